"""How filters interact: what each of them removes in every order in which they can be applied.

The states of the audit are the sets of filters applied so far, a lattice of 2^n states; an edge leaves a
state by applying one more filter. Documents are counted once per set of filters they fail; from these few
counts every edge gets what it removes. Counting the orders that reach a state from nothing (forward) and
that go on from it to the full set (backward) gives each edge the number of orders that use it: weighted
with it, the removals of a filter's edges sum to its Shapley total. One order is one path, so its steps are
read from the same edges. The lattice depends on the number of filters only, never on the data.

Texts are read once by native expressions. A filter that looks for earlier copies is settled by aggregates:
documents are counted per (text digest, part, flags, id), so a group of copies of any size leaves its tasks
as a few counts.

Defined results: a null text is empty, it has no words and fails the filter on words only (and equals other
empty texts); a null part is the empty string; rows count as often as they occur; a row without an id is
never a later copy, nor is one whose id only equals the smallest; a document with several label rows has
what any of them says; no rows give no parts. Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = "[#$%&*|]"
NAMES = "ABCDE"            # four filters on the text itself, then the one on earlier copies


def text_failures(text: Column) -> list[Column]:
    """Too few words, too few different words, too many capitals, symbols of markup."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def times(count: Column, percent: int) -> Column:
        return count.cast("long") * percent
    return [F.size(words) < MIN_WORDS,
            times(F.size(F.array_distinct(words)), 100) < times(F.size(words), DISTINCT_PERCENT),
            times(capitals, 100) > times(F.length(text), CAPITAL_PERCENT),
            text.rlike(SYMBOLS)]


def _bits(failures: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0))


def failure_counts(docs: DataFrame, flags: DataFrame, part: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, <a count per flag>): documents by the set of filters they fail.

    `flags` has the id and boolean columns; bits of `mask` are in the order of `NAMES`. The last filter
    fails what equals a text with a smaller id anywhere in `docs`.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [c for c in flags.columns if c != id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
                       _bits(text_failures(content)).alias("mask"), F.unhex(F.sha2(content, 256)).alias("digest"))
    known = flags.groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in names])
    rows = rows.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in names})
    group = ["digest", "mask", "part", *names]
    each = rows.groupBy(*group, "id").agg(F.count("*").alias("n"))
    least = each.groupBy(*group).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("at_first"),
                                     F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    # one row per digest, part and flags: as few as there are parts, however many copies
    smallest = F.min("first").over(Window.partitionBy("digest"))
    stays = F.col("nameless") + F.when(F.col("first") == smallest, F.col("at_first")).otherwise(0)
    split = least.withColumn("stays", stays)
    later = 1 << (len(NAMES) - 1)
    either = split.select("part", *names, F.explode(F.array(
        F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + later).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))).alias("e"))
    return either.where("e.n > 0").groupBy("part", "e.mask").agg(
        F.sum("e.n").alias("n"), *[F.sum(F.when(F.col(c), F.col("e.n")).otherwise(0)).alias(c) for c in names])


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, bit of the filter applied next, number of orders through this edge) by forward and backward counts."""
    states = range(1 << n)
    bits = [1 << i for i in range(n)]
    forward, backward = [0] * (1 << n), [0] * (1 << n)
    forward[0] = backward[-1] = 1
    for state in states:                              # a state comes after all its subsets
        forward[state] += sum(forward[state ^ b] for b in bits if state & b)
    for state in reversed(states):
        backward[state] += sum(backward[state | b] for b in bits if not state & b)
    return [(state, b, forward[state] * backward[state | b]) for state in states for b in bits if not state & b]


def paths(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, state, bit): the edges along every order."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    out = []
    for order in permutations(names):
        state = 0
        for step, name in enumerate(order, 1):
            out.append(("".join(order), step, state, bit[name]))
            state |= bit[name]
    return out


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """From (part, mask, n, flag counts): per part, filter_order and step what the step's filter does.

    kept, removed, redundant, unique_fails, <flag>_lost for each flag, shapley; all long, zeros included.
    """
    spark, n = counts.sparkSession, len(names)
    flags = [c for c in counts.columns if c not in ("part", "mask", "n")]
    edges = lattice(n)
    # 2^n masks at n * 2^(n-1) edges: says of each whether it counts there
    effects = [(mask, state, bit, orders, int(not mask & (state | bit)), int(bool(mask & bit) and not mask & state),
                int(bool(mask & bit) and bool(mask & state)), int(mask == bit))
               for mask in range(1 << n) for state, bit, orders in edges]
    table = spark.createDataFrame(effects, "mask int, state int, bit int, orders long, kept int, removed int, redundant int, unique_fails int")
    met = counts.join(F.broadcast(table), "mask")
    per_edge = met.groupBy("part", "state", "bit", "orders").agg(
        *[F.sum(F.col("n") * F.col(c)).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails")],
        *[F.sum(F.col(c) * F.col("removed")).cast("long").alias(f"{c}_lost") for c in flags])
    share = F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "bit"))     # 2^(n-1) edges
    steps = spark.createDataFrame(paths(names), "filter_order string, step int, state int, bit int")
    return (per_edge.withColumn("shapley", share).join(F.broadcast(steps), ["state", "bit"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in flags], "shapley"))

