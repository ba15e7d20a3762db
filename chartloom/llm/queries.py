"""One query per operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r AS (SELECT row_number() OVER () AS row, doc_id, w FROM d),
s AS (SELECT row, unnest(range(1, len(w) - 33)) AS p FROM r WHERE len(w) >= 35),
h AS (SELECT s.row, s.p, md5(array_to_string(list_slice(r.w, s.p, s.p + 34), ' ')) AS m FROM s JOIN r USING (row)),
again AS (SELECT m FROM h GROUP BY m HAVING count(*) > 1),
gone AS (SELECT DISTINCT row, unnest(range(p, p + 35)) AS q FROM h SEMI JOIN again USING (m)),
lost AS (SELECT row, list(q) AS qs, count(*) AS n FROM gone GROUP BY row)
SELECT r.doc_id, len(r.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN l.n IS NULL THEN r.w ELSE
           list_transform(list_filter(list_zip(r.w, range(1, len(r.w) + 1)), lambda x: NOT list_contains(l.qs, x[2])), lambda x: x[1])
           END, ' ')) AS kept_sha256
FROM r LEFT JOIN lost l USING (row)
""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.anchors import remove_repeats
    stripped = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stripped.select("rest.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(list_slice(w, p, p + 4), ' ')) END) AS g FROM t),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS z FROM s UNION SELECT u.b, r.z FROM r JOIN u ON u.a = r.a WHERE r.z < u.b),
m AS (SELECT a AS doc_id, min(z) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
""")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.hyperminhash import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query(r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.cuckoo import exact_duplicates
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("content")


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from chartloom.llm.bpe import encode_texts
    coded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("rest.doc_id", F.expr("length(ids) DIV 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from chartloom.llm.vectorpack import pack_documents
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, mod `parts`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


@query()
def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.katz import score_texts
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held_out"))
    scored = score_texts(docs, ~F.col("held_out"))
    return scored.select("rest.doc_id", "rest.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.compresslid import classify, learn_dictionaries
    docs = table(spark, sf_dir, "documents")
    samples = learn_dictionaries(docs, fold("doc_id", 4) != 2, "lang")
    found = classify(docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out")), samples)
    return found.select("rest.doc_id", "rest.held_out", "lang_pred", "score", "rejected")


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.toxicity import learn, score_texts
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    scored = score_texts(docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out")), model)
    return scored.select("rest.doc_id", "rest.held_out", "score", "predicted")


@query()
def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.nndescent import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS f,
      array_to_string(list_transform(string_split(h, ''), lambda c: list_extract(
          ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
          instr('0123456789abcdef', c))), '') AS bits FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(0, 5), lambda j: (substr(bits, 5 * i + j + 1, 1) = '1')::INT * (16 >> j::INT)))::INT, 1)), '')
           AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM d
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.warc import archive_round_trip
    read = archive_round_trip(table(spark, sf_dir, "pages"), revisit_from=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM t LEFT JOIN l USING (doc_id)),
f AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
o AS (SELECT string_agg(x, '' ORDER BY p) AS filter_order, list(x ORDER BY p) AS o FROM (
      SELECT i, unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([i % 5, i // 5 % 5, i // 25 % 5, i // 125 % 5, i // 625]) AS p FROM range(3125) r(i))
      GROUP BY i HAVING count(DISTINCT p) = 5),
m AS (SELECT f.*, filter_order, list_transform(o, lambda x: fails[ascii(x) - 64]) AS bad FROM f, o),
k AS (SELECT *, unnest(range(1, 6)) AS step, coalesce(list_position(bad, true), 0) AS gone FROM m),
s AS (SELECT part, filter_order, step::INTEGER AS step,
      coalesce(sum(n) FILTER (gone = 0 OR gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (bad[step] AND gone < step), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (bad[step] AND len(list_filter(bad, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
      FROM k GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM s
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.filteraudit import audit, failure_counts
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit(failure_counts(table(spark, sf_dir, "documents"), labels, "lang"))


@query()
def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.mixture import taken
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.resampling import resample
    drawn = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("rest.doc_id", "n_features", "weight", "score", "rank")
