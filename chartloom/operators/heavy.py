"""Frequent n-grams by a mergeable summary, and the presence of the frequent ones as blocks of term numbers.

`summary` reads every document once. A task counts, per run of documents, in how many of them each n-gram
occurs, takes `SLACK` of the run's documents off every count and keeps what is left; kept counts are at most
that much too small, and an n-gram left out had no more. The summaries of all tasks add up: counts by n-gram,
errors altogether. What can be in more than a tenth of the documents is then in more than the rest of a tenth by the
summary, and that is few n-grams: fewer than `KEEP` mean documents hold, whatever the order of the documents.

`frequent_ngrams` makes words of the texts once: the summary's pass also stores each run as word numbers (`coded`), and the
candidates are counted in these.

`presence_blocks` reads the documents once more with these candidates, and stores for each run of documents
the numbers of the candidates they hold. Exact frequencies, the vocabulary and the presence matrix all follow from the blocks;
no list of terms ever becomes part of a plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chartloom.functions.messages import pack, unpack
from chartloom.functions.text import word_tokens
from chartloom.sources.checkpoints import materialise

RUN_WORDS = 400_000       # words of a run of documents; a longer document is a run by itself
SLACK = 40                # a run's counts give up one fortieth of its documents, a task's tables another fortieth
TABLE = 200_000           # entries of a task's table before it gives up counts
KEEP = 20                 # 1 / (a tenth - two fortieths) rounded up, and room
SEPARATOR = " "


def _runs(tokens: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, pa.Array, np.ndarray]]:
    """(first document, document after the last, document of each word, distinct words, word numbers) of runs of whole documents."""
    lengths = np.nan_to_num(tokens.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    ends, start, flat = np.cumsum(lengths), 0, tokens.flatten()
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + RUN_WORDS, side="right")))
        coded = flat.slice(base, ends[stop - 1] - base).dictionary_encode()
        document = np.repeat(np.arange(stop - start), lengths[start:stop])
        yield start, stop, document, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start = stop


def _grams(document: np.ndarray, words: np.ndarray, base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, code and first place of all n-grams; equal n-grams have equal codes. No n-gram holds a word numbered -1."""
    last = max(0, len(words) - n + 1)
    whole = document[n - 1:] == document[:last]
    for k in range(n):
        whole &= words[k:last + k] >= 0
    inside = np.flatnonzero(whole)
    code = words[inside]
    for k in range(1, n):
        if len(code) and int(code.max()) >= 2**62 // base:
            code = np.unique(code, return_inverse=True)[1]
        code = code * base + words[inside + k]
    return document[inside], code, inside


def _once(document: np.ndarray, code: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by code and document, each pair once."""
    by = np.lexsort((document, code))
    document, code, place = document[by], code[by], place[by]
    first = np.ones(len(code), dtype=bool)
    first[1:] = (code[1:] != code[:-1]) | (document[1:] != document[:-1])
    return document[first], code[first], place[first]


def _in_more(document: np.ndarray, words: np.ndarray, base: int, n: int, documents: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams in more than `slack` of the documents, a line of word numbers each, and in how many they are."""
    here, code, place = _grams(document, words, base, n)
    if base**n * documents < 2**62:                # a pair is one number, and a code can be read back
        pairs = np.sort(code * documents + here)
        code = pairs[np.diff(pairs, prepend=-1) != 0] // documents
        start = np.flatnonzero(np.diff(code, prepend=-1))
        count = np.diff(start, append=len(code))
        left, lines = code[start[count > slack]], []
        for _ in range(n):
            left, word = np.divmod(left, base)
            lines.append(word)
        return np.stack(lines[::-1], axis=1), count[count > slack]
    _, code, place = _once(here, code, place)
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return words[place[first[count > slack]][:, None] + np.arange(n)], count[count > slack]


class Counts:
    """A task's table: n-gram -> a count at most `error` too small. Tables of two tasks add up."""

    def __init__(self, high: int = 3, table: int = TABLE):
        self.high, self.table = high, table
        self.counts: dict[str, int] = {}
        self.documents = self.error = self.spent = 0

    def add(self, documents: int, document: np.ndarray, names: pa.Array, words: np.ndarray) -> None:
        """A run: its number of documents, and the document and number of each word."""
        slack = documents // SLACK
        for n in range(1, self.high + 1):
            lines, count = _in_more(document, words, max(1, len(names)), n, documents, slack)
            if n == 1:                             # no n-gram is in more documents than each of its words
                number = np.full(len(names), -1)
                number[lines[:, 0]] = np.arange(len(lines))
                words, names = number[words], names.take(pa.array(lines[:, 0]))
                lines, held = np.arange(len(lines))[:, None], names.to_pylist()
            for line, more in zip(lines.tolist(), (count - slack).tolist()):
                term = SEPARATOR.join([held[w] for w in line])
                self.counts[term] = self.counts.get(term, 0) + more
        self.documents += documents
        self.error += slack
        if len(self.counts) > self.table:
            self.shrink()

    def shrink(self) -> None:
        """Take off all counts what the documents so far allow."""
        off = self.documents // SLACK - self.spent
        if off > 0:
            self.spent += off
            self.error += off
            self.counts = {t: c - off for t, c in self.counts.items() if c > off}


def _tokens(df: DataFrame, body: str, keys: list[str] = ()) -> DataFrame:
    return df.select(*keys, word_tokens(F.coalesce(F.col(f"`{body}`"), F.lit(""))).alias("_tokens"))


SUMMARY = "term string, n long, documents long, error long"


def coded(df: DataFrame, body: str, high: int = 3, table: int = TABLE) -> DataFrame:
    """(run, term, n, documents, error): a row per run of documents, as a message of its different words and their numbers,
    and what `summary` lists, with no run."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts(high, table)
        for batch in batches:
            for start, stop, document, names, words in _runs(batch.column(0)):
                held.add(stop - start, document, names, words)
                one = pa.table({"names": pa.ListArray.from_arrays([0, len(names)], names), "words": pa.ListArray.from_arrays([0, len(words)], pa.array(words.astype(np.int32))),
                                "document": pa.ListArray.from_arrays([0, len(words)], pa.array(document.astype(np.int32))), "documents": [stop - start]})
                yield pa.RecordBatch.from_arrays([pa.array([pack(one)], pa.binary()), pa.nulls(1, pa.string()), *(pa.nulls(1, pa.int64()) for _ in range(3))],
                                                 names=["run", "term", "n", "documents", "error"])
        terms, none = list(held.counts), [0] * len(held.counts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(terms) + 1, pa.binary()), pa.array([None, *terms], pa.string()), *(pa.array(x, pa.int64()) for x in (
                [0, *held.counts.values()], [held.documents, *none], [held.error, *none]))], names=["run", "term", "n", "documents", "error"])

    return _tokens(df, body).mapInArrow(count, f"run binary, {SUMMARY}")


def summary(df: DataFrame, body: str, high: int = 3, table: int = TABLE) -> DataFrame:
    """(term, n, documents, error): the tasks' tables, and one row without a term per task with its documents and error."""
    return coded(df, body, high, table).where("run IS NULL").drop("run")


@dataclass(frozen=True)
class Candidates:
    terms: list[str]          # whatever can be in more than a tenth of the documents, sorted
    documents: int
    exact: list[int] | None   # in how many documents each is, if the summary had no error


def candidates(df: DataFrame, body: str, high: int = 3, table: int = TABLE) -> Candidates:
    """At most as many terms as `KEEP` mean documents hold reach the driver."""
    return _possible(materialise(summary(df, body, high, table)))


def _possible(merged: DataFrame) -> Candidates:
    whole = merged.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("error"), F.lit(0)).alias("error")).first()
    possible = (merged.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
                .where((F.col("n") + whole["error"]) * 10 > whole["documents"]))
    found = sorted((r["term"], r["n"]) for r in possible.collect())
    return Candidates([t for t, _ in found], whole["documents"], None if whole["error"] else [n for _, n in found])


class Index:
    """Finds the numbers of listed terms in runs of documents. Terms are coded over the words they are made of."""

    def __init__(self, terms: list[str]):
        split, self.size = [t.split(SEPARATOR) for t in terms], len(terms)
        self.words = {w: i for i, w in enumerate(sorted({w for s in split for w in s}))}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(s) for s in split}):
            mine = [(self._code([self.words[w] for w in s]), k) for k, s in enumerate(split) if len(s) == n]
            mine.sort()
            self.by_length[n] = np.array([c for c, _ in mine], dtype=np.int64), np.array([k for _, k in mine], dtype=np.int64)

    def _code(self, numbers: list[int]) -> int:
        code = 0
        for x in numbers:
            code = code * len(self.words) + x
        return code

    def find(self, document: np.ndarray, names: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, term number), sorted, each pair once."""
        listed = pa.array(list(self.words), names.type)          # in the order of their numbers
        known = pc.fill_null(pc.index_in(names, value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = known[words] if len(words) else words
        documents, terms = [], []
        for n, (codes, term) in self.by_length.items():
            here, code, _ = _grams(document, numbers, len(self.words), n)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            documents.append(here[hit])
            terms.append(term[at[hit]])
        if not documents:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(documents) * self.size + np.concatenate(terms))
        return pairs // self.size, pairs % self.size


@dataclass(frozen=True)
class Presence:
    """blocks (keys as arrays, terms: an array of term numbers per document) over the listed terms."""

    blocks: DataFrame
    keys: list[str]
    terms: list[str]

    def frequency(self) -> DataFrame:
        """(number, df): in how many documents each term is; terms of no document are left out."""
        size = len(self.terms)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, dtype=np.int64)
            for batch in batches:
                total += np.bincount(batch.column(0).flatten().flatten().to_numpy(zero_copy_only=False), minlength=size)
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["number", "df"])
        return self.blocks.select("terms").mapInArrow(count, "number int, df long").groupBy("number").agg(F.sum("df").alias("df"))

    def rows(self) -> DataFrame:
        """(keys, terms): a document's term numbers in order."""
        return self.blocks.select(F.inline(F.arrays_zip(*self.keys, "terms")))

    def matrix(self) -> DataFrame:
        """(keys, term), a row for each term a document holds."""
        listed = self.blocks.sparkSession.createDataFrame(list(enumerate(self.terms)), "number int, term string")
        # as many rows as the vocabulary has terms: fewer than `KEEP` mean documents hold
        return (self.rows().select(*self.keys, F.explode("terms").alias("number")).join(F.broadcast(listed), "number").select(*self.keys, "term"))


def presence(df: DataFrame, keys: list[str], body: str, terms: list[str]) -> Presence:
    """Which of `terms` each document holds, in blocks of documents; one tokenisation."""
    source = _tokens(df, body, keys)
    named = source.select(*keys).schema
    schema = ", ".join([*(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in named), "terms array<array<int>>"])
    kinds = [to_arrow_type(f.dataType) for f in named]
    index = Index(terms)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, document, names, words in _runs(batch.column(len(keys))):
                document, term = index.find(document, names, words)
                offsets = np.searchsorted(document, np.arange(stop - start + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(term.astype(np.int32)))
                ends = pa.array([0, stop - start], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.ListArray.from_arrays(ends, batch.column(i).slice(start, stop - start).cast(kind)) for i, kind in enumerate(kinds)),
                     pa.ListArray.from_arrays(ends, lists)], names=[*keys, "terms"])

    return Presence(source.mapInArrow(find, schema), list(keys), list(terms))


def _counted(stored: DataFrame, terms: list[str]) -> DataFrame:
    """(number, df): in how many documents of the stored runs each of `terms` is; terms of no document are left out."""
    index, size = Index(terms), len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for message in batch.column(0):
                for run in unpack(message):
                    document, words = (run.column(c)[0].values.to_numpy().astype(np.int64) for c in ("document", "words"))
                    total += np.bincount(index.find(document, run.column("names")[0].values, words)[1], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["number", "df"])
    runs = stored.where("run IS NOT NULL").select("run").mapInArrow(count, "number int, df long")
    return runs.groupBy("number").agg(F.sum("df").alias("df"))


def _in_order(terms: list[str]) -> list[str]:
    return sorted(terms, key=lambda t: (t.count(SEPARATOR), t))


def frequent_ngrams(df: DataFrame, body: str, high: int = 3, table: int = TABLE) -> list[str]:
    """Word 1..high-grams in more than a tenth of the documents, by length, then alphabetically."""
    stored = materialise(coded(df, body, high, table))
    found = _possible(stored.where("run IS NULL").drop("run"))
    if found.exact is not None:
        return _in_order([t for t, n in zip(found.terms, found.exact) if n * 10 > found.documents])
    counted = _counted(stored, found.terms).where(F.col("df") * 10 > found.documents)
    return _in_order([found.terms[r["number"]] for r in counted.collect()])
