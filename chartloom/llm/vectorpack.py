"""Packing of examples into sequences under several limits at once, by the dot-product heuristic.

An example is its token ids and the place from which they bear loss. A sequence is limited in tokens,
in segments and in loss-bearing tokens. Each limit is one dimension; the open sequence takes the
example whose (share of each limit) has the largest dot product with what the sequence has left, so an
example heavy in what is still free goes first. Where no example fits whole, the one with the largest
dot product is cut to what is left; a whole sequence's worth of a long example is cut off beforehand.

Every task packs its own rows from a pool, so nothing is shuffled and no row count matters. The pool has
`POOL` examples, and more of short ones, until it holds a sequence's tokens or segments. What is left in a task's last
sequence is cut at powers of two, which need no padding. The limit on segments is off (none is as many as tokens)
unless it is given.

Defined results: a null text is empty, its only token the end; rows repeat freely; no rows give none.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from chartloom.llm.bpe import byte_letters
from chartloom.llm.store import binary_sizes, claim_worker, row_slices

TOKENS = 4096
LOSS = 4096
POOL = 256
END = 2
SLICE = 4 << 20           # bytes of texts encoded together
KNOWN_WORDS = 700_000
KNOWN_IDS = 8_000_000     # of all known words together
LONGEST_KNOWN = 64
# how the vocabulary file cuts lower-cased text: fixed
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Pieces(dict):
    """Ids of lower-cased pieces; emptied when it has `KNOWN_WORDS`."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, {b: c for c, b in byte_letters().items()}

    def __missing__(self, piece: str) -> array:
        spelled = piece if piece.isascii() and piece.isalpha() else "".join(self.letters[b] for b in piece.encode())
        ids = array("I", [t.id for t in self.model.tokenize(spelled)])
        if len(self) >= KNOWN_WORDS:
            self.clear()
        if len(piece) <= LONGEST_KNOWN:
            self[piece] = ids
        return ids


class WordIds:
    """Ids of words between ASCII white space, which no token of the vocabulary spans.

    Latin words are cut into the vocabulary's pieces here and each new piece goes to the library's
    model; whatever needs the library's normaliser (other scripts, special tokens) goes through all of it.
    The ids of all known words lie one after the other in one array; a text's ids are gathered from it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = Pieces(self.tokenizer)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = array("I"), array("q", [0])       # word k has the ids from starts[k] to starts[k + 1]

    def _learn(self, words: list[str]) -> None:
        other, pieces, ids, known, starts = [], self.pieces, self.ids, self.known, self.starts
        for word in words:
            ascii = word.isascii()
            if ascii and word.isalpha():                    # one run of letters is one piece
                ids.extend(pieces[word.lower()])
            # below this letter text is in normal form already and lower case is letter by letter
            elif (ascii or (max(word) < "\u0250" and "\u0130" not in word)) and "<|" not in word:
                for piece in PIECES.findall(word.lower()):
                    ids.extend(pieces[piece])
            else:
                other.append(word)
                continue
            known[word] = len(known)
            starts.append(len(ids))
        for word, encoded in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            ids.extend(encoded.ids)
            known[word] = len(known)
            starts.append(len(ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin in them."""
        if len(self.known) > KNOWN_WORDS or len(self.ids) > KNOWN_IDS:
            self.forget()
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words, known = coded.dictionary.to_pylist(), self.known
        self._learn([w for w in words if w not in known])
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        starts = np.array(self.starts)
        begin, length = starts[number], starts[number + 1] - starts[number]
        until = np.concatenate([[0], np.cumsum(length)])
        ids = np.array(self.ids, dtype="<u4")[np.repeat(begin - until[:-1], length) + np.arange(until[-1])]
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        return ids, until[ends]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Sequences of (example, start, length) pieces; `give` adds an example, `rest` ends the stream."""

    def __init__(self, tokens: int = TOKENS, segments: int | None = None, loss: int = LOSS, pool: int = POOL):
        segments = segments or tokens         # a segment has a token at least
        self.limits = np.array([tokens, segments, loss], dtype=np.int64)
        self.pool = pool
        self.items: list[tuple[int, int, int, int]] = []      # example, start, tokens left, first loss-bearing place
        self.sizes = np.zeros((2 * max(pool, segments) + 2, 3), dtype=np.int64)

    def _loss(self, start: int, length: int, first: int) -> int:
        return max(0, start + length - max(start, first))

    def _put(self, example: int, start: int, left: int, first: int) -> None:
        self.sizes[len(self.items)] = left, 1, self._loss(start, left, first)
        self.items.append((example, start, left, first))

    def _drop(self, at: int) -> None:
        last = self.items.pop()
        if at < len(self.items):
            self.items[at] = last
            self.sizes[at] = self.sizes[len(self.items)]

    def give(self, example: int, n: int, first: int = 0) -> Iterator[list[tuple[int, int, int]]]:
        start = 0
        while n - start >= self.limits[0] and self._loss(start, int(self.limits[0]), first) <= self.limits[2]:
            yield [(example, start, int(self.limits[0]))]
            start += int(self.limits[0])
        if n > start:
            self._put(example, start, n - start, first)
        while len(self.items) >= self.pool and self._enough():
            yield self._fill()

    def _enough(self) -> bool:
        """Whether the pool holds a sequence's tokens or segments."""
        return len(self.items) >= self.limits[1] or self.sizes[:len(self.items), 0].sum() >= self.limits[0]

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        while self.items:
            pieces = self._fill()
            if self.items or sum(p[2] for p in pieces) == self.limits[0]:
                yield pieces
            else:
                yield from powers_of_two(pieces)

    def _fill(self) -> list[tuple[int, int, int]]:
        pieces, free = [], self.limits.copy()
        while self.items and free[0] and free[1]:
            sizes = self.sizes[:len(self.items)]
            score = (sizes / self.limits ** 2) @ free
            fits = (sizes <= free).all(axis=1)
            at = int(np.argmax(np.where(fits, score, -1.0))) if fits.any() else int(np.argmax(score))
            example, start, left, first = self.items[at]
            length = left
            if not fits[at]:
                length = min(left, int(free[0]), max(0, first - start) + int(free[2]))
                if not length:
                    break
            pieces.append((example, start, length))
            free -= [length, 1, self._loss(start, length, first)]
            self._drop(at)
            if length < left:
                self._put(example, start + length, left - length, first)
        return pieces


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces, in order, as sequences whose lengths are the binary digits of their sum."""
    total, queue = sum(p[2] for p in pieces), list(pieces)[::-1]
    for bit in reversed(range(total.bit_length())):
        room, out = total & 1 << bit, []
        while room:
            example, start, length = queue.pop()
            took = min(room, length)
            out.append((example, start, took))
            room -= took
            if took < length:
                queue.append((example, start + took, length - took))
        if out:
            yield out


SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", loss_from: str | None = None,
                   tokens: int = TOKENS, segments: int | None = None, loss: int = LOSS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    `loss_from` names an integer column: the first token of the row that bears loss (null: all do).
    """
    first = F.coalesce(F.col(f"`{loss_from}`").cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), first.alias("first"))
    schema = SCHEMA.format(id=df.schema[id_col].dataType.simpleString())

    def run(batches):
        from pyspark import TaskContext
        sequence = TaskContext.get().partitionId() << 32
        claim_worker("words", word_ids.cache_clear)
        encoder, packer, held, count = word_ids(path), Packer(tokens, segments, loss), {}, 0
        kind, rows = None, []

        def write(pieces):
            nonlocal sequence
            offset = 0
            for example, start, length in pieces:
                doc, ids, left = held[example]
                rows.append((doc, start, length, ids[4 * start:4 * (start + length)], len(ids) // 4, sequence, offset))
                offset += length
                if left == length:
                    del held[example]
                else:
                    held[example] = (doc, ids, left - length)
            sequence += 1

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)),
                 pa.array([r[3] for r in rows], pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (4, 5, 6))],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids_of, firsts = batch.column("doc_id").to_pylist(), batch.column("first").to_pylist()
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            for begin, end in row_slices(binary_sizes(texts), SLICE):
                coded, at = encoder.encode(texts.slice(begin, end - begin))
                for i in range(begin, end):
                    ids = coded[at[i - begin]:at[i - begin + 1]].tobytes() + END.to_bytes(4, "little")
                    held[count] = (ids_of[i], ids, len(ids) // 4)
                    for pieces in packer.give(count, len(ids) // 4, firsts[i]):
                        write(pieces)
                    count += 1
                if rows:
                    yield flush()
        for pieces in packer.rest():
            write(pieces)
        if rows:
            yield flush()

    return source.mapInArrow(run, schema)
