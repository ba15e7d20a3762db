"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last of the prefix's encoding. Reading the
piece byte by byte, an automaton over the vocabulary gives the tokens that end here, longest first;
a token is the one sought if its encoding stays apart from the last token of what is left before it,
that is if no merge of lower rank would have joined pieces across the border. The tokens stored for
the prefixes are back-pointers from the end.

The vocabulary file stays outside the repository and its path is a parameter. Each Python worker loads
it once. Pieces are independent, so a bounded table keeps those seen; longer ones are encoded anew.

Defined results: a null text is empty and has no tokens; special tokens spelled out in a text are their
own ids, as the file's library has it; other columns of any name pass through.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chartloom.llm.anchors import wrap
from chartloom.llm.store import claim_worker

# the pre-tokenizer's pattern: fixed, part of the public vocabulary's definition
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KNOWN_PIECES = 400_000
KNOWN_PAIRS = 1_000_000
LONGEST_KNOWN = 64
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in plain]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in name) for name, i in vocab.items()
                                        if name not in self.special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        made = {vocab[a + b]: (r, vocab[a], vocab[b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        # the pieces at a token's right and left edge, each with the rank of the merge that ends it
        self.right = {t: self._edge(t, made, 2) for t in self.bytes}
        self.left = {t: self._edge(t, made, 1) for t in self.bytes}
        self._automaton()
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.whole = {b: t for t, b in self.bytes.items() if t not in self.special.values()}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = _Known(self)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def _edge(token: int, made: dict, side: int) -> list[tuple[int, int]]:
        edge, ended = [(token, NEVER)], made.get(token)
        while ended:
            token, ended = ended[side], (ended[0], made.get(ended[side]))
            edge.append((token, ended[0]))
            ended = ended[1]
        return edge

    def _automaton(self) -> None:
        """State: the longest suffix of what was read that some token starts with."""
        self.go: dict[int, int] = {}
        ends, count = {}, 1
        for token, name in self.bytes.items():
            state = 0
            for byte in name:
                key = state << 8 | byte
                state = self.go.get(key)
                if state is None:
                    state = self.go[key] = count
                    count += 1
            ends[state] = token
        children: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        for key, state in self.go.items():
            children[key >> 8].append((key & 255, state))
        self.fall, self.longest = [0] * count, [-1] * count
        self.shorter: dict[int, int] = {}
        queue = deque([0])
        while queue:
            state = queue.popleft()
            if state:
                inherited = self.longest[self.fall[state]]
                token = ends.get(state)
                if token is None:
                    self.longest[state] = inherited
                else:
                    self.longest[state] = token
                    self.shorter[token] = inherited
            for byte, child in children[state]:
                back = self.fall[state]
                while back and back << 8 | byte not in self.go:
                    back = self.fall[back]
                self.fall[child] = self.go.get(back << 8 | byte, 0) if state else 0
                queue.append(child)

    def apart(self, one: int, two: int) -> bool:
        """Would the two tokens, next to each other, stay as they are?"""
        key = one << 20 | two
        known = self.pairs.get(key)
        if known is None:
            known = True
            for x, x_ends in self.right[one]:
                for y, y_ends in self.left[two]:
                    rank = self.rank.get(x << 20 | y)
                    # of equal merges the left one comes first
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        known = False
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        token = self.whole.get(piece)
        if token is not None:
            return [token]
        go, fall, longest, shorter, size, apart = self.go, self.fall, self.longest, self.shorter, self.bytes, self.apart
        last, state = [0] * (len(piece) + 1), 0
        for end, byte in enumerate(piece, 1):
            following = go.get(state << 8 | byte)
            while following is None and state:
                state = fall[state]
                following = go.get(state << 8 | byte)
            state = following or 0
            token = longest[state]
            before = end - len(size[token])
            while before and not apart(last[before], token):
                token = shorter[token]
                before = end - len(size[token])
            last[end] = token
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(size[last[end]])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.pieces
        if self.split is None or not any(s in text for s in self.special):
            return b"".join(map(known.__getitem__, PIECES.findall(text)))
        parts = self.split.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else
                        b"".join(map(known.__getitem__, PIECES.findall(p))) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Known(dict):
    """Pieces and their ids; emptied when it has `KNOWN_PIECES`."""

    def __init__(self, coder: PrefixBpe):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.coder.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_KNOWN:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def coder(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_texts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """text, rest (struct of the other columns), ids (binary, little-endian unsigned 32-bit), decoded."""
    wrapped = wrap(df, text)
    schema = T.StructType([*wrapped.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        claim_worker("pieces", coder.cache_clear)
        bpe = coder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text"), batch.column("rest").cast(arrow.field("rest").type), pa.array(ids, pa.binary()),
                     pa.array([bpe.decode(x) for x in ids], pa.string())], schema=arrow)

    return wrapped.mapInArrow(run, schema)
