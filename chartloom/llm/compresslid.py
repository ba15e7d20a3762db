"""Language by compression: the language whose dictionary makes the text smallest.

For each label a raw-content zstandard dictionary is made from a bounded sample of labelled rows:
the `SAMPLE_ROWS` rows of that label with the smallest hash, up to `SAMPLE_CHARS` characters each and
`DICTIONARY_BYTES` in all. A text is encoded in blocks of `BLOCK` bytes, each with every dictionary, and
the sizes are added up over the whole text. The smallest sum wins (ties: the label first in order). The
margin to the second is turned into a score; narrow margins are rejected, with the best guess still
given in `lang_pred`. Case, digits and punctuation are levelled before coding.

Defined results: null texts, and texts without a letter, are `und` with score 0; without any labelled row
everything is; rows whose label is null teach nothing.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chartloom.llm.anchors import wrap

SAMPLE_ROWS = 200
SAMPLE_CHARS = 4_000
DICTIONARY_BYTES = 112 << 10
BLOCK = 512
LEVEL = 6
NARROW = 3                # bytes; a smaller lead is rejected
LETTER = regex.compile(r"\p{L}")
BETWEEN = re.compile(r"[\W\d_]+")
NONE = "und"


def letters(text: str) -> bytes:
    """The text as it is coded: lower-cased words with one space between."""
    return BETWEEN.sub(" ", text.lower()).encode()


def learn_dictionaries(df: DataFrame, train: Column, label: str, text: str = "text") -> dict[str, bytes]:
    """label -> dictionary content, from the rows where `train` holds."""
    rows = (df.where(train).select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").alias("text"))
            .where("label IS NOT NULL AND text IS NOT NULL AND text != ''"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("text"), F.length("text"))
    picked = (rows.select("label", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
              .withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_ROWS))
    samples: dict[str, bytes] = {}
    for row in picked.orderBy("label", "n").toLocalIterator():
        have = samples.get(row.label, b"")
        if len(have) < DICTIONARY_BYTES:
            samples[row.label] = (have + letters(row.text) + b"\n")[:DICTIONARY_BYTES]
    return samples


class Languages:
    def __init__(self, samples: dict[str, bytes]):
        import zstandard
        self.labels = sorted(samples)
        self.coders = []
        for label in self.labels:
            content = zstandard.ZstdCompressionDict(samples[label], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(label, score, rejected)"""
        if text is None or not self.labels or not LETTER.search(text):
            return NONE, 0.0, True
        sizes = self.sizes(letters(text))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        lead = sizes[order[1]] - sizes[order[0]] if len(order) > 1 else NARROW
        return self.labels[order[0]], 1 - 2.0 ** (-lead / 4), lead < NARROW


@lru_cache(maxsize=4)
def _languages(samples: tuple[tuple[str, bytes], ...]) -> Languages:
    return Languages(dict(samples))


def classify(df: DataFrame, samples: dict[str, bytes], text: str = "text") -> DataFrame:
    """text, rest (struct of the other columns), lang_pred, score, rejected."""
    wrapped = wrap(df, text)
    schema = T.StructType([*wrapped.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    arrow, model = to_arrow_schema(schema), tuple(sorted(samples.items()))

    def run(batches):
        languages = _languages(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                found = [languages.judge(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text"), batch.column("rest").cast(arrow.field("rest").type),
                     *(pa.array([f[i] for f in found], arrow.field(2 + i).type) for i in range(3))], schema=arrow)

    return wrapped.mapInArrow(run, schema)
