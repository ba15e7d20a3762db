"""Reading source tables and writing stage and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from chartloom.schemas import DATE_COLUMNS


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Headed CSV with quoted, possibly multi-line, text; the schema is given, never inferred.

    A multi-line file cannot be split, so deliver large exports as many files (or convert them
    once with `write_stage`); parallelism here is per file.
    """
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"')
            .option("encoding", encoding)
            .csv(path))


def read_note_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Note exports are windows-1252; needs spark.sql.legacy.javaCharsets (see `build_session`)."""
    return read_csv(spark, path, schema, encoding="windows-1252")


def parse_dates(df: DataFrame, columns=DATE_COLUMNS, fmt: str = "M/d/yyyy") -> DataFrame:
    """Text dates become DateType once, at ingest. An unreadable or empty date becomes null."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("date") for c in present})


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage table as parquet and return it re-read: later stages start from files."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Report sink with a header and no index column."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """A user-kept word list, one term per line (for instance the site's stop words)."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("term"))
    return sorted({r.term for r in rows.collect()})
