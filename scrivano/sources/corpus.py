"""Readers and writers of corpora, profiles and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str, placed: bool = False) -> DataFrame:
    """A strict reader: blank lines are left out, a malformed line is an error. placed adds each line's place, by file."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not placed:
        return rows
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.select("*", place.alias("place"))


def optional_jsonl(spark: SparkSession, path: str, schema: str, placed: bool = False) -> DataFrame | None:
    try:
        return read_jsonl(spark, path, schema, placed)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def listing(spark: SparkSession, corpus: str) -> list[DataFrame | None]:
    """The corpora in order: tagged and salvaged messages, all email-* and all chat-* files by name; None where there are none."""
    parts = (("tagged.jsonl", schemas.TAGGED), ("salvaged.jsonl", schemas.SALVAGED), ("email-*.jsonl", schemas.EMAIL), ("chat-*.jsonl", schemas.CHAT))
    return [optional_jsonl(spark, f"{corpus}/{name}", schema, placed=True) for name, schema in parts]


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """A report of a few lines as one text file in a folder."""
    lines.orderBy(*order).coalesce(1).select("line").write.mode("overwrite").text(path)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def write_by_source(rows: DataFrame, path: str) -> None:
    """One folder a source under path; the rows keep their source, as they are read by folders of any depth."""
    rows.withColumn("name", F.regexp_replace("source", "[^A-Za-z0-9._-]+", "-")).write.mode("overwrite").partitionBy("name").json(path)


def write_profiles(prints: DataFrame, folder: str) -> None:
    prints.write.mode("overwrite").partitionBy("bucket").json(folder)


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
