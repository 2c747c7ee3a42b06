"""Typed messages from transcripts: cleaned, and each text once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivano.functions import text as T
from scrivano.sources import transcripts

BANDS = ("1-5", "6-20", "21-50", "51+")


def band(words: Column) -> Column:
    return F.when(words <= 5, BANDS[0]).when(words <= 20, BANDS[1]).when(words <= 50, BANDS[2]).otherwise(BANDS[3])


def first_of_each(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Rows in which a text appears first, in the order of columns; nothing else decides.

    The first place of each text is an aggregate, so a text that fills a third of the rows needs no task to itself.
    """
    firsts = rows.groupBy(text).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(firsts.select(F.col("_first.*")).withColumnsRenamed({c: f"_{c}" for c in order}), [F.col(c) == F.col(f"_{c}") for c in order], "left_semi")


def messages(blocks: DataFrame) -> DataFrame:
    """Kept blocks: ts, project, session, words, text and their place (file, line_no, block_no)."""
    kept = blocks.withColumn("text", T.keep(F.col("text"))).where("text is not null")
    return kept.select("ts", "project", "session", T.py_word_count(F.col("text")).alias("words"), "text", "file", "line_no", "block_no")


def extract(spark: SparkSession, root: str) -> DataFrame:
    found = messages(transcripts.user_blocks(transcripts.sessions(spark, root)))
    return first_of_each(found, "text", ["file", "line_no", "block_no"])


def project_totals(rows: DataFrame, order: str) -> DataFrame:
    """Messages and words of each project, the most first, ties by first appearance."""
    return rows.groupBy("project").agg(F.count("*").alias("messages"), F.sum("words").alias("words"), F.min(order).alias("first")).orderBy(F.desc("messages"), "first").drop("first")


def length_bands(rows: DataFrame) -> DataFrame:
    """Messages of each band, with zeros for bands that have none."""
    bands = rows.sparkSession.createDataFrame([(b, i) for i, b in enumerate(BANDS)], "band string, position int")
    return bands.join(rows.groupBy(band(F.col("words")).alias("band")).agg(F.count("*").alias("n")), "band", "left").select("band", "position", F.coalesce("n", F.lit(0)).alias("messages"))


def summary(all_rows: DataFrame) -> DataFrame:
    """Of kept rows before the duplicates go: messages, their words, duplicates, projects, and the range of times in their own order."""
    texts = all_rows.groupBy("text").agg(F.count("*").alias("n"), F.min("words").alias("w"))
    ranges = all_rows.agg(F.min(F.when(F.col("ts") != "", F.col("ts"))).alias("first_ts"), F.max(F.when(F.col("ts") != "", F.col("ts"))).alias("last_ts"), F.countDistinct("project").alias("projects"))
    return texts.agg(F.count("*").alias("messages"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"), F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicates")).join(ranges, F.lit(True))


def stats(all_rows: DataFrame, order: str) -> DataFrame:
    """The lines of a report on kept rows before the duplicates go: totals, range of times, and a table of projects."""
    total = summary(all_rows)
    shown = lambda c: F.coalesce(c, F.lit("None"))
    head = [F.lit("# Corpus stats"), F.lit(""), F.format_string("Messages: %d, words: %d, duplicates skipped: %d", "messages", "words", "duplicates"), F.concat(F.lit("Range: "), shown("first_ts"), F.lit(" to "), shown("last_ts")), F.lit(""), F.lit("| project | messages | words |"), F.lit("|---|---|---|")]
    lines = total.select(F.posexplode(F.array(*head)).alias("at", "line")).select(F.lit(0).alias("part"), F.col("at").cast("long"), "line")
    firsts = all_rows.groupBy("text").agg(F.min(F.struct(order, "project", "words")).alias("m")).select("m.*")
    table = firsts.groupBy("project").agg(F.count("*").alias("messages"), F.sum("words").alias("words"), F.min(order).alias("first"))
    rows = table.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(F.desc("messages"), "first")).cast("long").alias("at"), F.format_string("| %s | %d | %d |", "project", "messages", "words").alias("line"))
    return lines.unionByName(rows)
