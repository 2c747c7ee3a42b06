"""The message stages over a stream of transcript lines: stateless columns, deduplication within a watermark, Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivano.functions import lang
from scrivano.functions import text as T
from scrivano.operators import curate, registers


def read_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of files as they appear: value, file, arrived."""
    return spark.readStream.schema("value string").format("text").load(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.current_timestamp().alias("arrived"))


def typed(lines: DataFrame) -> DataFrame:
    """Kept, curated and scored messages of user lines whose content is a string or text blocks."""
    content = F.get_json_object("value", "$.message.content")
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    texts = F.when(blocks.isNotNull(), F.transform(F.filter(blocks, lambda b: b.type == "text"), lambda b: F.coalesce(b.text, F.lit("")))).otherwise(F.array(content))
    user = lines.where((F.get_json_object("value", "$.type") == "user") & (F.coalesce(F.get_json_object("value", "$.isSidechain"), F.lit("false")) != "true") & content.isNotNull())
    rows = user.select("file", "arrived", F.get_json_object("value", "$.timestamp").alias("ts"), F.explode(texts).alias("text"))
    rows = rows.withColumn("text", T.keep(F.col("text"))).where("text is not null")
    done = curate.curate(rows)
    return done.withColumns({**registers.score_columns(F.col("text")), "lang": lang.detect(F.col("text"))})


def first_seen(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each text once within the delay; state older than that is let go."""
    return rows.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["text"])


def run(spark: SparkSession, pattern: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes typed messages under out, by route; with once what is there now, else as files come."""
    writer = first_seen(typed(read_lines(spark, pattern))).writeStream.format("parquet").partitionBy("route").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows, late ones up to the delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
