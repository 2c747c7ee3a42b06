"""The owner's own messages from chat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.functions import lang
from scrivano.functions import text as T
from scrivano.sources import archives

LEAST_WORDS = 3


def owner(messages: DataFrame, sender: str, thread: list[str], order: list[str]) -> DataFrame:
    """The sender who is in most threads, of equals the first to appear: one row of sender and threads."""
    seen = messages.groupBy(sender, *thread).agg(F.min(F.struct(*order)).alias("first"))
    counts = seen.groupBy(sender).agg(F.count("*").alias("threads"), F.min("first").alias("first"))
    return counts.orderBy(F.desc("threads"), "first").limit(1).select(sender, "threads")


def ingest(spark: SparkSession, inbox: str, owner_name: str | None = None) -> DataFrame:
    """ts, source, lang, words, text of the owner's messages of three words or more, split by language."""
    rows = archives.chat_messages(spark, inbox).withColumn("sender", T.demojibake(F.col("sender")))
    who = spark.createDataFrame([(owner_name,)], "sender string") if owner_name else owner(rows, "sender", ["file", "thread"], ["file", "thread", "place"]).select("sender")
    own = rows.join(who, "sender", "left_semi").where("content is not null")
    own = own.withColumn("text", T.py_strip(T.url_strip(T.demojibake(F.col("content"))))).where(T.py_word_count(F.col("text")) >= LEAST_WORDS)
    own = own.withColumn("key", F.concat_ws("\u0001", "file", "thread", "place"))
    parts = lang.split(own.select("key", "text"), "key")
    return parts.join(own.select("key", "ts", "source"), "key").select("ts", F.concat(F.lit("chat:"), "source").alias("source"), "lang", T.py_word_count(F.col("text")).alias("words"), "text")


def dropped_others(rows: DataFrame, owner_name: str) -> DataFrame:
    """How many messages others than the owner sent: one row."""
    return rows.agg(F.count_if(~F.col("sender").eqNullSafe(F.lit(owner_name))).alias("not_owner"))


def words_by_language(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang").agg(F.sum("words").alias("words")).orderBy("lang")
