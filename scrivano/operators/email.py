"""The owner's own mail from mailboxes and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivano.functions import lang, mail
from scrivano.functions import text as T
from scrivano.sources import archives

LEAST_WORDS = 5


def owners(messages: DataFrame, source: str = "source", address: str = "address", order: str = "place") -> DataFrame:
    """The most frequent address of each source, of equals the first to appear: source, address, n."""
    counts = messages.groupBy(source, address).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy(F.desc("n"), "first"))).where("rank = 1").select(source, address, "n")


def records(messages: DataFrame) -> DataFrame:
    """Cleaned messages (key, text) that are no bounces, split by language; chunks under five words go."""
    clean = messages.where(~mail.is_bounce(F.col("text")) & (T.py_word_count(F.col("text")) >= LEAST_WORDS))
    parts = lang.split(clean, "key").withColumn("words", T.py_word_count(F.col("text")))
    return parts.where(F.col("words") >= LEAST_WORDS)


def judged(rows: DataFrame) -> DataFrame:
    """Messages (of archives.mail_messages) with `own`: whether the sender is the source's owner.

    In Outlook archives empty senders are no owners. Only owners' bodies are cleaned; the others' text is null.
    """
    rows = rows.withColumns({"address": mail.from_address(F.col("sender")), "key": F.concat_ws("\u0001", "source", "place")})
    who = owners(rows.where((F.col("address") != "") | (F.col("archive") != "olm"))).select("source", F.col("address").alias("owner"))
    html = F.col("kind") == "html"
    # References are decoded in Python, to which all rows go: those without markup go without their bodies.
    body = F.when(html, mail.html_to_text(F.when(html, F.col("body")))).otherwise(F.col("body"))
    rows = rows.join(who, "source", "left").withColumn("own", F.col("address") == F.coalesce("owner", F.lit("")))
    # Side by side, so that one worker does both.
    rows = rows.select("key", "source", "own", mail.format_date(F.col("sent")).alias("ts"), body.alias("body"))
    # What generates rows is computed once, where filters on the text would be inlined.
    return rows.select("key", "source", "own", "ts", F.explode(F.array(F.when(F.col("own"), mail.clean(F.col("body"))))).alias("text"))


def ingest_rows(rows: DataFrame) -> DataFrame:
    own = judged(rows).where("own")
    # The key has what each chunk keeps of its message, so that messages aren't parsed again to be joined.
    parts = records(own.select(F.struct("key", "source", "ts").alias("key"), "text"))
    return parts.select("key.ts", "key.source", "lang", "words", "text")


def ingest(spark: SparkSession, inbox: str) -> DataFrame:
    """ts, source, lang, words, text of what each source's owner wrote."""
    return ingest_rows(archives.mail_messages(spark, inbox))


def counters(rows: DataFrame) -> DataFrame:
    """One row: kept, skipped and not_owner of judged messages (own, text).

    A message that is too short or a bounce is skipped once, and so is each of its chunks under LEAST_WORDS words.
    """
    sizes = F.transform(lang.chunks(F.col("text")), lambda c: T.py_word_count(c.text))
    whole = (T.py_word_count(F.col("text")) < LEAST_WORDS) | mail.is_bounce(F.col("text"))
    each = rows.select("own", F.when(F.col("own"), F.when(whole, F.array(F.lit(0))).otherwise(sizes)).alias("sizes"))
    kept, skipped = (F.sum(F.size(F.filter(F.coalesce("sizes", F.array().cast("array<int>")), f))) for f in (lambda n: n >= LEAST_WORDS, lambda n: n < LEAST_WORDS))
    return each.agg(F.coalesce(kept, F.lit(0)).alias("kept"), F.coalesce(skipped, F.lit(0)).alias("skipped"), F.count_if(~F.col("own")).alias("not_owner"))
