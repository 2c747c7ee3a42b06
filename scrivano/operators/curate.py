"""Curation of raw messages into three routes, and salvage of typed fragments from quarantined ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano import constants as C
from scrivano.functions import text as T
from scrivano.operators import registers
from scrivano.sources import shared

ROUTES = ("curated", "quarantine", "ai-marked", "dropped")


def route(text: Column, words: Column) -> Column:
    """Where a stripped text goes; the checks come in this order."""
    pasted = F.substring(text, 1, 1).isin("{", "[") & (T.occurrences(text, '":') >= 2)
    return F.when(words == 0, "dropped").when(pasted, "dropped").when(text.contains("—"), "ai-marked").when(words <= C.MAX_TYPED_WORDS, "curated").otherwise("quarantine")


def curate(raw: DataFrame) -> DataFrame:
    """raw with text stripped, words counted anew, raw_words (the former count), route, and excluded for AI-marked rows."""
    before = F.col("words") if "words" in raw.columns else T.py_word_count(F.col("text"))
    counted = T.let(T.strip_machine_text(F.col("text")), lambda t: F.struct(t.alias("text"), T.py_word_count(t).alias("words")))
    # What generates rows is computed once, where filters on the words or the route would be inlined.
    done = raw.withColumns({"raw_words": before, "_s": F.explode(F.array(counted))}).withColumns({"text": F.col("_s.text"), "words": F.col("_s.words")}).drop("_s")
    return done.withColumn("route", route(F.col("text"), F.col("words"))).withColumn("excluded", F.when(F.col("route") == "ai-marked", "ai-marker-emdash"))


def write_routes(curated: DataFrame, folder: str) -> None:
    """One folder a route under folder; every route is there even where it is empty. The rows are computed and written once."""
    spark, staged = curated.sparkSession, f"{folder}/_{uuid.uuid4().hex}"
    try:
        # Rows that aren't AI-marked have no `excluded`, so it is not in their lines.
        curated.where(F.col("route").isin(*ROUTES[:3])).write.partitionBy("route").option("ignoreNullFields", True).json(staged)
        for name in ROUTES[:3]:
            shared.replace_folder(spark, f"{staged}/route={name}", f"{folder}/{name}")
    finally:
        shared.delete(spark, staged)


def route_totals(curated: DataFrame) -> DataFrame:
    return curated.groupBy("route").agg(F.count("*").alias("messages"), F.sum("words").alias("words"))


def stats(curated: DataFrame) -> DataFrame:
    """The lines of a report on routed messages: at and line."""
    found = {name: (F.count_if(F.col("route") == name), F.coalesce(F.sum(F.when(F.col("route") == name, F.col("words"))), F.lit(0))) for name in ROUTES}
    one = curated.agg(*(c.alias(f"{name}_{i}") for name, pair in found.items() for i, c in enumerate(pair)))
    said = [F.lit("# Curated corpus stats"), F.lit(""), F.format_string("Kept: %d messages, %d words", "curated_0", "curated_1"), F.format_string("Quarantined (over %d words): %d messages, %d words", F.lit(C.MAX_TYPED_WORDS), "quarantine_0", "quarantine_1"), F.format_string("AI-marked: %d messages", "`ai-marked_0`"), F.format_string("Dropped: %d", "dropped_0")]
    return one.select(F.posexplode(F.array(*said)).alias("at", "line"))


def typed_flavored(para: Column, most: int) -> Column:
    """Whether a trimmed paragraph reads like a typed instruction."""
    return T.py_word_count(para).between(4, most) & ~para.rlike(C.CORRESPONDENCE) & ~para.rlike(C.DOCUMENT_LIKE) & para.rlike(f"(?iu){C.NOT_AFTER_WORD}(?:{C.SALVAGE_INSTRUCTION}){C.NOT_BEFORE_WORD}")


def salvaged(text: Column) -> Column:
    """The typed fragment of a long message: up to two opening paragraphs, and the last; null where there is none."""

    def said(paras: Column, one: Column, two: Column) -> Column:
        first, second, last = F.get(paras, F.lit(0)), F.get(paras, F.lit(1)), F.try_element_at(paras, F.lit(-1))
        end = (F.size(paras) > two.cast("int") + one.cast("int")) & typed_flavored(last, 60)
        parts = F.concat_ws("\n\n", F.when(one, first), F.when(two, second), F.when(end, last))
        return T.let(parts, lambda out: F.when((F.size(paras) >= 2) & ~out.contains("—") & (T.py_word_count(out) >= 8), out))

    def chosen(paras: Column) -> Column:
        one, second = typed_flavored(F.get(paras, F.lit(0)), 120), typed_flavored(F.get(paras, F.lit(1)), 120)
        return T.let(one, lambda x: T.let(x & second, lambda y: said(paras, x, y)))

    return T.let(F.transform(T.paragraphs(text), T.js_trim), chosen)


def salvage(quarantine: DataFrame, curated: DataFrame, order: list[str]) -> DataFrame:
    """Fragments of quarantined messages that no curated message is and no earlier one gave; columns of a message."""
    # A row for each fragment that there is: what generates rows is computed once, where a filter would be inlined.
    found = quarantine.withColumn("text", F.explode(F.array_compact(F.array(salvaged(F.col("text"))))))
    found = found.join(curated.select("text").distinct(), "text", "left_anti")
    firsts = found.groupBy("text").agg(F.min(F.struct(*dict.fromkeys([*order, *(c for c in ("ts", "project") if c in found.columns)]))).alias("m"))
    rows = firsts.select("text", "m.*").withColumns({"source": F.lit("salvage"), "words": T.py_word_count(F.col("text"))})
    return registers.tag(rows).drop("register_scores")
