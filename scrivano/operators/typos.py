"""Catalogs of typing errors: rare unknown tokens one edit away from a frequent known word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano import constants as C
from scrivano.functions import text as T


def dictionary(spark: SparkSession, path: str = "/usr/share/dict/words") -> DataFrame:
    """Lower-cased, trimmed words of a file, one a line; none where there is no file."""
    try:
        return spark.read.text(path).select(T.js_trim(F.lower("value")).alias("form")).where("form <> ''").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "form string")


def probes(word: Column) -> Column:
    """The forms of which one in the dictionary makes a word known."""
    forms = [word] + [F.when(word.endswith(s), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in C.SUFFIXES]
    forms += [F.when(word.endswith("ing"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("e"))), F.when(word.endswith("ed"), F.substring(word, F.lit(1), F.length(word) - 1))]
    return F.array_compact(F.array(*forms))


def edits(word: Column) -> Column:
    """The forms one edit away, in order: deletions, swaps of neighbours, replacements, insertions."""
    n = F.length(word)
    letters = F.array(*map(F.lit, C.EDIT_LETTERS))

    def head(i: Column) -> Column:
        return F.substring(word, F.lit(1), i)

    def tail(i: Column) -> Column:
        return F.substring(word, i + 1, n)

    inner = F.sequence(F.lit(0), n - 1)
    deleted = F.transform(inner, lambda i: F.concat(head(i), tail(i + 1)))
    swapped = F.transform(F.filter(inner, lambda i: i < n - 1), lambda i: F.concat(head(i), F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), tail(i + 2)))
    replaced = F.flatten(F.transform(inner, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i + 1)))))
    inserted = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i)))))
    return F.concat(deleted, swapped, replaced, inserted)


def catalog(messages: DataFrame, words: DataFrame, by: str = "bucket") -> DataFrame:
    """by, typo, correction and n: tokens seen at most twice that aren't known, and the first edit that is a known word
    seen at least three times as often.

    An edit back from the correction is one of the same kinds, so the frequent known words are edited, which are far fewer
    than the rare tokens; only pairs that meet are then put in the order of edits.
    """
    freq = messages.select(by, F.explode(T.typo_tokens(F.col("text"))).alias("w")).groupBy(by, "w").agg(F.count("*").alias("n"))
    frequent = freq.where("n >= 3").join(words, F.col("w") == F.col("form"), "left_semi").select(F.col(by).alias("b"), F.col("w").alias("correction"), F.col("n").alias("m"))
    rare = freq.where("n <= 2 and instr(w, \"'\") = 0")
    known = rare.select("w").distinct().select("w", F.explode(probes(F.col("w"))).alias("form")).join(words, "form", "left_semi").select("w").distinct()
    unknown = rare.join(known, "w", "left_anti")
    # The estimate of an exploded side is that of its input, so it must not be the one that is broadcast.
    near = frequent.select("correction").distinct().select("correction", F.explode(F.array_distinct(edits(F.col("correction")))).alias("w")).hint("merge")
    pairs = unknown.join(near, "w")
    met = pairs.join(frequent, (F.col(by) == F.col("b")) & (pairs.correction == frequent.correction)).where(F.col("m") >= F.greatest(F.col("n") * 3, F.lit(3))).select(by, "w", "n", pairs.correction)
    met = met.withColumn("at", F.array_position(edits(F.col("w")), F.col("correction")))
    return met.groupBy(by, F.col("w").alias("typo"), "n").agg(F.min_by("correction", "at").alias("correction")).select(by, "typo", "correction", "n")


def rates(found: DataFrame, totals: DataFrame, by: str = "bucket") -> DataFrame:
    """Typing errors in a thousand words of each bucket, unrounded."""
    return totals.select(by, "words").join(found.groupBy(by).agg(F.sum("n").alias("typos")), by, "left").select(by, (F.coalesce("typos", F.lit(0)) * F.lit(1000.0) / F.greatest("words", F.lit(1))).alias("typo_per_1k"))
