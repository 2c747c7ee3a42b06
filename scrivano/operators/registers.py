"""Register scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivano import constants as C
from scrivano.functions import text as T
from scrivano.functions.numbers import py_rounds

NAMES = ("technical", "informal", "editorial")


def score_columns(text: Column, found: Column | None = None, fragments: Column | None = None) -> dict[str, Column]:
    """Unrounded technical, informal and editorial scores; the text's tokens and fragments may be given."""
    found = T.register_words(text) if found is None else found
    fragments = T.register_sentences(text) if fragments is None else fragments
    n, parts = F.size(found), F.size(fragments)
    per, whole = F.greatest(n, F.lit(1)).cast("double"), F.greatest(parts, F.lit(1)).cast("double")

    def among(names: list[str], tokens: Column = found) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(names)))

    openers = F.array_distinct(F.filter(F.transform(fragments, lambda s: F.regexp_extract(F.lower(s), C.REGISTER_WORD, 0)), lambda w: w != ""))
    technical = among(C.TECH_NOUNS) / per
    instruction = F.regexp_count(text, F.lit(f"(?iu){C.NOT_AFTER_WORD}(?:{C.INSTRUCTION}){C.NOT_BEFORE_WORD}")) / whole
    imperative = among(C.IMPERATIVES, openers) / whole
    editorial = among(C.DISCOURSE) / per * 5.0 + F.when(parts >= 4, 0.4).otherwise(0.0) + F.when(n > 80, 0.3).otherwise(0.0) - technical * 4.0 - instruction * 1.0 - imperative * 1.5
    scores = (technical * 6.0 + instruction * 1.5 + imperative * 2.0, among(C.CASUAL) / per * 8.0 + F.when(n < 8, 0.3).otherwise(0.0), F.greatest(editorial, F.lit(0.0)))
    return {name: F.when(n == 0, 0.0).otherwise(s) for name, s in zip(NAMES, scores)}


def with_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the three unrounded scores; each text is split into tokens and fragments once."""
    return _split(df, text).withColumns(score_columns(F.col(text), F.col("_split.tokens"), F.col("_split.fragments"))).drop("_split")


def _split(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a text's tokens and fragments; as a generated row, they are computed once, not at each use."""
    return df.withColumn("_split", F.explode(F.array(F.struct(T.register_words(F.col(text)).alias("tokens"), T.register_sentences(F.col(text)).alias("fragments")))))


def label(technical: Column, informal: Column, editorial: Column) -> Column:
    """The register of the highest score, the earlier one on ties; technical where none is above zero."""
    best = F.greatest(technical, informal, editorial)
    return F.when((best <= 0) | (technical == best), "technical-instruction").when(informal == best, "informal").otherwise("editorial")


def tag(messages: DataFrame) -> DataFrame:
    """messages with register_scores (rounded to three digits) and register; other columns pass through."""
    scores = score_columns(F.col("text"), F.col("_split.tokens"), F.col("_split.fragments"))
    tagged = _split(messages).withColumn("register_scores", py_rounds(scores, 3)).drop("_split")
    s = F.col("register_scores")
    return tagged.withColumn("register", label(s.technical, s.informal, s.editorial))


def distribution(tagged: DataFrame, order: str) -> DataFrame:
    """Messages, share in per cent, and words of each register, the most frequent first, ties by first appearance."""
    counts = tagged.groupBy("register").agg(F.count("*").alias("messages"), F.sum(T.py_word_count(F.col("text"))).alias("words"), F.min(order).alias("first"))
    return counts.withColumn("share", F.col("messages") * 100.0 / F.sum("messages").over(Window.partitionBy())).orderBy(F.desc("messages"), "first").drop("first")
