"""Stylometric fingerprints of buckets of messages.

Everything is aggregated before it is shuffled: medians and percentiles come from histograms of lengths, not from lists,
so a bucket of any size fits any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivano import constants as C
from scrivano.functions import mail
from scrivano.functions import text as T
from scrivano.functions.numbers import py_round

RHYTHM_COLUMNS = ["messages", "words", "sentence_len", "message_len_p50", "punct_per_1k_words", "lowercase_sentence_start_rate", "allcaps_word_per_1k", "emoji_per_1k", "ellipses_per_1k"]
RHYTHM_WORDS = 500


MARKS = [f"p{i}" for i in range(len(C.PUNCTUATION))]
COUNTED = [*MARKS, "emoji", "contractions", "ellipses", "allcaps", "letters"]


def _measured(messages: DataFrame, by: str) -> DataFrame:
    """One row a message: n words, and the counts of COUNTED."""
    text, found = F.col("text"), F.col("_w")
    return messages.withColumn("_w", T.words(text)).select(
        by, F.size(found).alias("n"),
        *(T.occurrences(text, p).alias(name) for name, p in zip(MARKS, C.PUNCTUATION)),
        T.emoji(text).alias("emoji"), T.contractions(text).alias("contractions"), T.ellipses(text).alias("ellipses"),
        F.size(F.filter(found, lambda w: (F.length(w) > 2) & T.is_upper(w))).alias("allcaps"),
        F.length(F.lower(F.array_join(found, ""))).cast("long").alias("letters"),
    )


def totals(messages: DataFrame, by: str = "bucket") -> DataFrame:
    """Messages, words (1 if there are none), and counts of marks, emoji, contractions, ellipses, capitals and letters."""
    return _measured(messages, by).groupBy(by).agg(F.count("*").alias("messages"), F.greatest(F.sum("n"), F.lit(1)).alias("words"), *(F.sum(c).alias(c) for c in COUNTED))


def histogram_stats(lengths: DataFrame, by: str, sums: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """by, total, mean, p50 (mean of the middle two) and p90 (the element at floor(0.9 n) - 1; null for one) of column n, and
    the sums of other columns, in one pass over the rows."""
    bars = lengths.groupBy(by, "n").agg(F.count("*").alias("c"), *(F.sum(s).alias(s) for s in sums))
    order = Window.partitionBy(by).orderBy("n")
    bars = bars.withColumn("upto", F.sum("c").over(order)).withColumn("all", F.sum("c").over(Window.partitionBy(by)))

    def at(index: Column) -> Column:
        """The value at an index from 0 of the sorted values; null outside them."""
        return F.max(F.when((index >= 0) & (F.col("upto") > index) & (F.col("upto") - F.col("c") <= index), F.col("n")))

    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    weight = F.sum(F.col("n") * F.col("c"))
    return bars.groupBy(by).agg(F.max("all").alias("total"), weight.alias("weight"), (weight / F.max("all")).alias("mean"), ((at(low) + at(high)) / 2.0).alias("p50"), at(F.floor(F.col("all") * F.lit(0.9)) - 1).alias("p90"), *(F.sum(s).alias(s) for s in sums)).select(by, "total", "mean", "p50", "p90", *sums, "weight")


def word_stats(messages: DataFrame, by: str = "bucket") -> DataFrame:
    """What totals has, and message_len_p50: the median of words a message."""
    found = histogram_stats(_measured(messages, by), by, COUNTED)
    return found.select(by, F.col("total").alias("messages"), F.greatest("weight", F.lit(1)).alias("words"), F.col("p50").alias("message_len_p50"), *COUNTED)


def sentence_stats(messages: DataFrame, by: str = "bucket") -> DataFrame:
    """sentences, mean, p50 and p90 of their lengths, and how many start lower."""
    rows = sentence_rows(messages, by).select(by, "n", F.col("lower").cast("long").alias("lower"))
    return histogram_stats(rows, by, ["lower"]).withColumnRenamed("total", "sentences").drop("weight")


def sentence_rows(messages: DataFrame, by: str = "bucket", order: str | None = None) -> DataFrame:
    """One row for each sentence that has a token: its length, whether it starts lower, and its first token."""
    keys = [by] + ([order] if order else [])
    rows = messages.select(*keys, F.posexplode(T.sentences(F.col("text"))).alias("at", "s"))
    rows = rows.withColumn("_w", T.words(F.col("s"))).where(F.size("_w") > 0)
    return rows.select(*keys, "at", F.size("_w").alias("n"), T.first_is_lower(F.col("s")).alias("lower"), F.lower(F.get("_w", F.lit(0))).alias("opener"))


def openers(messages: DataFrame, by: str = "bucket", order: str = "doc_id", top: int = 15) -> DataFrame:
    """The most frequent first tokens of sentences, ties by first appearance."""
    counts = sentence_rows(messages, by, order).groupBy(by, "opener").agg(F.count("*").alias("n"), F.min(F.struct(order, "at")).alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= top).select(by, "rank", "opener", "n")


def _lower_words(messages: DataFrame, by: str) -> DataFrame:
    tokens = messages.select(by, F.explode(F.transform(T.words(F.col("text")), F.lower)).alias("w"))
    return tokens.groupBy(by, "w").agg(F.count("*").alias("n"))


def connectors(messages: DataFrame, by: str = "bucket", top: int = 12) -> DataFrame:
    """Uses of connectors, the most frequent first, ties in the order of the list, without zeros."""
    place = F.array_position(F.array(*map(F.lit, C.CONNECTORS)), F.col("w"))
    tokens = messages.select(by, F.explode(F.filter(F.transform(T.words(F.col("text")), F.lower), lambda w: w.isin(C.CONNECTORS))).alias("w"))
    counts = tokens.groupBy(by, "w").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), place))).where(F.col("rank") <= top).select(by, "rank", F.col("w").alias("connector"), "n")


def vocabulary(messages: DataFrame, by: str = "bucket") -> DataFrame:
    """How many different lower-cased words there are; exact."""
    return _lower_words(messages, by).groupBy(by).agg(F.count("*").alias("unique_words"))


def _lexicon(messages: DataFrame, by: str, top: int = 12) -> DataFrame:
    """unique_words, and the most used connectors (of the few in the list), from one count of the words."""
    place = F.array_position(F.array(*map(F.lit, C.CONNECTORS)), F.col("w"))
    used = F.collect_list(F.when(F.col("w").isin(C.CONNECTORS), F.struct((-F.col("n")).alias("less"), place.alias("place"), F.col("w").alias("connector"), F.col("n").alias("n"))))
    return _lower_words(messages, by).groupBy(by).agg(F.count("*").alias("unique_words"), F.slice(F.array_sort(used), 1, top).alias("used"))


def fingerprint(messages: DataFrame, by: str = "bucket", order: str = "doc_id") -> DataFrame:
    """One row a bucket, rounded as profiles are: see the columns at the end. The messages are read four times: for words,
    for sentences, for the sentences' first tokens, and for the vocabulary with its connectors."""
    lengths = sentence_stats(messages, by).select(by, (F.col("lower") / F.col("sentences")).alias("lower"), "mean", "p50", "p90")
    first = openers(messages, by, order).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "opener", "n"))), lambda x: F.struct(x.opener, x.n)).alias("top_sentence_openers"))
    table = word_stats(messages, by)
    for part in (lengths, first, _lexicon(messages, by)):
        table = table.join(part, by, "left")
    k = F.lit(1000.0) / F.col("words")

    def per(column: str | Column, digits: int = 2) -> Column:
        return py_round((F.col(column) if isinstance(column, str) else column) * F.lit(1000.0) / F.col("words"), digits)

    marks = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, C.PUNCTUATION)), F.array(*map(per, MARKS))), lambda _, v: v > 0)
    use = F.map_from_arrays(F.transform("used", lambda x: x.connector), F.transform("used", lambda x: x.n * k))
    return table.select(
        by, "messages", "words",
        F.struct(py_round(F.col("mean"), 1).alias("mean"), F.col("p50").alias("p50"), F.col("p90").cast("double").alias("p90")).alias("sentence_len"),
        "message_len_p50", marks.alias("punct_per_1k_words"), py_round(F.coalesce("lower", F.lit(0.0)), 3).alias("lowercase_sentence_start_rate"),
        per("allcaps").alias("allcaps_word_per_1k"), per("emoji").alias("emoji_per_1k"), per("contractions").alias("contractions_per_1k"), per("ellipses").alias("ellipses_per_1k"),
        py_round(F.col("letters") / F.col("words"), 2).alias("avg_word_len"), py_round(F.coalesce("unique_words", F.lit(0)) / F.col("words"), 3).alias("unique_word_ratio"),
        F.coalesce("top_sentence_openers", F.array().cast("array<struct<opener: string, n: long>>")).alias("top_sentence_openers"), F.coalesce(use, F.create_map().cast("map<string, double>")).alias("connector_use_per_1k"),
    )


def enough_for_rhythm(messages: DataFrame, by: str = "bucket") -> DataFrame:
    """Rows of buckets with RHYTHM_WORDS words between white space."""
    sizes = messages.groupBy(by).agg(F.sum(T.py_word_count(F.col("text"))).alias("n")).where(F.col("n") >= RHYTHM_WORDS)
    return messages.join(sizes.select(by), by, "left_semi")


def rhythm(messages: DataFrame, by: str = "bucket", order: str = "doc_id") -> DataFrame:
    """What a text in any language tells: the fingerprint's cadence, of buckets that have enough words."""
    return fingerprint(enough_for_rhythm(messages, by), by, order).select(by, *RHYTHM_COLUMNS, F.lit(C.RHYTHM_SIGNAL).alias("signal"))


def source_bucket(kind: str, source: Column) -> Column:
    """kind and the part of a source after its first colon, without the ending -account."""
    return F.concat(F.lit(f"{kind}-"), F.regexp_replace(F.regexp_replace(source, "(?s)^[^:]*:", ""), "-account$", ""))


def buckets(messages: DataFrame) -> DataFrame:
    """messages (bucket, ts) once for its bucket, and again for the years before 2023 or from 2024 on."""
    y = mail.year(F.col("ts").cast("string"))
    names = F.array_compact(F.array(F.col("bucket"), F.when(y < 2023, F.concat("bucket", F.lit("-pre2023"))), F.when(y >= 2024, F.concat("bucket", F.lit("-recent")))))
    return messages.withColumn("bucket", F.explode(names))


def corpus_buckets(tagged: DataFrame | None, salvaged: DataFrame | None, email: DataFrame | None, chat: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The union of the corpora: rows for fingerprints, and non-English chat for rhythm alone. Non-English mail is left out."""
    parts = []
    for i, df in enumerate((tagged, salvaged, email, chat)):
        if df is None:
            continue
        if i < 2:
            df = df.where("register is not null").withColumn("bucket", F.col("register")).withColumn("lang", F.lit("en"))
        else:
            df = df.withColumn("bucket", source_bucket(("email", "chat")[i - 2], F.col("source")))
        place = [F.struct(F.lit(i).alias("kind"), F.col("place")).alias("place")] if "place" in df.columns else []
        part = df.select("bucket", F.col("ts").cast("string").alias("ts"), "lang", "text", F.lit(i).alias("kind"), *place)
        parts.append(buckets(part) if i >= 2 else part)
    if not parts:
        raise ValueError("there is no corpus")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    english = F.col("lang") == "en"
    return whole.where(english), whole.where(~english & (F.col("kind") == 3))
