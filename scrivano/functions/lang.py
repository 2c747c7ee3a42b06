"""Language tags en, el, gr-latn and other, and splitting a message by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano import constants as C
from scrivano.functions import text as T

LANGUAGES = ("en", "el", "gr-latn", "other")
#: A language with fewer words doesn't split a message.
MINORITY = 15


def detect(text: Column) -> Column:
    greek, latin = F.regexp_count(text, F.lit(C.GREEK_LETTER)), F.regexp_count(text, F.lit("[a-zA-Z]"))

    def romanised(found: Column) -> Column:
        strong, weak = (F.size(F.filter(found, lambda w: w.isin(names))) for names in (C.STRONG_GREEK, C.WEAK_GREEK))
        n = F.size(found)
        return (n >= 4) & T.let(strong, lambda s: (s >= 1) & ((s + weak).cast("double") / F.greatest(n, F.lit(1)) >= 0.12))

    # Letters are only counted where Greek ones are there.
    side = F.when(T.let(T.latin_words(text), romanised), "gr-latn").otherwise("en")
    return F.when((greek > 0) & (greek > latin), "el").when(~text.rlike("[a-zA-Z]"), "other").otherwise(side)


def chunks(text: Column) -> Column:
    """lang and text of each chunk of a message, in order, as an array; of one row alone, so nothing is shuffled.

    A message stays whole if it has one language, or if its second language has under MINORITY words.
    """
    tagged = F.transform(T.paragraphs(text), lambda p: F.struct(p.alias("para"), detect(p).alias("lang"), T.py_word_count(p).alias("n")))

    def total(parts: Column, name: str) -> Column:
        own = F.filter(parts, lambda x: x.lang == name)
        words = F.aggregate(own, F.lit(0), lambda a, x: a + x.n)
        place = F.array_position(F.transform(parts, lambda x: x.lang), F.lit(name))
        return F.when(place > 0, F.struct((-words).alias("less"), place.alias("first"), F.lit(name).alias("lang")))

    def parted(parts: Column) -> Column:
        """Neighbours of one language as one chunk: from each place where the language changes up to the next."""
        starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: (i == 1) | (F.get(parts, i - 1).lang != F.get(parts, i - 2).lang))

        def chunk(at: Column, i: Column) -> Column:
            own = F.slice(parts, F.get(at, i), F.coalesce(F.get(at, i + 1), F.size(parts) + 1) - F.get(at, i))
            return F.struct(F.get(own, F.lit(0)).lang.alias("lang"), F.array_join(F.transform(own, lambda x: x.para), "\n\n").alias("text"))

        return T.let(starts, lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda i: chunk(at, i)))

    def judged(parts: Column) -> Column:
        ranked = F.array_sort(F.array_compact(F.array(*(total(parts, name) for name in LANGUAGES))))
        whole = lambda name: F.array(F.struct(name.alias("lang"), text.alias("text")))
        split = lambda order: F.when(-F.coalesce(F.get(order, F.lit(1)).less, F.lit(0)) < MINORITY, whole(F.get(order, F.lit(0)).lang)).otherwise(parted(parts))
        return F.when(F.size(parts) == 0, whole(detect(text))).otherwise(T.let(ranked, split))

    return T.let(tagged, judged)


def split(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, chunk (from 0), lang and text of each message's chunks; null texts have none."""
    parts = df.where(F.col(text).isNotNull()).select(key, F.posexplode(chunks(F.col(text))).alias("chunk", "c"))
    return parts.select(key, "chunk", "c.lang", "c.text")
