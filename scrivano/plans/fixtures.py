"""Literal rows that join the tables in queries, so that features the tables lack are met as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LONG = "and then we ran the whole set of figures again to see what had changed " * 36

#: doc_id and text.
FIX: list[tuple[int, str]] = [
    (-1, "Please fix the build. It's broken... don't merge!"),
    (-2, "this one — pasted — has dashes"),
    (-3, '{"a": 1, "b": 2}'),
    (-4, "before\n```code```\nError: boom\nafter the fence"),
    (-5, "hey ok thanks lol"),
    (-6, "Καλημέρα, θα σε πάρω τηλέφωνο"),
    (-7, "ela re file pame gia kafe tora?"),
    (-8, "1234 !!"),
    (-9, "NASA and the FBI 😀 ☀"),
    (-10, "Notably, a robust and **key** result. see https://example.org/x now"),
    (-11, "éa re"),
    (-12, "Ã©tude"),
    (-13, "hello there friend"),
    (-14, f"Please check the api and fix the token.\n\n{_LONG}\n\nnow that is done, run the tests please"),
    (-15, "kalimera, tha se paro tilefono meta, eimai edo kai perimeno"),
    (-16, "It's worth noting that X works. You're absolutely right. Importantly, it passed. that is the smoking gun, you're absolutely right to ask, it's not just speed, it's design"),
    (-17, "However, the plan is sound. Although it rains, we go. Therefore we pack. Indeed, all is well, and besides there is time, so then we also rest; yet still we hurry."),
    (-18, "hi all team here today\nOn Mon, Jan 1, Bob wrote:\n> old"),
    (-19, "[Image: a cat] look at the  wide   gap\n| table |\n12:30 noon\nhttps://example.org/a-very-long-path-without-any-space-at-all"),
    (-20, "one two three four\n\nΗ γάτα κάθεται στο χαλί και ο σκύλος κοιμάται έξω στον κήπο όλη τη μέρα χωρίς καμία έγνοια\n\nthe cat sits on the mat and the dog sleeps out in the garden all day long without a care"),
    (-21, ""),
    (-22, "+"),
    (-23, "/clear"),
    (-24, "[Pasted text #1 +20 lines] please read this"),
    (-25, "<system>note</system>"),
    (-26, "hello there friend"),
]
#: Days of mail: doc_id, From, Date.
MAILS: list[tuple[int, str, str]] = [
    (-1, "Ann <Ann@Example.org>", "Thu, 4 Jun 2026 9:05:00 GMT"),
    (-2, "bob@example.org ", "31 Feb 2026 10:00 +0000"),
    (-3, "ANN@example.org", "1 Jan 69 10:00 +0000"),
    (-4, "<<x@y.z>>", "1 Jan 68 10:00 EST"),
    (-5, "", "yesterday"),
    (-6, "Ann <ann@example.org>", "Mon, 02 Jan 2023 10:00:00 +0200"),
]


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIX, "doc_id long, text string")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    """The rows as SQL."""
    return "VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else quoted(x) for x in r) + ")" for r in rows)
