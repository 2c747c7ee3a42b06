"""The operators as stages over documents: each takes (spark, docs, sf_dir), and its decisions take effect on docs.

docs has doc_id, text, lang and source, and may have more columns of any names, which pass through: inside a stage the row is
one struct, so that no name clashes. An empty table gives an empty one. Each stage says what it does with nulls, ties and
repeated rows; texts of any length are handled as a whole. A stage keeps no table but those that its result reads.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.llm import langid, lines, mixing, simhash
from scrivano.llm.bpe import Bpe
from scrivano.llm.store import drop, materialise

#: The vocabulary of the last stage.
WORD_BPE = path("word_bpe_49k.json")


def _packed(docs: DataFrame) -> DataFrame:
    """docs as one column, `row`."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; those without text or letters go. A null lang becomes the predicted one, another stays.

    Where no row can be learned from, a null lang becomes `und`. Equal texts are judged alike; repeated rows stay repeated.
    """
    model = langid.learn(docs)
    text = F.col("row.text")
    found = _packed(docs).withColumn("p", langid.predict(docs, model, text)).where(langid.lettered(text) if model is None else F.col("p.lang") != langid.UNKNOWN)
    return found.select(F.col("row").withField("lang", F.coalesce("row.lang", "p.lang")).alias("row")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated lines, with n_chars (where docs has it) counted anew; no row goes.

    Null texts stay null. Of repeats the one of the smallest doc_id stays; rows of one doc_id are one document. Rows without
    a doc_id lose their own repeats alone.
    """
    kept = lines.dedup_lines(_packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id; rows without a doc_id stay.

    Near-duplicates are linked by SimHash fingerprints of 512 bits and their pivot distance tables, and checked by their shingles.
    Texts that are null or have no words are one group. Rows with the same doc_id are one document, of which one row stays.
    """
    groups = simhash.similar_documents(spark, docs, words=5, similarity=0.8)
    kept = materialise(groups.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    drop(groups)
    rows = _packed(docs).withColumn("doc_id", F.col("row.doc_id"))
    first = rows.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(rows.where("doc_id is null")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to two times.

    Null texts and those without words have no size and are never taken. Equal rows rank alike and are taken together.
    """
    taken = mixing.copies(_packed(docs), F.col("row.doc_id"), F.col("row.text"), F.col("row.source"))
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed 32-bit integers) of each document, with their number and the digest of the text they decode to.

    Null and empty texts have none. Every row gives one row.
    """
    bpe = Bpe(spark, WORD_BPE)
    found = docs.select("doc_id", "lang", "source", bpe.round_trip(F.col("text")).alias("b"))
    return found.select("doc_id", "lang", "source", "b.ids", (F.octet_length("b.ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("b.text").cast("binary"), 256).alias("decoded_sha256"))
