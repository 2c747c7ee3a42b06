"""The registered queries over the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.llm import html, langid, lines, media, mixing, simhash, substring, topk, warc
from scrivano.llm.bpe import Bpe
from scrivano.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]

#: The vocabulary's file, of which the driver reads the bytes.
WORD_BPE = path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex256(column) -> Column:
    return F.sha2(column, 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = Bpe(spark, WORD_BPE)
    found = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text")).alias("b"))
    return found.select("doc_id", (F.octet_length("b.ids") / 4).cast("long").alias("n_tokens"), hex256("b.ids").alias("ids_sha256"), hex256(F.col("b.text").cast("binary")).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"), words=3, bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html.extract(spark, F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", hex256(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_sha256"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.write_texts(spark, table(spark, sf_dir, "documents")).withColumn("f", media.features(spark, F.col("media")))
    return stored.select("doc_id", "n_bytes", "f.payload_bytes", "f.payload_sha256", "f.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), hex256("media").alias("media_sha256"), "f.feature")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"), 50)
    return found.select("doc_id", "n_words", "n_removed", hex256(F.col("kept").cast("binary")).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(spark, table(spark, sf_dir, "pages")))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), langid.predict(docs, langid.learn(docs), F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": op1_bpe,
        "op2_simhash": op2_simhash,
        "op3_html": op3_html,
        "op4_lines": op4_lines,
        "op5_media": op5_media,
        "op6_substring": op6_substring,
        "op7_mixing": op7_mixing,
        "op8_langid": op8_langid,
        "op9_topk": op9_topk,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
