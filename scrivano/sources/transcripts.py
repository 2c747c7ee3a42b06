"""Agent transcripts: folders of projects with a JSON line file for each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.functions import text as T


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Lines of root/<project>/*.jsonl and root/.archive/<project>/*.jsonl: file, project, session, line_no, value."""
    lines = None
    for pattern in (f"{root}/*/*.jsonl", f"{root}/.archive/*/*.jsonl"):
        try:
            part = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        lines = part if lines is None else lines.unionByName(part)
    if lines is None:
        lines = spark.createDataFrame([], "value string, file string, block long, line_no long")
    return lines.withColumns({"project": T.project_name(F.element_at(F.split("file", "/"), -2)), "session": T.stem(F.col("file"))})


def content_texts(content: Column) -> Column:
    """The texts of a message's content (a variant): of a string itself, of an array its text blocks."""
    blocks = F.expr("try_cast(_content as array<variant>)")
    kind = F.expr("schema_of_variant(_content)")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.when(F.schema_of_variant(F.variant_get(b, "$.text", "variant")) == "STRING", F.try_variant_get(b, "$.text", "string")).otherwise(""))
    return F.when(kind == "STRING", F.array(F.expr("cast(_content as string)"))).otherwise(texts)


def user_blocks(lines: DataFrame) -> DataFrame:
    """Text blocks of what users typed, in order: ts, block_no and text beside the line's columns. Bad lines are left out."""
    parsed = lines.withColumn("_json", F.try_parse_json("value")).where("_json is not null")
    side = F.try_variant_get("_json", "$.isSidechain", "string")
    parsed = parsed.where((F.try_variant_get("_json", "$.type", "string") == "user") & ~F.coalesce(~side.isin("false", "0", ""), F.lit(False)))
    parsed = parsed.withColumns({"ts": F.try_variant_get("_json", "$.timestamp", "string"), "_content": F.try_variant_get("_json", "$.message.content", "variant")})
    return parsed.select(*lines.columns, "ts", F.posexplode(content_texts(F.col("_content"))).alias("block_no", "text")).drop("value")
