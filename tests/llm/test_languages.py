"""Many labels, and none that can be learned from."""

import random

from pyspark.sql import functions as F

from scrivano.llm import langid, stages


def test_each_label_is_learned(spark):
    rng = random.Random(1)
    docs = []
    for k in range(110):
        stock = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        for _ in range(12 if k < 100 else 9):
            docs.append((len(docs), " ".join(rng.choices(stock, k=30)), f"l{k:03}"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert len(model.languages) == 110
    got = df.where(langid.held_out(F.col("doc_id"))).select("lang", langid.predict(df, model, F.col("text")).alias("p")).collect()
    rare = [r for r in got if r.lang >= "l100"]
    assert len(rare) > 10 and sum(r.p.lang == r.lang for r in rare) / len(rare) > 0.9


def test_stage_with_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in stages.language(spark, docs, "").collect()) == [1, 4]
