"""The pipeline's stages against brute force, and the groups of similar documents."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scrivano.llm import langid, simhash, stages
from scrivano.llm.queries import WORD_BPE

sys.path.insert(0, str(Path(__file__).parent))
import test_line_runs  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_documents(spark):
    rng = random.Random(9)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for i in range(6):
            w = list(base)
            for at in rng.sample(range(400), i):
                w[at] = "x"
            docs.append((g * 10 + i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, docs[0][1]), (203, "a b"), (None, docs[0][1]), (203, "a b"), (205, "A  b")]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {g * 10 + i: g * 10 for g in range(12) for i in range(6)} | {200: 200, 201: 200, 202: 0, 203: 203, 205: 203}
    assert got == want
    assert simhash.similar_documents(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "1234 !!", "en", "src0", 7), (-3, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    columns = docs.columns
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        outs.append(docs)
        docs.count()
    language, line, near, mixed, tokens = (o.toPandas() for o in outs)
    assert all(list(o.columns) == columns for o in (language, line, near, mixed))
    before = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    lettered = [i for i, t in zip(before.doc_id, before.text) if any(c.isalpha() for c in t)]
    assert sorted(language.doc_id) == sorted(lettered)

    want = {i: (kept, lost) for i, kept, lost in test_line_runs.brute(list(zip(language.doc_id, language.text)))}
    for i, kept, n in zip(line.doc_id, line.text, line.n_chars):
        assert (kept, n) == (want[i][0], len(want[i][0]))

    texts = dict(zip(line.doc_id, line.text))
    stays = set(near.doc_id)
    assert len(stays) == len(near)
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert stays == {top(i) for i in texts}

    times = Counter(mixed.doc_id)
    assert set(times) <= stays and max(times.values()) <= 2
    size = {i: len(texts[i].encode().split()) for i in stays}
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * sum(size.values())) < 0.15 * sum(size.values())

    assert Counter(tokens.doc_id) == times
    library = Tokenizer.from_file(WORD_BPE)
    for i, ids, digest in zip(tokens.doc_id, tokens.ids, tokens.decoded_sha256):
        want = library.encode(texts[i], add_special_tokens=False).ids
        assert np.frombuffer(bytes(ids), "<u4").tolist() == want and digest == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.where("n_tokens <> octet_length(ids) / 4").count() == 0


def test_rejection_is_by_letters_alone(spark):
    df = spark.createDataFrame([(1, "zq", "en"), (2, "éà", None), (3, "--", None)], "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert [r.p.lang == "und" for r in df.select(langid.predict(df, model, F.col("text")).alias("p")).collect()] in ([False, False, True], [True, True, True])


def test_stages_pass_columns_of_any_name(spark):
    """Names that the stages might use themselves, nulls in every column, and repeated rows."""
    names = "doc_id long, text string, lang string, source string, n_chars long, _p string, p string, row string, hs int, share int, last int, _s int, s int, copies int, copy int, _id int, node int, size int, odds int, `a b` int"
    more = ("p", "q", "r") + tuple(range(12))
    texts = ["one two three four five six\nseven eight nine ten", "one two three four five six\nseven eight nine ten", None, "", "un deux trois quatre cinq six sept huit neuf dix onze"]
    docs = spark.createDataFrame([(i, t, "en" if i else None, "s", 5, *more) for i, t in enumerate(texts)] + [(None, None, None, None, None, *[None] * len(more)), (1, texts[1], "en", "s", 5, *more)], names)
    for f in (stages.language, stages.line_dedup, stages.near_dedup, stages.mix):
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        kept = out.collect()
        assert all(tuple(r[5:]) == more for r in kept if r.doc_id is not None)
        assert f(spark, docs.where("false"), SF).count() == 0
    assert {r.doc_id for r in stages.near_dedup(spark, docs, SF).collect()} == {0, 2, 4, None}
    assert stages.tokens(spark, docs, SF).count() == 7


def test_pivot_tables_lose_no_link():
    """The tables' bound is never above the distance of two sets, and discards most pairs far apart."""
    rng = np.random.default_rng(1)
    far = 0
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        keep = rng.random(n) < rng.choice([0.3, 0.6, 0.9, 1.0])
        a, b = np.unique(base), np.unique(np.concatenate([base[keep], rng.integers(0, 2**64, n - int(keep.sum()), dtype=np.uint64)]))
        distance = len(np.setxor1d(a, b))
        found = simhash.apart(*(np.frombuffer(simhash.table(x), np.uint8)[None] for x in (a, b)))[0]
        assert found <= distance
        far += distance * 1.8 > 0.2 * 3 * (len(a) + len(b)) and found * 1.8 > 0.2 * (len(a) + len(b))
    assert far > 50
