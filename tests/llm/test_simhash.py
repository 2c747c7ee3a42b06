import random

import pytest
import xxhash
from pyspark.sql import functions as F

from scrivano.llm import simhash


def brute(rows, words=3, bits=2):
    import re

    fps = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if least[j] < least[i] and (fps[i] ^ fps[j]).bit_count() <= bits:
                    least[i], changed = least[j], True
    return {(i, f"{fps[i]:016x}", least[i]) for i in fps}


def answer(spark, rows):
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    return {(i, f"{fp & (2**64 - 1):016x}", c) for i, fp, c in got.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(60)}" for _ in range(200)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "oNE two"), (6, "ÀB c d"), (7, "àB c d")]
    for i in range(10, 70):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(200)] = "x"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "\t".join(w)))
    assert answer(spark, rows) == brute(rows)


@pytest.mark.parametrize("cell", [1, 32])
def test_links_of_close_fingerprints(spark, monkeypatch, cell):
    """Chains and clusters of fingerprints, through cells of few and of many."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(9):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                f ^= 1 << b
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    from scrivano.llm.graph import components

    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)).collect()}
    least = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for f in fps:
            for g in fps:
                if least[g] < least[f] and ((f ^ g) & (2**64 - 1)).bit_count() <= 2:
                    least[f], changed = least[g], True
    assert {f: got.get(f, f) for f in fps} == least


def test_empty_and_odd_rows(spark):
    assert answer(spark, []) == set()
    rows = spark.createDataFrame([(None, "a b c d", 1), (7, "a b c d", 2), (7, "a b c d", 2), (None, "other words here now", 3)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(spark, rows).collect())
    assert got == [(0, 0), (0, 7), (7, 7), (7, 7)]


def test_long_text(spark):
    assert answer(spark, [(1, "a b " * 100_000), (2, "b a " * 100_000)]) == brute([(1, "a b " * 100_000), (2, "b a " * 100_000)])


def test_giant_component(spark):
    """A chain of fingerprints two bits apart and a hub with very many neighbours, in one component each."""
    from scrivano.llm.graph import components

    edges = [(i, i + 1) for i in range(3000)] + [(10_000, 10_001 + i) for i in range(60_000)]
    got = components(spark.createDataFrame(edges, "u long, v long"))
    counts = {r.root: r["count"] for r in got.groupBy("root").count().collect()}
    assert counts == {0: 3000, 10_000: 60_000}
