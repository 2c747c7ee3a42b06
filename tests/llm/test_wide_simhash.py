"""The pipeline's near-dedup links by SimHash fingerprints and their pivot distance tables."""

import itertools
import random

import numpy as np
import pytest

from scrivano.llm import simhash, stages


def spread(x):
    """simhash.mix of one number."""
    full = 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
    x = (x ^ x >> 27) * 0x94D049BB133111EB & full
    return x ^ x >> 31


def majority(found):
    """The fingerprint as a number, from the shingles' bits one by one."""
    rows = [sum(spread(x ^ spread(i + 1)) << 64 * i for i in range(simhash.BITS // 64)) for x in found]
    return sum(1 << b for b in range(simhash.BITS) if 2 * sum(r >> b & 1 for r in rows) > len(rows))


def fingerprints(*found):
    return [np.frombuffer(simhash.wide(np.array(sorted(x), np.uint64)).tobytes(), np.uint8)[None] for x in found]


def differ(a, b):
    return int(np.bitwise_count(a ^ b).sum())


@pytest.mark.parametrize("n", [0, 1, 2, 5, 254, 255, 256, 1000])
def test_fingerprints_are_majorities(n):
    found = [random.Random(n).getrandbits(64) for _ in range(n)]
    assert int.from_bytes(fingerprints(found)[0].tobytes(), "little") == majority(found)


def test_tables_hold_distances_to_references():
    """The bound is the largest difference of the distances to any reference, and never above the fingerprints' own distance."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, (2, 1000, 1), np.uint8)
    refs = np.array([[sum(3 << 2 * i for i in c)] for r in range(5) for c in itertools.combinations(range(4), r)], np.uint8)
    apart = [np.abs(np.bitwise_count(a ^ p).astype(int) - np.bitwise_count(b ^ p)).sum(1) for p in refs]
    found = simhash.tables_apart(simhash.distances(a), simhash.distances(b))
    assert (found == np.max(apart, axis=0)).all() and (found <= np.bitwise_count(a ^ b).sum(1)).all()


def test_chance_by_counting():
    for shared, a, b in itertools.product(range(1, 6), range(3), range(3)):
        sides = itertools.product((0, 1), repeat=shared + a + b)
        odds = [(2 * sum(x[: shared + a]) > shared + a) != (2 * (sum(x[:shared]) + sum(x[shared + a :])) > shared + b) for x in sides]
        assert simhash.chance(shared, a, b) == pytest.approx(sum(odds) / len(odds))


def test_limits_hold_for_linked_sets_of_any_size():
    """No size beyond those computed has a higher chance; linked sets stay within, sets far apart are discarded by the tables."""
    top = max(simhash.chance(s, n - s, m - s) for n in range(24, 48) for m in range(n, n * 5 // 4 + 1) for s in range(-(-4 * (n + m) // 9), n + 1))
    for n in [*range(48, 70), 99, 100, 250, 399, 400]:
        assert all(simhash.chance(s, n - s, m - s) <= top for m in range(n, n * 5 // 4 + 1) for s in range(-(-4 * (n + m) // 9), min(n, -(-4 * (n + m) // 9) + 3) + 1))
    most, rng, far = simhash.limits(0.8), random.Random(4), 0
    for _ in range(400):
        n = rng.choice([4, 5, 8, 9, 12, 20, 47, 48, 100, 300, 1000])
        m = rng.randint(n, n * 5 // 4)
        s = -(-4 * (n + m) // 9)
        shared, one, two = ([rng.getrandbits(64) for _ in range(k)] for k in (s, n - s, m - s))
        other = [rng.getrandbits(64) for _ in range(m)]
        a, b, c = fingerprints(shared + one, shared + two, other)
        limit = most[min(n, len(most) - 1)]
        assert differ(a, b) <= limit < differ(a, c)
        far += simhash.tables_apart(*map(simhash.distances, (a, c)))[0] > limit
    assert far > 350


def test_links_go_by_fingerprints(spark, monkeypatch):
    """Within no bit nothing links but equal sets; within the limits near copies do, and texts that only share a passage don't."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near, part = [*base[:150], "edited", *base[151:]], [*base[:60], *(f"p{i}" for i in range(140))]
    docs = spark.createDataFrame([(i, " ".join(w), None, "s") for i, w in enumerate([base, near, base, part])], "doc_id long, text string, lang string, source string")

    def kept():
        return {r.doc_id for r in stages.near_dedup(spark, docs, "").collect()}

    assert kept() == {0, 3}
    monkeypatch.setattr(simhash, "limits", lambda similarity: np.zeros(1, np.int64))
    assert kept() == {0, 1, 3}
