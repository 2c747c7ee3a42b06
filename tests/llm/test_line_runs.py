"""Line dedup against an independent brute force over strings, and the share of repeated passages that it removes."""

import random

import pytest
import xxhash

from scrivano.llm import lines


def parts(text):
    """Units: lines with text, each with the blank lines after it."""
    out = []
    for line in text.split("\n"):
        if out and (not line.strip() or not seen):
            out[-1] += "\n" + line
        else:
            out.append(line)
            seen = False
        seen = seen or bool(line.strip())
    return out


def stretches(us):
    """(first, end, kind) of all pairs (kind 0) and of the chunks of the three chunkings."""
    n = len(us)
    if n < 2:
        return []
    found = [(i, i + 2, 0) for i in range(n - 1)]
    h = [int.from_bytes(xxhash.xxh3_128_digest(u)[:8], "little") for u in us]
    for kind, sign in ((1, 1), (2, -1)):
        starts, run = [0], 0
        for i in range(1, n):
            run = run + 1 if us[i] == us[i - 1] else 0
            valley = i < n - 1 and sign * h[i] < sign * h[i - 1] and sign * h[i] <= sign * h[i + 1]
            if valley or run >= 2 and run % 2 == 0 and i < n - 1 and us[i + 1] == us[i]:
                starts.append(i)
        found += [(a, b, kind) for a, b in zip(starts, [*starts[1:], n]) if b - a > 1]
    for i in range(n):
        length = 0
        for e in range(i + 1, n + 1):
            length += len(us[e - 1])
            if length >= 250 and e - i > 1:
                found.append((i, e, 3))
                break
    return found


def seeded_runs(pairs, seeds):
    """Runs of pairs (first units) that a chunk starts in, as (first, last unit)."""
    out = []
    for p in sorted(pairs):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [(a, b) for a, b in out if any(a <= s < b for s in seeds)]


def brute(docs):
    first = {}
    for i, t in docs:
        if i is not None:
            us = parts(t or "")
            for a, b, _ in stretches(us):
                key = tuple(us[a:b])
                first[key] = min(first.get(key, i), i)
    used = {}
    for i, t in docs:
        us = parts(t or "")
        hits = [(a, b, k) for a, b, k in stretches(us) if i is not None and first[tuple(us[a:b])] < i]
        ends = {}
        for a, b, k in hits:
            if k:
                ends[a] = max(b, ends.get(a, 0))
        for p, last in seeded_runs({a for a, _, k in hits if not k}, ends):
            while p <= last:
                a, b = (p, ends[p]) if p in ends else (p - 1, p + 1) if p == last else (p, p + 2)
                used.setdefault(i, set()).add(tuple(us[a:b]))
                p = p + 1 if p not in ends and p + 1 in ends else b
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, None, 0))
            continue
        us, gone, seen = parts(t), set(), {}
        own = ([], [])
        for a, b, k in sorted(stretches(us), key=lambda x: x[0]):
            key = tuple(us[a:b])
            if key in used.get(i, ()):
                gone.update(range(a, b))
            if seen.setdefault((k, key), b) <= a:
                own[k > 0].append(a)
        for a, b in seeded_runs(*own):
            gone.update(range(a, b + 1))
        out.append((i, "\n".join(u for k, u in enumerate(us) if k not in gone), sum(us[k].count("\n") + 1 for k in gone)))
    return sorted(out, key=str)


def answer(spark, docs, schema="doc_id long, text string"):
    return sorted(((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(docs, schema)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    stock = [f"line {i}" for i in range(30)] + ["", " ", "same", "same"]
    passages = [[rng.choice(stock) for _ in range(rng.randrange(2, 14))] for _ in range(8)]
    docs = []
    for i in range(80):
        ls = []
        for _ in range(rng.randrange(6)):
            ls += rng.choice([rng.choice(passages), [f"own {rng.random()}"], ["same"] * rng.randrange(9), [""] * rng.randrange(3)])
        docs.append((i, "\n".join(ls)))
    docs += [(None, docs[5][1] + "\n" + docs[5][1]), (90, None), (91, ""), (92, "one line"), (93, docs[7][1]), (93, docs[7][1]), (93, docs[8][1]), (94, "\n".join(["x"] * 50)), (95, "\n\n\nx\ny\n\n")]
    assert answer(spark, docs) == brute(docs)


def test_hashes_only_propose(spark, monkeypatch):
    """With hashes of three values, nothing goes that hasn't its very bytes in an earlier document."""
    docs = [(1, "a\nb\nc\nd\ne\nf"), (2, "g\nh\ni\nj\nk\nl"), (3, "a\nb\nc\nd\ne\nf")]
    real = lines.Units.__init__

    def poor(self, text):
        real(self, text)
        self.hashes = self.hashes % 3

    monkeypatch.setattr(lines.Units, "__init__", poor)
    firsts: dict = {}
    for i, t in docs:
        kept, n, lost = lines.strip(t, [])
        assert (kept, n, lost) == (t, 6, 0)
        u = lines.Units(t)
        for k in range(len(u.starts)):
            firsts.setdefault((int(u.hashes[k]), u.content(k)), i)
    assert {i for (h, c), i in firsts.items() if c.startswith("g")} == {2}


def test_recall_of_passages(spark):
    """Passages of 8 to 20 lines between unique lines: over nine tenths of their lines go, and no other line."""
    rng = random.Random(3)
    own = lambda n: [f"own {rng.random()}" for _ in range(n)]
    for size in (8, 12, 20):
        passages = [own(size) for _ in range(150)]
        docs = [(i, "\n".join(own(3) + p + own(3))) for i, p in enumerate(passages)] + [(1000 + i, "\n".join(own(2) + p + own(4))) for i, p in enumerate(passages)]
        got = {i: (t, n) for i, t, n in answer(spark, docs)}
        assert all(got[i] == (t, 0) for i, t in docs[:150])
        assert sum(got[1000 + i][1] for i in range(150)) >= 0.9 * size * 150
        assert all(set(t.split("\n")) - set(passages[i - 1000]) <= set(got[i][0].split("\n")) for i, t in docs[150:])


def test_few_long_lines(spark):
    """Passages of two or three lines that have over fifty words go whole."""
    rng = random.Random(6)
    own = lambda n, k: [" ".join(f"w{rng.randrange(10**6)}" for _ in range(k)) for _ in range(n)]
    passages = [own(n, 60 // n + 2) for n in (2, 3) for _ in range(40)]
    docs = [(i, "\n".join(own(3, 9) + p + own(3, 9))) for i, p in enumerate(passages)] + [(1000 + i, "\n".join(own(2, 9) + p + own(4, 9))) for i, p in enumerate(passages)]
    got = {i: n for i, _, n in answer(spark, docs)}
    assert all(got[i] == 0 and got[1000 + i] == len(p) for i, p in enumerate(passages))


def test_repeated_documents_go_whole(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join(f"own {rng.random()}" for _ in range(rng.randrange(2, 30)))) for i in range(60)]
    docs += [(100 + i, t) for i, t in docs]
    got = {i: (t, n) for i, t, n in answer(spark, docs)}
    assert all(got[100 + i] == ("", t.count("\n") + 1) and got[i] == (t, 0) for i, t in docs[:60])


def test_odd_columns_and_tables(spark):
    names = "doc_id long, text string, n_lines string, n_removed int, row string, hs int, h int, owner int, s string, `a.b` int"
    docs = spark.createDataFrame([(1, "a\nb\nc", "x", 1, "r", 2, 3, 4, "s", 5), (2, "a\nb\nc", "x", 1, "r", 2, 3, 4, "s", 5)], names)
    got = lines.dedup_lines(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed, r.row, r["a.b"]) for r in got.collect()} == {(1, "a\nb\nc", 3, 0, "r", 5), (2, "", 3, 3, "r", 5)}
    assert lines.dedup_lines(docs.where("false")).count() == 0


def test_long_text_and_hot_passage(spark):
    """A passage that most documents have, and a very long text."""
    long = "\n".join(map(str, range(30_000)))
    docs = [(i, f"own {i}\nlicense a\nlicense b\nlicense c\nlicense d\nlicense e\nlicense f\nown too {i}") for i in range(2000)] + [(5000, long), (5001, "x\n" + long)]
    got = {i: (t, n) for i, t, n in answer(spark, docs)}
    assert got[5000] == (long, 0) and got[5001] == ("x", 30_000)
    assert got[0][1] == 0 and len({got[i][1] for i in range(1, 2000)}) == 1 and got[1][1] >= 6
