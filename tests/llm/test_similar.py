"""Groups of similar documents against exact Jaccard similarity of five-word shingles."""

import random

import pytest

from scrivano.llm import simhash


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    found = {i: sets(t) for i, t in docs}
    root = {i: i for i in found}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in found:
        for j in found:
            if i < j and 5 * len(found[i] & found[j]) >= 4 * len(found[i] | found[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in found}


def answer(spark, docs):
    return {r.doc_id: r.component_id for r in simhash.similar_documents(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("original", [0, 1700])
def test_star_of_copies(spark, original):
    """Copies that resemble their original, first or in the midst of them, but not each other, all join it."""
    rng = random.Random(original)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    whole = sets(" ".join(base))
    docs, like = [(original, " ".join(base))], {original}
    for i in range(2000):
        if i != original:
            docs.append((i, t := edited(rng, base, rng.choice([7, 8]))))
            if 5 * len(whole & sets(t)) >= 4 * len(whole | sets(t)):
                like.add(i)
    got = answer(spark, docs)
    assert len(like) > 1900 and {got[i] for i in like} == {min(like)}
    assert all(got[i] == i for i in got if i not in like)


@pytest.mark.parametrize("rounds", [0, 3])
def test_links_are_exact(spark, monkeypatch, rounds):
    """All pairs at 0.8 or more and none below, of short and long texts, ties and chains."""
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "COMMON", 5)
    rng = random.Random(rounds)
    docs = []
    for size in [*range(4, 14), 20, 40, 60, 100, 200, 400]:
        for _ in range(3):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            docs += [" ".join(base), " ".join([*base, "more"])]
            docs += [edited(rng, base, k) for k in range(1, 1 + max(1, size // 35))]
            docs.append(" ".join(base[: size * 4 // 5 + 1]))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    assert answer(spark, docs) == brute(docs)
