"""Line dedup by content-defined chunks.

A text is a sequence of units: a line with text and the blank lines after it (leading blank lines belong to the first unit).
Each unit has a hash. A unit whose hash is less than that of the one before and not more than that of the one after starts a
chunk; so does, in a second chunking, one whose hash is more than the one before and not less than the one after. In a run of
equal units every second one starts a chunk. Such boundaries depend on the units beside them alone, so the chunks of a
passage are the same wherever it stands. No chunk of these has less than two units (but the first and the last may), and
as hashes rarely rise or fall for long, chunks are short: two to four units mostly, without any bound set. Passages of few
but long lines may hold no whole chunk of these; so in a third chunking, whose chunks overlap, the fewest units from each unit on
(two at least) that have LONG characters are a chunk as well.

A chunk of two or more units that also stands in a document of smaller doc_id is a repeat, and it grows to both sides, unit by
unit, as long as the pair of units at its edge stands in a document of smaller doc_id too. All units of a repeat are removed.
Within a document the same holds of what stands farther up. Equal hashes only propose: the bytes are grouped, and what
merely shares its hash stays. Texts of a single unit are never removed.

Null texts stay null, empty ones empty. doc_id is an integer. Rows with the same doc_id count as one document and lose the
same chunks; rows with a null doc_id lose only their own repeats. Other columns, of any names, pass through. An empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.store import claim, drop, materialise, small_batches
from scrivano.llm.words import Rolling, line_hashes

#: Characters of a chunk of the third kind: some fifty words.
LONG = 250
STRIPPED = "struct<text: string, n_lines: long, n_removed: long>"


def units(text: str) -> tuple[list[str], np.ndarray]:
    """The units of a text, which line feeds join to the text again, and how many lines each has."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x and not x.isspace()][1:]
    edges = [0, *full, len(lines)]
    return [lines[a] if b - a == 1 else "\n".join(lines[a:b]) for a, b in zip(edges, edges[1:])], np.diff(edges)


def starts_of_chunks(h: np.ndarray, most: bool) -> np.ndarray:
    """Positions that start a chunk, from the units' hashes."""
    n = len(h)
    x = ~h if most else h
    first = np.zeros(n, bool)
    first[1:-1] = (x[1:-1] < x[:-2]) & (x[1:-1] <= x[2:])
    same = np.concatenate([[False], h[1:] == h[:-1]])
    at = np.arange(n)
    run = at - np.maximum.accumulate(np.where(same, 0, at))  # place in a run of equal units
    inner = np.append(same[1:], False)  # the next one is in the run too
    return np.flatnonzero(first | (run >= 2) & (run % 2 == 0) & inner)


class Units:
    """A text's units and the stretches of them that are looked at: pairs (kind 0) and the chunks of the three chunkings."""

    def __init__(self, text: str):
        self.texts, self.lines = units(text)
        n = len(self.texts)
        self.starts = self.ends = self.hashes = self.kinds = np.array([], np.int64)
        if n < 2:
            return
        found = line_hashes(self.texts)
        starts, ends, kinds = [np.arange(n - 1)], [np.arange(2, n + 1)], [np.zeros(n - 1, np.int64)]
        for kind, most in ((1, False), (2, True)):
            cuts = starts_of_chunks(found[:, 0], most)
            a, b = np.concatenate([[0], cuts]), np.append(cuts, n)
            a, b = a[b - a > 1], b[b - a > 1]
            starts.append(a), ends.append(b), kinds.append(np.full(len(a), kind))
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.texts), np.int64, n))])
        a = np.arange(n)
        b = np.maximum(np.searchsorted(total, total[:-1] + LONG), a + 2)
        a, b = a[b <= n], b[b <= n]
        starts.append(a), ends.append(b), kinds.append(np.full(len(a), 3))
        self.starts, self.ends, self.kinds = (np.concatenate(x) for x in (starts, ends, kinds))
        self.hashes = Rolling(found).of(self.starts, self.ends)

    def content(self, i: int) -> str:
        return "\n".join(self.texts[self.starts[i] : self.ends[i]])


def _runs(pairs: np.ndarray, seeds: np.ndarray) -> list[tuple[int, int]]:
    """First and last unit of each unbroken run of pairs (given by first units, in order) in which a chunk starts."""
    if not len(pairs) or not len(seeds):
        return []
    edges = np.flatnonzero(np.diff(pairs) > 1)
    first, last = pairs[np.concatenate([[0], edges + 1])], pairs[np.append(edges, len(pairs) - 1)]
    at = np.unique(np.searchsorted(first, seeds, "right") - 1)
    return [(int(first[i]), int(last[i]) + 1) for i in at if i >= 0]


def _cover(at: list[int], sizes: list[int], hashes: list[int]) -> list[int]:
    """Of the hits of a text (pairs have size 0) the hashes that cover every unit of each repeat."""
    pairs, seeds = {}, {}
    for a, n, h in zip(at, sizes, hashes):
        if not n:
            pairs[a] = h
        elif n > seeds.get(a, (0, 0))[0]:
            seeds[a] = (n, h)
    out = []
    for p, last in _runs(np.array(sorted(pairs)), np.array(sorted(seeds))):
        while p <= last:
            if p in seeds:
                out.append(seeds[p][1])
                p += seeds[p][0]
            elif p == last:
                out.append(pairs[p - 1])
                p += 1
            else:
                out.append(pairs[p])
                p += 1 if p + 1 in seeds else 2
    return list(dict.fromkeys(out))


def _looked_at(texts: pa.Array) -> pa.Array:
    claim("lines")
    out = []
    for t in texts.to_pylist():
        u = Units(t or "")
        sizes = np.where(u.kinds > 0, u.ends - u.starts, 0)
        out.append([{"at": a, "n": n, "h": h} for a, n, h in dict.fromkeys(zip(u.starts.tolist(), sizes.tolist(), u.hashes.tolist()))])
    return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("h", pa.int64())])))


def _used(hits: pa.Array) -> pa.Array:
    claim("lines")
    return pa.array([_cover([x["at"] for x in h], [x["n"] for x in h], [x["h"] for x in h]) for h in hits.to_pylist()], pa.list_(pa.int64()))


def _contents(texts: pa.Array, hashes: pa.Array) -> pa.Array:
    """The distinct stretches whose hashes are among the given."""
    claim("lines")
    out = []
    for t, hs in zip(texts.to_pylist(), hashes.to_pylist()):
        u = Units(t or "")
        at = np.flatnonzero(np.isin(u.hashes, np.array(hs, np.int64))).tolist()
        out.append([{"h": h, "content": c} for h, c in dict.fromkeys((int(u.hashes[i]), u.content(i)) for i in at)])
    return pa.array(out, pa.list_(pa.struct([("h", pa.int64()), ("content", pa.string())])))


def _own_repeats(u: Units) -> list[tuple[int, int]]:
    """Runs of units that stand farther up in the same text."""
    repeated: list[list[int]] = [[], [], [], []]
    first: dict = {}
    for i in np.argsort(u.starts, kind="stable").tolist():
        kind, h, a = int(u.kinds[i]), int(u.hashes[i]), int(u.starts[i])
        j = first.setdefault((kind, h), i)
        if u.ends[j] <= a and u.content(i) == u.content(j):
            repeated[kind].append(a)
    return _runs(np.array(repeated[0]), np.array(sorted(repeated[1] + repeated[2] + repeated[3])))


def strip(text: str, gone: list[int]) -> tuple[str, int, int]:
    """What is left of a text without the stretches of these hashes and without its own repeats; its lines, and those removed."""
    u = Units(text)
    covered = np.zeros(len(u.texts) + 1, np.int64)
    if gone:
        at = np.isin(u.hashes, np.array(gone, np.int64))
        np.add.at(covered, u.starts[at], 1)
        np.add.at(covered, u.ends[at], -1)
    if len(np.unique(u.hashes[u.kinds == 0])) < len(u.texts) - 1:
        for a, b in _own_repeats(u):
            covered[a] += 1
            covered[b + 1] -= 1
    lost = np.cumsum(covered[:-1]) > 0
    kept = text if not lost.any() else "\n".join(x for x, out in zip(u.texts, lost.tolist()) if not out)
    return kept, int(u.lines.sum()), int(u.lines[lost].sum())


def _strip(texts: pa.Array, hashes: pa.Array) -> pa.Array:
    claim("lines")
    found = [(None, 0, 0) if t is None else strip(t, h or []) for t, h in zip(texts.to_pylist(), hashes.to_pylist())]
    columns = list(zip(*found)) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) with the kept text in `text`, and n_lines and n_removed added (or replaced)."""
    small_batches(docs.sparkSession)
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    looked = F.explode(F.arrow_udf(_looked_at, "array<struct<at: int, n: int, h: long>>")(F.col("text")))
    rows = materialise(texts.select("doc_id", F.xxhash64("text").alias("row"), looked.alias("k")).select("doc_id", "row", "k.*"), "stretches")
    # The owners are written: in one stage with a sum a skewed hash could not be split.
    owners = materialise(rows.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"), "owners")
    hits = rows.join(owners, "h").where("owner < doc_id").groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "n", "h")).alias("hits"))
    used = materialise(hits.select("doc_id", F.explode(F.arrow_udf(_used, "array<long>")(F.col("hits"))).alias("h")).distinct(), "used")
    drop(rows)
    # Byte comparison: the first document that has the same bytes under the same hash must come before.
    wanted = materialise(used.select("h").distinct().join(owners, "h"), "wanted")
    sought = used.unionByName(wanted.select(F.col("owner").alias("doc_id"), "h")).groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    contents = F.explode(F.arrow_udf(_contents, "array<struct<h: long, content: string>>")(F.col("text"), F.col("hs")))
    # Both joins of the texts are merges at any size: sides that a planner would broadcast while they are small grow with docs.
    firsts = texts.join(sought.hint("merge"), "doc_id").select("doc_id", contents.alias("c")).groupBy("c.h", "c.content").agg(F.min("doc_id").alias("doc_id")).select("h", "doc_id")
    firsts = materialise(firsts, "firsts")
    spared = firsts.join(wanted, "h").where("doc_id > owner").select("doc_id", "h")
    gone = materialise(used.join(spared, ["doc_id", "h"], "left_anti").groupBy("doc_id").agg(F.collect_list("h").alias("hs")), "gone")
    drop(owners, used, wanted, firsts)
    # Whatever the columns of docs are called, the row is one column here.
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed"))).alias("row"))
    marked = row.withColumn("doc_id", F.col("row.doc_id")).join(gone.hint("merge"), "doc_id", "left")
    return marked.select("row", F.arrow_udf(_strip, STRIPPED)(F.col("row.text"), F.col("hs")).alias("s")).select(F.col("row").withField("text", F.col("s.text")).alias("row"), "s.n_lines", "s.n_removed").select("row.*", "n_lines", "n_removed")
