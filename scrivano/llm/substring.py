"""Removal of word sequences that also stand in a document of smaller doc_id, by level-wise doubling.

A window is `window` (w) consecutive words. Candidates start at a quarter of that length: of the quarter windows inside each
window the one of least hash is chosen, which both copies of a repeated window choose alike, so no repeat is lost though
only a few per cent of the positions are looked at. Those that stand in more than one document are extended to half
of w, to the right and to the left; those repeated at that length are extended to w, at every start they allow. Then no
candidate is left to extend.

The stretch between chosen neighbours, w words beyond the second, is a candidate of up to twice w: where it stands in an
earlier document as a whole, all its windows do, and only the earliest document's windows go on to the last level. So many
copies of a text cost little more than one. Hashes at lengths under w only filter; at w and beyond they have 128 bits.

Windows are judged on the input. Null texts have no words. Rows with the same doc_id don't count as earlier than each other;
rows with a null doc_id keep all words and remove none elsewhere. doc_id is an integer. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.store import claim, drop, materialise, small_batches
from scrivano.llm.words import Rolling, forget, word_hashes


def _sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minima (or maxima) of each `size` neighbours, by doubling."""
    pick, have = (np.minimum if least else np.maximum), 1
    while have < size:
        step = min(have, size - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def anchors(grams: np.ndarray, size: int) -> np.ndarray:
    """Positions of the least of each `size` neighbours, and the first and last window's start."""
    least = _sliding(grams, size, True)
    edge = np.zeros(size - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, least, edge]), size, False) == grams
    chosen[[0, len(least) - 1]] = True
    return np.flatnonzero(chosen)


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


LEVELS = "doc_id long, row long, pos int, span int, quarter long, right long, left long, hi long, lo long"


def _levels(w: int):
    quarter, half = w // 4, w // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            claim("substring", forget)
            found = []
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = split(text)
                if (n := len(words)) < w:
                    continue
                roll, at = Rolling(word_hashes(words)), np.arange(n - quarter + 1)
                p = anchors(roll.of(at, at + quarter).view(np.uint64), w - quarter + 1)
                p = p[p <= n - quarter]
                rest = half - quarter
                has_right, has_left = p + half <= n, p >= rest
                following = np.append(p[1:], n)
                has_span = following + w <= n
                r, l, e = np.where(has_right, p, 0), np.where(has_left, p - rest, 0), np.where(has_span, following + w, p)
                columns = [np.full(len(p), doc_id), np.full(len(p), row), p.astype(np.int32), np.where(has_span, following - p, -1).astype(np.int32), roll.of(p, p + quarter), roll.of(r, r + half), roll.of(l, l + half), roll.of(p, e), roll.of(p, e, 1)]
                found.append((columns, has_right, has_left))
            if found:
                whole = [np.concatenate([f[0][i] for f in found]) for i in range(9)]
                right, left = (np.concatenate([f[i] for f in found]) for i in (1, 2))
                masks = {5: ~right, 6: ~left}
                names = [x.split()[0] for x in LEVELS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, mask=masks.get(i)) for i, c in enumerate(whole)], names=names)

    return run


def _starts(n: int, w: int, positions: list[int], marks: list[int], spans: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Masks over window starts: those covered by a repeated span, and the others that candidates allow.

    marks: 1 for repeated to the right, 2 to the left, 4 for a span that an earlier document has.
    """
    quarter, half = w // 4, w // 2
    p, m, s = np.array(positions), np.array(marks), np.array(spans)
    size = n - w + 1
    out = []
    for bit, first, last in ((4, p, p + s), (1, p - (w - half), p), (2, p - (w - quarter), p - (half - quarter))):
        on = (m & bit) > 0
        edges = np.zeros(size + 1, np.int64)
        low, high = np.clip(first[on], 0, size), np.clip(last[on] + 1, 0, size)
        np.add.at(edges, low, 1)
        np.add.at(edges, np.maximum(low, high), -1)
        out.append(np.cumsum(edges[:-1]) > 0)
    return out[0], (out[1] | out[2]) & ~out[0]


WINDOWS = "doc_id long, row long, start int, hi long, lo long"


def _windows(w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            claim("substring", forget)
            found = []
            for doc_id, row, text, positions, marks, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = split(text)
                at = np.flatnonzero(_starts(len(words), w, positions, marks, spans)[1])
                if len(at):
                    roll = Rolling(word_hashes(words))
                    found.append([np.full(len(at), doc_id), np.full(len(at), row), at.astype(np.int32), roll.of(at, at + w), roll.of(at, at + w, 1)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(5)], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return run


def _strip(w: int):
    def run(texts: pa.Array, marked: pa.Array, hits: pa.Array) -> pa.Array:
        claim("substring", forget)
        kept, sizes, lost = [], [], []
        for text, m, h in zip(texts.to_pylist(), marked.to_pylist(), hits.to_pylist()):
            words = split(text)
            sizes.append(n := len(words))
            if m or h:
                gone = np.zeros(n - w + 1, bool)
                if m:
                    gone |= _starts(n, w, [x["pos"] for x in m], [x["mark"] for x in m], [x["span"] for x in m])[0]
                gone[h or []] = True
                edges = np.zeros(n + 1, np.int64)
                edges[: n - w + 1] += gone
                edges[w:] -= gone
                stay = np.cumsum(edges[:-1]) == 0
                words = [words[i] for i in np.flatnonzero(stay)]
            lost.append(n - len(words))
            kept.append(b" ".join(words))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())], ["text", "n_words", "n_removed"])

    return run


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, kept (words joined by single spaces), n_words and n_removed of each row of docs (doc_id, text)."""
    if window < 8:
        raise ValueError("a window has eight words at least")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    numbered = docs.where("doc_id is not null and text is not null")
    # A quarter: the chosen positions that stand in more than one document.
    first = materialise(numbered.mapInArrow(_levels(window), LEVELS), "levels")
    twice = first.groupBy("quarter").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("quarter")
    twice = materialise(twice, "quarters")  # or else the join follows the sum in one stage, where a skewed key can't be split
    second = materialise(first.join(twice, "quarter").drop("quarter"), "levels")
    drop(first)
    # A half, to either side; and the stretch to the next position, beyond the window's length.
    none = F.lit(None).cast("long")
    rows = second.select("doc_id", "row", "pos", "span", F.explode(F.array(
        F.struct(F.lit(1).alias("mark"), F.col("right").alias("hi"), F.lit(0).cast("long").alias("lo")),
        F.struct(F.lit(2).alias("mark"), F.col("left").alias("hi"), F.lit(0).cast("long").alias("lo")),
        F.struct(F.lit(4).alias("mark"), F.when(F.col("span") >= 0, F.col("hi")).otherwise(none).alias("hi"), F.col("lo").alias("lo")),
    )).alias("k")).select("doc_id", "row", "pos", "span", F.when(F.col("k.mark") == 4, 4).otherwise(3).alias("side"), "k.*").where("hi is not null")
    owners = materialise(rows.groupBy("side", "hi", "lo").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").drop("b"), "halves")
    found = rows.join(owners, ["side", "hi", "lo"]).where((F.col("mark") < 4) | (F.col("doc_id") > F.col("a")))
    marks = found.groupBy("doc_id", "row", "pos", "span").agg(F.bit_or("mark").alias("mark"))
    marked = materialise(marks.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("pos", "mark", "span")).alias("m")), "marks")
    drop(second)
    # The whole length, at every start that is left.
    at = [F.col("doc_id") == F.col("d"), F.col("row") == F.col("r")]
    whole = numbered.join(marked, at).select("doc_id", "row", "text", "m.pos", "m.mark", "m.span")
    windows = materialise(whole.mapInArrow(_windows(window), WINDOWS), "windows")
    owners = materialise(windows.groupBy("hi", "lo").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").drop("b"), "owners")
    hits = windows.join(owners, ["hi", "lo"]).where("doc_id > a").groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list("start").alias("h"))
    gone = marked.select("d", "r", F.filter("m", lambda x: x.mark.bitwiseAND(4) > 0).alias("m")).join(hits, ["d", "r"], "left").where("size(m) > 0 or h is not null")
    gone = materialise(gone, "gone")
    drop(windows)
    stripped = docs.join(gone, at, "left").select("doc_id", F.arrow_udf(_strip(window), "struct<text: string, n_words: long, n_removed: long>")("text", "m", "h").alias("s"))
    return stripped.select("doc_id", F.col("s.text").alias("kept"), "s.n_words", "s.n_removed")
