"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set if it is set in over half of the XXH64 values (seed 42) of the document's word shingles,
repeats included. Two fingerprints link at `bits` or fewer differing bits.

Equal fingerprints are one node. Each distinct fingerprint carries a table of its Hamming distances to reference
fingerprints. Since a Hamming distance differs by at most d between fingerprints that are d apart, a pair whose tables
differ by more than `bits` in any coordinate is discarded before its own distance is computed. The pairs themselves come
from cells: with the fingerprint cut into bits + 2 blocks, two blocks agree exactly in every linked pair. In a cell of more
than `CELL` fingerprints (many near copies of one text) pairs would grow with the square; those fingerprints are linked
through shared midpoints instead: all codes that differ in at most half of the bits, so the work is a fixed number of
rows for each fingerprint and no link is lost.

Texts that are null or have no words have fingerprint zero and link like any other. A text with fewer words than a shingle
is one shingle. Rows whose doc_id is null get a fingerprint and belong to components, but name none unless alone.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.llm.graph import components
from scrivano.llm.store import claim, drop, free, materialise, small_batches
from scrivano.llm.words import forget, mix, word_hashes

#: Reference fingerprints, the largest cell whose pairs are compared, and shingles hashed at once.
PIVOTS, CELL, AT_ONCE = 16, 32, 1 << 16


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), AT_ONCE):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + AT_ONCE], ends[i : i + AT_ONCE])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(spark: SparkSession, text: Column, words: int) -> Column:
    small_batches(spark)

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        claim("simhash", forget)
        return pa.array([fingerprint(x, words) for x in texts.to_pylist()], pa.int64())

    return run(text)


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _distances(fp: Column) -> list[Column]:
    """The pivot table: PIVOTS Hamming distances, eight packed in a long."""
    pivots = [_long(xxhash.xxh64_intdigest(f"pivot {i}".encode())) for i in range(PIVOTS)]
    return [F.expr("0L") if not g else sum((F.shiftleft(F.bit_count(fp.bitwiseXOR(p)).cast("long"), 8 * i) for i, p in enumerate(g[1:], 1)), F.bit_count(fp.bitwiseXOR(g[0])).cast("long")) for g in (pivots[i : i + 8] for i in range(0, PIVOTS, 8))]


def _apart(a: Column, b: Column) -> Column:
    """The largest difference of coordinates of two packed tables."""
    return F.greatest(*(F.abs(F.shiftrightunsigned(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(b, 8 * i).bitwiseAND(F.lit(255))) for i in range(8)))


def _cells(fp: Column, bits: int) -> Column:
    """A key for each pair of blocks: the pair's number above the two blocks' bits, so keys of different pairs differ."""
    edges = [round(i * 64 / (bits + 2)) for i in range(bits + 3)]
    keys = []
    for n, (i, j) in enumerate(itertools.combinations(range(bits + 2), 2)):
        mask = sum(((1 << (edges[x + 1] - edges[x])) - 1) << edges[x] for x in (i, j))
        keys.append(F.struct(F.lit(n).cast("tinyint").alias("n"), fp.bitwiseAND(_long(mask)).alias("cell")))
    return F.explode(F.array(*keys))


def links(fps: DataFrame, bits: int) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) whose components are those of all links at `bits` or fewer bits."""
    tables = [f"d{i}" for i in range((PIVOTS + 7) // 8)]
    cells = fps.select("fp", *(d.alias(n) for n, d in zip(tables, _distances(F.col("fp")))), _cells(F.col("fp"), bits).alias("k")).select("k.*", "fp", *tables)
    sizes = materialise(cells.groupBy("n", "cell").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    full = materialise(cells.join(sizes, ["n", "cell"]), "cells")
    some = full.where(F.col("size") <= CELL)
    a, b = some.alias("a"), some.alias("b")
    near = F.lit(True)
    for t in tables:
        near &= _apart(F.col(f"a.{t}"), F.col(f"b.{t}")) <= bits
    pairs = a.join(b, [F.col("a.n") == F.col("b.n"), F.col("a.cell") == F.col("b.cell"), F.col("a.fp") < F.col("b.fp"), near])
    pairs = pairs.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return pairs.unionByName(_by_midpoints(full.where(F.col("size") > CELL).select("fp").distinct(), bits)).distinct()


def _by_midpoints(fps: DataFrame, bits: int) -> DataFrame:
    """Edges that connect all fingerprints at `bits` or fewer bits: through codes half way, of which each has a fixed number.

    For an even number of bits, what shares a midpoint is linked; for an odd one a midpoint may also join pairs one bit
    farther apart, so `bits` must be even here.
    """
    if bits % 2:
        raise ValueError("an even number of bits is needed")
    masks = [0, *(sum(1 << i for i in c) for r in range(1, bits // 2 + 1) for c in itertools.combinations(range(64), r))]
    codes = fps.select("fp", F.explode(F.array(*map(_long, masks))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("code"))
    met = codes.groupBy("code").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # no more than there are masks
    return met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp (signed 64-bit) and component_id of every row of docs (doc_id, text); bits is even."""
    if bits % 2:
        raise ValueError("an even number of bits is needed")
    own = materialise(docs.select("doc_id", fingerprints(spark, F.col("text"), words).alias("fp")), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), bits))
    # Written before they are joined, so that a giant component or a text with very many copies can be split.
    linked = materialise(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "linked")
    ids = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = materialise(linked.join(ids, "root").select("fp", "component_id"), "named")
    drop(linked, ids)
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


# Similarity of sets of shingles. At a similarity of 0.8 about one bit in seven of a SimHash differs, which 64 bits can't tell
# from chance, so fingerprints have BITS bits here. What their pivot distance tables and then their own distances leave is
# checked exactly: the symmetric difference of two sets of shingles decides their similarity.

#: Documents that are looked through for common shingles, and how many of them must have one.
SAMPLE, COMMON = 20_000, 20
#: Slices of the hash values, in which a set's shingles are counted.
SLICES = 256
#: Times that each member of a cell meets the one partner that shares most cells with it, before all that is open meets in pairs.
ROUNDS = 3
MULTIPLIER = np.uint64(0x94D049BB133111EB)
#: Bits of a wide fingerprint (64 a seed, which turns a shingle's hash into 64 more bits), and how rarely a link may be lost:
#: no more often than two shingles have one hash by chance.
BITS, LOST = 512, 2.0**-64
SEEDS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))
#: Sizes of sets for which the largest distance is computed one by one; from half of them on it hardly changes.
SIZES = 48


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles, rolled from the hashes of its words."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.array([], np.uint64)
    k, one = min(words, len(found)), word_hashes(found)[:, 0]
    h = np.full(len(found) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * MULTIPLIER + one[i : i + len(h)]
    return np.unique(mix(h))


def wide(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in BITS / 8 bytes: a bit is set if it is set in over half of the shingles' bits."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 255):
        h = mix(found[i : i + 255, None] ^ SEEDS).astype("<u8")
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(found), bitorder="little")


def distances(fps: np.ndarray) -> np.ndarray:
    """Rows of the pivot distance table of fingerprints (rows of bytes): four numbers of 0 to 2 in each byte.

    The reference fingerprints are all unions of pairs of neighbouring bits. The distance of F to such a union P is |F| + |P| -
    2 |F and P|, so the numbers of bits that F has in each pair hold the distances to all of them.
    """
    return (fps & 0x55) + (fps >> 1 & 0x55)


def tables_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of `distances`, the largest difference of their coordinates, which the fingerprints' distance is never below.

    For the union of the pairs in which F has less, the distances of F and G differ by all that one has more than the other.
    """
    return sum(np.abs((a >> i & 3).astype(np.int8) - (b >> i & 3).astype(np.int8)).sum(1, dtype=np.int64) for i in (0, 2, 4, 6))


def chance(shared: int, a: int, b: int) -> float:
    """How likely a bit of two sets' fingerprints differs, by the shingles that they share and those that one alone has."""

    def over(own: int) -> np.ndarray:  # the chance that the set's bit is set, by the shared shingles that have it
        ways = np.array([math.comb(own, i) / 2**own for i in range(own + 1)])
        tail = np.append(np.cumsum(ways[::-1])[::-1], 0)
        return tail[np.clip((shared + own) // 2 + 1 - np.arange(shared + 1), 0, own + 1)]

    x, y = over(a), over(b)
    return float(np.array([math.comb(shared, i) / 2**shared for i in range(shared + 1)]) @ (x * (1 - y) + y * (1 - x)))


@functools.cache
def limits(similarity: float) -> np.ndarray:
    """The most bits in which two linked sets' fingerprints differ, but with the chance LOST, by the smaller set's size.

    Of the sizes and shares that give the similarity the one with most differing bits counts. The last number is for all larger sets.
    """

    def worst(n: int) -> float:
        found = [0.0]
        for m in range(n, math.floor(n / similarity + 1e-9) + 1):
            least = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            found += [chance(s, n - s, m - s) for s in range(least, min(n, least + 1) + 1)]  # an even and an odd number
        return max(found)

    def most(p: float) -> int:
        """The least number of bits that is exceeded with a chance under LOST (Chernoff's bound)."""
        for at in range(math.ceil(p * BITS), BITS):
            q = at / BITS
            if p == 0 or q and BITS * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p))) >= -math.log(LOST):
                return at
        return BITS

    p = [worst(n) for n in range(SIZES)]
    return np.array([*map(most, p), most(max(p[SIZES // 2 :]))])


def table(found: np.ndarray) -> bytes:
    """How many of a set's shingles lie in each slice, up to 255: for the exact check, its row of a table of distances.

    The distance of a set A to a reference fingerprint P that is a union of slices is |A| + |P| - 2 |A and P|, so the slices'
    counts hold the distances to all such references.
    """
    return np.minimum(np.bincount((found >> np.uint64(64 - SLICES.bit_length() + 1)).astype(np.int64), minlength=SLICES), 255).astype(np.uint8).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of counts, the largest difference of coordinates, which no distance of two sets is below.

    For the union of the slices in which A has more, the coordinates of A and B differ by what A has more and what B has more
    elsewhere, together; no other union does better. Counts that are cut at 255 only lower the bound.
    """
    return np.abs(a.astype(np.int16) - b).sum(1, dtype=np.int64)


def _sets(words: int) -> Callable[[Column], Column]:
    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        claim("simhash", forget)
        return pa.array([shingles(t, words).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return run


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many documents of a sample have."""
    step = max(1, docs.count() // SAMPLE)
    drawn = docs.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(step)) == 0).select(F.explode(_sets(words)(F.col("text"))).alias("x"))
    return np.sort(drawn.groupBy("x").count().where(F.col("count") >= COMMON).select("x").toArrow().column(0).to_numpy().view(np.uint64))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by cell, those of a cell with more rows; the first and the last cell may go on in other tasks and stay."""
    held, going = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held else [batch])
        cell = table.column("cell").to_numpy()
        same = cell[1:] == cell[:-1]
        keep = np.concatenate([[going], same]) | np.concatenate([same, [False]])
        yield from table.slice(0, len(cell) - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
        held, going = table.slice(len(cell) - 1).combine_chunks().to_batches()[0], bool(keep[-1])
    if held:
        yield held


def _may_link(similarity: float) -> Column:
    """Whether two sets that first meet in this cell, at these places of their order, may have the similarity."""
    na, nb = F.col("a.n"), F.col("b.n")
    left = F.least(na - F.col("a.at"), nb - F.col("b.at"))
    return (F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-9) & (left * (1 + similarity) >= similarity * (na + nb) - 1e-9)


def _near(similarity: float) -> Callable[..., Column]:
    """Whether pairs may link: by the pivot tables, then by the fingerprints, then by the counts of the sets."""
    most = limits(similarity)

    @F.arrow_udf("boolean")
    def run(ta: pa.Array, tb: pa.Array, fa: pa.Array, fb: pa.Array, ca: pa.Array, cb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        claim("simhash", forget)

        def rows(column: pa.Array, width: int) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)

        m, n = na.to_numpy(zero_copy_only=False), nb.to_numpy(zero_copy_only=False)
        bits = most[np.minimum(np.minimum(m, n), len(most) - 1)]
        left = np.flatnonzero(tables_apart(rows(ta, BITS // 8), rows(tb, BITS // 8)) <= bits)
        left = left[np.bitwise_count(rows(fa, BITS // 8)[left] ^ rows(fb, BITS // 8)[left]).sum(1, dtype=np.int64) <= bits[left]]
        left = left[apart(rows(ca, SLICES)[left], rows(cb, SLICES)[left]) * (1 + similarity) <= (m + n)[left] * (1 - similarity) + 1e-6]
        found = np.zeros(len(m), bool)
        found[left] = True
        return pa.array(found)

    return run


class _Verifier:
    """Holds the fingerprints and tables of the documents in play (node, n, pivots, fp, counts) and verifies pairs."""

    def __init__(self, docs: DataFrame, pivots: DataFrame, words: int, similarity: float):
        self.docs, self.pivots, self.words, self.similarity = docs, pivots, words, similarity
        self.sets: list[DataFrame] = []

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """The sets of nodes, of which those that no earlier pair had are made from the texts."""
        new = nodes
        for known in self.sets:
            new = new.join(known.select("node"), "node", "left_anti")
        new = materialise(new, "new-nodes")
        own = self.docs.join(new, F.col("doc_id") == F.col("node"), "left_semi")
        self.sets.append(materialise(own.select(F.col("doc_id").alias("node"), _sets(self.words)(F.col("text")).alias("set")), "sets"))
        drop(new)
        return functools.reduce(DataFrame.unionByName, self.sets).join(nodes, "node", "left_semi")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that have the similarity: what the pivot tables and fingerprints leave is held against the whole sets."""
        a, b = (self.pivots.select(F.col("node").alias(end), *(F.col(c).alias(c + end) for c in ("pivots", "fp", "counts", "n"))) for end in "uv")
        near = _near(self.similarity)(*(c + end for c in ("pivots", "fp", "counts", "n") for end in "uv"))
        left = materialise(pairs.join(a, "u").join(b, "v").where(near).select("u", "v"), "pairs")
        ends = materialise(left.select(F.col("u").alias("node")).union(left.select("v")).distinct(), "ends")
        sets = self._sets(ends)
        free(pairs.sparkSession)
        both = left.join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v")
        shared = F.size(F.array_intersect("su", "sv"))
        found = materialise(both.where(shared * (1 + self.similarity) >= self.similarity * (F.size("su") + F.size("sv")) - 1e-9).select("u", "v"), "links")
        drop(left, ends)
        return found

    def close(self) -> None:
        drop(self.pivots, *self.sets)


def _best(cells: DataFrame, similarity: float, met: DataFrame | None) -> DataFrame:
    """For each member of a cell the one first member, of any of its cells, that shares most cells with it: (u, v, u < v).

    A cell's first member is the one with the least root and node. Pairs that have met are left out.
    """
    first = materialise(cells.groupBy("cell").agg(F.min(F.struct("root", "node", "n", "at")).alias("x")).select("cell", "x.*"), "first-members")
    pairs = cells.alias("a").join(first.alias("b"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.root") != F.col("b.root")) & _may_link(similarity))
    counts = pairs.groupBy(F.col("a.node").alias("node"), F.col("b.node").alias("other")).agg(F.count("*").alias("count"))
    if met is not None:
        counts = counts.join(met, (F.least("node", "other") == met.u) & (F.greatest("node", "other") == met.v), "left_anti")
    best = counts.groupBy("node").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
    found = materialise(best.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct(), "best")
    drop(first)
    return found


def similar_documents(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links) of every row of docs that has a doc_id.

    Two documents link where the Jaccard similarity of their sets of word shingles (as 64-bit hashes) is that or more. A text
    with fewer words than a shingle is one shingle; texts without words are alike. doc_id is an integer; rows of one doc_id should have one text.
    Each set is ordered by the shingles' hashes, common shingles last. Of two sets of that similarity the first places, n -
    ceil(similarity * n) + 1 of them, have a shingle in common, whatever the order, so each such shingle is a cell, and cells
    propose all pairs. Pairs link by their fingerprints (`wide`): what the pivot distance tables leave must differ in no more
    bits than `limits` has for its size, which linked sets exceed with a chance under LOST. Survivors are verified by their
    whole sets.

    Only pairs of documents that aren't in one component yet matter. So each member first meets the one of its cells' first
    members that shares most cells with it, ROUNDS times over, which joins the copies of a text; then all pairs of a cell
    that are still apart meet.
    """
    small_batches(spark)
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    common = spark.sparkContext.broadcast(_common(docs, words))  # at most SAMPLE documents' shingles over COMMON

    @F.arrow_udf("struct<same: binary, n: int, first: array<long>, pivots: binary, fp: binary, counts: binary>")
    def run(texts: pa.Array) -> pa.Array:
        claim("simhash", forget)
        same, sizes, firsts, pivots, fps, counts = [], [], [], [], [], []
        for t in texts.to_pylist():
            found = shingles(t, words)
            n = len(found)
            fp = wide(found)
            same.append(hashlib.sha256(found.tobytes()).digest()), sizes.append(n)
            pivots.append(distances(fp).tobytes()), fps.append(fp.tobytes()), counts.append(table(found))
            last = np.isin(found, common.value, assume_unique=True)
            firsts.append(np.concatenate([found[~last], found[last]])[: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64))
        columns = [pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in (pivots, fps, counts))]
        return pa.StructArray.from_arrays(columns, ["same", "n", "first", "pivots", "fp", "counts"])

    every = materialise(docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*"), "prefixes")
    # Equal sets are one node.
    firsts = materialise(every.groupBy("same").agg(F.min("doc_id").alias("node")), "firsts")
    own = materialise(every.select("doc_id", "same").join(firsts, "same").select("doc_id", "node").distinct(), "copies")
    nodes = every.join(firsts.select("node"), F.col("doc_id") == F.col("node"), "left_semi").dropDuplicates(["doc_id"])
    pivots = every.select(F.col("doc_id").alias("node"), "n", "pivots", "fp", "counts").dropDuplicates(["node"])
    cells = nodes.select(F.col("doc_id").alias("node"), "n", F.posexplode("first").alias("at", "cell")).select("cell", "node", "n", "at")
    cells = cells.repartitionByRange("cell", "node").sortWithinPartitions("cell", "node").mapInArrow(_shared, "cell long, node long, n int, at int")
    cells = materialise(cells, "cells").withColumn("root", F.col("node"))
    pivots = materialise(pivots.join(cells.select("node").distinct(), "node", "left_semi"), "pivots")
    drop(every, firsts)
    free(spark)
    verifier = _Verifier(docs, pivots, words, similarity)
    links = met = None
    for i in range(ROUNDS + 1):
        if i < ROUNDS:
            pairs = _best(cells, similarity, met)
        else:
            apart_ = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & _may_link(similarity)
            pairs = cells.alias("a").join(cells.alias("b"), (F.col("a.cell") == F.col("b.cell")) & apart_).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
            pairs = materialise(pairs if met is None else pairs.join(met, ["u", "v"], "left_anti"), "open-pairs")
        found = verifier.links(pairs)
        links = found if links is None else links.unionByName(found)
        met = pairs if met is None else met.unionByName(pairs)
        roots = components(links)
        if i == ROUNDS:
            break
        named = cells.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = materialise(named, "named")
        open_ = materialise(named.groupBy("cell").agg(F.min("root").alias("l"), F.max("root").alias("g")).where("l < g").select("cell"), "open")
        old, cells = cells, materialise(named.join(open_, "cell").select("cell", "node", "n", "at", "root"), "cells")
        drop(old, named, open_)
        if cells.isEmpty():
            break
    verifier.close()
    drop(cells)
    named = materialise(own.join(roots, own.node == roots.node, "left").select("doc_id", F.coalesce("root", own.node).alias("component_id")), "components")
    drop(own, links, met)
    return named
