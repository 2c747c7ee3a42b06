"""Exact top-k inner products with vector-approximation files.

Components are floor(scale * x). Vectors lie in blocks of approximations: a byte for each component that names one of 256
cells of the component's range in the block. Query blocks meet candidate blocks. The scan reads only the cells and bounds
each score from both sides; a task carries the k-th best lower bound of each query from block to block, and what has its
upper bound below is out. The k-th lower bound over all tasks puts out more. Of the rest exact vectors are read in the order
of their bounds, in two steps: the k with the best bounds of each query, whose k-th exact score is a sharper limit, and then
those that this limit leaves, after which the result is certain. All scores are exact integers; ties go to the smaller vec_id.

Null vectors and those with null or non-finite components take no part, neither do pairs of different lengths. A score
beyond 64 bits is held at the largest or smallest long. Rows that repeat a vec_id are candidates each, but never of a query
of the same vec_id; equal query rows count once, different vectors of one query vec_id are ranked apart. Empty vectors
score 0. Null vec_ids take no part. vec_id is an integer; other columns are left out. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivano.llm.store import claim, drop, materialise, small_batches

#: Vectors in a candidate block and in a query block, and cells of a component.
BLOCK, QUERIES, CELLS = 4096, 256, 256
#: Groups of candidate blocks, each of which gets a copy of the query blocks: this many at least, and no less than the root
#: of the number of blocks.
TASKS = 64
CANDIDATES = "dims int, block long, ids binary, marks binary, low binary, width binary, cells binary"
QUERY_BLOCKS = "dims int, q_block long, q_ids binary, q_marks binary, q binary"
SURVIVORS = "query_id long, q_mark long, vec_id long, mark long, lower double, upper double"


def _arrays(rows: list[tuple], scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vec_ids, marks and exact components of rows (vec_id, mark, vector)."""
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.floor(scale * np.array([r[2] for r in rows], np.float64).reshape(len(rows), -1))


def _blocks(vectors: DataFrame, scale: float, size: int, schema: str, pack) -> DataFrame:
    """Packs (vec_id, mark, embedding) into blocks of up to `size` vectors of one length."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("topk")
        held: dict[int, list] = {}

        def out(rows: list) -> pa.RecordBatch:
            ids, marks, exact = _arrays(rows, scale)
            # The number of a block is a hash of what it holds, so that a task run anew makes the same.
            number = int((ids * 0x9E3779B1 ^ marks).sum() % (1 << 40))
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((exact.shape[1], number, ids.tobytes(), marks.tobytes(), *pack(exact)), kinds)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows = held.setdefault(len(row[2]), [])
                rows.append(row)
                if len(rows) == size:
                    yield out(held.pop(len(row[2])))
        for rows in held.values():
            yield out(rows)

    return vectors.mapInArrow(run, schema)


def approximate(exact: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The lowest value and the width of a cell of each component, and every vector's cells."""
    low = exact.min(0) if exact.size else np.zeros(exact.shape[1])
    width = np.maximum((exact.max(0) - low if exact.size else low) / CELLS, 1e-300)
    return low.tobytes(), width.tobytes(), np.minimum((exact - low) / width, CELLS - 1).astype(np.uint8).tobytes()


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries (rows) and candidates (columns), from the cells alone.

    Where scores may be too large for exact doubles nothing is bounded.
    """
    dims = q.shape[1]
    top = max(np.abs(low).max(initial=0), np.abs(low + CELLS * width).max(initial=0))
    most = np.abs(q).max(initial=0)
    if dims and most * top * dims >= 2**52:
        whole = np.full((len(q), len(cells)), np.inf)
        return -whole, whole
    middle = (q * width) @ (cells.T.astype(np.float64) + 0.5) + (q @ low)[:, None]
    slack = (np.abs(q) @ width / 2 + 1e-9 * dims * most * top + 1e-6)[:, None]
    return middle - slack, middle + slack


class _Survivors:
    """What may still be among the k best of each query of a block, over the candidate blocks met so far."""

    def __init__(self, q_ids: np.ndarray, q_marks: np.ndarray, k: int):
        self.q_ids, self.q_marks, self.k = q_ids, q_marks, k
        self.kth = np.full(len(q_ids), -np.inf)
        self.held = [[np.array([]), np.array([]), np.array([], np.int64), np.array([], np.int64)] for _ in q_ids]

    def meet(self, ids: np.ndarray, marks: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        for i, own in enumerate(self.q_ids.tolist()):
            at = np.flatnonzero((upper[i] >= self.kth[i]) & (ids != own))
            if not len(at):
                continue
            held = [np.concatenate(x) for x in zip(self.held[i], (lower[i][at], upper[i][at], ids[at], marks[at]))]
            if len(held[0]) >= self.k:
                self.kth[i] = np.partition(held[0], len(held[0]) - self.k)[len(held[0]) - self.k]
                stay = held[1] >= self.kth[i]
                held = [x[stay] for x in held]
            self.held[i] = held

    def batch(self) -> pa.RecordBatch:
        sizes = [len(h[0]) for h in self.held]
        lower, upper, ids, marks = (np.concatenate([h[j] for h in self.held]) for j in range(4))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(self.q_ids, sizes), np.repeat(self.q_marks, sizes), ids, marks, lower, upper)], names=[x.split()[0] for x in SURVIVORS.split(", ")])


def _scan(k: int):
    """Rows of a query block beside candidate blocks, one query block after the other, to what survives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("topk")
        seen, state, q = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if (key := (r["dims"], r["q_block"], r["q_ids"])) != seen:
                    if state:
                        yield state.batch()
                    seen, state = key, _Survivors(np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_marks"], np.int64), k)
                    q = np.frombuffer(r["q"], np.float64).reshape(len(state.q_ids), r["dims"])
                ids = np.frombuffer(r["ids"], np.int64)
                cells = np.frombuffer(r["cells"], np.uint8).reshape(len(ids), r["dims"])
                state.meet(ids, np.frombuffer(r["marks"], np.int64), *bounds(q, np.frombuffer(r["low"], np.float64), np.frombuffer(r["width"], np.float64), cells))
        if state:
            yield state.batch()

    return run


def _exact(scale: float):
    @F.arrow_udf("long")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        """Inner products; where doubles may not be exact, in whole numbers of any size, held at the ends of 64 bits."""
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = np.floor(scale * np.array(x, np.float64)), np.floor(scale * np.array(y, np.float64))
            if np.abs(x) @ np.abs(y) < 2**52:
                out.append(int(x @ y))
            else:
                out.append(min(max(sum(int(i) * int(j) for i, j in zip(x, y)), -(1 << 63)), (1 << 63) - 1))
        return pa.array(out, pa.int64())

    return run


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row of vectors (vec_id, embedding) that is_query."""
    small_batches(spark)
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    embedding = F.col("embedding").cast("array<double>")
    # The mark tells apart the vectors of one vec_id.
    vectors = vectors.select("vec_id", F.xxhash64(embedding).alias("mark"), embedding.alias("embedding")).where(fine)
    candidates = materialise(_blocks(vectors, scale, BLOCK, CANDIDATES, approximate), "candidates")
    asked = vectors.where(is_query).distinct()
    queries = materialise(_blocks(asked, scale, QUERIES, QUERY_BLOCKS, lambda exact: (exact.tobytes(),)), "queries")
    count = candidates.count()
    groups = max(1, min(count, TASKS), math.isqrt(count))
    # A stated query set against all rows, in blocks: each group of candidate blocks gets a copy of the query blocks. The
    # query blocks lead, so that a task meets all its candidates with one query block before the next.
    left = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = candidates.withColumn("part", F.pmod(F.xxhash64("block", "ids"), F.lit(groups)))
    pairs = left.repartition(groups, "part").join(right.repartition(groups, "part").hint("merge"), ["part", "dims"])
    found = materialise(pairs.drop("part", "block").mapInArrow(_scan(k), SURVIVORS), "survivors")
    drop(candidates, queries)
    query = ["query_id", "q_mark"]
    best = Window.partitionBy(*query)
    limits = found.withColumn("n", F.row_number().over(best.orderBy(F.col("lower").desc()))).where(F.col("n") <= k)
    limits = limits.groupBy(*query).agg(F.when(F.count("*") == k, F.min("lower")).otherwise(float("-inf")).alias("limit"))
    left_over = found.join(limits, query).where("upper >= limit").select(*query, "vec_id", "mark", "upper").distinct()
    left_over = materialise(left_over.withColumn("n", F.row_number().over(best.orderBy(F.col("upper").desc(), "vec_id", "mark"))), "left-over")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("mark").alias("q_mark"), F.col("embedding").alias("q"))

    def read(rows: DataFrame) -> DataFrame:
        """The exact scores of the rows, from the vectors themselves."""
        both = rows.join(vectors, ["vec_id", "mark"]).join(asked, query)
        return both.select(*query, "vec_id", _exact(scale)("q", "embedding").alias("score"))

    first = materialise(read(left_over.where(F.col("n") <= k)), "first-scores")
    limits = first.groupBy(*query).agg(F.when(F.count("*") >= k, F.min("score")).alias("limit"))
    rest = left_over.where(F.col("n") > k).join(limits, query).where(F.col("limit").isNull() | (F.col("upper") >= F.col("limit")))
    by = best.orderBy(F.col("score").desc(), "vec_id")
    scores = materialise(first.unionByName(read(rest)), "scores")
    drop(found, left_over, first)
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
