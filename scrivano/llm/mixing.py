"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

The sources, in the order of their code points with null last, take shares of the whole in proportion to their weights; a
source stops at `most` times its own size and its excess goes to the others by weight.

Inside a source long documents are preferred: a document's expected copies grow with the digits of its size in the binary
system (its class), and stop at `most`. So the inclusion probabilities are unequal: of e expected copies floor(e) are
certain, and the rest p = e - floor(e) is sampled: documents are ranked by the odds of a random number over the odds of
their own p (Pareto's order), and taken from the lowest rank while they fit into what the target leaves. One more document,
that which comes nearest to the gap, closes it.

The random number is a digest of doc_id and text, so reruns agree, and equal rows rank alike and are taken together. No
source is ordered in one task: sums over SLICES slices of the ranks find the slice where the target is met, and only its
documents are ordered. Only the table of sources (a row each) passes through single tasks.

Null texts and texts without words have size 0 and are never taken. A null source is a source; a null doc_id counts as
empty. Other columns pass through `copies`. An empty table gives an empty plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivano.llm.store import drop, materialise

WEIGHTS, FACTOR, MOST, SEED, SLICES = (3.0, 1.0, 2.0), 1.5, 2.0, 7, 4096
#: Probabilities this near to 0 or 1 are rounding errors.
EXACT = 1e-9


def sizes(text: Column) -> Column:
    """Words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def classes(size: Column) -> Column:
    """Binary digits of a size."""
    return F.length(F.bin(size))


def odds(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Odds of a random number in (0, 1) that depends on the row alone: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) * 2.0**-52
    return u / (1 - u)


def _filled(total: Column, weight: Column, most: Column, by: Sequence[str], order: Sequence[Column]) -> Column:
    """What each row of a group gets of the total by weight, where none gets more than `most` and the excess is reshared."""
    room = most / weight
    whole = Window.partitionBy(*by)
    ordered = whole.orderBy(room, *order)
    full = F.coalesce(F.sum(most).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(weight).over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (total - full) / left
    # The level: what each unit of weight gets once all rows with less room are full.
    return F.least(most, F.max(F.when(level <= room, level)).over(whole) * weight)


def targets(docs: DataFrame, weights: Sequence[float] = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """source, source_size and target from docs (source, size); one row a source."""
    name = F.col("source").asc_nulls_last()
    found = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(name)) - 1) % len(weights) + 1).cast("int")))
    found = found.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * factor)
    return found.select("source", "source_size", _filled(F.col("total"), F.col("weight"), F.col("source_size") * most, [], [name]).alias("target"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """What each class of each source takes, from docs (source, size, odds).

    The table has source, class (null in the row of sources without words), wordless (the row beside which the source's
    documents without words stand), source_size, target, certain (copies of each
    document), share (the odds of p; null: none is sampled), and of the source last (the highest rank taken; null: none),
    below (all under that rank are taken), closing (the rank of the document that closes the gap) and sampled (all are taken).
    """
    own = docs.where("size > 0").withColumn("class", classes(F.col("size")))
    goal = materialise(targets(docs, weights, factor, most), "targets")
    kinds = own.groupBy(F.col("source").alias("s"), "class").agg(F.sum("size").alias("words"))
    kinds = kinds.join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("e", _filled(F.col("target"), F.col("class") * F.col("words"), F.col("words") * most, ["s"], [F.col("class")]) / F.col("words"))
    kinds = kinds.withColumn("certain", F.floor(F.col("e") + EXACT)).withColumn("p", F.col("e") - F.col("certain")).withColumn("p", F.when(F.col("p") > EXACT, F.col("p")))
    kinds = kinds.withColumn("rest", F.coalesce(F.sum(F.col("p") * F.col("words")).over(Window.partitionBy("s")), F.lit(0.0)))
    kinds = materialise(kinds.select("s", "class", "certain", (F.col("p") / (1 - F.col("p"))).alias("share"), "rest"), "classes")
    drawn = own.join(kinds.where("share is not null").withColumnRenamed("class", "c"), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    drawn = drawn.select("source", "size", "rest", (F.col("odds") / F.col("share")).alias("rank"))
    drawn = drawn.withColumn("slice", F.floor(F.col("rank") / (1 + F.col("rank")) * SLICES))
    slices = drawn.groupBy("source", "slice", "rest").agg(F.sum("size").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The slice where the rest is met; where sums of doubles leave it just unmet, the whole source goes.
    met = slices.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("own") > F.col("rest"))).select(F.col("source").alias("s"), F.col("slice").alias("at"), "before")
    met = materialise(met, "slices")
    edge = drawn.join(met, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("at")))
    edge = edge.withColumn("run", F.col("before") + F.sum("size").over(Window.partitionBy("source", "slice").orderBy("rank")))
    inside = F.col("run") <= F.col("rest")
    cut = edge.groupBy("source").agg(F.max(F.when(inside, F.col("rank"))).alias("last"), F.max(F.when(inside, F.col("run"))).alias("words"), F.min("rank").alias("least"), F.min("before").alias("before"), F.min("rest").alias("rest"))
    # Nothing of the slice fits: everything below its lowest rank is taken.
    cut = materialise(cut.select(F.col("source").alias("s"), "last", F.when(F.col("last").isNull(), F.col("least")).alias("below"), (F.col("rest") - F.coalesce("words", "before")).alias("gap")), "cuts")
    others = drawn.join(cut, F.col("source").eqNullSafe(F.col("s"))).where((F.col("rank") > F.col("last")) | (F.col("rank") >= F.col("below"))).withColumn("off", F.abs(F.col("size") - F.col("gap"))).where(F.col("off") < F.col("gap"))
    closing = others.groupBy("source").agg(F.min(F.struct("off", "rank")).alias("best")).select(F.col("source").alias("c"), F.col("best.rank").alias("closing"))
    goal_ = goal.join(cut.drop("gap"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").join(closing, F.col("source").eqNullSafe(F.col("c")), "left").drop("c")
    found = goal_.join(kinds, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    found = found.withColumn("wordless", F.row_number().over(Window.partitionBy("source").orderBy("class")) == 1)
    found = materialise(found.withColumn("sampled", F.col("last").isNull() & F.col("below").isNull()).drop("rest"), "plan")
    drop(goal, kinds, met, cut)
    return found


def _taken(odds_: Column) -> Column:
    """How many copies the mix takes of a document, beside its class's row of the plan."""
    rank = F.try_divide(odds_, F.col("share"))  # null where nothing is sampled
    extra = F.coalesce((rank <= F.col("last")) | F.lit(False), F.lit(False)) | F.coalesce(rank < F.col("below"), F.lit(False)) | F.coalesce(rank == F.col("closing"), F.lit(False)) | (F.col("sampled") & rank.isNotNull())
    return F.coalesce(F.col("certain") + extra.cast("int"), F.lit(0)).cast("long")


def _beside(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """docs (with _source and _size) beside their rows of the plan."""
    goal = goal.withColumnsRenamed({"source": "s", "class": "c"})
    own = F.when(F.col("size") > 0, F.col("c") == classes(F.col("size"))).otherwise(F.col("wordless"))
    return docs.join(goal, F.col("source").eqNullSafe(F.col("s")) & own).drop("s", "c", "wordless")


def copies(docs: DataFrame, doc_id: Column, text: Column, source: Column, **options) -> DataFrame:
    """docs of one column (a struct of the row) with `copies`, how often the mix takes the row."""
    given = docs.columns[0]
    own = docs.select(given, source.alias("source"), sizes(text).alias("size"), odds(doc_id, text).alias("odds"))
    measured = materialise(own.select("source", "size", "odds"), "sizes")
    goal = plan(measured, **options)
    drop(measured)
    return _beside(own, goal).select(given, F.when(F.col("size") > 0, _taken(F.col("odds"))).otherwise(0).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, copies counted) and copies of every row of docs (doc_id, text, source)."""
    own = materialise(docs.select("doc_id", "source", sizes(F.col("text")).alias("size"), odds(F.col("doc_id"), F.col("text")).alias("odds")), "sizes")
    found = _beside(own, plan(own.select("source", "size", "odds"), **options)).withColumn("copies", F.when(F.col("size") > 0, _taken(F.col("odds"))).otherwise(0))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
