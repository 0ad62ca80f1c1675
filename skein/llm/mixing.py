"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the budget by its weight; a source whose share
exceeds ``cap`` times its size is clamped there, and the excess goes to the
others by weight until no share is above.  A source's target is met by whole
repetitions of all its documents, plus one more repetition of the documents
that come first in a seeded order; the document at which the target is reached
is taken in part, so a source's words sum to its rounded target.

Only one row for each source is ever joined to the documents.  The document at
which a source's target is reached is found in two steps: sums over the top
bits of the order (aggregated before the shuffle), then a running sum inside
the one cell that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dropped, written
from .text import likely, table, word_count

#: Cells of the seeded order within each source.
CELLS = 4096


def cyclic_weights(sources: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """``sources`` (a row each) with weights that repeat by code point, null last; numbered in sorted ranges, one after another."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    place = F.monotonically_increasing_id()
    ranged = written(ranged.withColumns({"_mix_part": F.shiftright(place, 33).cast("int"), "_mix_nth": place.bitwiseAND((1 << 33) - 1)}), "mixing-ranges")
    # a row for each partition
    held = ranged.groupBy("_mix_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_mix_part").collect()
    before, upto = {}, 0
    for r in held:
        before[r["_mix_part"]] = upto
        upto += r["n"]
    starts = sources.sparkSession.createDataFrame([(p, n) for p, n in before.items()], "_mix_part int, _mix_before long")
    at = (F.col("_mix_before") + F.col("_mix_nth")) % len(weights) + 1
    out = ranged.join(F.broadcast(starts), "_mix_part")
    return out.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at.cast("int"))).select(*sources.columns, "weight")


def water_fill(sources: DataFrame, budget: float, cap: float = 3.0) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    A source of size or weight 0 (or null) gets 0.  If all sources are
    clamped, the rest of the budget is not given out.
    """
    full, weight = F.col("source_size") * F.lit(float(cap)), F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    level, clamped = None, F.lit(False)
    while True:
        # a source that is clamped at one level stays so at the higher levels that follow
        clamped = F.lit(False) if level is None else weight * F.lit(level) > full
        got = sources.agg(F.sum(F.when(clamped, full)).alias("given"), F.sum(F.when(~clamped, weight)).alias("weights"), F.sum(clamped.cast("long")).alias("n")).first()
        if not got["weights"]:
            break
        now = max(0.0, budget - (got["given"] or 0.0)) / got["weights"]
        if level is not None and now <= level:
            break
        level = now
    return sources.withColumn("target", F.lit(0.0) if level is None else F.least(full, weight * F.lit(level)))


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, budget: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The documents with ``size`` and ``place`` (of the seeded order), and a row for each source that says what is taken.

    ``budget`` is the sum of all sizes if not given.
    """
    spark = docs.sparkSession
    # the order depends on the content alone, so that reruns agree; equal rows tie and share
    placed = docs.withColumns({"_mix_size": word_count(F.col("text")), "_mix_place": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)})
    narrow = written(placed.select("source", "_mix_size", "_mix_place"), "mixing-sizes")
    totals = written(cyclic_weights(narrow.groupBy("source").agg(F.sum("_mix_size").alias("source_size")), weights), "mixing-sources")
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size"))).otherwise(0).cast("long")
    filled = water_fill(totals, float(total) if budget is None else budget, cap).withColumns({"_mix_whole": whole})
    filled = filled.withColumn("_mix_rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("_mix_whole") * F.col("source_size"))

    cell = F.shiftright("_mix_place", 63 - (CELLS - 1).bit_length()).cast("int")
    order = Window.partitionBy("source").orderBy("_mix_cell")
    cells = narrow.withColumn("_mix_cell", cell).groupBy("source", "_mix_cell").agg(F.sum("_mix_size").alias("_mix_sum")).withColumn("_mix_upto", F.sum("_mix_sum").over(order))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    hit = cells.join(filled, same(cells, filled)).where((F.col("_mix_rest") > 0) & (F.col("_mix_upto") >= F.col("_mix_rest")) & (F.col("_mix_upto") - F.col("_mix_sum") < F.col("_mix_rest")))
    hit = written(hit.select(filled["source"], "_mix_cell", (F.col("_mix_rest") - F.col("_mix_upto") + F.col("_mix_sum")).alias("_mix_left")), "mixing-cells")
    # one cell of each source is opened
    inside, _ = likely(narrow.withColumn("_mix_cell", cell), ["source", "_mix_cell"], hit, ["source", "_mix_cell"])
    inside = inside.join(hit, same(inside, hit) & (inside["_mix_cell"] == hit["_mix_cell"])).select(inside["source"], "_mix_place", "_mix_size", "_mix_left")
    inside = inside.groupBy("source", "_mix_place", "_mix_left").agg(F.sum("_mix_size").alias("_mix_size"), F.count(F.lit(1)).alias("_mix_n"))
    upto = F.sum("_mix_size").over(Window.partitionBy("source").orderBy("_mix_place"))
    last = inside.withColumn("_mix_upto", upto).where((F.col("_mix_upto") >= F.col("_mix_left")) & (F.col("_mix_upto") - F.col("_mix_size") < F.col("_mix_left")))
    last = last.select("source", F.col("_mix_place").alias("_mix_last"), F.expr("(_mix_left - _mix_upto + _mix_size) div _mix_n").alias("_mix_part"))
    plan = filled.join(last, same(filled, last), "left").select(filled["source"].alias("_mix_source"), "source_size", "target", "_mix_whole", F.when(F.col("_mix_rest") > 0, F.col("_mix_last")).alias("_mix_last"), "_mix_part")
    plan = written(plan, "mixing-plan")
    dropped(narrow, totals, hit)
    return placed, plan


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of each row.

    A null text has size 0; null is a source of its own.  Rows that are equal
    in doc_id and text share what is left for them evenly.  Columns of the new
    names are replaced.
    """
    new = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in new]
    placed, sources = plan(docs.select(*kept), **how)
    extra = F.when(F.col("_mix_last").isNull(), 0).when(F.col("_mix_place") == F.col("_mix_last"), F.col("_mix_part")).when(F.col("_mix_place") < F.col("_mix_last"), F.col("_mix_size")).otherwise(0)
    out = placed.join(sources, F.col("source").eqNullSafe(F.col("_mix_source")))
    return out.select(*kept, F.col("_mix_size").alias("size"), "source_size", "target", (F.col("_mix_size") * F.col("_mix_whole") + extra).cast("long").alias("taken"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole texts only.

    The document at which a source's target is reached is taken once more if
    at least half of its words are wanted, so a source's words come within
    half a document of its target (of each of several equal ones).
    """
    columns = docs.columns
    out = mixed(docs.select(*columns), **how)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return out.withColumn("_mix_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select(*columns)


def result(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources meet their targets."""
    return repeated(docs)
