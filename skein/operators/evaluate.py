"""Quality and speed of searches: recall, distance ratio, sweeps, operating points, a scaling model."""

from __future__ import annotations

import contextlib
import math
import resource
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hits, queries, recall in percent of k neighbours for each query of ``truth``."""
    t = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    hits = t.join(found.where(F.col("rank") <= k).select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    n = t.agg(F.countDistinct("query_id").alias("queries"))
    both = hits.join(F.broadcast(n), F.lit(True))
    return both.withColumn("recall", F.when(F.col("queries") > 0, 100.0 * F.col("hits") / (F.col("queries") * k)).otherwise(0.0))


def recall_by_query(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, recall)."""
    t = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    f = found.where(F.col("rank") <= k).select("query_id", "vec_id").distinct().withColumn("_hit", F.lit(1))
    got = t.join(f, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("_hit").alias("hits"))
    return got.withColumn("recall", 100.0 * F.col("hits") / k)


def distance_ratio(found: DataFrame, truth: DataFrame, k: int, tiny: float = 1e-4) -> DataFrame:
    """One row: the mean over queries of the mean ratio of found to true distances (not squared), rank by rank.

    True distances under ``tiny`` are left out; a query without any other counts as 1.
    """
    f = found.where(F.col("rank") <= k).select("query_id", "rank", F.sqrt("dist").alias("_f"))
    t = truth.where(F.col("rank") <= k).select("query_id", "rank", F.sqrt("dist").alias("_t"))
    ratio = F.avg(F.when(F.col("_t") >= tiny, F.col("_f") / F.col("_t")))
    each = t.join(f, ["query_id", "rank"]).groupBy("query_id").agg(F.coalesce(ratio, F.lit(1.0)).alias("_r"))
    return each.agg(F.avg("_r").alias("ratio"))


def distances_to(pairs: DataFrame, queries: DataFrame, base: DataFrame, vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, dist): Euclidean distances (not squared) of given pairs."""
    from ..functions.vectors import l2_sqr

    both = pairs.join(base.select("vec_id", F.col(vector).alias("_x")), "vec_id").join(queries.select("query_id", F.col(vector).alias("_q")), "query_id")
    return both.select("query_id", "vec_id", F.sqrt(l2_sqr(F.col("_x"), F.col("_q"))).alias("dist"))


def averages(rounds: DataFrame, by: list[str]) -> DataFrame:
    """Mean qps and recall over rounds of the same settings."""
    return rounds.groupBy(*by).agg(F.avg("qps").alias("qps"), F.avg("recall").alias("recall"))


def beam_sizes(k: int) -> Iterator[int]:
    """10, 15, 20, 25, 30, 40 and on to 80, times 10 for each digit of k beyond the second, without end."""
    # The steps of a decade.
    steps = (10, 15, 20, 25, 30, 40, 50, 60, 70, 80)
    scale = 10 ** max(0, len(str(max(1, k))) - 2)
    while True:
        for s in steps:
            yield s * scale
        scale *= 10


def timed(run: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """A result, evaluated and kept in memory, and the seconds it took."""
    start = time.perf_counter()
    out = run().persist()
    out.count()
    return out, time.perf_counter() - start


class Stages:
    """Seconds by stage: ``with stages("probe"): ...``; a stage inside another is named after both and counts in both.

    Spark works when a result is asked for, so a stage counts what is evaluated in it.
    """

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.calls: dict[str, int] = {}
        self._open: list[str] = []

    @contextlib.contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        self._open.append(name)
        at, start = "/".join(self._open), time.perf_counter()
        try:
            yield
        finally:
            self._open.pop()
            self.seconds[at] = self.seconds.get(at, 0.0) + time.perf_counter() - start
            self.calls[at] = self.calls.get(at, 0) + 1

    def report(self, spark: SparkSession) -> DataFrame:
        """(stage, calls, seconds), in the order in which stages first ended."""
        return spark.createDataFrame([(s, self.calls[s], t) for s, t in self.seconds.items()], "stage string, calls long, seconds double")


def memory(spark: SparkSession) -> DataFrame:
    """(process, storage_limit, storage_used, peak_resident): bytes of each block manager, and the peak of this Python driver."""
    held = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    rows, each = [], held.iterator()
    while each.hasNext():
        entry = each.next()
        rows.append((entry._1(), entry._2()._1(), entry._2()._1() - entry._2()._2(), None))
    rows.append(("python", None, None, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024))
    return spark.createDataFrame(rows, "process string, storage_limit long, storage_used long, peak_resident long")


def callback_rounds(spark: SparkSession, queries: int, answers: int, k: int, rounds: int = 3, seed: int = 1) -> DataFrame:
    """(round, ms): how long the k best of made-up answers (query_id, vec_id, dist) take to be found and counted.

    A test of merging alone; distances come from a hash, so each round has the same rows.
    """
    from .search import top

    out = []
    for r in range(rounds):
        made = spark.range(queries * answers).selectExpr(f"id div {int(answers)} as query_id", f"id % {int(answers)} as vec_id", f"shiftrightunsigned(xxhash64({int(seed)}, id), 11) / {float(1 << 53)}D as dist")
        start = time.perf_counter()
        top(made, k, ["query_id"], ["dist", "vec_id"]).agg(F.count(F.lit(1)), F.sum("dist")).first()
        out.append((r, (time.perf_counter() - start) * 1000))
    return spark.createDataFrame(out, "round int, ms double")


def sweep(search: Callable[[int], DataFrame], truth: DataFrame, queries: int, k: int, sizes: Iterable[int] | None = None, enough: float = 99.8, gain: float = 0.05, slow: float = 10.0) -> list[dict]:
    """Runs ``search`` with growing beam sizes until recall is ``enough``, gains less than ``gain``, or falls under ``slow`` queries a second."""
    out: list[dict] = []
    for size in beam_sizes(k) if sizes is None else sizes:
        found, seconds = timed(lambda size=size: search(size))
        got = recall(found, truth, k).first()["recall"]
        found.unpersist()
        out.append({"ef": size, "qps": queries / seconds, "recall": got})
        if got > enough or (len(out) > 1 and got - out[-2]["recall"] < gain) or out[-1]["qps"] < slow:
            break
    return out


def operating_points(measured: DataFrame, ticks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., tick, qps, recall): for each tick the measured point of nearest recall, ties to the lower recall."""
    each = measured.join(F.broadcast(ticks), F.lit(True)).groupBy(*by, "tick").agg(F.min(F.struct(F.abs(F.col("recall") - F.col("tick")).alias("d"), F.col("recall"), F.col("qps"))).alias("_b"))
    return each.select(*by, "tick", F.col("_b.qps").alias("qps"), F.col("_b.recall").alias("recall"))


def speedups(points: DataFrame, system: str) -> DataFrame:
    """(dataset, tick, other, speedup): how many times the queries a second of every other system ``system`` reaches."""
    own = points.where(F.col("system") == system).select("dataset", "tick", F.col("qps").alias("_own"))
    return points.where(F.col("system") != system).join(own, ["dataset", "tick"]).select("dataset", "tick", F.col("system").alias("other"), (F.col("_own") / F.col("qps")).alias("speedup"))


def per_watt(points: DataFrame, watts: DataFrame) -> DataFrame:
    """Points with qps_per_watt; ``watts`` has (system, watts)."""
    return points.join(F.broadcast(watts), "system").withColumn("qps_per_watt", F.col("qps") / F.col("watts"))


def scaling(spark: SparkSession, nodes: Iterable[int], queries: int, compute_ms: float, bytes_out: int, bytes_in: int = 0, latency_ms: float = 0.02, gbit: float = 10.0, overhead_ms: float = 0.0, spread: float = 0.1, seed: int = 1) -> DataFrame:
    """(nodes, qps): a model of query-parallel search on several machines.

    A query costs an overhead, compute time with a normal spread for
    imbalance (0 at least) and, with several machines, the transfer of the
    query and of its answer, a latency each and their bytes; nodes work side
    by side.  The spread comes from a hash of the query's number, so it is the
    same however the rows are dealt.
    """
    network = 2 * latency_ms + (bytes_in + bytes_out) * 8 / (gbit * 1e6)
    sized = spark.createDataFrame([(int(n),) for n in nodes], "nodes int").withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(int(queries)))))
    even = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "nodes", "q"), 11) + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.log(even(0))) * F.cos(2 * math.pi * even(1))
    cost = F.lit(overhead_ms) + F.lit(network) * (F.col("nodes") > 1).cast("int") + F.lit(compute_ms) * F.greatest(F.lit(0.0), 1 + normal * spread)
    return sized.withColumn("ms", cost).groupBy("nodes").agg((F.lit(1000.0) * F.first("nodes") / F.avg("ms")).alias("qps"))
