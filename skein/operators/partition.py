"""Coarse partitioning: centroids, assignment, size capping and cluster statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.vectors import doubles
from ..scratch import dropped, written


def mean_vectors(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by..., mean): the mean of each group by component, partially aggregated before the shuffle; null vectors don't count."""
    parts = rows.select(*by, F.posexplode(doubles(F.col(vector))).alias("_pos", "_x")).groupBy(*by, "_pos").agg(F.avg("_x").alias("_m"))
    item = F.struct("_pos", "_m")
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["_m"]).alias("mean"))


def centroids_of(rows: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """(cluster_id, centroid) of given clusters."""
    return mean_vectors(rows, [cluster], vector).select(F.col(cluster).alias("cluster_id"), F.col("mean").alias("centroid"))


class Centers:
    """Centroids on the driver, in the order of their ids: at most ``limit`` (the number of clusters is a parameter, not a size of the data).

    ``diagonal`` is that of the rotation of codes and queries; None is the fixed one.
    """

    diagonal: np.ndarray | None = None

    def __init__(self, table: DataFrame, limit: int = 1 << 16, diagonal: np.ndarray | None = None):
        self.diagonal = diagonal
        rows = table.select("cluster_id", doubles(F.col("centroid")).alias("centroid")).limit(limit + 1).toArrow().to_pandas().sort_values("cluster_id")
        if len(rows) > limit:
            raise ValueError(f"more than {limit} clusters")
        if rows["centroid"].map(len).nunique() > 1:
            raise ValueError("centroids of different dimensions")
        self.ids = rows["cluster_id"].to_numpy(np.int64)
        self.matrix = np.stack(rows["centroid"]) if len(rows) else np.zeros((0, 0))


def probes(rows: DataFrame, centroids: DataFrame | Centers, nprobe: int, key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(key, rank, cluster_id, dist): the ``nprobe`` centroids nearest to each row by squared distance, ties to smaller ids.

    With fewer centroids all are returned.  Rows with a null vector give none.
    The centroids are sent to the executors, so nothing is shuffled.
    """
    centers = centroids if isinstance(centroids, Centers) else Centers(centroids)
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for df in batches:
            if not len(df) or not len(c.ids):
                continue
            ids, dist = kernels.nearest(np.stack(df["x"]), c.matrix, c.ids, nprobe)
            k = ids.shape[1]
            yield pd.DataFrame({"k": np.repeat(df["k"].to_numpy(), k), "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), len(df)), "cluster_id": ids.ravel(), "dist": dist.ravel()})

    out = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), doubles(F.col(vector)).alias("x"))
    return out.mapInPandas(find, "k long, rank int, cluster_id long, dist double").withColumnRenamed("k", key)


def assigned(rows: DataFrame, centroids: DataFrame | Centers, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster_id, dist): the nearest centroid of each row and the distance to it (not squared)."""
    return probes(rows, centroids, 1, key, vector).select(key, "cluster_id", F.sqrt("dist").alias("dist"))


def kmeans(rows: DataFrame, k: int, vector: str = "embedding", sample: int = 65_536, rounds: int = 10, seed: int = 1) -> DataFrame:
    """(cluster_id, centroid) by Lloyd's rounds, each one distributed pass over all rows.

    The start is ``k`` vectors that come first by a seeded hash, of a sample
    of about ``sample`` rows drawn by the same hash, so nothing else is
    shuffled.  Equal vectors have one hash and are drawn together: if the
    sample has fewer than k different ones, all rows are asked, and if these
    have fewer, there are as many clusters as different vectors.  More
    clusters than ``sample`` are an error.  A cluster that loses all its rows
    keeps its centroid.
    """
    if k > sample:
        raise ValueError(f"{k} clusters of a sample of {sample}")
    rows = rows.where(F.col(vector).isNotNull())
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "cluster_id long, centroid array<double>")
    spread = rows.select(doubles(F.col(vector)).alias("x"), F.xxhash64(F.lit(seed), F.col(vector)).alias("h"))
    for share in (min(1.0, sample / n), 1.0):
        drawn = spread.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share) if share < 1 else spread
        start = drawn.dropDuplicates(["x"]).orderBy("h", "x").limit(k).toArrow().to_pandas()
        if len(start) == k or share == 1:
            break
    centers = Centers.__new__(Centers)
    centers.matrix = np.stack(start["x"])
    centers.ids = np.arange(len(centers.matrix))
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centers)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = shared.value
            sums, counts = np.zeros_like(c.matrix), np.zeros(len(c.ids), np.int64)
            for df in batches:
                if not len(df):
                    continue
                x = np.stack(df["x"])
                near, _ = kernels.nearest(x, c.matrix, c.ids, 1)
                np.add.at(sums, near[:, 0], x)
                counts += np.bincount(near[:, 0], minlength=len(c.ids))
            some = np.flatnonzero(counts)
            # Arrow takes no column without rows for lists, and a part of a large file may have no rows
            if len(some):
                yield pd.DataFrame({"cluster_id": some, "n": counts[some], "s": list(sums[some])})

        # one row for each cluster and task
        got = rows.select(doubles(F.col(vector)).alias("x")).mapInPandas(partial, "cluster_id long, n long, s array<double>")
        got = got.select("cluster_id", "n", F.posexplode("s").alias("pos", "v")).groupBy("cluster_id", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        got = got.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("v") / F.col("n")).alias("m")))), lambda s: s["m"]).alias("mean")).toArrow().to_pandas()
        new = centers.matrix.copy()
        new[got["cluster_id"].to_numpy()] = np.stack(got["mean"])
        moved = float(np.abs(new - centers.matrix).max())
        centers = Centers.__new__(Centers)
        centers.matrix, centers.ids = new, np.arange(len(new))
        if moved < 1e-9:
            break
    return rows.sparkSession.createDataFrame([(int(i), c.tolist()) for i, c in zip(centers.ids, centers.matrix, strict=True)], "cluster_id long, centroid array<double>")


def sizes(assignment: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, n) with 0 for empty clusters."""
    n = assignment.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return centroids.select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


def members(assignment: DataFrame) -> DataFrame:
    """(cluster_id, local_id, vec_id): each vector's place among its cluster's, by id from 0; capped clusters bound a window."""
    return assignment.selectExpr("cluster_id", "row_number() over (partition by cluster_id order by vec_id) - 1 as local_id", "vec_id")


def stats(assignment: DataFrame, centroids: DataFrame, probed: DataFrame | None = None) -> DataFrame:
    """(cluster_id, n, min_dist, max_dist, avg_dist, probes): 0 where a cluster is empty or isn't probed."""
    got = assignment.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"), F.avg("dist").alias("avg_dist"))
    out = centroids.select("cluster_id").join(got, "cluster_id", "left")
    if probed is not None:
        out = out.join(probed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("probes")), "cluster_id", "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    cols = [zero("n", 0), zero("min_dist", 0.0), zero("max_dist", 0.0), zero("avg_dist", 0.0)]
    return out.select("cluster_id", *cols, *([zero("probes", 0)] if probed is not None else []))


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) over equal widths between the least and the largest value above 0; bins without a value are left out."""
    some = values.where(F.col(column) > 0)
    lo, hi = some.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return values.sparkSession.createDataFrame([], "bin long, n long")
    wide = (hi - lo) or 1.0
    place = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(wide) * bins), F.lit(bins - 1)).cast("long")
    return some.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def capped(rows: DataFrame, assignment: DataFrame, centroids: DataFrame, limit: int, rounds: int = 100, near: int = 100, vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster_id, dist, moved) with clusters of at most ``limit`` rows, as far as rounds allow.

    In each round every oversized cluster offers its first rows by id.  Each
    asks for the nearest of its ``near`` centroids that has room, which takes
    the nearest of those that ask, as many as fit.  Where none has room, it asks
    for the smallest, which takes rows until it is half way to the size of the
    one that gives.  The others ask again in the next round.  Only the sizes of
    the clusters come to the driver; if all clusters together are too small for
    the rows, an error is raised.
    """
    spark = rows.sparkSession
    centers = Centers(centroids)
    now = assignment.select("vec_id", "cluster_id", "dist", F.col("cluster_id").alias("home"))
    made: DataFrame | None = None
    for done in range(rounds + 1):
        count = [(int(c), int(n)) for c, n in sizes(now, centroids).toArrow().to_pandas().itertuples(index=False)]
        if (total := sum(n for _, n in count)) > limit * len(count):
            raise ValueError(f"{total} rows do not fit in {len(count)} clusters of {limit}")
        if done == rounds or all(n <= limit for _, n in count):
            break
        # one row for each cluster
        n = F.broadcast(spark.createDataFrame(count, "_c long, _n long"))
        offered = now.join(n.where(F.col("_n") > limit), F.col("cluster_id") == F.col("_c")).selectExpr("vec_id", "cluster_id as _old", "_n as _from", "row_number() over (partition by cluster_id order by vec_id) as _at")
        offered = written(offered.where(F.col("_at") <= F.col("_from") - limit).drop("_at"), "capped-offered")
        to = probes(offered.join(rows.select("vec_id", vector), "vec_id"), centers, near, "vec_id", vector)
        to = to.join(n, F.col("cluster_id") == F.col("_c")).join(offered, "vec_id").where("cluster_id != _old")
        full = F.col("_n") >= limit
        best = F.min(F.struct(full.alias("full"), F.when(full, F.col("_n")).otherwise(F.col("rank").cast("long")).alias("by"), F.col("cluster_id").alias("_to"), F.sqrt("dist").alias("_dist"), "_n", "_from"))
        asked = to.groupBy("vec_id").agg(best.alias("b")).select("vec_id", "b.*")
        room = F.when(F.col("full"), F.floor((F.col("_from") - F.col("_n")) / 2)).otherwise(limit - F.col("_n"))
        turn = F.row_number().over(Window.partitionBy("_to").orderBy("_dist", "vec_id"))
        moves = written(asked.withColumn("_at", turn).where(F.col("_at") <= room).select("vec_id", "_to", "_dist"), "capped-moves")
        if moves.isEmpty():
            dropped(offered, moves)
            break
        now = now.join(moves, "vec_id", "left").select("vec_id", F.coalesce("_to", "cluster_id").alias("cluster_id"), F.coalesce("_dist", "dist").alias("dist"), "home")
        old, made = made, written(now, "capped")
        dropped(offered, moves, *([old] if old is not None else []))
        now = made
    return now.select("vec_id", "cluster_id", "dist", (F.col("cluster_id") != F.col("home")).alias("moved"))
