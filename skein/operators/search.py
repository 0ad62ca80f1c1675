"""Search: exact neighbours, and probing, scoring, reranking over the clustered index."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.vectors import doubles, normalize
from ..scratch import written
from .partition import Centers, probes

NEIGHBORS = "query_id long, rank int, vec_id long, dist double"


def top(rows: DataFrame, k: int, by: list[str], order: list[Column | str], rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes them before and after the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def query_blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries (query_id, x) in blocks of about ``size`` rows on the driver, by a hash of the id."""
    n = queries.count()
    blocks = max(1, -(-n // size))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = part.toArrow().to_pandas().sort_values("query_id")
        if len(got):
            yield got["query_id"].to_numpy(np.int64), np.stack(got["x"])


def exact_knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", block: int = 4096, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, dist): the k nearest rows of ``base`` (vec_id) for each of ``queries`` (query_id), squared Euclidean.

    ``angular`` normalises both sides first.  A block of queries at a time is
    sent to the executors; each task returns its k best for each query, and
    the ranks are taken over those.  Ties go to the smaller id.
    """
    if metric not in ("l2", "angular"):
        raise ValueError(f"unknown metric {metric}")
    spark = base.sparkSession
    shape = normalize if metric == "angular" else doubles
    q = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), shape(F.col(vector)).alias("x"))
    x = base.where(F.col(vector).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), shape(F.col(vector)).alias("x"))
    found = None
    several = q.count() > block
    for ids, matrix in query_blocks(q, block):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            best_i, best_d = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for df in batches:
                if not len(df):
                    continue
                i, d = kernels.nearest(matrix, np.stack(df["x"]), df["vec_id"].to_numpy(np.int64), k)
                i, d = np.concatenate([best_i, i], 1), np.concatenate([best_d, d], 1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_i, best_d = np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1)
            yield pd.DataFrame({"query_id": np.repeat(ids, best_i.shape[1]), "vec_id": best_i.ravel(), "dist": best_d.ravel()})

        part = top(x.mapInPandas(scan, "query_id long, vec_id long, dist double"), k, ["query_id"], ["dist", "vec_id"])
        if several:  # one block's plan and queries at a time
            part = written(part, "exact-knn")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], NEIGHBORS) if found is None else found.select("query_id", "rank", "vec_id", "dist")


def _slots(probed: DataFrame, index: DataFrame, most: int, replicas: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Probes with a slot, and the rows of ``index`` of probed clusters, once for each slot of their cluster.

    A cluster has as many slots as ``replicas`` (cluster_id, replicas) says, or
    one for every ``most`` queries.  The number of slots comes to the driver,
    one row for each probed cluster; their ids become a filter of the index,
    so that a saved one opens the folders of no other cluster.
    """
    slots = F.ceil(F.count(F.lit(1)) / most).cast("int")
    visits = probed.groupBy("cluster_id").agg(slots.alias("slots"))
    if replicas is not None:
        visits = visits.join(replicas, "cluster_id", "left").select("cluster_id", F.greatest(F.coalesce("replicas", F.lit(1)), F.lit(1)).cast("int").alias("slots"))
    held = [(r["cluster_id"], r["slots"]) for r in visits.toArrow().to_pylist()]
    visits = F.broadcast(probed.sparkSession.createDataFrame(held, "cluster_id long, slots int"))
    opened = index.where(F.expr(f"cluster_id in ({','.join(str(c) for c, _ in sorted(held)) or 'null'})"))
    copies = opened.join(visits, "cluster_id").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    return probed.join(visits, "cluster_id").withColumn("slot", F.pmod(F.xxhash64("query_id"), F.col("slots")).cast("int")), copies


def _turn(centroids: DataFrame | Centers) -> Callable[[np.ndarray], np.ndarray]:
    """The rotation of queries: that of the index, if its centres name one."""
    diagonal = centroids.diagonal if isinstance(centroids, Centers) else None
    return lambda x: kernels.rotate(x, diagonal)


def scored(queries: DataFrame, index: DataFrame, centroids: DataFrame | Centers, nprobe: int, post_ef: int, most: int = 4096, vector: str = "embedding", whole: bool = False, replicas: DataFrame | None = None) -> DataFrame:
    """(query_id, cluster_id, vec_id, approx): the ``post_ef`` best scores of each query in each of its clusters, all codes scored.

    Each cluster is one task's work, so clusters must be capped; a cluster
    that many queries probe is copied, and its queries are dealt over the
    copies.  ``whole`` scores in whole numbers (see
    :func:`..functions.kernels.approximate_whole`).
    """
    probed, copies = _slots(written(probes(queries, centroids, nprobe, "query_id", vector), "search-probes"), index.select("cluster_id", "vec_id", "code", "factor"), most, replicas)
    asked = probed.select("query_id", "cluster_id", "slot").join(queries.select("query_id", doubles(F.col(vector)).alias("x")), "query_id")
    turn, judge = _turn(centroids), kernels.approximate_whole if whole else kernels.approximate

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "cluster_id": [], "vec_id": [], "approx": []}
        if len(q) and len(c):
            c = c.sort_values("vec_id")
            ids = c["vec_id"].to_numpy(np.int64)
            turned = turn(np.stack(q["x"]))
            approx = judge(kernels.unpack(list(c["code"]), turned.shape[1]), c["factor"].to_numpy(), turned)
            order = np.argsort(approx, axis=1, kind="stable")[:, :post_ef]
            k = order.shape[1]
            out = {"query_id": np.repeat(q["query_id"].to_numpy(np.int64), k), "cluster_id": int(c["cluster_id"].iloc[0]), "vec_id": ids[order].ravel(), "approx": np.take_along_axis(approx, order, 1).ravel()}
        return pd.DataFrame(out)

    return asked.groupBy("cluster_id", "slot").cogroup(copies.groupBy("cluster_id", "slot")).applyInPandas(score, "query_id long, cluster_id long, vec_id long, approx double")


def beamed(queries: DataFrame, index: DataFrame, base: DataFrame, centroids: DataFrame | Centers, nprobe: int, ef: int, post_ef: int, most: int = 4096, vector: str = "embedding", replicas: DataFrame | None = None) -> DataFrame:
    """Like :func:`scored`, but walks each cluster's graph from its entry point with a beam of ``ef`` nodes.

    A popped node goes into the result with its score, the entry point with
    its exact distance; its neighbours that weren't visited are scored and join
    the beam, so the work of a query grows with ``ef`` and not with the cluster.
    """
    if ef > post_ef and post_ef < 1:
        raise ValueError("post_ef must be at least 1")
    probed, nodes = _slots(written(probes(queries, centroids, nprobe, "query_id", vector), "search-probes"), index, most, replicas)
    asked = probed.select("query_id", "cluster_id", "slot").join(queries.select("query_id", doubles(F.col(vector)).alias("x")), "query_id")
    turn = _turn(centroids)
    entry = nodes.where("slot = 0").drop("slot").where("entry").select("cluster_id", "vec_id").join(base.select("vec_id", doubles(F.col(vector)).alias("entry_x")), "vec_id").select("cluster_id", "entry_x")
    nodes = nodes.join(entry, "cluster_id").withColumn("entry_x", F.when(F.col("entry"), F.col("entry_x")))

    def walk(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int, float]] = []
        if len(q) and len(c):
            c = c.sort_values("local_id").reset_index(drop=True)
            start, ids = int(c.index[c["entry"]][0]), c["vec_id"].to_numpy(np.int64)
            turned, x = turn(np.stack(q["x"])), np.stack(q["x"])
            first = ((x - np.asarray(c["entry_x"][start])) ** 2).sum(1)
            bits, factor, edges = kernels.unpack(list(c["code"]), turned.shape[1]), c["factor"].to_numpy(), [np.asarray(n, np.int64) for n in c["neighbors"]]
            cluster = int(c["cluster_id"].iloc[0])
            for r, query in enumerate(q["query_id"].tolist()):
                score = lambda v: kernels.approximate(bits[v], factor[v], turned[r : r + 1])[0]  # noqa: B023, E731
                rows += [(query, cluster, int(ids[v]), s) for s, _, v in beam(start, float(first[r]), edges, score, ids, ef, post_ef)]
        return pd.DataFrame(rows, columns=["query_id", "cluster_id", "vec_id", "approx"])

    return asked.groupBy("cluster_id", "slot").cogroup(nodes.groupBy("cluster_id", "slot")).applyInPandas(walk, "query_id long, cluster_id long, vec_id long, approx double")


def beam(start: int, first: float, edges: list[np.ndarray], score: Callable[[np.ndarray], np.ndarray], ids: np.ndarray, ef: int, post_ef: int) -> list[tuple[float, int, int]]:
    """(score, vec_id, node) of the result of one walk, best first; only nodes that the walk meets are scored."""
    seen = np.zeros(len(edges), bool)
    seen[start] = True
    open_ = [(first, int(ids[start]), start)]
    held = [(first, int(ids[start]), start)]  # the beam, ascending
    done: list[tuple[float, int, int]] = []
    while open_:
        s, i, u = heapq.heappop(open_)
        if len(held) >= ef and (s, i, u) > held[-1]:
            break
        done.append((s, i, u))
        new = edges[u][~seen[edges[u]]]
        new = np.unique(new)
        seen[new] = True
        if not len(new):
            continue
        for v, near in zip(new.tolist(), score(new).tolist(), strict=True):
            item = (near, int(ids[v]), v)
            if len(held) < ef or item < held[-1]:
                heapq.heappush(open_, item)
                held.append(item)
        held.sort()
        del held[ef:]
    done.sort()
    return done[:post_ef]


def reranked(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, dist): exact squared distances of the candidates (query_id, vec_id), and the k nearest.

    A candidate that isn't in ``base`` is dropped by the join.
    """
    pairs = candidates.select("query_id", "vec_id").distinct()
    both = pairs.join(base.select("vec_id", doubles(F.col(vector)).alias("x")), "vec_id").join(queries.select("query_id", doubles(F.col(vector)).alias("q")), "query_id")

    @F.pandas_udf("double")
    def apart(x: pd.Series, q: pd.Series) -> pd.Series:
        d = np.stack(x) - np.stack(q) if len(x) else np.zeros((0, 1))
        return pd.Series(np.einsum("ab,ab->a", d, d))

    return top(both.select("query_id", "vec_id", apart("x", "q").alias("dist")), k, ["query_id"], ["dist", "vec_id"]).select("query_id", "rank", "vec_id", "dist")


def ivf_search(queries: DataFrame, base: DataFrame, index: DataFrame, centroids: DataFrame | Centers, k: int = 10, nprobe: int = 10, post_ef: int = 100, ef: int | None = None, pool: str = "cluster", workers: DataFrame | None = None, placed: DataFrame | None = None, drop_singletons: bool = False, whole: bool = False) -> DataFrame:
    """The whole search: probe, score (or walk the graph with a beam of ``ef``), rerank exactly, top k.

    ``pool`` says over what the best ``post_ef`` scores are taken: each
    ``cluster`` of a query, each ``worker`` (``workers`` has cluster_id and
    worker_id), or the ``query``.  Scores of different clusters aren't
    comparable, so ``cluster`` is the sound choice; the others are variants.
    ``placed`` (cluster_id, replica, worker_id) of :func:`.balance.placement`
    gives a cluster as many copies as it has replicas, and ``worker`` then means
    the worker that holds the replica of a query.  ``drop_singletons`` leaves
    clusters of one vector out; ``whole`` scores in whole numbers.
    """
    if pool not in ("cluster", "worker", "query"):
        raise ValueError(f"unknown pool {pool}")
    if ef is not None and ef > post_ef:
        raise ValueError("ef must not exceed post_ef")
    if not isinstance(centroids, Centers):
        centroids = Centers(centroids)
    if whole and ef is not None:
        raise ValueError("a walk scores in doubles")
    if pool == "worker" and workers is None and placed is None:
        raise ValueError("workers or a placement is needed")
    if drop_singletons:
        many = index.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("cluster_id")
        index = index.join(many, "cluster_id", "left_semi")
    replicas = None if placed is None else placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("replicas"))
    if ef is None:
        found = scored(queries, index, centroids, nprobe, post_ef, whole=whole, replicas=replicas)
    else:
        found = beamed(queries, index, base, centroids, nprobe, ef, post_ef, replicas=replicas)
    if pool == "worker":
        if workers is None:
            turn = found.join(F.broadcast(replicas), "cluster_id", "left").withColumn("replica", F.pmod(F.xxhash64("query_id"), F.col("replicas")).cast("int"))
            found = turn.join(F.broadcast(placed.select("cluster_id", "replica", "worker_id")), ["cluster_id", "replica"], "left").drop("replica", "replicas")
        else:
            found = found.join(workers.select("cluster_id", "worker_id"), "cluster_id")
        found = top(found, post_ef, ["query_id", "worker_id"], ["approx", "vec_id"], "_at")
    elif pool == "query":
        found = top(found, post_ef, ["query_id"], ["approx", "vec_id"], "_at")
    return reranked(found, queries, base, k)


def topped_up(found: DataFrame, index: DataFrame, queries: DataFrame, base: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, dist): where a query has fewer than k results, the graph neighbours of those join them, by exact distance.

    One step over the graph: a query may still have fewer than k.
    """
    have = found.select("query_id", "vec_id").distinct()
    short = have.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < k).select("query_id")
    ends = index.select("cluster_id", F.explode("neighbors").alias("local_id"), "vec_id")
    near = have.join(short, "query_id").join(ends, "vec_id").select("query_id", "cluster_id", "local_id").distinct()
    near = near.join(index.select("cluster_id", "local_id", "vec_id"), ["cluster_id", "local_id"]).select("query_id", "vec_id")
    return reranked(have.unionByName(near), queries, base, k, vector)


def merged(results: list[DataFrame], k: int) -> DataFrame:
    """The k nearest over several results (query_id, vec_id, dist); a vector found twice counts once."""
    every = results[0].select("query_id", "vec_id", "dist")
    for r in results[1:]:
        every = every.unionByName(r.select("query_id", "vec_id", "dist"))
    every = every.groupBy("query_id", "vec_id").agg(F.min("dist").alias("dist"))
    return top(every, k, ["query_id"], ["dist", "vec_id"]).select("query_id", "rank", "vec_id", "dist")
