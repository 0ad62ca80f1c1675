"""Placing hot clusters on workers: workloads, replicas, greedy placement, routing."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visits(probed: DataFrame) -> DataFrame:
    """(cluster_id, visits)."""
    return probed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("visits"))


def workload(probed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster_id, visits, n, workload): rows that a cluster's visits score, 0 where it isn't visited."""
    v = sizes.join(visits(probed), "cluster_id", "left").select("cluster_id", F.coalesce("visits", F.lit(0)).alias("visits"), "n")
    return v.withColumn("workload", F.col("visits") * F.col("n"))


def replicas(work: DataFrame, workers: int, most: int = 16) -> DataFrame:
    """``work`` with ``replicas``: the workload over a worker's mean (in whole numbers), rounded up, ``most`` at most; 0 if not visited."""
    mean = work.agg(F.expr(f"coalesce(sum(workload), 0) div {int(workers)}").alias("_mean"))
    count = F.when((F.col("workload") > 0) & (F.col("_mean") > 0), F.least(F.lit(most), F.ceil(F.col("workload") / F.col("_mean")))).when(F.col("workload") > 0, 1).otherwise(0)
    # one row; sent to every task
    return work.join(F.broadcast(mean), F.lit(True)).withColumn("replicas", count.cast("int")).drop("_mean")


def placement(counted: DataFrame, workers: int, max_clusters: int = 256, max_rows: int | None = None) -> DataFrame:
    """(cluster_id, replica, worker_id, load): every replica on the least loaded worker that has room, the largest loads first.

    Greedy and sequential, over one row for each cluster (a parameter of the
    index, not a size of the data).  Two replicas of a cluster go to different
    workers.  A replica that fits nowhere raises an error: no probe is dropped.
    """
    rows = counted.where(F.col("replicas") > 0).select("cluster_id", "n", "workload", "replicas").toArrow().to_pylist()
    items = [(-(r["workload"] // r["replicas"]), r["cluster_id"], i, r["n"]) for r in rows for i in range(r["replicas"])]
    heap = [(0, w) for w in range(workers)]
    held: dict[int, list[int]] = {w: [0, 0] for w in range(workers)}
    own: dict[int, set[int]] = {}
    out = []
    for neg, cluster, replica, n in sorted(items):
        aside = []
        while heap:
            load, w = heapq.heappop(heap)
            if held[w][0] < max_clusters and (max_rows is None or held[w][1] + n <= max_rows) and w not in own.setdefault(cluster, set()):
                break
            aside.append((load, w))
        else:
            if replica and len(own[cluster]) >= workers:
                for a in aside:
                    heapq.heappush(heap, a)
                continue  # more replicas than workers
            raise ValueError(f"no worker has room for cluster {cluster}")
        held[w][0] += 1
        held[w][1] += n
        own[cluster].add(w)
        out.append((cluster, replica, w, -neg))
        for a in [*aside, (load - neg, w)]:
            heapq.heappush(heap, a)
    return counted.sparkSession.createDataFrame(out, "cluster_id long, replica int, worker_id int, load long")


def routed(probed: DataFrame, counted: DataFrame) -> DataFrame:
    """(query_id, cluster_id, replica): the queries of a cluster take its replicas in turn, by id.

    The turn of a query is a rank in its cluster and so a window; use
    :func:`salted` where one cluster may be probed by very many queries.
    """
    turn = F.row_number().over(Window.partitionBy("cluster_id").orderBy("query_id")) - 1
    return probed.join(counted.select("cluster_id", "replicas"), "cluster_id").select("query_id", "cluster_id", (turn % F.col("replicas")).cast("int").alias("replica"))


def salted(probed: DataFrame, counted: DataFrame) -> DataFrame:
    """Like :func:`routed` by a hash of the query, without a shuffle of the probes by cluster."""
    return probed.join(counted.select("cluster_id", "replicas"), "cluster_id").select("query_id", "cluster_id", F.pmod(F.xxhash64("query_id"), F.col("replicas")).cast("int").alias("replica"))


def imbalance(placed: DataFrame, workers: int) -> DataFrame:
    """One row: max_load, avg_load, imbalance (their ratio; 0 without load); workers that have nothing count."""
    load = placed.groupBy("worker_id").agg(F.sum("load").alias("load"))
    got = load.agg(F.coalesce(F.max("load"), F.lit(0)).alias("max_load"), (F.coalesce(F.sum("load"), F.lit(0)) / F.lit(float(workers))).alias("avg_load"))
    return got.withColumn("imbalance", F.when(F.col("avg_load") > 0, F.col("max_load") / F.col("avg_load")).otherwise(0.0))
