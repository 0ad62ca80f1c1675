"""The clustered index: one-bit codes with a factor, and an optional proximity graph inside every cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.vectors import doubles
from .partition import Centers

CODES = "vec_id long, cluster_id long, code binary, factor double"
GRAPH = "cluster_id long, local_id int, vec_id long, neighbors array<int>, code binary, factor double, entry boolean"


def encoded(rows: DataFrame, assignment: DataFrame, centroids: DataFrame | Centers, vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster_id, code, factor): sign bits of each vector's rotated residual, packed, and the factor of its score.

    One pass over the rows after the join with the assignment; the centroids
    are sent to the executors, rotated once for each task.
    """
    centers = centroids if isinstance(centroids, Centers) else Centers(centroids)
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        turned = kernels.rotate(c.matrix, c.diagonal)
        for df in batches:
            if not len(df):
                continue
            r = kernels.rotate(np.stack(df["x"]), c.diagonal)
            at = np.searchsorted(c.ids, df["cluster_id"].to_numpy())
            codes, factors = np.empty(len(df), object), np.empty(len(df))
            for i in np.unique(at):
                own = np.flatnonzero(at == i)
                bits, factors[own] = kernels.encode(r[own], turned[i])
                codes[own] = kernels.pack(bits)
            yield pd.DataFrame({"vec_id": df["vec_id"], "cluster_id": df["cluster_id"], "code": codes, "factor": factors})

    both = rows.where(F.col(vector).isNotNull()).select("vec_id", doubles(F.col(vector)).alias("x")).join(assignment.select("vec_id", "cluster_id"), "vec_id")
    return both.mapInPandas(encode, CODES)


class ClusterGraph:
    """Builds the directed proximity graph of one cluster; every step follows a fixed order, so builds agree."""

    def __init__(self, x: np.ndarray, degree: int, ef: int, seed: int, pool: int = 750, keep_pruned: int = 300):
        self.x, self.degree, self.ef, self.pool, self.keep_pruned = x, degree, ef, pool, keep_pruned
        self.rng = np.random.default_rng(seed)
        n = len(x)
        mean = x.mean(0)
        self.entry = int(((x - mean) ** 2).sum(1).argmin())
        self.out: list[list[int]] = []
        for i in range(n):
            self.out.append(self.drawn(i, degree, []))

    def drawn(self, i: int, many: int, without: list[int]) -> list[int]:
        """``many`` different random nodes (all, if there are fewer) that are neither i nor among ``without``; drawn again where they repeat."""
        n, barred = len(self.x), {i, *without}
        if n - len(barred) <= 4 * many:
            rest = [v for v in range(n) if v not in barred]
            return [rest[j] for j in self.rng.permutation(len(rest))[:many].tolist()]
        out: list[int] = []
        while len(out) < many:
            for v in self.rng.integers(n, size=2 * many).tolist():
                if v not in barred and len(out) < many:
                    barred.add(v)
                    out.append(v)
        return out

    def dist(self, i: int, to: list[int]) -> np.ndarray:
        d = self.x[to] - self.x[i]
        return np.einsum("ab,ab->a", d, d)

    def candidates(self, i: int) -> dict[int, float]:
        """What a beam from the entry point towards node i expands, with exact distances, and i's neighbours."""
        seen, beam = {self.entry}, [(float(self.dist(i, [self.entry])[0]), self.entry)]
        open_, found = [beam[0]], {}
        while open_:
            open_.sort(reverse=True)
            d, u = open_.pop()
            if len(beam) >= self.ef and d > beam[-1][0]:
                break
            if u != i:
                found[u] = d
            new = [v for v in self.out[u] if v not in seen]
            seen.update(new)
            if new:
                for v, dv in zip(new, self.dist(i, new).tolist(), strict=True):
                    if len(beam) < self.ef or dv < beam[-1][0]:
                        beam.append((dv, v))
                        open_.append((dv, v))
                beam.sort()
                del beam[self.ef :]
        own = [v for v in self.out[i] if v not in found]
        if own:
            found.update(zip(own, self.dist(i, own).tolist(), strict=True))
        return found

    def prune(self, i: int, found: dict[int, float]) -> tuple[list[int], list[tuple[float, int]]]:
        """Relative-neighbourhood rule: a candidate stays unless one that stays is nearer to it than node i is; ``degree`` candidates or fewer all stay."""
        pool = sorted((d, v) for v, d in found.items() if v != i)[: self.pool]
        if len(pool) <= self.degree:
            return [v for _, v in pool], []
        kept, pruned = [], []
        for d, v in pool:
            if len(kept) >= self.degree:
                break
            if kept and (self.dist(v, kept) < d).any():
                if len(pruned) < self.keep_pruned:
                    pruned.append((d, v))
            else:
                kept.append(v)
        return kept, pruned

    def round(self, last: bool) -> None:
        chosen = [self.prune(i, self.candidates(i)) for i in range(len(self.x))]
        self.out = [list(kept) for kept, _ in chosen]
        for i, (kept, _) in enumerate(chosen):
            for v in kept:
                if i in self.out[v]:
                    continue
                self.out[v].append(i)
                if len(self.out[v]) > self.degree:
                    self.out[v] = self.prune(v, dict(zip(self.out[v], self.dist(v, self.out[v]).tolist(), strict=True)))[0]
        if last:
            for i, (_, pruned) in enumerate(chosen):
                self.fill(i, pruned)

    def fill(self, i: int, pruned: list[tuple[float, int]]) -> None:
        """Tops a node up to its degree from what was pruned, by the widest angle that suffices, then at random."""
        lack = self.degree - len(self.out[i])
        if lack <= 0:
            return
        spare = [(d, v) for d, v in pruned if v not in self.out[i]]
        far = dict(zip(self.out[i], self.dist(i, self.out[i]).tolist(), strict=True)) if self.out[i] else {}

        def within(limit: float) -> list[int]:
            took: list[int] = []
            for d, v in spare:
                if len(took) >= lack:
                    break
                # farther neighbours hide nothing; what was taken before is nearer
                near = [u for u in self.out[i] if far[u] <= d] + took
                if near:
                    a, b = self.x[v] - self.x[i], self.x[near] - self.x[i]
                    cos = (b @ a) / np.maximum(np.linalg.norm(b, axis=1) * np.linalg.norm(a), 1e-30)
                    if (cos > limit).any():
                        continue
                took.append(v)
            return took

        lo, hi, best = 0.5, 1.0, within(1.0)
        for _ in range(5):
            mid = (lo + hi) / 2
            got = within(mid)
            if len(got) >= lack:
                best, hi = got, mid
            else:
                lo = mid
        self.out[i] += best[:lack]
        self.out[i] += self.drawn(i, self.degree - len(self.out[i]), self.out[i])

    def build(self, rounds: int) -> "ClusterGraph":
        for r in range(rounds):
            self.round(r + 1 == rounds)
        return self


def graph_index(rows: DataFrame, assignment: DataFrame, centroids: DataFrame | Centers, degree: int = 32, ef: int = 64, rounds: int = 3, limit: int = 400_000, seed: int = 1, vector: str = "embedding") -> DataFrame:
    """The index with graphs: (cluster_id, local_id, vec_id, neighbors, code, factor, entry).

    Clusters are built side by side, each in one task, which is why they must
    be capped first; one of more than ``limit`` rows raises an error.  A node
    has ``degree`` different neighbours, or all others if there are fewer.
    """
    if degree < 1 or rounds < 2:
        raise ValueError("degree must be at least 1 and rounds at least 2")
    centers = centroids if isinstance(centroids, Centers) else Centers(centroids)
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def build(df: pd.DataFrame) -> pd.DataFrame:
        if len(df) > limit:
            raise ValueError(f"cluster {df['cluster_id'].iloc[0]} has {len(df)} rows; cap it at {limit}")
        df = df.sort_values("vec_id").reset_index(drop=True)
        c, x, cluster = shared.value, np.stack(df["x"]), int(df["cluster_id"].iloc[0])
        g = ClusterGraph(x, degree, ef, seed + cluster).build(rounds)
        bits, factor = kernels.encode(kernels.rotate(x, c.diagonal), kernels.rotate(c.matrix[np.searchsorted(c.ids, cluster)][None], c.diagonal)[0])
        return pd.DataFrame({"cluster_id": cluster, "local_id": np.arange(len(df), dtype=np.int32), "vec_id": df["vec_id"], "neighbors": g.out, "code": kernels.pack(bits), "factor": factor, "entry": np.arange(len(df)) == g.entry})

    both = rows.where(F.col(vector).isNotNull()).select("vec_id", doubles(F.col(vector)).alias("x")).join(assignment.select("vec_id", "cluster_id"), "vec_id")
    return both.groupBy("cluster_id").applyInPandas(build, GRAPH)


def degree_stats(index: DataFrame) -> DataFrame:
    """(cluster_id, n, avg_degree, duplicate_edges, self_loops) of a graph index."""
    return index.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.size("neighbors")).alias("avg_degree"),
        F.sum(F.size("neighbors") - F.size(F.array_distinct("neighbors"))).alias("duplicate_edges"),
        F.sum(F.array_contains("neighbors", F.col("local_id")).cast("long")).alias("self_loops"),
    )


def save(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet in one folder for each cluster, so a search opens only the clusters that it probes."""
    rows = index.repartition(partitions, "cluster_id") if partitions else index.repartition("cluster_id")
    rows.sortWithinPartitions("cluster_id", "vec_id").write.partitionBy("cluster_id").parquet(path)


def load(spark, path: str) -> DataFrame:
    """An index that :func:`save` wrote; raises if a column is missing."""
    index = spark.read.parquet(path)
    missing = {"cluster_id", "vec_id", "code", "factor"} - set(index.columns)
    if missing:
        raise ValueError(f"{path} is no index: it lacks {sorted(missing)}")
    return index.withColumn("cluster_id", F.col("cluster_id").cast("long"))
