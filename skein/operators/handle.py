"""An index as one object: built, saved, loaded, asked and searched."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.vectors import padded_dim
from . import index, partition, search


@dataclass
class VectorIndex:
    """Codes (and graphs) by cluster, the centres with the rotation's diagonal, and the vectors that they stand for.

    ``base`` has (vec_id, embedding) and is read only for exact distances.  A
    method that returns a DataFrame evaluates nothing by itself.
    """

    rows: DataFrame
    centers: partition.Centers
    base: DataFrame

    @classmethod
    def build(cls, base: DataFrame, centroids: DataFrame, assignment: DataFrame | None = None, diagonal: np.ndarray | None = None, seed: int | None = None, graph: bool = False, **options) -> "VectorIndex":
        """An index over ``base``; rows go to their nearest centroid unless an assignment is given.

        The rotation's signs are fixed, drawn from ``seed``, or those of
        ``diagonal``.  ``options`` are those of :func:`.index.graph_index`.
        """
        centers = partition.Centers(centroids)
        if seed is not None and diagonal is None:
            diagonal = kernels.seeded_diagonal(padded_dim(centers.matrix.shape[1]), seed)
        centers.diagonal = diagonal
        assignment = partition.assigned(base, centers) if assignment is None else assignment
        rows = index.graph_index(base, assignment, centers, **options) if graph else index.encoded(base, assignment, centers)
        return cls(rows, centers, base)

    def save(self, path: str) -> None:
        """The folders ``rows`` (one inside for each cluster), ``sizes``, ``centroids`` and ``diagonal``; the vectors stay where they are."""
        spark = self.rows.sparkSession
        index.save(self.rows, f"{path}/rows")
        self.sizes_of(index.load(spark, f"{path}/rows")).coalesce(1).write.parquet(f"{path}/sizes")
        spark.createDataFrame(self.centroids(), "cluster_id long, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        signs = [] if self.centers.diagonal is None else [(self.centers.diagonal.tolist(),)]
        spark.createDataFrame(signs, "diagonal array<double>").coalesce(1).write.parquet(f"{path}/diagonal")

    @classmethod
    def load(cls, spark: SparkSession, path: str, base: DataFrame) -> "VectorIndex":
        """What :meth:`save` wrote; raises if a column, a cluster or rows of one are missing (rows are counted by file footers)."""
        rows = index.load(spark, f"{path}/rows")
        sizes = spark.read.parquet(f"{path}/sizes").withColumnRenamed("n", "_n")
        wrong = cls.sizes_of(rows).join(sizes, "cluster_id", "full").where(~F.col("n").eqNullSafe(F.col("_n"))).first()
        if wrong is not None:
            raise ValueError(f"{path} is not complete: cluster {wrong['cluster_id']} has {wrong['n'] or 0} rows of {wrong['_n'] or 0}")
        signs = spark.read.parquet(f"{path}/diagonal").first()
        centers = partition.Centers(spark.read.parquet(f"{path}/centroids"), diagonal=None if signs is None else np.array(signs["diagonal"]))
        return cls(rows, centers, base)

    @staticmethod
    def sizes_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))

    def sizes(self) -> DataFrame:
        """(cluster_id, n) of the clusters that have rows."""
        return self.sizes_of(self.rows)

    def centroids(self) -> list[tuple[int, list[float]]]:
        return [(int(i), c.tolist()) for i, c in zip(self.centers.ids, self.centers.matrix, strict=True)]

    @property
    def dimension(self) -> int:
        return self.centers.matrix.shape[1]

    @property
    def padded(self) -> int:
        return padded_dim(self.dimension)

    @property
    def diagonal(self) -> np.ndarray:
        return kernels.rotation_diagonal(self.padded) if self.centers.diagonal is None else self.centers.diagonal

    def entry_points(self) -> DataFrame:
        """(cluster_id, local_id, vec_id) of an index with graphs."""
        return self.rows.where("entry").select("cluster_id", "local_id", "vec_id")

    def elements(self, *vec_ids: int) -> DataFrame:
        """What the index holds of some vectors: code, factor, place and neighbours, and the vector itself."""
        return self.rows.where(F.col("vec_id").isin(*vec_ids)).join(self.base.select("vec_id", "embedding"), "vec_id")

    def members(self) -> DataFrame:
        """(cluster_id, local_id, vec_id), by the ids' order."""
        return partition.members(self.rows.select("cluster_id", "vec_id"))

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 10, post_ef: int = 100, **options) -> DataFrame:
        """See :func:`.search.ivf_search`."""
        return search.ivf_search(queries, self.base, self.rows, self.centers, k, nprobe, post_ef, **options)
