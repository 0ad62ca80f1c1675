"""Names for SQL users: scalar functions over vectors and a table function for search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels


def register(spark: SparkSession) -> None:
    """Registers l2_sqr, l2_normalize, inner_product (SQL expressions) and rotate_vector (Arrow batches); null for null."""
    pair = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_sqr{pair} aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION inner_product{pair} aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    size = "sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_normalize(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN IF({size} > 0, zip_with(a, array_repeat({size}, size(a)), (x, n) -> x / n), a)")

    @F.pandas_udf("array<double>")
    def rotate(a: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), dtype=object)
        for _, at in a.groupby(a.map(len, na_action="ignore")).groups.items():
            turned = kernels.rotate(np.stack(a.loc[at]).astype(float))
            for i, v in zip(at, turned, strict=True):
                out[i] = v
        return out

    spark.udf.register("rotate_vector", rotate)


def register_search(spark: SparkSession, base: DataFrame, name: str = "ann_search", k: int = 10, most: int = 1_000_000, most_bytes: int = 256 << 20) -> None:
    """Registers a table function ``name(query_id, vector)`` that returns (query_id, rank, vec_id, dist) over ``base``.

    The base is sent along with the function and so must be small: more than
    ``most`` rows, or ``most_bytes`` of components, raise an error before any
    of them is collected (search those with the DataFrame operators).
    """
    held = base.where(F.col("embedding").isNotNull()).select(F.sum(F.size("embedding")).alias("n")).first()["n"] or 0
    if 8 * held > most_bytes:
        raise ValueError(f"{8 * held} bytes of vectors, more than {most_bytes}")
    rows = base.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").limit(most + 1).toArrow().to_pandas().sort_values("vec_id")
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    shared = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(np.int64), np.stack(rows["embedding"]).astype(float)))

    class Search:
        def eval(self, query_id: int, vector: list) -> Iterator[tuple]:
            if vector is None:
                return
            ids, x = shared.value
            i, d = kernels.nearest(np.asarray(vector, float)[None], x, ids, k)
            for rank, (v, dist) in enumerate(zip(i[0].tolist(), d[0].tolist(), strict=True), 1):
                yield query_id, rank, v, dist

    spark.udtf.register(name, F.udtf(Search, returnType="query_id long, rank int, vec_id long, dist double"))
