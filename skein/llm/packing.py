"""Packing into optimal length buckets.

The histogram of lengths is global (a row for each distinct length, aggregated
before the shuffle).  A dynamic programme over it chooses the bucket
boundaries that minimise the padding of all documents.  Inside each bucket the
documents follow a seeded order, and each run of ``budget // boundary`` of
them is a batch, so a padded batch holds at most ``budget`` tokens (one
document alone may exceed it).

The histogram goes to the driver: its D lengths are distinct, so at least
D * D / 2 tokens lie in the corpus, and 10**13 tokens bound D by 4.5 million.
The programme holds 4 bytes for each length and bucket and some arrays of 8
bytes for each length, so 0.6 GB at that bound.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .text import table, word_count

#: Least parts of the seeded order in which the documents of a bucket are ranked; a part has about ``PART`` of them in larger corpora.
SHARDS, PART = 1024, 1 << 20


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds (the last is the largest length) with the least padding.

    ``lengths`` ascend.  Of several best choices the one found first from the
    right end counts, so the outcome is fixed.  Works in whole numbers, by
    lines of falling slope: O(buckets * lengths).
    """
    x, n = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(x):
        return []
    size = len(x)
    upto, mass = (np.concatenate([[0], np.cumsum(v)]) for v in (n, x * n))
    # cost[j]: least padding of the first j lengths with k buckets; the last holds lengths i to j - 1
    own = np.concatenate([[0], x * upto[1:] - mass[1:]])
    cost, choice = own, []
    # the lines of a bucket's beginnings, by number; products go beyond 64 bits, so they are taken of Python's numbers
    lines = np.empty(size, np.int32)
    for _ in range(1, min(buckets, size)):
        rise = cost + mass
        now, came, held, at = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int32), 0, 0
        line = lambda i: (-int(upto[i]), int(rise[i]))  # noqa: E731, B023
        for j in range(1, size + 1):
            m, c = line(j - 1)
            while held >= 2:
                (m1, c1), (m2, c2) = line(lines[held - 2]), line(lines[held - 1])
                if (c - c1) * (m1 - m2) > (c2 - c1) * (m1 - m):
                    break
                held -= 1
            lines[held] = j - 1
            held += 1
            at = min(at, held - 1)
            v = int(x[j - 1])
            m, c = line(lines[at])
            best = m * v + c
            while at + 1 < held:
                m, c = line(lines[at + 1])
                if m * v + c > best:
                    break
                at, best = at + 1, m * v + c
            now[j], came[j] = int(own[j]) + best, lines[at]
        cost = now
        choice.append(came)
    out, j = [], size
    for came in [*reversed(choice), np.zeros(size + 1, np.int32)]:
        if j:
            out.append(int(x[j - 1]))
            j = int(came[j])
    return out[::-1]


def packed(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65_536, seed: int = 3) -> DataFrame:
    """``docs`` with ``n_tokens``, ``bucket``, ``bucket_len`` (its boundary), ``batch`` (within the bucket) and ``padding``.

    ``length`` is a column of whole numbers (words of ``text`` if not given);
    null counts as 0.  Documents without a token go to the first bucket.
    Repeated rows each have a place.  Columns of the new names are replaced.
    """
    spark = docs.sparkSession
    new = ("n_tokens", "bucket", "bucket_len", "batch", "padding")
    n = word_count(F.col("text")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    # the order depends on the content alone, so that reruns agree
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)
    placed = docs.withColumns({"_pk_n": n, "_pk_place": order})
    kept = [c for c in docs.columns if c not in new]
    narrow = written(placed.select("_pk_n", "_pk_place"), "packing-lengths")
    seen = narrow.groupBy("_pk_n").count().toArrow().to_pandas().sort_values("_pk_n")
    tops = boundaries(seen["_pk_n"], seen["count"], buckets) or [0]

    bounds = F.array(*[F.lit(t).cast("long") for t in tops])
    bucket = lambda c: F.size(F.filter(bounds, lambda t: t < F.col(c)))
    shards = max(SHARDS, int(seen["count"].sum()) // PART)
    shard = F.shiftright("_pk_place", 63 - (shards - 1).bit_length()).cast("int")
    narrow = narrow.select(bucket("_pk_n").alias("_pk_bucket"), shard.alias("_pk_shard"))
    # a row for each bucket and part: 16 for each million documents of large corpora
    held = narrow.groupBy("_pk_bucket", "_pk_shard").count().toArrow().to_pandas().sort_values(["_pk_bucket", "_pk_shard"])
    held["_pk_before"] = held.groupby("_pk_bucket")["count"].cumsum() - held["count"]
    starts = spark.createDataFrame(
        [(int(b), int(s), int(c)) for b, s, c in zip(held["_pk_bucket"], held["_pk_shard"], held["_pk_before"], strict=True)], "_pk_b int, _pk_s int, _pk_before long"
    )
    rows = placed.withColumns({"_pk_bucket": bucket("_pk_n"), "_pk_shard": shard})
    rows = rows.withColumn("_pk_row", F.row_number().over(Window.partitionBy("_pk_bucket", "_pk_shard").orderBy("_pk_place")))
    rows = rows.join(F.broadcast(starts), (F.col("_pk_bucket") == F.col("_pk_b")) & (F.col("_pk_shard") == F.col("_pk_s")))
    top = F.element_at(bounds, F.col("_pk_bucket") + 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(top, F.lit(1)))).cast("long")
    return rows.withColumns({"_pk_top": top, "_pk_each": each}).select(
        *kept, F.col("_pk_n").alias("n_tokens"), F.col("_pk_bucket").alias("bucket"), F.col("_pk_top").alias("bucket_len"),
        F.expr("(_pk_before + _pk_row - 1) div _pk_each").alias("batch"), (F.col("_pk_top") - F.col("_pk_n")).alias("padding"),
    )


def least_padding(lengths: np.ndarray, tops: Sequence[int]) -> int:
    """Padding of ``lengths`` in buckets of these boundaries."""
    t = np.asarray(tops)
    return int((t[np.searchsorted(t, lengths)] - lengths).sum())


def result(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds bucket and batch to the documents."""
    return packed(docs)
