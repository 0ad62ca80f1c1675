"""Nearest neighbours by inner product or Euclidean distance with additive quantisation.

A vector is approximated by the sum of one full-dimensional codeword from each
codebook.  The codebooks are learned one after another on what the earlier
ones leave over (k-means on a bounded sample, ``sample`` rows); a vector's
codes are found by beam search over them, and the squared norm of the sum is
stored beside the codes.  A query's inner products with all codewords form a
lookup table; the sum of a vector's entries is its approximate score, less
half the stored norm for Euclidean search, where the norm of the sum stands
for that of the vector.  The best ``depth`` of each block
of the index are scored exactly, in double precision, and the best ``k`` over
all blocks are the result.

Every row is indexed.  Equal vectors inside a block are scored once, so a
large group of copies neither fills the shortlist nor costs more; the copies
come back with ties going to the smaller id.  Rows with a query's own id are
left out before anything is cut off, however often the id is repeated.  Queries are dealt into blocks of
at most about ``query_block`` rows, each of which is sent to the executors and
compared with the whole index, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .text import drawn, fraction_of, table


@dataclass
class Codebooks:
    """``words[m, c]`` is codeword c of codebook m."""

    words: np.ndarray

    @property
    def flat(self) -> np.ndarray:
        return self.words.reshape(-1, self.words.shape[-1])

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum((self.words[m][codes[:, m]] for m in range(len(self.words))), np.zeros((len(codes), self.words.shape[-1]), np.float32))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``x``; centres that lose all rows move to the rows farthest from theirs."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * (x @ c.T)
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        ends = np.cumsum(n)
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (ends - n)[full], axis=0) / n[full, None]
        lost = np.flatnonzero(n == 0)
        if len(lost):
            apart = d[np.arange(len(x)), near] + (x * x).sum(1)
            far = np.argsort(-apart, kind="stable")[: len(lost)]
            c[lost[: len(far)]] = x[far]
    return c


def learn(x: np.ndarray, books: int = 12, words: int = 256, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Codebooks for float32 rows ``x`` (at least one)."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32).copy(), []
    for _ in range(books):
        c = _kmeans(rest, words, rounds, rng)
        near = ((c * c).sum(1) - 2 * (rest @ c.T)).argmin(1)
        rest -= c[near]
        out.append(c)
    return Codebooks(np.stack(out))


def encode(x: np.ndarray, books: Codebooks, beam: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint8) of the rows of ``x`` by beam search, and the squared norms of their sums."""
    n, (m, k, _) = len(x), books.words.shape
    rest = x.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for i in range(m):
        c = books.words[i]
        # squared length of what is left after each choice, without the choice's own part where it doesn't matter
        left = (rest * rest).sum(2)[:, :, None] + (c * c).sum(1) - 2 * (rest @ c.T)
        left = left.reshape(n, -1)
        w = min(beam, left.shape[1])
        best = np.argpartition(left, w - 1, axis=1)[:, :w]
        came, word = best // k, best % k
        rest = np.take_along_axis(rest, came[:, :, None], 1) - c[word]
        codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    win = (rest * rest).sum(2).argmin(1)
    codes = codes[np.arange(n), win]
    y = books.decode(codes)
    return codes, (y * y).sum(1)


def approximate(luts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scores (rows by queries) by lookup; ``luts[m, c, q]`` is query q's inner product with codeword c of codebook m."""
    out = luts[0][codes[:, 0]]
    for m in range(1, len(luts)):
        out += luts[m][codes[:, m]]
    return out


class _Best:
    """Each query's best k so far: score descending, id ascending."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score, score], 1), np.concatenate([self.id, ids], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score, self.id = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, asked: np.ndarray, query: np.ndarray, luts: np.ndarray, best: _Best, depth: int, euclidean: bool) -> None:
    """Adds a block of the index to the best; needs ascending ids.

    Of equal vectors twice k rows are enough, k of each id at most: k are left
    for a query whose own id some of them have.
    """
    k, none = best.k, np.iinfo(np.int64).max
    _, first, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)

    def numbered(*by: np.ndarray) -> np.ndarray:
        """Of rows sorted by ``by``, each one's number among those that are equal."""
        at = np.arange(len(by[0]))
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in by], axis=0)])
        return at - np.maximum.accumulate(np.where(new, at, 0))

    order = np.argsort(group, kind="stable")
    order = order[numbered(group[order], ids[order]) < k]
    rank = numbered(group[order])
    order, rank = order[rank < 2 * k], rank[rank < 2 * k]
    copies = np.full((len(first), int(rank.max()) + 1), none)
    copies[group[order], rank] = ids[order]
    x = x[first].astype(np.float64)
    half = (x * x).sum(1) / 2 if euclidean else np.zeros(len(x))
    score = approximate(luts, codes[first]).T - (norms[first] / 2 if euclidean else 0)
    d = min(depth, len(first))
    near = np.argpartition(-score, d - 1, axis=1)[:, :d]
    for q in range(0, len(query), 256):
        at, own = near[q : q + 256], asked[q : q + 256]
        exact = np.einsum("qd,qnd->qn", query[q : q + 256], x[at]) - half[at]
        part = copies[at]
        sub = _Best(len(at), k)
        wide = np.repeat(exact[:, :, None], part.shape[2], 2)
        sub.add(np.where((part == none) | (part == own[:, None, None]), -np.inf, wide).reshape(len(at), -1), part.reshape(len(at), -1))
        old = _Best(0, best.k)
        old.score, old.id = best.score[q : q + 256], best.id[q : q + 256]
        old.add(sub.score, sub.id)
        best.score[q : q + 256], best.id[q : q + 256] = old.score, old.id


def usable(vector: str, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components and isn't zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    c = F.col(vector)
    return F.coalesce((F.size(c) == dim) & F.forall(c, finite) & F.exists(c, lambda v: v != 0), F.lit(False))


def search(rows: DataFrame, is_query: Column, k: int = 20, books: int = 20, words: int = 256, beam: int = 2, sample: int = 8192, depth: int = 192, query_block: int = 4096, block: int = 8192, seed: int = 7, metric: str = "inner") -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's ``k`` nearest rows of ``rows`` (vec_id, embedding) but itself.

    Rows with a null id take no part, nor do vectors that are null, zero, of
    another dimension than most, or hold null or non-finite components.  If an
    id is repeated, each of its rows counts as a candidate of its own for
    others, and its smallest vector (by its bytes) as the one query.  Without
    queries or vectors the result is empty.  ``score`` is the inner product,
    or with the metric ``euclidean`` the squared distance, negated.
    """
    if metric not in ("inner", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    euclidean = metric == "euclidean"
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    dims = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["d"]
    rows = rows.where(F.col("vec_id").isNotNull() & usable("embedding", dim)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), is_query.alias("is_query"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("is_query"), F.lit(False)).cast("long")).alias("q")).first()
    if not total["n"] or not total["q"]:
        return spark.createDataFrame([], schema)
    got = rows.where(drawn(F.lit(fraction_of(total["n"], sample)), F.col("vec_id"), seed=seed)).select("vec_id", "x").toArrow().to_pandas()
    if not len(got):
        got = rows.select("vec_id", "x").limit(sample).toArrow().to_pandas()
    got = got.sort_values("vec_id")
    model = spark.sparkContext.broadcast(learn(np.unique(np.stack(got["x"]).astype(np.float32), axis=0), books, words, seed=seed))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for i in range(0, len(df), 1024):
                part = df.iloc[i : i + 1024]
                x = np.stack(part["x"].to_numpy())
                codes, norms = encode(x, model.value, beam)
                yield pd.DataFrame({"vec_id": part["vec_id"], "is_query": part["is_query"], "x": [v.tobytes() for v in x], "codes": [c.tobytes() for c in codes], "norm": norms})

    coded = written(rows.withColumn("is_query", F.coalesce("is_query", F.lit(False))).mapInPandas(index, "vec_id long, is_query boolean, x binary, codes binary, norm float"), "ann-index")
    blocks = -(-total["q"] // query_block)
    asked = coded.where("is_query").groupBy("vec_id").agg(F.min("x").alias("x"))

    def compare(query: "Broadcast") -> "Callable":  # noqa: F821
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = query.value
            luts = np.ascontiguousarray((model.value.flat.astype(np.float64) @ q.T).reshape(books, words, len(q)).astype(np.float32))
            best = _Best(len(q), k)
            for df in batches:
                df = df.sort_values("vec_id")
                for i in range(0, len(df), block):
                    part = df.iloc[i : i + block]
                    x = np.frombuffer(b"".join(part["x"]), np.float64).reshape(len(part), dim)
                    codes = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), books)
                    _block(part["vec_id"].to_numpy(), x, codes, part["norm"].to_numpy(), ids, q, luts, best, depth, euclidean)
            at, col = np.nonzero(best.score > -np.inf)
            score = best.score[at, col]
            if euclidean:
                score = 2 * score - (q * q).sum(1)[at]
            yield pd.DataFrame({"query_id": ids[at], "vec_id": best.id[at, col], "score": score})

        return run

    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        part = part.toArrow().to_pandas().sort_values("vec_id")
        if not len(part):
            continue
        query = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), np.frombuffer(b"".join(part["x"]), np.float64).reshape(len(part), dim)))
        hits = coded.select("vec_id", "x", "codes", "norm").mapInPandas(compare(query), "query_id long, vec_id long, score double")
        # ids of one query that repeat are rows of their own, so the rank is over rows
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            hits = written(hits, "ann-hits")
        found = hits if found is None else found.unionByName(hits)
    return found


def result(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
