"""The registered queries of the vector engine and their SQL.

All work on ``embeddings`` (vec_id, embedding, label); queries are the rows
whose id is divisible by 50, clusters are the labels unless a query makes its
own.  Doubles are rounded half up to six digits in both engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import balance, evaluate, index, partition, search
from ..operators.handle import VectorIndex
from ..scratch import shared_dir, written
from ..sources import vectors as files
from ..streaming import search as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K, NPROBE, POST_EF, WORKERS = 10, 3, 20, 4


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def base_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("cluster_id"))


def queries_of(base: DataFrame) -> DataFrame:
    return base.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def own_assignment(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """The labels as an assignment, with the distance to the label's centroid."""
    both = base.where(F.col("embedding").isNotNull()).join(centroids, "cluster_id")
    return both.select("vec_id", "cluster_id", F.sqrt(V.l2_sqr(F.col("embedding"), F.col("centroid"))).alias("dist"))


def _r(c: str) -> Column:
    return V.fixed(F.col(c)).alias(c)


def _long(rows: DataFrame, column: str) -> DataFrame:
    """A row for each component, so results compare without regard to how an engine shows arrays."""
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(column).alias("pos", "x"))


def _long_sql(keys: str, column: str, sql: str) -> str:
    return f"SELECT {keys}{', ' if keys else ''}unnest(range(0, len({column})))::INTEGER AS pos, unnest({column}) AS x FROM ({sql})"


# --- SQL parts

_L2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_FIX = "floor({0} * 1e6 + 0.5) / 1e6"
_FIX_ALL = "list_transform({0}, lambda x: floor(x * 1e6 + 0.5) / 1e6)"


def _l2(a: str, b: str) -> str:
    return _L2.format(a, b)


def _fix(x: str) -> str:
    return _FIX.format(x)


_BASE = """base AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label::BIGINT AS cluster_id FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT vec_id AS query_id, e FROM base WHERE vec_id % 50 = 0)"""
_CENTROIDS = """parts AS (SELECT cluster_id, unnest(range(1, len(e) + 1)) AS pos, unnest(e) AS x FROM base),
centroids AS (SELECT cluster_id, list(m ORDER BY pos) AS c FROM (SELECT cluster_id, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY cluster_id)"""
_PROBES = f"""dists AS (SELECT query_id, cluster_id, {_l2("e", "c")} AS dist FROM q, centroids),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, cluster_id) AS rank FROM dists),
probes AS (SELECT * FROM ranked WHERE rank <= {NPROBE})"""
_WORK = f"""sizes AS (SELECT cluster_id, count(*) AS n FROM base GROUP BY 1),
visits AS (SELECT cluster_id, count(*) AS visits FROM probes GROUP BY 1),
work AS (SELECT cluster_id, coalesce(visits, 0) AS visits, n, coalesce(visits, 0) * n AS workload FROM sizes LEFT JOIN visits USING (cluster_id)),
replicas AS (SELECT *, CASE WHEN workload > 0 AND m > 0 THEN least(16, ceil(workload / m)) WHEN workload > 0 THEN 1 ELSE 0 END::INTEGER AS replicas
  FROM work, (SELECT coalesce(sum(workload), 0) // {WORKERS} AS m FROM work))"""


def _rotated(table: str, column: str, key: str, to: str) -> str:
    """CTE ``to``(key, r): rotated vectors of 64 dimensions."""
    return f"""{to} AS (SELECT {key}, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64),
  lambda j: s[j + 1] * (1 - 2 * (bit_count(i & j) % 2))))) AS r FROM (SELECT {key}, list_transform(range(0, 64),
  lambda j: {column}[j + 1] * (1 - 2 * (bit_count((j * 2654435761) & 4294967295) % 2)) / 8) AS s FROM {table}))"""


_CODES = f"""{_rotated("base", "e", "vec_id, cluster_id", "rbase")},
{_rotated("centroids", "c", "cluster_id", "rcent")},
resid AS (SELECT vec_id, cluster_id, rcent.r AS rc, list_transform(list_zip(rbase.r, rcent.r), lambda z: z[1] - z[2]) AS d FROM rbase JOIN rcent USING (cluster_id)),
unit AS (SELECT vec_id, cluster_id, rc, n, list_transform(d, lambda x: x / CASE WHEN n > 0 THEN n ELSE 1 END) AS u FROM (SELECT *, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS n FROM resid)),
signs AS (SELECT vec_id, cluster_id, rc, u, n, list_transform(u, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM unit),
codes AS (SELECT vec_id, cluster_id, bits, CASE WHEN n > 0 THEN (size * size + 2 * size / (CASE WHEN x0 <> 0 THEN x0 ELSE 1 END) * x1) * 8 ELSE 8 END AS factor FROM (
  SELECT *, sqrt(list_sum(list_transform(u, lambda x: x * x))) AS size,
    list_sum(list_transform(list_zip(u, bits), lambda z: z[1] * (2 * z[2] - 1))) / 8 / (CASE WHEN list_sum(list_transform(u, lambda x: x * x)) > 0 THEN sqrt(list_sum(list_transform(u, lambda x: x * x))) ELSE 1 END) AS x0,
    list_sum(list_transform(list_zip(rc, bits), lambda z: z[1] * (2 * z[2] - 1))) / 8 AS x1 FROM signs))"""
_SCORES = f"""{_rotated("q", "e", "query_id", "rq")},
scores AS (SELECT p.query_id, p.cluster_id, p.rank AS probe, c.vec_id, c.factor + (2 * list_sum(list_transform(list_zip(rq.r, c.bits), lambda z: -10 * z[1] * z[2])) - list_sum(list_transform(rq.r, lambda x: -10 * x))) / 4 AS approx
  FROM probed p JOIN codes c USING (cluster_id) JOIN rq USING (query_id))"""


def _search_sql(pool: str, probes: str = f"SELECT * FROM ranked WHERE rank <= {NPROBE}") -> str:
    """CTEs down to ``found`` (query_id, rank, vec_id, dist)."""
    return f"""{_BASE}, {_CENTROIDS}, {_PROBES}, probed AS ({probes}), {_CODES}, {_SCORES},
pooled AS (SELECT *, row_number() OVER (PARTITION BY {pool} ORDER BY approx, vec_id) AS nth FROM scores),
exact AS (SELECT p.query_id, p.vec_id, {_l2("b.e", "q.e")} AS dist FROM pooled p JOIN base b USING (vec_id) JOIN q USING (query_id) WHERE nth <= {POST_EF}),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM exact) WHERE rank <= {K})"""


_TRUTH = f"""truth AS (SELECT * FROM (SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank
  FROM (SELECT query_id, vec_id, {_l2("q.e", "b.e")} AS dist FROM q, base b)) WHERE rank <= {K})"""


def _neighbors(table: str) -> str:
    return f"SELECT query_id, rank::INTEGER AS rank, vec_id, {_fix('dist')} AS dist FROM {table}"


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "vec_id", V.fixed(F.col("dist")).alias("dist"))


# --- exact search and vector arithmetic


@query(f"WITH {_BASE}, {_TRUTH} {_neighbors('truth')}")
def exact_knn_top10(spark, d):
    base = base_of(spark, d)
    return _rounded(search.exact_knn(queries_of(base), base, K))


@query(f"""WITH raw AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
base AS (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS e FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM raw)),
q AS (SELECT vec_id AS query_id, e FROM base WHERE vec_id % 50 = 0), {_TRUTH} {_neighbors('truth')}""")
def exact_knn_top10_angular(spark, d):
    base = base_of(spark, d)
    return _rounded(search.exact_knn(queries_of(base), base, K, metric="angular"))


@query(f"WITH {_BASE} SELECT vec_id, {_fix('list_sum(list_transform(e, lambda x: x * x))')} AS norm_sqr FROM base")
def vector_norms(spark, d):
    return base_of(spark, d).where(F.col("embedding").isNotNull()).select("vec_id", V.fixed(V.norm_sqr(F.col("embedding"))).alias("norm_sqr"))


@query(_long_sql("vec_id", "unit", f"WITH {_BASE} SELECT vec_id, {_FIX_ALL.format('CASE WHEN n > 0 THEN list_transform(e, lambda x: x / n) ELSE e END')} AS unit FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM base)"))
def normalized_vectors(spark, d):
    return _long(base_of(spark, d).where(F.col("embedding").isNotNull()).select("vec_id", V.fixed_all(V.normalize(F.col("embedding"))).alias("unit")), "unit")


@query(_long_sql("vec_id", "padded", f"WITH {_BASE} SELECT vec_id, list_concat(e, list_transform(range(len(e), 128), lambda i: 0.0::DOUBLE)) AS padded FROM base"))
def padded_vectors(spark, d):
    return _long(base_of(spark, d).where(F.col("embedding").isNotNull()).select("vec_id", V.pad(F.col("embedding"), 128).alias("padded")), "padded")


@query(_long_sql("vec_id", "rotated", f"WITH {_BASE}, {_rotated('base', 'e', 'vec_id', 'turned')} SELECT vec_id, {_FIX_ALL.format('r')} AS rotated FROM turned"))
def rotated_vectors(spark, d):
    return _long(base_of(spark, d).where(F.col("embedding").isNotNull()).select("vec_id", V.fixed_all(V.rotate(F.col("embedding"), 64)).alias("rotated")), "rotated")


@query(_long_sql("vec_id", "codes", f"""WITH {_BASE}, span AS (SELECT vec_id, e, list_min(e) AS lo, (list_max(e) - list_min(e)) / 255 AS w FROM base)
SELECT vec_id, list_transform(e, lambda x: CASE WHEN w > 0 THEN floor((x - lo) / w + 0.5) ELSE 0 END::INTEGER) AS codes FROM span"""))
def scalar_quantized_vectors(spark, d):
    return _long(base_of(spark, d).where(F.col("embedding").isNotNull()).select("vec_id", V.scalar_quantized(F.col("embedding"), 256).alias("codes")), "codes")


@query(f"""WITH {_BASE}, pairs AS (SELECT query_id, vec_id, sqrt({_l2('q.e', 'b.e')}) AS dist FROM q, base b WHERE b.vec_id = q.query_id + 1)
SELECT query_id, vec_id, {_fix('dist')} AS dist FROM pairs""")
def pair_distances(spark, d):
    base = base_of(spark, d)
    q = queries_of(base)
    return evaluate.distances_to(q.select("query_id", (F.col("query_id") + 1).alias("vec_id")), q, base).select("query_id", "vec_id", _r("dist"))


# --- partitioning


@query(_long_sql("", "mean", f"""WITH {_BASE}, parts AS (SELECT unnest(range(1, len(e) + 1)) AS pos, unnest(e) AS x FROM base)
SELECT list({_fix('m')} ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS m FROM parts GROUP BY pos)"""))
def global_mean(spark, d):
    return _long(partition.mean_vectors(base_of(spark, d), []).select(V.fixed_all(F.col("mean")).alias("mean")), "mean")


@query(_long_sql("cluster_id", "centroid", f"WITH {_BASE}, {_CENTROIDS} SELECT cluster_id, {_FIX_ALL.format('c')} AS centroid FROM centroids"))
def cluster_centroids(spark, d):
    return _long(partition.centroids_of(base_of(spark, d)).select("cluster_id", V.fixed_all(F.col("centroid")).alias("centroid")), "centroid")


@query(f"""WITH {_BASE}, {_CENTROIDS} SELECT cluster_id, vec_id FROM (SELECT b.cluster_id, vec_id, row_number() OVER (PARTITION BY b.cluster_id ORDER BY {_l2('e', 'c')}, vec_id) AS rank
FROM base b JOIN centroids USING (cluster_id)) WHERE rank = 1""")
def entry_points_per_cluster(spark, d):
    base = base_of(spark, d)
    near = own_assignment(base, partition.centroids_of(base))
    # min of a struct aggregates before the shuffle
    return near.groupBy("cluster_id").agg(F.min(F.struct("dist", "vec_id"))["vec_id"].alias("vec_id"))


@query(f"""WITH {_BASE}, {_CENTROIDS}, near AS (SELECT vec_id, centroids.cluster_id, {_l2('e', 'c')} AS dist FROM base, centroids)
SELECT vec_id, cluster_id, {_fix('sqrt(dist)')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) AS rank FROM near) WHERE rank = 1""")
def nearest_centroid_assignment(spark, d):
    base = base_of(spark, d)
    return partition.assigned(base, partition.centroids_of(base)).select("vec_id", "cluster_id", _r("dist"))


_NEAR = f"""near AS (SELECT vec_id, cluster_id, sqrt(dist) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) AS rank
  FROM (SELECT vec_id, centroids.cluster_id, {_l2('e', 'c')} AS dist FROM base, centroids)) WHERE rank = 1)"""


@query(f"WITH {_BASE}, {_CENTROIDS}, {_NEAR} SELECT cluster_id, count(vec_id) AS n FROM centroids LEFT JOIN near USING (cluster_id) GROUP BY 1")
def cluster_sizes(spark, d):
    base = base_of(spark, d)
    centroids = partition.centroids_of(base)
    return partition.sizes(partition.assigned(base, centroids), centroids)


_STATS = f"""stats AS (SELECT cluster_id, count(vec_id) AS n, coalesce(min(near.dist), 0) AS min_dist, coalesce(max(near.dist), 0) AS max_dist, coalesce(avg(near.dist), 0) AS avg_dist
  FROM centroids LEFT JOIN near USING (cluster_id) GROUP BY 1),
full_stats AS (SELECT stats.*, coalesce(p, 0) AS probes FROM stats LEFT JOIN (SELECT cluster_id, count(*) AS p FROM probes GROUP BY 1) USING (cluster_id))"""


def _stats_of(spark, d) -> DataFrame:
    base = base_of(spark, d)
    centroids = partition.Centers(written(partition.centroids_of(base), "catalogue-centroids"))
    table = spark.createDataFrame([(int(c),) for c in centroids.ids], "cluster_id long")
    return partition.stats(partition.assigned(base, centroids), table, partition.probes(queries_of(base), centroids, NPROBE))


@query(f"WITH {_BASE}, {_CENTROIDS}, {_PROBES}, {_NEAR}, {_STATS} SELECT cluster_id, n, {_fix('min_dist')} AS min_dist, {_fix('max_dist')} AS max_dist, {_fix('avg_dist')} AS avg_dist, probes FROM full_stats")
def cluster_stats(spark, d):
    return _stats_of(spark, d).select("cluster_id", "n", _r("min_dist"), _r("max_dist"), _r("avg_dist"), "probes")


@query(f"WITH {_BASE}, {_CENTROIDS}, {_PROBES}, {_NEAR}, {_STATS} SELECT {_fix('regr_slope(probes, n)')} AS slope, {_fix('regr_intercept(probes, n)')} AS intercept, {_fix('corr(probes, n)')} AS r FROM full_stats")
def cluster_size_probe_regression(spark, d):
    got = _stats_of(spark, d).agg(F.regr_slope("probes", "n").alias("slope"), F.regr_intercept("probes", "n").alias("intercept"), F.corr("probes", "n").alias("r"))
    return got.select(_r("slope"), _r("intercept"), _r("r"))


@query(f"""WITH {_BASE}, {_CENTROIDS}, {_NEAR}, sizes AS (SELECT cluster_id, count(*) AS n FROM near GROUP BY 1)
SELECT cluster_id, n, n - cap AS excess FROM sizes, (SELECT ceil(avg(n))::BIGINT AS cap FROM sizes) WHERE n > cap""")
def oversized_clusters(spark, d):
    base = base_of(spark, d)
    n = written(partition.assigned(base, partition.centroids_of(base)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "catalogue-sizes")
    cap = n.agg(F.ceil(F.avg("n")).alias("c")).first()["c"]
    return n.where(F.col("n") > F.lit(cap)).select("cluster_id", "n", (F.col("n") - F.lit(cap)).alias("excess"))


@query("SELECT label::BIGINT AS cluster_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS local_id, vec_id FROM embeddings")
def cluster_members(spark, d):
    return partition.members(base_of(spark, d).select("cluster_id", "vec_id")).select("cluster_id", F.col("local_id").cast("long").alias("local_id"), "vec_id")


@query(f"""WITH {_BASE}, {_CENTROIDS}, {_NEAR}, v AS (SELECT cluster_id, count(*) AS n FROM near GROUP BY 1), span AS (SELECT min(n) AS lo, max(n) AS hi FROM v)
SELECT least(floor((n - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END)::DOUBLE * 50), 49)::BIGINT AS bin, count(*) AS n FROM v, span GROUP BY 1""")
def cluster_size_histogram(spark, d):
    base = base_of(spark, d)
    n = partition.assigned(base, partition.centroids_of(base)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("v"))
    return partition.histogram(written(n, "catalogue-sizes"), "v")


@query(f"""WITH {_BASE}, {_CENTROIDS}, {_PROBES}, v AS (SELECT cluster_id, count(*) AS probes FROM probes GROUP BY 1)
SELECT cluster_id, probes, row_number() OVER (ORDER BY probes DESC, cluster_id)::INTEGER AS place FROM v QUALIFY place <= 5""")
def most_probed_clusters(spark, d):
    base = base_of(spark, d)
    v = balance.visits(partition.probes(queries_of(base), partition.centroids_of(base), NPROBE))
    return search.top(v.withColumnRenamed("visits", "probes"), 5, [], [F.desc("probes"), "cluster_id"], "place")


def _extreme(order: str) -> str:
    return f"""WITH {_BASE}, {_CENTROIDS}, {_NEAR}, v AS (SELECT cluster_id, count(vec_id) AS n FROM centroids LEFT JOIN near USING (cluster_id) GROUP BY 1)
SELECT cluster_id, n, row_number() OVER (ORDER BY {order}, cluster_id)::INTEGER AS place FROM v QUALIFY place <= 5"""


def _sizes_of(spark, d) -> DataFrame:
    base = base_of(spark, d)
    centroids = partition.centroids_of(base)
    return partition.sizes(partition.assigned(base, centroids), centroids)


@query(_extreme("n"))
def smallest_clusters(spark, d):
    return search.top(_sizes_of(spark, d), 5, [], [F.asc("n"), "cluster_id"], "place")


@query(_extreme("n DESC"))
def largest_clusters(spark, d):
    return search.top(_sizes_of(spark, d), 5, [], [F.desc("n"), "cluster_id"], "place")


@query(f"""WITH {_BASE}, {_CENTROIDS}, {_PROBES}, {_NEAR}, {_STATS}, v AS (SELECT avg_dist AS x FROM full_stats WHERE avg_dist > 0), span AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT least(floor((x - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END)::DOUBLE * 50), 49)::BIGINT AS bin, count(*) AS n FROM v, span GROUP BY 1""")
def cluster_distance_histogram(spark, d):
    return partition.histogram(written(_stats_of(spark, d).where("avg_dist > 0").select("avg_dist"), "catalogue-distances"), "avg_dist")


@query(f"""WITH {_BASE}, {_CENTROIDS}, {_PROBES}, {_NEAR}, {_STATS}
SELECT {_fix('avg(n)')} AS mean_size, {_fix('quantile_cont(n, 0.5)')} AS median_size, {_fix('avg(avg_dist) FILTER (avg_dist > 0)')} AS mean_dist, {_fix('quantile_cont(avg_dist, 0.5) FILTER (avg_dist > 0)')} AS median_dist FROM full_stats""")
def cluster_averages(spark, d):
    own = F.when(F.col("avg_dist") > 0, F.col("avg_dist"))
    got = _stats_of(spark, d).agg(F.avg("n").alias("mean_size"), F.percentile("n", 0.5).alias("median_size"), F.avg(own).alias("mean_dist"), F.percentile(own, 0.5).alias("median_dist"))
    return got.select(_r("mean_size"), _r("median_size"), _r("mean_dist"), _r("median_dist"))


# --- probing and balancing


@query(f"WITH {_BASE}, {_CENTROIDS}, {_PROBES} SELECT query_id, rank::INTEGER AS rank, cluster_id, {_fix('dist')} AS dist FROM probes")
def probe_top_nprobe(spark, d):
    base = base_of(spark, d)
    return partition.probes(queries_of(base), partition.centroids_of(base), NPROBE).select("query_id", "rank", "cluster_id", _r("dist"))


@query(f"WITH {_BASE}, {_CENTROIDS}, {_PROBES} SELECT cluster_id, count(*) AS visits FROM probes GROUP BY 1")
def probe_counts(spark, d):
    base = base_of(spark, d)
    return balance.visits(partition.probes(queries_of(base), partition.centroids_of(base), NPROBE))


def _replicas_of(spark, d) -> tuple[DataFrame, DataFrame]:
    base = base_of(spark, d)
    probed = written(partition.probes(queries_of(base), partition.centroids_of(base), NPROBE), "catalogue-probes")
    n = base.where(F.col("embedding").isNotNull()).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return probed, balance.replicas(written(balance.workload(probed, n), "catalogue-work"), WORKERS)


@query(f"WITH {_BASE}, {_CENTROIDS}, {_PROBES}, {_WORK} SELECT * FROM work")
def cluster_workload(spark, d):
    return _replicas_of(spark, d)[1].drop("replicas")


@query(f"WITH {_BASE}, {_CENTROIDS}, {_PROBES}, {_WORK} SELECT cluster_id, workload, replicas FROM replicas")
def replica_counts(spark, d):
    return _replicas_of(spark, d)[1].select("cluster_id", "workload", "replicas")


@query(f"""WITH {_BASE}, {_CENTROIDS}, {_PROBES}, {_WORK}
SELECT query_id, cluster_id, ((row_number() OVER (PARTITION BY cluster_id ORDER BY query_id) - 1) % replicas)::INTEGER AS replica FROM probes JOIN replicas USING (cluster_id)""")
def replica_routing(spark, d):
    probed, counted = _replicas_of(spark, d)
    return balance.routed(probed, counted)


@query()
def lpt_placement(spark, d):
    return balance.placement(_replicas_of(spark, d)[1], WORKERS)


@query()
def placement_imbalance(spark, d):
    return balance.imbalance(balance.placement(_replicas_of(spark, d)[1], WORKERS), WORKERS)


# --- codes and the searches over them


def _index_of(base: DataFrame) -> tuple[DataFrame, partition.Centers]:
    centers = partition.Centers(partition.centroids_of(base))
    return index.encoded(base.select("vec_id", "embedding"), base.select("vec_id", "cluster_id"), centers), centers


@query(_long_sql("vec_id, cluster_id", "words", f"""WITH {_BASE}, {_CENTROIDS}, {_CODES} SELECT vec_id, cluster_id, list_transform(range(0, 2), lambda w: list_sum(list_transform(range(0, 32), lambda i: bits[w * 32 + i + 1]::BIGINT << (31 - i)))::BIGINT) AS words FROM codes"""))
def packed_sign_codes(spark, d):
    return _long(_packed(spark, d), "words")


def _packed(spark, d) -> DataFrame:
    codes = _index_of(base_of(spark, d))[0]
    word = lambda i: F.conv(F.hex(F.substring("code", 4 * i + 1, 4)), 16, 10).cast("long")
    return codes.select("vec_id", "cluster_id", F.array(word(0), word(1)).alias("words"))


@query(f"WITH {_BASE}, {_CENTROIDS}, {_CODES} SELECT vec_id, list_sum(bits)::INTEGER AS ones FROM codes")
def code_popcount(spark, d):
    return _packed(spark, d).select("vec_id", V.popcount(F.col("words")).alias("ones"))


@query(f"WITH {_BASE}, {_CENTROIDS}, {_CODES} SELECT vec_id, cluster_id, {_fix('factor')} AS factor FROM codes")
def quant_factors(spark, d):
    return _index_of(base_of(spark, d))[0].select("vec_id", "cluster_id", _r("factor"))


@query(f"""WITH {_BASE}, {_CENTROIDS}, {_PROBES}, probed AS (SELECT * FROM probes), {_CODES}, {_SCORES}
SELECT query_id, cluster_id, vec_id, {_fix('approx')} AS approx FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY approx, vec_id) AS nth FROM scores) WHERE nth <= {POST_EF}""")
def approx_scores(spark, d):
    base = base_of(spark, d)
    built, centers = _index_of(base)
    return search.scored(queries_of(base), built, centers, NPROBE, POST_EF).select("query_id", "cluster_id", "vec_id", _r("approx"))


def _scan(spark, d, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = base_of(spark, d)
    built, centers = _index_of(base)
    q = queries_of(base)
    return search.ivf_search(q, base, built, centers, K, how.pop("nprobe", NPROBE), POST_EF, **how), q, base


@query(f"WITH {_search_sql('query_id, cluster_id')} {_neighbors('found')}")
def ivf_scan_search_top10(spark, d):
    return _rounded(_scan(spark, d)[0])


@query(f"WITH {_search_sql('query_id, cluster_id')} {_neighbors('found')}")
def placed_search_top10(spark, d):
    placed = balance.placement(_replicas_of(spark, d)[1], WORKERS)
    return _rounded(_scan(spark, d, placed=written(placed, "catalogue-placed"))[0])


@query(f"WITH {_search_sql('query_id, cluster_id')} {_neighbors('found')}")
def saved_index_search_top10(spark, d):
    base = base_of(spark, d)
    path = f"{shared_dir(spark)}/skein/index-{uuid.uuid4().hex}"
    rows = base.where(F.col("embedding").isNotNull())
    VectorIndex.build(rows.select("vec_id", "embedding"), partition.centroids_of(rows), rows.select("vec_id", "cluster_id")).save(path)
    return _rounded(VectorIndex.load(spark, path, base).search(queries_of(base), K, NPROBE, POST_EF))


@query(f"WITH {_search_sql('query_id')} {_neighbors('found')}")
def ivf_query_pool_top10(spark, d):
    return _rounded(_scan(spark, d, pool="query")[0])


@query(f"WITH {_search_sql(f'query_id, cluster_id % {WORKERS}')} {_neighbors('found')}")
def ivf_worker_pool_top10(spark, d):
    workers = base_of(spark, d).select("cluster_id").distinct().withColumn("worker_id", F.pmod("cluster_id", F.lit(WORKERS)))
    return _rounded(_scan(spark, d, pool="worker", workers=workers)[0])


@query(f"""WITH {_BASE}, pairs AS (SELECT query_id, vec_id, {_l2('q.e', 'b.e')} AS dist FROM q JOIN base b ON b.cluster_id = q.query_id % 10),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs) {_neighbors(f'found WHERE rank <= {K}')}""")
def rerank_top10(spark, d):
    base = base_of(spark, d)
    q = queries_of(base)
    candidates = q.select("query_id", (F.col("query_id") % 10).alias("cluster_id")).join(base.where(F.col("embedding").isNotNull()).select("cluster_id", "vec_id"), "cluster_id")
    return _rounded(search.reranked(candidates, q, base, K))


@query(f"""WITH {_search_sql('query_id, cluster_id')}, {_TRUTH}, hit AS (SELECT count(*) AS hits FROM truth JOIN found USING (query_id, vec_id)), n AS (SELECT count(DISTINCT query_id) AS queries FROM truth)
SELECT hits, queries, {_fix(f'100.0 * hits / (queries * {K})')} AS recall FROM hit, n""")
def recall_at_10(spark, d):
    found, q, base = _scan(spark, d)
    return evaluate.recall(found, search.exact_knn(q, base, K), K).select("hits", "queries", _r("recall"))


@query(f"""WITH {_search_sql('query_id, cluster_id')}, {_TRUTH}, each AS (SELECT query_id, coalesce(avg(CASE WHEN sqrt(t.dist) >= 1e-4 THEN sqrt(f.dist) / sqrt(t.dist) END), 1.0) AS r FROM truth t JOIN found f USING (query_id, rank) GROUP BY 1)
SELECT {_fix('avg(r)')} AS ratio FROM each""")
def distance_ratio(spark, d):
    found, q, base = _scan(spark, d)
    return evaluate.distance_ratio(found, search.exact_knn(q, base, K), K).select(_r("ratio"))


def _by_nprobe(n: int) -> str:
    return f"""SELECT {n} AS nprobe, hits, {_fix(f'100.0 * hits / (queries * {K})')} AS recall FROM (WITH {_search_sql('query_id, cluster_id', f'SELECT * FROM ranked WHERE rank <= {n}')}, {_TRUTH},
hit AS (SELECT count(*) AS hits FROM truth JOIN found USING (query_id, vec_id)), n AS (SELECT count(DISTINCT query_id) AS queries FROM truth) SELECT * FROM hit, n)"""


@query(" UNION ALL ".join(_by_nprobe(n) for n in (1, 2, 4, 8)))
def recall_by_nprobe(spark, d):
    base = base_of(spark, d)
    built, centers = _index_of(base)
    built, q = written(built, "catalogue-index"), queries_of(base)
    truth, out = written(search.exact_knn(q, base, K), "catalogue-truth"), None
    for n in (1, 2, 4, 8):
        row = evaluate.recall(search.ivf_search(q, base, built, centers, K, n, POST_EF), truth, K).select(F.lit(n).alias("nprobe"), "hits", _r("recall"))
        out = row if out is None else out.unionByName(row)
    return out


# Published operating points (system, dataset, recall, qps).
POINTS = (("accelerator", "SIFT1B", 62.0, 34197.78), ("cpu", "SIFT1B", 62.0, 4820.95), ("gpu", "SIFT1B", 62.0, 2387.0), ("accelerator", "SIFT1B", 90.0, 3157.89), ("cpu", "SIFT1B", 90.0, 1231.37), ("gpu", "SIFT1B", 90.0, 2311.0))
_POINTS = "points(system, dataset, recall, qps) AS (VALUES " + ", ".join(f"('{s}', '{d}', {r}::DOUBLE, {q}::DOUBLE)" for s, d, r, q in POINTS) + ")"


@query(f"""WITH {_POINTS}, ticks(tick) AS (VALUES (60.0::DOUBLE), (80.0), (95.0))
SELECT system, tick, qps, recall FROM (SELECT *, row_number() OVER (PARTITION BY system, tick ORDER BY abs(recall - tick), recall) AS rank FROM points, ticks) WHERE rank = 1""")
def operating_point_lookup(spark, d):
    points = spark.createDataFrame(list(POINTS), "system string, dataset string, recall double, qps double")
    return evaluate.operating_points(points, spark.createDataFrame([(60.0,), (80.0,), (95.0,)], "tick double"), ["system"])


@query(f"""WITH {_POINTS} SELECT a.dataset, a.recall AS tick, a.system AS other, {_fix('b.qps / a.qps')} AS speedup FROM points a JOIN points b ON a.dataset = b.dataset AND a.recall = b.recall AND b.system = 'accelerator' WHERE a.system <> 'accelerator'""")
def speedup_table(spark, d):
    points = spark.createDataFrame(list(POINTS), "system string, dataset string, tick double, qps double")
    return evaluate.speedups(points, "accelerator").select("dataset", "tick", "other", _r("speedup"))


# --- sequential or seeded operators


@query()
def kmeans_clusters(spark, d):
    return partition.kmeans(base_of(spark, d), 16).select("cluster_id", V.fixed_all(F.col("centroid")).alias("centroid"))


@query()
def capped_assignment(spark, d):
    base = base_of(spark, d)
    centroids = written(partition.kmeans(base, 16), "catalogue-centroids")
    assignment = written(partition.assigned(base, centroids), "catalogue-assigned")
    # few different vectors make fewer clusters than 12; then a cluster takes the least share that holds all rows
    limit = -(-assignment.count() // min(12, max(1, centroids.count())))
    return partition.capped(base, assignment, centroids, limit).select("vec_id", "cluster_id", _r("dist"), "moved")


def _graph_of(base: DataFrame) -> tuple[DataFrame, partition.Centers]:
    centers = partition.Centers(partition.centroids_of(base))
    rows = base.where(F.col("embedding").isNotNull())
    return written(index.graph_index(rows.select("vec_id", "embedding"), rows.select("vec_id", "cluster_id"), centers), "catalogue-graph"), centers


@query()
def graph_edges(spark, d):
    return _graph_of(base_of(spark, d))[0].select("cluster_id", "local_id", "vec_id", F.explode("neighbors").alias("neighbor"))


@query()
def graph_degree_check(spark, d):
    return index.degree_stats(_graph_of(base_of(spark, d))[0])


@query()
def beam_search_top10(spark, d):
    base = base_of(spark, d)
    built, centers = _graph_of(base)
    return _rounded(search.ivf_search(queries_of(base), base, built, centers, K, NPROBE, POST_EF * 2, ef=POST_EF * 2))


@query(f"WITH {_BASE}, {_TRUTH} {_neighbors('truth')}")
def stream_search_top10(spark, d):
    base = base_of(spark, d)
    folder = f"{shared_dir(spark)}/skein/stream-{uuid.uuid4().hex}"
    queries_of(base).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(queries_of(base).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streaming.search_stream(source, lambda q: search.exact_knn(q, base, K), streaming.parquet_sink(f"{folder}/out"), f"{folder}/state").awaitTermination()
    return _rounded(spark.read.schema(search.NEIGHBORS).parquet(f"{folder}/out"))


@query(_long_sql("vec_id", "embedding", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL"))
def fvecs_roundtrip(spark, d):
    rows = base_of(spark, d).where(F.col("embedding").isNotNull())
    path = f"{shared_dir(spark)}/skein/fvecs-{uuid.uuid4().hex}"
    files.write_vectors(rows, path)
    return _long(files.read_vectors(spark, path, "fvecs"), "embedding")


@query("SELECT unnest([10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 100, 150]) AS ef")
def beam_sizes(spark, d):
    sizes = evaluate.beam_sizes(K)
    return spark.createDataFrame([(next(sizes),) for _ in range(12)], "ef int")


@query()
def simulator_qps(spark, d):
    return evaluate.scaling(spark, (1, 2, 4, 8, 16), 1000, 2.0, 4 * K).select("nodes", _r("qps"))
