import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F
from skein.functions import kernels
from skein.functions import vectors as V
from skein.operators import balance, evaluate, index, partition, search
from skein.operators.handle import VectorIndex
from skein.plans import catalogue


def frame(spark, x, ids=None, key="vec_id"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], f"{key} long, embedding array<double>")


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 40))
    q = x[rng.integers(0, 300, 25)] + rng.normal(size=(25, 40)) * 0.3
    base = frame(spark, x).cache()
    queries = frame(spark, q, key="query_id").cache()
    centroids = partition.kmeans(base, 8).cache()
    return x, q, base, queries, centroids


def truth(x, q, k):
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_exact_knn(made):
    x, q, base, queries, _ = made
    got = search.exact_knn(queries, base, 7, block=10).toPandas().sort_values(["query_id", "rank"])
    assert (got["vec_id"].to_numpy().reshape(25, 7) == truth(x, q, 7)).all()
    assert np.allclose(got["dist"], ((q[got["query_id"]] - x[got["vec_id"]]) ** 2).sum(1))


def test_exact_knn_ties_nulls_and_empties(spark):
    base = frame(spark, [[0, 0], [0, 0], None, [1, 0]], [3, 1, 7, 2])
    q = frame(spark, [[0, 0], None], key="query_id")
    got = [tuple(r) for r in search.exact_knn(q, base, 10).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 3, 0.0), (0, 3, 2, 1.0)]
    assert search.exact_knn(q.where("false"), base, 3).count() == 0
    assert search.exact_knn(q, base.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        search.exact_knn(q, base, 1, metric="cosine")


def test_rotation_keeps_lengths_and_agrees_with_columns(spark):
    x = np.random.default_rng(1).normal(size=(5, 40))
    r = kernels.rotate(x)
    assert r.shape == (5, 64) and np.allclose((r**2).sum(1), (x**2).sum(1))
    got = frame(spark, x).orderBy("vec_id").select(V.rotate(F.col("embedding"), 40).alias("r")).collect()
    assert np.allclose([g["r"] for g in got], r)


def test_score_is_the_sign_form():
    rng = np.random.default_rng(2)
    x, c, q = rng.normal(size=(50, 64)), rng.normal(size=64), rng.normal(size=(7, 64))
    bits, factor = kernels.encode(x, c)
    signs = 2.0 * bits - 1
    assert np.allclose(kernels.approximate(bits, factor, q), factor[None] - 2.5 * q @ signs.T)
    bits, factor = kernels.encode(c[None], c)
    assert not bits.any() and factor[0] == 8
    assert (kernels.unpack(kernels.pack(signs > 0), 64) == (signs > 0)).all()


def test_column_math(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], None)], "a array<double>, z array<double>, n array<double>")
    a, z, n = F.col("a"), F.col("z"), F.col("n")
    got = df.select(V.l2_sqr(a, z), V.inner(a, a), V.normalize(a), V.normalize(z), V.pad(a, 4), V.sign_bits(a), V.normalize(n), V.scalar_quantized(a, 256), V.packed_bits(F.array(*[F.lit(1), F.lit(0)] * 16), 32)).first()
    assert got[0] == 25.0 and got[1] == 25.0 and got[2] == [0.6, 0.8] and got[3] == [0.0, 0.0] and got[4] == [3.0, 4.0, 0.0, 0.0] and got[5] == [1, 1] and got[6] is None and got[7] == [0, 255] and got[8] == [0xAAAAAAAA]
    assert [V.padded_dim(d) for d in (1, 64, 65, 128, 300)] == [64, 64, 128, 128, 512]


def test_search_over_all_clusters_is_exact(made):
    x, q, base, queries, centroids = made
    a = partition.assigned(base, centroids)
    built = index.encoded(base, a, centroids)
    got = search.ivf_search(queries, base, built, centroids, 10, nprobe=8, post_ef=300).toPandas().sort_values(["query_id", "rank"])
    assert (got["vec_id"].to_numpy().reshape(25, 10) == truth(x, q, 10)).all()


def test_recall_grows_with_probes_and_shortlist(made):
    x, q, base, queries, centroids = made
    built = index.encoded(base, partition.assigned(base, centroids), centroids).cache()
    exact = search.exact_knn(queries, base, 10).cache()
    r = {(n, p): evaluate.recall(search.ivf_search(queries, base, built, centroids, 10, n, p), exact, 10).first()["recall"] for n, p in ((1, 10), (4, 10), (8, 10), (8, 60))}
    assert r[1, 10] <= r[4, 10] <= r[8, 10] <= r[8, 60] and r[8, 60] >= 90
    for pool in ("query", "worker"):
        workers = centroids.select("cluster_id").withColumn("worker_id", F.col("cluster_id") % 2)
        assert search.ivf_search(queries, base, built, centroids, 10, 8, 40, pool=pool, workers=workers).count() == 250


def test_graph_and_beam(made):
    x, q, base, queries, centroids = made
    a = partition.assigned(base, centroids)
    graph = index.graph_index(base, a, centroids, degree=8).cache()
    rows = graph.toPandas()
    for _, g in rows.groupby("cluster_id"):
        assert g["entry"].sum() == 1
        for i, n in zip(g["local_id"], g["neighbors"], strict=True):
            assert len(n) == min(8, len(g) - 1) == len(set(n)) and i not in n and all(0 <= v < len(g) for v in n)
    exact = search.exact_knn(queries, base, 10)
    beam = evaluate.recall(search.ivf_search(queries, base, graph, centroids, 10, 8, 60, ef=60), exact, 10).first()["recall"]
    scan = evaluate.recall(search.ivf_search(queries, base, graph, centroids, 10, 8, 60), exact, 10).first()["recall"]
    assert beam >= scan - 5
    with pytest.raises(ValueError):
        search.ivf_search(queries, base, graph, centroids, 10, 8, 10, ef=20)
    assert index.degree_stats(graph).agg(F.sum("self_loops")).first()[0] == 0


def test_graph_builds_in_the_time_of_its_rows():
    """Random neighbours are drawn without a list of all nodes, and few candidates are all kept."""
    x = np.random.default_rng(0).normal(size=(3000, 8))
    g = index.ClusterGraph(x, 8, 16, 1)
    assert all(len(set(o)) == 8 and i not in o for i, o in enumerate(g.out))
    assert index.ClusterGraph(x[:4], 8, 16, 1).drawn(1, 8, [2]) in ([0, 3], [3, 0])
    near = dict(enumerate([0.1, 0.2, 0.3]))
    assert g.prune(2999, near) == ([0, 1, 2], [])
    assert g.drawn(5, 4, []) != g.drawn(5, 4, [])


def test_kmeans_brute_force(spark):
    """Lloyd's rounds from the same start; no silent limit on the number of clusters."""
    x = np.random.default_rng(5).normal(size=(200, 6))
    base = frame(spark, x)
    got = np.array([r["centroid"] for r in partition.kmeans(base, 5, rounds=60).orderBy("cluster_id").collect()])
    near = ((x[:, None] - got[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(got, [x[near == k].mean(0) for k in range(5)], atol=1e-6)
    with pytest.raises(ValueError):
        partition.kmeans(base, 20, sample=10)
    same = frame(spark, [[1.0, 0.0]] * 9 + [[0.0, 1.0]])
    assert partition.kmeans(same, 2, sample=2).count() == 2 and partition.kmeans(same, 4).count() == 2


@pytest.fixture()
def parts_without_rows(spark, tmp_path):
    """200 vectors in a file of one row group that is read in many parts, so all parts but one have no rows."""
    frame(spark, np.random.default_rng(6).normal(size=(200, 64))).coalesce(1).write.parquet(f"{tmp_path}/one")
    keys = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    base = spark.read.parquet(f"{tmp_path}/one")
    assert base.rdd.getNumPartitions() > 4
    yield base
    for k, v in before.items():
        spark.conf.set(k, v)


def test_kmeans_of_parts_without_rows(parts_without_rows):
    base = parts_without_rows
    whole = partition.kmeans(base.coalesce(1), 4, rounds=60).orderBy("cluster_id").collect()
    got = partition.kmeans(base, 4, rounds=60).orderBy("cluster_id").collect()
    assert len(got) == 4 and np.allclose([r["centroid"] for r in got], [r["centroid"] for r in whole])


def test_scaling_model(spark):
    """Against the same formula in closed form, without spread; with it, reruns agree on any number of partitions."""
    got = {r["nodes"]: r["qps"] for r in evaluate.scaling(spark, (1, 4), 50, 2.0, 1000, 500, 0.5, 1.0, 0.25, spread=0.0).collect()}
    assert np.isclose(got[1], 1000 / 2.25) and np.isclose(got[4], 4000 / (2.25 + 1.0 + 1500 * 8 / 1e6))
    a, b = ([tuple(r) for r in evaluate.scaling(spark, (1, 2, 8), 3000, 2.0, 40).orderBy("nodes").collect()] for _ in range(2))
    assert a == b and abs(a[0][1] - 500) < 10


def test_index_round_trip(made, spark, tmp_path):
    _, _, base, queries, centroids = made
    built = index.encoded(base, partition.assigned(base, centroids), centroids)
    index.save(built, f"{tmp_path}/index")
    again = index.load(spark, f"{tmp_path}/index")
    key = lambda d: sorted((r["vec_id"], r["cluster_id"], bytes(r["code"]), r["factor"]) for r in d.collect())
    assert key(built) == key(again)
    base.write.parquet(f"{tmp_path}/other")
    with pytest.raises(Exception):
        index.load(spark, f"{tmp_path}/other")


def test_slots_split_hot_clusters(made):
    _, _, base, queries, centroids = made
    built = index.encoded(base, partition.assigned(base, centroids), centroids)
    one = search.scored(queries, built, centroids, 3, 5)
    many = search.scored(queries, built, centroids, 3, 5, most=2)
    key = lambda d: sorted((r["query_id"], r["cluster_id"], r["vec_id"], round(r["approx"], 9)) for r in d.collect())
    assert key(one) == key(many)


def test_capping(made):
    _, _, base, _, centroids = made
    a = partition.assigned(base, centroids)
    before = {r["vec_id"]: r["cluster_id"] for r in a.collect()}
    got = partition.capped(base, a, centroids, limit=40).collect()
    size = {}
    for r in got:
        size[r["cluster_id"]] = size.get(r["cluster_id"], 0) + 1
        assert r["moved"] == (before[r["vec_id"]] != r["cluster_id"])
    assert max(size.values()) <= 40 and len(got) == 300
    with pytest.raises(ValueError):
        partition.capped(base, a, centroids, limit=3)


def test_capping_of_parts_without_rows(parts_without_rows):
    """The clusters of k-means, assignment and capping, all from a file whose parts have no rows but for one."""
    base = parts_without_rows
    centroids = partition.kmeans(base, 4)
    got = partition.capped(base, partition.assigned(base, centroids), centroids, limit=55).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(200))
    assert max(np.bincount([r["cluster_id"] for r in got])) <= 55


def test_capped_query_with_few_different_vectors(spark, tmp_path):
    """Fewer clusters than 12: all rows stay, the clusters are as even as they can be, and distances are those of the own centroid; no rows give none."""
    points = np.random.default_rng(7).normal(size=(7, 64))
    of = np.array([0] * 150 + [i % 7 for i in range(50)])
    for name, rows in (("few", points[of]), ("none", [])):
        frame(spark, rows).withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    got = catalogue.QUERIES["capped_assignment"](spark, f"{tmp_path}/few").collect()
    assert sorted(r["vec_id"] for r in got) == list(range(200))
    size = np.bincount([r["cluster_id"] for r in got])
    assert len(size) == 7 and max(size) <= 29
    home = {of[r["vec_id"]]: r["cluster_id"] for r in got if not r["moved"]}
    center = {c: points[p] for p, c in home.items()}
    assert len(center) == 7 and all(r["moved"] == (r["cluster_id"] != home[of[r["vec_id"]]]) for r in got)
    assert all(abs(r["dist"] - np.linalg.norm(points[of[r["vec_id"]]] - center[r["cluster_id"]])) < 1e-5 for r in got)
    assert catalogue.QUERIES["capped_assignment"](spark, f"{tmp_path}/none").count() == 0


def test_capping_moves_on_from_full_neighbours(spark):
    """One hot cluster whose only near neighbour fills up: rows go on over rounds, distances are those of the new centroid."""
    x = np.array([[0.001 * i, 0.0] for i in range(90)])
    base = frame(spark, x)
    centers = [[float(c), 0.0] for c in range(5)]
    centroids = spark.createDataFrame([(i, c) for i, c in enumerate(centers)], "cluster_id long, centroid array<double>")
    got = partition.capped(base, partition.assigned(base, centroids), centroids, limit=20).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(90))
    assert max(np.bincount([r["cluster_id"] for r in got])) <= 20
    for r in got:
        assert r["moved"] == (r["cluster_id"] != 0)
        assert abs(r["dist"] - np.linalg.norm(x[r["vec_id"]] - centers[r["cluster_id"]])) < 1e-9
    # the three nearest of every row hold 60 rows only, so the rest is spread over them
    tight = partition.capped(base, partition.assigned(base, centroids), centroids, limit=20, near=3, rounds=8).collect()
    assert len(tight) == 90 and {r["cluster_id"] for r in tight} == {0, 1, 2}
    assert max(np.bincount([r["cluster_id"] for r in tight])) <= 40


def test_walk_scores_only_what_it_meets():
    edges = [np.array(e) for e in ([1, 2], [3], [0], [1], [0])]
    near, met = np.array([9.0, 1.0, 2.0, 0.5, 0.0]), []
    got = search.beam(0, 9.0, edges, lambda v: met.extend(v.tolist()) or near[v], np.arange(5), 5, 5)
    assert sorted(met) == [1, 2, 3] and [v for _, _, v in got] == [3, 1, 2, 0]


def test_cluster_tables(spark):
    a = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (3, 2, 1.0)], "vec_id long, cluster_id long, dist double")
    c = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0])], "cluster_id long, centroid array<double>")
    assert sorted(map(tuple, partition.sizes(a, c).collect())) == [(0, 2), (1, 0), (2, 1)]
    assert sorted(map(tuple, partition.stats(a, c, a.select("cluster_id")).collect())) == [(0, 2, 2.0, 4.0, 3.0, 2), (1, 0, 0.0, 0.0, 0.0, 0), (2, 1, 1.0, 1.0, 1.0, 1)]
    assert sorted(map(tuple, partition.members(a).collect())) == [(0, 0, 1), (0, 1, 2), (2, 0, 3)]
    assert partition.histogram(a, "dist", 3).agg(F.sum("n")).first()[0] == 3
    assert partition.histogram(a.where("false"), "dist").count() == 0


def test_balance(spark):
    sizes = spark.createDataFrame([(i, 10 * (i + 1)) for i in range(6)], "cluster_id long, n long")
    probed = spark.createDataFrame([(q, 0 if q % 3 else q % 5) for q in range(90)], "query_id long, cluster_id long")
    work = balance.replicas(balance.workload(probed, sizes), 4)
    rows = {r["cluster_id"]: r for r in work.collect()}
    mean = sum(r["workload"] for r in rows.values()) // 4
    assert all(r["replicas"] == (-(-r["workload"] // mean) if r["workload"] else 0) for r in rows.values())
    placed = balance.placement(work, 4).collect()
    assert len(placed) == sum(r["replicas"] for r in rows.values()) and len({(p["cluster_id"], p["worker_id"]) for p in placed}) == len(placed)
    with pytest.raises(ValueError):
        balance.placement(work, 4, max_rows=5)
    for route in (balance.routed, balance.salted):
        got = route(probed, work).collect()
        assert len(got) == 90 and all(0 <= r["replica"] < rows[r["cluster_id"]]["replicas"] for r in got)
    assert balance.imbalance(balance.placement(work, 4), 4).first()["imbalance"] >= 1


def test_evaluate(spark):
    t = spark.createDataFrame([(0, 1, 5, 0.0), (0, 2, 6, 4.0), (1, 1, 7, 0.0)], "query_id long, rank int, vec_id long, dist double")
    f = spark.createDataFrame([(0, 1, 5, 0.0), (0, 2, 9, 16.0), (1, 1, 8, 1.0)], "query_id long, rank int, vec_id long, dist double")
    assert evaluate.recall(f, t, 2).first()["recall"] == 25.0
    assert {r["query_id"]: r["hits"] for r in evaluate.recall_by_query(f, t, 2).collect()} == {0: 1, 1: 0}
    assert evaluate.distance_ratio(f, t, 2).first()["ratio"] == 1.5
    sizes = evaluate.beam_sizes(100)
    assert [next(sizes) for _ in range(11)] == [100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 1000]
    out = evaluate.sweep(lambda ef: t.where(F.col("rank") <= ef), t, 2, 2, sizes=[1, 2, 3])
    assert [o["ef"] for o in out] == [1, 2, 3][: len(out)]
    rounds = spark.createDataFrame([(8, 10.0, 50.0), (8, 20.0, 60.0)], "nprobe int, qps double, recall double")
    assert tuple(evaluate.averages(rounds, ["nprobe"]).first()) == (8, 15.0, 55.0)
    assert evaluate.scaling(spark, (1, 4), 50, 1.0, 40).count() == 2


def test_merged_results(spark):
    a = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0)], "query_id long, vec_id long, dist double")
    assert [tuple(r) for r in search.merged([a, a], 3).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 3.0)]


def test_saved_index_opens_probed_clusters_only(made, spark, tmp_path):
    _, _, base, queries, centroids = made
    path = f"{tmp_path}/handle"
    built = VectorIndex.build(base, centroids, seed=7)
    assert (built.dimension, built.padded, len(built.diagonal)) == (40, 64, 64)
    built.save(path)
    again = VectorIndex.load(spark, path, base)
    assert (again.diagonal == built.diagonal).all() and (again.diagonal != kernels.rotation_diagonal(64)).any()
    assert sorted(map(tuple, again.sizes().collect())) == sorted(map(tuple, built.sizes().collect()))
    key = lambda d: [tuple(r) for r in d.orderBy("query_id", "rank").collect()]
    assert key(again.search(queries, 10, 8, 300)) == key(search.exact_knn(queries, base, 10))
    one = again.search(queries.where("query_id = 3"), 5, 2, 20)
    plan = one._jdf.queryExecution().executedPlan().toString()
    probed = sorted(r["cluster_id"] for r in partition.probes(queries.where("query_id = 3"), centroids, 2, "query_id").collect())
    opened = re.search(r"PartitionFilters: \[cluster_id#\d+ IN \(([\d,]+)\)", plan)
    assert sorted(map(int, opened[1].split(","))) == probed
    r = again.elements(5).first()
    assert len(r["code"]) == 8 and list(r["embedding"]) == list(base.where("vec_id = 5").first()["embedding"])

    shutil.rmtree(next((tmp_path / "handle" / "rows").glob("cluster_id=*")))
    with pytest.raises(ValueError, match="not complete"):
        VectorIndex.load(spark, path, base)
    with pytest.raises(ValueError):
        kernels.rotate(np.ones((1, 40)), np.ones(32))


def test_placement_gives_the_same_neighbours(made, spark):
    _, _, base, queries, centroids = made
    handle = VectorIndex.build(base, centroids)
    probed = partition.probes(queries, handle.centers, 3, "query_id")
    placed = balance.placement(balance.replicas(balance.workload(probed, handle.sizes()), 4), 4).cache()
    assert placed.where("replica > 0").count() > 0
    key = lambda d: [tuple(r) for r in d.orderBy("query_id", "rank").collect()]
    want = key(handle.search(queries, 10, 3, 30))
    assert key(handle.search(queries, 10, 3, 30, placed=placed)) == want
    # what is placed nowhere is searched all the same
    assert key(handle.search(queries, 10, 3, 30, placed=placed.where("cluster_id > 3"))) == want
    pooled = handle.search(queries, 10, 3, 300, placed=placed, pool="worker")
    assert key(pooled) == key(handle.search(queries, 10, 3, 300))
    with pytest.raises(ValueError):
        handle.search(queries, pool="worker")


def test_singletons_may_be_left_out(spark):
    base = frame(spark, [[0, 0], [0, 1], [9, 9]])
    centroids = spark.createDataFrame([(0, [0.0, 0.5]), (1, [9.0, 9.0])], "cluster_id long, centroid array<double>")
    handle, q = VectorIndex.build(base, centroids), frame(spark, [[8, 8]], key="query_id")
    found = lambda **o: [r["vec_id"] for r in handle.search(q, 3, 2, 5, **o).orderBy("rank").collect()]
    assert found() == [2, 1, 0] and found(drop_singletons=True) == [1, 0]


def test_scores_in_whole_numbers(made):
    rng = np.random.default_rng(3)
    bits, factor, q = rng.random((30, 64)) < 0.5, rng.normal(size=30) * 900, rng.normal(size=(4, 64)) * 50
    got = kernels.approximate_whole(bits, factor, q)
    for i in range(4):
        w, total = [int(v) for v in q[i] * kernels.QUERY_SCALE], int((q[i] * kernels.QUERY_SCALE).sum())
        for j in range(30):
            assert got[i, j] == int(factor[j]) + ((2 * sum(v for v, b in zip(w, bits[j], strict=True) if b) - total) >> 2)
    with pytest.raises(OverflowError):
        kernels.approximate_whole(bits, factor, q * 1e4)
    _, _, base, queries, centroids = made
    handle = VectorIndex.build(base, centroids)
    exact = search.exact_knn(queries, base, 10)
    assert evaluate.recall(handle.search(queries, 10, 8, 60, whole=True), exact, 10).first()["recall"] > 90


def test_short_results_are_topped_up(made):
    x, q, base, queries, centroids = made
    graph = index.graph_index(base, partition.assigned(base, centroids), centroids, degree=8).cache()
    few = search.exact_knn(queries, base, 2)
    full = few.where("query_id < 5").unionByName(search.exact_knn(queries, base, 6).where("query_id >= 5"))
    got = search.topped_up(full, graph, queries, base, 6).toPandas()
    assert (got.groupby("query_id").size() == 6).all()
    edges = {r["vec_id"]: (r["cluster_id"], r["neighbors"]) for r in graph.collect()}
    at = {(r["cluster_id"], r["local_id"]): r["vec_id"] for r in graph.collect()}
    for query in range(5):
        own = [int(v) for v in truth(x, q, 2)[query]]
        every = sorted(set(own) | {at[edges[v][0], n] for v in own for n in edges[v][1]}, key=lambda v: ((x[v] - q[query]) ** 2).sum())
        assert got[got["query_id"] == query].sort_values("rank")["vec_id"].tolist() == every[:6]


def test_stage_times_and_memory(spark):
    stages = evaluate.Stages()
    for _ in range(2):
        with stages("search"), stages("probe"):
            spark.range(10).count()
    got = {r["stage"]: r for r in stages.report(spark).collect()}
    assert set(got) == {"search", "search/probe"} and got["search"]["calls"] == 2 and got["search"]["seconds"] >= got["search/probe"]["seconds"] > 0
    held = evaluate.memory(spark).collect()
    assert held[-1]["peak_resident"] > 1 << 20 and held[0]["storage_limit"] > 0
    assert evaluate.callback_rounds(spark, 20, 50, 5, rounds=2).where("ms > 0").count() == 2
