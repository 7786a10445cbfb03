import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions.metrics import METRICS, block_distances, distance, parse_metric
from vecspark.operators import codecs, exact, graph, ivf, kmeans, maintenance, selectors, topk


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def uniform(n, d, seed):
    return np.random.RandomState(seed).uniform(0, 1, (n, d))


@pytest.mark.parametrize("name", METRICS)
def test_both_forms_of_a_metric_agree(spark, name):
    x, y = uniform(6, 5, 1) + 1e-3, uniform(7, 5, 2) + 1e-3
    if name == "nan_euclidean":
        x[0, 1] = y[2, 3] = np.nan
    m = parse_metric(name, 3)
    got = exact.scored(frame(spark, x), frame(spark, y), m).collect()
    want = block_distances(m, x, y)
    assert len(got) == 42
    for r in got:
        assert r.distance == pytest.approx(want[r.query_id, r.id], rel=1e-9)


def test_metric_golden_values(spark):
    df = spark.createDataFrame([([2.0, 0.0], [0.0, 0.0])], "x array<float>, y array<float>")
    one = lambda m, p=2: df.select(distance(m, "x", "y", p).alias("d")).first().d
    assert one("lp", 3) == 8 and one("l2") == 4 and one("linf") == 2
    assert np.isnan(one("canberra")) and one("braycurtis") == 1 and np.isnan(one("jensenshannon")) and np.isnan(one("gower"))


@pytest.mark.parametrize("metric", ["l2", "ip", "l1", "jaccard"])
def test_strategies_agree_and_match_brute_force(spark, metric):
    x, q = uniform(300, 8, 12345), uniform(20, 8, 67890)
    m = parse_metric(metric)
    want = block_distances(m, q, x)
    for strategy in ("arrow", "sql"):
        got = exact.knn(frame(spark, q), frame(spark, x), 7, metric, strategy=strategy).collect()
        for i in range(20):
            order = np.argsort(-want[i] if m.larger_is_better else want[i], kind="stable")[:7]
            assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == order.tolist()


def test_ties_nan_and_short_results(spark):
    base = frame(spark, [[1.0], [1.0], [np.nan], [0.0]])
    got = exact.knn(frame(spark, [[0.5]]), base, 10).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 3]
    padded = exact.padded(exact.knn(frame(spark, [[0.5]]), base, 5), frame(spark, [[0.5]]), 5).orderBy("rank").collect()
    assert [r.id for r in padded] == [0, 1, 3, -1, -1] and padded[4].distance == float("inf")


def test_range_bounds(spark):
    q, b = frame(spark, [[0.0]]), frame(spark, [[1.0], [2.0]])
    assert exact.range_search(q, b, 1.0).count() == 0
    assert exact.range_search(q, b, 1.0, inclusive=True).count() == 1
    assert exact.range_search(q, b, 1.0, strategy="sql").count() == 0


def test_flat1d_takes_the_nearest(spark):
    b = spark.createDataFrame([(i, float(i * i)) for i in range(50)], "id long, x double")
    q = spark.createDataFrame([(0, 10.0)], "id long, x double")
    assert [r.id for r in exact.flat1d(q, b, 3).orderBy("rank").collect()] == [3, 2, 4]


def test_selectors(spark):
    df = spark.range(64).select("id")
    pick = lambda s: {r.id for r in selectors.select_ids(df, s).collect()}
    a, b = selectors.id_range(5, 20), selectors.id_array([3, 7, 30])
    assert pick(selectors.both(a, b)) == {7} and pick(selectors.either(a, b)) == set(range(5, 20)) | {3, 30}
    assert pick(selectors.differ(a, b)) == (set(range(5, 20)) - {7}) | {3, 30}
    assert pick(selectors.id_bitmap(bytes([0b10000001, 2]))) == {0, 7, 9}
    assert pick(selectors.id_call(lambda i: i % 10 == 0)) == {0, 10, 20, 30, 40, 50, 60}
    assert pick(selectors.negate(selectors.every())) == set()


def test_filter_expressions():
    assert selectors.parse_filter("a == 'x' AND b==\"y z\" and c == 3") == [("a", "x"), ("b", "y z"), ("c", "3")]
    assert selectors.parse_filter(" k=='this and that' and  _m1 == -2.5 ") == [("k", "this and that"), ("_m1", "-2.5")]
    for bad in ("a > 3", "a == ", "a = 3", "a === 3", "a == =", "== 3", "a 3", "1a == 3", "a == 'x", "a == 1 and", "and a == 1", "a == 1 b == 2", "a == 'x' or b == 'y'", "", " "):
        with pytest.raises(ValueError):
            selectors.parse_filter(bad)


def test_topk_helpers(spark):
    rows = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "id long, b int")
    got = topk.bucket_sort(rows, "b", 3).orderBy("bucket").collect()
    assert [(r.bucket, r.lim, r.ids) for r in got] == [(0, 0, [1]), (1, 1, []), (2, 1, [0, 2])]
    with pytest.raises(ValueError):
        topk.bucket_sort(rows, "b", 2)
    vals = spark.createDataFrame([(i, float((i * 7) % 11)) for i in range(11)], "id long, v double")
    order = [r.id for r in topk.argsort(vals, "v").orderBy("place").collect()]
    assert order == sorted(range(11), key=lambda i: (i * 7) % 11)


def test_kmeans_separates_clusters_and_checks_input(spark):
    rng = np.random.RandomState(7)
    x = np.concatenate([rng.uniform(-1, 1, (30, 3)) + c for c in ([10, 10, -10], [-10, 10, 10], [10, -10, 10])])
    r = kmeans.kmeans(frame(spark, x), 3, niter=6, nredo=3)
    assert r.loss < 2 * x.size and r.loss <= kmeans.kmeans(frame(spark, x), 3, niter=6).loss + 1e-4
    unit = kmeans.kmeans(frame(spark, x), 3, niter=3, metric="ip").centroids
    assert np.allclose(np.linalg.norm(unit, axis=1), 1)
    for bad in ({"k": 100}, {"k": 3, "niter": 0}, {"k": 3, "metric": "l1"}):
        with pytest.raises(ValueError):
            kmeans.kmeans(frame(spark, x), **bad)
    again = kmeans.kmeans(frame(spark, np.repeat([[0.0, 0.0], [5.0, 5.0]], 4, axis=0)), 4, niter=4).centroids
    assert len(np.unique(again, axis=0)) == 4


def test_sample_positions_are_distinct():
    assert sorted(kmeans.sample_positions(20, 20, 5)) == list(range(20))


def test_bit_packing_round_trip():
    for nbits in (1, 4, 6, 7, 8, 10, 16):
        v = np.random.RandomState(nbits).randint(0, 1 << nbits, (13, 5))
        assert (codecs.unpack_bits(codecs.pack_bits(v, nbits), nbits, 5) == v).all()


def test_quantizers(spark):
    x = 5 * uniform(1200, 16, 1)
    q = 5 * uniform(20, 16, 2)
    pq = codecs.ProductQuantizer.train(x, 8, 6, 8)
    codes = pq.encode(x)
    assert np.allclose(pq.distances(q, codes), block_distances(parse_metric("l2"), q, pq.decode(codes)), rtol=1e-6)
    truth = exact.knn(frame(spark, q), frame(spark, x), 10)
    found = codecs.code_search(frame(spark, q), codecs.encode(frame(spark, x), pq), pq, 10)
    assert topk.recall(found, truth, 10) > 0.4
    lvq = codecs.LocalQuantizer.train(x, 8, 5, 6)
    assert np.allclose(lvq.distances(q, lvq.encode(x)), block_distances(parse_metric("l2"), q, lvq.decode(lvq.encode(x))), rtol=1e-6)
    with pytest.raises(ValueError):
        codecs.ProductQuantizer.train(x, 7)


def test_inverted_lists(spark):
    x, q = 5 * uniform(1500, 16, 5), 5 * uniform(20, 16, 6)
    b, qs = frame(spark, x), frame(spark, q)
    truth = exact.knn(qs, b, 10).persist()
    index = ivf.IVFIndex.train(b, 16, niter=4).add(b)
    got = [topk.recall(index.search(qs, 10, p), truth, 10) for p in (1, 4, 16)]
    assert got[2] >= 0.99 and got[0] <= got[1] + 0.02 <= got[2] + 0.04
    coded = ivf.IVFIndex.train(b, 16, niter=4, pq_m=8, nbits=6).add(b)
    raw = ivf.IVFIndex.train(b, 16, niter=4, pq_m=8, nbits=6, by_residual=False).add(b)
    r, s = (topk.recall(i.search(qs, 10, 16), truth, 10) for i in (coded, raw))
    assert r > 0.4 and r >= s - 0.05
    assert index.list_sizes().agg(F.sum("n")).first()[0] == 1500
    with pytest.raises(ValueError):
        ivf.IVFIndex(np.zeros((2, 2)), "l1")


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_graph_recall(spark, metric):
    x, q = uniform(600, 16, 12345), uniform(30, 16, 67890)
    truth = exact.knn(frame(spark, q), frame(spark, x), 10, metric).persist()
    g = graph.GraphIndex(m=16, metric=metric, shards=2).add(frame(spark, x))
    g.nodes = g.nodes.persist()
    assert topk.recall(g.search(frame(spark, q), 10, 32), truth, 10) > 0.8
    stats = graph.edge_stats(g.edges()).first()
    assert stats.nodes == 600 and stats.links >= 600
    g.freeze()
    with pytest.raises(ValueError):
        g.add(frame(spark, x))


def test_maintenance(spark):
    rows = frame(spark, uniform(10, 2, 3))
    left = maintenance.remove_ids(rows, spark.range(3).select("id"))
    assert sorted(r.id for r in left.collect()) == list(range(7))
    with pytest.raises(ValueError):
        maintenance.reconstruct(rows, 8, 5)
    ok = maintenance.label_map_errors(rows, "id", "vec", 2).first()
    assert ok.contiguous and ok.same_dim


def test_graph_search_with_a_condition_is_complete_and_ranges_are_exact(spark):
    rng = np.random.RandomState(12)
    x, q = rng.uniform(size=(300, 4)), rng.uniform(size=(10, 4))
    g = graph.GraphIndex(m=8, ef_search=16, shards=2).add(frame(spark, x))
    got = g.search(frame(spark, q), 5, condition=F.col("id") % 30 == 0).collect()
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    assert {(r.query_id, r.id) for r in got} == {(i, int(j) * 30) for i in range(10) for j in np.argsort(d[i, ::30])[:5]}
    near = {(r.query_id, r.id) for r in g.range_search(frame(spark, q), 0.1).collect()}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d < 0.1))}
    assert near <= want and len(near) >= 0.9 * len(want)


def test_argsort_splits_common_values(spark):
    """A value that most rows share spans ranges; null comes first."""
    vals = [(i, None if i % 50 == 0 else 7.0 if i % 3 else float(i % 11)) for i in range(900)]
    rows = spark.createDataFrame(vals, "id long, v double").repartition(5)
    got = topk.argsort(rows, "v").orderBy("place").collect()
    want = sorted(vals, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert [(r.place, r.id) for r in got] == [(p, i) for p, (i, _) in enumerate(want)]
    parts = rows.groupBy(topk.range_of(rows, ["v", "id"]).alias("p")).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 600
    assert topk.argsort(rows.where("id < 0"), "v").count() == 0
    assert [r.place for r in topk.argsort(rows.where("id = 3"), "v").collect()] == [0]


def test_range_of_in_two_steps(spark):
    rows = spark.range(3000).selectExpr("id", "cast(id * 7919 % 1000 as double) v")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        parts = rows.select("v", "id", topk.range_of(rows, ["v", "id"]).alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = [r.p for r in sorted(parts)]
    assert order == sorted(order) and set(order) == set(range(30))


def test_flat1d_against_brute_force(spark):
    """Ties on both sides, many rows of one number, more neighbours asked than there are, and empty sides."""
    r = np.random.RandomState(5)
    base = [(i, float(x)) for i, x in enumerate(np.concatenate([r.randint(0, 40, 300), np.full(200, 17.0)]))] + [(900, None), (901, float("nan"))]
    asked = [(i, float(x)) for i, x in enumerate(r.randint(-5, 50, 60))] + [(70, 17.0), (71, 17.5), (72, None)]
    b, q = spark.createDataFrame(base, "id long, x double"), spark.createDataFrame(asked, "id long, x double")
    for k, most in ((6, 10**9), (8, 4)):
        held = [(i, x) for i, x in base if x is not None and x == x and i < most]
        want = {(qi, n + 1, i, d) for qi, y in asked if y is not None for n, (d, i) in enumerate(sorted((abs(x - y), i) for i, x in held)[:k])}
        assert {tuple(r) for r in exact.flat1d(q, b.where(f"id < {most}"), k).collect()} == want
    assert exact.flat1d(q, b.where("id < 0"), 3).count() == 0 and exact.flat1d(q.where("id < 0"), b, 3).count() == 0


ODD = [[float("nan"), 0.5, 0.25], [0.1, None, 0.3], None, [0.5, 0.5], [], [1.0, 0.0, 0.0]]


def odd_frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, r) for i, r in enumerate([*x.tolist(), *ODD])], "id long, vec array<double>")


@pytest.mark.parametrize("metric", METRICS)
def test_compiled_search_takes_every_row(spark, metric):
    """The compiled condition gives the rows of the lambdas, with ties, NaN, nulls and other lengths, over both joins."""
    x = uniform(200, 3, 5).round(1)
    x[40:120] = x[0]
    base, q = odd_frame(spark, x), odd_frame(spark, x[:12], 300)
    key = lambda df: sorted((r.query_id, r.rank, r.id, round(r.distance, 9)) for r in df.collect())
    want = key(exact.knn(q, base, 7, metric, 3, "sql"))
    assert want and key(exact.knn(q, base, 7, metric, 3, "sql", dim=3)) == want
    alone = exact.knn(base, base, 3, metric, 3, "sql", exclude_self=True, dim=3).collect()
    assert alone and all(r.query_id != r.id for r in alone)


def test_compiled_search_sorts_few_pairs(spark):
    """Most pairs fail the join's condition, so that they are not sorted."""
    x = uniform(2000, 3, 9)
    few = exact.wide_top(frame(spark, x[:20]), frame(spark, x), 5, parse_metric("l2"), 3)
    assert few.count() < 0.5 * 20 * 2000


def test_ip_to_l2_in_blocks_keeps_every_pair(spark):
    from vecspark.functions import vectors as V

    x, y = odd_frame(spark, uniform(5, 3, 1)), odd_frame(spark, uniform(9, 3, 2), 50)
    got = {(r.query_id, r.id): r.distance for r in exact.pairwise_ip_to_l2(x, y, 3).collect()}
    p = x.select(F.col("id").alias("i"), F.col("vec").alias("x")).crossJoin(y.select(F.col("id").alias("j"), F.col("vec").alias("y")))
    want = {(r.i, r.j): r.d for r in p.select("i", "j", V.ip_to_l2(V.norm2("x"), V.norm2("y"), distance("ip", "x", "y")).alias("d")).collect()}
    assert got.keys() == want.keys() and len(got) == 11 * 15
    for k, d in want.items():
        assert got[k] is None if d is None else got[k] == pytest.approx(d, abs=1e-9, nan_ok=True)


def test_graph_shards_are_bounded(spark, monkeypatch):
    """A shard's rows are bounded, however few shards are asked, and graphs of common vectors are found whole."""
    monkeypatch.setattr(graph, "SHARD_ROWS", 250)
    x = uniform(900, 8, 3)
    x[100:140] = x[0]
    g = graph.GraphIndex(m=8, shards=1).add(frame(spark, x))
    g.nodes = g.nodes.persist()
    assert g.nodes.groupBy("shard").count().agg(F.max("count")).first()[0] < 330 and g.nodes.count() == 900
    hits = g.search(frame(spark, x[:30]), 10, 32).collect()
    d = np.sort(((x[:30, None] - x[None]) ** 2).sum(2), 1)[:, 9]
    assert np.mean([r.distance <= d[r.query_id] + 1e-9 for r in hits]) >= 0.9 and len(hits) == 300
