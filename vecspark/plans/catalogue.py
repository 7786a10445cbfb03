"""The registered queries of the vector engine and their SQL twins.

Queries are the vectors whose vec_id is divisible by 20 and the base is all vectors; trained artefacts are fixed
(centroids are the vectors with vec_id < 16), so that SQL can state every result. Distances are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.metrics import distance
from ..operators import codecs, exact, graph, ivf, kmeans, maintenance, selectors, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
D = 64


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, change: str | None = None) -> DataFrame:
    """(id, vec); change: an expression of v (the vector as doubles) and id."""
    e = table(spark, sf_dir, "embeddings")
    if change is None:
        return exact.vectors(e)
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).select("id", F.expr(change).alias("vec"))


def sides(spark: SparkSession, sf_dir: str, change: str | None = None) -> tuple[DataFrame, DataFrame]:
    b = base(spark, sf_dir, change)
    return asked(b), b


def asked(b: DataFrame) -> DataFrame:
    """The rows of b that are queries."""
    return b.where("id % 20 = 0")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("distance", F.round("distance", digits) + F.lit(0.0))


# --- the SQL side ---------------------------------------------------------------------------------
def _sum(term: str, n: int = D) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {term}))"


X, Y = "q.v[i]", "b.v[i]"
SQL_DISTANCE = {
    "l2": _sum(f"({X} - {Y}) ** 2"),
    "ip": _sum(f"{X} * {Y}"),
    "l1": _sum(f"abs({X} - {Y})"),
    "linf": f"list_max(list_transform(range(1, {D + 1}), lambda i: abs({X} - {Y})))",
    "lp": _sum(f"abs({X} - {Y}) ** 3"),
    "canberra": _sum(f"CASE WHEN abs({X}) + abs({Y}) = 0 THEN 'nan'::double ELSE abs({X} - {Y}) / (abs({X}) + abs({Y})) END"),
    "braycurtis": f"({_sum(f'abs({X} - {Y})')} / {_sum(f'abs({X} + {Y})')})",
    "jensenshannon": f"0.5::double * {_sum(f'-{X} * ln(({X} + {Y}) / 2 / {X}) - {Y} * ln(({X} + {Y}) / 2 / {Y})')}",
    "jaccard": f"({_sum(f'least({X}, {Y})')} / {_sum(f'greatest({X}, {Y})')})",
    "nan_euclidean": f"({D}.0::double / {_sum(f'CASE WHEN isnan({X}) OR isnan({Y}) THEN 0 ELSE 1 END')} * {_sum(f'CASE WHEN isnan({X}) OR isnan({Y}) THEN 0::double ELSE ({X} - {Y}) ** 2 END')})",
    "gower": f"({_sum(f'abs({X} - {Y})')} / {D})",
}
#: What the vectors become, in Spark and in SQL, so that a metric's domain holds.
CHANGES = {
    "jaccard": ("transform(v, x -> abs(x) + 0.001D)", "list_transform(v, lambda x: abs(x) + 0.001::double)"),
    "jensenshannon": ("transform(v, x -> abs(x) + 0.001D)", "list_transform(v, lambda x: abs(x) + 0.001::double)"),
    "gower": ("transform(v, x -> (x + 1D) / 2D)", "list_transform(v, lambda x: (x + 1) / 2)"),
    "nan_euclidean": (
        "transform(v, (x, i) -> if((id + i + 1) % 7 = 0, double('NaN'), x))",
        "list_transform(v, lambda x, i: CASE WHEN (vec_id + i) % 7 = 0 THEN 'nan'::double ELSE x END)",
    ),
}


def sql_sides(change: str = "v", asked: str = "id % 20 = 0") -> str:
    return f"""WITH e AS (SELECT vec_id AS id, embedding::double[] AS v, vec_id FROM embeddings), b AS (SELECT id, {change} AS v FROM e), q AS (SELECT id AS qid, v FROM b WHERE {asked})"""


def sql_top(scored: str, k: int = 10, larger: bool = False, extra: str = "") -> str:
    """scored: a SELECT of qid, id, d."""
    return f"""SELECT qid AS query_id, rank, id, round(d, 6) + 0.0 AS distance{extra} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d {'DESC' if larger else 'ASC'}, id) AS rank FROM ({scored}) WHERE NOT isnan(d)) WHERE rank <= {k}"""


def sql_knn(metric: str, k: int = 10, change: str = "v", where: str = "true", asked: str = "id % 20 = 0") -> str:
    larger = metric in ("ip", "jaccard")
    return f"{sql_sides(change, asked)} {sql_top(f'SELECT qid, b.id, {SQL_DISTANCE[metric]} AS d FROM q, b WHERE {where}', k, larger)}"


# --- exact search ----------------------------------------------------------------------------------
def _knn(metric: str, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, b = sides(spark, sf_dir, CHANGES.get(metric, (None,))[0])
        return rounded(exact.knn(q, b, 10, metric, p=3, strategy=strategy, dim=D))

    return run


for _m in SQL_DISTANCE:
    _name = {"lp": "knn_lp3"}.get(_m, f"knn_{_m}")
    query(_name, sql_knn(_m, change=CHANGES.get(_m, ("", "v"))[1]))(_knn(_m, "arrow"))
query("knn_l2_catalyst", sql_knn("l2"))(_knn("l2", "sql"))
query("knn_gower_catalyst", sql_knn("gower", change=CHANGES["gower"][1]))(_knn("gower", "sql"))
query("knn_nan_euclidean_catalyst", sql_knn("nan_euclidean", change=CHANGES["nan_euclidean"][1]))(_knn("nan_euclidean", "sql"))
query("knn_jensenshannon_catalyst", sql_knn("jensenshannon", change=CHANGES["jensenshannon"][1]))(_knn("jensenshannon", "sql"))
query("knn_canberra_catalyst", sql_knn("canberra"))(_knn("canberra", "sql"))
query("knn_braycurtis_catalyst", sql_knn("braycurtis"))(_knn("braycurtis", "sql"))


@query("knn_cosine", sql_knn("ip", change="list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"))
def knn_cosine(spark, sf_dir):
    return rounded(exact.cosine_knn(*sides(spark, sf_dir), 10))


@query("knn_self_excluding", sql_knn("l2", where="qid <> b.id"))
def knn_self_excluding(spark, sf_dir):
    return rounded(exact.knn(*sides(spark, sf_dir), 10, exclude_self=True))


@query("knn_all_pairs", sql_knn("l2", 5, asked="true"))
def knn_all_pairs(spark, sf_dir):
    b = base(spark, sf_dir)
    return rounded(exact.knn(b, b, 5))


@query("assign", f"SELECT query_id, id FROM ({sql_knn('l2', 1)})")
def assign(spark, sf_dir):
    return exact.assign(*sides(spark, sf_dir))


@query("search_and_reconstruct", f"SELECT s.*, list_transform(e.embedding, lambda x: round(x::double, 6)) AS vec FROM ({sql_knn('l2', 3)}) s JOIN embeddings e ON s.id = e.vec_id")
def search_and_reconstruct(spark, sf_dir):
    r = rounded(exact.search_and_reconstruct(*sides(spark, sf_dir), 3))
    return r.withColumn("vec", F.expr("transform(vec, x -> round(cast(x as double), 6))"))


@query("knn_padded", f"SELECT g.qid AS query_id, g.r AS rank, coalesce(k.id, -1) AS id, coalesce(k.distance, 'inf'::double) AS distance FROM (SELECT vec_id AS qid, r FROM embeddings, range(1, 13) t(r) WHERE vec_id % 20 = 0) g LEFT JOIN ({sql_knn('l2', 12, where='b.id < 9')}) k ON g.qid = k.query_id AND g.r = k.rank")
def knn_padded(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return exact.padded(rounded(exact.knn(q, b.where("id < 9"), 12)), q, 12)


def _range(metric: str, op: str, radius: float) -> str:
    return f"{sql_sides()} SELECT qid AS query_id, id, round(d, 6) + 0.0 AS distance FROM (SELECT qid, b.id, {SQL_DISTANCE[metric]} AS d FROM q, b) WHERE d {op} {radius}"


@query("range_l2", _range("l2", "<", 1.5))
def range_l2(spark, sf_dir):
    return rounded(exact.range_search(*sides(spark, sf_dir), 1.5))


@query("range_ip", _range("ip", ">", 0.2))
def range_ip(spark, sf_dir):
    return rounded(exact.range_search(*sides(spark, sf_dir), 0.2, "ip"))


@query("range_l1_catalyst", _range("l1", "<=", 8.0))
def range_l1_catalyst(spark, sf_dir):
    return rounded(exact.range_search(*sides(spark, sf_dir), 8.0, "l1", inclusive=True, strategy="sql"))


@query("range_l2_limits", f"SELECT v.vec_id AS query_id, coalesce(n, 0) AS n, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY v.vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS lim FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) v LEFT JOIN (SELECT query_id, count(*) AS n FROM ({_range('l2', '<', 1.5)}) GROUP BY query_id) h ON v.vec_id = h.query_id")
def range_l2_limits(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return exact.range_limits(q, exact.range_search(q, b, 1.5))


@query("pairwise_l2", f"{sql_sides()} SELECT qid AS query_id, b.id, round({SQL_DISTANCE['l2']}, 6) + 0.0 AS distance FROM q, b")
def pairwise_l2(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(exact.pairwise(q, b))


@query("pairwise_canberra", f"{sql_sides()} SELECT qid AS query_id, b.id, round({SQL_DISTANCE['canberra']}, 6) + 0.0 AS distance FROM q, b")
def pairwise_canberra(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(exact.pairwise(q, b, "canberra"))


@query("pairwise_indexed_ip", f"{sql_sides()}, p AS (SELECT id AS pos, id AS ix, CASE WHEN id % 5 = 0 THEN -1 ELSE id + 7 END AS iy FROM b) SELECT p.pos, p.ix, p.iy, CASE WHEN b.id IS NULL THEN '-inf'::double ELSE round({SQL_DISTANCE['ip'].replace('q.v', 'x.v')}, 6) + 0.0 END AS distance FROM p JOIN b x ON x.id = p.ix LEFT JOIN b ON b.id = p.iy")
def pairwise_indexed_ip(spark, sf_dir):
    b = base(spark, sf_dir)
    pairs = b.select(F.col("id").alias("pos"), F.col("id").alias("ix"), F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id") + 7).alias("iy"))
    return rounded(exact.pairwise_indexed(pairs, b, b, "ip"))


def _listed(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return q.withColumn("ids", F.expr("transform(sequence(0, 9), i -> if(i = 8 and id % 2 = 0, -1L, id * 3 + i * i))")), b


_LISTED = f"{sql_sides()}, l AS (SELECT qid, v, i AS place, CASE WHEN i = 8 AND qid % 2 = 0 THEN -1 ELSE qid * 3 + i * i END AS id FROM q, range(10) r(i))"


@query("distances_by_id", f"{_LISTED} SELECT qid AS query_id, place, l.id, CASE WHEN b.id IS NULL THEN 'inf'::double ELSE round({SQL_DISTANCE['l2'].replace('q.v', 'l.v')}, 6) + 0.0 END AS distance FROM l LEFT JOIN b ON b.id = l.id")
def distances_by_id(spark, sf_dir):
    return rounded(exact.distances_by_id(*_listed(spark, sf_dir)))


@query("knn_subset", f"{_LISTED} {sql_top('SELECT qid, l.id, ' + SQL_DISTANCE['l2'].replace('q.v', 'l.v') + ' AS d FROM l JOIN b ON b.id = l.id WHERE NOT (qid % 2 = 0 AND place >= 8)', 5)}")
def knn_subset(spark, sf_dir):
    return rounded(exact.knn_subset(*_listed(spark, sf_dir), 5))


@query("merge_shards", sql_knn("l2"))
def merge_shards(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(exact.merge_knn([exact.knn(q, b.where(F.pmod("id", F.lit(3)) == i), 10) for i in range(3)], 10))


@query("rerank", f"{sql_sides()}, c AS (SELECT * FROM (SELECT qid, b.id, {SQL_DISTANCE['l2']} AS d, row_number() OVER (PARTITION BY qid ORDER BY {SQL_DISTANCE['l1']}, b.id) AS r FROM q, b) WHERE r <= 30) {sql_top('SELECT qid, id, d FROM c', 10)}")
def rerank(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(exact.rerank(exact.knn(q, b, 30, "l1"), q, b, 10))


@query("flat1d", "WITH b AS (SELECT o_orderkey AS id, o_totalprice AS x FROM orders), q AS (SELECT o_orderkey AS qid, o_totalprice + 0.5 AS y FROM orders WHERE o_orderkey % 100 = 0) SELECT qid AS query_id, rank, id, round(d, 6) + 0.0 AS distance FROM (SELECT qid, id, abs(x - y) AS d, row_number() OVER (PARTITION BY qid ORDER BY abs(x - y), id) AS rank FROM q, b) WHERE rank <= 5")
def flat1d(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    q = b.where("id % 100 = 0").withColumn("x", F.col("x") + 0.5)
    return rounded(exact.flat1d(q, b, 5))


@query("id_map_search", f"SELECT query_id, rank, id * 10 + 7 AS id, distance FROM ({sql_knn('l2')})")
def id_map_search(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(exact.with_id_map(exact.knn(q, b, 10), b.select("id", (F.col("id") * 10 + 7).alias("external_id"))))


# --- selectors and filters ---------------------------------------------------------------------------
_BITS = bytes((7 * i + 3) % 256 for i in range(40))
_SELECTORS = {
    "sel_range": (selectors.id_range(30, 200), "b.id >= 30 AND b.id < 200"),
    "sel_array": (selectors.id_array([3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377]), "b.id IN (3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377)"),
    "sel_bitmap": (selectors.id_bitmap(_BITS), "b.id IN (" + ", ".join(str(i) for i in range(320) if _BITS[i >> 3] >> (i & 7) & 1) + ")"),
    "sel_not": (selectors.negate(selectors.id_range(30, 200)), "NOT (b.id >= 30 AND b.id < 200)"),
    "sel_and": (selectors.both(selectors.id_range(30, 200), selectors.id_range(100, 300)), "b.id >= 100 AND b.id < 200"),
    "sel_or": (selectors.either(selectors.id_range(30, 60), selectors.id_range(100, 130)), "b.id BETWEEN 30 AND 59 OR b.id BETWEEN 100 AND 129"),
    "sel_xor": (selectors.differ(selectors.id_range(30, 200), selectors.id_range(100, 300)), "b.id BETWEEN 30 AND 99 OR b.id BETWEEN 200 AND 299"),
    "sel_all": (selectors.every(), "true"),
    "sel_udf": (selectors.id_call(lambda i: i % 3 == 1), "b.id % 3 = 1"),
}


def _selected(s: selectors.Selector):
    def run(spark, sf_dir):
        q, b = sides(spark, sf_dir)
        return rounded(exact.knn(q, selectors.select_ids(b, s), 10))

    return run


for _name, (_s, _where) in _SELECTORS.items():
    query(_name, sql_knn("l2", where=f"({_where})"))(_selected(_s))


@query("sel_batch", sql_knn("l2", where="b.id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def sel_batch(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(exact.knn(q, selectors.select_batch(b, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))), 10))


def _labelled(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return asked(e).select("id", "vec"), e


@query("filter_pre", sql_knn("l2", where="b.id IN (SELECT vec_id FROM embeddings WHERE label = 3)"))
def filter_pre(spark, sf_dir):
    return rounded(selectors.filtered_knn(*_labelled(spark, sf_dir), 10, F.col("label") == 3))


@query("filter_post8", f"WITH k AS ({sql_knn('l2', 80)}) SELECT query_id, rank, id, distance FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY k.rank) AS rank FROM k JOIN embeddings e ON k.id = e.vec_id WHERE label = 3) WHERE rank <= 10")
def filter_post8(spark, sf_dir):
    return rounded(selectors.filtered_knn(*_labelled(spark, sf_dir), 10, F.col("label") == 3, mode="post"))


@query("filter_expression", "SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND source = 'src3'")
def filter_expression(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("metadata", F.to_json(F.struct("source", "n_chars")))
    return d.where(selectors.filter_column("lang == 'en' AND source == \"src3\"", {"lang": F.col("lang")}, F.col("metadata"))).select("doc_id", "source", "lang")


@query("output_projection", "SELECT vec_id, label FROM embeddings")
def output_projection(spark, sf_dir):
    return selectors.project(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec"))


# --- vector functions ---------------------------------------------------------------------------------
def _elements(make: Callable[[], Column], sql: str):
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings")
        other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
        r = e.join(other, "vec_id").select("vec_id", make().alias("r"))
        return r.select("vec_id", F.expr("transform(r, x -> round(x, 6) + 0D)").alias("r"))

    return run, f"SELECT a.vec_id, list_transform({sql}, lambda x: round(x, 6) + 0.0) AS r FROM (SELECT vec_id, embedding::double[] AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, embedding::double[] AS y FROM embeddings) b ON a.vec_id = b.vec_id"


def _each(term: str) -> str:
    return f"list_transform(range(1, {D + 1}), lambda i: {term})"


for _name, (_make, _sql) in {
    "vec_add": (lambda: V.add("embedding", "other"), _each("a.x[i] + b.y[i]")),
    "vec_sub": (lambda: V.sub("embedding", "other"), _each("a.x[i] - b.y[i]")),
    "vec_add_scalar": (lambda: V.add_scalar("embedding", 0.25), _each("a.x[i] + 0.25::double")),
    "vec_madd": (lambda: V.madd("embedding", 2.5, "other"), _each("a.x[i] + 2.5::double * b.y[i]")),
    "normalize": (lambda: V.normalize("embedding"), _each("a.x[i] / sqrt(list_sum(list_transform(a.x, lambda z: z * z)))")),
}.items():
    _f, _s = _elements(_make, _sql)
    query(_name, _s)(_f)


@query("norms", "SELECT vec_id, round(sqrt(n), 6) AS norm, round(n, 6) AS norm2 FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::double * x::double)) AS n FROM embeddings)")
def norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"), F.round(V.norm2("embedding"), 6).alias("norm2"))


@query("madd_argmin", "SELECT vec_id, (list_position(s, list_min(s)) - 1)::bigint AS at FROM (SELECT vec_id, list_transform(embedding, lambda x: x::double * 3 + x::double) AS s FROM embeddings)")
def madd_argmin(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.madd("embedding", 3.0, "embedding").alias("s")).select("vec_id", V.argmin("s").alias("at"))


@query("ip_to_l2", f"{sql_sides()} SELECT qid, b.id, round({SQL_DISTANCE['l2']}, 6) + 0.0 AS l2 FROM q, b")
def ip_to_l2(spark, sf_dir):
    p = exact.pairwise_ip_to_l2(*sides(spark, sf_dir), D)
    return p.select(F.col("query_id").alias("qid"), "id", (F.round("distance", 6) + F.lit(0.0)).alias("l2"))


# --- top-k helpers -------------------------------------------------------------------------------------
for _name, _big in (("kmin", False), ("kmax", True)):
    query(
        _name,
        f"SELECT id, rank, place, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value {'DESC' if _big else 'ASC'}, place) AS rank FROM (SELECT vec_id AS id, i AS place, embedding[i + 1]::double AS value FROM embeddings, range({D}) r(i))) WHERE rank <= 3",
    )(lambda spark, sf_dir, big=_big: topk.k_least(base(spark, sf_dir), 3, largest=big).withColumn("value", F.round("value", 6)))


@query("result_heap", sql_knn("l2"))
def result_heap(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    h = topk.ResultHeap(10)
    for low in (0, 100, 250):
        h.add(exact.knn(q, b.where((F.col("id") >= low) & (F.col("id") < {0: 100, 100: 250, 250: 1 << 40}[low])), 10))
    return rounded(h.finalize())


@query("per_line_extrema", f"SELECT query_id, id, distance FROM ({sql_knn('l2')}) WHERE rank = 10")
def per_line_extrema(spark, sf_dir):
    return rounded(topk.per_line_extrema(exact.knn(*sides(spark, sf_dir), 10)))


@query("argsort", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, o_orderkey AS id FROM orders")
def argsort(spark, sf_dir):
    return topk.argsort(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), "o_totalprice")


@query("bucket_sort", "SELECT b AS bucket, coalesce(sum(len(ids)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS lim, ids FROM (SELECT r.b, coalesce(ids, []::bigint[]) AS ids FROM range(12) r(b) LEFT JOIN (SELECT label AS b, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label) g ON r.b = g.b)")
def bucket_sort(spark, sf_dir):
    return topk.bucket_sort(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "label", 12)


@query("bucket_order", "SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS place, label::bigint AS bucket, vec_id AS id FROM embeddings")
def bucket_order(spark, sf_dir):
    return topk.bucket_order(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "label")


@query("matrix_bucket_sort", "SELECT b AS bucket, coalesce(sum(len(ids)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS lim, ids FROM (SELECT r.b, coalesce(ids, []::bigint[]) AS ids FROM range(8) r(b) LEFT JOIN (SELECT b, list(vec_id ORDER BY vec_id) AS ids FROM (SELECT vec_id, unnest([vec_id % 8, (vec_id * 3) % 8, label % 8]) AS b FROM embeddings) GROUP BY b) g ON r.b = g.b)")
def matrix_bucket_sort(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr("array(vec_id % 8, (vec_id * 3) % 8, cast(label % 8 as bigint))").alias("vec"))
    return topk.matrix_bucket_sort(e, 8)


@query("histogram16", "SELECT r.b AS bin, coalesce(n, 0) AS n FROM range(16) r(b) LEFT JOIN (SELECT (l_quantity::bigint - 5) >> 1 AS b, count(*) AS n FROM lineitem WHERE l_quantity::bigint >= 5 GROUP BY 1) h ON r.b = h.b")
def histogram16(spark, sf_dir):
    return topk.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 5, 1, 16)


@query("histogram8_raw", "SELECT r.b AS bin, coalesce(n, 0) AS n FROM range(8) r(b) LEFT JOIN (SELECT l_linenumber::bigint AS b, count(*) AS n FROM lineitem GROUP BY 1) h ON r.b = h.b")
def histogram8_raw(spark, sf_dir):
    return topk.histogram(table(spark, sf_dir, "lineitem"), "l_linenumber", 0, -1, 8)


@query("partition_smallest", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_totalprice, orders.o_orderkey LIMIT 100")
def partition_smallest(spark, sf_dir):
    return topk.smallest(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice")), "o_totalprice", 100, "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("hash_lookup", "SELECT p_partkey * 2 AS key, coalesce(p2.v, -1)::bigint AS value FROM part p LEFT JOIN (SELECT p_partkey AS k, p_size AS v FROM part) p2 ON p.p_partkey * 2 = p2.k")
def hash_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return topk.hash_lookup(p.select((F.col("p_partkey") * 2).alias("key")), p.select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("value")))


@query("recall_intersection", f"SELECT a.query_id, count(*) AS n FROM ({sql_knn('l2')}) a JOIN ({sql_knn('l1')}) b ON a.query_id = b.query_id AND a.id = b.id GROUP BY a.query_id")
def recall_intersection(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return topk.intersections(exact.knn(q, b, 10), exact.knn(q, b, 10, "l1"))


# --- lists, codes and clusters with fixed artefacts -------------------------------------------------------
def fixed_vectors(spark, sf_dir, n: int) -> np.ndarray:
    rows = base(spark, sf_dir).where(F.col("id") < n).orderBy("id").collect()  # n rows
    return np.array([r.vec for r in rows], np.float64)


_CENTROIDS = f"{sql_sides()}, c AS (SELECT id AS no, v FROM b WHERE id < 16), a AS (SELECT * FROM (SELECT b.id, c.no, {SQL_DISTANCE['l2'].replace('q.v', 'c.v')} AS d, row_number() OVER (PARTITION BY b.id ORDER BY {SQL_DISTANCE['l2'].replace('q.v', 'c.v')}, c.no) AS r FROM b, c))"


def fixed_ivf(spark, sf_dir, **options) -> ivf.IVFIndex:
    return ivf.IVFIndex(fixed_vectors(spark, sf_dir, 16), **options)


@query("ivf_assign", f"{_CENTROIDS} SELECT id, no::int AS list_no, (r - 1)::int AS place, round(d, 6) + 0.0 AS centroid_distance FROM a WHERE r <= 4")
def ivf_assign(spark, sf_dir):
    return fixed_ivf(spark, sf_dir).assign(base(spark, sf_dir), 4).drop("vec").withColumn("centroid_distance", F.round("centroid_distance", 6) + F.lit(0.0))


@query("ivf_list_sizes", f"{_CENTROIDS} SELECT no::int AS list_no, count(*) AS n FROM a WHERE r = 1 GROUP BY no")
def ivf_list_sizes(spark, sf_dir):
    return fixed_ivf(spark, sf_dir).add(base(spark, sf_dir)).list_sizes()


_PROBED = "SELECT p.id AS qid, l.id, {d} AS d FROM a p JOIN a l ON p.no = l.no AND l.r = 1 JOIN b q ON q.id = p.id JOIN b ON b.id = l.id WHERE p.id % 20 = 0 AND p.r <= 4"


@query("ivf_flat_nprobe4", f"{_CENTROIDS} {sql_top(_PROBED.format(d=SQL_DISTANCE['l2']))}")
def ivf_flat_nprobe4(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(fixed_ivf(spark, sf_dir).add(b).search(q, 10, 4))


@query("ivf_flat_exhaustive", sql_knn("l2"))
def ivf_flat_exhaustive(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(fixed_ivf(spark, sf_dir).add(b).search(q, 10, 16))


@query("ivf_range_inclusive", f"{_CENTROIDS} SELECT qid AS query_id, id, round(d, 6) + 0.0 AS distance FROM ({_PROBED.format(d=SQL_DISTANCE['l2'])}) WHERE d <= 1.6")
def ivf_range_inclusive(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(fixed_ivf(spark, sf_dir).add(b).range_search(q, 1.6, 4))


@query("ivf_search_preassigned", f"{_CENTROIDS} {sql_top('SELECT q.qid, l.id, ' + SQL_DISTANCE['l2'] + ' AS d FROM q JOIN a l ON l.no = q.qid % 16 AND l.r = 1 JOIN b ON b.id = l.id', 5)}")
def ivf_search_preassigned(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(fixed_ivf(spark, sf_dir).add(b).search_preassigned(q.withColumn("list_no", (F.col("id") % 16).cast("int")), 5))


@query("kmeans_one_step", f"{_CENTROIDS} SELECT no AS cluster, round(avg(b.v[1]), 6) + 0.0 AS x1, round(avg(b.v[64]), 6) + 0.0 AS x64 FROM a JOIN b ON a.id = b.id WHERE r = 1 GROUP BY no")
def kmeans_one_step(spark, sf_dir):
    sums, counts, _ = kmeans._step(base(spark, sf_dir), fixed_vectors(spark, sf_dir, 16), False)
    rows = [(i, float(s[0] / n), float(s[63] / n)) for i, (s, n) in enumerate(zip(sums, counts)) if n]
    out = spark.createDataFrame(rows, "cluster long, x1 double, x64 double")
    return out.select("cluster", (F.round("x1", 6) + F.lit(0.0)).alias("x1"), (F.round("x64", 6) + F.lit(0.0)).alias("x64"))


@query("residual", f"{_CENTROIDS} SELECT b.id, a.no::int AS list_no, list_transform(range(1, {D + 1}), lambda i: round(b.v[i] - c.v[i], 6) + 0.0) AS residual FROM a JOIN b ON a.id = b.id JOIN c ON a.no = c.no WHERE r = 1")
def residual(spark, sf_dir):
    rows = fixed_ivf(spark, sf_dir).assign(base(spark, sf_dir)).select("id", "vec", "list_no")
    c = base(spark, sf_dir).where("id < 16").select(F.col("id").cast("int").alias("list_no"), "vec")
    return maintenance.residual(rows, c).withColumn("residual", F.expr("transform(residual, x -> round(x, 6) + 0D)"))


def fixed_pq(spark, sf_dir) -> codecs.ProductQuantizer:
    return codecs.ProductQuantizer(fixed_vectors(spark, sf_dir, 16).reshape(16, 8, 8).transpose(1, 0, 2).copy(), 4)


_SUBD = "list_sum(list_transform(range(m * 8 + 1, m * 8 + 9), lambda i: (b.v[i] - c.v[i]) ** 2))"
_PQ = f"{sql_sides()}, c AS (SELECT id AS no, v FROM b WHERE id < 16), pq AS (SELECT id, m AS part, no AS number FROM (SELECT b.id, m, c.no, row_number() OVER (PARTITION BY b.id, m ORDER BY {_SUBD}, c.no) AS r FROM b, c, range(8) t(m)) WHERE r = 1), dec AS (SELECT pq.id, list(c.v[part * 8 + 1:part * 8 + 8] ORDER BY part) AS parts FROM pq JOIN c ON c.no = pq.number GROUP BY pq.id), y AS (SELECT id, flatten(parts) AS v FROM dec)"


@query("pq_encode", f"{_PQ} SELECT id, part, number FROM pq")
def pq_encode(spark, sf_dir):
    pq = fixed_pq(spark, sf_dir)
    return codecs.code_numbers(codecs.encode(base(spark, sf_dir), pq), pq)


@query("pq_decode_error", f"{_PQ} SELECT b.id, round({_sum('(b.v[i] - y.v[i]) ** 2')}, 6) + 0.0 AS error FROM b JOIN y ON b.id = y.id")
def pq_decode_error(spark, sf_dir):
    pq, b = fixed_pq(spark, sf_dir), base(spark, sf_dir)
    d = codecs.decode(codecs.encode(b, pq), pq).select("id", F.col("vec").alias("y"))
    return b.join(d, "id").select("id", (F.round(distance("l2", "vec", "y"), 6) + F.lit(0.0)).alias("error"))


@query("pq_adc", f"{_PQ} {sql_top('SELECT q.qid, y.id, ' + _sum('(q.v[i] - y.v[i]) ** 2') + ' AS d FROM q, y')}")
def pq_adc(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    pq = fixed_pq(spark, sf_dir)
    return rounded(codecs.code_search(q, codecs.encode(b, pq), pq, 10))


@query("pq_symmetric", f"{_PQ} SELECT x.id AS a, y.id AS b, round({_sum('(x.v[i] - y.v[i]) ** 2')}, 6) + 0.0 AS distance FROM y x, y WHERE x.id % 20 = 0")
def pq_symmetric(spark, sf_dir):
    pq = fixed_pq(spark, sf_dir)
    d = codecs.decode(codecs.encode(base(spark, sf_dir), pq), pq)
    p = asked(d).select(F.col("id").alias("a"), F.col("vec").alias("x")).crossJoin(d.select(F.col("id").alias("b"), F.col("vec").alias("y")))
    return rounded(p.select("a", "b", codecs.symmetric_distance("x", "y").alias("distance")))


def fixed_lvq(spark, sf_dir) -> codecs.LocalQuantizer:
    x = fixed_vectors(spark, sf_dir, 136)
    return codecs.LocalQuantizer(x[:8], np.stack([np.stack([x[c + 8 * (w + 1)] - x[c] for w in range(16)]) for c in range(8)]), 4)


_LD = _sum("(b.v[i] - w.v[i]) ** 2")
_LVQ = f"{sql_sides()}, w AS (SELECT c.id AS cell, n AS word, x.v AS v FROM b c, range(16) t(n), b x WHERE c.id < 8 AND x.id = c.id + 8 * (n + 1)), cells AS (SELECT id AS cell, v FROM b WHERE id < 8), near AS (SELECT id, cell FROM (SELECT b.id, w.cell, row_number() OVER (PARTITION BY b.id ORDER BY {_LD}, w.cell) AS r FROM b, cells w) WHERE r = 1), code AS (SELECT id, cell, word, v FROM (SELECT b.id, w.cell, w.word, w.v, row_number() OVER (PARTITION BY b.id ORDER BY {_LD}, w.word) AS r FROM b JOIN near ON near.id = b.id JOIN w ON w.cell = near.cell) WHERE r = 1)"


@query("lvq_encode", f"{_LVQ} SELECT id, p AS part, CASE p WHEN 0 THEN cell ELSE word END AS number FROM code, range(2) t(p)")
def lvq_encode(spark, sf_dir):
    q = fixed_lvq(spark, sf_dir)
    return codecs.code_numbers(codecs.encode(base(spark, sf_dir), q), q)


@query("lvq_adc", f"{_LVQ} {sql_top('SELECT q.qid, code.id, ' + _sum('(q.v[i] - code.v[i]) ** 2') + ' AS d FROM q, code')}")
def lvq_adc(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    lvq = fixed_lvq(spark, sf_dir)
    return rounded(codecs.code_search(q, codecs.encode(b, lvq), lvq, 10))


_IVFPQ = (
    f"{_CENTROIDS}, res AS (SELECT b.id, a.no, list_transform(range(1, {D + 1}), lambda i: b.v[i] - c.v[i]) AS v FROM a JOIN b ON a.id = b.id JOIN c ON c.no = a.no WHERE a.r = 1), "
    f"pq AS (SELECT id, m AS part, no AS number FROM (SELECT b.id, m, c.no, row_number() OVER (PARTITION BY b.id, m ORDER BY {_SUBD}, c.no) AS r FROM res b, c, range(8) t(m)) WHERE r = 1), "
    f"dec AS (SELECT pq.id, flatten(list(c.v[part * 8 + 1:part * 8 + 8] ORDER BY part)) AS v FROM pq JOIN c ON c.no = pq.number GROUP BY pq.id), "
    f"y AS (SELECT dec.id, list_transform(range(1, {D + 1}), lambda i: dec.v[i] + c.v[i]) AS v FROM dec JOIN res ON res.id = dec.id JOIN c ON c.no = res.no)"
)


@query("ivfpq", f"{_IVFPQ} {sql_top('SELECT p.id AS qid, l.id, ' + _sum('(q.v[i] - y.v[i]) ** 2') + ' AS d FROM a p JOIN a l ON p.no = l.no AND l.r = 1 JOIN b q ON q.id = p.id JOIN y ON y.id = l.id WHERE p.id % 20 = 0 AND p.r <= 4')}")
def ivfpq(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(fixed_ivf(spark, sf_dir, quantizer=fixed_pq(spark, sf_dir)).add(b).search(q, 10, 4))


@query("ivfpq_raw", f"{_CENTROIDS}, pq AS (SELECT id, m AS part, no AS number FROM (SELECT b.id, m, c.no, row_number() OVER (PARTITION BY b.id, m ORDER BY {_SUBD}, c.no) AS r FROM b, c, range(8) t(m)) WHERE r = 1), y AS (SELECT pq.id, flatten(list(c.v[part * 8 + 1:part * 8 + 8] ORDER BY part)) AS v FROM pq JOIN c ON c.no = pq.number GROUP BY pq.id) {sql_top('SELECT p.id AS qid, l.id, ' + _sum('(q.v[i] - y.v[i]) ** 2') + ' AS d FROM a p JOIN a l ON p.no = l.no AND l.r = 1 JOIN b q ON q.id = p.id JOIN y ON y.id = l.id WHERE p.id % 20 = 0 AND p.r <= 4')}")
def ivfpq_raw(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(fixed_ivf(spark, sf_dir, quantizer=fixed_pq(spark, sf_dir), by_residual=False).add(b).search(q, 10, 4))


@query("ivflvq", f"{_LVQ}, c AS (SELECT id AS no, v FROM b WHERE id < 16), a AS (SELECT * FROM (SELECT b.id, c.no, row_number() OVER (PARTITION BY b.id ORDER BY {SQL_DISTANCE['l2'].replace('q.v', 'c.v')}, c.no) AS r FROM b, c)) {sql_top('SELECT p.id AS qid, l.id, ' + _sum('(q.v[i] - y.v[i]) ** 2') + ' AS d FROM a p JOIN a l ON p.no = l.no AND l.r = 1 JOIN b q ON q.id = p.id JOIN code y ON y.id = l.id WHERE p.id % 20 = 0 AND p.r <= 4')}")
def ivflvq(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(fixed_ivf(spark, sf_dir, quantizer=fixed_lvq(spark, sf_dir), by_residual=False).add(b).search(q, 10, 4))


# --- maintenance ---------------------------------------------------------------------------------------
def _first(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(F.col("vec")[0].cast("double"), 6).alias("x1"))


@query("remove_ids", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, round(embedding[1]::double, 6) AS x1 FROM embeddings WHERE vec_id % 7 <> 3")
def remove_ids(spark, sf_dir):
    b = base(spark, sf_dir)
    return _first(maintenance.remove_ids(b, b.where("id % 7 = 3").select("id")))


@query("merge_from", "SELECT vec_id AS id, round(embedding[1]::double, 6) AS x1 FROM embeddings UNION ALL SELECT vec_id + (SELECT count(*) FROM embeddings), round(embedding[1]::double, 6) FROM embeddings WHERE vec_id < 50")
def merge_from(spark, sf_dir):
    b = base(spark, sf_dir)
    return _first(maintenance.append(b, b.where("id < 50")))


@query("permute", "SELECT n - 1 - vec_id AS id, round(embedding[1]::double, 6) AS x1 FROM embeddings, (SELECT count(*) AS n FROM embeddings)")
def permute(spark, sf_dir):
    b = base(spark, sf_dir)
    n = b.count()
    return _first(maintenance.permute(b, b.select("id", (F.lit(n - 1) - F.col("id")).alias("source"))))


query("copy_subset_range", "SELECT vec_id AS id, round(embedding[1]::double, 6) AS x1 FROM embeddings WHERE vec_id >= 100 AND vec_id < 300")(lambda spark, sf_dir: _first(maintenance.copy_range(base(spark, sf_dir), 100, 300)))
query("copy_subset_mod", "SELECT vec_id AS id, round(embedding[1]::double, 6) AS x1 FROM embeddings WHERE vec_id % 5 = 2")(lambda spark, sf_dir: _first(maintenance.copy_mod(base(spark, sf_dir), 5, 2)))
query("reconstruct_n", "SELECT vec_id AS id, round(embedding[1]::double, 6) AS x1 FROM embeddings WHERE vec_id >= 40 AND vec_id < 90")(lambda spark, sf_dir: _first(maintenance.reconstruct(base(spark, sf_dir), 40, 50)))


@query("sync_norms", "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) AS norm2 FROM embeddings")
def sync_norms(spark, sf_dir):
    return maintenance.with_norms(base(spark, sf_dir)).select("id", F.round("norm2", 6).alias("norm2"))


@query("graph_stats", "WITH e AS (SELECT DISTINCT c_custkey % 100 AS a, c_nationkey::bigint AS b FROM customer) SELECT (SELECT count(DISTINCT a) FROM e) AS nodes, (SELECT count(*) FROM e) AS links, (SELECT count(*) FROM e x JOIN e y ON x.a = y.b AND x.b = y.a) AS reciprocal, (SELECT count(*) FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) AS shared")
def graph_stats(spark, sf_dir):
    return graph.edge_stats(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("a"), F.col("c_nationkey").cast("long").alias("b")))


# --- collection rows ------------------------------------------------------------------------------------
def _rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("source"), F.array(F.col("n_chars").cast("float"), F.lit(1.0).cast("float")).alias("vector"))


@query("lookup_in_order", "SELECT p.i AS pos, d.doc_id AS row_id, d.source FROM (SELECT i, CASE WHEN i % 4 = 3 THEN -5 ELSE 97 - i * 3 END AS k FROM range(20) r(i)) p LEFT JOIN documents d ON d.doc_id = p.k")
def lookup_in_order(spark, sf_dir):
    want = spark.range(20).select(F.col("id").alias("pos"), F.when(F.col("id") % 4 == 3, -5).otherwise(97 - F.col("id") * 3).alias("want"))
    return maintenance.lookup_in_order(_rows(spark, sf_dir).select("row_id", "source"), want.select("pos", F.col("want").alias("row_id"))).select("pos", F.expr("if(source is null, null, row_id)").alias("row_id"), "source")


query("next_row_id", "SELECT coalesce(max(doc_id), -1) + 1 AS next_id FROM documents")(lambda spark, sf_dir: maintenance.next_row_id(_rows(spark, sf_dir)))
query("bundle_label_map", "SELECT count(*) AS total, min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AND count(DISTINCT doc_id) = count(*) AS contiguous, true AS same_dim FROM documents")(lambda spark, sf_dir: maintenance.label_map_errors(_rows(spark, sf_dir)))
query("row_count", "SELECT count(*) AS n FROM documents")(lambda spark, sf_dir: _rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")))


# --- approximate graphs (held against exact search in the tests) -----------------------------------------
#: Hits by code that are ranked again by exact distance.
CANDIDATES = 200


@query("hnsw_search")
def hnsw_search(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    return rounded(graph.GraphIndex(m=16, ef_search=32, shards=2).add(b).search(q, 10))


@query("hnsw_pq_search")
def hnsw_pq_search(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    pq = codecs.ProductQuantizer.train(b, 8, 6, 8)
    return rounded(exact.rerank(graph.GraphIndex(m=16, ef_search=32, quantizer=pq).add(b).freeze().search(q, CANDIDATES), q, b, 10))


@query("hnsw_lvq_search")
def hnsw_lvq_search(spark, sf_dir):
    q, b = sides(spark, sf_dir)
    lvq = codecs.LocalQuantizer.train(b, 8, 5, 8)
    return rounded(exact.rerank(graph.GraphIndex(m=16, ef_search=32, quantizer=lvq).add(b).freeze().search(q, CANDIDATES), q, b, 10))
