"""Exact search: every query against every base vector, as DataFrames.

The default strategy packs both sides into blocks of rows, pairs the blocks, computes each pair with one
numpy kernel and lets only each query's best k of a block leave it; a window keeps the best k over all
blocks. Spark broadcasts the query blocks if they are small by its own threshold and pairs partitions
otherwise, so neither side has to fit anywhere. `sql` states the same in Catalyst expressions.

Results are (query_id, rank, id, distance): best first, ties by smaller id, NaN and null distances dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import MARKS, Metric, block_distances, distance, parse_metric, unrolled

QUERY_BLOCK, BASE_BLOCK = 512, 4096
#: One row in so many gives each query the distance that its k best do not exceed.
FIRST = 64


def vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The two columns (id, vec) that the operators take."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _blocks(df: DataFrame, prefix: str, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()]), pa.array([matrix(part.column(1)).tobytes()])], names=[f"{prefix}_ids", f"{prefix}_vecs"])

    return df.select("id", "vec").where("vec is not null").mapInArrow(run, f"{prefix}_ids binary, {prefix}_vecs binary")


def block_pairs(queries: DataFrame, base: DataFrame, m: Metric | Callable[[np.ndarray, np.ndarray], np.ndarray], pick) -> DataFrame:
    """pick(distances) -> (row, column) of what leaves a pair of blocks; m: a metric or the kernel itself."""
    kernel = (lambda q, b: block_distances(m, q, b)) if isinstance(m, Metric) else m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, bi, bv in zip(*(c.to_pylist() for c in b.columns)):
                qi, bi = np.frombuffer(qi, np.int64), np.frombuffer(bi, np.int64)
                d = kernel(np.frombuffer(qv).reshape(len(qi), -1), np.frombuffer(bv).reshape(len(bi), -1))
                r, c = pick(d, bi)
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(bi[c]), pa.array(d[r, c])], names=["query_id", "id", "distance"])

    pairs = _blocks(queries, "q", QUERY_BLOCK).join(_blocks(base, "b", BASE_BLOCK), how="cross")
    return pairs.mapInArrow(run, "query_id long, id long, distance double")


def best_of(d: np.ndarray, ids: np.ndarray, k: int, larger: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best, ties by id, NaN left out."""
    v = np.where(np.isnan(d), np.inf, -d if larger else d)
    rows, cols = [], []
    edge = np.partition(v, min(k, v.shape[1]) - 1, axis=1)[:, min(k, v.shape[1]) - 1]
    for i in range(len(v)):
        c = np.flatnonzero(v[i] <= edge[i])
        c = c[~np.isnan(d[i, c])]
        c = c[np.lexsort((ids[c], v[i, c]))][:k]
        rows.append(np.full(len(c), i))
        cols.append(c)
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cols) if cols else np.zeros(0, int)


def top_k(scored: DataFrame, k: int, larger: bool = False, by: str = "query_id") -> DataFrame:
    """(query_id, rank, id, distance): each query's k best of scored rows."""
    order = F.col("distance").desc() if larger else F.col("distance").asc()
    w = Window.partitionBy(by).orderBy(order, F.col("id").asc())
    ranked = scored.where("distance is not null and not isnan(distance)").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return ranked.select(by, "rank", "id", "distance")


def scored(queries: DataFrame, base: DataFrame, metric: str | Metric = "l2", p: float = 2.0) -> DataFrame:
    """(query_id, id, distance) of every pair, in Catalyst expressions."""
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qv"))
    return q.crossJoin(base.select("id", F.col("vec").alias("bv"))).select("query_id", "id", distance(metric, "qv", "bv", p).alias("distance"))


def is_plain(dim: int) -> str:
    """Condition: vec is `dim` numbers, none of them null."""
    return f"coalesce(size(vec) = {dim} and not exists(vec, v -> v is null), false)"


def _side(df: DataFrame) -> int:
    """Partitions of each side of a product."""
    spark = df.sparkSession
    return math.ceil(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) ** 0.5)


def _wide(df: DataFrame, name: str, id_name: str, dim: int) -> DataFrame:
    """Rows that are plain: the id and a column a coordinate (name0, name1, ...), never null, and the marks of NaN.
    Dealt by round-robin, so that the pairs of partitions make enough tasks however the rows were stored."""
    d = df.where(is_plain(dim)).select(F.col("id").alias(id_name), *[F.expr(f"coalesce(cast(get(vec, {i}) as double), double('NaN'))").alias(f"{name}{i}") for i in range(dim)])
    marks = [" + ".join(f"if(isnan({name}{i}), {1 << i % MARKS}L, 0L)" for i in range(at, min(at + MARKS, dim))) for at in range(0, dim, MARKS)]
    return d.select("*", *[F.expr(x).alias(f"{name}_nan{j}") for j, x in enumerate(marks)]).repartition(_side(df))


def wide_top(queries: DataFrame, base: DataFrame, k: int, m: Metric, dim: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance): the k best of every query among them, in Catalyst expressions.

    A query's k-th best (distance, id) of some of the rows bounds its k best of all. It stands in the join's condition,
    so the pairs beyond it are neither copied nor sorted. Rows of other lengths or with nulls go by lambdas.
    """
    d = unrolled(m, "q", "b", dim)
    near = f"-({d})" if m.larger_is_better else f"({d})"
    differ = "query_id <> id" if exclude_self else "true"
    q, b = _wide(queries, "q", "query_id", dim), _wide(base, "b", "id", dim)
    found = lambda pairs: pairs.select("query_id", "id", F.expr(d).alias("distance"))
    first = _wide(base.where(F.pmod(F.xxhash64("id"), F.lit(FIRST)) == 0), "b", "id", dim)
    edge = top_k(found(q.join(first, F.expr(differ))), k, m.larger_is_better).where(F.col("rank") == k)
    edge = edge.select("query_id", (-F.col("distance") if m.larger_is_better else F.col("distance")).alias("far"), F.col("id").alias("last"))
    bounded = q.join(edge, "query_id", "left").fillna({"far": float("inf"), "last": 2**63 - 1}).repartition(_side(queries))
    out = found(bounded.join(b, F.expr(f"{differ} and {near} <= far and (id <= last or {near} < far)")))
    # Dealt once more, so that adaptive execution sees that there are none and leaves these joins out.
    plain, held = F.expr(is_plain(dim)), F.col("vec").isNotNull()
    odd = lambda df: df.where(~plain & held).repartition(1)
    rest = scored(queries.where(held), odd(base), m).unionByName(scored(odd(queries), base.where(plain), m))
    return out.unionByName(rest.where(differ))


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str | Metric = "l2", p: float = 2.0, strategy: str = "arrow", exclude_self: bool = False, dim: int | None = None) -> DataFrame:
    """Exact k nearest neighbours. dim: the usual number of coordinates, for which strategy "sql" is compiled."""
    if k < 1:
        raise ValueError("k must be positive")
    m = parse_metric(metric, p)
    more = k + exclude_self
    if strategy == "sql":
        pairs = wide_top(queries, base, k, m, dim, exclude_self) if dim else scored(queries, base, m)
    else:
        pairs = block_pairs(queries, base, m, lambda d, ids: best_of(d, ids, more, m.larger_is_better))
    if exclude_self:
        pairs = pairs.where("query_id <> id")
    return top_k(pairs, k, m.larger_is_better)


def cosine_knn(queries: DataFrame, base: DataFrame, k: int, compat: bool = False) -> DataFrame:
    """True cosine similarity; compat leaves the vectors as they are (plain inner product)."""
    from ..functions.vectors import normalize

    if not compat:
        queries, base = (x.withColumn("vec", normalize("vec")) for x in (queries, base))
    return knn(queries, base, k, "ip")


def range_search(queries: DataFrame, base: DataFrame, radius: float, metric: str | Metric = "l2", inclusive: bool = False, strategy: str = "arrow", p: float = 2.0) -> DataFrame:
    """(query_id, id, distance) of all pairs nearer than radius (further, for similarities)."""
    m = parse_metric(metric, p)
    op = {(False, False): np.less, (False, True): np.less_equal, (True, False): np.greater, (True, True): np.greater_equal}[m.larger_is_better, inclusive]
    if strategy == "sql":
        c, r = F.col("distance"), F.lit(float(radius))
        near = {np.less: c < r, np.less_equal: c <= r, np.greater: c > r, np.greater_equal: c >= r}[op]
        return scored(queries, base, m).where(~F.isnan("distance") & near)
    return block_pairs(queries, base, m, lambda d, ids: np.nonzero(op(d, radius)))


def range_limits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n, lim): hits of each query and their running total before it, in order of the ids."""
    n = queries.select(F.col("id").alias("query_id")).join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").fillna(0, ["n"])
    w = Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a query
    return n.withColumn("lim", F.coalesce(F.sum("n").over(w), F.lit(0)))


def pairwise(x: DataFrame, y: DataFrame, metric: str | Metric = "l2", p: float = 2.0) -> DataFrame:
    """All distances of two sets, NaN included."""
    m = parse_metric(metric, p)
    return block_pairs(x, y, m, lambda d, ids: tuple(a.ravel() for a in np.indices(d.shape)))


def pairwise_ip_to_l2(x: DataFrame, y: DataFrame, dim: int) -> DataFrame:
    """All squared distances of two sets from norms and inner products: norms once a row, products in blocks. Pairs with
    a row that is not `dim` numbers go by lambdas; their distance is null where a coordinate or a vector is missing."""
    from ..functions.vectors import ip_to_l2, norm2

    def pairs(ids_of: DataFrame, with_: DataFrame) -> DataFrame:
        p = ids_of.select(F.col("id").alias("query_id"), F.col("vec").alias("x")).crossJoin(with_.select("id", F.col("vec").alias("y")))
        return p.select("query_id", "id", ip_to_l2(norm2("x"), norm2("y"), distance("ip", "x", "y")).alias("distance"))

    plain = F.expr(is_plain(dim))
    odd = lambda df: df.where(~plain).repartition(1)
    kernel = lambda q, b: ip_to_l2((q * q).sum(1)[:, None], (b * b).sum(1)[None], q @ b.T)
    x_plain, y_plain = (df.where(plain).repartition(_side(df)) for df in (x, y))
    out = block_pairs(x_plain, y_plain, kernel, lambda d, ids: tuple(a.ravel() for a in np.indices(d.shape)))
    return out.unionByName(pairs(x, odd(y))).unionByName(pairs(odd(x), y.where(plain)))


def pairwise_indexed(pairs: DataFrame, x: DataFrame, y: DataFrame, metric: str | Metric = "l2", p: float = 2.0) -> DataFrame:
    """distance of the pairs (pos, ix, iy); a negative or unknown id gives the metric's worst value."""
    m = parse_metric(metric, p)
    joined = pairs.join(x.select(F.col("id").alias("ix"), F.col("vec").alias("xv")), "ix", "left").join(y.select(F.col("id").alias("iy"), F.col("vec").alias("yv")), "iy", "left")
    return joined.select("pos", "ix", "iy", F.coalesce(distance(m, "xv", "yv"), F.lit(m.worst)).alias("distance"))


def distances_by_id(queries: DataFrame, base: DataFrame, metric: str | Metric = "l2") -> DataFrame:
    """queries (id, vec, ids): the distance to each listed base id, in list order (place from 0)."""
    m = parse_metric(metric)
    listed = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qv"), F.posexplode("ids").alias("place", "id"))
    joined = listed.join(base.select("id", F.col("vec").alias("bv")), "id", "left")
    return joined.select("query_id", F.col("place").cast("long").alias("place"), "id", F.coalesce(distance(m, "qv", "bv"), F.lit(m.worst)).alias("distance"))


def knn_subset(queries: DataFrame, base: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    """k nearest among each query's listed ids (id, vec, ids), up to the first id that is not in base."""
    m = parse_metric(metric)
    d = distances_by_id(queries, base, m).join(base.select("id", F.lit(True).alias("known")), "id", "left")
    w = Window.partitionBy("query_id").orderBy("place")
    cut = d.withColumn("bad", F.max(F.when(F.col("known").isNull(), 1).otherwise(0)).over(w)).where("bad = 0")
    return top_k(cut, k, m.larger_is_better)


def assign(queries: DataFrame, base: DataFrame, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, id): the nearest base id."""
    return knn(queries, base, 1, metric).select("query_id", "id")


def search_and_reconstruct(queries: DataFrame, base: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    return knn(queries, base, k, metric).join(base.select("id", "vec"), "id").select("query_id", "rank", "id", "distance", "vec")


def merge_knn(shards: list[DataFrame], k: int, larger: bool = False) -> DataFrame:
    """The best k over per-shard results; a shard ends at its first negative id."""
    out = None
    for s in shards:
        w = Window.partitionBy("query_id").orderBy("rank")
        s = s.withColumn("_stop", F.max((F.col("id") < 0).cast("int")).over(w)).where("_stop = 0").select("query_id", "id", "distance")
        out = s if out is None else out.unionByName(s)
    if out is None:
        raise ValueError("no shards")
    return top_k(out, k, larger)


def rerank(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    """The k best of (query_id, id) candidates by exact distance."""
    m = parse_metric(metric)
    c = candidates.select("query_id", "id").distinct()
    j = c.join(queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qv")), "query_id").join(base.select("id", F.col("vec").alias("bv")), "id")
    return top_k(j.select("query_id", "id", distance(m, "qv", "bv").alias("distance")), k, m.larger_is_better)


def flat1d(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """k nearest numbers by absolute difference: (id, x) against (id, x); null and NaN are left out.

    The distinct numbers of base are numbered in order, by range, together with the queries; a query then meets the k
    numbers on each side of it by their places, and the k smallest ids of each number.
    """
    from .topk import running

    two = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x")).where("x is not null and not isnan(x)")
    asked, held = two(queries), two(base)
    held = held.withColumn("_n", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("_n") <= k).drop("_n")
    line = held.select("x", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id")).distinct().unionByName(asked.select("x", F.lit(1).alias("kind"), "id"))
    line = running(line, ["x", "kind", "id"], F.col("kind") == 0)
    numbers = line.where("kind = 0").select(F.col("before").alias("place"), "x")
    near = line.where("kind = 1").select(F.col("id").alias("query_id"), F.col("x").alias("y"), F.explode(F.sequence(F.col("before") - k, F.col("before") + (k - 1))).alias("place"))
    found = near.join(numbers, "place").join(held, "x")
    return top_k(found.select("query_id", "id", F.abs(F.col("x") - F.col("y")).alias("distance")), k)


def with_id_map(result: DataFrame, id_map: DataFrame) -> DataFrame:
    """Internal ids of a k-NN or range result replaced by external ones (id, external_id)."""
    return result.join(id_map.select("id", "external_id"), "id").withColumn("id", F.col("external_id")).drop("external_id").select(*result.columns)


def padded(result: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    """Dense (query_id, rank, id, distance) with k ranks a query: id -1 and the worst value where none is."""
    m = parse_metric(metric)
    grid = queries.select(F.col("id").alias("query_id")).select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank"))
    return grid.join(result, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("distance", F.lit(m.worst)).alias("distance"))
