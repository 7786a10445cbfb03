"""Top-k, sorting, bucketing, lookup and recall helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact import top_k


def k_least(rows: DataFrame, k: int, id_col: str = "id", vec: str = "vec", largest: bool = False) -> DataFrame:
    """(id, rank, place, value): the k least (largest) elements of each array, ties by place (from 0)."""
    e = rows.select(F.col(id_col).alias("query_id"), F.posexplode(vec).alias("id", "distance"))
    e = e.select("query_id", F.col("id").cast("long").alias("id"), F.col("distance").cast("double").alias("distance"))
    return top_k(e, k, largest).select(F.col("query_id").alias("id"), "rank", F.col("id").alias("place"), F.col("distance").alias("value"))


class ResultHeap:
    """Collects slices of (query_id, id, distance) and gives the k best of all."""

    def __init__(self, k: int, larger: bool = False):
        self.k, self.larger, self.rows = k, larger, None

    def add(self, part: DataFrame) -> ResultHeap:
        part = part.select("query_id", "id", "distance")
        self.rows = part if self.rows is None else self.rows.unionByName(part)
        return self

    def finalize(self) -> DataFrame:
        if self.rows is None:
            raise ValueError("no results were added")
        return top_k(self.rows, self.k, self.larger)


def per_line_extrema(result: DataFrame, larger: bool = False) -> DataFrame:
    """(query_id, id, distance): the worst kept hit of each query, ties by larger id."""
    best = F.max_by if not larger else F.min_by
    pair = F.struct("distance", (F.col("id") if not larger else -F.col("id")).alias("i"))
    x = result.groupBy("query_id").agg(best(F.struct("id", "distance"), pair).alias("x"))
    return x.select("query_id", "x.id", "x.distance")


#: Rows a range that are sampled to place the ranges' bounds; only balance depends on it.
SAMPLE = 32


def range_of(rows: DataFrame, order: list[str]) -> Column:
    """The range, from 0, that a row's `order` columns lie in; null comes first.

    The bounds are rows of the table, so a common value is split by the later columns. They are the same each time:
    a sample by hash, of SAMPLE rows a shuffle partition. A row is compared with the bounds in two steps of about the
    square root of their number.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order)
    sample = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(SAMPLE * n)
    got = sample.orderBy(*order).collect()
    types = [rows.schema[c].dataType for c in order]
    picked = [got[i * len(got) // n] for i in range(1, n)] if len(got) > 1 else []
    if not picked:
        return F.lit(0)
    step = max(1, math.isqrt(len(picked)))
    array = lambda rs: F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(r, types, order)]) for r in rs])
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < key))
    coarse = below(array(picked[step - 1 :: step])) * step
    return coarse + below(F.slice(array(picked), coarse + 1, F.lit(step)))


def running(rows: DataFrame, order: list[str], weight: Column) -> DataFrame:
    """rows and `before`, the sum of the weights of all rows before each in the order; no task sees more than a range."""
    dealt = rows.withColumn("_weight", weight.cast("long")).withColumn("_part", range_of(rows, order))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.sum("_weight").alias("n"))  # one row a range
    starts = starts.select("_part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("_part"))), F.lit(0)).alias("_start"))
    inner = F.coalesce(F.sum("_weight").over(earlier(Window.partitionBy("_part").orderBy(*order))), F.lit(0))
    numbered = dealt.withColumn("_inner", inner).join(F.broadcast(starts), "_part")
    return numbered.select(*rows.columns, (F.col("_start") + F.col("_inner")).alias("before"))


def argsort(rows: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """(place, id): the ascending order of the values, null first, ties by id; ranges are sorted apart and then numbered."""
    pairs = rows.select(F.col(value).alias("value"), F.col(id_col).alias("id"))
    return running(pairs, ["value", "id"], F.lit(1)).select(F.col("before").alias("place"), "id")


def bucket_order(rows: DataFrame, bucket: str, id_col: str = "id") -> DataFrame:
    """(place, bucket, id): bucket_sort as rows, for buckets of any size; a bucket's place starts at its `lim`."""
    pairs = rows.select(F.col(bucket).cast("long").alias("bucket"), F.col(id_col).cast("long").alias("id"))
    return running(pairs, ["bucket", "id"], F.lit(1)).select(F.col("before").alias("place"), "bucket", "id")


def bucket_sort(rows: DataFrame, bucket: str, n_buckets: int, id_col: str = "id") -> DataFrame:
    """(bucket, lim, ids): ids of each bucket in order, and how many lie in the buckets before it.

    A bucket is one array; bucket_order gives the same order as rows where buckets are large.
    """
    if rows.where((F.col(bucket) < 0) | (F.col(bucket) >= n_buckets)).limit(1).count():
        raise ValueError(f"bucket values must be in [0, {n_buckets})")
    spark = rows.sparkSession
    grouped = rows.groupBy(F.col(bucket).cast("long").alias("bucket")).agg(F.sort_array(F.collect_list(F.col(id_col).cast("long"))).alias("ids"))
    full = spark.range(n_buckets).select(F.col("id").alias("bucket")).join(grouped, "bucket", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    return full.withColumn("lim", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long")).select("bucket", "lim", "ids")


def matrix_bucket_sort(rows: DataFrame, n_buckets: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """bucket_sort of every element of an integer matrix; the ids are row ids."""
    e = rows.select(F.col(id_col).alias("id"), F.explode(vec).alias("bucket"))
    return bucket_sort(e, "bucket", n_buckets)


def histogram(rows: DataFrame, value: str, low: int, shift: int, bins: int) -> DataFrame:
    """(bin, n) of (value - low) >> shift, all bins; values outside are dropped; shift < 0: values are bins."""
    v = F.col(value).cast("long")
    b = v if shift < 0 else F.shiftright(v - F.lit(low), shift)
    kept = rows.where(v >= (0 if shift < 0 else low)).select(b.cast("long").alias("bin")).where(F.col("bin") < bins)
    all_bins = rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return all_bins.join(kept.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "bin", "left").fillna(0, ["n"])


def smallest(rows: DataFrame, value: str, q: int, id_col: str = "id") -> DataFrame:
    """The q rows with the smallest values, ties by id."""
    return rows.orderBy(F.col(value).asc(), F.col(id_col).asc()).limit(q)


def hash_lookup(keys: DataFrame, table: DataFrame) -> DataFrame:
    """(key, value) of each key; -1 where the table (key, value) has none. -1 is no key."""
    if table.where("key = -1").limit(1).count():
        raise ValueError("-1 is reserved")
    one = table.dropDuplicates(["key"])
    return keys.join(one, "key", "left").select("key", F.coalesce("value", F.lit(-1)).cast("long").alias("value"))


def intersections(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, n): hits that two results share."""
    x, y = (r.groupBy("query_id").agg(F.collect_set("id").alias(c)) for r, c in ((a, "x"), (b, "y")))
    return x.join(y, "query_id").select("query_id", F.size(F.array_intersect("x", "y")).cast("long").alias("n"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> float:
    """Share of the true k neighbours that were found."""
    f, t = found.where(F.col("rank") <= k), truth.where(F.col("rank") <= k)
    hit = t.select("query_id", "id").join(f.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return hit / max(1, t.count())
