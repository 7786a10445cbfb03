"""Adding, removing, merging and copying stored vectors. Positions are dense ids 0..n-1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def renumber(rows: DataFrame, order: str = "id") -> DataFrame:
    """The rows with id = their place in the order; ranges are numbered apart and shifted by their counts."""
    from .topk import argsort

    places = argsort(rows.select(F.col("id").alias("_old"), F.col(order).alias("_by")), "_by", "_old")
    return rows.withColumnRenamed("id", "_old").join(places.select(F.col("place"), F.col("id").alias("_old")), "_old").withColumn("id", F.col("place")).drop("_old", "place")


def remove_ids(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows without the listed ids; later ids move down."""
    return renumber(rows.join(gone.select("id").distinct(), "id", "left_anti"))


def append(rows: DataFrame, more: DataFrame, offset: int | None = None) -> DataFrame:
    """Merges `more` after rows: its ids are shifted by the size of rows (or by offset)."""
    n = rows.count() if offset is None else offset
    return rows.unionByName(more.withColumn("id", F.col("id") + F.lit(n)))


def permute(rows: DataFrame, order: DataFrame) -> DataFrame:
    """new[i] = old[order[i]]; order: (id, source)."""
    return order.select("id", F.col("source").alias("_s")).join(rows.withColumnRenamed("id", "_s"), "_s").drop("_s").select(*rows.columns)


def copy_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where((F.col("id") >= low) & (F.col("id") < high))


def copy_mod(rows: DataFrame, divisor: int, rest: int) -> DataFrame:
    return rows.where(F.pmod("id", F.lit(divisor)) == rest)


def reconstruct(rows: DataFrame, first: int, count: int) -> DataFrame:
    """The stored vectors first..first+count-1; an id out of range is an error."""
    got = rows.where((F.col("id") >= first) & (F.col("id") < first + count))
    if got.select("id").distinct().count() != count:
        raise ValueError("id out of range")
    return got


def with_norms(rows: DataFrame) -> DataFrame:
    from ..functions.vectors import norm2

    return rows.withColumn("norm2", norm2("vec"))


def residual(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, list_no, residual) of (id, vec, list_no) rows and (list_no, vec) centroids."""
    from ..functions.vectors import sub

    c = centroids.select("list_no", F.col("vec").alias("_c"))
    return rows.join(c, "list_no").select("id", "list_no", sub("vec", "_c").alias("residual"))


def lookup_in_order(table: DataFrame, wanted: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows of (pos, key), in request order; null columns where the table has none."""
    return wanted.select("pos", key).join(table, key, "left").select("pos", *table.columns).orderBy("pos")


def next_row_id(table: DataFrame, key: str = "row_id") -> DataFrame:
    return table.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).cast("long").alias("next_id"))


def label_map_errors(table: DataFrame, key: str = "row_id", vec: str = "vector", dim: int | None = None) -> DataFrame:
    """One row: total, whether the ids are exactly 0..total-1, and whether all vectors have the dimension."""
    size = F.size(F.col(vec))
    s = table.agg(F.count(F.lit(1)).alias("total"), F.min(key).alias("low"), F.max(key).alias("high"), F.countDistinct(key).alias("distinct"), F.min(size).alias("least"), F.max(size).alias("most"))
    dense = (F.col("total") == 0) | ((F.col("low") == 0) & (F.col("high") == F.col("total") - 1) & (F.col("distinct") == F.col("total")))
    same = (F.col("least") == F.col("most")) if dim is None else (F.col("least") == dim) & (F.col("most") == dim)
    return s.select("total", dense.alias("contiguous"), F.coalesce(same, F.lit(True)).alias("same_dim"))
