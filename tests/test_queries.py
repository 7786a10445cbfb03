import re

"""Every registered query with an SQL twin gives the twin's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from vecspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


def rows(records, columns):
    flat = lambda v: tuple(v) if isinstance(v, list) else "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(flat(r[c]) for c in columns) for r in records), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert rows([r.asDict() for r in got.collect()], names) == rows([dict(zip(names, r)) for r in rel.fetchall()], names)


def test_searches_have_every_query(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = {r.vec_id for r in e.where("vec_id % 20 = 0").select("vec_id").collect()}
    n = e.count()
    for name in ("knn_l2", "filter_pre", "sel_all", "ivf_flat_exhaustive", "pq_adc"):
        assert {r.query_id for r in catalogue.QUERIES[name](spark, DATA).select("query_id").collect()} == want
    assert catalogue.QUERIES["pairwise_l2"](spark, DATA).count() == n * len(want)
    assert catalogue.QUERIES["pairwise_indexed_ip"](spark, DATA).count() == n


def test_searches_have_no_fixed_query_set():
    for name, sql in catalogue.ORACLE_SQL.items():
        assert not re.search(r"id < 20\b", sql), name


def test_default_index_is_exact_at_every_size(spark):
    from pyspark.sql import functions as F

    from vecspark.sources.artefacts import FlatIndex
    from vecspark.sources.collection import make_index

    rows = spark.range(100_001).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("vec"))
    index = make_index(rows, 2)
    assert isinstance(index, FlatIndex)
    q = spark.createDataFrame([(0, [70_000.2, 0.0])], "id long, vec array<double>")
    assert [r.id for r in index.search(q, 3).orderBy("rank").collect()] == [70_000, 70_001, 69_999]


@pytest.mark.parametrize("name", ["hnsw_search", "hnsw_pq_search", "hnsw_lvq_search"])
def test_graph_searches_find_nine_in_ten(spark, name):
    hits = lambda n: {(r.query_id, r.id) for r in catalogue.QUERIES[n](spark, DATA).collect()}
    exact = hits("knn_l2")
    assert len(exact & hits(name)) >= 0.9 * len(exact)
