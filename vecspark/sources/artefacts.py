"""Indexes and quantizers on disk: a Parquet folder for each table and meta.json, read back by kind."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codecs import LocalQuantizer, ProductQuantizer, Quantizer
from ..operators.graph import GraphIndex
from ..operators.ivf import IVFIndex
from .files import Files


class FlatIndex:
    """All vectors, searched exactly."""

    def __init__(self, rows: DataFrame | None = None, metric: str = "l2"):
        self.rows, self.metric = rows, metric

    def add(self, rows: DataFrame) -> FlatIndex:
        rows = rows.select("id", "vec")
        self.rows = rows if self.rows is None else self.rows.unionByName(rows)
        return self

    def search(self, queries: DataFrame, k: int, **_) -> DataFrame:
        from ..operators.exact import knn

        return knn(queries, self.rows, k, self.metric)

    def range_search(self, queries: DataFrame, radius: float, **_) -> DataFrame:
        from ..operators.exact import range_search

        return range_search(queries, self.rows, radius, self.metric)


class CodeIndex:
    """Codes of one quantizer, searched by table distances."""

    def __init__(self, quantizer: Quantizer, codes: DataFrame | None = None):
        self.quantizer, self.codes = quantizer, codes

    def add(self, rows: DataFrame) -> CodeIndex:
        from ..operators.codecs import encode

        return self.add_codes(encode(rows, self.quantizer))

    def add_codes(self, codes: DataFrame) -> CodeIndex:
        """Appends ready codes (id, code) of this quantizer."""
        new = codes.select("id", "code")
        self.codes = new if self.codes is None else self.codes.unionByName(new)
        return self

    def search(self, queries: DataFrame, k: int, **_) -> DataFrame:
        from ..operators.codecs import code_search

        return code_search(queries, self.codes, self.quantizer, k)


Index = FlatIndex | CodeIndex | IVFIndex | GraphIndex


def quantizer_meta(q: Quantizer | None) -> dict | None:
    if q is None:
        return None
    if isinstance(q, ProductQuantizer):
        return {"kind": "pq", "nbits": q.nbits, "centroids": q.centroids.tolist()}
    return {"kind": "lvq", "nbits": q.nbits, "cells": q.cells.tolist(), "words": q.words.tolist()}


def quantizer_of(meta: dict | None) -> Quantizer | None:
    if meta is None:
        return None
    if meta["kind"] == "pq":
        return ProductQuantizer(np.array(meta["centroids"]), meta["nbits"])
    if meta["kind"] == "lvq":
        return LocalQuantizer(np.array(meta["cells"]), np.array(meta["words"]), meta["nbits"])
    raise ValueError(f"unknown quantizer: {meta['kind']}")


def write_quantizer(spark: SparkSession, q: Quantizer, path: str) -> None:
    Files(spark, path).write("meta.json", json.dumps(quantizer_meta(q)).encode())


def read_quantizer(spark: SparkSession, path: str) -> Quantizer:
    q = quantizer_of(json.loads(Files(spark, path).read("meta.json")))
    assert q
    return q


def write_index(spark: SparkSession, index: Index, path: str) -> str:
    """Writes the index; gives the SHA-256 of its description, which holds a hash of the table's rows in no order."""
    meta: dict = {}
    if isinstance(index, FlatIndex):
        meta, table = {"kind": "flat", "metric": index.metric}, index.rows
    elif isinstance(index, CodeIndex):
        meta, table = {"kind": "codes", "quantizer": quantizer_meta(index.quantizer)}, index.codes
    elif isinstance(index, IVFIndex):
        meta = {"kind": "ivf", "metric": index.metric.name, "centroids": index.centroids.tolist(), "quantizer": quantizer_meta(index.quantizer), "by_residual": index.by_residual, "nprobe": index.nprobe}
        table = index.lists
    elif isinstance(index, GraphIndex):
        meta = {"kind": "graph", "metric": index.metric.name, "m": index.m, "ef_construction": index.ef_construction, "ef_search": index.ef_search, "shards": index.shards, "frozen": index.frozen or index.quantizer is not None, "quantizer": quantizer_meta(index.quantizer)}
        table = index.nodes
    else:
        raise ValueError(f"cannot write {type(index).__name__}")
    if table is None:
        raise ValueError("the index is empty")
    writer = table.write
    (writer.partitionBy("list_no") if meta["kind"] == "ivf" else writer).parquet(f"{path}/table")
    stored = spark.read.parquet(f"{path}/table")
    meta["total"] = stored.count()
    meta["columns"] = stored.columns
    # Each row's two hashes, summed: equal for equal rows in any order and any files.
    own = [F.xxhash64(*sorted(stored.columns), F.lit(seed)).cast("decimal(38,0)") for seed in (0, 1)]
    meta["content"] = [str(x or 0) for x in stored.agg(*[F.sum(h) for h in own]).first()]
    data = json.dumps(meta, sort_keys=True).encode()
    Files(spark, path).write("meta.json", data)
    return hashlib.sha256(data).hexdigest()


def read_index(spark: SparkSession, path: str) -> Index:
    meta = json.loads(Files(spark, path).read("meta.json"))
    table, q = spark.read.parquet(f"{path}/table"), quantizer_of(meta.get("quantizer"))
    if meta["kind"] == "flat":
        return FlatIndex(table, meta["metric"])
    if meta["kind"] == "codes":
        assert q
        return CodeIndex(q, table)
    if meta["kind"] == "ivf":
        return IVFIndex(np.array(meta["centroids"]), meta["metric"], q, meta["by_residual"], meta["nprobe"], table.select("list_no", "id", "vec" if q is None else "code"))
    if meta["kind"] == "graph":
        g = GraphIndex(meta["m"], meta["ef_construction"], meta["ef_search"], meta["metric"], meta["shards"], q)
        g.nodes, g.frozen = table, meta["frozen"]
        return g
    raise ValueError(f"unknown index kind: {meta['kind']}")


def empty_clone(index: Index) -> Index:
    """The same configuration without rows."""
    if isinstance(index, FlatIndex):
        return FlatIndex(None, index.metric)
    if isinstance(index, CodeIndex):
        return CodeIndex(index.quantizer)
    if isinstance(index, IVFIndex):
        return IVFIndex(index.centroids, index.metric, index.quantizer, index.by_residual, index.nprobe)
    return GraphIndex(index.m, index.ef_construction, index.ef_search, index.metric, index.shards, index.quantizer)
