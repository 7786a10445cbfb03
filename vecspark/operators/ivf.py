"""Inverted-file search: vectors or codes in lists by nearest centroid, searched by an equi-join.

Queries are assigned to their nprobe nearest lists and meet only those lists' rows: one join on list_no, which
prunes partitions of a table written with partitionBy(list_no). Long lists are cut into blocks before the
join, so a hot list is many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric, block_distances, parse_metric
from .codecs import LocalQuantizer, ProductQuantizer, Quantizer, code_matrix
from .exact import best_of, matrix, top_k
from .kmeans import kmeans

LIST_BLOCK = 4096


def nearest_lists(rows: DataFrame, centroids: np.ndarray, n: int, metric: str | Metric = "l2") -> DataFrame:
    """(id, vec, list_no, place, centroid_distance): each row's n nearest centroids, best first."""
    m = parse_metric(metric)
    n = min(n, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = block_distances(m, matrix(b.column(1)), centroids)
            r, c = best_of(d, np.arange(len(centroids)), n, m.larger_is_better)
            place = np.concatenate([np.arange((r == i).sum()) for i in range(b.num_rows)]) if len(r) else r
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array(c.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(d[r, c])], names=["id", "vec", "list_no", "place", "centroid_distance"])

    kind = dict(rows.dtypes)["vec"]
    return rows.select("id", "vec").where("vec is not null").mapInArrow(run, f"id long, vec {kind}, list_no int, place int, centroid_distance double")


class IVFIndex:
    """Lists of raw vectors, or of codes of the vectors or of their residuals."""

    def __init__(self, centroids: np.ndarray, metric: str | Metric = "l2", quantizer: Quantizer | None = None, by_residual: bool = True, nprobe: int = 1, lists: DataFrame | None = None):
        self.centroids, self.metric = np.asarray(centroids, np.float64), parse_metric(metric)
        if self.metric.name not in ("l2", "ip") or quantizer is not None and self.metric.name != "l2":
            raise ValueError("lists of vectors take l2 or ip, lists of codes l2")
        self.quantizer, self.by_residual, self.nprobe, self.lists = quantizer, by_residual, nprobe, lists

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    @classmethod
    def train(cls, rows: DataFrame, nlist: int = 1024, metric: str = "l2", niter: int = 25, seed: int = 1234, pq_m: int | None = None, nlocal: int | None = None, nbits: int = 8, by_residual: bool = True, nprobe: int = 1) -> IVFIndex:
        """Centroids by k-means (always L2), then the quantizer on a bounded sample of the residuals."""
        from .codecs import training_matrix

        c = kmeans(rows, nlist, niter, seed).centroids
        q: Quantizer | None = None
        if pq_m or nlocal:
            x = training_matrix(rows)
            if by_residual:
                x = x - c[block_distances(parse_metric("l2"), x, c).argmin(1)]
            q = ProductQuantizer.train(x, pq_m, nbits, niter, seed) if pq_m else LocalQuantizer.train(x, nlocal or 16, nbits, niter, seed)
        return cls(c, metric, q, by_residual, nprobe)

    def assign(self, rows: DataFrame, nprobe: int = 1) -> DataFrame:
        return nearest_lists(rows, self.centroids, nprobe, self.metric)

    def add(self, rows: DataFrame) -> IVFIndex:
        """Appends (id, vec) rows: (list_no, id, vec) or (list_no, id, code)."""
        new = self.assign(rows).select("list_no", "id", "vec")
        if self.quantizer is not None:
            q, c, rest = self.quantizer, self.centroids, self.by_residual

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        x = matrix(b.column(2)) - (c[b.column(0).to_numpy()] if rest else 0)
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in q.encode(x)], pa.binary())], names=["list_no", "id", "code"])

            new = new.mapInArrow(run, "list_no int, id long, code binary")
        self.lists = new if self.lists is None else self.lists.unionByName(new)
        return self

    def reset(self) -> IVFIndex:
        self.lists = None
        return self

    def _rows(self) -> DataFrame:
        if self.lists is None:
            raise ValueError("the index is empty")
        return self.lists

    def list_sizes(self) -> DataFrame:
        """(list_no, n) of all lists, empty ones too."""
        n = self._rows().groupBy("list_no").agg(F.count(F.lit(1)).alias("n"))
        every = n.sparkSession.range(self.nlist).select(F.col("id").cast("int").alias("list_no"))
        return every.join(n, "list_no", "left").fillna(0, ["n"])

    def _blocks(self) -> DataFrame:
        q = self.quantizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(0).to_numpy()
                order = np.argsort(lists, kind="stable")
                ids, body = b.column(1).to_numpy()[order], b.column(2)
                data = (matrix(body) if q is None else code_matrix(body, q.code_size))[order] if b.num_rows else body
                edges = np.flatnonzero(np.diff(lists[order], prepend=-1)).tolist() + [b.num_rows]
                for low, high in zip(edges, edges[1:]):
                    for at in range(low, high, LIST_BLOCK):
                        end = min(high, at + LIST_BLOCK)
                        yield pa.RecordBatch.from_arrays([pa.array([lists[order[at]]], pa.int32()), pa.array([ids[at:end].tobytes()]), pa.array([data[at:end].tobytes()])], names=["list_no", "b_ids", "b_data"])

        return self._rows().mapInArrow(run, "list_no int, b_ids binary, b_data binary")

    def _pairs(self, assigned: DataFrame, pick) -> DataFrame:
        """assigned: (id, vec, list_no). pick(distances, ids) -> (row, column)."""
        m, q, c, rest = self.metric, self.quantizer, self.centroids, self.by_residual
        probes = assigned.groupBy("list_no", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_s")).agg(F.collect_list(F.struct("id", F.col("vec").cast("array<double>").alias("vec"))).alias("probes"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for no, probes, bi, bd in zip(*(x.to_pylist() for x in b.columns)):
                    qi, qv = np.array([p["id"] for p in probes], np.int64), np.array([p["vec"] for p in probes])
                    bi = np.frombuffer(bi, np.int64)
                    if q is None:
                        d = block_distances(m, qv, np.frombuffer(bd).reshape(len(bi), -1))
                    else:
                        d = q.distances(qv - (c[no] if rest else 0), np.frombuffer(bd, np.uint8).reshape(len(bi), -1))
                    r, col = pick(d, bi)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(bi[col]), pa.array(d[r, col])], names=["query_id", "id", "distance"])

        joined = probes.join(self._blocks(), "list_no").select("list_no", "probes", "b_ids", "b_data")
        return joined.mapInArrow(run, "query_id long, id long, distance double")

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        return self.search_preassigned(self.assign(queries, nprobe or self.nprobe), k)

    def search_preassigned(self, assigned: DataFrame, k: int) -> DataFrame:
        """k nearest of (id, vec, list_no) queries within the lists the caller names."""
        larger = self.metric.larger_is_better
        return top_k(self._pairs(assigned, lambda d, ids: best_of(d, ids, k, larger)), k, larger)

    def range_search(self, queries: DataFrame, radius: float, nprobe: int | None = None) -> DataFrame:
        """All hits up to and including the radius in the probed lists; codes are decoded by their tables."""
        larger = self.metric.larger_is_better
        return self._pairs(self.assign(queries, nprobe or self.nprobe), lambda d, ids: np.nonzero(d >= radius if larger else d <= radius))

    def reconstruct(self) -> DataFrame:
        """(id, vec) of all rows, decoded."""
        q, c, rest = self.quantizer, self.centroids, self.by_residual
        if q is None:
            return self._rows().select("id", F.col("vec").cast("array<double>").alias("vec"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = q.decode(code_matrix(b.column(2), q.code_size)) + (c[b.column(0).to_numpy()] if rest else 0)
                    yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vec"])

        return self._rows().mapInArrow(run, "id long, vec array<double>")
