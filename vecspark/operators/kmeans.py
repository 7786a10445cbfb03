"""Lloyd's k-means over DataFrames: partial sums in the tasks, one small aggregate a step."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import parse_metric
from .exact import matrix


@dataclass
class KMeansResult:
    centroids: np.ndarray
    loss: float
    history: list[float]


def sample_positions(n: int, k: int, seed: int) -> list[int]:
    """k distinct positions of 0..n-1: the head of a seeded Fisher-Yates shuffle; only k swaps are held."""
    raw = np.random.RandomState(seed).randint(0, 2**32, k, dtype=np.uint32)
    moved: dict[int, int] = {}
    out = []
    for i in range(k):
        j = i + int(raw[i]) % (n - i)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of and squared distance to the nearest row of c; the first of equals."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _step(rows: DataFrame, c: np.ndarray, by_ip: bool) -> tuple[np.ndarray, np.ndarray, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, loss = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                if by_ip:
                    s = x @ c.T
                    at = s.argmax(1)
                    d = -s[np.arange(len(x)), at]
                else:
                    at, d = nearest(x, c)
                np.add.at(sums, at, x)
                counts += np.bincount(at, minlength=len(c))
                loss += np.bincount(at, d, len(c))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(sums[some]), pa.list_(pa.float64())), pa.array(counts[some]), pa.array(loss[some])], names=["c", "s", "n", "loss"])

    part = rows.select("vec").mapInArrow(run, "c long, s array<double>, n long, loss double")
    add = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(c.shape[1])]
    sums, counts, loss = np.zeros_like(c), np.zeros(len(c), np.int64), 0.0
    for r in part.groupBy("c").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), *add).collect():  # k rows
        sums[r["c"]], counts[r["c"]] = [r[f"s{i}"] for i in range(c.shape[1])], r["n"]
        loss += r["loss"]
    return sums, counts, loss


def _split_empty(c: np.ndarray, counts: np.ndarray) -> None:
    """An empty cluster takes the heaviest one's centroid; both move apart a little, with opposite signs."""
    counts = counts.copy()
    for e in np.flatnonzero(counts == 0):
        heavy = int(counts.argmax())
        shift = np.maximum(np.abs(c[heavy]), 1) / 1024 * (e + 1) * np.where(np.arange(c.shape[1]) % 2 == 0, 1, -1)
        c[e] = c[heavy] + shift
        c[heavy] = c[heavy] - shift
        counts[e] = counts[heavy] // 2
        counts[heavy] -= counts[e]


def kmeans(rows: DataFrame, k: int, niter: int = 25, seed: int = 1234, nredo: int = 1, spherical: bool = False, metric: str = "l2") -> KMeansResult:
    """Centroids of rows (id, vec). The start is k rows by position in id order; ip is spherical."""
    m = parse_metric(metric)
    if m.name not in ("l2", "ip"):
        raise ValueError("k-means takes l2 or ip")
    if niter <= 0 or nredo <= 0 or k <= 0:
        raise ValueError("k, niter and nredo must be positive")
    rows = rows.select("id", "vec").where("vec is not null").persist()
    try:
        n = rows.count()
        if n < k:
            raise ValueError(f"{n} points for {k} clusters")
        spherical = spherical or m.name == "ip"
        unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
        best: KMeansResult | None = None
        for redo in range(nredo):
            c = _rows_at(rows, sample_positions(n, k, seed + redo), n)
            c = unit(c) if spherical else c
            history = []
            for _ in range(niter):
                sums, counts, loss = _step(rows, c, m.name == "ip")
                history.append(loss)
                c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
                _split_empty(c, counts)
                c = unit(c) if spherical else c
            loss = _step(rows, c, m.name == "ip")[2]
            if best is None or loss < best.loss:
                best = KMeansResult(c, loss, history)
        assert best
        return best
    finally:
        rows.unpersist()


def _rows_at(rows: DataFrame, at: list[int], n: int) -> np.ndarray:
    """The vectors at positions of the id order. Ids that are 0..n-1 are their own positions."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if (low, high) == (0, n - 1):
        found = {r.id: r.vec for r in rows.where(F.col("id").isin(at)).collect()}
    else:
        # Range-sorted, then numbered by zipWithIndex: one task a range, none sees all rows.
        numbered = rows.select("id").orderBy("id").rdd.zipWithIndex().map(lambda r: (r[1], r[0][0]))
        places = rows.sparkSession.createDataFrame(numbered, "place long, id long").where(F.col("place").isin(at))
        found = {r.place: r.vec for r in places.join(rows, "id").collect()}
    return np.array([found[i] for i in at], np.float64)


def local_kmeans(x: np.ndarray, k: int, niter: int = 25, seed: int = 1234) -> np.ndarray:
    """The same steps over a matrix in memory (a bounded training sample)."""
    if len(x) < k:
        raise ValueError(f"{len(x)} points for {k} clusters")
    c = x[sample_positions(len(x), k, seed)].copy()
    for _ in range(niter):
        at, _ = nearest(x, c)
        counts = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        _split_empty(c, counts)
    return c
