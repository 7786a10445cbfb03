"""Product and local-residual quantizers: training, packed codes, decoding and table search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import best_of, matrix, top_k
from .kmeans import kmeans, local_kmeans, nearest

#: Rows that a quantizer trains on at most; it encodes every row.
TRAIN_ROWS = 100_000


def pack_bits(values: np.ndarray, nbits: int) -> np.ndarray:
    """Rows of integers as bytes, least significant bit first."""
    bits = (values[..., None].astype(np.int64) >> np.arange(nbits)) & 1
    return np.packbits(bits.reshape(len(values), -1).astype(np.uint8), axis=1, bitorder="little")


def unpack_bits(codes: np.ndarray, nbits: int, count: int) -> np.ndarray:
    bits = np.unpackbits(codes, axis=1, bitorder="little")[:, : nbits * count].reshape(len(codes), count, nbits)
    return (bits.astype(np.int64) << np.arange(nbits)).sum(2)


def training_matrix(rows: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray:
    """At most `most` vectors, those with the smallest hash of the id: a bounded sample, the same each time."""
    got = rows.select("id", "vec").where("vec is not null").orderBy(F.xxhash64("id"), "id").limit(most)
    table = got.orderBy("id").toArrow()
    return matrix(table.column("vec").combine_chunks()) if table.num_rows else np.zeros(0)


class ProductQuantizer:
    """M sub-vectors of d / M coordinates, each the number of one of 2^nbits centroids."""

    def __init__(self, centroids: np.ndarray, nbits: int):
        self.centroids, self.nbits = centroids, nbits  # (M, ksub, dsub)
        self.m, self.ksub, self.dsub = centroids.shape
        self.code_size = (self.m * nbits + 7) // 8

    @classmethod
    def train(cls, rows: DataFrame | np.ndarray, m: int, nbits: int = 8, niter: int = 25, seed: int = 1234) -> ProductQuantizer:
        if not 1 <= nbits <= 16:
            raise ValueError("nbits must be in 1..16")
        x = rows if isinstance(rows, np.ndarray) else training_matrix(rows)
        if x.size == 0 or x.shape[1] % m:
            raise ValueError("the dimension must be a multiple of M")
        sub = x.reshape(len(x), m, -1)
        return cls(np.stack([local_kmeans(sub[:, j], 1 << nbits, niter, seed + j) for j in range(m)]), nbits)

    def numbers(self, x: np.ndarray) -> np.ndarray:
        sub = x.reshape(len(x), self.m, self.dsub)
        return np.stack([nearest(sub[:, j], self.centroids[j])[0] for j in range(self.m)], 1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return pack_bits(self.numbers(x), self.nbits)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        n = unpack_bits(codes, self.nbits, self.m)
        return np.concatenate([self.centroids[j][n[:, j]] for j in range(self.m)], 1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(nq, M, ksub) squared distances of the query parts to the centroids."""
        sub = q.reshape(len(q), self.m, 1, self.dsub)
        return ((sub - self.centroids[None]) ** 2).sum(3)

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        n, t = unpack_bits(codes, self.nbits, self.m), self.tables(q)
        return sum(t[:, j, n[:, j]] for j in range(self.m))


class LocalQuantizer:
    """The nearest of nlocal centroids, and the nearest of its 2^nbits residual words."""

    def __init__(self, cells: np.ndarray, words: np.ndarray, nbits: int):
        self.cells, self.words, self.nbits = cells, words, nbits  # (nlocal, d), (nlocal, ksub, d)
        self.local_nbits = max(1, int(np.ceil(np.log2(len(cells)))))
        self.code_size = (self.local_nbits + nbits + 7) // 8

    @classmethod
    def train(cls, rows: DataFrame | np.ndarray, nlocal: int = 16, nbits: int = 8, niter: int = 25, seed: int = 1234) -> LocalQuantizer:
        if not 1 <= nbits <= 16:
            raise ValueError("nbits must be in 1..16")
        x = rows if isinstance(rows, np.ndarray) else training_matrix(rows)
        ksub = 1 << nbits
        cells = local_kmeans(x, nlocal, niter, seed)
        at, _ = nearest(x, cells)
        words = np.zeros((nlocal, ksub, x.shape[1]))
        for i in range(nlocal):
            rest = x[at == i] - cells[i]
            if len(rest) >= ksub:
                words[i] = local_kmeans(rest, ksub, niter, seed + 1009 + i)
            elif len(rest):
                words[i] = rest[np.arange(ksub) % len(rest)]  # too few: they repeat in turn
        return cls(cells, words, nbits)

    def numbers(self, x: np.ndarray) -> np.ndarray:
        at, _ = nearest(x, self.cells)
        rest = x - self.cells[at]
        code = np.empty(len(x), np.int64)
        for i in np.unique(at):
            code[at == i] = nearest(rest[at == i], self.words[i])[0]
        return np.stack([at, code], 1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        n = self.numbers(x)
        return pack_bits((n[:, 0] | n[:, 1] << self.local_nbits)[:, None], self.code_size * 8)

    def split(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = unpack_bits(codes, self.code_size * 8, 1)[:, 0]
        return v & ((1 << self.local_nbits) - 1), v >> self.local_nbits

    def decode(self, codes: np.ndarray) -> np.ndarray:
        at, code = self.split(codes)
        return self.cells[at] + self.words[at, code]

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """A table of the distances to all decoded words, then one look-up a code."""
        at, code = self.split(codes)
        all_words = self.cells[:, None] + self.words
        t = ((q[:, None, None, :] - all_words[None]) ** 2).sum(3)
        return t[:, at, code]


Quantizer = ProductQuantizer | LocalQuantizer


def code_matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size)


def encode(rows: DataFrame, quantizer: Quantizer) -> DataFrame:
    """(id, code) of every row (id, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = quantizer.encode(matrix(b.column(1))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

    return rows.select("id", "vec").where("vec is not null").mapInArrow(run, "id long, code binary")


def decode(rows: DataFrame, quantizer: Quantizer) -> DataFrame:
    """(id, vec) of coded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = quantizer.decode(code_matrix(b.column(1), quantizer.code_size)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vec"])

    return rows.select("id", "code").mapInArrow(run, "id long, vec array<double>")


def code_numbers(codes: DataFrame, quantizer: Quantizer) -> DataFrame:
    """(id, part, number): the integers of each code."""

    @F.pandas_udf("array<bigint>")
    def go(s: pd.Series) -> pd.Series:
        c = np.frombuffer(b"".join(s), np.uint8).reshape(len(s), quantizer.code_size)
        n = unpack_bits(c, quantizer.nbits, quantizer.m) if isinstance(quantizer, ProductQuantizer) else np.stack(quantizer.split(c), 1)
        return pd.Series(list(n))

    return codes.select("id", F.posexplode(go("code")).alias("part", "number")).select("id", F.col("part").cast("long").alias("part"), "number")


def code_search(queries: DataFrame, codes: DataFrame, quantizer: Quantizer, k: int) -> DataFrame:
    """k nearest by table distance (squared L2 to the decoded vectors)."""
    from .exact import _blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, bi, bc in zip(*(c.to_pylist() for c in b.columns)):
                qi, bi = np.frombuffer(qi, np.int64), np.frombuffer(bi, np.int64)
                d = quantizer.distances(np.frombuffer(qv).reshape(len(qi), -1), np.frombuffer(bc, np.uint8).reshape(len(bi), -1))
                r, c = best_of(d, bi, k, False)
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(bi[c]), pa.array(d[r, c])], names=["query_id", "id", "distance"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                p = b.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([pa.array([p.column(0).to_numpy().tobytes()]), pa.array([b"".join(p.column(1).to_pylist())])], names=["b_ids", "b_codes"])

    pairs = _blocks(queries, "q", 64).crossJoin(codes.select("id", "code").mapInArrow(blocks, "b_ids binary, b_codes binary"))
    return top_k(pairs.mapInArrow(run, "query_id long, id long, distance double"), k)


def symmetric_distance(a: str, b: str) -> Column:
    """Squared L2 of two decoded vector columns."""
    from ..functions.metrics import distance

    return distance("l2", a, b)


def coarse(rows: DataFrame, nlist: int, niter: int = 25, seed: int = 1234) -> np.ndarray:
    return kmeans(rows, nlist, niter, seed).centroids
