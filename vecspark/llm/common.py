"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs without these characters.
WHITE = r"\x20\x09-\x0D"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that setting is unset (local tests) is a temporary folder used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import shutil
        import tempfile

        _own_dir.append(tempfile.mkdtemp(prefix="vecspark-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it, which ends its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._vecspark_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table written by cut() that no later plan reads, and lets Spark free its shuffles."""
    spark = df.sparkSession
    path = getattr(df, "_vecspark_path", None)
    if path:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Asks the JVM to collect garbage: shuffle files of finished, unreferenced plans go with it."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what is made of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII white space by byte.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_factors = [mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each word of the bytes, which end in white space."""
    inside = ~SPACES[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2] - edge[::2]


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes (none empty, in order): a multilinear hash, all spans at once."""
    if not len(size):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(size)
    first = ends - size
    longest = int(size.max())
    if longest > len(_factors[0]):
        _factors[0] = mix64(np.arange(1, 2 * longest + 1, dtype=np.uint64)) | np.uint64(1)
    place = np.arange(int(ends[-1])) - np.repeat(first, size)
    gap = start - first
    held = data[place + np.repeat(start, size)] if gap[-1] - gap[0] or len(data) != ends[-1] else data
    with np.errstate(over="ignore"):
        value = (held.astype(np.uint64) + np.uint64(1)) * _factors[0][place]
        return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def flat_word_hashes(batch: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts, end to end, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(batch) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in batch], dtype=np.int64)
    if lower:
        data = _LOWER[data]
    start, size = word_spans(data)
    return span_hashes(data, start, size), np.diff(np.searchsorted(start, ends), prepend=0)


def word_hashes(batch: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of the words of each text."""
    h, counts = flat_word_hashes(batch, lower)
    return np.split(h, np.cumsum(counts)[:-1])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n consecutive words: a polynomial in their hashes."""
    m = len(words) - n + 1
    h = words[:m].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += words[i : i + m]
    return mix64(h)
