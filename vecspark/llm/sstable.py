"""Token ids in sorted-string-table shards.

A shard file holds documents in key order:

* blocks: entries of one or more documents, each (shared prefix length, rest of the key, payload length,
  token count) followed by the payloads (unsigned 16- or 32-bit ids), compressed with zstd;
* index: first key, offset and length of each block (sparse: one entry a block);
* Bloom filter over the keys;
* footer: offsets of index and filter, counts, check sum and magic number.

A key is the doc_id (big-endian, sign bit flipped, so that bytes sort as numbers) and a serial number for
rows that share it; null ids have a key below all others. A lookup asks the filter, searches the index by
bisection and opens one block.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, new_path, partitions, texts
from .tokens import encoder, public_path

MAGIC = b"VSST0001"
BLOCK = 1 << 18
BLOOM_BITS, BLOOM_HASHES = 10, 7
END = 2
_ENTRY, _FOOTER, _INDEX = struct.Struct("<HHII"), struct.Struct("<QQQQQII8s"), struct.Struct("<13sQI")


def key_of(doc: int | None, serial: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc is None else b"\1" + struct.pack(">Q", (doc + (1 << 63)) & (2**64 - 1))) + struct.pack(">I", serial)


def doc_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _bloom(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, one row a key (its doc_id part as unsigned 64-bit)."""
    h = mix64(keys + np.uint64(0x9E3779B97F4A7C15))
    step = mix64(h) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Writes entries that come in key order; memory holds one block, the index and the keys' hashes."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.packer = zstandard.ZstdCompressor(level=1)
        self.index: list[tuple[bytes, int, int]] = []
        self.docs: list[int] = []
        self.heads, self.bodies, self.size, self.first, self.last = [], [], 0, b"", b""
        self.count = self.tokens = self.sum = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.last and key <= self.last:
            raise ValueError("keys must rise")
        shared = 0
        if self.heads:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        body = ids.astype(f"<u{self.width}").tobytes()
        self.heads.append(_ENTRY.pack(shared, len(key) - shared, len(body), len(ids)) + key[shared:])
        self.bodies.append(body)
        self.last, self.size = key, self.size + len(body)
        self.docs.append(struct.unpack(">Q", key[1:9])[0])
        self.count += 1
        self.tokens += len(ids)
        if self.size >= BLOCK:
            self.end_block()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)
        self.sum = crc32(data, self.sum)

    def end_block(self) -> None:
        if self.heads:
            data = self.packer.compress(struct.pack("<I", len(self.heads)) + b"".join(self.heads) + b"".join(self.bodies))
            self.index.append((self.first, self.at, len(data)))
            self.write(data)
            self.heads, self.bodies, self.size = [], [], 0

    def close(self) -> None:
        self.end_block()
        index_at = self.at
        self.write(b"".join(_INDEX.pack(*x) for x in self.index))
        bits = max(64, -(-self.count * BLOOM_BITS // 8) * 8)
        table = np.zeros(bits, bool)
        if self.docs:
            table[_bloom(np.array(self.docs, np.uint64), bits).ravel()] = True
        bloom_at = self.at
        self.write(np.packbits(table).tobytes())
        self.out.write(_FOOTER.pack(index_at, bloom_at, bits, self.count, self.tokens, self.width, self.sum, MAGIC))
        self.out.close()


class Reader:
    """Reads a shard through a random-access file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - _FOOTER.size)
        self.index_at, bloom_at, self.bits, self.count, self.tokens, self.width, self.sum, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(self.index_at)
        raw = file.read(bloom_at - self.index_at)
        self.blocks = list(_INDEX.iter_unpack(raw))
        self.firsts = [b[0] for b in self.blocks]
        self.filter = np.unpackbits(np.frombuffer(file.read(size - _FOOTER.size - bloom_at), np.uint8)).astype(bool)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        _, at, length = self.blocks[i]
        self.file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.file.read(length))
        (n,) = struct.unpack_from("<I", data)
        heads, pos, key = [], 4, b""
        for _ in range(n):
            shared, rest, size, tokens = _ENTRY.unpack_from(data, pos)
            pos += _ENTRY.size
            key = key[:shared] + data[pos : pos + rest]
            pos += rest
            heads.append((key, size, tokens))
        for key, size, tokens in heads:
            yield key, np.frombuffer(data, f"<u{self.width}", tokens, pos).astype("<u4")
            pos += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, doc: int | None) -> bool:
        k = np.array([struct.unpack(">Q", key_of(doc)[1:9])[0]], np.uint64)
        return bool(self.count and self.filter[_bloom(k, self.bits).ravel().astype(np.int64)].all())

    def get(self, doc: int | None) -> list[np.ndarray]:
        """The ids of every row of that doc_id, by bisection of the sparse index."""
        out: list[np.ndarray] = []
        if not self.may_hold(doc):
            return out
        want = key_of(doc)[:9]
        i = max(0, bisect.bisect_right(self.firsts, want + bytes(4)) - 1)
        while i < len(self.blocks) and self.firsts[i][:9] <= want:
            out += [ids for key, ids in self.block(i) if key[:9] == want]
            i += 1
        return out


def open_file(path: str):
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def ranges(docs: DataFrame, id_col: str, n: int) -> list[int]:
    """At most n - 1 bounds that cut the ids into about equal ranges; only the id column is read."""
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], 10_000).alias("b")).first().b if n > 1 else []
    return sorted(set(found or []))


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", end: int = END, shards: int | None = None) -> DataFrame:
    """Encodes docs into shard files under path: (shard, path, docs, tokens), ascending by doc_id over shards.

    Rows are dealt by id range, so a task holds one range, sorts it and streams it into its file. A retried
    task writes another file; the table names the files of the tasks that Spark accepted.
    """
    source, n = tokenizer or public_path("byte_bpe_50k.json"), shards or partitions(docs.sparkSession)
    bounds = ranges(docs, id_col, n)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shard = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.aggregate(F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>"), F.lit(0), lambda a, b: a + (F.col("doc_id") > b).cast("int")))
    dealt = rows.withColumn("shard", shard).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, writer, name, last, serial, shard = encoder(source, True, added=True), None, None, "", (), 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                flat, counts = enc.encode(texts(part.column(1)))
                for doc, ids, s in zip(part.column(0).to_pylist(), np.split(flat, np.cumsum(counts)[:-1]), part.column(2).to_pylist()):
                    if writer is None:
                        shard, where = s, fs.FileSystem.from_uri(path)
                        where[0].create_dir(where[1], recursive=True)
                        name = f"{path}/shard-{s:06d}-{uuid.uuid4().hex}.sst"
                        out = where[0].open_output_stream(fs.FileSystem.from_uri(name)[1])
                        writer = Writer(out, 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4)
                    serial = serial + 1 if last == (doc,) else 0
                    last = (doc,)
                    writer.add(key_of(doc, serial), np.append(ids, np.uint32(end)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [name], "docs": pa.array([writer.count], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

    return dealt.mapInArrow(run, "shard long, path string, docs long, tokens long")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the files; start counts all ids before it."""
    # One row a file: the running total is over the shard table, not the documents.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = shards.select("path", before.alias("start"), (F.row_number().over(Window.orderBy("shard")) - 1).alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                size = 0
                with open_file(path) as f:
                    for key, ids in Reader(f):
                        rows.append((doc_of(key), start, len(ids), ids.tobytes()))
                        start += len(ids)
                        size += len(ids)
                        if size > 1_000_000:
                            yield _rows(rows)
                            rows, size = [], 0
                yield _rows(rows)

    n = shards.count()
    return listed.repartitionById(max(1, n), F.col("file")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.binary()])], names=["doc_id", "start", "n_tokens", "ids"])


def token_table(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes docs to shard files and gives what the files hold (see write_shards and read_shards)."""
    path = path or new_path(docs.sparkSession, "tokens")
    return read_shards(cut(write_shards(docs, path, **options), "shards"))


def digest(table: DataFrame) -> DataFrame:
    """ids replaced by their crc32."""
    return table.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
