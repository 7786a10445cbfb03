"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. Documents longer than a
sequence give full sequences first; their rests and all shorter documents wait in a bounded buffer. The
open sequence takes, of the waiting pieces that fit in every limit, the one with the largest dot product of
its weighted sizes and the space left. When none fits and more than `slack` tokens are free, the longest
waiting piece is cut to fill the gap. Each task packs its own rows, so nothing is shuffled; only a task's last
sequence is short.

Defined cases: a null or empty text is its end token alone; rows that share a doc_id are packed each; extra
columns are ignored; an empty table gives no rows. A retried task packs the same rows the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .tokens import encoder, public_path

SEQUENCE = 2048
MAX_SEGMENTS = 64
#: Pieces that wait at a time.
WAITING = 2048
SLACK = 16
END = 1


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    loss: int
    total: int


class Packer:
    """Packs pieces under (tokens, segments, loss-bearing tokens) <= limits."""

    def __init__(self, limits: tuple[int, int, int], slack: int = SLACK, waiting: int = WAITING):
        self.limits, self.slack, self.most = np.array(limits, np.float64), slack, waiting
        self.sizes = np.zeros((waiting * 2, 3))
        self.free: list[int] = list(range(waiting * 2))[::-1]
        self.count = 0
        self.slots: list[Piece | None] = [None] * (waiting * 2)

    def put(self, p: Piece) -> None:
        i = self.free.pop()
        self.slots[i] = p
        self.sizes[i] = (len(p.ids), 1, p.loss)
        self.count += 1

    def take(self, i: int) -> Piece:
        p = self.slots[i]
        assert p
        self.slots[i] = None
        self.sizes[i] = 0
        self.free.append(i)
        self.count -= 1
        return p

    def fill(self) -> list[Piece]:
        """One sequence of waiting pieces."""
        left, out = self.limits.copy(), []
        scaled = self.sizes / self.limits
        while self.count:
            fits = (self.sizes[:, 0] > 0) & (self.sizes <= left).all(1)
            if fits.any():
                score = np.where(fits, scaled @ (left / self.limits), -1.0)
                i = int(score.argmax())
                p = self.take(i)
                scaled[i] = 0
            elif left[0] > self.slack and left[1] >= 1 and left[2] >= 1:
                i = int(self.sizes[:, 0].argmax())
                whole = self.take(i)
                # Loss-bearing tokens are taken as spread evenly over a piece.
                n = len(whole.ids)
                k = int(min(left[0], n - 1, left[2] * n // max(whole.loss, 1)))
                if k < 1:
                    self.put(whole)
                    break
                loss = min(whole.loss, -(-whole.loss * k // n))
                p = Piece(whole.doc, whole.start, whole.ids[:k], loss, whole.total)
                self.put(Piece(whole.doc, whole.start + k, whole.ids[k:], whole.loss - loss, whole.total))
                scaled = self.sizes / self.limits
            else:
                break
            out.append(p)
            left -= (len(p.ids), 1, p.loss)
            if left[0] < 1 or left[1] < 1:
                break
        return out

    def add(self, p: Piece) -> Iterator[list[Piece]]:
        full = int(self.limits[0])
        while len(p.ids) >= full and p.loss <= self.limits[2] * (len(p.ids) / full):
            loss = -(-p.loss * full // len(p.ids))
            if loss > self.limits[2]:
                break
            yield [Piece(p.doc, p.start, p.ids[:full], loss, p.total)]
            p = Piece(p.doc, p.start + full, p.ids[full:], p.loss - loss, p.total)
        if len(p.ids):
            self.put(p)
        while self.count >= self.most:
            yield self.fill()

    def flush(self) -> Iterator[list[Piece]]:
        while self.count:
            yield self.fill()


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    loss_share: str | None = None,
    limits: tuple[int, int, int] = (SEQUENCE, MAX_SEGMENTS, SEQUENCE),
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids, loss_tokens.

    loss_share: a column with the share of a document's tokens that bear loss (null or none: all).
    """
    path = tokenizer or public_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path, False, added=True), Packer(limits)
        serial = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(pieces: list[Piece]) -> None:
            nonlocal serial
            offset = 0
            for p in pieces:
                raw = p.ids.tobytes()
                rows.append((p.doc, p.start, len(p.ids), crc32(raw), p.total, serial, offset, raw, p.loss))
                offset += len(p.ids)
            serial += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "loss_tokens"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                flat, counts = enc.encode(texts(part.column(1)))
                for doc, ids, share in zip(part.column(0).to_pylist(), np.split(flat, np.cumsum(counts)[:-1]), part.column(2).to_pylist()):
                    ids = np.append(ids, np.uint32(END))
                    loss = round(len(ids) * min(max(1.0 if share is None else share, 0.0), 1.0))
                    for full in packer.add(Piece(doc, 0, ids, loss, len(ids))):
                        emit(full)
                yield batch()
        for full in packer.flush():
            emit(full)
        yield batch()

    share = F.col(loss_share).cast("double") if loss_share else F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), share.alias("share"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, loss_tokens long")
