"""Exact BM25 top-k over an inverted index with block-max pruning.

The index is a table: segments of at most SEGMENT documents, a row a term of a segment with its postings
(document places and counts) in blocks of BLOCK, each block with its largest count and shortest document, which
bound its scores whatever the corpus statistics turn out to be. Document counts and frequencies come from
the whole index. A search reads only the rows of its terms and groups them by segment. In a segment each query moves
through the documents in order: the pivot is the next place whose current blocks' maxima add up to the k-th score so
far, and every term's cursor goes to the block of the pivot, so the blocks passed over are not decoded. Terms too light
to reach that score together lead to no pivot: only their blocks around documents of heavier terms are decoded. Places
between two block ends share their current blocks and are taken together, several pivots at a time; the few with the
largest sums go first, which gives a k-th score to begin with. Segment results are merged by a window.

Defined cases: a null text has length 0 and matches nothing; a query without known terms has no rows; ties go to
the smaller doc_id; rows that share a doc_id are ranked each; queries that share an id are one query of all their
words; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sliced, texts

K1, B = 1.2, 0.75
SEGMENT, BLOCK = 2048, 64
#: Pivots taken at first; each further step takes twice as many.
PRIME = 8
#: Text of queries searched at a time; larger query sets go in several rounds.
QUERY_BYTES = 4_000_000


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(segment, term, n, places, counts, tops, shorts); the row with a null term has the ids and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["segment", "term", "n", "places", "counts", "tops", "shorts"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        segment = TaskContext.get().partitionId() << 24
        ids: list[int | None] = []
        lengths: list[int] = []
        lists: dict[bytes, tuple[list[int], list[int]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            size = np.array(lengths, "<i8")
            known = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], "<i8")
            rows: list[tuple] = [(segment, None, len(ids), known.tobytes(), size.tobytes(), None, None)]
            for term, (places, counts) in lists.items():
                p, c = np.array(places, "<u2"), np.array(counts, "<u4")
                at = np.arange(0, len(p), BLOCK)
                rows.append((segment, term, len(p), p.tobytes(), c.tobytes(), np.maximum.reduceat(c, at).tobytes(), np.minimum.reduceat(size[p], at).astype("<u4").tobytes()))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=names)

        for b in sliced(batches):
            for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                words = t.lower().split()
                place = len(ids)
                ids.append(i)
                lengths.append(len(words))
                for w, c in Counter(words).items():
                    got = lists.get(w)
                    if got is None:
                        got = lists[w] = ([], [])
                    got[0].append(place)
                    got[1].append(c)
                if len(ids) >= SEGMENT:
                    yield from out()
                    segment, ids, lengths, lists = segment + 1, [], [], {}
        if ids:
            yield from out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "segment long, term binary, n long, places binary, counts binary, tops binary, shorts binary")


class Segment:
    """The asked terms' postings of a segment, behind each other, and the bounds of their blocks."""

    def __init__(self, rows: list[tuple], mean: float):
        head = next(r for r in rows if r[0] is None)
        lists = [r for r in rows if r[0] is not None]
        self.ids, size = np.frombuffer(head[2], "<i8"), np.frombuffer(head[3], "<i8").astype(float)
        self.soft = K1 * (1 - B + B * size / max(mean, 1e-9))
        self.number = {r[0]: i for i, r in enumerate(lists)}
        self.places = np.frombuffer(b"".join(r[2] for r in lists), "<u2")
        self.counts = np.frombuffer(b"".join(r[3] for r in lists), "<u4")
        top, short = (np.frombuffer(b"".join(r[c] for r in lists), "<u4").astype(float) for c in (4, 5))
        self.top = top * (K1 + 1) / (top + K1 * (1 - B + B * short / max(mean, 1e-9)))
        n = np.array([r[1] for r in lists], np.int64)
        blocks = -(-n // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        within = np.arange(blocks.sum()) - np.repeat(self.first[:-1], blocks)
        self.begin = np.repeat(np.cumsum(n) - n, blocks) + within * BLOCK
        self.stop = np.minimum(self.begin + BLOCK, np.repeat(np.cumsum(n), blocks))
        self.low, self.high = self.places[self.begin].astype(np.int64), self.places[self.stop - 1].astype(np.int64) + 1
        self.asked = self.decoded = 0

    def best(self, terms: list[tuple[bytes, float]], k: int) -> list[tuple[int, float]]:
        """(doc_id, score) of the k best and all that tie with the last of them."""
        have = [(self.number[t], w) for t, w in terms if t in self.number]
        if not have:
            return []
        of = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i, _ in have])
        sizes = np.array([self.first[i + 1] - self.first[i] for i, _ in have])
        weight = np.repeat([w for _, w in have], sizes)
        # Between two edges the same blocks are current for every document, so one sum of maxima bounds them all.
        edge, at = np.unique(np.concatenate([self.low[of], self.high[of]]), return_inverse=True)
        enter, leave = at[: len(of)], at[len(of) :]
        gain = weight * self.top[of]
        bound = np.cumsum(np.bincount(enter, gain, len(edge)) - np.bincount(leave, gain, len(edge)))[:-1] * (1 + 1e-9) + 1e-9
        stretch = np.searchsorted(edge, np.arange(len(self.ids)), side="right") - 1
        score, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        self.asked += len(of)
        # What a term adds at most, together with all terms that add no more.
        most = np.maximum.reduceat(gain, np.cumsum(sizes) - sizes)
        reach = np.empty(len(most))
        reach[np.argsort(most, kind="stable")] = np.cumsum(np.sort(most)) * (1 + 1e-9) + 1e-9

        def decode(chosen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            """Adds the scores of the chosen blocks at the wanted documents, and gives those found."""
            b = of[chosen]
            self.decoded += len(b)
            length = self.stop[b] - self.begin[b]
            pos = np.repeat(self.begin[b] - np.cumsum(length) + length, length) + np.arange(length.sum())
            d = self.places[pos].astype(np.int64)
            inside = wanted[d]
            d, f = d[inside], self.counts[pos[inside]].astype(float)
            part = np.repeat(weight[chosen], length)[inside] * (f * (K1 + 1) / (f + self.soft[d]))
            score[:] += np.bincount(d, part, len(score))
            return d

        def visit(pivots: np.ndarray, limit: float) -> float:
            """Scores the documents of the stretches that can reach the limit, and gives the k-th score."""
            chosen = np.zeros(len(edge), bool)  # the last stands for all places outside
            chosen[pivots] = True
            before = np.concatenate([[0], np.cumsum(chosen)])
            current = before[leave] > before[enter]
            # Terms that cannot reach the limit together lead to no document of their own.
            leads = np.repeat(reach >= limit, sizes)
            found = np.zeros(len(self.ids), bool)
            found[decode(current & leads, chosen[stretch])] = True
            held = np.concatenate([[0], np.cumsum(found)])
            decode(current & ~leads & (held[self.high[of]] > held[self.low[of]]), found)
            seen[found] = True
            bound[pivots] = np.nan  # not again
            known = score[seen]
            return np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf

        limit = visit(np.argsort(-bound, kind="stable")[:PRIME], -np.inf)
        cursor, step = 0, PRIME
        while True:
            ahead = cursor + np.flatnonzero(bound[cursor:] >= limit)[:step]
            if not len(ahead):
                break
            limit = visit(ahead, limit)
            cursor, step = int(ahead[-1]) + 1, step * 2
        hit = np.flatnonzero(seen & (score >= limit))
        if not len(hit):
            return []
        # Scores are equal only up to rounding.
        last = np.sort(score[hit])[::-1][min(k, len(hit)) - 1]
        return [(int(self.ids[i]), float(score[i])) for i in np.flatnonzero(seen & (score >= last - 1e-9))]


def search_segment(queries: dict[int, list[tuple[bytes, float]]], rows: list[tuple], mean: float, k: int) -> list[tuple[int, int, float]]:
    """(query, doc_id, score) of each query's k best of a segment. queries: (term, idf times its count)."""
    if len(rows) < 2:  # none of the terms
        return []
    segment = Segment(rows, mean)
    return [(q, doc, score) for q, terms in queries.items() for doc, score in segment.best(terms, k)]


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query, by exact BM25 over the whole index."""
    heads = index.where("term is null")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(np.frombuffer(x, "<i8").sum()) for x in b.column(1).to_pylist()], pa.int64())], names=["n", "words"])

    n, total = heads.select("n", "counts").mapInArrow(lengths, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    n, mean = n or 0, (total or 0) / max(n or 0, 1)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // QUERY_BYTES))
    parts = [_search_round(index, heads, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r), n, mean, k) for r in range(rounds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.col("rounded").desc(), F.col("doc_id").asc())
    out = out.withColumn("rounded", F.round("score", 9)).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "doc_id", "score")


def _search_round(index: DataFrame, heads: DataFrame, asked: DataFrame, n: int, mean: float, k: int) -> DataFrame:
    spark = index.sparkSession
    # At most about QUERY_BYTES of text.
    words: dict[int | None, Counter[bytes]] = {}
    for r in asked.collect():
        words.setdefault(r.query_id, Counter()).update(r.text.encode().lower().split())
    terms = sorted({w for c in words.values() for w in c})
    wanted = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in terms], "term binary"))
    rows = cut(index.join(wanted, "term"), "postings")
    freq = {bytes(r.term): r.df for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    idf = {t: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in freq.items()}
    plan = {q: [(t, idf[t] * c[t]) for t in sorted(c) if t in idf] for q, c in words.items()}

    def run(table: pa.Table) -> pa.Table:
        found = search_segment(plan, list(zip(*(table.column(c).to_pylist() for c in ("term", "n", "places", "counts", "tops", "shorts")))), mean, k)
        cols = list(zip(*found)) or [[]] * 3
        return pa.table({"query_id": pa.array(list(cols[0]), pa.int64()), "doc_id": pa.array(list(cols[1]), pa.int64()), "score": pa.array(list(cols[2]), pa.float64())})

    return rows.unionByName(heads).groupBy("segment").applyInArrow(run, "query_id long, doc_id long, score double")
