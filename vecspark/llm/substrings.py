"""Substring dedup with FM-index shards.

A word goes if a window of WINDOW words over it also starts in a document with a smaller id.

1. Every window has an anchor, the least hash of its runs of GRAM words, so equal windows have equal
   anchors, and neighbours mostly share theirs. Documents are cut into stretches of one anchor. Anchors of
   one document only are dropped: counts are partially aggregated before the shuffle, so a common passage
   is as cheap as a rare one.
2. The texts of the remaining stretches are dealt by anchor, equal stretches merged with their least and
   greatest document. Stretches of an anchor with very many contexts are first cut into single windows and
   dealt by window, so no anchor gathers in one task.
3. Each shard indexes its stretches in a compressed FM-index and streams them against it: matching
   statistics by backward search give, for every window at the threshold, the least document that holds it.
4. Windows held by a smaller document come back to their documents, and the words under them go.

Defined cases: a null or wordless text has no words; rows that share a doc_id do not remove each other's
words; a null doc_id counts as the greatest; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, flat_word_hashes, free_shuffles, gram_hashes, sliced, texts
from .fmindex import FMIndex

WINDOW = 13
GRAM = 6
#: Stretches indexed at a time, and contexts of one anchor before it is dealt by window.
SHARD, HOT = 50_000, 5_000
LAST = 2**63 - 1


def stretches(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, anchor, first window and number of windows of each stretch of texts (word hashes end to end, words a text)."""
    gram = min(GRAM, window)
    if len(words) < window:
        e = np.zeros(0, np.int64)
        return e, e, e, e
    least, span, want = gram_hashes(words, gram), 1, window - gram + 1
    while span < want:
        by = min(span, want - span)
        least = np.minimum(least[:-by], least[by:])
        span += by
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    whole = np.flatnonzero(np.arange(len(least)) + window <= ends[text])  # windows that end in their text
    least, text = least[whole], text[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], least[at].view(np.int64), whole[at] - (ends - counts)[text[at]], np.diff(np.append(at, len(whole)))


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(t).alias("mark"), t.alias("text"))


def _occurrences(keyed: DataFrame, window: int, places: bool) -> DataFrame:
    """(anchor, doc) and, with places, mark, first and n of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text, anchor, first, n = stretches(*flat_word_hashes(texts(b.column(2))), window)
            own = pa.array(text)
            cols = {"anchor": pa.array(anchor), "doc": b.column(0).take(own)}
            if places:
                cols |= {"mark": b.column(1).take(own), "first": pa.array(first.astype(np.int32)), "n": pa.array(n.astype(np.int32))}
            yield pa.RecordBatch.from_pydict(cols)

    return keyed.mapInArrow(run, "anchor long, doc long" + ", mark long, first int, n int" * places)


def _contents(joined: DataFrame, window: int) -> DataFrame:
    """The words of the stretches of (doc, mark, text, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if not b.num_rows:
                continue
            parts = [t.split() for t in texts(b.column(2))]
            # All words, one space between: a stretch is a slice.
            flat = [w for p in parts for w in p]
            joined, place = b" ".join(flat), np.cumsum([0, *map(len, flat)]) + np.arange(len(flat) + 1)
            before = np.cumsum([0, *map(len, parts)])
            own = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
            found = b.column(3).flatten()
            first, n = (found.field(c).to_numpy() for c in ("first", "n"))
            at = before[own] + first
            start, stop = place[at], place[at + n + window - 1] - 1
            words = pa.array([joined[x:y] for x, y in zip(start.tolist(), stop.tolist())], pa.binary()).cast(pa.string())
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), found.field("first"), found.field("anchor"), words], names=["doc", "mark", "first", "route", "words"])

    return joined.mapInArrow(run, "doc long, mark long, first int, route long, words string")


def _search(unique: DataFrame, window: int, shard: int) -> DataFrame:
    """(route, h, least array): of each distinct stretch, the least document of each of its windows."""

    def answer(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        route, h, low, high = (rows.column(c).to_numpy() for c in ("route", "h", "low", "high"))
        # Words become dense numbers by their hashes.
        hashes, sizes = flat_word_hashes([t for c in rows.column("words").chunks for t in texts(c)])
        flat = np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1
        starts = np.cumsum(sizes) - sizes
        least = FMIndex(flat, sizes, low, window).least_values(flat, starts, sizes)
        counts = sizes - window + 1
        owner = np.repeat(np.arange(len(route)), counts)
        # A stretch of one document whose windows nobody before it holds has nothing to report.
        tells = (high > low) | (np.bincount(owner, least < low[owner], len(route)) > 0)
        values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[tells])]).astype(np.int32)), pa.array(least[tells[owner]]))
        return pa.RecordBatch.from_arrays([pa.array(route[tells]), pa.array(h[tells]), values], names=["route", "h", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            while b.num_rows:
                route = b.column(0).to_numpy()
                if size >= shard:
                    # A full shard ends where its last route does.
                    other = np.flatnonzero(route != last)
                    cut_at = int(other[0]) if len(other) else len(route)
                    held.append(b.slice(0, cut_at))
                    b = b.slice(cut_at)
                    if b.num_rows:
                        yield answer(held)
                        held, size = [], 0
                    continue
                take = min(b.num_rows, shard - size)
                held.append(b.slice(0, take))
                size, last = size + take, route[take - 1]
                b = b.slice(take)
        if held:
            yield answer(held)

    dealt = unique.select("route", "h", "words", "low", "high").repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(run, "route long, h long, least array<long>")


def covered(n_words: int, windows: list[int], window: int) -> np.ndarray:
    """Which of the words lie under the windows."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.unique(np.array(windows, np.int64))
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + window, n_words), 1)
    return np.cumsum(edge[:-1]) > 0


def flagged_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc, mark, windows): starts of the windows of each text that a smaller document holds."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text)
    shared = cut(_occurrences(keyed, window, False).groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor"), "anchors")
    free_shuffles(spark)
    # Anchors are distinct and dealt by hash: a part's share of them is small.
    found = cut(_occurrences(keyed, window, True).join(shared.hint("shuffle_hash"), "anchor").groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "n", "anchor")).alias("found")), "found")
    drop(shared)
    free_shuffles(spark)
    parts = cut(_contents(keyed.join(found, ["doc", "mark"]).select("doc", "mark", "text", "found"), window).withColumn("h", F.xxhash64("words")), "stretches")
    drop(found)
    free_shuffles(spark)
    unique = _unique(parts)
    busy = cut(unique.groupBy("route").count().where(F.col("count") > hot).select("route"), "hot")
    free_shuffles(spark)
    if busy.limit(1).count():
        w = F.split("words", " ")
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("ws", i + 1, window), " ").alias("words")))
        single = parts.join(busy, "route").withColumn("ws", w).select("doc", "mark", "first", F.explode(windows).alias("x"))
        single = single.select("doc", "mark", (F.col("first") + F.col("x.i")).alias("first"), F.xxhash64(F.col("x.words"), F.lit(1)).alias("route"), F.col("x.words").alias("words"), F.xxhash64("x.words").alias("h"))
        parts = cut(parts.join(busy, "route", "left_anti").select(*single.columns).unionByName(single), "stretches")
        unique = _unique(parts)
    least = cut(_search(unique, window, shard), "least")
    free_shuffles(spark)
    hits = parts.select("doc", "mark", "first", "route", "h").join(least, ["route", "h"])
    hits = hits.withColumn("w", F.expr("transform(filter(transform(least, (v, i) -> if(v < doc, i, -1)), i -> i >= 0), i -> first + i)")).where("size(w) > 0")
    out = cut(hits.groupBy("doc", "mark").agg(F.flatten(F.collect_list("w")).alias("windows")), "flagged")
    drop(parts)
    drop(least)
    free_shuffles(spark)
    return out


def _unique(parts: DataFrame) -> DataFrame:
    return parts.groupBy("route", "h", "words").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (remaining words, one space between) and the `keep` columns of every row."""
    flagged = flagged_windows(docs, id_col, text, window)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("_t"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(t).alias("mark"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    joined = rows.join(flagged, ["doc", "mark"], "left").select("doc_id", "_t", "windows", *[f"keep_{c}" for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n_words, n_removed, left = [], [], []
            for x, windows in zip(texts(b.column(1)), b.column(2).to_pylist()):
                words = x.split()
                n = len(words)
                if windows:
                    gone = covered(n, windows, window)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                n_words.append(n)
                n_removed.append(n - len(words))
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string()), *b.columns[3:]], names=["doc_id", "n_words", "n_removed", "kept", *[f"keep_{c}" for c in keep]]
            )

    kinds = dict(docs.dtypes)
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string" + "".join(f", `keep_{c}` {kinds[c]}" for c in keep))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
