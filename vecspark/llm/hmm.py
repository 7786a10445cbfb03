"""A hidden Markov language model trained by Baum-Welch on the whole corpus.

A hidden state emits a word class, a class emits a word: the HEAD_CLASSES most frequent words are classes
of their own, all other words fall into HASH_CLASSES classes by hash, and a word's share of its class is
its smoothed corpus count. So the model is of fixed size, while the counts behind it cover every word. Words
are told apart by 64-bit hashes of their bytes.

1. Word counts of all training texts: counted in the task, summed by word.
2. One pass turns each text into class numbers (2 bytes a token). Words among the LOOKUP most frequent,
   a fixed number, are looked up in the task; the rest go to a join with the counts.
3. Baum-Welch: PASSES passes over all training texts. Each task runs scaled forward-backward over its whole
   texts in lockstep and emits expected counts, which Spark sums.
4. The scaled forward recursion over each whole text gives its exact log likelihood; the rest words' terms
   come from the join and are added.

Scores do not depend on how the rows are dealt, but for the rounding of sums (single precision in step 3).

Defined cases: a null text is empty (one token, the end); rows that share a doc_id are scored each; a null
doc_id counts as held out; extra columns are ignored; with no training text every count is zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, flat_word_hashes, free_shuffles, sliced, texts

STATES = 8
HEAD_CLASSES, HASH_CLASSES = 2048, 2048
#: The end of a text, and the number of classes.
END, CLASSES = HEAD_CLASSES + HASH_CLASSES, HEAD_CLASSES + HASH_CLASSES + 1
#: Words with their counts that every task holds: a fixed number, about 2 MB.
LOOKUP = 65_536
PASSES = 7
SEED = 7
#: Tokens trained on at a time (a longer text is taken alone), and of a segment that runs in lockstep with others.
TRAINED, SEGMENT = 500_000, 128
#: Tokens scored at a time.
BUFFER = 3_000_000
ADD = 0.1


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c) by word hash over the rows of docs (text): counted in the task in bounded tables, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in sliced(batches):
            new, c = np.unique(flat_word_hashes(texts(b.column(0)), lower=True)[0], return_counts=True)
            if len(keys) + len(new) > 300_000:
                yield _counted(keys, sums)
                keys, sums = keys[:0], sums[:0]
            i = np.searchsorted(keys, new)
            old = np.zeros(len(new), bool)
            if len(keys):
                old = keys[np.minimum(i, len(keys) - 1)] == new
            sums[i[old]] += c[old]
            keys, sums = np.insert(keys, i[~old], new[~old]), np.insert(sums, i[~old], c[~old])
        yield _counted(keys, sums)

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _counted(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["h", "c"])


class Vocabulary:
    """Corpus totals, the LOOKUP most frequent words by hash and the totals of the hash classes."""

    def __init__(self, counts: DataFrame, n_docs: int):
        total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.tokens, self.distinct, self.end = (total or 0) + n_docs, distinct + (n_docs > 0), n_docs
        top = counts.orderBy(F.desc("c"), "h").limit(LOOKUP).collect()
        self.full = len(top) >= LOOKUP
        keys, c = np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.c for r in top], np.int64)
        self.least = int(c.min()) if len(c) else 0
        k = (HEAD_CLASSES + (keys % np.uint64(HASH_CLASSES))).astype(np.int64)
        head = slice(0, HEAD_CLASSES)
        sums = counts.groupBy(class_of("h").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
        class_c, class_v = np.zeros(HASH_CLASSES), np.zeros(HASH_CLASSES)
        for r in sums:
            class_c[r.k], class_v[r.k] = r.c, r.v
        np.subtract.at(class_c, k[head] - HEAD_CLASSES, c[head])
        np.subtract.at(class_v, k[head] - HEAD_CLASSES, 1)
        self.class_c, self.class_total = class_c, class_c + ADD * (class_v + 1)
        inner = np.log10((c + ADD) / self.class_total[k - HEAD_CLASSES])
        k[head] = np.arange(len(k[head]))
        inner[head] = 0
        self.head_c = c[head].astype(float)
        order = np.argsort(keys)
        self.keys, self.k, self.base_of, self.inner_of = keys[order], k[order], self.base(c)[order], inner[order]

    def base(self, c: float | np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.tokens + ADD * (self.distinct + 1)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in the table (any where there is none) and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return i, self.keys[i] == h


def class_of(h: str) -> Column:
    """The hash class, less HEAD_CLASSES, of a word hash."""
    return F.col(h).bitwiseAND(HASH_CLASSES - 1)


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """rid, doc_id, held_out, n_tokens, n_known, base, inner, classes, rest (hash, times) of docs (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for b in sliced(batches):
            n = b.num_rows
            h, size = flat_word_hashes(texts(b.column(2)), lower=True)
            names, which = np.unique(h, return_inverse=True)
            at, ok = v.find(names)
            k = (HEAD_CLASSES + (names % np.uint64(HASH_CLASSES))).astype(np.uint16)
            base, inner = np.zeros(len(names)), np.zeros(len(names))
            k[ok], base[ok], inner[ok] = v.k[at[ok]], v.base_of[at[ok]], v.inner_of[at[ok]]
            doc = np.repeat(np.arange(n), size)
            add = lambda x: np.bincount(doc, x[which], n)
            classes = np.full(len(h) + n, END, np.uint16)
            classes[np.arange(len(h)) + doc] = k[which]
            ends = np.cumsum(size + 1)
            bits = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32).tobytes()), pa.py_buffer(classes.tobytes())])
            # The rest words of each text, each once.
            far = np.flatnonzero(~ok[which])
            pair, times = np.unique(doc[far] * len(names) + which[far], return_counts=True)
            own, name = (pair // len(names), pair % len(names)) if len(names) else (pair, pair)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32))
            rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(names[name].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "k"]))
            known, end = add(ok.astype(float)).astype(np.int64) + (v.end > 0), v.base(v.end)
            cols = [pa.array(np.arange(rid, rid + n)), b.column(0), b.column(1), pa.array(size + 1), pa.array(known), pa.array(add(base) + end), pa.array(add(inner)), bits, rest]
            rid += n
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "classes", "rest"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, classes binary, rest array<struct<h:long,k:int>>")


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, unigram: np.ndarray) -> Model:
        rng = np.random.RandomState(SEED)
        emit = unigram * np.exp(rng.normal(size=(STATES, CLASSES)))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, counts: np.ndarray, unigram: np.ndarray) -> Model:
        start, move, emit = np.split(counts, [STATES, STATES + STATES**2])
        start, move, emit = start + 1, move.reshape(STATES, STATES) + 1, emit.reshape(STATES, CLASSES) + 20 * unigram
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def lanes(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts end to end, their starts and lengths, longest first."""
    size = np.array([len(p) for p in parts])
    order = np.argsort(-size, kind="stable")
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.concatenate(parts), starts[order], size[order]


def expected_counts(m: Model, parts: list[np.ndarray], out: np.ndarray) -> None:
    """Adds the expected start, transition and emission counts of the parts (whole texts) to out.

    Texts are cut into segments of SEGMENT tokens that run in lockstep. Nothing is lost at a cut: each segment
    begins with the exact forward vector, and ends with the exact backward vector, of its text; both come from
    the products of the step matrices of the segments before and after.
    """
    flat, size = np.concatenate(parts), np.array([len(p) for p in parts])
    k = -(-size // SEGMENT)
    first = np.cumsum(k) - k
    number = np.arange(int(k.sum())) - np.repeat(first, k)
    begin = np.repeat(np.cumsum(size) - size, k) + number * SEGMENT
    length = np.minimum(SEGMENT, np.repeat(size, k) - number * SEGMENT)
    order = np.argsort(-length, kind="stable")
    lane = np.empty(len(order), np.int64)
    lane[order] = np.arange(len(order))
    begin, length, number = begin[order], length[order], number[order]
    # Token t of all segments longer than t, then token t + 1, and so on; a row a state.
    live = [int(np.searchsorted(-length, -t)) for t in range(int(length[0]))]
    at = [0, *np.cumsum(live).tolist()]
    symbols = np.concatenate([flat[begin[:n] + t] for t, n in enumerate(live)])
    start, move = m.start.astype(np.float32), m.move.astype(np.float32)
    back = np.ascontiguousarray(move.T)
    seen = np.take(m.emit.astype(np.float32), symbols, axis=1)
    before, beta = np.repeat(start[:, None], len(order), 1), np.ones((STATES, len(order)), np.float32)
    if k.max() > 1:
        _carry(seen, live, at, start, move, first, k, lane, before, beta)
    alpha, scale = np.empty_like(seen), np.empty(len(flat), np.float32)
    for t, n in enumerate(live):
        here = slice(at[t], at[t] + n)
        a = (before if t == 0 else back @ alpha[:, at[t - 1] : at[t - 1] + n]) * seen[:, here]
        s = scale[here] = a.sum(0)
        np.divide(a, s, out=alpha[:, here])
    # With this scale the products of both vectors sum to one at every token.
    beta /= (alpha[:, np.array(at)[length - 1] + np.arange(len(order))] * beta).sum(0)
    gamma, moved = np.empty_like(seen), np.zeros((STATES, STATES))
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        here = slice(at[t], at[t] + n)
        np.multiply(alpha[:, here], beta[:, :n], out=gamma[:, here])
        x = seen[:, here] * beta[:, :n]
        x /= scale[here]
        if t:
            beta[:, :n] = move @ x
            moved += alpha[:, at[t - 1] : at[t - 1] + n] @ x.T
        else:
            later = np.flatnonzero(number > 0)  # the token before is the last of the segment before
            moved += alpha[:, at[SEGMENT - 1] + lane[order[later] - 1]] @ x[:, later].T if len(later) else 0
    out[:STATES] += gamma[:, lane[first]].sum(1)
    out[STATES : STATES + STATES**2] += (moved * m.move).ravel()
    for j in range(STATES):
        out[STATES + STATES**2 + j * CLASSES :][:CLASSES] += np.bincount(symbols, gamma[j], CLASSES)


def _carry(seen: np.ndarray, live: list[int], at: list[int], start: np.ndarray, move: np.ndarray, first: np.ndarray, k: np.ndarray, lane: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """Fills before (the predicted states at its first token) and after (the backward vector at its last) of each segment."""
    # Product of each segment's steps, scaled: [j, i] is state j of the forward vector that starts in state i.
    step = np.zeros((STATES, STATES, live[0]), np.float32)
    step[range(STATES), range(STATES)] = seen[:, : live[0]]
    back = np.ascontiguousarray(move.T)
    for t, n in enumerate(live[1:], 1):
        x = (back @ step[:, :, :n].reshape(STATES, -1)).reshape(STATES, STATES, n)
        x *= seen[:, None, at[t] : at[t] + n]
        if t % 2:
            x /= x.sum((0, 1))
        step[:, :, :n] = x
    step /= step.sum((0, 1))
    a, b = np.repeat(start[:, None], len(first), 1), np.ones((STATES, len(first)), np.float32)
    for j in range(int(k.max()) - 1):
        on = np.flatnonzero(k > j + 1)
        x = (step[:, :, lane[first[on] + j]] * a[:, on]).sum(1)
        a[:, on] = before[:, lane[first[on] + j + 1]] = back @ (x / x.sum(0))
    for j in range(int(k.max()) - 1, 0, -1):
        on = np.flatnonzero(k > j)
        x = move @ (step[:, :, lane[first[on] + j]] * b[:, None, on]).sum(0)
        b[:, on] = after[:, lane[first[on] + j - 1]] = x / x.sum(0)


def baum_welch(rows: DataFrame, m: Model, unigram: np.ndarray) -> Model:
    """One pass over the rows (classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(STATES + STATES**2 + STATES * CLASSES)
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for c in b.column(0).to_pylist():
                k = np.frombuffer(c, np.uint16)
                if held and size + len(k) > TRAINED:
                    expected_counts(m, held, out)
                    held, size = [], 0
                held.append(k)
                size += len(k)
        if held:
            expected_counts(m, held, out)
        at = np.nonzero(out)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["i", "x"])

    counts = np.zeros(STATES + STATES**2 + STATES * CLASSES)
    for r in rows.select("classes").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        counts[r.i] = r.x
    return Model.of_counts(counts, unigram)


def log_likelihoods(m: Model, parts: list[np.ndarray]) -> np.ndarray:
    """log10 P(part) of whole texts by the scaled forward recursion, in lockstep."""
    flat, starts, size = lanes(parts)
    emit = np.ascontiguousarray(m.emit.T)
    ll, alpha = np.zeros(len(size)), np.empty((0, STATES))
    k = len(size)
    for t in range(int(size[0])):
        while size[k - 1] <= t:
            k -= 1
        a = emit[flat[starts[:k] + t]]
        a *= m.start if t == 0 else alpha[:k] @ m.move
        s = a.sum(1)
        alpha = a / s[:, None]
        ll[:k] += np.log10(s)
    out = np.empty(len(size))
    out[np.argsort(-np.array([len(p) for p in parts]), kind="stable")] = ll
    return out


def forward(rows: DataFrame, m: Model) -> DataFrame:
    """rid and the log10 likelihood of its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(log_likelihoods(m, parts))], names=["rid", "ll"])

        ids, parts, size = [], [], 0
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(r)
                parts.append(np.frombuffer(c, np.uint16))
                size += len(parts[-1])
                if size >= BUFFER:
                    yield out()
                    ids, parts, size = [], [], 0
        if ids:
            yield out()

    return rows.select("rid", "classes").mapInArrow(run, "rid long, ll double")


def train(coded: DataFrame, v: Vocabulary) -> Model:
    unigram = np.full(CLASSES, ADD)
    unigram[: len(v.head_c)] += v.head_c
    unigram[HEAD_CLASSES:END] += v.class_c
    unigram[END] += v.end
    unigram /= unigram.sum()
    m = Model.first(unigram)
    rows = coded.where("not held_out")
    for _ in range(PASSES):
        m = baum_welch(rows, m, unigram)
    return m


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ident = F.col(id_col).cast("long").alias("doc_id")
    d = docs.select(ident, (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = cut(word_counts(d.where("not held_out")), "counts")
    v = Vocabulary(counts, d.where("not held_out").count())
    free_shuffles(spark)
    coded = cut(encode(d, v), "coded")
    m = train(coded, v)
    sums = cut(forward(coded, m), "forward")
    tail = coded.select("rid", F.inline("rest"))
    # Fixed size: HASH_CLASSES rows.
    totals = F.broadcast(spark.createDataFrame(list(enumerate(map(float, v.class_total))), "class long, total double"))
    # Counts of distinct words, dealt by hash: a part's share of them is small.
    rare = counts.where(F.col("c") <= (v.least if v.full else 0)).hint("shuffle_hash")
    seen = tail.join(rare, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    seen = seen.withColumn("class", class_of("h")).join(totals, "class")
    rest = seen.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"),
        F.sum(F.col("k") * F.log10((F.col("c") + ADD) / (v.tokens + ADD * (v.distinct + 1)))).alias("rest_base"),
        F.sum(F.col("k") * F.log10((F.col("c") + ADD) / F.col("total"))).alias("rest_inner"),
    )
    rest = cut(rest, "rest")
    drop(counts)
    free_shuffles(spark)
    out = coded.drop("classes", "rest").join(sums, "rid").join(rest, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("known")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rest_base")).alias("base_score"),
        (F.col("ll") + F.col("inner") + zero("rest_inner")).alias("score"),
    )
