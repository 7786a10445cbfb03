"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass makes each document's shingle set, its fingerprint, its MinHash signature and band keys.
   Documents with equal sets form a class at once; only one row a class goes on.
2. Classes that share a band key are candidates. Each bucket first compares its members to one pivot,
   so a bucket of n costs n - 1 pairs, and links are contracted to components.
3. Buckets that still hold several components meet as groups: the members outside the bucket's largest
   component ("open") are compared to all members of other components. Large buckets are dealt in blocks;
   open rows meet every block, rows of the largest component only the open blocks. A group keeps its own
   components and gives links alone, at most one a member, so no pair that fails leaves it. No bucket,
   however large, is cut short, and no link is lost.
4. A candidate pair is checked signature batch by signature batch: it is dropped as soon as the posterior
   probability that its similarity reaches the threshold (uniform prior, binomial matches) is below
   `miss`. Survivors are compared on their full sets.
5. Links are contracted to components by star contraction.

Banding finds a pair of similarity 0.8 with probability 1 - (1 - 0.8^4)^32, all but 5e-8.

Defined cases: null or wordless texts have an empty set and link with nothing; rows that share a doc_id
are one node; a row without a doc_id takes the component of the documents of equal set and is kept only if
there is none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, free_shuffles, gram_hashes, mix64, sliced, texts, word_hashes
from .graph import components

SHINGLE = 5
THRESHOLD = (80, 100)
BANDS, ROWS = 32, 4
#: Hashes compared between two looks at the posterior.
BATCH = 16
#: Probability of dropping a pair that reaches the threshold, a look.
MISS = 1e-9
#: Equal buckets up to this size count once.
SMALL = 16
#: Members, and shingles of all members, of a block of a large bucket.
BLOCK, BLOCK_GRAMS = 4096, 2_000_000

_rng = np.random.RandomState(20_240_501)
_MULT = (_rng.randint(0, 2**32, BANDS * ROWS, np.uint64) << np.uint64(32) | _rng.randint(0, 2**32, BANDS * ROWS, np.uint64)) | np.uint64(1)
_XOR = _rng.randint(0, 2**32, BANDS * ROWS, np.uint64) << np.uint64(32) | _rng.randint(0, 2**32, BANDS * ROWS, np.uint64)


def shingle_sets(batch: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles; a shorter text is one shingle."""
    out = []
    for h in word_hashes(batch, lower=True):
        if len(h) >= n:
            out.append(np.unique(gram_hashes(h, n)))
        else:
            out.append(gram_hashes(h, len(h)) ^ np.uint64(len(h)) if len(h) else h)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row a set (none empty)."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 32_768):
            size += len(sets[end])
            end += 1
        h = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        t = np.empty_like(h)
        for i in range(BANDS * ROWS):
            np.bitwise_xor(h, _XOR[i], out=t)
            np.multiply(t, _MULT[i], out=t)
            out[at:end, i] = np.minimum.reduceat(t, starts) >> np.uint64(32)
        at = end
    return out


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(grams.tobytes())
    return d >> 64, d & (2**64 - 1)


def prepare(docs: DataFrame, shingle: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (set size), f1, f2 (fingerprint of the set), sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(texts(b.column(1)), shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            marks = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, 2)
            sig = [None] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full]) if full else ()):
                sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)), pa.array(sig, pa.binary())],
                names=["doc_id", "n", "f1", "f2", "sig"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig binary")


def band_keys(sigs: DataFrame) -> DataFrame:
    """(node, n, key, band) of each of the BANDS bands of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bands = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(b.num_rows, BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (b.num_rows, BANDS)).copy()
                for r in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
            band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
            node, n = (pa.array(np.repeat(b.column(c).to_numpy(), BANDS)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([node, n, pa.array(key.view(np.int64).ravel()), pa.array(band)], names=["node", "n", "key", "band"])

    return sigs.select("node", "n", "sig").mapInArrow(run, "node long, n long, key long, band int")


@cache
def least_matches(miss: float, threshold: float) -> tuple[int, ...]:
    """For each look, the fewest matches that keep a pair: P(similarity >= threshold | matches) >= miss."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        # With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def verify(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, threshold: tuple[int, int], miss: float) -> DataFrame:
    """The pairs (a, b) that reach the threshold. sigs: (node, n, sig); sets: (node, grams)."""
    num, den = threshold
    least = least_matches(miss, num / den)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in (2, 3))
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for look, need in enumerate(least):
                part = slice(look * BATCH, (look + 1) * BATCH)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(1)
                alive = alive[matches[alive] >= need]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(alive)), b.column(1).take(pa.array(alive))], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (p, q))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1]).rename_columns(["a", "b"]) if b.num_rows else b.select([0, 1])

    s = lambda c: sigs.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"s_{c}"))
    near = pairs.join(s("a"), "a").join(s("b"), "b").where((den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")))
    kept = near.select("a", "b", "s_a", "s_b").mapInArrow(prune, "a long, b long")
    g = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"g_{c}"))
    return kept.join(g("a"), "a").join(g("b"), "b").select("a", "b", "g_a", "g_b").mapInArrow(exact, "a long, b long")


def gram_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, f1, grams) of (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(texts(b.column(1)), shingle)
            marks = np.array([fingerprint(s)[0] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "f1", "grams"])

    return docs.mapInArrow(run, "node long, f1 long, grams binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept (doc_id = component_id) of every row."""
    spark = docs.sparkSession
    rows = cut(prepare(docs, shingle, id_col, text), "minhash")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    member = cut(rows.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2"], "left"), "members")
    heads = rows.join(member.where("doc_id = node").select("f1", "f2", "node").distinct(), ["f1", "f2"]).where("doc_id = node")
    sigs = cut(heads.groupBy("node").agg(F.min("f1").alias("f1"), F.min_by("n", "f1").alias("n"), F.min_by("sig", "f1").alias("sig")), "signatures")
    several = member.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("doc_id")
    same_id = member.join(several, "doc_id", "left_semi").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    drop(rows)

    keys = band_keys(sigs)
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = cut(keys.join(shared, "key"), "buckets")
    wanted = docs.select(F.col(id_col).alias("node"), F.col(text).alias("text")).join(buckets.select("node").distinct(), "node", "left_semi")
    sets = cut(gram_sets(wanted, shingle).join(sigs.select("node", "f1"), ["node", "f1"], "left_semi").dropDuplicates(["node"]).drop("f1"), "sets")
    free_shuffles(spark)

    pairs = cut(buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = cut(verify(pairs, sigs, sets, threshold, miss), "links")
    drop(pairs)
    label = components(links)
    state = cut(open_buckets(buckets, label), "open")
    drop(buckets)
    if state.limit(1).count():
        more = cut(open_links(state, sigs, sets, threshold, miss), "links")
        if more.limit(1).count():
            links = links.unionByName(more)
            label = components(links)
    free_shuffles(spark)
    # Documents of equal sets hang on their class; a doc_id with several texts joins their classes.
    roots = components(links.unionByName(same_id)) if same_id.limit(1).count() else label
    drop(sets)
    drop(sigs)
    out = member.join(roots, F.coalesce(member.node, member.doc_id) == roots.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", member.node, "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def open_buckets(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """(key, band, node, component, open, parts, mains) of the buckets that hold several components.

    open: not of the bucket's largest component; parts, mains: blocks of the open rows and of the others. Of
    small buckets with the same members only the one of the least band stays.
    """
    state = buckets.join(label, "node", "left").select("key", "band", "node", "n", F.coalesce("component", "node").alias("component"))
    of = state.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("g"))
    of = of.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.max(F.struct("k", "component", "g")).alias("top"), F.sum("k").alias("k"), F.sum("g").alias("g")).where("k > top.k")
    blocks = lambda k, g: F.ceil(F.greatest(k / BLOCK, g / BLOCK_GRAMS)).cast("int")
    of = of.select("key", "main", F.col("k").alias("size"), blocks(F.col("k") - F.col("top.k"), F.col("g") - F.col("top.g")).alias("parts"), blocks(F.col("top.k"), F.col("top.g")).alias("mains"))
    state = cut(state.join(of, "key").withColumn("open", F.col("component") != F.col("main")), "several")
    lists = state.where(F.col("size") <= SMALL).groupBy("key", "band").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    again = lists.groupBy("nodes").agg(F.min_by("key", "band").alias("key")).select("key")
    out = state.where(F.col("size") > SMALL).unionByName(state.where(F.col("size") <= SMALL).join(again, "key", "left_semi"))
    return out.select("key", "band", "node", "component", "open", "parts", "mains")


def open_links(state: DataFrame, sigs: DataFrame, sets: DataFrame, threshold: tuple[int, int], miss: float) -> DataFrame:
    """Links (a, b) between different components of a bucket: enough to join all that are linked there.

    A group has an open block on its left; on its right another open block or one of the largest component.
    """
    num, den = threshold
    least = least_matches(miss, num / den)

    def answer(group: list[tuple]) -> pa.RecordBatch:
        node, comp, n = (np.array(c, np.int64) for c in list(zip(*group))[2:5])
        left = np.array([g[5] for g in group])
        within, earlier = group[0][6], group[0][7] * ROWS
        sig = np.frombuffer(b"".join(g[8] for g in group), np.uint32).reshape(len(group), -1)
        flat = np.unique(np.concatenate([np.frombuffer(g[9], np.uint64) for g in group]), return_inverse=True)[1]
        ends = np.cumsum(n)
        begin, mark = ends - n, np.zeros(int(flat.max()) + 1, bool)
        found_a, found_b = [], []
        for i in np.flatnonzero(left).tolist():
            other = (comp != comp[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))
            other &= (~left | (node > node[i])) if within else ~left
            j = np.flatnonzero(other)
            matches = np.zeros(len(j), np.int64)
            for look, need in enumerate(least):
                if not len(j):
                    break
                part = slice(look * BATCH, (look + 1) * BATCH)
                matches += (sig[j, part] == sig[i, part]).sum(1)
                ok = matches >= need
                j, matches = j[ok], matches[ok]
            if not len(j):
                continue
            # A pair that shares several buckets counts in the first.
            j = j[~(sig[j, :earlier] == sig[i, :earlier]).reshape(len(j), earlier // ROWS, ROWS).all(2).any(1)]
            if not len(j):
                continue
            mine = flat[begin[i] : ends[i]]
            mark[mine] = True
            first = np.cumsum(n[j]) - n[j]
            both = np.add.reduceat(mark[flat[np.repeat(begin[j] - first, n[j]) + np.arange(int(n[j].sum()))]], first, dtype=np.int64)
            mark[mine] = False
            j = j[den * both >= num * (n[j] + n[i] - both)]
            for c, at in zip(*np.unique(comp[j], return_index=True)):
                found_a.append(min(node[i], node[j[at]]))
                found_b.append(max(node[i], node[j[at]]))
                comp[comp == c] = comp[i]
        return pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[:2] != held[0][:2]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    # Open block x meets each open block y > x, and block d of the largest component as parts + d; the first of these
    # groups also compares x with itself.
    total = F.col("parts") + F.col("mains")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("open"), F.col("parts")).otherwise(F.col("mains"))).cast("int")
    partners = F.when(F.col("open"), F.filter(F.sequence(F.lit(0), total - 1), lambda y: y != F.col("mine"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = state.withColumn("mine", mine).withColumn("other", F.explode(partners)).withColumn("mine", F.when(F.col("open"), F.col("mine")).otherwise(F.col("parts") + F.col("mine")))
    rows = rows.withColumn("meet", F.least("mine", "other").cast("long") * total + F.greatest("mine", "other"))
    rows = rows.withColumn("left", F.col("mine") < F.col("other")).withColumn("within", F.greatest("mine", "other") == F.col("parts"))
    rows = rows.join(sigs.select("node", "n", "sig"), "node").join(sets, "node")
    dealt = rows.select("key", "meet", "node", "component", "n", "left", "within", "band", "sig", "grams").repartition("key", "meet").sortWithinPartitions("key", "meet", "node")
    return dealt.mapInArrow(run, "a long, b long")
