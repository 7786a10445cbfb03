"""The training-data operators against brute-force versions on small tables."""

import itertools
import math
import re
import tempfile
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import bm25, hmm, licenses, minhash, packing, quality, queries, secrets, segmentation, sstable, substrings
from vecspark.llm.automaton import Automaton
from vecspark.llm.common import flat_word_hashes
from vecspark.llm.fmindex import FMIndex
from vecspark.llm.tokens import encoder, public_path

DATA = "/root/testdata/sf0.001"
RNG = np.random.RandomState(3)
WORDS = [f"w{i}" for i in range(300)]


def prose(n, seed):
    return " ".join(np.random.RandomState(seed).choice(WORDS, n).tolist())


def fixture_rows():
    base = prose(120, 1)
    rows = [(0, base), (1, base.upper()), (2, None), (3, ""), (4, " \n\t "), (5, "two words"), (6, "Two  WORDS"), (7, "two words"), (7, "two words"), (None, base)]
    for i in range(40):
        w = base.split()
        r = np.random.RandomState(100 + i)
        for j in r.choice(120, 1 + i % 9, replace=False):
            w[j] = f"x{r.randint(1000)}"
        rows.append((20 + i, " ".join(w)))
    rows += [(100 + i, prose(40 + i, 500 + i) + "\n" + prose(20, 7)) for i in range(10)]
    rows.append((200, prose(4000, 9)))
    rows.append((201, "ab" * 30_000))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "x", "src", 1, True, 5) for i, t in fixture_rows()], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long")
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


# --- near duplicates -------------------------------------------------------------------------------
def brute_components(rows, n):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations([i for i in sets if i is not None], 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets if i is not None}


@pytest.mark.parametrize("small,block", [(16, 4096), (2, 4)])
def test_near_duplicates(docs, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_duplicates(docs, shingle=4).collect()
    rows = fixture_rows()
    assert len(got) == len(rows)
    want = brute_components(rows, 4)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == 0 and not r.kept  # an exact copy of document 0
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


@pytest.mark.parametrize("small,block,linked", [(16, 4096, False), (0, 5, False), (2, 3, True), (16, 1, False)])
def test_groups_alone_join_all_that_are_linked(spark, monkeypatch, small, block, linked):
    """The comparison in groups by itself, with nothing or one pair of a class linked before."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(i, t) for i, t in fixture_rows() if i is not None and t and i != 7]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = minhash.prepare(d, 4).where("n > 0").select(F.col("doc_id").alias("node"), "n", "sig").cache()
    sets = minhash.gram_sets(d.select(F.col("doc_id").alias("node"), "text"), 4).select("node", "grams").cache()
    keys = minhash.band_keys(sigs)
    buckets = keys.join(keys.groupBy("key").agg(F.count("node").alias("size")).where("size > 1"), "key")
    want = brute_components(rows, 4)
    pair = next(((a, c) for a, (_, c) in want.items() if a != c), None) if linked else None
    label = spark.createDataFrame([(x, pair[1]) for x in pair] if pair else [], "node long, component long")
    links = minhash.open_links(minhash.open_buckets(buckets, label), sigs, sets, (80, 100), 1e-9).collect()
    comp = {i: i for i in want}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in [(r.a, r.b) for r in links] + ([pair] if pair else []):
        assert want[a][1] == want[b][1]
        x, y = find(a), find(b)
        comp[max(x, y)] = min(x, y)
    assert {i: find(i) for i in want} == {i: c for i, (_, c) in want.items()}


def test_sequential_test_is_safe():
    least = minhash.least_matches(1e-9, 0.8)
    assert list(least) == sorted(least) and least[0] == 0 or least[0] <= 4
    n = minhash.BANDS * minhash.ROWS
    miss = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least[-1]))
    assert miss < 1e-7


# --- substrings ------------------------------------------------------------------------------------------
def brute_substrings(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            key, d = tuple(w[j : j + k]), substrings.LAST if i is None else i
            first[key] = min(first.get(key, d), d)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (substrings.LAST if i is None else i):
                gone |= set(range(j, j + k))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("shard,hot,window", [(50_000, 5_000, 13), (3, 2, 13), (50_000, 5_000, 20), (7, 3, 33)])
def test_substring_dedup(docs, spark, monkeypatch, shard, hot, window):
    monkeypatch.setattr(substrings.flagged_windows, "__defaults__", ("doc_id", "text", window, shard, hot))
    shared = prose(window + 1, 77)  # exactly one word more than a window, in two documents
    more = [(900, f"{prose(20, 78)} {shared} x"), (901, f"y {shared} {prose(30, 79)}")]
    got = substrings.substring_dedup(docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True), window=window, keep=("text",)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in got), key=key) == sorted(brute_substrings(fixture_rows() + more, window), key=key)


def test_fm_index_counts():
    seqs = [np.array([1, 2, 3, 1, 2]), np.array([2, 3, 1, 2, 2]), np.array([3, 3, 3])]
    flat, sizes = np.concatenate(seqs), np.array([5, 5, 3])
    got = FMIndex(flat, sizes, np.array([5, 4, 9]), 3).least_values(flat, np.array([0, 5, 10]), sizes)
    assert got.tolist() == [5, 4, 4, 4, 4, 4, 9]


@pytest.mark.parametrize("length", [1, 2, 5, 13, 16, 17, 31, 40])
def test_fm_index_finds_the_least_at_any_length(length):
    seqs = [RNG.randint(1, 4 if length < 6 else 2 + i % 2, length + RNG.randint(0, 30)) for i in range(40)]
    flat, sizes, values = np.concatenate(seqs), np.array([len(s) for s in seqs]), RNG.randint(0, 1000, 40)
    got = FMIndex(flat, sizes, values, length).least_values(flat, np.cumsum(sizes) - sizes, sizes)
    low = {}
    for s, v in zip(seqs, values.tolist()):
        for j in range(len(s) - length + 1):
            k = tuple(s[j : j + length])
            low[k] = min(low.get(k, v), v)
    assert got.tolist() == [low[tuple(s[j : j + length])] for s in seqs for j in range(len(s) - length + 1)]


# --- secrets ---------------------------------------------------------------------------------------------
def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate((("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        for m in p.finditer(t):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_secret_spans(spark):
    alphabet = ["token", "API_KEY", "apikey", "=", " ", ":", '"', "abc123", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "é", "\n", "passwd", "secret", "x", "-", "\U00010000"]
    texts = ["".join(RNG.choice(alphabet, RNG.randint(1, 40))) for _ in range(600)] + ["a" * 100_000 + "g", "token=" + "z" * 70_000, "", "AKIA" * 10]
    got = secrets.find_spans([t.encode() for t in texts])
    for t, s in zip(texts, got):
        assert [x for x in s if x[2] in ("assign", "access", "hex")] == brute_spans(t)
    df = spark.createDataFrame([(1, None), (2, "é password: hunter22"), (2, "é password: hunter22")], "doc_id long, text string")
    rows = secrets.secret_spans(df).collect()
    assert [r.spans for r in rows] == ["", "assign:2:20", "assign:2:20"] and rows[0].base_sha256 == sha256(b"").hexdigest()
    assert [r.text for r in secrets.redact(df).collect()] == [None, "é <ASSIGN>", "é <ASSIGN>"]


def test_automaton_is_minimal_and_exact():
    a = Automaton([("ab*c", False), ("(?:x|y){2,3}", True)])
    for s in map("".join, itertools.product("abcxY", repeat=5)):
        want = (1 if re.search("ab*c", s) else 0) | (2 if re.search("[xyXY]{2,3}", s) else 0)
        found = 0
        for _, _, f in a.scan(s.encode()):
            found |= f
        assert found == want
    assert len(Automaton([("a", False)]).table) == 2


# --- tokens ------------------------------------------------------------------------------------------------
def ids_of(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(name))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def encoded(enc, texts):
    flat, counts = enc.encode([t.encode() for t in texts])
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("name,lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoder_is_exact(name, lead):
    parts = ["Hello", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u2003", "\u3000", "\0", "\x1c", "\x85", "中文", "<|startoftext|>", "world's", "don't", "é", " ", "123", "!!", "<|endoftext|>", "ﬁ", "İ", "é", " ", "\x1c", "Σ", "Größe,", "ª", "word.", "É", "µ", "STRASSE", "naïve"]
    texts = ["".join(RNG.choice(parts, RNG.randint(0, 14))) for _ in range(800)] + ["", " ", "a b"]
    assert encoded(encoder(public_path(name), lead, added=True), texts) == ids_of(name, texts)


def test_packing_covers_every_id_once(docs, empty):
    got = packing.pack(docs).collect()
    rows = fixture_rows()
    want = Counter()
    for (i, t), ids in zip(rows, ids_of("word_bpe_49k.json", [t or "" for _, t in rows])):
        want[i, len(ids) + 1, tuple([*ids, 1])] += 1
    pieces = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.concatenate([[0], np.cumsum([r.length for r in s])[:-1]]).tolist()
        assert sum(r.length for r in s) <= 2048 and len(s) <= packing.MAX_SEGMENTS and sum(r.loss_tokens for r in s) <= 2048
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    single = {k for k, n in Counter((i, n) for i, n, _ in want.elements()).items() if n == 1}
    for i, n, ids in want:
        if (i, n) in single:
            assert [x for _, p in sorted(pieces[i, n]) for x in p] == list(ids)
    assert sum(r.length for r in got) == sum(n * k for (_, n, _), k in want.items())
    assert packing.pack(empty).count() == 0


def test_packing_keeps_three_limits(spark):
    df = spark.createDataFrame([(i, prose(5 + i % 30, i), 0.5 if i % 2 else None) for i in range(60)], "doc_id long, text string, share double")
    seqs = {}
    for r in packing.pack(df, loss_share="share", limits=(256, 5, 150)).collect():
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        assert sum(r.length for r in s) <= 256 and len(s) <= 5 and sum(r.loss_tokens for r in s) <= 150


def test_token_shards(docs, empty, tmp_path):
    where = f"file://{tmp_path}/t"
    listed = sstable.write_shards(docs, where, shards=4).cache()
    got = {}
    for r in sstable.read_shards(listed).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = sorted(fixture_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (i, t), ids in zip(rows, ids_of("byte_bpe_50k.json", [t or "" for _, t in rows])):
        hit = [r for r in got[i] if r.start == start]
        assert len(hit) == 1 and np.frombuffer(hit[0].ids, "<u4").tolist() == [*ids, 2]
        start += len(ids) + 1
    readers = [sstable.Reader(sstable.open_file(r.path)) for r in listed.collect()]
    look = lambda i: [x.tolist() for r in readers for x in r.get(i)]
    assert look(5) == [[*ids_of("byte_bpe_50k.json", ["two words"])[0], 2]] and len(look(7)) == 2 and len(look(None)) == 1 and look(99_999) == []
    assert sstable.token_table(empty).count() == 0


# --- language model -------------------------------------------------------------------------------------------
def test_language_model(docs):
    rows = fixture_rows()
    c, n_docs = Counter(), 0
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, t in rows:
        if not held(i):
            c.update([*words(t, True), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = [*words(t, True), None]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)] += 1
    got = hmm.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def brute_scores(rows):
    """The whole model, text by text and token by token in double precision."""
    name = {w: int(flat_word_hashes([w])[0][0]) for _, t in rows for w in words(t, True)}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [words(t, True) for i, t in rows if not held(i)]
    c = Counter(name[w] for t in train for w in t)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    head = {h: k for k, h in enumerate(sorted(c, key=lambda h: (-c[h], signed(h)))[: min(hmm.HEAD_CLASSES, hmm.LOOKUP)])}
    cls = lambda h: head.get(h, hmm.HEAD_CLASSES + h % hmm.HASH_CLASSES)
    class_c, class_v = Counter(), Counter()
    for h in c:
        if h not in head:
            class_c[cls(h)] += c[h]
            class_v[cls(h)] += 1
    inner = lambda h: 0.0 if h in head else math.log10((c[h] + 0.1) / (class_c[cls(h)] + 0.1 * (class_v[cls(h)] + 1)))
    unigram = np.full(hmm.CLASSES, 0.1)
    for h in c:
        unigram[cls(h)] += c[h]
    unigram[hmm.END] += len(train)
    unigram /= unigram.sum()
    coded = lambda t: [*(cls(name[w]) for w in t), hmm.END]
    m = hmm.Model.first(unigram)

    def forward(s):
        a, out, ll = m.start * m.emit[:, s[0]], [], 0.0
        for t in range(len(s)):
            a = a if t == 0 else (out[-1] @ m.move) * m.emit[:, s[t]]
            ll += math.log10(a.sum())
            out.append(a / a.sum())
        return out, ll

    for _ in range(hmm.PASSES):
        start, move, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.STATES, hmm.CLASSES))
        for s in map(coded, train):
            alpha, _ = forward(s)
            beta = np.ones(hmm.STATES)
            for t in range(len(s) - 1, -1, -1):
                g = alpha[t] * beta
                emit[:, s[t]] += g / g.sum()
                if t == 0:
                    start += g / g.sum()
                else:
                    x = np.outer(alpha[t - 1], m.emit[:, s[t]] * beta) * m.move
                    move += x / x.sum()
                    beta = m.move @ (m.emit[:, s[t]] * beta)
                    beta /= beta.sum()
        m = hmm.Model.of_counts(np.concatenate([start, move.ravel(), emit.ravel()]), unigram)
    return sorted((i is None, i or 0, forward(coded(words(t, True)))[1] + sum(inner(name[w]) for w in words(t, True))) for i, t in rows)


@pytest.mark.parametrize("lookup", [65_536, 60])
def test_scores_equal_brute_force_however_rows_are_dealt(docs, monkeypatch, lookup):
    """Also with so small a table that known words go through the join."""
    monkeypatch.setattr(hmm, "LOOKUP", lookup)
    monkeypatch.setattr(hmm, "PASSES", 4)
    rows = fixture_rows()
    want = brute_scores(rows)
    for n in (3, 7):
        got = hmm.score(docs.repartition(n)).collect()
        for r, w in zip(sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in got), want):
            assert r[:2] == w[:2] and r[2] == pytest.approx(w[2], rel=2e-4)


def test_known_words_beyond_the_table_come_from_the_join(docs, monkeypatch):
    monkeypatch.setattr(hmm, "LOOKUP", 60)
    test_language_model(docs)


def test_forward_is_exact_and_probabilities_sum_to_one():
    rng = np.random.RandomState(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = hmm.Model(norm(rng.uniform(size=3)), norm(rng.uniform(size=(3, 3))), norm(rng.uniform(size=(3, 4))))
    seqs = [np.array(s, np.uint16) for s in itertools.product(range(4), repeat=3)]
    p = 10 ** hmm.log_likelihoods(m, seqs)
    assert p.sum() == pytest.approx(1)
    for s, got in zip(seqs, p):
        want = sum(m.start[a] * m.emit[a, s[0]] * m.move[a, b] * m.emit[b, s[1]] * m.move[b, c] * m.emit[c, s[2]] for a, b, c in itertools.product(range(3), repeat=3))
        assert got == pytest.approx(want)


def test_expected_counts_are_exact(monkeypatch):
    rng = np.random.RandomState(2)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = hmm.Model(norm(rng.uniform(size=hmm.STATES)), norm(rng.uniform(size=(hmm.STATES,) * 2)), norm(rng.uniform(size=(hmm.STATES, hmm.CLASSES))))
    parts = [np.array([1, 5, 2], np.uint16), np.array([7, 7], np.uint16)]
    out = np.zeros(hmm.STATES + hmm.STATES**2 + hmm.STATES * hmm.CLASSES)
    hmm.expected_counts(m, parts, out)
    start, move, emit = np.split(out, [hmm.STATES, hmm.STATES + hmm.STATES**2])
    assert start.sum() == pytest.approx(2, rel=1e-5) and move.sum() == pytest.approx(3, rel=1e-5) and emit.sum() == pytest.approx(5, rel=1e-5)
    want = np.zeros((hmm.STATES, hmm.STATES))
    for s in parts:
        for path in itertools.product(range(hmm.STATES), repeat=len(s)):
            p = m.start[path[0]] * m.emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[path[t], s[t]]
            for t in range(1, len(s)):
                want[path[t - 1], path[t]] += p / 10 ** hmm.log_likelihoods(m, [s])[0]
    assert np.allclose(move.reshape(want.shape), want, rtol=1e-3)


def test_model_beats_the_base_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = hmm.score(d).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# --- quality, licences, search, sampling ------------------------------------------------------------------------
def test_quality_counts(docs, empty):
    got = quality.document_counts(docs, "text", {"doc_id": F.col("doc_id")}).collect()
    want = Counter()
    for i, t in fixture_rows():
        t = t or ""
        w = [x.decode() for x in words(t)]
        seen = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + o for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want[i, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(cover)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality.quality_rules(empty).count() == 0


def test_bad_hosts_go_and_clean_ones_stay(spark):
    good, bad = prose(80, 1), "word " * 80
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, bad, "bad") for i in range(200)] + [(500, good, "bad"), (501, good, None)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and got[501].kept and not got[100].kept and got[500].host_rejected and not got[500].kept and not got[500].base_failed


NOTICES = {
    "isc": "Permission to use, copy, modify, and/or distribute this software\nfor any purpose with or without fee is hereby granted, provided that\nthe above copyright notice and this permission notice appear in all copies.",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "lgpl": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl": "Released under the GNU Affero General Public License, version 3.",
    "bsd": "Released under the BSD License.",
    "mit": "Released under the MIT License.",
    "mpl": "Licensed under the Mozilla Public License 2.0",
    "apache": "Distributed under the terms of the Apache License, Version 2.0.",
    "cc_by": "Creative Commons Attribution 4.0 International",
    "cc_by_sa": "CC BY-SA 4.0",
    "cc_by_nc": "Licensed under CC BY-NC 4.0.",
    "public_domain": "CC0 1.0",
    "all_rights_reserved": "All rights reserved.",
}
CLEAN = ["the license of the house is old", "Eclipse Public License 2.0", "He lost his driving licence on a public road.", "Released under the moon.", "Under the terms of the deal, all seats were reserved.", "MIT professors like coffee", "Boost Software License 1.0"]


def test_licences(spark, empty):
    m = licenses.train()
    rows = [(1, "intro of it\n\n" + NOTICES["gpl"] + "\n\nmore"), (2, None), (3, ""), (4, prose(50, 1)), (5, NOTICES["cc_by_nc"] + "\nmore"), (5, NOTICES["cc_by_nc"] + "\nmore"), (None, NOTICES["mit"]), (6, prose(30_000, 2) + "\n" + NOTICES["bsd"])]
    rows += [(100 + i, t) for i, t in enumerate(NOTICES.values())] + [(200 + i, t) for i, t in enumerate(CLEAN)] + [(300, " \n\n-\n"), (301, NOTICES["mit"] + "\n" + NOTICES["mit"])]
    df = spark.createDataFrame([(*r, "x", 1, [2]) for r in rows], "doc_id long, text string, license string, _p int, candidates array<int>").repartition(3)
    scanned = licenses.scan(df)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.doc_id, r.n_paragraphs, [(c.paragraph, c.family, c.probability, c.similarity, c.confirmed) for c in r.candidates]) for r in scanned.collect()), key=key)
    for g, (i, t) in zip(got, sorted(rows, key=key)):
        want = m.judge(t or "")
        assert g[:2] == (i, len(licenses.paragraphs_of(t or ""))) and [c[:2] + c[4:] for c in g[2]] == [c[:2] + c[4:] for c in want]
        assert np.allclose([c[2:4] for c in g[2]], [c[2:4] for c in want], atol=2e-6)
    told = {r.doc_id: r.license for r in licenses.verdicts(scanned).collect()}
    assert [told[100 + i] for i in range(len(NOTICES))] == list(NOTICES)
    assert [told[200 + i] for i in range(len(CLEAN))] == [None] * len(CLEAN)
    assert [told[i] for i in (1, 2, 3, 4, 5, None, 6, 300, 301)] == ["gpl", None, None, None, "cc_by_nc", "mit", "bsd", None, "mit"]
    assert licenses.verdicts(licenses.scan(empty)).count() == 0


def test_licence_classifier_holds_out():
    m = licenses.train()
    assert m.classes[int(m.probabilities("").argmax())] == licenses.UNKNOWN
    right, c = np.diag(m.confusion), m.confusion
    assert (right[:-1] / c.sum(1)[:-1]).mean() > 0.93 and c[-1, :-1].sum() <= 0.01 * c[-1].sum()


def test_licence_bound_loses_no_candidate(spark):
    m = licenses.train()
    base, gain, need = m.gains()
    rng, used = np.random.RandomState(5), sorted({w for g in m.weights for w in g.split(" ")})
    texts = ["Released under\nthe\nMIT\n\nLicense.", "zzz MIT License\nqqq\nGNU General\nPublic License qqq", "CC\r\n \r\nBY 4.0\n\n-\nzz", "MIT\u00a0License \u00e9 GNU\u00e9GPL v3", "license " * 300, "zz\n" * 50 + "All rights reserved."]
    for i in range(150):
        w = [used[j] if rng.uniform() < 0.8 else "zzz" for j in rng.randint(0, len(used), rng.randint(1, 12))]
        name = list(NOTICES.values())[i % len(NOTICES)]
        texts.append(rng.choice([" ", "\n", ", "]).join([*w, name if i % 3 else "", *w[::-1]]))
    asked = found = 0
    for t in texts:
        hit = {c[0] for c in m.judge(t)}
        for i, p in enumerate(licenses.paragraphs_of(t)):
            may = base + sum(gain[g] for g in licenses.grams_of(licenses.words_of(p)) if g in gain) >= need
            assert may or i not in hit
            asked, found = asked + may, found + (i in hit)
    assert found > 100
    prose_may = [base + sum(gain[g] for g in licenses.grams_of(licenses.words_of(t)) if g in gain) >= need for t in CLEAN[3:4] + [prose(200, i) for i in range(20)]]
    assert not any(prose_may)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in licenses.scan(df).collect():
        want = m.judge(texts[r.doc_id])
        assert r.n_paragraphs == len(licenses.paragraphs_of(texts[r.doc_id]))
        assert [(c.paragraph, c.family, c.confirmed) for c in r.candidates] == [c[:2] + c[4:] for c in want]
        assert np.allclose([(c.probability, c.similarity) for c in r.candidates], [c[2:4] for c in want], atol=2e-6)


def test_bm25(docs, spark, empty, monkeypatch):
    monkeypatch.setattr(bm25, "SEGMENT", 16)
    rows = fixture_rows()
    qs = [(0, rows[20][1]), (1, "w1 w2 w3 nothing"), (2, None), (3, "zzz"), (4, "two two words")]
    got = {}
    for r in bm25.search(bm25.build_index(docs).cache(), spark.createDataFrame(qs, "item_id long, text string"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, round(r.score, 6)))
    ws = [(i, Counter(words(t, True))) for i, t in rows]
    n, mean = len(ws), sum(sum(c.values()) for _, c in ws) / len(ws)
    for q, t in qs:
        qc, scored = Counter(words(t, True)), []
        for i, c in ws:
            s = 0
            for w, k in qc.items():
                df = sum(w in x for _, x in ws)
                if c[w]:
                    s += k * math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            if s:
                scored.append((-round(s, 9), -1 << 63 if i is None else i, s))
        want = [(r + 1, None if i == -1 << 63 else i, round(s, 6)) for r, (_, i, s) in enumerate(sorted(scored)[:5])]
        assert [(a, None if b == -1 << 63 else b, c) for a, b, c in sorted(got.get(q, []))] == want
    assert bm25.search(bm25.build_index(empty), spark.createDataFrame(qs, "item_id long, text string"), 5).count() == 0


def test_sampled_segmentations(docs, empty):
    got = {}
    for r in segmentation.sampled_segmentations(docs, 3).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in fixture_rows():
        if i is None or i == 7:
            continue
        s = sorted(got[i], key=lambda r: r.rank)
        assert all(segmentation.decode(bytes(r.ids)) == (t or "") for r in s)
        assert len({bytes(r.ids) for r in s}) == len(s) and [r.perturbed for r in s] == sorted((r.perturbed for r in s), reverse=True)
        assert all(0 < r.inclusion <= 1 for r in s)
    assert len(got[2]) == 1 and got[2][0].n_pieces == 0 and got[2][0].inclusion == 1
    again = {(r.doc_id, r.rank, bytes(r.ids)) for r in segmentation.sampled_segmentations(docs.coalesce(1), 3).collect()}
    assert again == {(r.doc_id, r.rank, bytes(r.ids)) for rs in got.values() for r in rs}
    assert segmentation.sampled_segmentations(empty).count() == 0


def test_samples_follow_the_lattice():
    lat = segmentation.Lattices(public_path("piece_bpe_32k.model"), 0.2)
    text, n = "the", 6000
    out = []

    def walk(u, i, ids, w):
        if i == len(u):
            out.append((tuple(ids), w))
        for j in range(i + 1, len(u) + 1):
            if u[i:j] in lat.pieces:
                walk(u, j, [*ids, lat.pieces[u[i:j]][0]], w + lat.pieces[u[i:j]][1])

    walk("▁the", 0, [], 0.0)
    z = math.log(sum(math.exp(w) for _, w in out))
    p = {s: math.exp(w - z) for s, w in out}
    got = segmentation.sample(lat, [text.encode()] * n, np.arange(n, dtype=np.uint64) * 7919 + 1, 2)
    first = Counter(tuple(g[0][0].tolist()) for g in got)
    pairs = Counter((tuple(g[0][0].tolist()), tuple(g[1][0].tolist())) for g in got)
    for s in p:
        assert abs(first[s] / n - p[s]) < 5 * math.sqrt(p[s] / n) + 1e-3
        if p[s] > 0.02:  # rarer ones vary too much
            assert sum(1 / q for g in got for ids, _, _, q in g if tuple(ids.tolist()) == s) / n == pytest.approx(1, abs=0.25)
    for a, b in itertools.permutations(p, 2):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(pairs[a, b] / n - want) < 5 * math.sqrt(want / n) + 1e-3


def test_lattice_units_end_where_no_piece_crosses(monkeypatch):
    lat = segmentation.Lattices(public_path("piece_bpe_32k.model"), 0.2)
    # "▁the" once and three marks, not three words; the store's node 0 is the end.
    first, counts = lat.units([b"the,", b"the! the;", b""])
    assert counts.tolist() == [2, 4, 0] and first[0] == first[2] == first[4] and lat.nodes == 1 + 4 + 3

    def mass(text):
        m = [0.0] * (len(text) + 1)
        for i in range(len(text) - 1, -1, -1):
            scores = [lat.pieces[text[i:j]][1] + m[j] for j in range(i + 1, min(len(text), i + 16) + 1) if text[i:j] in lat.pieces]
            if text[i] not in lat.pieces:
                scores.append(lat.byte_weight * len(text[i].encode()) + m[i + 1])
            m[i] = max(scores) + math.log(sum(math.exp(x - max(scores)) for x in scores))
        return m[0]

    texts = ["the, quick!! Brown  fox\n(naïve) 漢字 \U0001f600\u0007x", "a", "", "ab" * 400, " ", "x" * 70_000]
    keys = np.arange(len(texts), dtype=np.uint64)
    got = segmentation.sample(lat, [t.encode() for t in texts], keys, 4)
    for t, s in zip(texts, got):
        assert len({ids.tobytes() for ids, *_ in s}) == len(s) and [x[2] for x in s] == sorted((x[2] for x in s), reverse=True)
        for ids, prob, _, inclusion in s:
            assert segmentation.decode(ids) == t and (0 < inclusion <= 1 or prob < -700)
            if 0 < len(t) < 1000 and all(c == "\n" or c >= " " for c in t) and max(t) < "\u2581":
                want = sum(float(lat.weight[i]) if lat.weight[i] else lat.byte_weight for i in ids.tolist())
                assert prob == pytest.approx(want - mass(segmentation.SPACE + t.replace(" ", segmentation.SPACE)), abs=1e-6)
    # All of a short text's segmentations, each once, with no value left over.
    every = segmentation.sample(lat, [b"in"], keys[:1], 50)[0]
    assert len(every) < 50 and sum(math.exp(x[1]) for x in every) == pytest.approx(1) and every[-1][3] == 1
    # Steps that are not asked for regions change nothing.
    for front, near in ((1, 0.5), (10**6, 1e9)):
        monkeypatch.setattr(segmentation, "FRONT", front)
        monkeypatch.setattr(segmentation, "NEAR", near)
        again = segmentation.sample(lat, [t.encode() for t in texts[:5]], keys[:5], 4)
        assert [[(i.tolist(), *x) for i, *x in s] for s in again] == [[(i.tolist(), *x) for i, *x in s] for s in got[:5]]


def test_later_samples_follow_the_lattice_too():
    lat = segmentation.Lattices(public_path("piece_bpe_32k.model"), 0.2)
    n = 20_000
    got = segmentation.sample(lat, [b"in,"] * n, np.arange(n, dtype=np.uint64) * 7919 + 1, 3)
    p = {ids.tobytes(): math.exp(prob) for g in got for ids, prob, _, _ in g}
    triples = Counter(tuple(x[0].tobytes() for x in g) for g in got)
    for t in itertools.permutations(p, 3):
        want = p[t[0]] * p[t[1]] / (1 - p[t[0]]) * p[t[2]] / (1 - p[t[0]] - p[t[1]])
        assert abs(triples[t] / n - want) < 5 * math.sqrt(want / n) + 1e-3
    top = np.array([g[0][2] for g in got])  # standard Gumbel
    assert abs(top.mean() - 0.5772) < 0.05 and abs(top.std() - math.pi / math.sqrt(6)) < 0.05
    for s in sorted(p, key=p.get)[-3:]:
        assert sum(1 / q for g in got for ids, _, _, q in g if ids.tobytes() == s) / n == pytest.approx(1, abs=0.1)


# --- queries and pipeline -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "op7_bm25_topk", "op8_quality_rules", "op10_fm_substring_dedup"])
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    rel = con.sql(queries.ORACLE_SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(rel.fetchall())


@pytest.mark.parametrize("name", ["op2", "op3", "op5", "op10"])
def test_empty_tables(spark, empty, name):
    f = {"op2": hmm.score, "op3": minhash.near_duplicates, "op5": secrets.secret_spans, "op10": substrings.substring_dedup}[name]
    assert f(empty).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    data = {r.doc_id: r for r in docs.collect()}
    at, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA).cache()
        at[name] = now
        if name != "packing":
            assert now.dtypes == docs.dtypes
    rated = {r.doc_id: r.kept for r in queries.op8_quality_rules(spark, DATA).collect()}
    kept = {i for i, k in rated.items() if k}
    assert {r.doc_id for r in at["quality_rules"].collect()} == kept
    comp = brute_components([(i, data[i].text) for i in kept], 5)
    single = {i for i in kept if comp[i][1] == i}
    assert {r.doc_id for r in at["near_dedup"].collect()} == single
    left = {i: (data[i].text if not gone else text.decode()) for i, n, gone, text in brute_substrings([(i, data[i].text) for i in sorted(single)], 13) if n > gone}
    assert {r.doc_id: r.text for r in at["substring_dedup"].collect()} == left
    clean = {r.doc_id: r.text for r in at["secret_scan"].collect()}
    assert clean == {i: secrets.mask(t, secrets.find_spans([t.encode()])[0]) for i, t in left.items()}
    total = sum(len(x) + 1 for x in ids_of("word_bpe_49k.json", list(clean.values())))
    assert at["packing"].agg(F.sum("length")).first()[0] == total


# --- whole jobs ------------------------------------------------------------------------------------------------
def test_documents_are_searched(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    asked = {r.doc_id for r in docs.where("doc_id % 20 = 0").select("doc_id").collect()}
    got = queries.QUERIES["op7_bm25_documents"](spark, DATA).collect()
    assert {r.query_id for r in got} == asked and {r.doc_id for r in got if r.rank == 1} & asked


def test_queries_that_share_an_id_are_one_query(spark):
    index = bm25.build_index(spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")).cache()
    got = bm25.search(index, spark.createDataFrame([(5, "a"), (5, "c")], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2}


def test_document_search_matches_sql(spark):
    test_query_matches_sql(spark, "op7_bm25_documents")


@pytest.mark.parametrize("name,lead,end", [("byte_bpe_50k.json", True, 50256), ("word_bpe_49k.json", False, 49407)])
def test_added_tokens_are_one_id(name, lead, end):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_path(name))
    parts = ["Hello", " ", "  ", "\n", "world's", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "endoftext|>", "Größe,", "word."]
    texts = ["".join(RNG.choice(parts, RNG.randint(0, 14))) for _ in range(800)] + ["", "a <|endoftext|> b"]
    got = encoded(encoder(public_path(name), lead, added=True), texts)
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)] and end in got[-1]


def test_packed_and_stored_ids_hold_added_tokens(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert 49407 in np.frombuffer(packing.pack(df).first().ids, "<u4")
    assert 50256 in np.frombuffer(sstable.read_shards(sstable.write_shards(df, f"file://{tempfile.mkdtemp()}/t", shards=1).cache()).first().ids, "<u4")


def test_training_sees_whole_texts_at_every_pass(spark, monkeypatch):
    seen, unigram = [], np.full(hmm.CLASSES, 1 / hmm.CLASSES)
    texts = [RNG.randint(0, hmm.CLASSES, n).astype(np.uint16) for n in (300, 129, 1)]
    coded = spark.createDataFrame([(i, False, bytearray(t.tobytes())) for i, t in enumerate(texts)], "rid long, held_out boolean, classes binary")
    m = hmm.Model.first(unigram)
    out = np.zeros(hmm.STATES + hmm.STATES**2 + hmm.STATES * hmm.CLASSES)
    hmm.expected_counts(m, texts, out)
    want, got = hmm.Model.of_counts(out, unigram), hmm.baum_welch(coded, m, unigram)
    assert np.allclose(got.move, want.move, rtol=1e-4) and np.allclose(got.start, want.start, rtol=1e-4)
    monkeypatch.setattr(hmm, "baum_welch", lambda rows, m, u: seen.append(rows.count()) or m)
    v = type("V", (), {"head_c": np.zeros(0), "class_c": np.ones(hmm.HASH_CLASSES), "end": 3})()
    hmm.train(coded, v)
    assert seen == [3] * hmm.PASSES


def test_pipeline_judges_every_row_and_keeps_ids(spark):
    import corpus_pipeline

    a, b = prose(60, 11), prose(60, 12)
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (None, a), (None, prose(60, 13)), (None, prose(60, 13))], "doc_id long, text string")
    got = corpus_pipeline.near_dedup_stage(spark, df, DATA)
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect())) == sorted([(1, a), (1, b), (0, prose(60, 13))])
    assert "ids" in corpus_pipeline.packing_stage(spark, got, DATA).columns


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, docs, empty):
    import corpus_pipeline

    odd = docs.withColumn("source", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, DATA), stage(spark, empty, DATA)
        assert none.count() == 0, name
        if name != "packing":
            assert out.columns == odd.columns and none.columns == empty.columns, name
            assert out.count() <= odd.count(), name


def test_pivots_skip_blocks(monkeypatch):
    """Blocks whose maxima cannot reach the k-th score are not decoded, and the best documents are those of all."""
    monkeypatch.setattr(bm25, "BLOCK", 4)
    r = np.random.RandomState(11)
    n, rows, truth = 800, [], np.zeros(800)
    size = r.randint(20, 60, n)
    rows.append((None, n, np.arange(n, dtype="<i8").tobytes(), size.astype("<i8").tobytes(), None, None))
    terms = [(b"rare", 5.0), (b"common", 0.3), (b"absent", 9.0)]
    for (term, weight), places in zip(terms, (np.sort(r.choice(n, 40, replace=False)), np.arange(n))):
        c = r.randint(1, 5, len(places)).astype("<u4")
        at = np.arange(0, len(places), 4)
        rows.append((term, len(places), places.astype("<u2").tobytes(), c.tobytes(), np.maximum.reduceat(c, at).tobytes(), np.minimum.reduceat(size[places], at).astype("<u4").tobytes()))
        truth[places] += weight * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size[places] / size.mean()))
    segment = bm25.Segment(rows, size.mean())
    got = sorted(segment.best(terms, 5), key=lambda x: -x[1])[:5]
    assert [i for i, _ in got] == np.argsort(-truth, kind="stable")[:5].tolist()
    assert np.allclose([s for _, s in got], np.sort(truth)[::-1][:5])
    assert segment.decoded < segment.asked / 2
