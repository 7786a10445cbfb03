"""Distinct sampled segmentations of whole texts: Gumbel top-k without replacement over the piece lattice.

A text's lattice falls into units wherever no piece holds the two characters side by side, so at its spaces and at most
marks. A worker compiles each distinct unit (told apart by the 64-bit hash of its characters) once into a bounded store,
with the exact log-mass of every suffix, so each edge has its conditional probability. Sampling is a perturbed best-first
(A*) search over regions of the lattice. A region's bound is its perturbed log-probability, the exact maximum over its
segmentations, drawn from the top down: the best segmentation of a region takes each child by its probability, and the
children that it passed by at one step are a region of their own, whose bound is a Gumbel variate of their log-mass below
the parent's. The next segmentation is the best of the best region. All texts of a batch take their steps together.

Piece weights follow a Zipf law over the vocabulary's merge order, as its own scores are ranks; a character
without a piece is spelt in bytes. Randomness comes from the row key alone, so a row gives the same samples in any
partition. The inclusion score of a sample is its probability to be above the (k+1)-th perturbed value.

Defined cases: a null or empty text has one empty segmentation; a text with fewer segmentations than k gives them
all, with score 1 when none is left; rows that share a key and a text give the same samples; extra columns are
ignored. The vocabulary's own normalisation applies: U+2581 decodes to a space.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, sliced, span_hashes, texts
from .tokens import Known, public_path

SPACE = "▁"
SAMPLES, ALPHA = 2, 1.0
#: Characters compiled at a time (a longer unit is compiled alone), and nodes held at most between two batches.
PART, NODES = 24_000, 3_000_000
#: Steps of a path and log-probability at first asked for regions, and what no Gumbel variate of 53 bits reaches.
FRONT, NEAR, NOISE = 384, 6.0, 37.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Lattices:
    """A vocabulary that compiles the units of a batch together."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = np.zeros(256, np.uint32)
        n = self.model.get_piece_size()
        self.weight = np.zeros(n)
        for i in range(n):
            if self.model.is_byte(i):
                self.bytes[int(self.model.id_to_piece(i)[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.weight[i] = -alpha * math.log(i + 1)
                self.pieces[self.model.id_to_piece(i)] = (i, float(self.weight[i]))
        self.byte_weight = -alpha * math.log(n)
        self._index()
        self.clear()

    def _index(self) -> None:
        """The pieces as a double array: a prefix is a slot, its child by a character the slot at base + class, whose
        `parent` it is. Also the pairs of characters that lie side by side in a piece."""
        below: dict[str, set[str]] = {}
        for p in self.pieces:
            for i in range(1, len(p)):
                below.setdefault(p[:i], set()).add(p[i])
        inner = sorted({c for p in self.pieces if len(p) > 1 for c in p})
        kinds = len(inner) + 1  # class 0: in no piece of several characters
        self.kind, self.first = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in inner]] = np.arange(1, kinds)
        side = np.zeros((kinds, kinds), bool)
        for p in self.pieces:
            k = self.kind[[ord(c) for c in p]]
            side[k[:-1], k[1:]] = True
        self.kinds, self.side = kinds, side.ravel()
        heads = {p[0] for p in self.pieces}
        size = 1 << (2 * sum(map(len, below.values())) + len(heads) + kinds).bit_length()
        parent = [-1] * (size + kinds)
        rng, slot, base = random.Random(1), {}, {}
        for i, c in enumerate(sorted(heads), kinds):  # slots below are no child's: base 0 leads nowhere
            parent[i], slot[c], self.first[ord(c)] = 0, i, i
        for prefix in sorted(below, key=lambda p: (len(p), p)):
            ks = [(int(self.kind[ord(c)]), c) for c in below[prefix]]
            b = rng.randrange(kinds, size)
            while any(parent[b + k] >= 0 for k, _ in ks):
                b = rng.randrange(kinds, size)
            base[slot[prefix]] = b
            for k, c in ks:
                parent[b + k], slot[prefix + c] = slot[prefix], b + k
        self.parent, self.base, self.value = np.array(parent, np.int32), np.zeros(len(parent), np.int32), np.full(len(parent), -1, np.int32)
        self.base[list(base)] = list(base.values())
        self.value[[slot[p] for p in self.pieces]] = [i for i, _ in self.pieces.values()]

    def clear(self) -> None:
        """Forgets all units. Node 0 is every unit's end; a node's edges lie between its start and the next node's."""
        self.known = (Known(), Known())
        self.start = np.zeros(1 << 16, np.int32)
        self.to, self.piece, self.logp, self.upto = np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int32), np.zeros(1 << 17), np.zeros(1 << 17)
        self.nodes, self.edges = 1, 0

    def add(self, chars: np.ndarray, size: np.ndarray) -> np.ndarray:
        """First node of each new unit; the units' characters lie end to end."""
        out, ends, at = [], np.cumsum(size), 0
        while at < len(size):
            # In parts whose tables fit in the processor's cache.
            begin = int(ends[at] - size[at])
            stop = max(at + 1, int(np.searchsorted(ends, begin + PART, "right")))
            first, counts, to, piece, logp, upto = self._compile(chars[begin : int(ends[stop - 1])], size[at:stop])
            n, m = len(counts), len(to)
            for name, used, more in (("start", self.nodes, n + 1), *((x, self.edges, m) for x in ("to", "piece", "logp", "upto"))):
                old = getattr(self, name)
                if used + more > len(old):
                    new = np.zeros(max(used + more, len(old) * 3 // 2), old.dtype)
                    new[:used] = old[:used]
                    setattr(self, name, new)
            a, b = self.edges, self.edges + m
            self.to[a:b], self.piece[a:b], self.logp[a:b], self.upto[a:b] = np.where(to < n, to + self.nodes, 0), piece, logp, upto
            self.start[self.nodes : self.nodes + n + 1] = a + np.concatenate([[0], np.cumsum(counts)])
            out.append(first + self.nodes)
            self.nodes, self.edges, at = self.nodes + n, b, stop
        return np.concatenate(out)

    def units(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First node of each unit of the texts, end to end, and the number of each text's units."""
        if self.nodes > NODES:
            self.clear()
        parts = [SPACE + t.decode() if t else "" for t in batch]
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).copy()
        chars[chars == 32] = ord(SPACE)
        ends = np.cumsum([len(t) for t in parts], dtype=np.int64)
        begins = ends - [len(t) for t in parts]
        kind = self.kind[chars]
        here = np.ones(len(chars), bool)
        here[1:] = ~self.side[kind[:-1] * self.kinds + kind[1:]]
        here[begins[ends > begins]] = True
        start = np.flatnonzero(here)
        size = np.diff(np.append(start, len(chars)))
        names, first, which = np.unique(span_hashes(chars, start, size), return_index=True, return_inverse=True)
        node = np.zeros(len(names), np.int64)
        for known in self.known:
            i = known.find(names)
            node[i >= 0] = known.at[i[i >= 0]]
        fresh = np.flatnonzero(node == 0)
        if len(fresh):
            a, n = start[first[fresh]], size[first[fresh]]
            done = np.cumsum(n)
            node[fresh] = self.add(chars[np.arange(int(done[-1])) + np.repeat(a - (done - n), n)], n)
            old, new = self.known
            new.add(names[fresh], node[fresh], node[fresh])
            if len(new.keys) > 1 << 16:
                old.add(new.keys, new.at, new.n)
                self.known = (old, Known())
        upto = np.searchsorted(start, ends)
        return node[which], np.diff(upto, prepend=0)

    def _compile(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """The node of each unit's first character; children a node; and by child the node it leads to (their number: the
        end), the piece (or minus the code point), the conditional log-probability and the probability up to it.

        Nodes are the characters in order of their distance to the unit's end.
        """
        n = len(chars)
        left = np.repeat(np.cumsum(size), size) - np.arange(n)  # characters from here to the unit's end
        state, at, length = self.first[chars], np.arange(n), 1
        piece = self.value[state]
        bare = np.flatnonzero(piece < 0)
        code = chars[bare].astype(np.int64)
        score = self.weight[piece]
        # A character of one byte is that byte's piece; longer ones are spelt when the ids are written.
        piece[bare] = np.where(code < 128, self.bytes[np.minimum(code, 127)].astype(np.int64), -code)
        score[bare] = self.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        found, counts = [(at, piece, score)], np.ones(n, np.int64)
        while True:
            go = np.flatnonzero((self.base[state] > 0) & (left[at] > length))
            if not len(go):
                break
            at, old = at[go], state[go]
            state = self.base[old] + self.kind[chars[at + length]]
            go = np.flatnonzero(self.parent[state] == old)
            at, state, length = at[go], state[go], length + 1
            piece = self.value[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], piece[hit], self.weight[piece[hit]]))
            counts[at[hit]] += 1
        few = left.astype(np.uint16) if n and left.max() < 1 << 16 else left
        order = np.argsort(few, kind="stable")
        place = np.empty(n + 1, np.int64)
        place[order], place[n] = np.arange(n), n
        counts = counts[order]
        start = np.cumsum(counts) - counts
        fill, m = start[place[:n]], int(counts.sum())
        to, pieces, logp = np.empty(m, np.int64), np.empty(m, np.int32), np.empty(m)
        for length in range(len(found), 0, -1):  # the longest piece first
            at, piece, score = found[length - 1]
            i = fill[at]
            fill[at] += 1
            to[i], pieces[i], logp[i] = place[np.where(left[at] == length, n, at + length)], piece, score
        # Log-mass of every suffix, from the ends; characters as far from them go together.
        mass = np.zeros(n + 1)
        edges = np.append(start, m)
        groups = np.flatnonzero(np.diff(left[order], prepend=0)).tolist() + [n]
        for a, b in zip(groups, groups[1:]):
            x, y = int(edges[a]), int(edges[b])
            s, begin = logp[x:y] + mass[to[x:y]], start[a:b] - x
            top = np.maximum.reduceat(s, begin)
            total = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, counts[a:b])), begin))
            mass[a:b] = total
            logp[x:y] = s - np.repeat(total, counts[a:b])
        upto = np.exp(logp)
        i, step = start[counts > 1] + 1, counts[counts > 1]
        for r in range(2, int(counts.max()) + 1 if n else 0):
            upto[i] += upto[i - 1]
            i, step = i[step > r] + 1, step[step > r]
        upto[start + counts - 1] = 2.0  # the last child takes what is left
        return place[np.cumsum(size) - size], counts, to, pieces, logp, upto

    def ids(self, pieces: np.ndarray) -> np.ndarray:
        if not len(pieces) or pieces.min() >= 0:
            return pieces.view("<u4")
        out: list[int] = []
        for p in pieces.tolist():
            out += [p] if p >= 0 else self.bytes[list(chr(-p).encode())].tolist()
        return np.array(out, "<u4")


_lattices: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattices(path, alpha)
    return _lattices[path, alpha]


class _Batch:
    """First nodes of the units of a batch of texts, end to end."""

    def __init__(self, lat: Lattices, batch: list[bytes]):
        self.first, self.doc_size = lat.units(batch)
        self.doc_start = np.cumsum(self.doc_size) - self.doc_size


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((mix64(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _descend(lat: Lattices, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Takes children by their probability from each lane's node to its end: the edges, lane by lane, and their numbers."""
    length, steps = np.zeros(len(node), np.int64), []
    live, t = np.arange(len(node)), 0
    while len(live):
        with np.errstate(over="ignore"):
            u = _uniform(key + np.uint64(t + 1) * _STEP)
        edge = lat.start[node]
        over = np.flatnonzero(u >= lat.upto[edge])
        while len(over):
            edge[over] += 1
            over = over[u[over] >= lat.upto[edge[over]]]
        steps.append((live, edge))
        length[live] += 1
        node = lat.to[edge]
        go = np.flatnonzero(node)
        live, node, key, t = live[go], node[go], key[go], t + 1
    offset = np.cumsum(length) - length
    path = np.empty(int(length.sum()), np.int32)
    for t, (lanes, edge) in enumerate(steps):
        path[offset[lanes] + t] = edge
    return path, length


def _regions(lat: Lattices, edge: np.ndarray, phi: np.ndarray, noise: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The best perturbed value, below top, of the other children at each step; -inf where there are none."""
    node = np.searchsorted(lat.start[: lat.nodes + 1], edge, "right") - 1
    first, count = lat.start[node].astype(np.int64), (lat.start[node + 1] - lat.start[node]).astype(np.int64)
    begin = np.cumsum(count) - count
    i = np.arange(int(count.sum())) + np.repeat(first - begin, count)
    mass = np.add.reduceat(np.where(i == np.repeat(edge, count), 0.0, np.exp(lat.logp[i])), begin) if len(i) else np.zeros(0)
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, -(phi + np.log(mass) + noise))


def _front(lat: Lattices, edge: np.ndarray, begin: np.ndarray, size: np.ndarray, phi0: np.ndarray, top: np.ndarray, seed: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best regions that each text's path passed by: text, step, bound, log-probability before the step.

    Log-probability falls along a path and a variate exceeds its log-mass by less than NOISE, so steps too improbable to
    reach the text's k-th bound are not asked.
    """
    n, width = len(size), np.minimum(size, FRONT)
    while True:
        off = np.cumsum(width) - width
        text, step = np.repeat(np.arange(n), width), np.arange(int(width.sum())) - np.repeat(off, width)
        own = edge[begin[text] + step]
        run = np.concatenate([[0.0], np.cumsum(lat.logp[own])])
        before = run[:-1] + (phi0 - run[off])[text]
        last = phi0 + run[off + width] - run[off]
        with np.errstate(over="ignore"):
            noise = -np.log(-np.log(_uniform(seed[text] + (step + 1).astype(np.uint64) * _STEP)))
        value, asked, kth = np.full(len(text), -np.inf), np.zeros(len(text), bool), np.full(n, -np.inf)
        for least in (phi0 - NEAR, None):
            at = np.flatnonzero(~asked & (before > least[text] if least is not None else before + noise > kth[text]))
            asked[at] = True
            value[at] = _regions(lat, own[at], before[at], noise[at], top[text[at]])
            some = np.flatnonzero(value > -np.inf)
            some = some[np.lexsort((some, -value[some], text[some]))]
            rank = np.arange(len(some)) - np.searchsorted(text[some], text[some])
            kth[text[some[rank == k - 1]]] = value[some[rank == k - 1]]
        short = (width < size) & (last + NOISE > kth)
        if not short.any():
            some = some[rank < k]
            return text[some], step[some], value[some], before[some]
        width[short] = np.minimum(size[short], 4 * width[short])


def sample(lat: Lattices, batch: list[bytes], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (ids, log-probability, perturbed value, inclusion score), best first."""
    b, n = _Batch(lat, batch), len(batch)
    seeds = mix64(keys.astype(np.uint64) + np.uint64(0xA5A5A5A5))
    found: list[list[list]] = [[] for _ in range(n)]
    #: The best regions a text: (bound, path, place on the path, edges no longer in it, log-probability before it).
    pool: list[list[tuple]] = [[] for _ in range(n)]
    docs, heads = np.repeat(np.arange(n), b.doc_size), {}
    top = -np.log(-np.log(_uniform(seeds)))
    lanes, node, phi0, live = np.arange(len(docs)), b.first, np.zeros(n), np.arange(n)

    def turn_keys(turn: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return seeds + np.uint64(turn) * np.uint64(0xD6E8FEB86659FD93)

    for turn in range(k):
        begun = np.flatnonzero(node > 0)
        seed, doc = turn_keys(turn), docs[begun]
        with np.errstate(over="ignore"):
            edge, length = _descend(lat, node[begun], mix64(seed[doc] + (lanes[begun] - b.doc_start[doc]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        size = np.bincount(doc, length, n).astype(np.int64)
        end = np.cumsum(size)
        begin, own, total = end - size, np.flatnonzero(size), phi0.copy()
        if len(own):
            total[own] += np.add.reduceat(lat.logp[edge], begin[own])
        for d, x, y, phi, value in zip(live.tolist(), begin[live].tolist(), end[live].tolist(), total[live].tolist(), top[live].tolist()):
            found[d].append([np.concatenate([heads[d], edge[x:y]]) if d in heads else edge[x:y], phi, value])
        for d, at, value, phi in zip(*(x.tolist() for x in _front(lat, edge, begin, size, phi0, top, mix64(seed + np.uint64(0x8BB84B93962EACC9)), k))):
            pool[d].append((value, turn, at + (len(heads[d]) if d in heads else 0), (int(edge[begin[d] + at]),), phi))
        for d in live.tolist():
            pool[d].sort(reverse=True)
            del pool[d][k:]
        if turn == k - 1:
            break
        # The next sample of a text is the best of its best region.
        node_parts, lane_parts, doc_parts, heads, phi0, top, nxt = [], [], [], {}, np.zeros(n), np.zeros(n), []
        with np.errstate(over="ignore"):
            draw = [_uniform(turn_keys(turn) + np.uint64(c)).tolist() for c in (0x9FB21C651E98DF25, 0xA0761D6478BD642F)]
        for d in live.tolist():
            if not pool[d]:
                continue
            bound, path_no, at, gone, phi = pool[d].pop(0)
            parent = found[d][path_no][0]
            here = int(np.searchsorted(lat.start[: lat.nodes + 1], np.int32(gone[0]), "right"))
            rest = np.array([e for e in range(int(lat.start[here - 1]), int(lat.start[here])) if e not in gone])
            p = np.exp(lat.logp[rest])
            i = min(int(np.searchsorted(np.cumsum(p), draw[0][d] * p.sum(), "right")), len(rest) - 1)
            e = int(rest[i])
            if len(rest) > 1:  # the others stay a region
                mass = float(np.delete(p, i).sum())
                if mass > 0:
                    g = phi + math.log(mass) - math.log(-math.log(draw[1][d]))
                    pool[d].append((float(-np.logaddexp(-bound, -g)), path_no, at, (*gone, e), phi))
                    pool[d].sort(reverse=True)
            lane = int((lat.to[parent[:at]] == 0).sum())  # units that ended before
            heads[d] = np.append(parent[:at], np.int32(e))
            phi0[d], top[d] = phi + lat.logp[e], bound
            first, stop = b.doc_start[d] + lane, b.doc_start[d] + b.doc_size[d]
            nodes = b.first[first:stop].copy()
            nodes[0] = lat.to[e]
            node_parts.append(nodes)
            lane_parts.append(np.arange(first, stop))
            doc_parts.append(np.full(stop - first, d))
            nxt.append(d)
        if not nxt:
            break
        node, lanes, docs, live = np.concatenate(node_parts), np.concatenate(lane_parts), np.concatenate(doc_parts), np.array(nxt)
    result = []
    for d in range(n):
        edge_value = max((p[0] for p in pool[d]), default=-np.inf)
        result.append([(lat.ids(lat.piece[path]), prob, value, float(-np.expm1(-np.exp(min(prob - edge_value, 700.0))))) for path, prob, value in found[d]])
    return result


def sampled_segmentations(docs: DataFrame, k: int = SAMPLES, vocabulary: str | None = None, id_col: str = "doc_id", text: str = "text", alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """doc_id, rank, n_pieces, log_prob, perturbed, inclusion, ids of up to k segmentations of every row."""
    path = vocabulary or public_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(path, alpha)
        for b in sliced(batches):
            got = sample(lat, texts(b.column(2)), b.column(1).to_numpy().view(np.uint64), k)
            rows = [(d, r + 1, len(ids), prob, value, inc, ids.tobytes()) for d, s in zip(b.column(0).to_pylist(), got) for r, (ids, prob, value, inc) in enumerate(s)]
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc_id", "rank", "n_pieces", "log_prob", "perturbed", "inclusion", "ids"])

    key = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, rank long, n_pieces long, log_prob double, perturbed double, inclusion double, ids binary")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "rank", "n_pieces", "log_prob", "perturbed", "inclusion", F.crc32("ids").cast("long").alias("ids_crc32"))


def decode(ids: np.ndarray | bytes, vocabulary: str | None = None) -> str:
    a = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
    return lattices(vocabulary or public_path("piece_bpe_32k.model"), ALPHA).model.decode(a.tolist())
