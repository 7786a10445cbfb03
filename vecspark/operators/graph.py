"""Navigable small-world graphs, one a shard, built and searched in Arrow tasks and merged by top-k.

A graph's links never cross shards, so building needs one shuffle by shard and searching none: every query
meets every shard, and a window keeps the best k of all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric, block_distances, parse_metric
from .codecs import Quantizer
from .exact import QUERY_BLOCK, _blocks, _side, matrix, top_k

LEVEL_SEED = 12345


#: Rows of a shard at most, so that its graph is built and searched in one task's memory; nodes handled at a time.
SHARD_ROWS, PART = 8_192, 512
#: Nodes that a search begins at, and opens at a time, and candidates of a node's links for each link it may have.
STARTS, OPENED, OFFERED = 8, 4, 3


def _gaps(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of rows q (n, d) or (n, w, d) against (n, v, d): (n, v) or (n, w, v); NaN is the worst."""
    if metric.name in ("l2", "ip"):
        one = q.ndim == 2
        q = q[:, None] if one else q
        d = q @ x.transpose(0, 2, 1)
        d = -d if metric.name == "ip" else np.maximum((q * q).sum(2)[:, :, None] + (x * x).sum(2)[:, None] - 2 * d, 0)
        d = d[:, 0] if one else d
    else:
        d = np.stack([block_distances(metric, np.atleast_2d(a), b) for a, b in zip(q, x)]).reshape(*q.shape[:-1], x.shape[1])
        d = -d if metric.larger_is_better else d
    return np.where(np.isnan(d), np.inf, d)


class Graph:
    """One shard's layered graph over rows of x; smaller scores are nearer.

    A node's candidates on a level are the ef nearest of the nodes before it, found exactly, many nodes at a time. It
    links to a spread of them, and then to a spread of those and of the nodes that chose it.
    """

    def __init__(self, x: np.ndarray, m: int, ef_construction: int, metric: Metric, seed: int = LEVEL_SEED):
        self.x, self.m, self.metric = x, m, metric
        rng = np.random.RandomState(seed)
        self.levels = np.minimum((-np.log(rng.uniform(1e-12, 1, len(x))) / np.log(max(m, 2))).astype(int), 12)
        self.top = int(self.levels.max()) if len(x) else -1
        self.entry = int(self.levels.argmax()) if len(x) else -1
        self.near = [self._level(level, ef_construction) for level in range(self.top + 1)]

    def _level(self, level: int, ef: int) -> np.ndarray:
        """(nodes, width) links of a level; -1 is none."""
        on, width = np.flatnonzero(self.levels >= level), self.width(level)
        x, n = self.x[on], len(on)
        ahead = np.full((n, width), -1, np.int64)
        score = np.full((n, width), np.inf)
        for a in range(0, n, PART):
            b = min(a + PART, n)
            d = block_distances(self.metric, x[a:b], x[:b])
            d = np.where(np.isnan(d), np.inf, -d if self.metric.larger_is_better else d)
            d[np.arange(b) >= np.arange(a, b)[:, None]] = np.inf
            at = np.argpartition(d, min(ef, b) - 1, axis=1)[:, :ef]
            at, s, ok = self._sorted(at, np.take_along_axis(d, at, 1), at < np.arange(a, b)[:, None])
            ahead[a:b], score[a:b] = self._spread(x, at, s, ok, width)
        # Both ends of every link, nearest first, in one table.
        i, slot = np.nonzero(ahead >= 0)
        j, s = ahead[i, slot], score[i, slot]
        node, other, s = np.append(i, j), np.append(j, i), np.append(s, s)
        order = np.lexsort((other, s, node))
        node, other, s = node[order], other[order], s[order]
        place = np.arange(len(node)) - np.searchsorted(node, node)
        held = place < OFFERED * width
        wide = int(place[held].max()) + 1 if held.any() else 1
        at, scores = np.full((n, wide), -1, np.int64), np.full((n, wide), np.inf)
        at[node[held], place[held]], scores[node[held], place[held]] = other[held], s[held]
        out = np.full((len(self.x), width), -1, np.int64)
        for a in range(0, n, PART):
            p = at[a : a + PART]
            got = self._spread(x, p, scores[a : a + PART], p >= 0, width)[0]
            out[on[a : a + PART]] = np.where(got >= 0, on[got], -1)
        return self._joined(out, ahead[:, 0]) if level == 0 else out

    def _joined(self, out: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        """Lowest links by which every node is reached: a node that is not gets a link from its nearest one before it."""
        reached, edge = np.zeros(len(out), bool), np.array([self.entry])
        while len(edge):
            reached[edge] = True
            edge = np.unique(out[edge])
            edge = edge[edge >= 0]
            edge = edge[~reached[edge]]
        lost = np.flatnonzero(~reached)
        source = np.where(nearest[lost] >= 0, nearest[lost], self.entry)
        order = np.argsort(source, kind="stable")
        lost, source = lost[order], source[order]
        place = np.arange(len(lost)) - np.searchsorted(source, source)
        more = np.full((len(out), int(place.max()) + 1 if len(lost) else 0), -1, np.int64)
        more[source, place] = lost
        return np.concatenate([out, more], 1)

    @staticmethod
    def _sorted(at: np.ndarray, s: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((at, s, ~ok), axis=1)
        return tuple(np.take_along_axis(v, order, 1) for v in (at, s, ok))

    def _spread(self, x: np.ndarray, at: np.ndarray, s: np.ndarray, ok: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates, nearest first, takes one only if it is nearer to the point than to any taken one;
        fills up with the rest. Gives the taken ones and their scores, padded with -1 and infinity."""
        n, wide = at.shape
        v = x[np.maximum(at, 0)]
        between = _gaps(self.metric, v, v)
        taken, count = np.zeros((n, wide), bool), np.zeros(n, np.int64)
        for p in range(wide):
            close = (taken[:, :p] & (between[:, p, :p] <= s[:, p, None])).any(1)
            taken[:, p] = ok[:, p] & ~close & (count < most)
            count += taken[:, p]
        order = np.argsort(np.where(taken, 0, np.where(ok, 1, 2)), axis=1, kind="stable")[:, :most]
        held = np.take_along_axis(ok, order, 1)
        chosen, scores = np.full((n, most), -1, np.int64), np.full((n, most), np.inf)
        chosen[:, : order.shape[1]] = np.where(held, np.take_along_axis(at, order, 1), -1)
        scores[:, : order.shape[1]] = np.where(held, np.take_along_axis(s, order, 1), np.inf)
        return chosen, scores

    @property
    def links(self) -> list[list[list[int]]]:
        """Each node's neighbours a level."""
        flat = [[r[r >= 0].tolist() for r in level] for level in self.near]
        return [[flat[l][i] for l in range(h + 1)] for i, h in enumerate(self.levels.tolist())]

    @classmethod
    def stored(cls, x: np.ndarray, m: int, metric: Metric, entry: int, near: list[np.ndarray], levels: np.ndarray) -> Graph:
        g = cls.__new__(cls)
        g.x, g.m, g.metric, g.entry, g.near, g.levels, g.top = x, m, metric, entry, near, levels, int(levels[entry])
        return g

    def around(self, j: int, level: int) -> list[int]:
        r = self.near[level][j]
        return r[r >= 0].tolist()

    def search_all(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, nodes) of every row of q, best first, infinity where there is none; all rows go in lockstep."""
        n, ef = len(q), max(ef, k)
        node, score = np.full((n, ef), -1, np.int64), np.full((n, ef), np.inf)
        opened, seen = np.zeros((n, ef), bool), np.zeros((n, len(self.x)), bool)
        # A shard's rows are bounded, and so are those above the lowest level: all are scored, and the best begin the beam.
        upper = np.flatnonzero(self.levels > 0) if self.top else np.array([self.entry])
        d = block_distances(self.metric, q, self.x[upper])
        d = np.where(np.isnan(d), np.inf, -d if self.metric.larger_is_better else d)
        begin = np.argsort(d, axis=1, kind="stable")[:, : min(STARTS, ef)]
        node[:, : begin.shape[1]], score[:, : begin.shape[1]] = upper[begin], np.take_along_axis(d, begin, 1)
        np.put_along_axis(seen, upper[begin], True, 1)
        live = np.arange(n)
        while len(live):
            # The nearest that are not opened yet, of a beam in order.
            new = ~opened[live] & (node[live] >= 0)
            new &= new.cumsum(1) <= OPENED
            live = live[new.any(1)]
            if not len(live):
                break
            row, slot = np.nonzero(new[new.any(1)])
            opened[live[row], slot] = True
            near = self.near[0][node[live[row], slot]]
            r, c = np.repeat(row, near.shape[1]), near.ravel()
            r, c = r[c >= 0], c[c >= 0]
            pair = np.unique(r * len(self.x) + c)
            r, c = pair // len(self.x), pair % len(self.x)
            fresh = ~seen[live[r], c]
            r, c = r[fresh], c[fresh]
            seen[live[r], c] = True
            d = _gaps(self.metric, q[live[r]], self.x[c][:, None])[:, 0]
            first = np.searchsorted(r, np.arange(len(live)))
            place = np.arange(len(r)) - first[r]
            wide = int(place.max()) + 1 if len(r) else 0
            more, more_score = np.full((len(live), wide), -1, np.int64), np.full((len(live), wide), np.inf)
            more[r, place], more_score[r, place] = c, d
            nodes, scores = np.concatenate([node[live], more], 1), np.concatenate([score[live], more_score], 1)
            done = np.concatenate([opened[live], np.zeros((len(live), wide), bool)], 1)
            order = np.argsort(scores, axis=1, kind="stable")[:, :ef]
            node[live], score[live], opened[live] = (np.take_along_axis(v, order, 1) for v in (nodes, scores, done))
        return score[:, :k], node[:, :k]

    def score(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        d = block_distances(self.metric, q[None], self.x[at])[0]
        return -d if self.metric.larger_is_better else d

    def width(self, level: int) -> int:
        return 2 * self.m if level == 0 else self.m

    def _greedy(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self.score(q, [at])[0])
        while True:
            around = self.around(at, level)
            if not around:
                return at
            s = self.score(q, around)
            if s.min() >= best:
                return at
            at, best = around[int(s.argmin())], float(s.min())

    def _beam(self, q: np.ndarray, start: list[int], level: int, ef: int, score, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The ef best found. Nodes that are not allowed are walked through but take no place among them."""
        score = score or (lambda at: self.score(q, at))
        seen = set(start)
        first = list(zip(score(start).tolist(), start))
        todo, best = list(first), [(-s, j) for s, j in first if allowed is None or allowed[j]]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, j = heapq.heappop(todo)
            if len(best) >= ef and s > -best[0][0]:
                break
            around = [n for n in self.around(j, level) if n not in seen]
            if not around:
                continue
            seen.update(around)
            for d, n in zip(score(around).tolist(), around):
                if len(best) < ef or d < -best[0][0]:
                    heapq.heappush(todo, (d, n))
                    if allowed is not None and not allowed[n]:
                        continue
                    heapq.heappush(best, (-d, n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-s, j) for s, j in best)

    def search(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        at = self.entry
        for l in range(self.top, 0, -1):
            at = self._greedy(q, at, l)
        return self._beam(q, [at], 0, max(ef, k), None, allowed)[:k]

    def within(self, q: np.ndarray, limit: float, ef: int) -> list[tuple[float, int]]:
        """Nodes with a score below the limit: those the beam finds, and all that hang on them through such nodes."""
        at = self.entry
        for l in range(self.top, 0, -1):
            at = self._greedy(q, at, l)
        found = {j: s for s, j in self._beam(q, [at], 0, ef, None) if s < limit}
        todo = list(found)
        while todo:
            around = [n for n in self.around(todo.pop(), 0) if n not in found]
            for s, n in zip(self.score(q, around).tolist(), around) if around else ():
                if s < limit and n not in found:
                    found[n] = s
                    todo.append(n)
        return [(s, j) for j, s in found.items()]


def _dense(hits: list[list[tuple[float, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of (score, node) as two padded tables."""
    wide = max(map(len, hits), default=0)
    score, node = np.full((len(hits), wide), np.inf), np.full((len(hits), wide), -1, np.int64)
    for i, h in enumerate(hits):
        if h:
            score[i, : len(h)], node[i, : len(h)] = zip(*h)
    return score, node


class GraphIndex:
    """Built over (id, vec); with a quantizer the graph is built on raw vectors and searched over decoded codes."""

    def __init__(self, m: int = 32, ef_construction: int = 40, ef_search: int = 16, metric: str | Metric = "l2", shards: int = 1, quantizer: Quantizer | None = None):
        """shards: the least number of them; there are more where one would get over `SHARD_ROWS` rows."""
        self.m, self.ef_construction, self.ef_search, self.shards, self.quantizer = m, ef_construction, ef_search, shards, quantizer
        self.metric = parse_metric(metric)
        self.nodes: DataFrame | None = None
        self.frozen = False

    def add(self, rows: DataFrame) -> GraphIndex:
        """(shard, id, place, vec, levels, links): each row with its neighbour places a level."""
        if self.frozen:
            raise ValueError("a frozen index takes no rows")
        m, ef, metric, quantizer = self.m, self.ef_construction, self.metric, self.quantizer

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
            x = np.array(pdf["vec"].tolist(), np.float64)
            g = Graph(x, m, ef, metric)
            stored = quantizer.decode(quantizer.encode(x)) if quantizer is not None else x
            return pd.DataFrame({"shard": pdf["shard"], "id": pdf["id"], "place": np.arange(len(pdf)), "vec": list(stored), "entry": g.entry, "links": g.links})

        rows = rows.select("id", "vec").where("vec is not null")
        shards = max(self.shards, -(-rows.count() // SHARD_ROWS))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        self.nodes = dealt.groupBy("shard").applyInPandas(build, "shard int, id long, place int, vec array<double>, entry int, links array<array<int>>")
        return self

    def freeze(self) -> GraphIndex:
        """Drops the right to add rows, as a code-only index must."""
        self.frozen = True
        return self

    def _nodes(self) -> DataFrame:
        if self.nodes is None:
            raise ValueError("the index is empty")
        return self.nodes

    def search(self, queries: DataFrame, k: int, ef_search: int | None = None, condition=None) -> DataFrame:
        """k nearest; `condition` (a Column over id) limits the hits."""
        ef = ef_search or self.ef_search
        if condition is None:
            hits = self._answers(queries, None, lambda g, v, _: g.search_all(v, k, ef))
        else:
            hits = self._answers(queries, condition, lambda g, v, allowed: _dense([g.search(x, k, ef, allowed) for x in v]))
        return top_k(hits, k, self.metric.larger_is_better)

    def range_search(self, queries: DataFrame, radius: float, ef_search: int | None = None) -> DataFrame:
        """(query_id, id, distance) of what lies strictly within the radius and hangs together in the graph."""
        ef, limit = ef_search or self.ef_search, -radius if self.metric.larger_is_better else radius
        return self._answers(queries, None, lambda g, v, _: _dense([g.within(x, limit, ef) for x in v]))

    def _answers(self, queries: DataFrame, condition, find) -> DataFrame:
        metric, m = self.metric, self.m
        # Dealt again by shard, else every block of queries would build the graphs anew.
        nodes = self._nodes().withColumn("ok", condition if condition is not None else F.lit(True)).repartition(_side(queries), "shard")
        shards = nodes.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("place", "id", "vec", "links", "entry", "ok"))).alias("nodes"))

        def graph(nodes: pa.StructArray) -> tuple[Graph, np.ndarray, np.ndarray]:
            x, links = matrix(nodes.field("vec")), nodes.field("links")
            first, lists = np.append(0, np.cumsum(links.value_lengths().to_numpy())), links.flatten()
            size, to = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            begin, levels, near = np.cumsum(size) - size, np.diff(first) - 1, []
            for level in range(int(levels.max()) + 1):
                at = np.flatnonzero(levels >= level)
                n, table = size[first[at] + level], np.full((len(x), max(int(size[first[at] + level].max()), 1)), -1, np.int64)
                slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                table[np.repeat(at, n), slot] = to[np.repeat(begin[first[at] + level], n) + slot]
                near.append(table)
            g = Graph.stored(x, m, metric, nodes.field("entry")[0].as_py(), near, levels)
            return g, nodes.field("id").to_numpy(), nodes.field("ok").to_numpy(zero_copy_only=False)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, (qi, qv) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    qi = np.frombuffer(qi, np.int64)
                    g, ids, allowed = graph(b.column(2).slice(i, 1).flatten())
                    s, j = find(g, np.frombuffer(qv).reshape(len(qi), -1), allowed)
                    r, c = np.nonzero(np.isfinite(s) & (j >= 0))
                    s = s[r, c]
                    yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(ids[j[r, c]]), pa.array(-s if metric.larger_is_better else s)], names=["query_id", "id", "distance"])

        pairs = _blocks(queries.repartition(_side(queries)), "q", QUERY_BLOCK).crossJoin(shards.select("nodes"))
        return pairs.mapInArrow(run, "query_id long, id long, distance double")

    def stored(self) -> DataFrame:
        return self._nodes().select("id", "vec")

    def edges(self, level: int = 0) -> DataFrame:
        """(shard, a, b) links of a level, by id."""
        n = self._nodes().where(F.size("links") > level)
        e = n.select("shard", F.col("id").alias("a"), F.explode(F.col("links")[level]).alias("place"))
        return e.join(self._nodes().select("shard", "place", F.col("id").alias("b")), ["shard", "place"]).select("shard", "a", "b")


def edge_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes with links, links, links whose reverse exists, and neighbours that two linked nodes share."""
    e = edges.select("a", "b").distinct()
    back = e.join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    share = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").join(e.select("a", F.col("b").alias("c")), ["a", "c"], "left_semi")
    n = e.agg(F.countDistinct("a").alias("nodes"), F.count(F.lit(1)).alias("links"))
    return n.crossJoin(back.agg(F.count(F.lit(1)).alias("reciprocal"))).crossJoin(share.agg(F.count(F.lit(1)).alias("shared")))
