"""One deterministic automaton for many byte patterns: parsing, subset construction, minimisation."""

from __future__ import annotations

import numpy as np

#: A parsed pattern is nested tuples: ("set", frozenset of bytes), ("cat", parts), ("alt", parts), ("star", part), ("opt", part).
_CLASSES = {"d": range(48, 58), "w": [*range(48, 58), *range(65, 91), *range(97, 123), 95]}


class _Parser:
    """Literals, escapes (\\xHH, \\d, \\w), classes, groups, alternation, ? * + {m} {m,} {m,n}; ASCII only."""

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        x = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "?":
                x = ("opt", x)
            elif c == "*":
                x = ("star", x)
            elif c == "+":
                x = ("cat", [x, ("star", x)])
            else:
                spec = self.p[self.i : self.p.index("}", self.i)]
                self.i += len(spec) + 1
                low, _, high = spec.partition(",")
                more = [("star", x)] if spec.endswith(",") else [("opt", x)] * (int(high or low) - int(low))
                x = ("cat", [x] * int(low) + more)
        return x

    def byte(self) -> set[int]:
        c = self.take()
        if c != "\\":
            return {ord(c)}
        c = self.take()
        if c == "x":
            self.i += 2
            return {int(self.p[self.i - 2 : self.i], 16)}
        return set(_CLASSES.get(c, [ord(c)]))

    def atom(self):
        if self.peek() == "(":
            self.take()
            if self.p[self.i : self.i + 2] == "?:":
                self.i += 2
            x = self.alternatives()
            self.take()
            return x
        if self.peek() == "[":
            self.take()
            found: set[int] = set()
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    low = set(range(min(low), max(self.byte()) + 1))
                found |= low
            self.take()
            return ("set", self.cased(found))
        return ("set", self.cased(self.byte()))

    def cased(self, s: set[int]) -> frozenset[int]:
        return frozenset(s | {b ^ 32 for b in s if chr(b).isalpha()}) if self.any_case else frozenset(s)


class Automaton:
    """Finds, in one pass over the bytes, where any of the patterns can end (patterns may start anywhere).

    moves[state * n_classes + class] is the next state times n_classes; accepts[state] has a bit for each
    pattern that ends there; `resets` are the bytes that lead every state back to the start, so that no
    match can hold one.
    """

    def __init__(self, patterns: list[tuple[str, bool]]):
        edges: list[list[tuple[frozenset[int], int]]] = []
        free: list[list[int]] = []

        def state() -> int:
            edges.append([])
            free.append([])
            return len(edges) - 1

        def build(x, at: int) -> int:
            kind, v = x
            if kind == "set":
                end = state()
                edges[at].append((v, end))
                return end
            if kind == "cat":
                for y in v:
                    at = build(y, at)
                return at
            if kind == "alt":
                end = state()
                for y in v:
                    free[build(y, at)].append(end)
                return end
            loop, end = state(), state()
            free[at].append(loop)
            free[loop].append(end)
            free[build(v, loop)].append(loop if kind == "star" else end)
            return end

        root = state()
        ends = {}
        for bit, (pattern, any_case) in enumerate(patterns):
            first = state()
            free[root].append(first)
            ends[build(_Parser(pattern, any_case).alternatives(), first)] = bit
        # Bytes that no pattern tells apart share a class.
        sets = {s for es in edges for s, _ in es}
        marks = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        self.classes = np.array([kinds[m] for m in marks], np.uint8)
        self.n_classes = len(kinds)
        sample = [marks.index(m) for m in kinds]

        def closure(states: set[int]) -> frozenset[int]:
            todo = list(states)
            states = set(states)
            while todo:
                for n in free[todo.pop()]:
                    if n not in states:
                        states.add(n)
                        todo.append(n)
            return frozenset(s for s in states if edges[s] or s in ends)

        start = closure({root})
        names, table, todo = {start: 0}, [], [start]
        steps = [[{i: n for i, x in enumerate(sample) if x in s} for s, n in es] for es in edges]
        while todo:
            now = todo.pop(0)
            to: list[set[int]] = [set() for _ in sample]
            for s in now:
                for step in steps[s]:
                    for c, n in step.items():
                        to[c].add(n)
            row = []
            for t in to:
                nxt = closure(t) | start
                if nxt not in names:
                    names[nxt] = len(names)
                    todo.append(nxt)
                row.append(names[nxt])
            table.append(row)
        accept = np.array([sum(1 << ends[s] for s in set(n) & set(ends)) for n in names], np.int64)
        self._minimise(np.array(table), accept)
        self.resets = np.array([(self.table[:, self.classes[b]] == 0).all() for b in range(256)])

    def _minimise(self, table: np.ndarray, accept: np.ndarray) -> None:
        """Refines the partition by acceptance until successors agree; the start stays state 0."""
        block = np.unique(accept, return_inverse=True)[1]
        while True:
            after = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if after.max() == block.max():
                break
            block = after
        order = list(dict.fromkeys(block.tolist()))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        block = rank[block]
        first = np.unique(block, return_index=True)[1]
        self.table, self.accepts = block[table[first]], accept[first]
        self.moves = (self.table * self.n_classes).ravel().astype(np.int64)

    def scan(self, data: bytes, lane: int = 768, long: int = 1 << 16) -> list[tuple[int, int, int]]:
        """(start, end, patterns found) of each stretch between resets in which some pattern ends.

        The bytes are cut at resets into lanes of about `lane` bytes, which advance together a byte at
        a time; a lane without a reset for over `long` bytes is walked alone.
        """
        buf = np.frombuffer(data, np.uint8)
        if not len(buf):
            return []
        resets = np.flatnonzero(self.resets[buf])
        cuts = np.searchsorted(resets, np.arange(lane, len(buf), lane))
        at = np.unique(np.concatenate([[0], resets[cuts[cuts < len(resets)]] + 1, [len(buf)]]))
        starts, size = at[:-1], np.diff(at)
        cls = self.classes[buf].astype(np.int64)
        found = np.zeros(len(starts), np.int64)
        order = np.argsort(-size, kind="stable")
        alone = order[: int(np.searchsorted(-size[order], -long))]
        moves, accepts, n = self.moves.tolist(), self.accepts.tolist(), self.n_classes
        for i in alone:
            s = hit = 0
            for c in cls[starts[i] : starts[i] + size[i]].tolist():
                s = moves[s + c]
                hit |= accepts[s // n]
            found[i] = hit
        order = order[len(alone) :]
        if len(order):
            by_move = np.zeros(len(self.moves), np.int64)
            by_move[:: self.n_classes] = self.accepts
            pos, sizes = starts[order].copy(), size[order]
            state, hit = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            counts = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
            for k in counts.tolist():
                s = state[:k]
                s += cls[pos[:k]]
                np.take(self.moves, s, out=s)
                hit[:k] |= by_move[s]
                pos[:k] += 1
            found[order] = hit
        return [(int(starts[i]), int(starts[i] + size[i]), int(found[i])) for i in np.flatnonzero(found)]
