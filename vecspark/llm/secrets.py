"""Secret scan by one combined automaton over all rules.

All rules are compiled to a single minimal automaton, which reads each byte once and tells which rules can
end in which stretch of text. Only in those stretches are the exact spans of the rules found that the
automaton saw: leftmost, greedy, not overlapping within a rule, with the rule's least length.

Defined cases: a null text is empty; rows are scanned one by one (ties and copies each give a row); offsets
are code points, ends exclusive; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import sliced, texts


@dataclass(frozen=True)
class Rule:
    """kind; exact pattern (its group `least_group` needs `least` characters); what the automaton looks for.

    `seen` ends inside every match of the pattern; long counted tails of rare prefixes are left to the
    exact pattern, as their counters would multiply the automaton's states.
    """

    kind: str
    pattern: str
    seen: str
    least: int = 1
    least_group: int = 0
    any_case: bool = False


BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\-]{6}", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 24),
)
#: What the method adds: token formats with fixed prefixes.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9\-]"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", r"AIza[A-Za-z0-9_\-]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", r"\.eyJ[A-Za-z0-9_\-]"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE + ADDED
#: Bytes scanned at a time.
BLOCK = 4_000_000

Span = tuple[int, int, str]


@cache
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[re.Pattern[bytes]]]:
    auto = Automaton([(r.seen, r.any_case) for r in rules])
    assert auto.resets[10], "documents are joined with line feeds"
    return auto, [re.compile(r.pattern.encode()) for r in rules]


def find_spans(batch: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[Span]]:
    """Spans (start, end, kind) in code points of each text, in order of start and rule."""
    auto, exact = compiled(rules)
    out: list[list[Span]] = [[] for _ in batch]
    first = 0
    while first < len(batch):
        last, size = first, 0
        while last < len(batch) and (last == first or size + len(batch[last]) < BLOCK):
            size += len(batch[last]) + 1
            last += 1
        data = b"\n".join(batch[first:last])
        doc, at = first, 0
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, found in auto.scan(data):
            for i, r in enumerate(rules):
                if found >> i & 1:
                    for m in exact[i].finditer(data, start, end):
                        if len(m[r.least_group]) >= r.least:
                            while m.start() > at + len(batch[doc]):
                                at += len(batch[doc]) + 1
                                doc += 1
                            d, a = doc, at
                            while m.start() < a:  # an earlier document of the same stretch
                                d -= 1
                                a -= len(batch[d]) + 1
                            hits.setdefault(d, []).append((m.start() - a, i, m.end() - a))
        for d, found in hits.items():
            text, byte, char, turned = batch[d], 0, 0, {}
            for p in sorted({x for s, _, e in found for x in (s, e)}):
                char += len(text[byte:p].decode())
                byte, turned[p] = p, char
            out[d] = [(turned[s], turned[e], rules[i].kind) for s, i, e in sorted(found)]
        first = last
    return out


def joined(spans: list[Span], kinds: set[str] | None = None) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans if kinds is None or k in kinds)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_<base kind>, base_sha256 and spans of every row."""
    kinds = [r.kind for r in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = find_spans(texts(b.column(1)))
            counts = [pa.array([sum(k == kind for _, _, k in s) for s in found], pa.int64()) for kind in kinds]
            marks = pa.array([sha256(joined(s, set(kinds)).encode()).hexdigest() for s in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, marks, pa.array([joined(s) for s in found], pa.string())], names=["doc_id", *[f"n_{k}" for k in kinds], "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by <KIND>."""
    out, at = [], 0
    for s, e, k in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, its columns unchanged but for the text, in which secrets are masked (null stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            i = b.schema.get_field_index(text)
            found = find_spans(texts(b.column(i)))
            new = [mask(t, s) if s else t for t, s in zip(b.column(i).to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(i).type) if j == i else c for j, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
