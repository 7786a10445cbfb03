"""The eleven metrics as Catalyst expressions and as numpy block kernels.

Coordinates are cast to double before any arithmetic. A result that the formula leaves undefined is NaN;
searches drop NaN before they rank. L2 is squared, L_p has no root.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN = "double('NaN')"
#: Term of each coordinate pair (a, b); sums of terms give these metrics.
_SUMS = {
    "l2": "(a - b) * (a - b)",
    "ip": "a * b",
    "l1": "abs(a - b)",
    "lp": "pow(abs(a - b), {p}D)",
    "canberra": f"if(abs(a) + abs(b) = 0D, {_NAN}, abs(a - b) / nullif(abs(a) + abs(b), 0D))",
    "jensenshannon": f"if(a <= 0D or b <= 0D, {_NAN}, -a * ln((a + b) / 2D / nullif(a, 0D)) - b * ln((a + b) / 2D / nullif(b, 0D)))",
}
_GOWER = f"case when isnan(a) or isnan(b) then {{skip}} when a >= 0D and b >= 0D then if(a > 1D or b > 1D, {_NAN}, abs(a - b)) when a < 0D and b < 0D then if(a <> b, 1D, 0D) else {_NAN} end"
#: Coordinates whose NaN marks share one number.
MARKS = 32
METRICS = ("l2", "ip", "l1", "linf", "lp", "canberra", "braycurtis", "jensenshannon", "jaccard", "nan_euclidean", "gower")
_ALIASES = {"euclidean": "l2", "inner_product": "ip"}


@dataclass(frozen=True)
class Metric:
    name: str
    p: float = 2.0

    @property
    def larger_is_better(self) -> bool:
        return self.name in ("ip", "jaccard")

    @property
    def worst(self) -> float:
        return float("-inf") if self.larger_is_better else float("inf")


def parse_metric(name: str | Metric, p: float = 2.0) -> Metric:
    """A metric by name or alias, in any case; cosine is searched as ip over normalised vectors."""
    if isinstance(name, Metric):
        return name
    key = _ALIASES.get(name.strip().lower(), name.strip().lower())
    if key not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    return Metric(key, p)


def _sum(term: str, x: str, y: str) -> str:
    return f"aggregate(zip_with({x}, {y}, (a, b) -> {term}), 0D, (s, v) -> s + v)"


def distance(metric: str | Metric, x: str, y: str, p: float = 2.0) -> Column:
    """Distance (or similarity) of two array columns, given by name."""
    m = parse_metric(metric, p)
    x, y = (f"cast({c} as array<double>)" for c in (x, y))
    if m.name in _SUMS:
        s = _sum(_SUMS[m.name].format(p=m.p), x, y)
        return F.expr(f"0.5D * {s}" if m.name == "jensenshannon" else s)
    if m.name == "linf":
        # NaN counts as the greatest value in array_max, so it stays visible.
        return F.expr(f"array_max(zip_with({x}, {y}, (a, b) -> abs(a - b)))")
    if m.name in ("braycurtis", "jaccard"):
        top, low = ("abs(a - b)", "abs(a + b)") if m.name == "braycurtis" else ("least(a, b)", "greatest(a, b)")
        return F.expr(f"coalesce({_sum(top, x, y)} / nullif({_sum(low, x, y)}, 0D), {_NAN})")
    if m.name == "nan_euclidean":
        n = _sum("if(isnan(a) or isnan(b), 0D, 1D)", x, y)
        s = _sum("if(isnan(a) or isnan(b), 0D, (a - b) * (a - b))", x, y)
        return F.expr(f"coalesce(size({x}) / nullif({n}, 0D) * {s}, {_NAN})")
    terms = f"filter(zip_with({x}, {y}, (a, b) -> {_GOWER.format(skip='null')}), t -> t is not null)"
    return F.expr(f"coalesce(aggregate({terms}, 0D, (s, v) -> s + v) / nullif(size({terms}), 0), {_NAN})")


def unrolled(m: Metric, x: str, y: str, dim: int) -> str:
    """The same over columns x0, x1, ... and y0, y1, ... that are never null, which Spark compiles where it interprets
    lambdas; of the metrics that skip NaN, x_nan0, ... mark the places of NaN, `MARKS` to a number."""

    def terms(term: str, join: str = " + ") -> str:
        return join.join(f"({re.sub(r'\b[ab]\b', lambda c: f'{x if c[0] == 'a' else y}{i}', term)})" for i in range(dim))

    if m.name in _SUMS:
        s = terms(_SUMS[m.name].format(p=m.p))
        return f"0.5D * ({s})" if m.name == "jensenshannon" else s
    if m.name == "linf":
        return f"greatest({terms('abs(a - b)', ', ')})" if dim > 1 else terms("abs(a - b)")
    if m.name in ("braycurtis", "jaccard"):
        top, low = ("abs(a - b)", "abs(a + b)") if m.name == "braycurtis" else ("least(a, b)", "greatest(a, b)")
        return f"coalesce(({terms(top)}) / nullif({terms(low)}, 0D), {_NAN})"
    n = f"nullif(cast({dim} - {' - '.join(f'bit_count({x}_nan{j} | {y}_nan{j})' for j in range(-(-dim // MARKS)))} as double), 0D)"
    if m.name == "nan_euclidean":
        return f"coalesce({dim} / {n} * ({terms('if(isnan(a) or isnan(b), 0D, (a - b) * (a - b))')}), {_NAN})"
    return f"coalesce(({terms(_GOWER.format(skip='0D'))}) / {n}, {_NAN})"


def block_distances(m: Metric, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of two blocks of rows (float64)."""
    if m.name == "ip":
        return q @ b.T
    if m.name == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (q @ b.T), 0)
    out = np.empty((len(q), len(b)))
    with np.errstate(all="ignore"):
        for i, x in enumerate(q):
            out[i] = _one_to_many(m, x, b)
    return out


def _one_to_many(m: Metric, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = np.abs(x - b)
    if m.name == "l1":
        return gap.sum(1)
    if m.name == "linf":
        return gap.max(1)
    if m.name == "lp":
        return (gap**m.p).sum(1)
    if m.name == "canberra":
        return (gap / (np.abs(x) + np.abs(b))).sum(1)
    if m.name == "braycurtis":
        return gap.sum(1) / np.abs(x + b).sum(1)
    if m.name == "jaccard":
        return np.minimum(x, b).sum(1) / np.maximum(x, b).sum(1)
    if m.name == "jensenshannon":
        mid = (x + b) / 2
        terms = -x * np.log(mid / x) - b * np.log(mid / b)
        return 0.5 * np.where((x <= 0) | (b <= 0), np.nan, terms).sum(1)
    if m.name == "nan_euclidean":
        ok = ~(np.isnan(x) | np.isnan(b))
        n = ok.sum(1)
        return np.where(n > 0, b.shape[1] / np.maximum(n, 1) * np.where(ok, gap * gap, 0).sum(1), np.nan)
    skip = np.isnan(x) | np.isnan(b)
    both, neither = (x >= 0) & (b >= 0), (x < 0) & (b < 0)
    terms = np.where(both, np.where((x > 1) | (b > 1), np.nan, gap), np.where(neither, (x != b).astype(float), np.nan))
    n = (~skip).sum(1)
    return np.where(n > 0, np.where(skip, 0, terms).sum(1) / np.maximum(n, 1), np.nan)
