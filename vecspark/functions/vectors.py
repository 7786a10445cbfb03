"""Element-wise vector functions as Catalyst expressions over array columns (by name)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: str) -> str:
    return f"cast({c} as array<double>)"


def norm2(x: str) -> Column:
    return F.expr(f"aggregate({_d(x)}, 0D, (s, v) -> s + v * v)")


def norm(x: str) -> Column:
    return F.sqrt(norm2(x))


def normalize(x: str) -> Column:
    """x over its norm; a zero vector stays."""
    return F.expr(f"transform({_d(x)}, v -> v / if(aggregate({_d(x)}, 0D, (s, u) -> s + u * u) > 0D, sqrt(aggregate({_d(x)}, 0D, (s, u) -> s + u * u)), 1D))")


def add(x: str, y: str) -> Column:
    return F.expr(f"zip_with({_d(x)}, {_d(y)}, (a, b) -> a + b)")


def sub(x: str, y: str) -> Column:
    return F.expr(f"zip_with({_d(x)}, {_d(y)}, (a, b) -> a - b)")


def add_scalar(x: str, c: float) -> Column:
    return F.expr(f"transform({_d(x)}, a -> a + {float(c)!r}D)")


def madd(x: str, factor: float, y: str) -> Column:
    """x + factor * y."""
    return F.expr(f"zip_with({_d(x)}, {_d(y)}, (a, b) -> a + {float(factor)!r}D * b)")


def argmin(x: str) -> Column:
    """Place (from 0) of the first least element; 0 for an empty array."""
    return F.expr(f"coalesce(greatest(array_position({x}, array_min({x})) - 1, 0), 0)").cast("long")


def ip_to_l2(x2, y2, ip):
    """Squared distances from squared norms and inner products, as columns or as numpy arrays."""
    return x2 + y2 - 2 * ip
