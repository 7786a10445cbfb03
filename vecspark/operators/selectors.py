"""Id selectors, metadata filters and output projection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

Selector = Callable[[Column], Column]
#: Longer lists go through a join instead of an IN list.
IN_LIST = 1000


def id_range(low: int, high: int) -> Selector:
    """low <= id < high; pushed to the scan."""
    return lambda c: (c >= low) & (c < high)


def id_array(ids: Iterable[int]) -> Selector:
    found = sorted(set(ids))
    return lambda c: c.isin(found)


def id_bitmap(bitmap: bytes) -> Selector:
    """Bit id & 7 of byte id >> 3; ids outside are not selected."""
    n = 8 * len(bitmap)
    byte = lambda c: F.conv(F.hex(F.substring(F.lit(bytearray(bitmap)), (c / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return lambda c: F.when((c >= 0) & (c < n), F.getbit(F.coalesce(byte(c), F.lit(0)), (c % 8).cast("int")) == 1).otherwise(False)


def id_call(f: Callable[[int], bool]) -> Selector:
    """A Python predicate, applied to Arrow batches."""

    @F.pandas_udf(BooleanType())
    def go(s: pd.Series) -> pd.Series:
        return s.map(f).astype(bool)

    return lambda c: go(c)


def every() -> Selector:
    return lambda c: F.lit(True)


def negate(s: Selector) -> Selector:
    return lambda c: ~s(c)


def both(*ss: Selector) -> Selector:
    return lambda c: reduce(lambda a, b: a & b, (s(c) for s in ss))


def either(*ss: Selector) -> Selector:
    return lambda c: reduce(lambda a, b: a | b, (s(c) for s in ss))


def differ(a: Selector, b: Selector) -> Selector:
    return lambda c: a(c) != b(c)


def select_ids(base: DataFrame, s: Selector) -> DataFrame:
    return base.where(s(F.col("id")))


def select_batch(base: DataFrame, ids: DataFrame | Iterable[int]) -> DataFrame:
    """Rows whose id is listed, by a semi join; a short list becomes an IN list that the scan can use."""
    if isinstance(ids, DataFrame):
        return base.join(ids.select("id").distinct(), "id", "left_semi")
    found = sorted(set(ids))
    if len(found) <= IN_LIST:
        return base.where(F.col("id").isin(found))
    return base.join(base.sparkSession.createDataFrame([(i,) for i in found], "id long"), "id", "left_semi")


#: Tokens of a filter: quoted text, the operator, or a bare word.
_TOKEN = re.compile(r"\s*(?:'(?P<one>[^']*)'|\"(?P<two>[^\"]*)\"|(?P<op>=+)|(?P<word>[^\s'\"=]+))")
_KEY = re.compile(r"[A-Za-z_]\w*", re.ASCII)


def parse_filter(expression: str) -> list[tuple[str, str]]:
    """(key, literal) of each clause.

    filter: clause {"and" clause}, `and` in any case; clause: key "==" literal; key: a name; literal: quoted text or a
    bare word without quotes and equal signs. Anything else is a ValueError.
    """
    wrong = ValueError(f"unsupported filter: {expression}")
    tokens, at, end = [], 0, len(expression.rstrip())
    while at < end:
        m = _TOKEN.match(expression, at, end)
        if not m:
            raise wrong
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    out = []
    for i in range(0, len(tokens) + 1, 4):
        clause, after = tokens[i : i + 3], tokens[i + 3 : i + 4]
        if len(clause) < 3 or clause[0][0] != "word" or not _KEY.fullmatch(clause[0][1]) or clause[1] != ("op", "==") or clause[2][0] == "op":
            raise wrong
        out.append((clause[0][1], clause[2][1]))
        if not after:
            return out
        if after[0][0] != "word" or after[0][1].lower() != "and":
            raise wrong
    raise wrong


def filter_column(expression: str, columns: dict[str, Column], metadata: Column) -> Column:
    """The filter as a condition: named columns first, other keys from the JSON metadata.

    Values are compared as the text that a Python str() would give: true is True, a missing key is None.
    """

    def text(key: str) -> Column:
        raw = columns[key].cast("string") if key in columns else F.get_json_object(metadata, f"$.{key}")
        bare = F.when(raw.isNull(), "None").when(raw == "true", "True").when(raw == "false", "False").otherwise(raw)
        return F.coalesce(raw, F.lit("None")) if key in columns else bare

    return reduce(lambda a, b: a & b, (text(k) == v for k, v in parse_filter(expression)))


def project(rows: DataFrame, fields: list[str] | None = None, never: tuple[str, ...] = ("vector", "vec")) -> DataFrame:
    """Only the asked columns, all if none; vectors are never returned."""
    return rows.select(*[c for c in rows.columns if c not in never and (not fields or c in fields)])


def filtered_knn(queries: DataFrame, base: DataFrame, k: int, condition: Column, metric: str = "l2", mode: str = "pre", oversample: int = 8) -> DataFrame:
    """k nearest that meet a condition on base's columns.

    `pre` filters before the search and is exact. `post` takes the oversample * k nearest, filters them and
    cuts at k, and can return fewer.
    """
    from .exact import knn, top_k
    from ..functions.metrics import parse_metric

    if k <= 0:
        raise ValueError("limit must be positive")
    if mode == "pre":
        return knn(queries, base.where(condition), k, metric)
    near = knn(queries, base, oversample * k, metric)
    ok = base.where(condition).select("id")
    return top_k(near.join(ok, "id", "left_semi").select("query_id", "id", "distance"), k, parse_metric(metric).larger_is_better)
