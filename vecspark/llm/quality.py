"""Host-level quality rules, in DataFrame operations only.

Every document gets word, symbol and repetition counts and the rules it fails. Rule failures are
summed by host, each rate is shrunk towards the corpus rate with a beta prior fitted to the hosts by
moments, and hosts whose shrunk rate passes `max_host_rate` take their documents with them.

Repeated windows are found inside the row: each 3-word window becomes one long holding the low bits of
its 64-bit hash and its position; sorted, equal windows are neighbours, and neighbours with the same
hash bits are compared word by word. No row is exploded and no text is shuffled.

Defined cases: a null text counts as empty (it fails `short`); a null host is one host of its own;
repeated rows each count; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_RATIO = 0.1
MAX_DUP_LINE_RATIO = 0.3
#: A host goes only if nearly all of its documents fail one rule.
MAX_HOST_RATE = 0.9

RULES = ("short", "repeats", "symbols", "dup_lines")


def document_counts(docs: DataFrame, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """`keep` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    base = docs.select(*[c.alias(k) for k, c in (keep or {}).items()], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    words = base.withColumn("_w", F.expr(rf"array_remove(split(_t, '[{WHITE}]+'), '')".replace("\\", "\\\\")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(rf"[^{WHITE}]"))
    words = words.withColumn("_l", lines).withColumn("_n", F.size("_w")).withColumn("_b", F.length(F.bin("_n")))
    # The hash takes the bits that the position leaves free.
    packed = F.expr(
        "if(_n < 4, array(), sort_array(transform(sequence(0, greatest(_n - 3, 0)),"
        " i -> shiftleft(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), _b) | cast(i as bigint))))"
    )
    df = words.withColumn("_s", packed).withColumn("_m", F.expr("shiftleft(1L, _b) - 1"))
    same = (
        "(shiftrightunsigned({a}, _b) = shiftrightunsigned({b}, _b)"
        " and get(_w, cast({a} & _m as int)) = get(_w, cast({b} & _m as int))"
        " and get(_w, cast({a} & _m as int) + 1) = get(_w, cast({b} & _m as int) + 1)"
        " and get(_w, cast({a} & _m as int) + 2) = get(_w, cast({b} & _m as int) + 2))"
    )
    repeated = F.expr(
        "transform(filter(_s, (x, i) ->"
        f" (i > 0 and {same.format(a='x', b='get(_s, i - 1)')})"
        f" or (i < size(_s) - 1 and {same.format(a='x', b='get(_s, i + 1)')})), x -> cast(x & _m as int))"
    )
    df = df.withColumn("_p", F.sort_array(repeated))
    covered = F.expr("aggregate(transform(_p, (p, i) -> least(3, coalesce(get(_p, i + 1) - p, 3))), 0L, (a, v) -> a + v)")
    return df.select(
        *(keep or {}),
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_p") == 0, F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def rule_failures(counts: DataFrame) -> DataFrame:
    """Adds one boolean column fail_<rule> a rule, and base_failed."""
    return counts.withColumns(
        {
            "fail_short": F.col("n_words") < MIN_WORDS,
            "fail_repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
            "fail_symbols": F.col("n_symbols") > MAX_SYMBOL_RATIO * F.col("word_chars"),
            "fail_dup_lines": F.col("n_dup_lines") > MAX_DUP_LINE_RATIO * F.col("n_lines"),
        }
    ).withColumn("base_failed", F.col("fail_short") | F.col("fail_repeats"))


def host_verdicts(failures: DataFrame, host: str = "host", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row a host and its shrunk failure rate a rule; host_rejected if one passes max_host_rate."""
    sums = failures.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"k_{r}") for r in RULES])
    sums = cut(sums, "hosts")
    prior = [F.sum("host_docs").cast("double").alias("N"), F.count(F.lit(1)).alias("H")]
    for r in RULES:
        rate = F.col(f"k_{r}") / F.col("host_docs")
        prior += [F.sum(f"k_{r}").cast("double").alias(f"s_{r}"), F.avg(rate * rate).alias(f"q_{r}"), F.avg(rate).alias(f"m_{r}")]
    # One row, whatever the number of hosts.
    fitted = sums.agg(*prior)
    out = sums.crossJoin(F.broadcast(fitted))
    for r in RULES:
        mean = F.col(f"s_{r}") / F.col("N")
        var = F.greatest(F.col(f"q_{r}") - F.col(f"m_{r}") * F.col(f"m_{r}"), F.lit(1e-6))
        strength = F.greatest(F.lit(1.0), F.least(F.lit(1e6), mean * (1 - mean) / var - 1))
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + mean * strength) / (F.col("host_docs") + strength))
    rejected = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_host_rate
    return out.select(host, "host_docs", *[f"rate_{r}" for r in RULES], rejected.alias("host_rejected"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, failed rules, base_failed, host_rejected and kept of every row of docs."""
    failures = cut(rule_failures(document_counts(docs, text, {"doc_id": F.col(id_col), "host": F.col(host)})), "quality")
    bad = host_verdicts(failures, "host", max_host_rate).where("host_rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("host_rejected"))
    out = failures.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left").drop("bad_host")
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
