"""The training-data pipeline over `documents`: quality, near-dedup, substring dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import minhash, packing, quality, secrets, substrings
from vecspark.llm.common import cut, drop, free_shuffles


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host does, go.

    A null or empty text is short and goes; a null source is a host; repeated rows are judged each; an empty table stays empty.
    """
    keep = {f"keep_{c}": F.col(c) for c in docs.columns}
    rated = quality.rule_failures(quality.document_counts(docs, "text", keep | {"host": F.col("source")}))
    # Rejected texts are not written again; their rows stay for the rates of the hosts.
    rated = cut(rated.withColumn("keep_text", F.when(~F.col("base_failed"), F.col("keep_text"))), "rated")
    bad = quality.host_verdicts(rated).where("host_rejected").select(F.col("host").alias("bad_host"))
    kept = rated.where("not base_failed").join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti")
    return kept.select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Rows are judged by a number of their own in order of doc_id, null last: rows that share an id or have none are
    judged each, in order of a hash of their texts, as the bounds of the order are sampled to the driver.
    """
    rows = cut(docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    free_shuffles(spark)
    ids = minhash.near_duplicates(rows, id_col="_row").where("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(ids, "_row", "left_semi").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; a document with no word left (so a null or empty one) goes.

    A text that loses nothing stays as it is, white space included; rows that share a doc_id do not cut each other; a null
    doc_id is the last.
    """
    other = tuple(c for c in docs.columns if c != "doc_id")
    rows = substrings.substring_dedup(docs, keep=other)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("keep_text"))
    rows = rows.where("n_words > n_removed")
    value = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[value.get(c, F.col(f"keep_{c}")).alias(c) for c in docs.columns])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked by their kind; a null text stays null, every row stays."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, one row a piece with its ids; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Tokenizer ids are out of SQL's reach; tests hold the stages against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        after = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs = after
    return docs
