"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, hmm, licenses, minhash, packing, quality, secrets, segmentation, sstable, substrings
from .common import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op6_token_sstables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digest(sstable.token_table(table(spark, sf_dir, "documents")))


def op7_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of `benchmark` against all documents."""
    index = cut(bm25.build_index(table(spark, sf_dir, "documents")), "index")
    found = bm25.search(index, table(spark, sf_dir, "benchmark"), 10)
    return found.withColumn("score", F.round("score", 6))


def op7_bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose doc_id is divisible by 20 against all documents."""
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(cut(bm25.build_index(docs), "index"), docs.where("doc_id % 20 = 0"), 10, "doc_id")
    return found.withColumn("score", F.round("score", 6))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.verdicts(licenses.scan(table(spark, sf_dir, "documents")))


def op2_hmm_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.digest(segmentation.sampled_segmentations(table(spark, sf_dir, "documents")))


def op10_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.substring_dedup(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_hmm_lm_scoring": op2_hmm_lm_scoring,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_vector_packing": op4_vector_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_sstables": op6_token_sstables,
    "op7_bm25_topk": op7_bm25_topk,
    "op7_bm25_documents": op7_bm25_documents,
    "op8_quality_rules": op8_quality_rules,
    "op9_gumbel_segmentations": op9_gumbel_segmentations,
    "op10_fm_substring_dedup": op10_fm_substring_dedup,
}

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, n_symbols > 0.1::double * word_chars AS f3, n_dup_lines > 0.3::double * n_lines AS f4 FROM b),
h AS (SELECT source, count(*) AS n, sum(f1::int) AS k1, sum(f2::int) AS k2, sum(f3::int) AS k3, sum(f4::int) AS k4 FROM f GROUP BY source),
u AS (SELECT source, n, v.r, v.k, v.k / n AS p FROM h, LATERAL (VALUES (1, k1), (2, k2), (3, k3), (4, k4)) v(r, k)),
m AS (SELECT r, sum(k) / sum(n) AS m, greatest(avg(p * p) - avg(p) * avg(p), 1e-6) AS v FROM u GROUP BY r),
s AS (SELECT r, m, greatest(1.0, least(1e6, m * (1 - m) / v - 1)) AS a FROM m),
bad AS (SELECT DISTINCT source FROM u JOIN s ON u.r = s.r WHERE (k + m * a) / (n + a) > 0.9)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
  n_repeat_words::bigint AS n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, min(r.y) AS component_id, min(r.y) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM m, range(13) r(o) WHERE low < doc_id),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN x ON w.doc_id = x.doc_id
"""

OP7_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM low),
s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d),
f AS (SELECT doc_id, dl, t, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM f GROUP BY t),
q AS (SELECT item_id, t, count(*) AS qf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS t FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id AS query_id, doc_id, sum(qf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / mean))) AS score
  FROM q JOIN df ON q.t = df.t JOIN f ON f.t = q.t, s GROUP BY item_id, doc_id)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 10
"""

OP7_DOCUMENTS_SQL = OP7_SQL.replace("SELECT item_id, unnest", "SELECT doc_id AS item_id, unnest").replace("FROM benchmark)", "FROM documents WHERE doc_id % 20 = 0)")

ORACLE_SQL: dict[str, str] = {
    "op7_bm25_topk": OP7_SQL,
    "op7_bm25_documents": OP7_DOCUMENTS_SQL,
    "op10_fm_substring_dedup": OP10_SQL,
    "op3_minhash_near_dedup": OP3_SQL,
    "op8_quality_rules": OP8_SQL,
}
