"""The registered queries of this subpackage: one thin ``opN_<name>`` for each operator, with
its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import kneser_ney, licenses, main_text, mixing, ngram_join, pseudonyms, pu_quality, sharding, spherical_caps, winnowing
from .common import documents


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents; edge cases as in ``ngram_join.ngram_jaccard_join``."""
    return ngram_join.ngram_jaccard_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op1_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings; edge cases as in ``spherical_caps.cap_near_duplicates``."""
    return spherical_caps.cap_near_duplicates(documents(spark, sf_dir, "embeddings"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of pages; edge cases as in ``main_text.extract_main_text``."""
    return main_text.extract_main_text(documents(spark, sf_dir, "pages"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents, learned from labels outside of the held-out fold; edge cases as in ``pu_quality.score_quality``."""
    return pu_quality.quality_report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents; edge cases, and where the key comes from, as in ``pseudonyms.pseudonym_report``."""
    return pseudonyms.pseudonym_report(documents(spark, sf_dir))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents in 24 shards; edge cases as in ``sharding.shard_report``."""
    return sharding.shard_report(documents(spark, sf_dir))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents against all items; edge cases as in ``winnowing.mark_contaminated``."""
    return winnowing.decontamination_report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents, mixed to the default targets; edge cases as in ``mixing.mix``."""
    return mixing.mixing_report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents, learned outside of the held-out fold; edge cases as in ``kneser_ney.identify_languages``."""
    return kneser_ney.language_report(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents; edge cases as in ``licenses.scan_licenses``."""
    return licenses.license_report(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_spherical_caps, op2_ngram_jaccard_join, op3_main_text, op4_pu_quality, op5_feistel_pseudonyms, op6_sampled_splitters, op7_winnowing, op8_soft_mixing, op9_kneser_ney, op10_license_scan)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL where the result can be told in SQL; the others learn models or use keyed hashes and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_spherical_caps": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
walk AS (SELECT vec_id AS src, vec_id AS dst FROM v UNION SELECT w.src, l.b FROM walk w JOIN l ON l.a = w.dst),
c AS (SELECT src AS vec_id, min(dst) AS component_id FROM walk GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op2_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
walk AS (SELECT doc_id AS src, doc_id AS dst FROM s UNION SELECT w.src, l.b FROM walk w JOIN l ON l.a = w.dst)
SELECT s.doc_id, len(any_value(sh))::BIGINT AS n_shingles, min(dst) AS component_id FROM s JOIN walk ON src = s.doc_id GROUP BY 1""",
    "op7_winnowing": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0))),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
