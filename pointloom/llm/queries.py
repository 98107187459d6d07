"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licenses, ngram, pii, quality, secrets, suffixes, tokencount, warc
from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.components_of(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs, table(spark, sf_dir, "labels")))


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.recount(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_decontaminate, op3_suffix_dedup, op4_quality, op5_warc, op6_pii, op7_bpe, op8_secrets, op9_tokencount, op10_licenses)}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))"

_SQL = {
    "op1_ngram_join": f"""WITH RECURSIVE words AS (SELECT doc_id, coalesce({_BLANK}, []) AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct({_RUNS.format(k=5)}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
  rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
  links AS (SELECT a.doc_id AS i, b.doc_id AS j FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  reach(i, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.j, reach.r FROM reach JOIN links ON links.i = reach.i)
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT i, min(r) AS component_id FROM reach GROUP BY i) c ON c.i = doc_id""",
    "op2_decontaminate": f"""WITH item AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS x FROM item WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT k FROM windows), doc AS (SELECT doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
  places AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM doc, sizes WHERE len(w) >= k),
  found AS (SELECT p.doc_id, p.i, p.k, v.item_id FROM places p JOIN windows v ON v.k = p.k AND v.x = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
  hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM doc d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
  f AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, x, min(page_id) OVER (PARTITION BY x) AS first FROM p)
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the whole result; the tests hold the others against brute force."""
    return dict(_SQL)
