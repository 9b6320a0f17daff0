"""Collects the runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return add


# ---- shared pieces of SQL: the same adapters as lexispark.sources.adapters ----------------------

LINES = r"""
line_offsets AS (
  SELECT doc_id, CAST(coalesce(sum(len(string_split(text, chr(10)))) OVER (
    ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents),
raw_lines AS (
  SELECT doc_id, source, before, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents JOIN line_offsets USING (doc_id)),
units AS (
  SELECT before + line_no AS unit_id, doc_id, source AS section, text, trim(lower(text)) AS text_norm,
         regexp_extract_all(lower(text), '[^ \t\r\n.,;:!?]+') AS words
  FROM raw_lines WHERE trim(text) <> '')"""

TOKENS = LINES + r""",
tokens AS (
  SELECT unit_id, section, pos, norm, left(norm, 4) AS root, norm AS lemma FROM (
    SELECT unit_id, section, unnest(words) AS norm, generate_subscripts(words, 1) AS pos FROM units))"""

BASKETS = """
tokens AS (
  SELECT l_orderkey AS unit_id, c_nationkey AS section, l_linenumber AS pos,
         p_brand AS brand, p_type AS type, p_size AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey)"""

BASKET_SETS = BASKETS + """,
sets AS (
  SELECT DISTINCT 'brand' AS item_type, unit_id, section, brand AS item FROM tokens WHERE brand <> ''
  UNION ALL
  SELECT DISTINCT 'type', unit_id, section, type FROM tokens WHERE type <> '')"""

PHRASES = TOKENS + r""",
lengths AS (SELECT unit_id, count(*) AS n_tokens FROM tokens GROUP BY unit_id),
full_groups AS (
  SELECT text_norm, min(unit_id) AS first_unit FROM units GROUP BY text_norm HAVING count(*) >= 3),
full_occ AS (
  SELECT 'full_unit' AS kind, left(u.text_norm, 500) AS pattern, coalesce(l.n_tokens, 0) AS word_count, u.unit_id,
         CAST(1 AS BIGINT) AS start_pos, coalesce(l.n_tokens, 0) AS end_pos, u.unit_id = g.first_unit AS is_first
  FROM units u JOIN full_groups g USING (text_norm) LEFT JOIN lengths l ON l.unit_id = g.first_unit),
grams AS (
  SELECT unit_id, n, array_to_string(words[len(words) - n + 1 : len(words)], ' ') AS pattern,
         CAST(len(words) - n + 1 AS BIGINT) AS start_pos, CAST(len(words) AS BIGINT) AS end_pos
  FROM units, (SELECT unnest([2, 3, 4, 5, 6]) AS n) WHERE len(words) >= n),
qualifying AS (SELECT n, pattern, count(*) AS n_units FROM grams GROUP BY n, pattern HAVING count(*) >= 10),
assigned AS (
  SELECT g.* FROM grams g JOIN qualifying USING (n, pattern)
  QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY n DESC) = 1),
gram_occ AS (
  SELECT 'final_ngram' AS kind, left(pattern, 500) AS pattern, CAST(n AS BIGINT) AS word_count, unit_id,
         start_pos, end_pos, unit_id = min(unit_id) OVER (PARTITION BY n, pattern) AS is_first
  FROM assigned),
occ AS (SELECT * FROM full_occ UNION ALL SELECT * FROM gram_occ),
ranges AS (SELECT unit_id, start_pos, end_pos FROM occ WHERE NOT is_first),
firsts AS (SELECT unit_id FROM occ GROUP BY unit_id HAVING bool_or(is_first) AND bool_and(is_first))"""

LINE_SETS = PHRASES + """,
flagged AS (
  SELECT t.*, NOT EXISTS (SELECT 1 FROM ranges r WHERE r.unit_id = t.unit_id
                          AND t.pos BETWEEN r.start_pos AND r.end_pos) AS kept FROM tokens t),
sets AS (
  SELECT item_type, unit_id, section, item, bool_or(kept) AS in_reduced FROM (
    SELECT 'root' AS item_type, unit_id, section, root AS item, kept FROM flagged
    UNION ALL SELECT 'lemma', unit_id, section, lemma, kept FROM flagged)
  WHERE item <> '' GROUP BY ALL)"""
