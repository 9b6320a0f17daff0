"""Queries for search, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import retrieval as rt
from lexispark.operators import search as se
from lexispark.plans.registry import TOKENS, query
from lexispark.sources.adapters import line_tokens, once, table


def form_tokens(spark, d):
    return line_tokens(spark, d).select(
        F.struct("unit_id", "pos").alias("token_id"), "unit_id", F.concat(F.lit("<"), "norm", F.lit(">")).alias("form"), "norm",
        F.reverse("lemma").alias("lemma"))


@query("search_tokens", f"""
WITH {TOKENS}, hits AS (SELECT norm, min({{'unit_id': unit_id, 'pos': pos}}) AS token_id FROM tokens
  WHERE contains('<' || norm || '>', 'on>') OR starts_with(norm, 'thor') OR contains(reverse(lemma), 'on>') GROUP BY norm)
SELECT norm, token_id.unit_id AS unit_id, token_id.pos AS pos FROM hits ORDER BY length(norm), token_id LIMIT 20""")
def search_tokens(spark, d):
    return se.search_tokens(form_tokens(spark, d), "on>", "thor", 20).select("norm", "token_id.unit_id", "token_id.pos")


@query("search_tokens_many", f"""
WITH {TOKENS}, counts AS (SELECT norm, count(*) AS occurrences FROM tokens GROUP BY norm),
vocab AS (SELECT norm, '<' || norm || '>' AS form, reverse(lemma) AS lemma, min({{'unit_id': unit_id, 'pos': pos}}) AS token_id FROM tokens GROUP BY ALL),
q AS (SELECT n_nationkey AS query_id, lower(right(r_name, 2)) || '>' AS query, lower(left(r_name, 2)) AS query_norm
  FROM nation JOIN region ON r_regionkey = n_regionkey),
hits AS (SELECT query_id, norm, min(token_id) AS token_id FROM vocab JOIN q
  ON contains(form, query) OR contains(lemma, query) OR starts_with(norm, query_norm) GROUP BY ALL)
SELECT query_id, norm, token_id.unit_id AS unit_id, token_id.pos AS pos, occurrences, CAST(row_number() OVER (
  PARTITION BY query_id ORDER BY length(norm), token_id) AS INTEGER) AS rank
FROM hits JOIN counts USING (norm) QUALIFY rank <= 20""")
def search_tokens_many(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    queries = nations.select(
        F.col("n_nationkey").alias("query_id"), F.concat(F.lower(F.right("r_name", F.lit(2))), F.lit(">")).alias("query"),
        F.lower(F.substring("r_name", 1, 2)).alias("query_norm"))
    index = once(spark, d, ("documents",), "search_index", lambda: se.search_index(form_tokens(spark, d)))
    return se.search_tokens_many(index, queries, 20).select(
        "query_id", "norm", "token_id.unit_id", "token_id.pos", "occurrences", "rank")


def _dictionary(spark, d):
    """Part names with their type as transliteration, counted over all order lines, and the same names unsold."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_type")
    names = parts.groupBy(F.col("p_name").alias("item")).agg(F.lower(F.min("p_type")).alias("translit"))
    names = names.unionByName(names.withColumn("item", F.concat("item", F.lit(" (new)"))))
    sold = table(spark, d, "lineitem", "l_partkey").join(
        parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("item"))
    return rt.count_with_zero(names, sold, "item")


_DICT = """
known AS (SELECT p_name AS item, lower(min(p_type)) AS translit FROM part GROUP BY p_name),
names AS (SELECT * FROM known UNION ALL SELECT item || ' (new)', translit FROM known),
sold AS (SELECT p_name AS item, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name),
dict AS (SELECT item, translit, coalesce(n, 0) AS occurrences FROM names LEFT JOIN sold USING (item))"""
_ITEM_HITS = "SELECT * FROM dict WHERE contains(item, 'd w') OR contains(replace(item, ' ', ''), 'dw') OR contains(translit, 'd w')"


@query("count_with_zero", f"WITH {_DICT} SELECT item, translit, occurrences FROM dict")
def count_with_zero(spark, d):
    return _dictionary(spark, d)


@query("search_items", f"WITH {_DICT} {_ITEM_HITS} ORDER BY occurrences DESC, item LIMIT 20")
def search_items(spark, d):
    return se.search_items(_dictionary(spark, d), "d w", "d w", 20)


@query("search_all", f"""
WITH {_DICT}, {TOKENS}
SELECT 'item' AS category, item AS label FROM ({_ITEM_HITS} ORDER BY occurrences DESC, item LIMIT 5)
UNION ALL SELECT 'token', norm FROM (SELECT norm, min({{'unit_id': unit_id, 'pos': pos}}) AS token_id FROM tokens WHERE contains('<' || norm || '>', 'and')
  OR contains(reverse(lemma), 'and') GROUP BY norm ORDER BY length(norm), token_id LIMIT 5)""")
def search_all(spark, d):
    return se.search_all(se.search_items(_dictionary(spark, d), "d w", "d w", 5),
                         se.search_tokens(form_tokens(spark, d), "and", "and", 5))


@query("page_rows", f"WITH {_DICT} SELECT item, occurrences FROM dict ORDER BY occurrences DESC, item LIMIT 10 OFFSET 10")
def page_rows(spark, d):
    rows = _dictionary(spark, d).select("item", "occurrences")
    return se.page_rows(rows, se.browse(rows, "frequency"), 2, 10)


@query("page_meta", f"""
WITH {_DICT} SELECT CAST(2 AS INTEGER) AS current_page, greatest(CAST(ceil(count(*) / 10.0) AS BIGINT), 1) AS last_page,
  count(*) AS total, 'frequency' AS sort FROM dict""")
def page_meta(spark, d):
    return se.page_meta(_dictionary(spark, d), 2, 10, "frequency")


@query("browse_alpha", f"""
WITH {TOKENS}, v AS (SELECT norm AS item, count(*) AS occurrences FROM tokens GROUP BY norm)
SELECT item, occurrences, row_number() OVER (ORDER BY item) AS rank, (row_number() OVER (ORDER BY item) - 1) // 50 + 1 AS page FROM v""")
def browse_alpha(spark, d):
    words = line_tokens(spark, d).groupBy(F.col("norm").alias("item")).agg(F.count(F.lit(1)).alias("occurrences"))
    return se.paged(words, se.browse(words, "alpha"), 50)


@query("browse_frequency", f"""
WITH {TOKENS}, v AS (SELECT norm AS item, count(*) AS occurrences FROM tokens GROUP BY norm)
SELECT item, occurrences, row_number() OVER (ORDER BY occurrences DESC, item) AS rank,
  (row_number() OVER (ORDER BY occurrences DESC, item) - 1) // 50 + 1 AS page FROM v""")
def browse_frequency(spark, d):
    words = line_tokens(spark, d).groupBy(F.col("norm").alias("item")).agg(F.count(F.lit(1)).alias("occurrences"))
    return se.paged(words, se.browse(words, "frequency"), 50)


@query("dense_reorder", """
SELECT c_custkey AS entry_id, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS sort_order
FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def dense_reorder(spark, d):
    customers = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    entries = customers.select(F.col("c_custkey").alias("entry_id"), (F.col("c_mktsegment") == "BUILDING").alias("is_locked"))
    requested = customers.select(F.col("c_custkey").alias("entry_id"), F.col("c_nationkey").alias("position")).unionByName(
        customers.select((-1 - F.col("c_custkey")).alias("entry_id"), F.col("c_nationkey").alias("position")))  # unknown ids
    return se.dense_reorder(entries, requested)
