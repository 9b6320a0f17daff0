"""Statistics builds that several queries read: stored once per session and input folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import cooccurrence as co
from lexispark.operators import dispersion as di
from lexispark.operators import phrases as ph
from lexispark.plans.registry import BASKETS
from lexispark.session import settle
from lexispark.sources import adapters
from lexispark.sources.adapters import basket_tokens, flagged_line_tokens, line_units, table

BASKET_ITEMS = {"brand": "brand", "type": "type"}
LINE_ITEMS = {"root": "root", "lemma": "lemma"}
FORCED = (("brand", "Brand#2", "Brand#1"), ("brand", "Brand#3", "Brand#missing"), ("brand", "Brand#nope", "Brand#missing"))

TABLES = ("documents", "lineitem", "orders", "customer", "part", "nation")


def once(spark, d, name, build):
    """The named table for these files, built on first use and again when a file changes."""
    return adapters.once(spark, d, TABLES, name, build)


def stored(spark, d, name, build):
    """The same, written on first use."""
    return once(spark, d, name, lambda: settle(build()))


def basket_ranges(spark, d):
    """Returned order lines play the part of repeated phrases: they are masked in the reduced variant."""
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("start_pos"), F.col("l_linenumber").alias("end_pos"))


def basket_firsts(spark, d):
    """Finished orders without a returned line."""
    return table(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("unit_id")).join(basket_ranges(spark, d).select("unit_id"), "unit_id", "left_anti")


def basket_sets(spark, d):
    flagged = co.flag_masked(basket_tokens(spark, d), basket_ranges(spark, d))
    return co.item_sets(co.item_occurrences(flagged, BASKET_ITEMS))


def basket_table(spark, d):
    return once(spark, d, "basket_table", lambda: co.collocation_table(
        basket_tokens(spark, d), BASKET_ITEMS, basket_ranges(spark, d), basket_firsts(spark, d), forced=FORCED))


def basket_dispersion(spark, d):
    return stored(spark, d, "basket_dispersion", lambda: di.dispersion_table(basket_sets(spark, d)))


def line_occurrences(spark, d):
    return stored(spark, d, "line_occurrences", lambda: ph.phrase_occurrences(line_units(spark, d)))


def line_sets(spark, d):
    ranges = ph.masked_ranges(line_occurrences(spark, d))
    return stored(spark, d, "line_sets", lambda: co.item_sets(co.item_occurrences(
        flagged_line_tokens(spark, d, ranges), LINE_ITEMS)))


LINE_FOLDS = {
    "n_partners": ("count(*)", "sum"), "n_ab": ("sum(n_ab)", "sum"), "n_first": ("sum(n_ab_first_instance)", "sum"),
    "n_family": ("count_if(in_family)", "sum"), "sum_ab": ("sum(n_a * n_b)", "sum"), "max_g2": ("max(g2)", "max"),
    "min_p": ("min(p)", "min"), "sum_p": ("sum(p)", "sum"), "sum_top": ("sum(cast(round(top_share * n_ab) as bigint))", "sum"),
    "last_section": ("max(top_section)", "max"), "n_total": ("min(n_total)", "min"), "n_scope": ("min(n_scope)", "min")}


def line_table(spark, d):
    """The pair table of the lines by first item; the table itself is never stored."""
    occ = line_occurrences(spark, d)
    flagged = flagged_line_tokens(spark, d, ph.masked_ranges(occ))
    return stored(spark, d, "line_table", lambda: co.folded_collocations(
        line_sets(spark, d), co.unit_scopes(flagged), ph.first_instance_units(occ), LINE_FOLDS))


BASKET_SETS2 = BASKETS + """,
returned AS (SELECT DISTINCT l_orderkey AS unit_id, l_linenumber AS pos FROM lineitem WHERE l_returnflag = 'R'),
firsts AS (SELECT o_orderkey AS unit_id FROM orders WHERE o_orderstatus = 'F'
           AND o_orderkey NOT IN (SELECT unit_id FROM returned)),
flagged AS (SELECT t.*, r.unit_id IS NULL AS kept FROM tokens t LEFT JOIN returned r USING (unit_id, pos)),
sets AS (SELECT item_type, unit_id, section, item, bool_or(kept) AS in_reduced FROM (
  SELECT 'brand' AS item_type, unit_id, section, brand AS item, kept FROM flagged
  UNION ALL SELECT 'type', unit_id, section, type, kept FROM flagged) WHERE item <> '' GROUP BY ALL)"""


def pair_table_sql(sets: str, forced: str = "SELECT '' AS item_type, '' AS item_a, '' AS item_b WHERE false") -> str:
    """CTEs up to ``coll``: the pair table computed the direct way, all statistics from their definitions."""
    return sets + f""",
forced AS ({forced}),
marg AS (SELECT item_type, item, count(*) AS n_raw, count(*) FILTER (in_reduced) AS n_reduced FROM sets GROUP BY ALL),
usable AS (SELECT s.* FROM sets s JOIN marg m USING (item_type, item) WHERE m.n_raw >= 5
           OR (s.item_type, s.item) IN (SELECT (item_type, item_a) FROM forced UNION SELECT (item_type, item_b) FROM forced)),
per_unit AS (SELECT item_type, unit_id, bool_or(in_reduced) AS red FROM sets GROUP BY ALL),
totals AS (SELECT 'raw' AS variant, item_type, count(*) AS n_total FROM per_unit GROUP BY ALL
  UNION ALL SELECT 'phrase_reduced', item_type, count(*) FILTER (red) FROM per_unit GROUP BY ALL),
unit_kept AS (SELECT unit_id, bool_or(kept) AS kept FROM flagged GROUP BY unit_id),
scopes AS (SELECT 'raw' AS variant, count(*) AS n_scope FROM unit_kept
  UNION ALL SELECT 'phrase_reduced', count(*) FILTER (kept) FROM unit_kept),
joint AS (SELECT a.item_type, a.unit_id, a.section, a.item AS item_a, b.item AS item_b, a.in_reduced AND b.in_reduced AS red
  FROM usable a JOIN usable b ON a.item_type = b.item_type AND a.unit_id = b.unit_id AND a.item < b.item),
by_variant AS (SELECT 'raw' AS variant, *, false AS is_first FROM joint
  UNION ALL SELECT 'phrase_reduced', *, unit_id IN (SELECT unit_id FROM firsts) FROM joint WHERE red),
by_section AS (SELECT variant, item_type, item_a, item_b, section, count(*) AS c, min(unit_id) AS u,
  count(*) FILTER (is_first) AS f FROM by_variant GROUP BY ALL),
counted AS (SELECT variant, item_type, item_a, item_b, CAST(sum(c) AS BIGINT) AS n_ab, CAST(sum(f) AS BIGINT) AS n_ab_first_instance,
  first(section ORDER BY c DESC, u) AS top_section, max(c) / sum(c) AS top_share FROM by_section GROUP BY ALL),
wanted AS (
  SELECT * FROM counted
  UNION ALL
  SELECT v.variant, f.item_type, f.item_a, f.item_b, 0, 0, NULL, NULL FROM forced f, (SELECT DISTINCT variant FROM totals) v
  WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.variant = v.variant AND c.item_type = f.item_type
                    AND c.item_a = f.item_a AND c.item_b = f.item_b)),
sized AS (SELECT w.*, n_total, n_scope,
  coalesce(CASE WHEN w.variant = 'raw' THEN a.n_raw ELSE a.n_reduced END, 0) AS n_a,
  coalesce(CASE WHEN w.variant = 'raw' THEN b.n_raw ELSE b.n_reduced END, 0) AS n_b
  FROM wanted w LEFT JOIN marg a ON a.item_type = w.item_type AND a.item = w.item_a
  LEFT JOIN marg b ON b.item_type = w.item_type AND b.item = w.item_b
  JOIN totals t ON t.variant = w.variant AND t.item_type = w.item_type JOIN scopes s ON s.variant = w.variant),
kept_pairs AS (SELECT * FROM sized WHERE (n_a >= 5 AND n_b >= 5) OR (item_type, item_a, item_b) IN (SELECT (item_type, item_a, item_b) FROM forced)),
tables2 AS (SELECT DISTINCT least(n_a, n_b) AS k, greatest(n_a, n_b) AS m, n_ab AS x, n_total AS n FROM kept_pairs WHERE n_ab > 0),
terms AS (SELECT k, m, x, n, unnest(range(greatest(x, k + m - n), k + 1)) AS i FROM tables2),
tails AS (SELECT k, m, x, n, least(1.0, sum(exp(
  lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(n - k + 1) - lgamma(m - i + 1) - lgamma(n - k - m + i + 1)
  - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)))) AS p FROM terms GROUP BY ALL),
scored AS (SELECT s.*, n_a * n_b / greatest(n_total, 1) AS expected, t.p,
  n_a >= 5 AND n_b >= 5 AND n_ab >= 2 AS in_family,
  n_ab AS k11, n_a - n_ab AS k12, n_b - n_ab AS k21, n_total - n_a - n_b + n_ab AS k22,
  n_a * n_b / n_total AS e11, n_a * (n_total - n_b) / n_total AS e12,
  (n_total - n_a) * n_b / n_total AS e21, (n_total - n_a) * (n_total - n_b) / n_total AS e22
  FROM kept_pairs s LEFT JOIN tails t ON t.k = least(n_a, n_b) AND t.m = greatest(n_a, n_b) AND t.x = n_ab AND t.n = n_total),
ranked AS (SELECT variant, item_type, p, row_number() OVER (PARTITION BY variant, item_type ORDER BY p) AS r,
  count(*) OVER (PARTITION BY variant, item_type) AS m FROM scored WHERE in_family),
limits AS (SELECT variant, item_type, max(p) AS p_limit FROM ranked WHERE p <= (r / m) * 0.05 GROUP BY ALL),
coll AS (SELECT s.*, CASE WHEN n_ab > 0 THEN log2(n_ab / expected) END AS pmi,
  2 * (CASE WHEN k11 > 0 AND e11 > 0 THEN k11 * ln(k11 / e11) ELSE 0 END + CASE WHEN k12 > 0 AND e12 > 0 THEN k12 * ln(k12 / e12) ELSE 0 END
     + CASE WHEN k21 > 0 AND e21 > 0 THEN k21 * ln(k21 / e21) ELSE 0 END + CASE WHEN k22 > 0 AND e22 > 0 THEN k22 * ln(k22 / e22) ELSE 0 END) AS g2,
  in_family AND coalesce(p <= p_limit, false) AS fdr_significant,
  CASE WHEN n_ab > expected THEN 'association' WHEN n_ab < expected THEN 'avoidance' ELSE 'neutral' END AS direction
  FROM scored s LEFT JOIN limits l USING (variant, item_type))"""


FORCED_SQL = """SELECT * FROM (VALUES ('brand', 'Brand#1', 'Brand#2'), ('brand', 'Brand#3', 'Brand#missing'),
  ('brand', 'Brand#missing', 'Brand#nope')) AS f(item_type, item_a, item_b)"""
BASKET_COLL = pair_table_sql(BASKET_SETS2, FORCED_SQL)
