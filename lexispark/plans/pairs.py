"""Queries over item sets, pair counts, pair statistics and dispersion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import stats as st
from lexispark.operators import cooccurrence as co
from lexispark.operators import dispersion as di
from lexispark.plans import builds as bd
from lexispark.plans.registry import BASKETS, LINE_SETS, query
from lexispark.session import settle
from lexispark.sources.adapters import basket_tokens


@query("item_sets", f"WITH {bd.BASKET_SETS2} SELECT item_type, unit_id, section, item, in_reduced FROM sets")
def item_sets(spark, d):
    return bd.basket_sets(spark, d)


@query("item_sets_lines", f"""
WITH {LINE_SETS} SELECT item_type, section, count(*) AS n_rows, count(*) FILTER (in_reduced) AS n_reduced,
  count(DISTINCT item) AS n_items FROM sets GROUP BY ALL""")
def item_sets_lines(spark, d):
    return bd.line_sets(spark, d).groupBy("item_type", "section").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("in_reduced"), 1)).alias("n_reduced"),
        F.countDistinct("item").alias("n_items"))


@query("n_total", f"""
WITH {bd.BASKET_SETS2}, u AS (SELECT item_type, unit_id, bool_or(in_reduced) AS red FROM sets GROUP BY ALL)
SELECT item_type, 'raw' AS variant, count(*) AS n_total FROM u GROUP BY ALL
UNION ALL SELECT item_type, 'phrase_reduced', count(*) FILTER (red) FROM u GROUP BY ALL""")
def n_total(spark, d):
    return co.unit_totals(bd.basket_sets(spark, d))


@query("marginals", f"""
WITH {bd.BASKET_SETS2} SELECT item_type, item, count(*) AS n_raw, count(*) FILTER (in_reduced) AS n_reduced FROM sets GROUP BY ALL""")
def marginals(spark, d):
    return co.marginals(bd.basket_sets(spark, d))


@query("pair_counts", f"""
WITH {bd.BASKET_SETS2} SELECT a.item_type, a.item AS item_a, b.item AS item_b, count(*) AS n_ab
FROM sets a JOIN sets b ON a.item_type = b.item_type AND a.unit_id = b.unit_id AND a.item < b.item GROUP BY ALL""")
def pair_counts(spark, d):
    return co.pair_counts(bd.basket_sets(spark, d))


@query("pair_counts_lines", f"""
WITH {LINE_SETS}, freq AS (SELECT item_type, item FROM sets GROUP BY ALL HAVING count(*) >= 5),
f AS (SELECT sets.* FROM sets JOIN freq USING (item_type, item)),
pc AS (SELECT a.item_type, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM f a JOIN f b
  ON a.item_type = b.item_type AND a.unit_id = b.unit_id AND a.item < b.item GROUP BY ALL)
SELECT item_type, n_ab, count(*) AS n_pairs, max(item_a) AS last_a, min(item_b) AS first_b FROM pc GROUP BY ALL""")
def pair_counts_lines(spark, d):
    return co.pair_count_sizes(bd.line_sets(spark, d))


@query("item_floor", f"""
WITH {BASKETS}, sets AS (SELECT DISTINCT unit_id, CAST(size AS VARCHAR) AS item FROM tokens),
m AS (SELECT item FROM sets GROUP BY item HAVING count(*) >= (SELECT count(DISTINCT unit_id) / 13 FROM sets)),
f AS (SELECT sets.* FROM sets JOIN m USING (item))
SELECT 'size' AS item_type, a.item AS item_a, b.item AS item_b, count(*) AS n_ab
FROM f a JOIN f b ON a.unit_id = b.unit_id AND a.item < b.item GROUP BY ALL""")
def item_floor(spark, d):
    tokens = basket_tokens(spark, d)
    sets = settle(co.item_sets(co.item_occurrences(co.flag_masked(tokens, None), {"size": "size"})))
    n_units = co.unit_totals(sets).where("variant = 'raw'").first().n_total  # one number
    return co.pair_counts(sets, floor=-(-n_units // 13))


_COUNT_COLUMNS = ["item_type", "variant", "item_a", "item_b", "n_a", "n_b", "n_ab"]


@query("preregistered_pairs", f"""
WITH {bd.BASKET_COLL} SELECT item_type, variant, item_a, item_b, n_a, n_b, n_ab, round(g2, 5) AS g2, fdr_significant FROM coll
WHERE (item_type, item_a, item_b) IN (SELECT (item_type, item_a, item_b) FROM forced)""")
def preregistered_pairs(spark, d):
    listed = co.canonical_pairs(bd.FORCED, spark)
    return bd.basket_table(spark, d).join(F.broadcast(listed), ["item_type", "item_a", "item_b"], "left_semi").select(
        *_COUNT_COLUMNS, F.round("g2", 5).alias("g2"), "fdr_significant")


@query("first_instance_counts", f"WITH {bd.BASKET_COLL} SELECT variant, item_type, item_a, item_b, n_ab, n_ab_first_instance FROM coll")
def first_instance_counts(spark, d):
    return bd.basket_table(spark, d).select("variant", "item_type", "item_a", "item_b", "n_ab", "n_ab_first_instance")


@query("top_section", f"""
WITH {bd.BASKET_COLL} SELECT variant, item_type, item_a, item_b, CAST(top_section AS VARCHAR) AS top_section, round(top_share, 6) AS top_share FROM coll""")
def top_section(spark, d):
    return bd.basket_table(spark, d).select(
        "variant", "item_type", "item_a", "item_b", F.col("top_section").cast("string").alias("top_section"),
        F.round("top_share", 6).alias("top_share"))


@query("expected_pmi_g2", f"""
WITH {bd.BASKET_COLL} SELECT variant, item_type, item_a, item_b, round(expected, 5) AS expected, round(pmi, 6) AS pmi, round(g2, 5) AS g2 FROM coll""")
def expected_pmi_g2(spark, d):
    return bd.basket_table(spark, d).select(
        "variant", "item_type", "item_a", "item_b", F.round("expected", 5).alias("expected"), F.round("pmi", 6).alias("pmi"),
        F.round("g2", 5).alias("g2"))


@query("hypergeom_sf", f"""
WITH {bd.BASKET_COLL} SELECT variant, item_type, item_a, item_b, round(p, 6) AS p, CASE WHEN p < 0.001 THEN round(log10(p), 5) END AS log10_p FROM coll""")
def hypergeom_sf(spark, d):
    """Rounded, and small ones as logarithms, which tell them apart."""
    return bd.basket_table(spark, d).select(
        "variant", "item_type", "item_a", "item_b", F.round("p", 6).alias("p"), F.when(F.col("p") < 0.001, F.round(F.log10("p"), 5)).alias("log10_p"))


@query("bh_fdr", f"WITH {bd.BASKET_COLL} SELECT variant, item_type, item_a, item_b, in_family, fdr_significant FROM coll")
def bh_fdr(spark, d):
    return bd.basket_table(spark, d).select("variant", "item_type", "item_a", "item_b", "in_family", "fdr_significant")


@query("family_sizes", f"""
WITH {bd.BASKET_COLL} SELECT variant, item_type, count(*) FILTER (in_family) AS family_size,
  count(*) FILTER (fdr_significant) AS n_significant FROM coll GROUP BY ALL""")
def family_sizes(spark, d):
    return co.family_sizes(bd.basket_table(spark, d))


@query("direction_ratio", f"""
WITH {bd.BASKET_COLL} SELECT variant, item_type, item_a, item_b, direction,
  CASE WHEN expected > 0 THEN round(n_ab / expected, 4) END AS ratio, n_ab - n_ab_first_instance AS non_phrase,
  coalesce(top_share >= 0.5, false) AS concentrated FROM coll""")
def direction_ratio(spark, d):
    ab, exp = F.col("n_ab"), F.col("expected")
    return bd.basket_table(spark, d).select(
        "variant", "item_type", "item_a", "item_b", st.direction(ab, exp).alias("direction"),
        F.round(st.ratio(ab, exp), 4).alias("ratio"), (ab - F.col("n_ab_first_instance")).alias("non_phrase"),
        st.concentrated(F.col("top_share")).alias("concentrated"))


@query("round_stats", f"""
WITH {bd.BASKET_COLL} SELECT variant, item_type, item_a, item_b, round(expected, 2) AS expected, round(n_ab / expected, 1) AS ratio,
  round(pmi, 2) AS pmi, round(g2, 1) AS g2, round(top_share, 3) AS top_share FROM coll WHERE n_ab > 0""")
def round_stats(spark, d):
    return bd.basket_table(spark, d).where("n_ab > 0").select(
        "variant", "item_type", "item_a", "item_b", F.round("expected", 2).alias("expected"),
        F.round(st.ratio(F.col("n_ab"), F.col("expected")), 1).alias("ratio"), F.round("pmi", 2).alias("pmi"),
        F.round("g2", 1).alias("g2"), F.round("top_share", 3).alias("top_share"))


_FULL = """SELECT item_type, variant, item_a, item_b, n_a, n_b, n_ab, n_ab_first_instance, n_total, n_scope,
  round(expected, 5) AS expected, round(pmi, 6) AS pmi, round(g2, 5) AS g2, round(p, 6) AS p, in_family, fdr_significant,
  CAST(top_section AS VARCHAR) AS top_section, round(top_share, 6) AS top_share FROM coll"""


def _full(table):
    return table.select(
        *_COUNT_COLUMNS, "n_ab_first_instance", "n_total", "n_scope", F.round("expected", 5).alias("expected"),
        F.round("pmi", 6).alias("pmi"), F.round("g2", 5).alias("g2"), F.round("p", 6).alias("p"), "in_family",
        "fdr_significant", F.col("top_section").cast("string").alias("top_section"), F.round("top_share", 6).alias("top_share"))


@query("collocation_baskets", f"WITH {bd.BASKET_COLL} {_FULL}")
def collocation_baskets(spark, d):
    return _full(bd.basket_table(spark, d))


@query("collocation_lines", f"""
WITH {bd.pair_table_sql(LINE_SETS)}
SELECT variant, item_type, item_a AS item, count(*) AS n_partners, CAST(sum(n_ab) AS BIGINT) AS n_ab,
  CAST(sum(n_ab_first_instance) AS BIGINT) AS n_first, count(*) FILTER (in_family) AS n_family,
  count(*) FILTER (fdr_significant) AS n_significant, CAST(sum(n_a * n_b) AS BIGINT) AS sum_ab, round(max(g2), 4) AS max_g2,
  round(min(p), 6) AS min_p, round(sum(p), 3) AS sum_p, CAST(sum(round(top_share * n_ab)) AS BIGINT) AS sum_top,
  max(top_section) AS last_section, min(n_total) AS n_total, min(n_scope) AS n_scope FROM coll GROUP BY variant, item_type, item_a""")
def collocation_lines(spark, d):
    """The whole pair table of the document lines, folded per first item."""
    return bd.line_table(spark, d).select(
        "variant", "item_type", "item", "n_partners", "n_ab", "n_first", "n_family", "n_significant", "sum_ab",
        F.round("max_g2", 4).alias("max_g2"), F.round("min_p", 6).alias("min_p"), F.round("sum_p", 3).alias("sum_p"),
        "sum_top", "last_section", "n_total", "n_scope")


def dispersion_sql(sets: str) -> str:
    return sets + """,
counts AS (SELECT 'raw' AS variant, item_type, item, section, count(*) AS c, min(unit_id) AS u FROM sets GROUP BY ALL
  UNION ALL SELECT 'phrase_reduced', item_type, item, section, count(*), min(unit_id) FROM sets WHERE in_reduced GROUP BY ALL),
weights AS (SELECT variant, item_type, section, sum(c) AS w FROM counts GROUP BY ALL),
whole AS (SELECT variant, item_type, sum(w) AS total_w, count(*) AS k FROM weights GROUP BY ALL),
items AS (SELECT variant, item_type, item, sum(c) AS t, first(section ORDER BY c DESC, u) AS top_section, max(c) AS top_n
  FROM counts GROUP BY ALL HAVING sum(c) >= 5),
grid AS (SELECT i.*, w.section, w.w, coalesce(c.c, 0) / i.t AS obs, w.w / h.total_w AS exp, h.k
  FROM items i JOIN weights w USING (variant, item_type) JOIN whole h USING (variant, item_type)
  LEFT JOIN counts c ON c.variant = i.variant AND c.item_type = i.item_type AND c.item = i.item AND c.section = w.section),
disp AS (SELECT variant, item_type, item, CAST(min(t) AS BIGINT) AS n_units,
  CASE WHEN min(k) > 1 THEN greatest(0.0, 1 - sqrt(sum((obs - 1 / k) * (obs - 1 / k)) / min(k)) * min(k) / sqrt(min(k) - 1)) END AS juilland_d,
  0.5 * sum(abs(obs - exp)) AS dp, min(top_section) AS top_section, min(top_n) / min(t) AS top_share
  FROM grid GROUP BY variant, item_type, item)"""


_DISP = """SELECT variant, item_type, item, n_units, round(juilland_d, 6) AS juilland_d, round(dp, 6) AS dp,
  CAST(top_section AS VARCHAR) AS top_section, round(top_share, 6) AS top_share FROM disp"""


def _disp(table):
    return table.select("variant", "item_type", "item", "n_units", F.round("juilland_d", 6).alias("juilland_d"),
                        F.round("dp", 6).alias("dp"), F.col("top_section").cast("string").alias("top_section"),
                        F.round("top_share", 6).alias("top_share"))


@query("section_weights", f"""
WITH {dispersion_sql(bd.BASKET_SETS2)} SELECT variant, item_type, section, CAST(w AS BIGINT) AS weight,
  CAST(total_w AS BIGINT) AS total_weight, k FROM weights JOIN whole USING (variant, item_type)""")
def section_weights(spark, d):
    return di.section_weights(di.item_sections(bd.basket_sets(spark, d)))


@query("dispersion_baskets", f"WITH {dispersion_sql(bd.BASKET_SETS2)} {_DISP}")
def dispersion_baskets(spark, d):
    return _disp(bd.basket_dispersion(spark, d))


@query("dispersion_lines", f"WITH {dispersion_sql(LINE_SETS)} {_DISP}")
def dispersion_lines(spark, d):
    return _disp(di.dispersion_table(bd.line_sets(spark, d)))
