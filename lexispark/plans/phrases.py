"""Queries over repeated phrases of the document lines."""

from __future__ import annotations

from lexispark.operators import cooccurrence as co
from lexispark.operators import phrases as ph
from lexispark.plans.registry import LINE_SETS, PHRASES, query
from lexispark.session import settle
from lexispark.sources.adapters import line_tokens, line_units


def occurrences(spark, d):
    return ph.phrase_occurrences(line_units(spark, d))


def _grams(spark, d):
    tokens = line_tokens(spark, d)
    return ph.final_ngrams(ph.unit_tails(tokens, ph.unit_lengths(tokens)))


@query("full_unit_repeats", f"""
WITH {PHRASES} SELECT pattern, CAST(word_count AS BIGINT) AS word_count, unit_id, start_pos, CAST(end_pos AS BIGINT) AS end_pos, is_first FROM full_occ""")
def full_unit_repeats(spark, d):
    lengths = ph.unit_lengths(line_tokens(spark, d))
    return ph.full_unit_repeats(line_units(spark, d), lengths).select(
        "pattern", "word_count", "unit_id", "start_pos", "end_pos", "is_first")


@query("final_ngrams", f"WITH {PHRASES} SELECT unit_id, n, pattern, start_pos, end_pos FROM grams")
def final_ngrams(spark, d):
    return _grams(spark, d)


@query("qualifying_patterns", f"WITH {PHRASES} SELECT n, pattern, n_units FROM qualifying")
def qualifying_patterns(spark, d):
    return ph.qualifying_patterns(_grams(spark, d))


@query("longest_match_assign", f"WITH {PHRASES} SELECT unit_id, n, pattern, start_pos, end_pos FROM assigned")
def longest_match_assign(spark, d):
    grams = _grams(spark, d)
    return ph.longest_assignment(grams, ph.qualifying_patterns(grams))


@query("phrase_table", f"""
WITH {PHRASES}
SELECT kind, pattern, CAST(word_count AS BIGINT) AS word_count, count(*) AS occurrence_count, min(unit_id) AS first_unit
FROM (SELECT o.*, CASE WHEN kind = 'full_unit' THEN u.text_norm ELSE pattern END AS identity FROM occ o JOIN units u USING (unit_id))
GROUP BY kind, pattern, word_count, identity""")
def phrase_table(spark, d):
    return ph.phrase_table(occurrences(spark, d)).drop("phrase_id")


@query("phrase_occurrences", f"""
WITH {PHRASES} SELECT kind, pattern, CAST(word_count AS BIGINT) AS word_count, unit_id, start_pos,
  CAST(end_pos AS BIGINT) AS end_pos, is_first FROM occ""")
def phrase_occurrences(spark, d):
    return occurrences(spark, d).drop("phrase_id")


@query("masked_ranges", f"WITH {PHRASES} SELECT unit_id, start_pos, CAST(end_pos AS BIGINT) AS end_pos FROM ranges")
def masked_ranges(spark, d):
    return ph.masked_ranges(occurrences(spark, d))


@query("first_instance_units", f"WITH {PHRASES} SELECT unit_id FROM firsts")
def first_instance_units(spark, d):
    return ph.first_instance_units(occurrences(spark, d))


@query("first_instance_conflicts", f"""
WITH {PHRASES}, per_unit AS (SELECT unit_id, bool_or(is_first) AS f, bool_or(NOT is_first) AS m FROM occ GROUP BY unit_id)
SELECT count(*) AS claimed, count(*) FILTER (m) AS conflicts FROM per_unit WHERE f""")
def first_instance_conflicts(spark, d):
    return ph.first_instance_conflicts(occurrences(spark, d))


@query("mask_ranges", f"""
WITH {LINE_SETS} SELECT unit_id, pos, norm FROM flagged WHERE kept""")
def mask_ranges(spark, d):
    ranges = settle(ph.masked_ranges(occurrences(spark, d)))
    return co.mask_ranges(line_tokens(spark, d), ranges).select("unit_id", "pos", "norm")


@query("unit_scopes", f"""
WITH {LINE_SETS}, per_unit AS (SELECT unit_id, bool_or(kept) AS kept FROM flagged GROUP BY unit_id)
SELECT 'raw' AS variant, count(*) AS n_scope FROM per_unit
UNION ALL SELECT 'phrase_reduced', count(*) FILTER (kept) FROM per_unit""")
def unit_scopes(spark, d):
    ranges = settle(ph.masked_ranges(occurrences(spark, d)))
    return co.unit_scopes(co.flag_masked(line_tokens(spark, d), ranges))
