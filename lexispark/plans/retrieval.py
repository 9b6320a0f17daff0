"""Queries for layered retrieval, lookups and the statistics view."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import cooccurrence as co
from lexispark.operators import dispersion as di
from lexispark.operators import publish as pu
from lexispark.operators import retrieval as rt
from lexispark.operators import spans as sp
from lexispark.operators import statistics_view as sv
from lexispark.plans import builds as bd
from lexispark.plans.load import LETTERS_SQL, letter_dictionary, spaced_tokens
from lexispark.plans.pairs import dispersion_sql
from lexispark.plans.registry import LINE_SETS, TOKENS, query
from lexispark.plans.spans import ROWS_IN_LINE, SPANS, annotations
from lexispark.session import with_global_rank
from lexispark.sources.adapters import (
    basket_tokens, line_tasks, line_tokens, line_units, lines_by_unit, table, tokens_by_unit)

# ---- labels, occurrences, layers ----------------------------------------------------------------


def _labels(spark, d):
    """Document labels; a toxic one is out of force, and documents of poor quality stand for test data."""
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("unit_id"), F.concat(F.lit("q"), F.col("quality")).alias("label"),
        (F.col("toxic") == 0).alias("is_current"), (F.col("quality") == 0).alias("is_test"))


@query("current_label", """
SELECT d.doc_id AS unit_id, 'q' || quality AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND toxic = 0 AND quality <> 0""")
def current_label(spark, d):
    units = table(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("unit_id"))
    return units.join(rt.current_labels(_labels(spark, d)), "unit_id", "left")


@query("current_label_with_test", """
SELECT d.doc_id AS unit_id, 'q' || quality AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND toxic = 0""")
def current_label_with_test(spark, d):
    units = table(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("unit_id"))
    return units.join(rt.current_labels(_labels(spark, d), include_test=True), "unit_id", "left")


@query("occurrences_by_item", f"""
WITH {TOKENS}
SELECT t.unit_id, t.pos, t.lemma, t.root, t.section || ':' || t.unit_id || ':' || t.pos AS ref, 'q' || quality AS label, 1 AS layer
FROM tokens t JOIN units u USING (unit_id) LEFT JOIN labels l ON l.doc_id = u.doc_id AND toxic = 0 AND quality <> 0 WHERE length(root) = 3""")
def occurrences_by_item(spark, d):
    tokens = line_tokens(spark, d)
    items = tokens.where(F.char_length("root") == 3).select("root").distinct()
    units = line_units(spark, d).select("unit_id", F.col("doc_id").alias("doc"))
    labels = rt.current_labels(_labels(spark, d)).withColumnRenamed("unit_id", "doc")
    hits = rt.occurrences_by_item(tokens, items, units).join(labels, "doc", "left")
    return rt.with_ref(hits, "section", "unit_id", "pos").select("unit_id", "pos", "lemma", "root", "ref", "label", "layer")


def _customers(spark, d):
    """Customers as tokens of their own unit: root = nation name, lemma = market segment."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("token_id"), F.col("c_custkey").alias("unit_id"), "c_acctbal",
                       F.col("n_name").alias("root"), F.col("c_mktsegment").alias("lemma"), F.col("c_name").alias("norm"))


def _members(spark, d):
    """Nations belong to their region's field; so does one market segment per region (in name order)."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    roots = nations.select(F.col("r_name").alias("field_id"), F.lit("root").alias("member_type"), F.col("n_name").alias("item"),
                           F.when(F.col("n_nationkey") < 20, "confirmed").otherwise("proposed").alias("status"))
    segments = with_global_rank(table(spark, d, "customer", "c_mktsegment").distinct(), [F.col("c_mktsegment")], "k")
    lemmas = segments.join(table(spark, d, "region"), F.col("k") == F.col("r_regionkey") + 1).select(
        F.col("r_name").alias("field_id"), F.lit("lemma").alias("member_type"), F.col("c_mktsegment").alias("item"),
        F.when(F.col("r_regionkey") < 3, "confirmed").otherwise("proposed").alias("status"))
    return roots.unionByName(lemmas)


_FIELDS = """
customers AS (SELECT c_custkey AS token_id, c_custkey AS unit_id, n_name AS root, c_mktsegment AS lemma
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
members AS (SELECT r_name AS field_id, 'root' AS member_type, n_name AS item FROM nation JOIN region ON n_regionkey = r_regionkey
    WHERE n_nationkey < 20
  UNION ALL SELECT r_name, 'lemma', seg FROM (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS k FROM (
    SELECT DISTINCT c_mktsegment AS seg FROM customer)) JOIN region ON k = r_regionkey WHERE r_regionkey < 3),
siblings AS (SELECT DISTINCT o.item AS of_item, s.member_type, s.item FROM members o JOIN members s USING (field_id)
  WHERE o.member_type = 'root' AND NOT (s.member_type = 'root' AND s.item = o.item)),
layer2 AS (SELECT DISTINCT of_item, token_id, unit_id FROM customers JOIN siblings
  ON (member_type = 'root' AND item = root) OR (member_type = 'lemma' AND item = lemma))"""


@query("occurrences_by_field", f"WITH {_FIELDS} SELECT of_item, token_id, unit_id, 2 AS layer FROM layer2")
def occurrences_by_field(spark, d):
    items = table(spark, d, "nation").select(F.col("n_name").alias("item"))
    return rt.occurrences_by_field(_customers(spark, d), _members(spark, d), items)


def _edges(spark, d):
    """Consecutive orders link their customers; finished orders count as confirmed."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    after = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("b"))
    return orders.join(after, "o_orderkey").select(
        F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("a"), "b", F.col("o_orderpriority").alias("relation"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("proposed").alias("status"))


_EDGES = """
edges AS (SELECT x.o_orderkey AS edge_id, x.o_custkey AS a, y.o_custkey AS b, x.o_orderpriority AS relation
  FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 1 WHERE x.o_orderstatus = 'F'),
chosen AS (SELECT c_custkey AS unit_id FROM customer WHERE c_mktsegment = 'BUILDING'),
layer3 AS (SELECT edge_id, relation, CASE WHEN a IN (SELECT unit_id FROM chosen) THEN b ELSE a END AS unit_id FROM edges
  WHERE a IN (SELECT unit_id FROM chosen) OR b IN (SELECT unit_id FROM chosen))"""


def _chosen(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("unit_id"))


@query("related_units", f"WITH {_EDGES} SELECT edge_id, relation, unit_id, 3 AS layer FROM layer3")
def related_units(spark, d):
    return rt.related_units(_edges(spark, d), _chosen(spark, d))


@query("union_layers", f"""
WITH {_FIELDS}, {_EDGES}
SELECT unit_id, min(layer) AS layer FROM (SELECT unit_id, 1 AS layer FROM chosen
  UNION ALL SELECT unit_id, 2 FROM layer2 WHERE of_item = 'NATION_1' UNION ALL SELECT unit_id, 3 FROM layer3) GROUP BY unit_id""")
def union_layers(spark, d):
    first = _chosen(spark, d).withColumn("layer", F.lit(1))
    item = table(spark, d, "nation").where("n_name = 'NATION_1'").select(F.col("n_name").alias("item"))
    second = rt.occurrences_by_field(_customers(spark, d), _members(spark, d), item)
    return rt.union_layers(first, second, rt.related_units(_edges(spark, d), _chosen(spark, d)))


_LAYERS = f"""{_FIELDS}, {_EDGES},
ends AS (SELECT c.root AS item, edge_id, 0 AS turn, b AS unit_id FROM edges JOIN customers c ON c.unit_id = a
  UNION ALL SELECT c.root, edge_id, 1, a FROM edges JOIN customers c ON c.unit_id = b),
layers AS (SELECT root AS item, 1 AS layer, unit_id, token_id AS ref_id FROM customers
  UNION ALL SELECT of_item, 2, unit_id, token_id FROM layer2
  UNION ALL SELECT item, 3, arg_min(unit_id, (turn, unit_id)), edge_id FROM ends GROUP BY item, edge_id)"""


def _layers(spark, d):
    items = table(spark, d, "nation").select(F.col("n_name").alias("item"))
    return rt.item_layers(_customers(spark, d), _members(spark, d), _edges(spark, d), items)


@query("union_layers_many", f"WITH {_LAYERS} SELECT item, unit_id, min(layer) AS layer FROM layers GROUP BY item, unit_id")
def union_layers_many(spark, d):
    """The units of all nations at once, each with the lowest layer that found it."""
    return rt.units_of_layers(_layers(spark, d))


@query("preview_top", """
SELECT c_nationkey, c_custkey, CAST(row_number() OVER w AS INTEGER) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS total
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) QUALIFY rank <= 20""")
def preview_top(spark, d):
    rows = table(spark, d, "customer", "c_nationkey", "c_custkey", "c_acctbal")
    return rt.preview_top(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")]).drop("c_acctbal")


@query("semi_fetch", f"""
WITH {_EDGES} SELECT c_custkey AS unit_id, c_name FROM customer WHERE c_custkey IN (SELECT unit_id FROM layer3)""")
def semi_fetch(spark, d):
    units = table(spark, d, "customer", "c_custkey", "c_name").withColumnRenamed("c_custkey", "unit_id")
    return rt.semi_fetch(units, rt.related_units(_edges(spark, d), _chosen(spark, d)))


@query("empty_retrievals", """
SELECT c_custkey AS unit_id, 'no units retrieved' AS reason FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def empty_retrievals(spark, d):
    requests = table(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "unit_id")
    found = table(spark, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("unit_id"))
    return rt.empty_retrievals(requests, found, "unit_id")


# ---- profiles -----------------------------------------------------------------------------------


def _featured(tokens):
    """Tokens with two features: the ending, and long or short."""
    ending = F.concat(F.lit("end:"), F.substring("norm", -2, 2))
    length = F.when(F.char_length("norm") > 6, "long").otherwise("short")
    return tokens.withColumn("features", F.array(length, ending)).withColumn("tag", length)


_FEATURED = """
featured AS (SELECT *, list_sort([CASE WHEN length(norm) > 6 THEN 'long' ELSE 'short' END, 'end:' || right(norm, 2)]) AS features,
  CASE WHEN length(norm) > 6 THEN 'long' ELSE 'short' END AS tag FROM flagged)"""


@query("surviving_tokens", f"""
WITH {LINE_SETS} SELECT lemma, count(*) AS n_tokens, min(unit_id) AS first_unit FROM flagged WHERE kept GROUP BY lemma""")
def surviving_tokens(spark, d):
    left = rt.surviving_tokens(line_tokens(spark, d), bd.line_occurrences(spark, d))
    return left.groupBy("lemma").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("unit_id").alias("first_unit"))


@query("profile_counts", f"""
WITH {LINE_SETS}, {_FEATURED}
SELECT 'raw' AS variant, root, count(DISTINCT (norm, features)) AS profiles, count(DISTINCT unit_id) AS n_units FROM featured GROUP BY root
UNION ALL SELECT 'phrase_reduced', root, count(DISTINCT (norm, features)), count(DISTINCT unit_id) FROM featured WHERE kept GROUP BY root""")
def profile_counts(spark, d):
    tokens = _featured(tokens_by_unit(spark, d))
    reduced = rt.surviving_tokens(tokens, bd.line_occurrences(spark, d))
    return rt.profile_counts(tokens, ["root"]).withColumn("variant", F.lit("raw")).unionByName(
        rt.profile_counts(reduced, ["root"]).withColumn("variant", F.lit("phrase_reduced")))


@query("morphology_profiles", f"""
WITH {LINE_SETS}, {_FEATURED} SELECT DISTINCT root, tag, array_to_string(features, ',') AS features FROM featured""")
def morphology_profiles(spark, d):
    rows = rt.morphology_profiles(_featured(line_tokens(spark, d)), "root")
    return rows.select("root", "tag", F.array_join(F.array_sort("features"), ",").alias("features"))


# ---- texts, bundles, examples -------------------------------------------------------------------


def _texts(spark, d):
    return table(spark, d, "documents", "doc_id", "source", "lang", "n_chars").select(
        F.col("source").alias("section"), "lang", F.col("doc_id").alias("source_id"), "n_chars")


_PREFERRED = """
preferred AS (SELECT source AS section, doc_id AS source_id, lang, n_chars FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang <> 'fr', doc_id) = 1)"""


@query("preferred_language", f"WITH {_PREFERRED} SELECT section, source_id, lang, n_chars FROM preferred")
def preferred_language(spark, d):
    return rt.preferred_language(_texts(spark, d), "section", "fr", ["source_id", "lang", "n_chars"])


@query("unit_bundle", f"""
WITH {SPANS}, {_PREFERRED},
seg AS (SELECT token_id, string_agg(rule || ':' || seg_start || ':' || seg_end || ':' || is_start || ':' || is_end, ',' ORDER BY seg_start, seg_end, rule, group_id)
  AS segments FROM pieces GROUP BY token_id)
SELECT u.unit_id, 'q' || quality AS label, p.source_id AS text_source, pos, form, 'gloss of ' || form AS gloss, coalesce(segments, '') AS segments
FROM units u LEFT JOIN labels l ON l.doc_id = u.doc_id AND toxic = 0 AND quality <> 0
LEFT JOIN preferred p ON p.section = u.section LEFT JOIN toks t ON t.unit_id = u.unit_id LEFT JOIN seg USING (token_id)""")
def unit_bundle(spark, d):
    lines = line_units(spark, d)
    units = lines_by_unit(spark, d, ROWS_IN_LINE).select("unit_id", "text")
    tokens = spaced_tokens(units)
    kept = sp.guarded_annotations(annotations(units), units, tokens)
    segments = sp.segments_per_token(sp.project_spans(kept, sp.token_offsets(tokens)))
    glosses = tokens.select("unit_id", "token_id", F.concat(F.lit("gloss of "), "form").alias("gloss"))
    per_unit = lines.select("unit_id", "section", F.col("doc_id").alias("doc"))
    labels = per_unit.join(rt.current_labels(_labels(spark, d)).withColumnRenamed("unit_id", "doc"), "doc").select("unit_id", "label")
    texts = per_unit.join(preferred_language(spark, d), "section").select("unit_id", F.col("source_id").alias("text_source"))
    bundle = rt.unit_bundle(units.select("unit_id"), tokens, labels, texts, glosses, segments,
                            tasks=line_tasks(spark, d, ROWS_IN_LINE))
    rows = bundle.select("unit_id", "label", "text_source", F.inline_outer("tokens"))
    shown = F.transform("segments", lambda s: F.concat_ws(
        ":", s["rule"], s["seg_start"].cast("string"), s["seg_end"].cast("string"), s["is_start"].cast("string"), s["is_end"].cast("string")))
    return rows.select("unit_id", "label", "text_source", F.col("pos").cast("long").alias("pos"), "form", "gloss",
                       F.coalesce(F.array_join(shown, ","), F.lit("")).alias("segments"))


@query("resolve_examples", r"""
WITH ex AS (SELECT doc_id, row_number() OVER (ORDER BY toxic DESC, nullif(doc_id % 5, 0) NULLS FIRST, doc_id) AS number
  FROM labels WHERE quality = 1),
refs AS (SELECT number, doc_id, 'a' AS side, unnest([1, 2, 3]) AS seq FROM ex UNION ALL SELECT number, doc_id, 'b', 2 FROM ex),
lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents)
SELECT number, doc_id AS example_id, side, CAST(seq AS INTEGER) AS seq, length(line) AS n_chars, lang FROM refs JOIN lines USING (doc_id, seq)""")
def resolve_examples(spark, d):
    key = F.col("doc_id")
    examples = table(spark, d, "labels").select(
        key.alias("example_id"), (F.col("quality") == 1).alias("is_current"), (F.col("toxic") == 1).alias("is_locked"),
        F.nullif(key % 5, F.lit(0)).alias("sort_order"),
        F.concat(key, F.lit(":1-3")).alias("ref_a"), F.concat(key, F.lit(":2")).alias("ref_b"))
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    units = docs.select(key.alias("section"), F.posexplode(F.split("text", "\n")).alias("i", "line")).select(
        "section", (F.col("i") + 1).alias("seq"), F.struct("section", "i").alias("unit_id"),
        F.char_length("line").cast("long").alias("n_chars"))
    texts = units.select("unit_id", F.col("section").alias("doc_id")).join(docs.select("doc_id", "lang"), "doc_id").select("unit_id", "lang")
    return rt.resolve_examples(examples, units, texts).select("number", "example_id", "side", "seq", "n_chars", "lang")


@query("tag_vs_substring", f"""
WITH {TOKENS}, x AS (SELECT (SELECT count(DISTINCT unit_id) FROM tokens WHERE lemma = 'the') AS by_item,
  (SELECT count(*) FROM units WHERE contains(text_norm, 'the')) AS by_substring)
SELECT by_item, by_substring, by_item <> by_substring AS differs FROM x""")
def tag_vs_substring(spark, d):
    return rt.tag_vs_substring(line_tokens(spark, d), line_units(spark, d), "lemma", "the")


# ---- the statistics view ------------------------------------------------------------------------

def view_sql(coll: str) -> str:
    """CTEs up to ``shown``: a pair table seen from single items, the five strongest partners and the changed ones."""
    return f"""{coll},
view AS (SELECT *, item_a AS item, item_b AS partner FROM coll UNION ALL SELECT *, item_b, item_a FROM coll),
changed AS (SELECT r.item_type, r.item, r.partner FROM view r JOIN view f USING (item_type, item, partner)
  WHERE r.variant = 'raw' AND f.variant = 'phrase_reduced' AND (r.fdr_significant <> f.fdr_significant OR r.direction <> f.direction)),
marked AS (SELECT v.*, c.item IS NOT NULL AS status_changed, row_number() OVER (
    PARTITION BY v.item_type, v.variant, v.item ORDER BY round(g2, 9) DESC, v.partner) AS rank FROM view v LEFT JOIN changed c USING (item_type, item, partner)),
shown AS (SELECT * FROM marked WHERE rank <= 5 OR status_changed)"""


_VIEW = view_sql(bd.BASKET_COLL)


def _view(spark, d):
    return sv.with_direction(sv.partner_view(bd.basket_table(spark, d).withColumn("g2", F.round("g2", 9))))


@query("partner_view", f"WITH {_VIEW} SELECT variant, item_type, item, partner, n_ab, direction FROM view")
def partner_view(spark, d):
    return _view(spark, d).select("variant", "item_type", "item", "partner", "n_ab", "direction")


@query("status_changed", f"WITH {_VIEW} SELECT item_type, item, partner FROM changed")
def status_changed(spark, d):
    return sv.status_changes(_view(spark, d))


@query("top_n_forced", f"""
WITH {_VIEW} SELECT variant, item_type, item, partner, CASE WHEN rank <= 5 THEN CAST(rank AS INTEGER) END AS rank, status_changed FROM shown""")
def top_n_forced(spark, d):
    return sv.top_n_forced(_view(spark, d), 5).select("variant", "item_type", "item", "partner", "rank", "status_changed")


@query("shown_total", f"""
WITH {_VIEW} SELECT variant, item_type, item, count(*) AS total, count(*) FILTER (rank <= 5 OR status_changed) AS shown FROM marked GROUP BY ALL""")
def shown_total(spark, d):
    view = _view(spark, d)
    return sv.shown_total(view, sv.top_n_forced(view, 5))


_PRESENTED = """variant, item_type, item, partner, n_ab,
  CASE WHEN variant <> 'raw' THEN n_ab_first_instance END AS n_ab_first_instance,
  CASE WHEN variant <> 'raw' THEN n_ab - n_ab_first_instance END AS n_ab_non_phrase, round(expected, 2) AS expected,
  CASE WHEN expected > 0 THEN round(n_ab / expected, 1) END AS ratio, round(pmi, 2) AS pmi, round(g2, 1) AS g2, direction, fdr_significant,
  CAST(top_section AS VARCHAR) AS top_section, round(top_share, 3) AS top_share, coalesce(top_share >= 0.5, false) AS concentration_warning,
  status_changed"""


@query("item_statistics", f"WITH {_VIEW} SELECT {_PRESENTED} FROM shown")
def item_statistics(spark, d):
    rows = sv.presented(sv.top_n_forced(_view(spark, d), 5))
    return rows.withColumn("top_section", F.col("top_section").cast("string"))


@query("finding_class", f"""
WITH {_VIEW}, paired AS (SELECT m.*, o.fdr_significant AS other FROM marked m LEFT JOIN view o
  ON o.item_type = m.item_type AND o.item = m.item AND o.partner = m.partner AND o.variant <> m.variant)
SELECT variant, item_type, item, partner, CASE
  WHEN status_changed AND fdr_significant AND NOT other THEN 'flip_lost'
  WHEN status_changed AND NOT fdr_significant AND other THEN 'flip_gained'
  WHEN status_changed AND other IS NOT NULL THEN 'flip_direction'
  WHEN direction = 'avoidance' THEN 'avoidance' WHEN NOT fdr_significant AND expected < 2 THEN 'weak_data'
  WHEN NOT fdr_significant THEN 'not_significant' WHEN top_share >= 0.5 THEN 'significant_concentrated' ELSE 'significant' END AS finding
FROM paired""")
def finding_class(spark, d):
    return sv.finding_classes(_view(spark, d)).select("variant", "item_type", "item", "partner", "finding")


@query("group_by_direction", f"""
WITH {_VIEW} SELECT variant, item_type, item, direction, CASE direction WHEN 'association' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END AS direction_rank,
  count(*) AS n_partners, count(*) FILTER (status_changed) AS n_changed, round(max(g2), 4) AS max_g2 FROM marked GROUP BY ALL""")
def group_by_direction(spark, d):
    return sv.group_by_direction(_view(spark, d)).withColumn("max_g2", F.round("max_g2", 4))


@query("direction_lists", f"""
WITH {_VIEW} SELECT variant, item_type, item, direction, CASE direction WHEN 'association' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END AS direction_rank,
  partner, row_number() OVER (PARTITION BY variant, item_type, item, direction ORDER BY round(g2, 6) DESC, partner) AS place FROM marked""")
def direction_lists(spark, d):
    view = _view(spark, d).withColumn("g2", F.round("g2", 6))
    return sv.direction_lists(view).select("variant", "item_type", "item", "direction", "direction_rank", "partner", "place")


@query("variant_compare", f"""
WITH {bd.BASKET_COLL}, r AS (SELECT * FROM coll WHERE variant = 'raw'), f AS (SELECT * FROM coll WHERE variant <> 'raw')
SELECT item_type, item_a, item_b, r.n_ab AS n_ab_raw, round(r.expected, 5) AS expected_raw, round(r.g2, 4) AS g2_raw, r.fdr_significant AS sig_raw,
  f.n_ab AS n_ab_reduced, round(f.expected, 5) AS expected_reduced, round(f.g2, 4) AS g2_reduced, f.fdr_significant AS sig_reduced
FROM r FULL JOIN f USING (item_type, item_a, item_b)""")
def variant_compare(spark, d):
    rows = sv.variant_compare(bd.basket_table(spark, d))
    return rows.select("item_type", "item_a", "item_b", *[
        c for s in ("raw", "reduced") for c in (
            F.col(f"n_ab_{s}"), F.round(f"expected_{s}", 5).alias(f"expected_{s}"), F.round(f"g2_{s}", 4).alias(f"g2_{s}"),
            F.col(f"fdr_significant_{s}").alias(f"sig_{s}"))])


ELEMENTS = """variant, item_type, item, total, shown_n AS shown, partner, n_ab, direction, fdr_significant, status_changed, round(g2, 1) AS g2,
  n_units, round(juilland_d, 3) AS juilland_d, round(dp, 3) AS dp, profiles, profile_units"""


def elements_sql(coll: str, profiles: str) -> str:
    """CTEs up to ``elements``: the nested item view of a pair table, one row per shown partner.

    ``profiles`` is a query for variant, item_type, item, profiles and profile_units.
    """
    return dispersion_sql(view_sql(coll)) + f""",
profs AS ({profiles}),
sizes AS (SELECT variant, item_type, item, count(*) AS total, count(*) FILTER (rank <= 5 OR status_changed) AS shown_n FROM marked GROUP BY ALL),
elements AS (SELECT s.variant, s.item_type, s.item, z.total, z.shown_n, s.partner, s.n_ab, s.direction, s.fdr_significant, s.status_changed, s.g2,
    d.n_units, d.juilland_d, d.dp, p.profiles, p.profile_units
  FROM shown s JOIN sizes z ON z.variant = s.variant AND z.item_type = s.item_type AND z.item = s.item
  LEFT JOIN disp d ON d.variant = 'raw' AND d.item_type = s.item_type AND d.item = s.item
  LEFT JOIN profs p ON p.variant = s.variant AND p.item_type = s.item_type AND p.item = s.item)"""


def elements(nested):
    """The rows of :func:`item_statistics` with one row per partner, rounded."""
    rows = nested.select("variant", "item_type", "item", "total", "shown", "dispersion", "profiles", "profile_units", F.inline("partners"))
    return rows.select(
        "variant", "item_type", "item", "total", "shown", "partner", "n_ab", "direction", "fdr_significant", "status_changed", "g2",
        "dispersion.n_units", "dispersion.juilland_d", "dispersion.dp", "profiles", "profile_units")


def profiles_by_variant(tokens, kept, item_types):
    """Distinct profiles and units per item in both variants; ``kept`` are the tokens that masking leaves."""
    found = None
    for variant, rows in (("raw", tokens), ("phrase_reduced", kept)):
        for item_type in item_types:
            part = rt.profile_counts(rows.where(F.col(item_type).isNotNull() & (F.col(item_type) != "")), [item_type]).select(
                F.lit(variant).alias("variant"), F.lit(item_type).alias("item_type"), F.col(item_type).alias("item"), "profiles",
                F.col("n_units").alias("profile_units"))
            found = part if found is None else found.unionByName(part)
    return found


def _profiled(tokens):
    """Basket lines with a form, their size, and two features."""
    return tokens.withColumn("norm", F.col("size").cast("string")).withColumn("features", F.array(
        F.when(F.col("size") > 25, "large").otherwise("small"), F.concat(F.lit("pos:"), F.col("pos"))))


_BASKET_PROFILES = """
SELECT CASE WHEN v.reduced THEN 'phrase_reduced' ELSE 'raw' END AS variant, x.item_type, CASE x.item_type WHEN 'brand' THEN brand ELSE type END AS item,
  count(DISTINCT (size, size > 25, pos)) AS profiles, count(DISTINCT unit_id) AS profile_units
FROM flagged, (SELECT unnest([false, true]) AS reduced) v, (SELECT unnest(['brand', 'type']) AS item_type) x WHERE kept OR NOT v.reduced GROUP BY ALL"""


@query("item_statistics_nested", f"WITH {elements_sql(bd.BASKET_COLL, _BASKET_PROFILES)} SELECT {ELEMENTS} FROM elements")
def item_statistics_nested(spark, d):
    """One nested row per item of the published build, with dispersion and the profile counts of both variants; here with
    one row per partner, so that every nested value is compared."""
    table_ = bd.basket_table(spark, d).withColumn("build", F.lit(1)).withColumn("g2", F.round("g2", 9))
    tokens = _profiled(basket_tokens(spark, d))
    profiles = profiles_by_variant(tokens, co.mask_ranges(tokens, bd.basket_ranges(spark, d)), ("brand", "type"))
    builds = spark.createDataFrame([(1, True), (2, False)], "build int, is_current boolean")
    return elements(sv.item_statistics(table_, bd.basket_dispersion(spark, d), profiles, builds, 5))


@query("item_dossier", f"""
WITH {_FIELDS}, {LETTERS_SQL},
nation_counts AS (SELECT root, count(*) AS occurrences FROM customers GROUP BY root),
spelled AS (SELECT token_id, count(*) AS n_letters FROM (SELECT c_custkey AS token_id, unnest(string_split(lower(c_name), '')) AS letter
  FROM customer) JOIN letters USING (letter) GROUP BY token_id),
urgent AS (SELECT o_custkey AS token_id, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c.token_id, c.root, coalesce(n_letters, 0) AS n_letters, occurrences, least(coalesce(n, 0), 20) AS n_preview, coalesce(n, 0) AS total
FROM customers c LEFT JOIN spelled USING (token_id) JOIN nation_counts USING (root) LEFT JOIN urgent u ON u.token_id = c.token_id""")
def item_dossier(spark, d):
    tokens = _customers(spark, d).select("token_id", "root", F.lower("norm").alias("norm"))
    counts = tokens.groupBy("root").agg(F.count(F.lit(1)).alias("occurrences"))
    orders = table(spark, d, "orders", "o_custkey", "o_orderkey").select(
        F.col("o_custkey").alias("token_id"), F.col("o_orderkey").alias("unit_id"), F.lit(1).alias("layer"))
    previews = rt.preview_top(orders, ["token_id", "layer"], [F.asc("unit_id")])
    fields = _members(spark, d).where("member_type = 'root'").select(F.col("item").alias("root"), "field_id")
    rows = rt.item_dossier(tokens, letter_dictionary(spark, d), fields, previews, counts)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return rows.select("token_id", "root", size("letters").alias("n_letters"), "occurrences", size("retrieval").alias("n_preview"),
                       F.coalesce(F.col("retrieval")[0]["total"], F.lit(0)).alias("total"))


# ---- the whole dossier of a word ------------------------------------------------------------------


_BUYERS = """
tokens AS (SELECT l_partkey AS unit_id, p_brand AS section, l_orderkey * 8 + l_linenumber AS pos, n_name AS root, c_mktsegment AS lemma,
    o_orderpriority AS norm, l_linestatus AS ending, l_quantity > 25 AS many, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
returned AS (SELECT DISTINCT unit_id, pos FROM tokens WHERE l_returnflag = 'R'),
firsts AS (SELECT unit_id FROM tokens WHERE false),
flagged AS (SELECT t.*, r.unit_id IS NULL AS kept FROM tokens t LEFT JOIN returned r USING (unit_id, pos)),
sets AS (SELECT item_type, unit_id, section, item, bool_or(kept) AS in_reduced FROM (
  SELECT 'root' AS item_type, unit_id, section, root AS item, kept FROM flagged
  UNION ALL SELECT 'lemma', unit_id, section, lemma, kept FROM flagged) WHERE item <> '' GROUP BY ALL)"""

_BUYER_PROFILES = """
SELECT CASE WHEN v.reduced THEN 'phrase_reduced' ELSE 'raw' END AS variant, 'lemma' AS item_type, lemma AS item,
  count(DISTINCT (norm, ending, many)) AS profiles, count(DISTINCT unit_id) AS profile_units
FROM flagged, (SELECT unnest([false, true]) AS reduced) v WHERE kept OR NOT v.reduced GROUP BY ALL"""


def _buyers(spark, d):
    """Parts as units, their buyers as tokens: root = the customer's nation, lemma = the market segment."""
    lines = table(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", "l_returnflag")
    rows = (
        lines.join(table(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")))
    return rows.select(
        F.col("l_partkey").alias("unit_id"), F.col("p_brand").alias("section"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("n_name").alias("root"),
        F.col("c_mktsegment").alias("lemma"), F.col("o_orderpriority").alias("norm"),
        F.array("l_linestatus", F.when(F.col("l_quantity") > 25, "many").otherwise("few")).alias("features"), "l_returnflag")


def _buyer_statistics(spark, d):
    """The nested item views of the published build of the buyers."""
    tokens = bd.stored(spark, d, "buyers", lambda: _buyers(spark, d))
    ranges = tokens.where("l_returnflag = 'R'").select("unit_id", F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"))
    flagged = co.flag_masked(tokens, ranges)
    sets = bd.stored(spark, d, "buyer_sets", lambda: co.item_sets(co.item_occurrences(flagged, {"root": "root", "lemma": "lemma"})))
    built = bd.once(spark, d, "buyer_table", lambda: co.collocations_of(sets, co.unit_scopes(flagged)))
    spread = bd.stored(spark, d, "buyer_dispersion", lambda: di.dispersion_table(sets))
    kept = bd.stored(spark, d, "buyers_kept", lambda: co.mask_ranges(tokens, ranges))
    profiles = profiles_by_variant(tokens, kept, ("lemma",))
    builds = spark.createDataFrame([(1, True)], "build int, is_current boolean")
    table_ = built.withColumn("build", F.lit(1)).withColumn("g2", F.round("g2", 9))
    return sv.item_statistics(table_, spread, profiles, builds, 5)


def _analyses(spark, d):
    """Every order is a version of the analysis of its customer's market segment; finished ones were reviewed."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice").join(
        table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    versions = orders.select(
        F.col("o_orderkey").alias("version"), F.lit("lemma").alias("subject_type"), F.lit(None).cast("long").alias("subject_id"),
        F.col("c_mktsegment").alias("subject_ref"), F.col("o_totalprice").alias("content"))
    log = orders.select(F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("at"),
                        F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("").alias("reason"))
    current = pu.promote_subject(versions, log).where("is_current")
    return current.select(F.col("subject_ref").alias("lemma"), F.struct("version", "content", "promoted_at").alias("analysis"))


def _dossier(spark, d):
    words = _customers(spark, d).select("token_id", "root", "lemma", F.lower("norm").alias("norm"))
    items = table(spark, d, "nation").select(F.col("n_name").alias("item"))
    fields = _members(spark, d).where("member_type = 'root' and status = 'confirmed'").groupBy(F.col("item").alias("root")).agg(
        F.sort_array(F.collect_set("field_id")).alias("fields"))
    statistics = _buyer_statistics(spark, d).where("item_type = 'lemma'")
    by_lemma = statistics.groupBy(F.col("item").alias("lemma")).agg(F.collect_list(F.struct(*statistics.columns)).alias("statistics"))
    return rt.word_dossier(words, letter_dictionary(spark, d), fields, rt.layer_previews(_layers(spark, d), items), by_lemma,
                           _analyses(spark, d))


@query("word_dossier", f"""
WITH {_LAYERS}, {LETTERS_SQL},
ranked AS (SELECT item, layer, unit_id, ref_id, row_number() OVER w AS rank, count(*) OVER (PARTITION BY item, layer) AS total FROM layers
  WINDOW w AS (PARTITION BY item, layer ORDER BY unit_id, ref_id)),
every AS (SELECT n_name AS item, unnest([1, 2, 3]) AS layer FROM nation),
previews AS (SELECT e.item, e.layer, coalesce(total, 0) AS total, rank, unit_id, ref_id
  FROM every e LEFT JOIN ranked r ON r.item = e.item AND r.layer = e.layer AND rank <= 20),
spelled AS (SELECT token_id, string_agg(letter, '' ORDER BY p) AS letters FROM (
  SELECT token_id, unnest(string_split(name, '')) AS letter, generate_subscripts(string_split(name, ''), 1) AS p
  FROM (SELECT c_custkey AS token_id, lower(c_name) AS name FROM customer)) JOIN letters USING (letter) GROUP BY token_id),
current AS (SELECT c_mktsegment AS lemma, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS content
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment)
SELECT c.token_id, c.root, (SELECT string_agg(DISTINCT field_id, ',' ORDER BY field_id) FROM members m WHERE m.member_type = 'root' AND m.item = c.root) AS fields,
  s.letters, layer, total, CAST(rank AS INTEGER) AS rank, p.unit_id, ref_id, version, content
FROM customers c LEFT JOIN spelled s USING (token_id) JOIN previews p ON p.item = c.root LEFT JOIN current ON current.lemma = c.lemma""")
def word_dossier(spark, d):
    """Every customer's dossier with one row per previewed element of each layer."""
    rows = _dossier(spark, d).select(
        "token_id", "root", F.array_join("fields", ",").alias("fields"), F.array_join("letters.letter", "").alias("letters"),
        F.col("analysis.version").alias("version"), F.col("analysis.content").alias("content"), F.inline("retrieval"))
    return rows.select("token_id", "root", "fields", "letters", "version", "content", "layer", "total", F.inline_outer("preview")).select(
        "token_id", "root", "fields", "letters", "layer", "total", "rank", "unit_id", "ref_id", "version", "content")


@query("word_dossier_statistics", f"""
WITH {elements_sql(bd.pair_table_sql(_BUYERS), _BUYER_PROFILES)}
SELECT c_custkey AS token_id, {ELEMENTS} FROM elements JOIN customer ON c_mktsegment = item WHERE item_type = 'lemma'""")
def word_dossier_statistics(spark, d):
    """The statistics in every customer's dossier, one row per shown partner."""
    rows = _dossier(spark, d).select("token_id", F.explode("statistics").alias("s")).select("token_id", "s.*")
    found = rows.select("token_id", "variant", "item_type", "item", "total", "shown", "dispersion", "profiles", "profile_units", F.inline("partners"))
    return found.select(
        "token_id", "variant", "item_type", "item", "total", "shown", "partner", "n_ab", "direction", "fdr_significant", "status_changed",
        "g2", "dispersion.n_units", "dispersion.juilland_d", "dispersion.dp", "profiles", "profile_units")
