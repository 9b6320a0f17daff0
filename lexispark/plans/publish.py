"""Queries for verification, publication and record rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import publish as pu
from lexispark.params import RAW
from lexispark.plans import builds as bd
from lexispark.plans.pairs import dispersion_sql
from lexispark.plans.registry import query
from lexispark.session import spread
from lexispark.sources.adapters import basket_tokens, table

# ---- verification -------------------------------------------------------------------------------


def _checked(spark, d):
    """Each market segment is a build; its customer and balance figures are the observations."""
    rows = table(spark, d, "customer", "c_mktsegment", "c_custkey", "c_acctbal").groupBy(F.col("c_mktsegment").alias("build")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("c_acctbal").alias("mean"))
    observed = rows.select("build", F.inline(F.array(
        F.struct(F.lit("customers").alias("name"), F.col("n").alias("value")),
        F.struct(F.lit("mean_balance").alias("name"), F.col("mean").alias("value")),
        F.struct(F.lit("missing").alias("name"), F.lit(None).cast("double").alias("value")))))
    rules = [("customers", "differs", 0.0, None), ("mean_balance", "equals", 4500.0, 150.0), ("missing", "is_null", None, None)]
    number = lambda v: F.lit(v).cast("double")
    expectations = rows.select("build", F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(rule).alias("rule"), number(want).alias("expected"), number(tol).alias("tolerance"))
        for name, rule, want, tol in rules])))
    return pu.verify(observed, expectations)


_CHECKED = """
obs AS (SELECT c_mktsegment AS build, CAST(count(*) AS DOUBLE) AS n, avg(c_acctbal) AS mean FROM customer GROUP BY 1),
checked AS (SELECT build, 'customers' AS name, CASE WHEN n <> 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM obs
  UNION ALL SELECT build, 'mean_balance', CASE WHEN abs(mean - 4500) < 150 THEN 'PASS' ELSE 'FAIL' END FROM obs
  UNION ALL SELECT build, 'missing', 'PASS' FROM obs),
summary AS (SELECT build, count(*) FILTER (status = 'PASS') AS n_passed, count(*) AS n_checks FROM checked GROUP BY build)"""


@query("verify_build", f"WITH {_CHECKED} SELECT build, name, status FROM checked")
def verify_build(spark, d):
    return _checked(spark, d).select("build", "name", "status")


@query("verification_summary", f"WITH {_CHECKED} SELECT *, n_passed = n_checks AS verified FROM summary")
def verification_summary(spark, d):
    return pu.verification_summary(_checked(spark, d))


_PAIR = ["variant", "item_type", "item_a", "item_b"]


def _brand_margins(spark, d):
    """Orders with a brand, and orders at all, counted from the raw tables and not by the build."""
    sold = basket_tokens(spark, d).select("unit_id", F.col("brand").alias("item")).distinct()
    total = sold.select("unit_id").distinct().agg(F.count(F.lit(1)).alias("n_total"))       # one row
    return sold.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))


def _equals(rows, *columns):
    """Expectations of several columns of one address: (column, expected, tolerance)."""
    number = lambda v: v.cast("double") if hasattr(v, "cast") else F.lit(v).cast("double")
    return F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit("equals").alias("rule"), number(want).alias("expected"), number(tol).alias("tolerance"))
        for c, want, tol in columns]))


@query("verify_built_pairs", f"""
WITH {bd.BASKET_COLL}, sold AS (SELECT DISTINCT unit_id, brand AS item FROM tokens),
m AS (SELECT item, count(*) AS n, (SELECT count(DISTINCT unit_id) FROM sold) AS total FROM sold GROUP BY item),
facts AS (SELECT c.item_a, c.item_b, unnest(['n_a', 'n_b', 'n_total', 'expected', 'p', 'pmi']) AS "column",
    unnest([c.n_a, c.n_b, c.n_total, c.expected, c.p, c.pmi]) AS value,
    unnest([a.n, b.n, a.total, a.n * b.n / a.total, 0.5, 100.0]) AS want, unnest([0.5, 0.5, 0.5, 0.001, 0.5000001, 1.0]) AS tol
  FROM coll c JOIN m a ON a.item = c.item_a JOIN m b ON b.item = c.item_b WHERE c.variant = 'raw' AND c.item_type = 'brand')
SELECT 'raw' AS variant, item_a, item_b, "column", 'equals' AS rule,
  CASE WHEN coalesce(abs(value - want) < tol, false) THEN 'PASS' ELSE 'FAIL' END AS status FROM facts
UNION ALL
SELECT v.variant, f.item_a, f.item_b, x.c, 'is_null', CASE WHEN c.variant IS NOT NULL AND
    CASE x.c WHEN 'pmi' THEN c.pmi IS NULL ELSE c.p IS NULL END THEN 'PASS' ELSE 'FAIL' END
FROM (SELECT DISTINCT item_type, item_a, item_b FROM forced) f, (SELECT unnest(['raw', 'phrase_reduced']) AS variant) v, (SELECT unnest(['pmi', 'p']) AS c) x
LEFT JOIN coll c ON c.variant = v.variant AND c.item_type = f.item_type AND c.item_a = f.item_a AND c.item_b = f.item_b""")
def verify_built_pairs(spark, d):
    """Named assertions on the built pair table: margins and expected counts against counts of the raw tables for every
    pair of brands, the pre-registered pairs that never occur without PMI and p, and one rule that must fail."""
    built = bd.basket_table(spark, d).withColumn("build", F.lit(1))
    margins = _brand_margins(spark, d)
    pairs = built.where((F.col("variant") == RAW) & (F.col("item_type") == "brand")).select(*_PAIR)
    a = margins.select(F.col("item").alias("item_a"), F.col("n").alias("a"), "n_total")
    b = margins.select(F.col("item").alias("item_b"), F.col("n").alias("b"))
    facts = pairs.join(a, "item_a").join(b, "item_b")
    equal = facts.select(*_PAIR, _equals(
        facts, ("n_a", F.col("a"), 0.5), ("n_b", F.col("b"), 0.5), ("n_total", F.col("n_total"), 0.5),
        ("expected", F.col("a") * F.col("b") / F.col("n_total"), 0.001), ("p", 0.5, 0.5000001), ("pmi", 100.0, 1.0)))
    listed = bd.co.canonical_pairs(bd.FORCED, spark)
    nulls = listed.select("item_type", "item_a", "item_b", F.explode(F.array(F.lit(RAW), F.lit("phrase_reduced"))).alias("variant")).select(
        *_PAIR, F.explode(F.array(F.lit("pmi"), F.lit("p"))).alias("column"), F.lit("is_null").alias("rule"),
        F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("tolerance"))
    wanted = equal.unionByName(nulls).withColumn("build", F.lit(1))
    keys = ["build", *_PAIR]
    return pu.verify(pu.observed_values(built, keys, wanted), wanted, [*keys, "column"]).select(
        "variant", "item_a", "item_b", "column", "rule", "status")


@query("verify_built_dispersion", f"""
WITH {dispersion_sql(bd.BASKET_SETS2)}, sold AS (SELECT brand AS item, count(DISTINCT unit_id) AS n FROM tokens GROUP BY brand)
SELECT s.item, x.c AS "column", CASE WHEN coalesce(CASE x.c WHEN 'n_units' THEN abs(d.n_units - s.n) < 0.5 WHEN 'dp' THEN abs(d.dp - 0.5) < 0.5000001
  ELSE abs(d.juilland_d - 0.5) < 0.5000001 END, false) THEN 'PASS' ELSE 'FAIL' END AS status
FROM sold s CROSS JOIN (SELECT unnest(['n_units', 'dp', 'juilland_d']) AS c) x
LEFT JOIN disp d ON d.variant = 'raw' AND d.item_type = 'brand' AND d.item = s.item""")
def verify_built_dispersion(spark, d):
    """The dispersion table of all brands: units against the raw tables, both measures within zero and one."""
    margins = _brand_margins(spark, d)
    wanted = margins.select(F.lit(1).alias("build"), F.lit(RAW).alias("variant"), F.lit("brand").alias("item_type"), "item", _equals(
        margins, ("n_units", F.col("n"), 0.5), ("dp", 0.5, 0.5000001), ("juilland_d", 0.5, 0.5000001)))
    keys = ["build", "variant", "item_type", "item"]
    built = bd.basket_dispersion(spark, d).withColumn("build", F.lit(1))
    return pu.verify(pu.observed_values(built, keys, wanted), wanted, [*keys, "column"]).select("item", "column", "status")


# ---- publication --------------------------------------------------------------------------------


def _requests(spark, d):
    """Orders act as promotion requests for their customer's market segment."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    customers = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("request_id"), F.col("c_mktsegment").alias("build"), F.col("o_orderdate").alias("at"),
        (F.col("o_orderpriority") == "1-URGENT").alias("force"), F.when(F.col("o_orderstatus") == "F", "checked by hand").alias("reason"))


_DECISIONS = f"""{_CHECKED},
decisions AS (SELECT o_orderkey AS request_id, c_mktsegment AS build, o_orderdate AS asked_at, CASE
    WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'force needs a reason'
    WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN n_passed IS NULL THEN 'never verified'
    WHEN n_passed < n_checks THEN 'verification failed' END AS refused
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN summary ON build = c_mktsegment)"""


@query("build_decisions", f"WITH {_DECISIONS} SELECT request_id, build, refused, refused IS NULL AS accepted FROM decisions")
def build_decisions(spark, d):
    return pu.build_decisions(_requests(spark, d), pu.verification_summary(_checked(spark, d))).select(
        "request_id", "build", "refused", "accepted")


def _promoted(spark, d):
    builds = table(spark, d, "customer", "c_mktsegment").select(F.col("c_mktsegment").alias("build")).distinct()
    return pu.promote_build(builds, pu.build_decisions(_requests(spark, d), pu.verification_summary(_checked(spark, d))))


_PROMOTED = f"""{_DECISIONS},
ok AS (SELECT * FROM decisions WHERE refused IS NULL),
promoted AS (SELECT b.build, max(asked_at) AS promoted_at,
    b.build = (SELECT build FROM ok ORDER BY asked_at DESC, request_id DESC LIMIT 1) AS is_current
  FROM (SELECT DISTINCT c_mktsegment AS build FROM customer) b LEFT JOIN ok USING (build) GROUP BY b.build)"""


@query("promote_build", f"WITH {_PROMOTED} SELECT build, promoted_at, coalesce(is_current, false) AS is_current FROM promoted")
def promote_build(spark, d):
    return _promoted(spark, d).select("build", "promoted_at", "is_current")


_HISTORY = f"""{_DECISIONS},
history AS (SELECT row_number() OVER w AS seq, request_id, build, CASE WHEN o_orderstatus = 'F' THEN 'checked by hand' END AS reason,
    asked_at AS valid_from, lead(asked_at) OVER w AS valid_to
  FROM decisions JOIN orders ON o_orderkey = request_id WHERE refused IS NULL WINDOW w AS (ORDER BY asked_at, request_id))"""


def _history(spark, d, times=1):
    log = _requests(spark, d)
    for _ in range(times - 1):
        log = log.unionByName(_requests(spark, d))
    return pu.promotion_history(pu.build_decisions(log, pu.verification_summary(_checked(spark, d))))


@query("promotion_history", f"WITH {_HISTORY} SELECT seq, request_id, build, reason, valid_from, valid_to FROM history")
def promotion_history(spark, d):
    """The log is replayed: every request stands in it twice."""
    return _history(spark, d, times=2)


@query("build_at", f"""
WITH {_HISTORY} SELECT event_id, ts AS moment, build FROM events ASOF LEFT JOIN history ON ts >= valid_from""")
def build_at(spark, d):
    """The build in force when each event happened."""
    events = table(spark, d, "events", "event_id", "ts").withColumnRenamed("ts", "moment")
    found = pu.build_at(_history(spark, d), events.select("moment").distinct())
    return events.join(found, "moment").select("event_id", "moment", "build")


@query("current_version", f"""
WITH {_PROMOTED} SELECT c_custkey, c_mktsegment AS build FROM customer JOIN promoted ON build = c_mktsegment WHERE is_current""")
def current_version(spark, d):
    rows = table(spark, d, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "build")
    return pu.current_rows(rows, _promoted(spark, d)).select("c_custkey", "build")


@query("publication_note", f"""
WITH {_PROMOTED}, sets AS (SELECT 'all' AS kind, build, is_current FROM promoted UNION ALL
  SELECT 'drafts', build, is_current FROM promoted WHERE NOT coalesce(is_current, false)),
winner AS (SELECT kind, max(CASE WHEN is_current THEN build END) AS build FROM sets GROUP BY kind)
SELECT kind, build, CASE WHEN build IS NULL THEN 'no build has been published' END AS note FROM winner""")
def publication_note(spark, d):
    """The note of all builds, one of them published, and of the drafts alone."""
    builds = _promoted(spark, d)
    noted = lambda kind, rows: pu.publication_note(rows).select(F.lit(kind).alias("kind"), "build", "note")
    return noted("all", builds).unionByName(noted("drafts", builds.where("not coalesce(is_current, false)")))


@query("promote_subject", """
WITH v AS (SELECT event_id AS version, event_type AS subject_type, CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS subject_id, props AS subject_ref,
  CASE WHEN value >= 10 THEN ts END AS promoted_at FROM events),
k AS (SELECT *, coalesce(CAST(subject_id AS VARCHAR), 'ref:' || subject_ref) AS subject FROM v)
SELECT version, subject_type, subject, promoted_at, coalesce(version = first_value(CASE WHEN promoted_at IS NOT NULL THEN version END) OVER (
  PARTITION BY subject_type, subject ORDER BY promoted_at DESC NULLS LAST, version DESC), false) AS is_current FROM k""")
def promote_subject(spark, d):
    events = table(spark, d, "events")
    versions = events.select(
        F.col("event_id").alias("version"), F.col("event_type").alias("subject_type"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("subject_id"), F.col("props").alias("subject_ref"))
    log = events.select(F.col("event_id").alias("version"), F.col("ts").alias("at"), F.when(F.col("value") >= 10, "reviewed").otherwise(" ").alias("reason"))
    return pu.promote_subject(versions, log).select("version", "subject_type", "subject", "promoted_at", "is_current")


# ---- records ------------------------------------------------------------------------------------


def _records(spark, d):
    """Orders as hypotheses: some without a parent that exists, some with an unknown verdict."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        key.alias("record_id"), F.concat(F.lit("order of "), F.col("o_totalprice").cast("long"), F.lit(" for "), "o_custkey").alias("statement"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "preregistered").otherwise("exploratory").alias("registration"),
        F.when(status == "F", "defined").alias("definition"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "contradicted").when(F.col("o_orderpriority") == "3-MEDIUM", "insufficient")
        .when(F.col("o_orderpriority") == "5-LOW", "unsure").otherwise("sync").alias("verdict"),
        F.when(status == "O", "more lines").otherwise("").alias("missing_data"),
        F.when(status == "P", key + 7).alias("parent_id"))


_RECORDS = """
records AS (SELECT o_orderkey AS record_id, 'order of ' || CAST(trunc(o_totalprice) AS BIGINT) || ' for ' || o_custkey AS statement,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'preregistered' ELSE 'exploratory' END AS registration,
  CASE WHEN o_orderstatus = 'F' THEN 'defined' END AS definition,
  CASE o_orderpriority WHEN '2-HIGH' THEN 'contradicted' WHEN '3-MEDIUM' THEN 'insufficient' WHEN '5-LOW' THEN 'unsure' ELSE 'sync' END AS verdict,
  CASE WHEN o_orderstatus = 'O' THEN 'more lines' ELSE '' END AS missing_data,
  CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 7 END AS parent_id FROM orders)"""


@query("lineage", f"""
WITH {_RECORDS}, kids AS (SELECT parent_id AS record_id, count(*) AS n_children FROM records WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT r.record_id, r.parent_id, p.statement AS parent_statement, coalesce(n_children, 0) AS n_children
FROM records r LEFT JOIN records p ON p.record_id = r.parent_id LEFT JOIN kids k ON k.record_id = r.record_id""")
def lineage(spark, d):
    return pu.lineage(_records(spark, d)).select("record_id", "parent_id", "parent_statement", "n_children")


@query("lineage_children", f"""
WITH {_RECORDS} SELECT p.record_id, c.record_id AS child_id, c.statement AS child_statement,
  row_number() OVER (PARTITION BY p.record_id ORDER BY c.record_id) AS place FROM records c JOIN records p ON p.record_id = c.parent_id""")
def lineage_children(spark, d):
    return pu.lineage_children(_records(spark, d))


def _verdict_rows(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus").select(
        F.col("l_orderkey").alias("record_id"), F.col("l_shipdate").alias("at"),
        F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("verdict_id"), F.col("l_linestatus").alias("verdict"))


@query("verdict_history", """
SELECT l_orderkey AS record_id, l_linestatus AS verdict, l_partkey, l_suppkey, row_number() OVER (
  PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) AS place FROM lineitem""")
def verdict_history(spark, d):
    return pu.verdict_history(_verdict_rows(spark, d)).select(
        "record_id", "verdict", "verdict_id.l_partkey", "verdict_id.l_suppkey", "place")


@query("evidence_units", """
SELECT l_orderkey AS record_id, CASE WHEN l_returnflag = 'R' THEN 'contradicting' ELSE 'supporting' END AS role, l_partkey AS unit_id, p_name AS unit_text
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 25 WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def evidence_units(spark, d):
    evidence = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").select(
        F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("unit_id"),
        F.when(F.col("l_returnflag") == "R", "contradicting").otherwise("supporting").alias("role"))
    units = table(spark, d, "part", "p_partkey", "p_name", "p_size").where("p_size < 25").select(
        F.col("p_partkey").alias("unit_id"), F.col("p_name").alias("unit_text"))
    return pu.evidence_with_units(_records(spark, d), evidence, units).select("record_id", "role", "unit_id", "unit_text")


@query("latest_verdicts", """
SELECT l_orderkey AS record_id, arg_max(l_linestatus, (l_shipdate, l_partkey, l_suppkey)) AS verdict, count(*) AS n_verdicts
FROM lineitem GROUP BY 1""")
def latest_verdicts(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_partkey", "l_suppkey", "l_linestatus").select(
        F.col("l_orderkey").alias("record_id"), F.col("l_shipdate").alias("at"),
        F.struct("l_partkey", "l_suppkey").alias("verdict_id"), F.col("l_linestatus").alias("verdict"))
    return pu.latest_verdicts(rows)


@query("record_contracts", f"""
WITH {_RECORDS}, contra AS (SELECT DISTINCT l_orderkey AS record_id FROM lineitem WHERE l_returnflag = 'R')
SELECT record_id, 'definition_required' AS rule FROM records WHERE registration = 'preregistered' AND definition IS NULL
UNION ALL SELECT record_id, 'contradicting_evidence_required' FROM records WHERE verdict = 'contradicted' AND record_id NOT IN (SELECT record_id FROM contra)
UNION ALL SELECT record_id, 'missing_data_required' FROM records WHERE verdict = 'insufficient' AND missing_data = ''
UNION ALL SELECT record_id, 'unknown_verdict' FROM records WHERE verdict = 'unsure'
UNION ALL SELECT record_id, 'statement_length' FROM records WHERE length(statement) < 20 OR length(statement) > 2000
UNION ALL SELECT record_id, 'unknown_parent' FROM records WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT record_id FROM records)""")
def record_contracts(spark, d):
    evidence = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").select(
        F.col("l_orderkey").alias("record_id"), F.when(F.col("l_returnflag") == "R", "contradicting").otherwise("supporting").alias("role"))
    orders = table(spark, d, "orders").count()       # both counts are in the footers
    return pu.contract_violations(_records(spark, d), spread(evidence, evidence.count(), "record_id"), orders)


def _curation(spark, d):
    """Customers outside MACHINERY are curated entries; every order of a customer is a change."""
    entries = table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("caption"), (F.col("c_mktsegment") == "BUILDING").alias("is_locked"),
        (F.col("c_acctbal") > 3000).alias("is_current"))
    orders = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    priority = F.col("o_orderpriority")
    action = (
        F.when(priority == "1-URGENT", "update").when(priority == "2-HIGH", "delete")
        .when(priority == "3-MEDIUM", "promote").otherwise("create"))
    changes = orders.select(F.col("o_orderkey").alias("change_id"), F.col("o_custkey").alias("entry_id"), action.alias("action"),
                            F.concat(F.lit("changed by "), F.col("o_orderkey")).alias("caption"))
    return entries, changes


_CURATION = """
entries AS (SELECT c_custkey AS entry_id, c_name AS caption, c_mktsegment = 'BUILDING' AS is_locked, c_acctbal > 3000 AS is_current
  FROM customer WHERE c_mktsegment <> 'MACHINERY'),
changes AS (SELECT o_orderkey AS change_id, o_custkey AS entry_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'update'
  WHEN '2-HIGH' THEN 'delete' WHEN '3-MEDIUM' THEN 'promote' ELSE 'create' END AS action,
  max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders),
outcomes AS (SELECT change_id, c.entry_id, action, 'changed by ' || change_id AS caption, CASE
  WHEN change_id < newest THEN 'superseded'
  WHEN action = 'create' THEN CASE WHEN e.entry_id IS NOT NULL THEN 'exists already' END
  WHEN e.entry_id IS NULL THEN 'unknown entry'
  WHEN action = 'update' THEN CASE WHEN is_locked THEN 'locked' WHEN is_current THEN 'already published' END
  WHEN action = 'delete' THEN CASE WHEN is_locked THEN 'locked' END
  WHEN action = 'promote' THEN CASE WHEN is_current THEN 'already published' END END AS rejected
  FROM changes c LEFT JOIN entries e ON e.entry_id = c.entry_id)"""


@query("curation_outcomes", f"WITH {_CURATION} SELECT change_id, entry_id, action, rejected FROM outcomes")
def curation_outcomes(spark, d):
    return pu.curation_outcomes(*_curation(spark, d)).select("change_id", "entry_id", "action", "rejected")


@query("apply_curation", f"""
WITH {_CURATION}, done AS (SELECT * FROM outcomes WHERE rejected IS NULL)
SELECT coalesce(e.entry_id, o.entry_id) AS entry_id, CASE WHEN action IN ('create', 'update') THEN o.caption ELSE e.caption END AS caption,
  coalesce(is_locked, false) AS is_locked, coalesce(is_current, false) OR coalesce(action = 'promote', false) AS is_current
FROM entries e FULL JOIN done o ON o.entry_id = e.entry_id WHERE action IS NULL OR action <> 'delete'""")
def apply_curation(spark, d):
    entries, changes = _curation(spark, d)
    return pu.apply_curation(entries, pu.curation_outcomes(entries, changes))
