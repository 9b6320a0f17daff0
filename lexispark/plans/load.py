"""Queries over sources, load checks and text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexispark.functions import stats as st
from lexispark.functions import text as tx
from lexispark.operators import integrity as ig
from lexispark.operators.retrieval import bad_refs, decompose_letters, expand_refs
from lexispark.plans.registry import LINES, query
from lexispark.session import scratch_dir, with_global_rank
from lexispark.sources import tables as tb
from lexispark.sources.adapters import line_units, table


def _path(spark) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query("csv_source", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def csv_source(spark, d):
    path = _path(spark)
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source", "n_chars")
    (docs.write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    rows = tb.read_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    return rows.where(F.col("_corrupt_record").isNull()).select(
        "doc_id", "lang", "source", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("json_map_source", """
SELECT doc_id AS unit_id, lang AS rule, CAST(0 AS INTEGER) AS span_start, CAST(n_chars AS INTEGER) AS span_end FROM documents""")
def json_map_source(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "n_chars")
    spans = F.array(F.struct(F.col("lang").alias("rule"), F.lit(0).alias("start"), F.col("n_chars").cast("int").alias("end")))
    path = _path(spark)
    docs.select(F.to_json(F.create_map(F.col("doc_id").cast("string"), spans)).alias("value")).write.text(path)
    rows = tb.explode_json_map(spark.read.text(path), F.col("value"))
    return rows.select("unit_id", F.inline("spans")).select(
        "unit_id", "rule", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query("table_source", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40""")
def table_source(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return rows.where("l_returnflag = 'R' and l_quantity > 40").drop("l_returnflag")


@query("overwrite_table", "SELECT c_custkey, c_mktsegment FROM customer")
def overwrite_table(spark, d):
    path = _path(spark)
    rows = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    for _ in range(2):  # a repeated load leaves the same rows
        tb.overwrite_table(rows, path)
    return tb.read_published(spark, path)


@query("replace_partition", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus
FROM orders""")
def replace_partition(spark, d):
    path = _path(spark)
    rows = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    rows.write.partitionBy("o_orderstatus").parquet(path)
    fresh = rows.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    tb.replace_partitions(fresh, path, ["o_orderstatus"])
    return spark.read.schema(rows.schema).parquet(path).select("o_orderkey", "o_totalprice", "o_orderstatus")


_LINE_KEY = ["l_orderkey", "l_linenumber"]


@query("insert_unique", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1""")
def insert_unique(spark, d):
    return tb.insert_unique(table(spark, d, "lineitem", *_LINE_KEY, "l_partkey", "l_suppkey"), _LINE_KEY)


@query("insert_unique_published", """
WITH kept AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_returnflag, count(*) AS n_rows, (SELECT count(*) FROM lineitem) AS asked, (SELECT count(*) FROM kept) AS stored
FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def insert_unique_published(spark, d):
    """The reload with its counts taken while it was written, read back by return flag."""
    path = _path(spark)
    asked, stored = tb.insert_unique_published(table(spark, d, "lineitem", *_LINE_KEY, "l_returnflag", "l_partkey"), _LINE_KEY, path)
    return tb.read_published(spark, path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "l_returnflag", "n_rows", F.lit(asked).cast("long").alias("asked"), F.lit(stored).cast("long").alias("stored"))


@query("update_partitions", """
WITH delta AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY o_custkey)
SELECT c_custkey, c_mktsegment, coalesce(x.c_acctbal, c.c_acctbal) AS c_acctbal, (SELECT count(DISTINCT c_mktsegment) FROM customer
  WHERE c_custkey IN (SELECT c_custkey FROM delta)) AS n_written FROM customer c LEFT JOIN delta x USING (c_custkey)""")
def update_partitions(spark, d):
    """Balances of two market segments taken from orders; only those two partitions are written anew."""
    path = _path(spark)
    base = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    base.write.partitionBy("c_mktsegment").parquet(path)
    some = base.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")
    delta = table(spark, d, "orders", "o_custkey", "o_totalprice").toDF("c_custkey", "c_acctbal").join(some, "c_custkey", "left_semi")
    written = tb.update_partitions(spark, path, delta, "c_custkey", "c_acctbal", ["c_mktsegment"])
    return spark.read.parquet(path).select("c_custkey", "c_mktsegment", "c_acctbal", F.lit(written).cast("long").alias("n_written"))


@query("insert_gap_audit", """
WITH kept AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL),
stored AS (SELECT l_returnflag, count(*) AS n FROM kept GROUP BY ALL),
asked AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, a.n AS asked, coalesce(s.n, 0) AS stored, a.n - coalesce(s.n, 0) AS missing
FROM asked a LEFT JOIN stored s USING (l_returnflag) WHERE a.n <> coalesce(s.n, 0)""")
def insert_gap_audit(spark, d):
    return tb.insert_gap(table(spark, d, "lineitem", *_LINE_KEY, "l_returnflag"), _LINE_KEY, ["l_returnflag"])


@query("update_from", """
WITH delta AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, coalesce(x.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN delta x USING (c_custkey)""")
def update_from(spark, d):
    base = table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal")
    delta = table(spark, d, "orders", "o_custkey", "o_totalprice").toDF("c_custkey", "c_acctbal")    # many per customer
    return tb.update_from(base, delta, "c_custkey", "c_acctbal")


@query("register_source", """
WITH registry AS (SELECT row_number() OVER (ORDER BY name) AS source_id, name, version FROM (
  SELECT DISTINCT source AS name, 'de' AS version FROM documents WHERE lang = 'de')),
wanted AS (SELECT DISTINCT source AS name, lang AS version FROM documents),
missing AS (SELECT * FROM wanted WHERE (name, version) NOT IN (SELECT (name, version) FROM registry))
SELECT source_id, name, version FROM registry
UNION ALL
SELECT (SELECT coalesce(max(source_id), 0) FROM registry) + row_number() OVER (ORDER BY name, version), name, version FROM missing""")
def register_source(spark, d):
    docs = table(spark, d, "documents", "source", "lang").select(F.col("source").alias("name"), F.col("lang").alias("version"))
    german = docs.where("version = 'de'").distinct()
    registry = with_global_rank(german, [F.col("name")], "source_id").select("source_id", "name", "version")
    return tb.register_sources(registry, docs, ["name", "version"])


@query("dictionary_encode", """
WITH dict AS (SELECT DISTINCT p_brand AS item FROM part WHERE p_size < 3),
codes AS (SELECT item, row_number() OVER (ORDER BY item) AS item_id FROM dict)
SELECT p_partkey, p_brand, item_id AS brand_id FROM part LEFT JOIN codes ON item = p_brand""")
def dictionary_encode(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    known = with_global_rank(parts.where("p_size < 3").select(F.col("p_brand").alias("item")).distinct(), [F.col("item")], "item_id")
    return ig.dictionary_encode(parts.drop("p_size"), known, "p_brand", "brand_id").select("p_partkey", "p_brand", "brand_id")


def _lines_and_open_orders(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'O'")
    return lines, orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")


@query("resolve_keys", """
SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'O'""")
def resolve_keys(spark, d):
    lines, index = _lines_and_open_orders(spark, d)
    return ig.resolve_keys(lines, index, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_quantity", "o_orderstatus")


@query("unresolved_keys", """
SELECT l_returnflag, count(*) AS n_unresolved FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY l_returnflag""")
def unresolved_keys(spark, d):
    lines, index = _lines_and_open_orders(spark, d)
    return ig.unresolved_keys(lines, index, ["l_orderkey"]).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_unresolved"))


@query("expect_counts", """
WITH n AS (SELECT 'region' AS table_name, 5 AS n_expected, (SELECT count(*) FROM region) AS n_rows
  UNION ALL SELECT 'nation', 25, (SELECT count(*) FROM nation)
  UNION ALL SELECT 'orders', 10, (SELECT count(*) FROM orders))
SELECT table_name, CAST(n_expected AS BIGINT) AS n_expected, n_rows,
  CASE WHEN n_expected = n_rows THEN 'OK' ELSE 'FAIL' END AS status,
  CASE WHEN (SELECT bool_and(n_expected = n_rows) FROM n) THEN 'OK' ELSE 'FAIL' END AS overall FROM n""")
def expect_counts(spark, d):
    expected = spark.createDataFrame([("region", 5), ("nation", 25), ("orders", 10)], "table_name string, n_expected long")
    return ig.expect_counts({t: table(spark, d, t) for t in ("region", "nation", "orders")}, expected)


def _flags(spark, d):
    flags = table(spark, d, "labels", "doc_id", "toxic").where("toxic = 1").select(
        F.lit("document").alias("subject_type"), F.col("doc_id").alias("subject_id"), F.lit("text").alias("field"),
        F.lit("toxic").alias("reason"))
    short = table(spark, d, "documents", "doc_id", "n_chars").where("n_chars < 2000").select(
        F.lit("document").alias("subject_type"), F.col("doc_id").alias("subject_id"), F.lit("text").alias("field"),
        F.explode(F.array(F.lit("short"), F.lit("check again"))).alias("reason"))
    return flags, short     # every short document is flagged twice


_FLAG_SQL = """
WITH flags AS (SELECT 'document' AS subject_type, doc_id AS subject_id, 'text' AS field, 'toxic' AS reason FROM labels WHERE toxic = 1),
short AS (SELECT 'document' AS subject_type, doc_id AS subject_id, 'text' AS field, unnest(['short', 'check again']) AS reason
  FROM documents WHERE n_chars < 2000)
SELECT * FROM flags UNION ALL """


@query("emit_flags_guarded", _FLAG_SQL + """SELECT subject_type, subject_id, field, min(reason) FROM short
WHERE subject_id NOT IN (SELECT subject_id FROM flags) GROUP BY ALL""")
def emit_flags_guarded(spark, d):
    return ig.emit_flags(*_flags(spark, d))


@query("emit_flags_always", _FLAG_SQL + "SELECT * FROM short")
def emit_flags_always(spark, d):
    return ig.emit_flags(*_flags(spark, d), guarded=False)


def spaced_tokens(units):
    """Tokens of a text split at spaces, empty pieces dropped."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return units.select("unit_id", F.posexplode(words).alias("i", "form")).select(
        "unit_id", (F.col("i") + 1).alias("pos"), "form",
        F.struct("unit_id", (F.col("i") + 1).alias("pos")).alias("token_id"))


@query("alignment_check", f"""
WITH {LINES}
SELECT unit_id, coalesce(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' '), '') = text AS aligned FROM units""")
def alignment_check(spark, d):
    units = line_units(spark, d)
    return ig.alignment_check(units, spaced_tokens(units))


@query("null_if_empty_clip", f"""
WITH {LINES}
SELECT doc_id, line_no AS line_no, nullif(trim(text), '') AS body, left(text, 255) AS clipped FROM raw_lines""")
def null_if_empty_clip(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"),
                        tx.null_if_empty(F.trim("text")).alias("body"), tx.clip(F.col("text"), 255).alias("clipped"))


@query("normalize_text", rf"""
WITH {LINES}
SELECT unit_id,
  translate(regexp_replace(lower(text), '[\x{{0300}}-\x{{036F}}]', '', 'g'), '{tx.LATIN_FOLD_FROM}', '{tx.LATIN_FOLD_TO}') AS latin,
  translate(regexp_replace(text, '[\x{{0610}}-\x{{061A}}\x{{064B}}-\x{{065F}}\x{{0670}}\x{{06D6}}-\x{{06DC}}\x{{06DF}}-\x{{06E8}}\x{{06EA}}-\x{{06ED}}\x{{0640}}]', '', 'g'),
    '{tx.ARABIC_FOLD_FROM}', '{tx.ARABIC_FOLD_TO}') AS arabic
FROM units""")
def normalize_text(spark, d):
    return line_units(spark, d).select(
        "unit_id", tx.normalize_latin(F.col("text")).alias("latin"), tx.normalize_text(F.col("text")).alias("arabic"))


@query("strip_spaces", f"WITH {LINES} SELECT unit_id, replace(text, ' ', '') AS squeezed FROM units")
def strip_spaces(spark, d):
    return line_units(spark, d).select("unit_id", tx.strip_spaces(F.col("text")).alias("squeezed"))


@query("match_contains_prefix", """
SELECT p_partkey, contains(p_name, 'widget') OR contains(p_type, 'widget') AS has_widget, starts_with(p_name, 'red') AS starts_red,
  contains(p_name, '%') AS literal_percent FROM part""")
def match_contains_prefix(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").select(
        "p_partkey", tx.match_contains(F.lit("widget"), name, kind).alias("has_widget"),
        tx.match_prefix(F.lit("red"), name).alias("starts_red"),
        tx.match_contains(F.lit("%"), name).alias("literal_percent"))


@query("char_length", f"WITH {LINES} SELECT unit_id, CAST(length(text) AS INTEGER) AS n_chars FROM units")
def char_length(spark, d):
    return line_units(spark, d).select("unit_id", F.char_length("text").alias("n_chars"))


def letter_dictionary(spark, d):
    """Letters that occur in region names, with their position in the alphabet."""
    letters = table(spark, d, "region", "r_name").select(F.explode(tx.letters_of(F.lower("r_name"))).alias("letter")).distinct()
    return letters.select("letter", F.upper("letter").alias("name"), F.ascii("letter").alias("code"))


LETTERS_SQL = """
letters AS (SELECT DISTINCT letter, upper(letter) AS name, CAST(ascii(letter) AS INTEGER) AS code FROM (
  SELECT unnest(string_split(lower(r_name), '')) AS letter FROM region) WHERE letter <> '')"""


@query("decompose_letters", f"""
WITH {LETTERS_SQL},
spread AS (SELECT p_partkey AS token_id, unnest(string_split(p_name, '')) AS letter,
  generate_subscripts(string_split(p_name, ''), 1) - 1 AS letter_pos FROM part)
SELECT token_id, CAST(letter_pos AS INTEGER) AS letter_pos, letter, name, code FROM spread JOIN letters USING (letter)""")
def decompose(spark, d):
    tokens = table(spark, d, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("token_id"), F.col("p_name").alias("norm"))
    return decompose_letters(tokens, letter_dictionary(spark, d)).select("token_id", "letter_pos", "letter", "name", "code")


def _part_refs(spark, d):
    key = F.col("p_partkey")
    ref = (
        F.when(key % 5 == 0, F.concat(F.col("p_size"), F.lit(":"), key % 9 + 1))
        .when(key % 5 == 1, F.concat(F.col("p_size"), F.lit("-"), key % 9))
        .otherwise(F.concat(F.lit(" "), F.col("p_size"), F.lit(":"), key % 9 + 1, F.lit("-"), key % 13 + 1)))
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", ref.alias("ref"))


_REFS_SQL = r"""
refs AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size || ':' || (p_partkey % 9 + 1)
  WHEN p_partkey % 5 = 1 THEN p_size || '-' || (p_partkey % 9)
  ELSE ' ' || p_size || ':' || (p_partkey % 9 + 1) || '-' || (p_partkey % 13 + 1) END AS ref FROM part),
parsed AS (SELECT p_partkey, ref, regexp_matches(trim(ref), '^(\d+):(\d+)(-(\d+))?$') AS ok,
  TRY_CAST(regexp_extract(trim(ref), '^(\d+):(\d+)(-(\d+))?$', 1) AS INTEGER) AS section,
  TRY_CAST(regexp_extract(trim(ref), '^(\d+):(\d+)(-(\d+))?$', 2) AS INTEGER) AS a,
  coalesce(TRY_CAST(regexp_extract(trim(ref), '^(\d+):(\d+)(-(\d+))?$', 4) AS INTEGER),
           TRY_CAST(regexp_extract(trim(ref), '^(\d+):(\d+)(-(\d+))?$', 2) AS INTEGER)) AS b FROM refs)"""


@query("expand_ref", f"""
WITH {_REFS_SQL}
SELECT p_partkey, section, unnest(CAST(range(a, b + 1) AS INTEGER[])) AS seq FROM parsed WHERE ok AND b >= a""")
def expand_ref(spark, d):
    return expand_refs(_part_refs(spark, d)).select("p_partkey", "section", "seq")


@query("expand_ref_rejects", f"""
WITH {_REFS_SQL}
SELECT p_partkey, ref, CASE WHEN NOT ok THEN 'bad_format' ELSE 'end_before_start' END AS error FROM parsed WHERE NOT ok OR b < a""")
def expand_ref_rejects(spark, d):
    return bad_refs(_part_refs(spark, d)).select("p_partkey", "ref", "error")


@query("format_ref", "SELECT l_orderkey, concat_ws(':', l_suppkey, l_partkey, l_linenumber) AS ref FROM lineitem")
def format_ref(spark, d):
    cols = [F.col(c).cast("string") for c in ("l_suppkey", "l_partkey", "l_linenumber")]
    return table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber").select(
        "l_orderkey", tx.format_ref(*cols).alias("ref"))


@query("json_codec", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"user":' || user_id || ',"k":' || json_extract(props, '$.k') || '}' AS encoded
FROM events""")
def json_codec(spark, d):
    rows = table(spark, d, "events", "event_id", "user_id", "props").withColumn("p", F.from_json("props", "k int"))
    return rows.select("event_id", F.col("p.k").alias("k"),
                       F.to_json(F.struct(F.col("user_id").alias("user"), F.col("p.k").alias("k"))).alias("encoded"))


@query("json_from_text", """
SELECT event_id, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN props WHEN 'purchase' THEN '[1, 2]' END AS body,
  event_type NOT IN ('view', 'click', 'purchase') AS rejected FROM events""")
def json_from_text(spark, d):
    kind = F.col("event_type")
    answer = (
        F.when(kind == "view", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(kind == "click", F.concat(F.lit("  "), "props"))
        .when(kind == "purchase", F.lit("```\n[1, 2]\n```"))
        .when(kind == "error", F.lit("I cannot answer that"))
        .otherwise(F.lit('{"broken": ')))
    rows = table(spark, d, "events", "event_id", "event_type", "props").withColumn("body", tx.json_from_text(answer))
    return rows.select("event_id", "body", F.col("body").isNull().alias("rejected"))


@query("bucket_p", """
SELECT l_orderkey, l_linenumber, l_partkey, l_discount, CASE WHEN l_discount < 0.001 THEN 'p<0.001' WHEN l_discount < 0.01 THEN 'p<0.01'
  WHEN l_discount < 0.05 THEN 'p<0.05' ELSE 'not small' END AS label FROM lineitem""")
def bucket_p(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_discount").withColumn(
        "label", tx.bucket_p(F.col("l_discount")))


@query("log_factorial", """
SELECT o_orderkey, round(lgamma(o_orderkey + 1), 6) AS log_factorial FROM orders""")
def log_factorial(spark, d):
    return table(spark, d, "orders", "o_orderkey").select(
        "o_orderkey", F.round(st.log_factorial(F.col("o_orderkey")), 6).alias("log_factorial"))
