"""The runnable query of each operator, with reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.substring_dedup import remove_repeats

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"),
        (F.size("repeat_bounds") / 2).cast("long").alias("n_spans"))


SQL["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM s WHERE win IN (SELECT win FROM s GROUP BY win HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM rep, (SELECT unnest(range(0, 35)) AS o)),
gone_at AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
firsts AS (SELECT doc_id, count(*) AS n_spans FROM (
  SELECT g.doc_id, g.p FROM gone g LEFT JOIN gone h ON g.doc_id = h.doc_id AND h.p = g.p - 1 WHERE h.p IS NULL)
  GROUP BY doc_id),
kept AS (
  SELECT doc_id, array_to_string(list(word ORDER BY p), ' ') AS t FROM (
    SELECT w.doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) a
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.p = a.p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM w LEFT JOIN gone_at USING (doc_id) LEFT JOIN firsts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexispark.llm.bpe import encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(documents(spark, sf_dir).select("doc_id", "text"), path, decoded=True).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexispark.llm.token_files import read_token_files, write_token_files
    from lexispark.session import scratch_path

    path = scratch_path(spark)
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), 50257, end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le32").alias("ids_crc32"))


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.chosen_path import near_groups

    return near_groups(documents(spark, sf_dir).select("doc_id", "text"), width=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept")


SQL["op8_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.langid import identify, train

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out)
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@query
def op7_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the two given labels: 0 bad quality, 1 good but toxic, 2 good; kept if grade 1 is likelier than not."""
    from lexispark.llm.ordinal import grade, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rating = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    model = train(docs, labels.where(~held_out), rating, top=2)
    return grade(docs, model, top=2).select(
        "doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "expected_grade",
        F.col("tail")[0].alias("p_good"), F.col("tail")[1].alias("p_best"), "kept")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.ftrl import score, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs, labels.where(~held_out), F.col("toxic"))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", "predicted")


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.pfair import mix_sources

    return mix_sources(documents(spark, sf_dir))


SQL["op9_source_mix"] = r"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
e AS (SELECT source, (1024 - count(*) OVER ()) * sqrt(n) / sum(sqrt(n)) OVER () AS x FROM c),
q AS (
  SELECT source, CAST(floor(x) + 1 + CASE WHEN row_number() OVER (ORDER BY round(floor(x) - x, 9), source)
         <= 1024 - count(*) OVER () - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quanta FROM e),
tasks AS (SELECT list(quanta ORDER BY quanta DESC, source) AS q, list(source ORDER BY quanta DESC, source) AS s FROM q),
sched(t, done, pick) AS (
  SELECT -1, list_transform(q, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM tasks
  UNION ALL
  SELECT t, list_transform(done, lambda d, i: d + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT t + 1 AS t, done, list_min(list_transform(range(1, len(q) + 1), lambda i:
      CASE WHEN done[i] * 1024 // q[i] <= t + 1 THEN ((done[i] + 1) * 1024 + q[i] - 1) // q[i] * 100000 + i END)) % 100000
      AS pick FROM sched, tasks WHERE t < 1023)),
pattern AS (
  SELECT s[pick] AS source, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn
  FROM sched, tasks WHERE t >= 0),
r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS within
  FROM documents),
b AS (SELECT r.*, within // 16 AS block, quanta FROM r JOIN q USING (source)),
p AS (
  SELECT b.doc_id, b.source, block, (block // quanta) * 1024 + slot AS slot, within
  FROM b JOIN pattern p ON p.source = b.source AND p.turn = block % quanta)
SELECT doc_id, source, block, slot, row_number() OVER (ORDER BY slot, within) AS position FROM p
"""


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.target_ratio import judge, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    ratios = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("quality") == 1)
    return judge(docs, ratios).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.iblt import fingerprints

    return fingerprints(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.col("d.edited.near").alias("near_edited"), F.col("d.next.near").alias("near_next"),
        F.size("d.edited.gone").alias("n_gone"), F.size("d.edited.come").alias("n_come"),
        F.col("d.edited.size").alias("cells_edited"), F.col("d.next.size").alias("cells_next"))


@query
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.decontaminate import contamination

    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL["op11_decontaminate"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i : i + 9], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM i WHERE len(words) > 0)),
s AS (
  SELECT doc_id, size, p, array_to_string(words[p : p + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p
        FROM w, (SELECT DISTINCT size FROM win) WHERE len(words) >= size)),
hit AS (SELECT doc_id, p, s.size, item_id FROM s JOIN win USING (size, win)),
n AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS place FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label=moved)


SQL["op12_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
  SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v),
k AS (SELECT vec_id, label, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM c),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM k a JOIN k b USING (i) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns,
    CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.filter_audit import document_masks, interaction_audit

    masks = document_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return interaction_audit(masks, "ABCDE")


SQL["op13_filter_audit"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN l USING (doc_id)),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
cells AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, filter_order[1 : step - 1] AS before
  FROM (SELECT DISTINCT part FROM t), orders, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT cells.part, filter_order, step, filter,
    coalesce(sum(n) FILTER (contains(fails, filter) AND translate(fails, before, '') = fails), 0) AS removed,
    coalesce(sum(good) FILTER (contains(fails, filter) AND translate(fails, before, '') = fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(fails, filter) AND translate(fails, before, '') = fails), 0) AS toxic_lost,
    coalesce(sum(n) FILTER (contains(fails, filter) AND translate(fails, before, '') <> fails), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
    coalesce(sum(n) FILTER (translate(fails, before || filter, '') = fails), 0) AS kept
  FROM cells JOIN c ON c.part = cells.part GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""
