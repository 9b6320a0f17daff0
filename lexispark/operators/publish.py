"""Verification, publication and record rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.session import spread, with_global_rank, with_global_sum, with_group_rank


def verify(observed: DataFrame, expectations: DataFrame, by: Sequence[str] = ("build", "name")) -> DataFrame:
    """PASS/FAIL per named assertion.

    ``observed``: build, name, value. ``expectations``: build, name, rule
    (equals, is_null, differs), expected, tolerance. A missing observation fails, whatever the rule. ``by`` names the
    columns that address a value, build first.
    """
    rows = expectations.join(observed.withColumn("_seen", F.lit(True)), list(by), "left")
    value, want = F.col("value"), F.col("expected")
    met = (
        F.when(F.col("rule") == "is_null", value.isNull())
        .when(F.col("rule") == "differs", value != want)
        .otherwise(F.abs(value - want) < F.col("tolerance"))
    )
    good = F.col("_seen").isNotNull() & F.coalesce(met, F.lit(False))
    return rows.withColumn("status", F.when(good, "PASS").otherwise("FAIL")).drop("_seen")


def observed_values(table: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The values of a built table at the addresses in ``wanted``: the keys, column, value as a double.

    ``wanted`` has the keys and the name of a column. The table is cut down to the wanted keys before its columns become
    rows, and only columns that any address names become rows at all.
    """
    held = wanted.select(*keys, "column").distinct()
    names = [r.column for r in held.select("column").distinct().collect() if r.column in table.columns]     # columns of one table
    if not names:
        return held.where(F.lit(False)).withColumn("value", F.lit(None).cast("double"))
    rows = table.join(held.select(*keys).distinct(), list(keys), "left_semi").select(
        *keys, *[F.col(c).cast("double").alias(c) for c in sorted(names)])
    return rows.unpivot(list(keys), sorted(names), "column", "value").join(held, [*keys, "column"], "left_semi")


def verification_summary(checked: DataFrame) -> DataFrame:
    """Passed and total per build, and whether the build passed."""
    return checked.groupBy("build").agg(
        F.count(F.when(F.col("status") == "PASS", 1)).alias("n_passed"),
        F.count(F.lit(1)).alias("n_checks")).withColumn("verified", F.col("n_passed") == F.col("n_checks"))


def current_rows(results: DataFrame, builds: DataFrame) -> DataFrame:
    """Rows of the published build only; without one the result is empty, never the newest."""
    return results.join(builds.where("is_current").select("build"), "build", "left_semi")


def publication_note(builds: DataFrame) -> DataFrame:
    """One row: the published build, or null and the reason."""
    return builds.agg(F.max(F.when(F.col("is_current"), F.col("build"))).alias("build")).withColumn(
        "note", F.when(F.col("build").isNull(), "no build has been published"))


def build_decisions(requests: DataFrame, summary: DataFrame) -> DataFrame:
    """Accept or refuse promotion requests (request_id, build, at, force, reason) by verification."""
    rows = requests.join(summary, "build", "left")
    has_reason = F.coalesce(F.trim("reason") != "", F.lit(False))
    refused = (
        F.when(F.col("force") & ~has_reason, "force needs a reason")
        .when(F.col("force"), F.lit(None).cast("string"))
        .when(F.col("verified").isNull(), "never verified")
        .when(~F.col("verified"), "verification failed")
    )
    return rows.withColumn("refused", refused).withColumn("accepted", F.col("refused").isNull())


def promote_build(builds: DataFrame, decisions: DataFrame) -> DataFrame:
    """Builds with exactly the latest accepted one current; each keeps its last promotion."""
    order = F.struct("at", "request_id")
    accepted = decisions.where("accepted")
    per_build = accepted.groupBy("build").agg(
        F.max("at").alias("promoted_at"), F.max_by("reason", order).alias("promotion_reason"))
    winner = accepted.agg(F.max_by("build", order).alias("build")).withColumn("_won", F.lit(True))  # one row
    return builds.join(per_build, "build", "left").join(F.broadcast(winner), "build", "left").withColumn(
        "is_current", F.coalesce("_won", F.lit(False))).drop("_won")


def promotion_history(decisions: DataFrame) -> DataFrame:
    """(seq, request_id, build, reason, valid_from, valid_to) of every accepted promotion, in the order of their times.

    A promotion is in force until the next one, of whatever build; the last one has no end. A request that the log holds
    twice counts once, so replaying a log changes nothing. The order is a range sort; each row then meets its successor
    by number, so no task sees the whole history.
    """
    asked = decisions.where("accepted").groupBy("request_id").agg(F.min(F.struct("at", "build", "reason")).alias("_r")).select(
        "request_id", "_r.*")
    ranked = with_global_rank(asked, [F.col("at"), F.col("request_id")], "seq")
    after = ranked.select((F.col("seq") - 1).alias("seq"), F.col("at").alias("valid_to"))
    return ranked.join(after, "seq", "left").select(
        "seq", "request_id", "build", "reason", F.col("at").alias("valid_from"), "valid_to")


def build_at(history: DataFrame, moments: DataFrame) -> DataFrame:
    """``moments`` (moment) with the build that was in force then, null before the first promotion.

    The promotion in force is the last one that is not later: a union of both, range sorted by time, in which the number of
    promotions up to a row is the number of the promotion asked for.
    """
    both = history.select(F.col("valid_from").alias("t"), F.lit(0).alias("kind"), F.col("seq").alias("seq"), F.lit(None).cast(
        moments.schema["moment"].dataType).alias("moment")).unionByName(
        moments.select(F.col("moment").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), "moment"))
    counted = with_global_sum(both.withColumn("one", 1 - F.col("kind")), [F.col("t"), F.col("kind"), F.col("seq")], "one", "before")
    asked = counted.where("kind = 1").select("moment", F.col("before").alias("seq"))
    return asked.join(history.select("seq", "build"), "seq", "left").select("moment", "build")


def promote_subject(versions: DataFrame, log: DataFrame) -> DataFrame:
    """Versions (version, subject_type, subject_id, subject_ref) after a promotion log (version, at, reason).

    Requests without a reason do nothing. Each subject, by id or else by reference, has one
    current version: the last one promoted. An aggregate per subject keeps popular subjects cheap.
    """
    valid = log.where(F.coalesce(F.trim("reason") != "", F.lit(False))).groupBy("version").agg(
        F.max("at").alias("promoted_at"))
    rows = versions.join(valid, "version", "left").withColumn(
        "subject", F.coalesce(F.col("subject_id").cast("string"), F.concat(F.lit("ref:"), F.col("subject_ref"))))
    winner = rows.where("promoted_at is not null").groupBy("subject_type", "subject").agg(
        F.max_by("version", F.struct("promoted_at", "version")).alias("_winner"))
    return rows.join(winner, ["subject_type", "subject"], "left").withColumn(
        "is_current", F.coalesce(F.col("version") == F.col("_winner"), F.lit(False))).drop("_winner")


def lineage(records: DataFrame) -> DataFrame:
    """Each record with its parent's statement and its number of children."""
    parents = records.select(F.col("record_id").alias("parent_id"), F.col("statement").alias("parent_statement"))
    children = records.where("parent_id is not null").groupBy(F.col("parent_id").alias("record_id")).agg(
        F.count(F.lit(1)).alias("n_children"))
    return records.join(parents, "parent_id", "left").join(children, "record_id", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def lineage_children(records: DataFrame) -> DataFrame:
    """Every child of a known record with its statement; place counts a record's children in the order of their ids."""
    known = records.select(F.col("record_id").alias("parent_id"))
    kids = records.join(known, "parent_id").select(
        F.col("parent_id").alias("record_id"), F.col("record_id").alias("child_id"), F.col("statement").alias("child_statement"))
    return with_group_rank(kids, ["record_id"], [F.col("child_id")], "place")


def verdict_history(verdicts: DataFrame) -> DataFrame:
    """All verdicts of a record, newest first."""
    return with_group_rank(verdicts, ["record_id"], [F.desc("at"), F.desc("verdict_id")], "place")


def evidence_with_units(records: DataFrame, evidence: DataFrame, units: DataFrame) -> DataFrame:
    """Evidence rows of known records with the unit they point to; evidence without a unit keeps its row."""
    known = evidence.join(records.select("record_id"), "record_id", "left_semi")
    return known.join(units, "unit_id", "left")


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """Newest verdict per record and the length of its history."""
    order = F.struct("at", "verdict_id")
    return verdicts.groupBy("record_id").agg(
        F.max_by("verdict", order).alias("verdict"), F.count(F.lit(1)).alias("n_verdicts"))


# fixed values: the five verdicts
VERDICTS = ("sync", "partial", "contradicted", "insufficient", "beyond_scope")


def contract_violations(records: DataFrame, evidence: DataFrame, count: int = 0) -> DataFrame:
    """One row per broken rule.

    ``records``: record_id, statement, registration, definition, verdict, missing_data, parent_id.
    ``evidence``: record_id, role. Relational rules are joins against pre-aggregated keys.
    ``count``, if known, is the number of records; it decides in how many partitions they meet their parents.
    """
    contradicting = evidence.where(F.col("role") == "contradicting").select("record_id").distinct().withColumn(
        "_has_contra", F.lit(True))
    known = records.select(F.col("record_id").alias("parent_id"), F.lit(True).alias("_parent_known"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    size = F.char_length("statement")
    alone: Mapping[str, Column] = {
        "definition_required": (F.col("registration") == "preregistered") & blank("definition"),
        "missing_data_required": (F.col("verdict") == "insufficient") & blank("missing_data"),
        "unknown_verdict": F.col("verdict").isNotNull() & ~F.col("verdict").isin(*VERDICTS),
        "statement_length": (size < 20) | (size > 2000),
    }
    # a record alone decides most rules; only flags go through the joins, not its texts
    flags = records.select("record_id", "parent_id", (F.col("verdict") == "contradicted").alias("_contradicted"), *[
        F.coalesce(c, F.lit(False)).alias(name) for name, c in alone.items()])
    proven = flags.join(contradicting, "record_id", "left")
    # records without a parent find none; they are dealt over all tasks instead of meeting in one
    deal = F.when(F.col("parent_id").isNull(), F.xxhash64("record_id")).otherwise(F.xxhash64("parent_id"))
    on = ["parent_id", "_deal"]
    rows = spread(proven.withColumn("_deal", deal), count, *on).join(
        spread(known.withColumn("_deal", F.xxhash64("parent_id")), count, *on), on, "left")
    rules: Mapping[str, Column] = {
        **{name: F.col(name) for name in alone},
        "contradicting_evidence_required": F.col("_contradicted") & F.col("_has_contra").isNull(),
        "unknown_parent": F.col("parent_id").isNotNull() & F.col("_parent_known").isNull(),
    }
    broken = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]),
        lambda x: x.isNotNull())
    return rows.select("record_id", F.explode(broken).alias("rule"))


def curation_outcomes(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Decide a batch of edits: change_id, entry_id, action in create, update, delete, promote.

    Of several changes of one entry the one with the highest change_id is decided, the others are superseded.
    """
    newest = changes.groupBy("entry_id").agg(F.max("change_id").alias("_newest"))
    rows = changes.join(newest, "entry_id").join(entries.select("entry_id", "is_locked", "is_current", F.lit(True).alias("_known")), "entry_id", "left")
    action = F.col("action")
    reason = (
        F.when(F.col("change_id") < F.col("_newest"), "superseded")
        .when(action == "create", F.when(F.col("_known"), "exists already"))
        .when(F.col("_known").isNull(), "unknown entry")
        .when(action == "update", F.when(F.col("is_locked"), "locked").when(F.col("is_current"), "already published"))
        .when(action == "delete", F.when(F.col("is_locked"), "locked"))
        .when(action == "promote", F.when(F.col("is_current"), "already published"))
        .otherwise("unknown action")
    )
    return rows.withColumn("rejected", reason).drop("_known", "_newest", "is_locked", "is_current")


def apply_curation(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entries after the accepted changes; created ones start unlocked and unpublished."""
    done = outcomes.where("rejected is null").select("entry_id", "action", F.col("caption").alias("_caption"))
    merged = entries.join(done, "entry_id", "full_outer").where("action is null or action <> 'delete'")
    edits = F.col("action").isin("create", "update")
    return merged.select(
        "entry_id",
        F.when(F.coalesce(edits, F.lit(False)), F.col("_caption")).otherwise(F.col("caption")).alias("caption"),
        F.coalesce("is_locked", F.lit(False)).alias("is_locked"),
        (F.coalesce("is_current", F.lit(False)) | F.coalesce(F.col("action") == "promote", F.lit(False))).alias("is_current"))
