"""What is made from lines stays with the partition of its line."""

import pytest

from lexispark import session
from lexispark.operators import retrieval as rt
from lexispark.operators import spans as sp
from lexispark.plans import QUERIES
from lexispark.sources import adapters
from tests.conftest import SMALL, rows


def _moved(df):
    """What stands under each exchange that the plan adds on its own."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "ENSURE_REQUIREMENTS" in line:
            end = next((j for j in range(i + 1, len(lines)) if at[j] <= at[i]), len(lines))
            yield "\n".join(lines[i + 1:end])


@pytest.mark.parametrize("name", ["sort_segments", "unit_bundle", "token_offsets"])
def test_tokens_and_annotations_do_not_move(spark, monkeypatch, name):
    whole = QUERIES[name](spark, SMALL)
    monkeypatch.setattr(session, "ROWS_IN_TASK", 5000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = QUERIES[name](spark, SMALL)
        assert all("Generate" not in below for below in _moved(dealt))
        assert dealt.exceptAll(whole).isEmpty() and whole.exceptAll(dealt).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_and_missing_units(spark):
    """Each annotation meets each copy of a token; a row without a unit meets nothing."""
    tokens = spark.createDataFrame([(1, 1, 11, "ab"), (None, 1, 12, "ab"), (1, 2, 13, "cd"), (1, 2, 13, "cd")],
                                   "unit_id long, pos int, token_id long, form string")
    anns = spark.createDataFrame([(1, 0, "r", 0, 1), (1, 0, "r", 0, 1), (None, 0, "r", 0, 1), (2, 0, "r", 0, 1)],
                                 "unit_id long, group_id int, rule string, start int, end int")
    placed = sp.token_offsets(tokens)
    assert rows(placed, "token_id", "tok_start") == [(11, 0), (13, 3), (13, 6)]
    found = sp.project_spans(anns, placed)
    assert rows(found, "token_id", "seg_start", "seg_end", "spans_tokens") == [(11, 0, 1, False)] * 2
    assert rows(sp.project_spans(anns, placed.unionAll(placed)), "token_id") == [(11,)] * 4


def test_profiles_of_dealt_tokens(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_IN_TASK", 500)
    tokens, plain = adapters.tokens_by_unit(spark, SMALL), adapters.line_tokens(spark, SMALL)
    assert tokens.exceptAll(plain).isEmpty() and plain.exceptAll(tokens).isEmpty()
    units = rt.profile_counts(tokens.selectExpr("*", "array(lemma) AS features"), ["root"]).select("root", "n_units")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(root" in units and not any("ENSURE" in x and "unit_id" in x for x in units.splitlines())
    features = spark.createDataFrame([("a", ["y", "x"], 1), ("a", ["x", "y"], 1), ("a", None, 2), ("a", [], 2), ("a", ["x", None], 3), ("a", [None, "x"], 3)],
                                     "norm string, features array<string>, unit_id long").selectExpr("norm AS lemma", "*")
    assert rows(rt.profile_counts(features), "lemma", "profiles", "n_units") == [("a", 3, 3)]
