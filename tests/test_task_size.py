"""Steps whose tasks must not grow with the input."""

from pyspark.sql import functions as F

from lexispark import session
from lexispark.operators import cooccurrence as co
from lexispark.operators import publish as pu
from lexispark.plans import builds as bd
from lexispark.sources import adapters
from tests.conftest import SMALL, rows


def _orders(spark, folder, n):
    """n orders of three lines each, as the tables that baskets are made of."""
    ids = spark.range(n)
    ids.select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus")).write.parquet(
        f"{folder}/orders.parquet")
    ids.select(F.col("id").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("l_linenumber")).select(
        "l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 11).alias("l_partkey"),
        F.when(F.col("l_orderkey") % 5 == 0, "R").otherwise("N").alias("l_returnflag")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(7).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey")).write.parquet(
        f"{folder}/customer.parquet")
    spark.range(11).select(F.col("id").alias("p_partkey"), F.concat(F.lit("B"), "id").alias("p_brand"), F.lit("t").alias("p_type"),
                           F.lit(1).alias("p_size")).write.parquet(f"{folder}/part.parquet")


def test_baskets_have_more_tasks_on_more_lines(spark, tmp_path, monkeypatch):
    _orders(spark, tmp_path, 400)
    whole = rows(bd.basket_sets(spark, str(tmp_path)))
    monkeypatch.setattr(session, "ROWS_IN_TASK", 100)
    sets = bd.basket_sets(spark, str(tmp_path))
    assert rows(sets) == whole and len(whole) == 400 * 4
    in_task = sets.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit_id").alias("units"))
    found = in_task.collect()
    assert len(found) >= 10 and max(r.n for r in found) <= 400
    assert sum(r.units for r in found) == 400       # no order is in two tasks
    assert rows(co.unit_totals(sets)) == rows(co.unit_totals(spark.createDataFrame(whole, sets.schema)))


def test_records_without_a_parent_are_dealt_over_tasks(spark):
    records = spark.range(4000).select(
        F.col("id").alias("record_id"), F.lit("a statement of some twenty letters").alias("statement"), F.lit("exploratory").alias("registration"),
        F.lit(None).cast("string").alias("definition"), F.lit("unsure").alias("verdict"), F.lit("").alias("missing_data"),
        F.when(F.col("id") % 10 == 0, F.col("id") + 1).when(F.col("id") == 3, F.lit(-1)).alias("parent_id"))
    evidence = spark.createDataFrame([(1, "contradicting")], "record_id long, role string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        broken = pu.contract_violations(records, evidence)
        tasks = broken.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert max(r.n for r in tasks) < 2000
        found = rows(broken)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == rows(records.select("record_id", F.lit("unknown_verdict")).unionByName(
        spark.createDataFrame([(3, "unknown_parent")], "record_id long, unknown_verdict string")))


def test_lines_move_before_they_are_tokens(spark):
    tokens = adapters.line_tokens(spark, SMALL)
    long_lines = tokens.groupBy("unit_id").agg(F.max("pos").alias("last")).where("unit_id % 3 = 0 and last > 4")
    ranges = long_lines.select("unit_id", F.lit(2).alias("start_pos"), F.lit(4).alias("end_pos")).unionByName(
        long_lines.select("unit_id", F.lit(3).alias("start_pos"), F.col("last").alias("end_pos"))).localCheckpoint()
    sets = co.item_sets(co.item_occurrences(adapters.flagged_line_tokens(spark, SMALL, ranges), bd.LINE_ITEMS))
    wanted = co.item_sets(co.item_occurrences(co.flag_masked(tokens, ranges), bd.LINE_ITEMS))
    assert sets.exceptAll(wanted).isEmpty() and wanted.exceptAll(sets).isEmpty()
    assert 0 < sets.where("not in_reduced").count() < sets.count()
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")


def test_the_buyers_are_joined_once(spark):
    from lexispark.plans.retrieval import _buyer_statistics

    plan = _buyer_statistics(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan


def test_outputs_in_one_piece_are_dealt_before_their_keys_are_made(spark, monkeypatch):
    """One large row group would be one task; passages without words of their own are found in any script."""
    from lexispark.operators import audit

    signs = "".join(chr(0x1F600 + i) for i in range(16))
    passages = spark.createDataFrame([(1, signs), (2, "a\n.." * 5), (3, "seven plain words stand in this passage")], "passage_id int, text_norm string")
    texts = [(i, f"{i} " * 300 + ("x" + signs + "y" if i == 3 else "ba\n..a\n..a\n..a\n..a\n..b" if i == 5 else
              "seven plain words stand in this passage" if i == 7 else "")) for i in range(24)]
    outputs = spark.createDataFrame([*texts, (24, None), (25, "")], "output_id int, text_norm string").coalesce(1)
    stored, settle = [], audit.settle
    monkeypatch.setattr(audit, "TASK_BYTES", 1 << 11, raising=False)
    monkeypatch.setattr(audit, "settle", lambda df: stored.append(settle(df)) or stored[-1])
    got = sorted(tuple(r) for r in audit.leak_exact(outputs, passages).collect())
    assert got == [(3, 1), (5, 2), (7, 3)]
    assert any(df.columns == ["output_id", "text_norm"] and df.count() == 26 and len(df.inputFiles()) > 4 for df in stored)


def test_most_pairs_are_told_by_their_beginnings(monkeypatch):
    """No pair that reaches the threshold is lost, unlike ones are not compared whole."""
    import random

    from lexispark.operators import audit

    rng, steps = random.Random(3), []
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    pairs = []
    for i in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(2, 50)))
        other = list(text) if i % 2 else list(" ".join(rng.choice(words) for _ in range(40))[:len(text)])
        if i % 2:       # from untouched to well below the threshold, in one place or everywhere
            for _ in range(len(text) * rng.randint(0, 30) // 100):
                at = rng.randrange(len(other) // (1 + i % 4 // 2) or 1)
                other[at:at + rng.randint(0, 2)] = rng.choice(["", "x", "qé"])
        pairs.append(("".join(other).encode(), text.encode()))
    pairs += [(b"", b"abc"), (b"a", b""), (b"abc", b"abc")]
    whole = audit.common_subsequence
    monkeypatch.setattr(audit, "common_subsequence", lambda a, b: steps.append(sum(map(len, b))) or whole(a, b))
    got = audit.near_percent([a for a, _ in pairs], [b for _, b in pairs])
    want = [audit.similarity(a, b) for a, b in pairs]
    assert [g >= 85 for g in got] == [w >= 85 for w in want] and all(g == w for g, w in zip(got, want) if w >= 85)
    assert 40 < sum(w >= 85 for w in want) < 300
    steps.clear()
    unlike = pairs[:400:2]
    audit.near_percent([a for a, _ in unlike], [b for _, b in unlike])
    assert sum(steps) < 0.8 * sum(len(a) for a, _ in unlike)


def test_unlike_windows_are_dropped_before_they_are_cut(spark, monkeypatch):
    """Of windows in the passage's own words only those whose common subsequence is long enough are compared one by one."""
    import random

    from lexispark.operators import audit
    from tests.test_operators import brute_fuzzy, texts

    rng, compared = random.Random(8), []
    words = ["".join(rng.choice(["th", "an", "er", "in", "é", "ou", "s"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = {i: some(n) for i, n in enumerate([4, 9, 30, 31, 32, 60, 400])}
    outputs = {i: some(rng.randint(0, 200)) for i in range(12)}
    for i, s in passages.items():
        for share in (2, 6, 13, 25):
            s_, lead = list(s), some(2)
            for _ in range(len(s) * share // 100):
                at = rng.randrange(len(s_))
                s_[at:at + 1] = rng.choice([[], ["x"], ["é", s_[at]]])
            outputs[len(outputs)] = lead[:len(s) // 20] + "".join(s_) + some(3)
    o, p = texts(spark, outputs, "output_id"), texts(spark, passages, "passage_id")
    exact = audit.leak_exact(o, p)
    want = brute_fuzzy(outputs, passages, {tuple(r) for r in exact.collect()})
    near = audit.near_percent
    monkeypatch.setattr(audit, "near_percent", lambda a, b: compared.extend(zip(a, b)) or near(a, b))
    import pyarrow as pa

    cell = audit._near_cell(*(pa.table({key: [*t], "text_norm": [*t.values()]}) for key, t in (("output_id", outputs), ("passage_id", passages))))
    held = {tuple(r) for r in exact.collect()}
    got = {(r["output_id"], r["passage_id"]): round(r["similarity"], 1) for r in cell.to_pylist()}
    assert len(want) > 8 and {k: v for k, v in got.items() if k not in held} == want
    like = [len(x) + len(y) <= 200 / 85 * n + 1e-6 for (x, y), n in zip(compared, audit.common_subsequence(*map(list, zip(*compared))))]
    assert len(like) > 8 and all(like)


def _unit_sets(spark, units=240):
    """Item sets in which some items are in most units, some in few, and one unit is many times the others."""
    import random

    rng = random.Random(12)
    rows = [("t" if u % 3 else "s", u, f"sec{u % 4}", f"i{i:03d}", rng.random() < 0.8)
            for u in range(units) for i in {int(60 * rng.random() ** 3) for _ in range(300 if u == 7 else rng.randint(1, 12))} | ({70, 71, 72} if u % 6 == 0 else set())]
    return spark.createDataFrame(rows, "item_type string, unit_id long, section string, item string, in_reduced boolean").localCheckpoint()


def test_pair_table_is_folded_by_slices(spark, monkeypatch):
    """The same as the stored table folded, with many slices, hot items, large units and shuffled lookups; nothing wide is stored."""
    from lexispark.params import Params

    sets, p = _unit_sets(spark), Params(pair_block=16)
    firsts = spark.range(0, 240, 5).select(F.col("id").alias("unit_id"))
    scopes = spark.createDataFrame([("raw", 240), ("phrase_reduced", 230)], "variant string, n_scope long")
    table = co.collocations_of(sets, scopes, firsts, p).localCheckpoint()
    wanted = table.groupBy("variant", "item_type", F.col("item_a").alias("item")).agg(
        *[F.expr(made).alias(name) for name, (made, _) in bd.LINE_FOLDS.items()], F.count_if("fdr_significant").alias("n_significant"))
    for name, value in (("PAIRS_AT_ONCE", 800), ("HOT_UNITS", 40), ("HOT_ITEMS", 9), ("PAIRS_IN_TASK", 500), ("LOOKUP_ROWS", 0)):
        monkeypatch.setattr(co, name, value)
    stored, settle = [], co.settle
    monkeypatch.setattr(co, "settle", lambda df: stored.append((df.columns, settle(df))) or stored[-1][1])
    got = co.folded_collocations(sets, scopes, firsts, bd.LINE_FOLDS, p)
    plain = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(df, *sorted(wanted.columns))]
    assert plain(got) == plain(wanted) and 0 < table.where("fdr_significant").count() < table.count()
    parts = [columns for columns, _ in stored if "c_raw" in columns]
    assert len(parts) > 5 and not any("item_b" in columns or "p" in columns for columns, _ in stored)


def test_pairs_are_counted_by_slices(spark, monkeypatch):
    """Pairs that share their smaller item move once, as arrays, and only a slice of them at a time."""
    from lexispark.params import Params

    sets, p = _unit_sets(spark), Params(pair_block=16)
    units = sets.join(co.marginals(sets).where("n_raw >= 5"), ["item_type", "item"]).select("item_type", "unit_id", "item")
    plain = units.join(units.withColumnRenamed("item", "item_b"), ["item_type", "unit_id"]).where("item < item_b").groupBy(
        "item_type", F.col("item").alias("item_a"), "item_b").agg(F.count(F.lit(1)).alias("n_ab"))
    sizes = plain.groupBy("item_type", "n_ab").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.max("item_a").alias("last_a"), F.min("item_b").alias("first_b"))
    assert rows(co.pair_counts(sets, p), *plain.columns) == rows(plain)
    for name, value in (("PAIRS_AT_ONCE", 800), ("HOT_UNITS", 40), ("HOT_ITEMS", 9), ("PAIRS_IN_TASK", 500)):
        monkeypatch.setattr(co, name, value)
    stored, settle = [], co.settle
    monkeypatch.setattr(co, "settle", lambda df: stored.append(df.columns) or settle(df))
    assert rows(co.pair_count_sizes(sets, p), *sizes.columns) == rows(sizes)
    assert sum("n_pairs" in columns for columns in stored) > 5
    numbers = co.NumberedItems(co.marginals(sets))
    cells = co.unit_cells(sets.join(numbers.lookup("item_type", "item", "id", "n_raw"), ["item_type", "item"]).select(
        "item_type", "unit_id", numbers.held(F.lit(0)).alias("item")), p=p)
    *cold, _ = co.pair_slices(cells, ("item_type", "unit_id"), numbers)
    plan = cold[0].groupBy("router", "partner").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert not any("ENSURE" in line and "partner" in line for line in plan.splitlines())


def test_units_listed_twice_count_as_before(spark):
    """Items of a unit that comes m times among the first units are m times in it."""
    from lexispark.params import Params

    sets = spark.createDataFrame([("t", 1, "s", i, True) for i in "ab"] + [("t", 2, "s", i, True) for i in "ab"],
                                 "item_type string, unit_id long, section string, item string, in_reduced boolean")
    firsts = spark.createDataFrame([(1,), (1,)], "unit_id long")
    got = rows(co.pair_rows(sets, firsts, Params(floor_item=1)).where("variant = 'raw'"), "item_a", "item_b", "n_ab")
    assert got == [("a", "a", 1), ("a", "b", 5), ("b", "b", 1)]
