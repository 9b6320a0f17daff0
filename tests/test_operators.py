"""Hand fixtures for phrases, masking, pairing, spans, references, audits and curation."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import audit as au
from lexispark.operators import cooccurrence as co
from lexispark.operators import integrity as ig
from lexispark.operators import phrases as ph
from lexispark.operators import retrieval as rt
from lexispark.operators import search as se
from lexispark.operators import spans as sp
from lexispark.operators import statistics_view as sv
from lexispark.params import Params
from lexispark.session import running_total, with_global_rank
from lexispark.sources import tables as tb
from tests.conftest import rows

TOKENS = "unit_id long, section string, pos int, norm string, lemma string"


def corpus(spark, texts, section=lambda u: "s"):
    units = spark.createDataFrame([(u, section(u), t, t) for u, t in texts.items()], "unit_id long, section string, text string, text_norm string")
    tokens = spark.createDataFrame(
        [(u, section(u), i + 1, w, w) for u, t in texts.items() for i, w in enumerate(t.split())], TOKENS)
    return units, tokens


def phrase_texts():
    texts = {1: "a b c", 2: "a b c", 3: "a b c"}
    texts.update({10 + i: f"w{i} x y z" for i in range(10)})
    return texts


def test_full_unit_keeps_the_first(spark):
    units, tokens = corpus(spark, phrase_texts())
    occ = ph.phrase_occurrences(units, tokens).cache()
    full = rows(occ.where("kind = 'full_unit'"), "unit_id", "start_pos", "end_pos", "is_first")
    assert full == [(1, 1, 3, True), (2, 1, 3, False), (3, 1, 3, False)]


def test_longest_ending_wins(spark):
    units, tokens = corpus(spark, phrase_texts())
    occ = ph.phrase_occurrences(units, tokens).where("kind = 'final_ngram'").cache()
    assert {r.pattern for r in occ.collect()} == {"x y z"}  # "y z" qualifies but is never assigned
    table = ph.phrase_table(occ).collect()
    assert len(table) == 1 and table[0].occurrence_count == 10 and table[0].first_unit == 10
    assert rows(ph.masked_ranges(occ).where("unit_id = 11")) == [(11, 2, 4)]


def test_masked_unit_is_no_first_instance(spark):
    texts = {i: f"w{i} x y z" for i in range(10)}
    texts.update({20: "q x y z", 21: "q x y z", 22: "q x y z"})  # 20 is first of its text but its ending is masked
    units, tokens = corpus(spark, texts)
    occ = ph.phrase_occurrences(units, tokens).cache()
    assert rows(ph.first_instance_units(occ)) == [(0,)]
    assert ph.first_instance_conflicts(occ).first().asDict() == {"claimed": 2, "conflicts": 1}


def test_item_outside_the_range_still_counts(spark):
    _, tokens = corpus(spark, {1: "a b a", 2: "a b"})
    ranges = spark.createDataFrame([(1, 2, 3), (2, 1, 2)], "unit_id long, start_pos long, end_pos long")
    sets = co.item_sets(co.item_occurrences(co.flag_masked(tokens, ranges), {"lemma": "lemma"}))
    assert rows(sets, "unit_id", "item", "in_reduced") == [(1, "a", True), (1, "b", False), (2, "a", False), (2, "b", False)]
    assert rows(co.mask_ranges(tokens, ranges), "unit_id", "pos") == [(1, 1)]


def test_denominators_differ(spark):
    tokens = spark.createDataFrame([(1, "s", 1, "x", None), (2, "s", 1, "y", "y")], TOKENS)
    flagged = co.flag_masked(tokens, None)
    sets = co.item_sets(co.item_occurrences(flagged, {"lemma": "lemma"}))
    assert {r.n_total for r in co.unit_totals(sets).collect()} == {1}
    assert {r.n_scope for r in co.unit_scopes(flagged).collect()} == {2}


@pytest.mark.parametrize("block", [2, 5, 256])
def test_pairs_of_large_units_are_complete(spark, block):
    rng = random.Random(block)
    units = {u: {f"i{rng.randint(0, 40):02d}" for _ in range(rng.randint(1, 40))} for u in range(12)}
    sets = spark.createDataFrame([("t", u, i) for u, items in units.items() for i in items], "item_type string, unit_id long, item string")
    got = rows(co.unit_pairs(sets, p=Params(pair_block=block)), "unit_id", "item_a", "item_b")
    want = sorted((u, a, b) for u, items in units.items() for a, b in itertools.combinations(sorted(items), 2))
    assert sorted(got) == want


@pytest.mark.parametrize("step,low", [(1, 0), (10**16, 0), (1, 10**18), (3 * 10**17, -9 * 10**18)])
def test_pair_rows_against_brute_force(spark, step, low):
    rng = random.Random(5)
    data, brute = [], {}
    for u in range(low, low + 60 * step, step):  # wide and negative unit ids need the wide packing
        section = f"s{rng.randint(0, 3)}"
        items = {f"i{rng.randint(0, 7)}" for _ in range(rng.randint(1, 6))}
        flags = {i: rng.random() < 0.7 for i in items}
        data += [("t", u, section, i, flags[i]) for i in items]
        for a, b in itertools.combinations(sorted(items), 2):
            brute.setdefault(("raw", a, b), []).append((u, section))
            if flags[a] and flags[b]:
                brute.setdefault(("phrase_reduced", a, b), []).append((u, section))
    sets = spark.createDataFrame(data, "item_type string, unit_id long, section string, item string, in_reduced boolean")
    firsts = {low + u * step for u in range(60) if u % 3 == 0}
    first_units = spark.createDataFrame([(u,) for u in firsts], "unit_id long")
    got = {(r.variant, r.item_a, r.item_b): r for r in co.pair_rows(sets, first_units, Params(floor_item=1)).collect()}
    assert set(got) == set(brute)
    for key, hits in brute.items():
        sections = [s for _, s in sorted(hits)]
        best = max(dict.fromkeys(sections), key=lambda s: (sections.count(s), -sections.index(s)))
        first = sum(u in firsts for u, _ in hits) if key[0] != "raw" else 0
        r = got[key]
        assert (r.n_ab, r.n_ab_first_instance, r.top_section) == (len(hits), first, best)
        assert r.top_share == pytest.approx(sections.count(best) / len(hits))


def test_pair_table_properties(spark):
    units, tokens = corpus(spark, {u: f"c{u % 3} common w{u % 5} x y z" for u in range(40)}, section=lambda u: f"s{u % 4}")
    occ = ph.phrase_occurrences(units, tokens).cache()
    table = co.collocation_table(tokens, {"lemma": "lemma"}, ph.masked_ranges(occ), ph.first_instance_units(occ)).cache()
    wide = sv.variant_compare(table)
    assert wide.where("n_ab_reduced > n_ab_raw").count() == 0
    assert table.where("item_a >= item_b or n_ab > least(n_a, n_b) or p < 0 or p > 1").count() == 0
    masked = ph.masked_ranges(occ).select("unit_id")
    assert ph.first_instance_units(occ).join(masked, "unit_id", "left_semi").count() == 0


def test_spans_across_tokens(spark):
    units = spark.createDataFrame([(1, "ab cd"), (2, "ab  cd")], "unit_id long, text string")
    tokens = spark.createDataFrame([(1, 1, 11, "ab"), (1, 2, 12, "cd"), (2, 1, 21, "ab"), (2, 2, 22, "cd")],
                                   "unit_id long, pos int, token_id long, form string")
    anns = spark.createDataFrame([(1, 0, "r", 1, 4), (1, 1, "space", 2, 3), (2, 0, "r", 0, 2)],
                                 "unit_id long, group_id int, rule string, start int, end int")
    kept = sp.guarded_annotations(anns, units, tokens)
    got = rows(sp.project_spans(kept, sp.token_offsets(tokens)).select(
        "token_id", "rule", "seg_start", "seg_end", "is_start", "is_end", "spans_tokens"))
    assert got == [(11, "r", 1, 2, True, False, True), (12, "r", 0, 1, False, True, True)]


def test_long_spans_are_found_once(spark):
    tokens = spark.createDataFrame([(1, i + 1, i, "x" * (i % 90 + 1)) for i in range(60)], "unit_id long, pos int, token_id long, form string")
    placed = sp.token_offsets(tokens)
    plain = {r.token_id: (r.tok_start, r.tok_end) for r in placed.collect()}
    spans = [(g, g * 37, g * 37 + 5 + g * 11) for g in range(30)]
    anns = spark.createDataFrame([(1, g, "r", s, e) for g, s, e in spans], "unit_id long, group_id int, rule string, start int, end int")
    got = rows(sp.project_spans(anns, placed).select("group_id", "token_id", "seg_start", "seg_end"))
    want = sorted(((g, t, max(s, a) - a, min(e, b) - a) for g, s, e in spans for t, (a, b) in plain.items() if s < b and e > a),
                  key=lambda r: tuple((True, str(v)) for v in r))
    assert got == want


def test_running_total_over_blocks(spark):
    df = spark.createDataFrame([("k", i, i * 3) for i in range(1, 50)], "k string, pos int, v int")
    got = rows(running_total(df, "k", "pos", F.col("v"), "before", block=7).select("pos", "before"))
    assert sorted(got) == [(i, sum(j * 3 for j in range(1, i))) for i in range(1, 50)]


def test_global_rank(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.col("id") % 13)
    got = with_global_rank(df, [F.desc("v"), F.asc("id")], "rank").orderBy("rank").collect()
    assert [(r.v, r.id) for r in got] == sorted(((i % 13, i) for i in range(1000)), key=lambda t: (-t[0], t[1]))
    assert [r["rank"] for r in got] == list(range(1, 1001))


def test_refs(spark):
    df = spark.createDataFrame([("1:6-7",), ("4:69",), ("23:1-11",), ("x",), ("2:5-2",), ("1:99999999999",)], "ref string")
    counts = {r.ref: r.n for r in rt.expand_refs(df).groupBy("ref").agg(F.count("*").alias("n")).collect()}
    assert counts == {"1:6-7": 2, "4:69": 1, "23:1-11": 11}
    assert rows(rt.bad_refs(df), "ref", "error") == [("1:99999999999", "bad_format"), ("2:5-2", "end_before_start"), ("x", "bad_format")]


def test_siblings_without_other_members_give_nothing(spark):
    members = spark.createDataFrame([("f", "root", "a", "confirmed")], "field_id string, member_type string, item string, status string")
    tokens = spark.createDataFrame([(1, 1, "a", "l"), (2, 1, "b", "l")], "token_id long, unit_id long, root string, lemma string")
    items = spark.createDataFrame([("a",)], "item string")
    assert rt.occurrences_by_field(tokens, members, items).count() == 0


def test_edge_with_both_ends_counts_once(spark):
    edges = spark.createDataFrame([(1, 10, 20, "r", "confirmed"), (2, 30, 10, "r", "confirmed"), (3, 10, 40, "r", "draft")],
                                  "edge_id long, a long, b long, relation string, status string")
    chosen = spark.createDataFrame([(10,), (20,)], "unit_id long")
    assert rows(rt.related_units(edges, chosen), "edge_id", "unit_id") == [(1, 20), (2, 30)]


def test_changed_partner_outside_the_top_is_shown(spark):
    data = []
    for variant in ("raw", "phrase_reduced"):
        for i in range(6):
            significant = not (i == 5 and variant != "raw")
            data.append(("t", variant, "x", f"y{i}", 3, 1.0, float(100 - i), significant))
    table = spark.createDataFrame(data, "item_type string, variant string, item_a string, item_b string, n_ab long, expected double, g2 double, fdr_significant boolean")
    view = sv.with_direction(sv.partner_view(table))
    shown = sv.top_n_forced(view, 2).where("item = 'x' and variant = 'raw'")
    assert rows(shown, "partner") == [("y0",), ("y1",), ("y5",)]
    total = sv.shown_total(view, sv.top_n_forced(view, 2)).where("item = 'x' and variant = 'raw'").first()
    assert (total.shown, total.total) == (3, 6)


def test_json_from_text(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("[1]",), ("\"text\"",), ("{broken",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.json_from_text(F.col("t"))).collect()] == ['{"a": 1}', "[1]", None, None, None]


def test_normalize_arabic(spark):
    df = spark.createDataFrame([("ٱلرَّحِيمِ أَآإـ",)], "t string")
    assert df.select(tx.normalize_text(F.col("t"))).first()[0] == "الرحيم ااا"


def test_cited_ids_and_strings():
    node = {"x": [{"unit_id": 7}], "cited_unit_ids": [1, "2", "n", True, {"UNIT_ID": "8"}], "unit_idx": 5, "unit_ids": 9}
    assert au.ids_in(node, "unit_id") == ([7, 1, 2, 8], [])
    assert au.strings_in({"a": "x", "b": [{"c": "y"}, 3, "z"]}) == ["x", "y", "z"]


def test_subset(spark):
    payload = spark.createDataFrame([(1, '{"x":[{"unit_id":7}],"cited_unit_ids":[1,"2"]}'), (2, "{}"), (3, "no json")], "output_id long, payload string")
    cited = payload.select("output_id", au.cited_ids(F.col("payload")).alias("ids"))
    allowed = spark.createDataFrame([(1, 1), (1, 2)], "output_id long, id long")
    assert rows(au.check_subset(cited, allowed), "output_id", "checked", "violations", "passed") == [
        (1, 3, [7], False), (2, 0, [], True), (3, 0, [], True)]


def texts(spark, data, key):
    return spark.createDataFrame(list(data.items()), f"{key} long, text_norm string")


def test_exact_leaks_against_brute_force(spark):
    rng = random.Random(11)
    words = ["a", "be", "cat", "dogs", "eagle", "antelope", "the", "of"]
    passages, outputs = {}, {}
    for i in range(60):
        passages[i] = " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
    passages.update({100: "longunbrokenpassage", 101: "--------------------", 102: "unbroken passage", 103: "x yyyyyyyyyyyyyyy"})
    for i in range(40):
        parts = [rng.choice(words + [passages[rng.choice(list(passages))]]) for _ in range(12)]
        outputs[i] = rng.choice([" ", ", ", "-"]).join(parts)
    outputs[100] = "averylongunbrokenpassageindeed ---------------------- unbroken passages; axx yyyyyyyyyyyyyyyz"
    got = rows(au.leak_exact(texts(spark, outputs, "output_id"), texts(spark, passages, "passage_id")))
    want = sorted((o, p) for o, t in outputs.items() for p, s in passages.items() if len(s) >= 15 and s in t)
    assert sorted(got) == want and {p for o, p in want if o == 100} == {100, 101, 102, 103}


def brute_fuzzy(outputs, passages, exact):
    found = {}
    for o, t in outputs.items():
        for p, s in passages.items():
            if len(s) < 15 or (o, p) in exact or len(t) < len(s):
                continue
            for i in range(0, len(t) - len(s) + 1, max(1, len(s) // 3)):
                pct = au.similarity(t[i:i + len(s)].encode(), s.encode())
                if pct >= 85.0:
                    found[(o, p)] = round(pct, 1)
                    break
    return found


def test_fuzzy_leaks_against_brute_force(spark):
    rng = random.Random(2)
    letters = "abcdefghij éع "
    passages = {i: "".join(rng.choice(letters) for _ in range(rng.randint(12, 70))).strip() or "x" for i in range(25)}
    outputs = {}
    for i in range(50):
        s = list(passages[rng.randrange(25)])
        for _ in range(rng.randint(0, max(1, len(s) // 6))):
            s[rng.randrange(len(s))] = rng.choice(letters)
        lead = "".join(rng.choice(letters) for _ in range(rng.choice([0, 0, len(s) // 3, len(s) // 6])))
        outputs[i] = lead + "".join(s) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
    o, p = texts(spark, outputs, "output_id"), texts(spark, passages, "passage_id")
    exact = au.leak_exact(o, p)
    pairs = {tuple(r) for r in exact.collect()}
    want = brute_fuzzy(outputs, passages, pairs)
    got = {(r.output_id, r.passage_id): r.similarity for r in au.leak_fuzzy(o, p, exact).collect()}
    assert len(want) > 5 and got == want


def test_fuzzy_leaks_in_small_cells(spark, monkeypatch):
    """The same with cells, steps and batches so small that every kind of seam is met, and texts longer than a step."""
    rng = random.Random(3)
    letters = "abcdef gé"
    passages = {i: "".join(rng.choice(letters) for _ in range(rng.randint(15, 60))).strip() + "xyz" for i in range(20)}
    outputs = {}
    for i in range(40):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
        for _ in range(3):
            s = list(passages[rng.randrange(20)])
            for _ in range(rng.randint(0, len(s) // 8)):
                at = rng.randrange(len(s))
                s[at] = rng.choice(["", rng.choice(letters), s[at] + rng.choice(letters)])
            text += "".join(s) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        outputs[i] = text
    o, p = texts(spark, {**outputs, 100: None, 101: ""}, "output_id"), texts(spark, passages, "passage_id")
    exact = au.leak_exact(o, p)
    want = brute_fuzzy(outputs, passages, {tuple(r) for r in exact.collect()})
    monkeypatch.setattr(au, "CELL_BYTES", 700)
    monkeypatch.setattr(au, "BLOCK_BYTES", 200)
    monkeypatch.setattr(au, "_STEP", 37)
    monkeypatch.setattr(au, "_HITS", 50)
    got = {(r.output_id, r.passage_id): r.similarity for r in au.leak_fuzzy(o, p, exact).collect()}
    assert len(want) > 10 and got == want
    assert au.leak_fuzzy(o.where("false"), p, exact).count() == au.leak_fuzzy(o, p.where("false"), exact).count() == 0


def test_window_phase_matters(spark):
    passage = "the quick brown fox jumps over the lazy dog near the old river bank at dawn today"
    altered = passage.replace("river", "water")
    shift = len(passage) // 6
    outputs = {1: altered + " and so on", 2: "z" * shift + altered + " and so on", 3: passage}
    o, p = texts(spark, outputs, "output_id"), texts(spark, {1: passage, 2: "too short"}, "passage_id")
    exact = au.leak_exact(o, p)
    assert rows(exact) == [(3, 1)]
    assert rows(au.leak_fuzzy(o, p, exact), "output_id", "passage_id") == [(1, 1)]
    allowed = spark.createDataFrame([(1, 1), (3, 1)], "output_id long, passage_id long")
    assert au.leak_exact(o, p, allowed).count() == 0 and au.leak_fuzzy(o, p, exact, allowed).count() == 0


def test_common_subsequence():
    rng = random.Random(1)
    first, second = [], []
    for _ in range(80):
        first.append(bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 150))))
        second.append(bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 150))))

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], row
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
        return row[-1]

    assert au.common_subsequence(first, second).tolist() == [slow(a, b) for a, b in zip(first, second)]


def test_failed_ids_stop_the_scan(spark):
    subset = spark.createDataFrame([(1, 1, [9], False), (2, 0, [], True)], "output_id long, checked long, violations array<long>, passed boolean")
    passage = "a protected passage of text"
    o = texts(spark, {1: passage, 2: passage}, "output_id")
    got = au.grounding_verdict(subset, o, texts(spark, {1: passage}, "passage_id"))
    assert rows(got, "output_id", "n_exact", "passed") == [(1, 0, False), (2, 1, False)]
    reasons = dict(rows(au.violation_summary(got)))
    assert reasons[1] == "ids outside the retrieved set: 9" and reasons[2] == "protected passages: 1 exact, 0 near"


def test_reorder_skips_locked_and_unknown(spark):
    entries = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "entry_id long, is_locked boolean")
    wanted = spark.createDataFrame([(4, 1), (1, 1), (2, 1), (3, 0), (99, 1)], "entry_id long, position int")
    assert rows(se.dense_reorder(entries, wanted)) == [(1, 2), (3, 1), (4, 3)]


def test_csv_with_bad_row(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,text\n1,"two\nlines, ""quoted"""\n2,x,y,z\n')
    got = rows(tb.read_csv(spark, str(path), "id INT, text STRING").select("id", "text", F.col("_corrupt_record").isNotNull()))
    assert got[0] == (1, 'two\nlines, "quoted"', False) and got[1][2] is True


def test_json_map(spark, tmp_path):
    path = tmp_path / "spans.json"
    path.write_text('{"5": [{"rule": "r", "start": 0, "end": 2}],\n "6": []}')
    assert rows(tb.read_json_map(spark, str(path)).select("unit_id", F.size("spans"))) == [(5, 1), (6, 0)]


def test_alignment(spark):
    units = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, ""), (4, "x")], "unit_id long, text string")
    tokens = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b"), (4, 1, "y")], "unit_id long, pos int, form string")
    assert rows(ig.alignment_check(units, tokens)) == [(1, True), (2, False), (3, True), (4, False)]


def test_hostile_payloads_end_no_job(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows_ = [(1, '{"unit_id": 1e999}'), (2, '{"unit_id": NaN}'), (3, '{"unit_id": 12345678901234567890}'), (4, '{"unit_id": "' + "9" * 40 + '"}'),
             (5, '{"a": 1, "unit_id": ' + deep + "}"), (6, '{"unit_id": '), (7, None), (8, '{"unit_id": [1, {"unit_id": 2}, [3]], "x": "unit_id"}'),
             (9, '{"unit\\u005fid": 5}'), (10, '{"unit_ids": {"unit_ids": [1, 2], "k": 4}}'), (11, '"unit_id"')]
    df = spark.createDataFrame(rows_, "i int, payload string").select("i", au.scan_citations(F.col("payload")).alias("s"))
    got = {r.i: (list(r.s.ids), len(r.s.rejected)) for r in df.collect()}
    assert got == {1: ([], 1), 2: ([], 1), 3: ([], 1), 4: ([], 1), 5: ([], 1), 6: ([], 1), 7: ([], 0), 8: ([1, 2], 0), 9: ([5], 0),
                   10: ([4], 0), 11: ([], 0)}


def test_citations_without_python(spark):
    """The level-wise walk gives what the walk in Python gives; it refuses more only where Spark's parser does."""
    rng = random.Random(5)

    def node(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.35:
            return rng.choice([1, -7, "2", " 31 ", "x", "1e3", 2.75, True, None, 2**63, "9" * 40, "-9223372036854775808", ".5", {}, []])
        if kind < 0.65:
            return [node(depth - 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(["unit_id", "cited_UNIT_IDS", "unit_ids", "a", "my_unit_id", "unit_idx", "b"]): node(depth - 1)
                for _ in range(rng.randint(0, 4))}

    payloads = [json.dumps(node(6)) for _ in range(300)] + [
        '{"unit_id": 1e999}', '{"unit_id": NaN}', '{"unit_id": 12345678901234567890}', '{"unit_id": ', None, '{"unit\\u005fid": 5}',
        '{"unit_ids": {"unit_ids": [1, 2], "k": 4}}', '"unit_id"', '{"a": 1, "unit_id": ' + "[" * 100_000 + "]" * 100_000 + "}",
        '{"unit_id": ' + "[" * 30 + "3" + "]" * 30 + ', "deep": ' + '{"a":' * 30 + '{"unit_id": 6}' + "}" * 30 + "}"]
    df = spark.createDataFrame(list(enumerate(payloads)) + [(1000, payloads[0]), (1000, payloads[1])], "output_id int, payload string")
    want = {}
    for r in df.select("output_id", au.scan_citations(F.col("payload")).alias("s")).collect():
        ids, rejected = want.get(r.output_id, ([], 0))
        want[r.output_id] = (sorted(ids + r.s.ids), rejected + len(r.s.rejected))
    got = au.cited_rows(df)
    assert {r.output_id: (sorted(r.ids), len(r.rejected)) for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_strings_of_payloads(spark):
    payloads = ['{"z": "first", "a": ["se\\"cond", {"k": "\\u00e9\\n"}], "m": {"z": "", "b": 5}}', '"alone"', "[]", "{broken", None,
                '["' + "x\\\\y" * 50_000 + '"]', '{"a:" : "b", "c": ":"}', '["a", 1, true, null, "b"]']
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, payload string").select(
        "i", au.flatten_strings(F.col("payload")).alias("flat"))
    want = {i: " ".join(au.strings_in(au._load(p)[0])) for i, p in enumerate(payloads)}
    assert {r.i: r.flat for r in df.collect()} == want
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_promotion_history_has_one_open_interval(spark):
    from lexispark.operators import publish as pu
    log = [(3, "b", 20, "again", True), (1, "a", 10, "first", True), (2, "c", 15, None, False), (4, "a", 20, "back", True), (5, "a", 31, "", True)]
    decisions = spark.createDataFrame(log + log, "request_id int, build string, at int, reason string, accepted boolean")
    history = pu.promotion_history(decisions)
    assert rows(history, "seq", "request_id", "build", "reason", "valid_from", "valid_to") == [
        (1, 1, "a", "first", 10, 20), (2, 3, "b", "again", 20, 20), (3, 4, "a", "back", 20, 31), (4, 5, "a", "", 31, None)]
    moments = spark.createDataFrame([(9,), (10,), (19,), (20,), (30,), (99,)], "moment int")
    assert rows(pu.build_at(history, moments)) == [(10, "a"), (19, "a"), (20, "a"), (30, "a"), (9, None), (99, "a")]
    assert pu.promotion_history(decisions.where("false")).count() == 0


def test_values_at_addresses(spark):
    from lexispark.operators import publish as pu
    table = spark.createDataFrame([(1, "x", 5, None, "t"), (1, "y", 7, 2.5, "u")], "build int, item string, n long, d double, s string")
    wanted = spark.createDataFrame(
        [(1, "x", "n", "equals", 5.0, 0.5), (1, "x", "d", "is_null", None, None), (1, "y", "d", "differs", 0.0, None),
         (1, "y", "n", "equals", 9.0, 1.0), (1, "z", "n", "is_null", None, None), (1, "y", "nothing", "is_null", None, None)],
        "build int, item string, column string, rule string, expected double, tolerance double")
    observed = pu.observed_values(table, ["build", "item"], wanted)
    assert rows(observed, "item", "column", "value") == [("x", "d", None), ("x", "n", 5.0), ("y", "d", 2.5), ("y", "n", 7.0)]
    checked = pu.verify(observed, wanted, ["build", "item", "column"])
    assert rows(checked, "item", "column", "status") == [
        ("x", "d", "PASS"), ("x", "n", "PASS"), ("y", "d", "PASS"), ("y", "n", "FAIL"), ("y", "nothing", "FAIL"), ("z", "n", "FAIL")]


def test_readers_survive_a_failed_reload(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    good = spark.range(100).withColumn("v", F.lit("old"))
    assert tb.overwrite_table(good, path) == 100
    before = tb.read_published(spark, path)
    broken = spark.range(0, 1000, 1, 8).select("id", F.when(F.col("id") < 900, "new").otherwise(
        F.raise_error(F.lit("half-way")).cast("string")).alias("v"))
    with pytest.raises(Exception, match="half-way"):
        tb.overwrite_table(broken, path)
    with pytest.raises(tb.Refused):
        tb.overwrite_table(good.limit(3), path, least=50)
    assert rows(tb.read_published(spark, path).groupBy("v").count()) == [("old", 100)]
    assert tb.overwrite_table(good.withColumn("v", F.lit("new")), path) == 100
    assert rows(tb.read_published(spark, path).groupBy("v").count()) == [("new", 100)]
    assert before.where("v = 'old'").count() == 100         # who began to read the old version still can
    assert tb.retire_versions(spark, path) == 1 and tb.read_published(spark, path).count() == 100
    with pytest.raises(FileNotFoundError):
        tb.read_published(spark, f"file://{tmp_path}/none")


def test_counts_of_an_insert_come_with_the_write(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")] * 5 + [(3, None)], "k int, v string")
    assert tb.insert_unique_published(df, ["k"], path) == (16, 3)
    with pytest.raises(tb.Refused):
        tb.insert_unique_published(df.unionByName(df), ["k"], path, most_missing=20)
    assert rows(tb.read_published(spark, path)) == [(1, "a"), (2, "c"), (3, None)]


def test_only_touched_partitions_are_written(spark, tmp_path):
    import os
    path = f"{tmp_path}/table"
    base = spark.range(40).select("id", (F.col("id") * 10).alias("v"), (F.col("id") % 4).cast("int").alias("p"))
    base.repartition(2).write.partitionBy("p").parquet(path)
    stamp = lambda: {f: os.stat(os.path.join(folder, f)).st_mtime_ns for folder, _, files in os.walk(path) for f in files
                     if f.endswith(".parquet") and "p=1" not in folder}
    before = stamp()
    delta = spark.createDataFrame([(1, 7), (1, 9), (5, -1), (400, 3)], "id long, v long")
    assert tb.update_partitions(spark, path, delta, "id", "v", ["p"]) == 1
    assert stamp() == before
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert got == {**{i: i * 10 for i in range(40)}, 1: 9, 5: -1}
    assert tb.update_partitions(spark, path, delta.where("id = 400"), "id", "v", ["p"]) == 0
    broken = spark.range(0, 8, 1, 2).select("id", F.when(F.col("id") < 7, F.col("id")).otherwise(
        F.raise_error(F.lit("half-way")).cast("long")).alias("v"), F.lit(2).alias("p"))
    with pytest.raises(Exception, match="half-way"):
        tb.replace_partitions(broken, path, ["p"])
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == got


def test_layers_of_many_items(spark):
    tokens = spark.createDataFrame([(1, 10, "x", "m"), (2, 10, "x", "n"), (3, 20, "y", "m"), (4, 30, "z", None), (5, 40, None, "q")],
                                   "token_id long, unit_id long, root string, lemma string")
    members = spark.createDataFrame([("f", "root", "x", "confirmed"), ("f", "root", "y", "confirmed"), ("f", "lemma", "q", "confirmed"),
                                     ("g", "root", "z", "confirmed"), ("g", "root", "x", "proposed")],
                                    "field_id string, member_type string, item string, status string")
    edges = spark.createDataFrame([(1, 10, 30, "r", "confirmed"), (2, 20, 10, "r", "confirmed"), (3, 10, 10, "r", "confirmed"),
                                   (4, 30, 40, "r", "proposed")], "edge_id long, a long, b long, relation string, status string")
    items = spark.createDataFrame([("x",), ("y",), ("z",), ("none",), ("x",)], "item string")
    layers = rt.item_layers(tokens, members, edges, items)
    assert rows(layers, "item", "layer", "unit_id", "ref_id") == [
        ("x", 1, 10, 1), ("x", 1, 10, 2), ("x", 2, 20, 3), ("x", 2, 40, 5), ("x", 3, 10, 3), ("x", 3, 20, 2), ("x", 3, 30, 1),
        ("y", 1, 20, 3), ("y", 2, 10, 1), ("y", 2, 10, 2), ("y", 2, 40, 5), ("y", 3, 10, 2),
        ("z", 1, 30, 4), ("z", 3, 10, 1)]
    assert rows(rt.units_of_layers(layers), "item", "unit_id", "layer") == [
        ("x", 10, 1), ("x", 20, 2), ("x", 30, 3), ("x", 40, 2), ("y", 10, 2), ("y", 20, 1), ("y", 40, 2), ("z", 10, 3), ("z", 30, 1)]
    shown = {r["item"]: [(e.layer, e.total, [p.ref_id for p in e.preview or []]) for e in r.retrieval]
             for r in rt.layer_previews(layers, items, 1).collect()}
    assert shown == {"x": [(1, 2, [1]), (2, 2, [3]), (3, 3, [3])], "y": [(1, 1, [3]), (2, 3, [1]), (3, 1, [2])],
                     "z": [(1, 1, [4]), (2, 0, []), (3, 1, [1])], "none": [(1, 0, []), (2, 0, []), (3, 0, [])]}


def test_search_from_an_index(spark):
    rng = random.Random(8)
    letters = "abcé"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    data = [(i, word(rng.randint(0, 7)), word(rng.randint(1, 5)), word(rng.randint(0, 6)) or None) for i in range(400)]
    tokens = spark.createDataFrame(data + [(400, None, "abc", None), (401, "", "", "")],
                                   "token_id long, form string, norm string, lemma string")
    asked = [(i, word(rng.randint(0, 5)), word(rng.randint(0, 4))) for i in range(40)] + [(40, "zz", "zz"), (41, "aaaaaaa", ""), (42, None, "a"), (43, "ab", None)]
    queries = spark.createDataFrame(asked, "query_id long, query string, query_norm string")
    got = {}
    for r in se.search_tokens_many(se.search_index(tokens), queries, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.norm, r.token_id, r.occurrences))
    every = [tuple(r) for r in tokens.collect()]
    for i, q, qn in asked:
        first = {}
        for token, form, norm, lemma in every:
            if (q and (q in (form or "") or q in (lemma or ""))) or (qn and norm.startswith(qn)):
                first[norm] = min(first.get(norm, token), token)
        best = sorted(first.items(), key=lambda x: (len(x[0]), x[1]))[:5]
        want = [(k, norm, t, sum(e[2] == norm for e in every)) for k, (norm, t) in enumerate(best, 1)]
        assert sorted(got.get(i, [])) == want, (i, q, qn)


def test_ranks_within_groups(spark):
    from lexispark.session import with_group_rank
    data = [(g, v) for g in ("a", "b", None) for v in (3, 1, 2, 2)] + [("c", None)]
    df = spark.createDataFrame(data, "g string, v int").repartition(3)
    got = rows(with_group_rank(df, ["g"], [F.desc("v")], "place"), "g", "v", "place")
    assert got == rows(spark.createDataFrame([(g, v, p) for g in ("a", "b", None) for p, v in enumerate((3, 2, 2, 1), 1)] + [("c", None, 1)],
                                             "g string, v int, place long"))


def test_bundles_move_tokens_once(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "unit_id long")
    tokens = spark.createDataFrame([(1, 11, 1, "b"), (1, 12, 0, "a"), (2, 21, 0, "c")], "unit_id long, token_id long, pos int, form string")
    glosses = spark.createDataFrame([(1, 12, "of a"), (1, 99, "of nobody")], "unit_id long, token_id long, gloss string")
    segments = spark.createDataFrame([(2, 21, [("r", 0)])], "unit_id long, token_id long, segments array<struct<rule:string,start:int>>")
    labels = spark.createDataFrame([(1, "l")], "unit_id long, label string")
    texts = spark.createDataFrame([(3, "t")], "unit_id long, text string")
    got = rt.unit_bundle(units, tokens, labels, texts, glosses, segments)
    plain = {r.unit_id: (r.label, r.text, [tuple(t) for t in r.tokens or []]) for r in got.collect()}
    assert plain == {1: ("l", None, [(0, 12, "a", "of a", None), (1, 11, "b", None, None)]),
                     2: (None, None, [(0, 21, "c", None, [("r", 0)])]), 3: (None, "t", [])}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_lines_are_numbered_without_bounds(spark, tmp_path):
    """More lines than 2**20 in one document, and document ids near the end of a long."""
    from lexispark.sources.adapters import line_units
    docs = [(10**12, "s", "a\n" * (2**20 + 5)), (2**62, "s", "b\n\nc"), (-5, "s", "x")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    units = line_units(spark, str(tmp_path)).select("unit_id", "doc_id", "text")
    assert units.count() == units.select("unit_id").distinct().count() == 2**20 + 5 + 3
    last = {r.text: r.unit_id for r in units.where("text in ('b', 'c', 'x')").collect()}
    assert last == {"x": 1, "b": 1 + 2**20 + 6 + 1, "c": 1 + 2**20 + 6 + 3}


def test_a_long_range_is_not_spread_over_missing_units(spark):
    from lexispark.operators import retrieval as rt
    refs = spark.createDataFrame([("1:1-2000000000",), ("1:5",), ("2:1",)], "ref string")
    units = spark.createDataFrame([(1, 1), (1, 5), (1, 9000), (3, 1)], "section int, seq int")
    assert sorted((r.ref, r.seq) for r in rt.units_of_refs(refs, units).collect()) == [
        ("1:1-2000000000", 1), ("1:1-2000000000", 5), ("1:1-2000000000", 9000), ("1:5", 5)]


def test_release_deletes_what_was_settled(spark, monkeypatch):
    import os
    from lexispark import session
    monkeypatch.setattr(session, "_settled", {})
    path = session.settle(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert session.release(spark) == 1 and not os.path.exists(path) and session.release(spark) == 0
