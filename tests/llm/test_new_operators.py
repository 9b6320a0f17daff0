"""Decontamination, hard negatives and the filter audit against brute force on awkward rows."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import decontaminate, filter_audit, hard_negatives
from tests.llm.cases import SCHEMA, awkward, words_of


def counted(rows):
    out = {}
    for row in rows:
        out[row] = out.get(row, 0) + 1
    return out


# ---- 11 decontamination --------------------------------------------------------------------------

def item_words(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def shared_places(a, b, size):
    return sum(a[i:i + size] == b[i:i + size] for i in range(len(b) - size + 1))


def brute_contamination(docs, items, percent):
    windows = {}
    for name, text in items:
        w = item_words(text)
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(name)
    out = []
    for key, text in docs:
        w, hit, named = item_words(text), set(), set()
        for window, names in windows.items():
            size = min(3, len(window))
            need = math.ceil((len(window) - size + 1) * percent / 100)
            for i in range(len(w) - len(window) + 1):
                if shared_places(tuple(w[i:i + len(window)]), window, size) >= need:
                    hit.update(range(i, i + len(window)))
                    named |= {n for n in names if n is not None}
        out.append((key, len(w), len(hit), len(named), tuple(sorted(map(str, named))), bool(hit)))
    return out


def benchmark_rows(rng):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (10, 11, 25, 40, 9, 2, 1, 3)]
    texts += [texts[2], "the same " * 12, "É日本 naïve FAÇADE", "", "?!", None, "zz"]
    return [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(2, texts[2]), (100, texts[3]), (11, texts[0])]


@pytest.mark.parametrize("percent", [100, 70])
def test_contamination(spark, percent):
    rng = random.Random(7)
    items = benchmark_rows(rng)
    docs = [(i, t) for i, (_, t) in enumerate(items)]
    for n in range(40):
        item = item_words(rng.choice(items)[1])
        if len(item) > 4 and n % 2:
            item[rng.randrange(len(item))] = "other"
        before = [rng.choice("abcdef") for _ in range(rng.randrange(30))]
        docs.append((100 + n, "\n".join([*before, *[w.upper() if n % 3 else w for w in item], *before[:4], *item])))
    docs += [(None, docs[20][1]), (None, None), docs[21], docs[21], (500, ""), (501, "w1, " * 20000 + docs[3][1])]
    table = spark.createDataFrame([(*d, 1, "x", 3) for d in docs], "doc_id long, text string, n_hit int, item_id string, h int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(table.repartition(3), bench, percent=percent)
    assert counted((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in got.collect()) \
        == counted(brute_contamination(docs, items, percent))


def test_contamination_without_broadcasts(spark, monkeypatch):
    rng = random.Random(7)
    items = benchmark_rows(rng)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = decontaminate.contamination(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 10)     # a crowded bit table lets wrong places through, no more
    assert counted(map(str, decontaminate.contamination(docs, bench).collect())) == counted(map(str, small))


def test_contamination_of_nothing(spark):
    docs = awkward(spark)
    no_docs = spark.createDataFrame([], SCHEMA)
    no_items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "A b C d e")], "item_id long, text string")
    assert decontaminate.contamination(no_docs, some).count() == 0
    clean = decontaminate.contamination(docs, no_items)
    assert clean.count() == docs.count() and clean.where("contaminated or n_hit > 0 or n_items > 0").count() == 0


# ---- 12 hard negatives ---------------------------------------------------------------------------

def brute_negatives(rows, anchors, scale=256, positives=5, negatives=3):
    taking = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(scale * x) for x in vector]
        taking[key] = min(taking.get(key, (label, whole)), (label, whole))
    out = []
    for a in taking:
        if not anchors(a):
            continue
        score = {k: sum(x * y for x, y in zip(taking[a][1], v)) for k, (_, v) in taking.items()}
        order = sorted((k for k in taking if k != a), key=lambda k: (-score[k], k))
        for p in [k for k in order if taking[k][0] == taking[a][0]][:positives]:
            inside = [k for k in order if taking[k][0] != taking[a][0] and 50 * score[p] <= 100 * score[k] <= 95 * score[p]]
            out += [(a, p, r, k, score[p], score[k]) for r, k in enumerate(inside[:negatives], 1)]
    return out


def vectors(seed, count, dims, spread=0.3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0.1, spread, dims).astype(np.float32)], int(rng.integers(0, 4)))
            for i in rng.permutation(count)]
    same = rows[0][1]
    rows = [(k, same if k % 3 == 0 else v, label) for k, v, label in rows]          # a third are one vector: ties
    odd = [(900, None, 1), (901, [math.nan] * dims, 1), (902, [math.inf] * dims, 2), (903, [None] * dims, 2),
           (904, [0.5] * dims, None), (None, [0.5] * dims, 1), (905, [], 1), (906, [0.5], 2), (907, [0.0] * dims, 3)]
    return rows + odd + [rows[1], rows[1]]


@pytest.mark.parametrize("dims, block, tile", [(8, 1 << 19, 1 << 20), (8, 200, 64), (600, 9000, 256)])
def test_hard_negatives(spark, dims, block, tile):
    rows = vectors(dims, 150, dims)
    table = spark.createDataFrame([(*r, 5, "x") for r in rows],
                                  "vec_id long, embedding array<float>, label int, score int, positives string")
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, block=block, tile=tile)
    expected = brute_negatives(rows, lambda k: k % 10 == 0)
    assert len(expected) > 20
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, [1.0], 1), (20, [1.0], 2)], schema)
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(10, [1e30], 1)], schema), F.col("vec_id") % 10 == 0)


@pytest.mark.parametrize("largest, dims", [(5, 3), (2000, 64), (10**6, 700), (3 * 10**7, 2000)])
def test_residue_scores_are_exact(largest, dims):
    rng = np.random.default_rng(dims)
    a = rng.integers(-largest, largest + 1, (9, dims))
    b = rng.integers(-largest, largest + 1, (13, dims))
    a[0], b[0], b[1] = largest, largest, -largest        # the bound itself, in both signs
    primes = hard_negatives.primes_for(largest * largest * dims)
    got = hard_negatives.Residues(a, primes).scores(hard_negatives.Residues(b, primes), 0, 9)
    assert (got == np.array([[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a])).all()


# ---- 13 filter audit -----------------------------------------------------------------------------

def brute_audit(rows, names):
    """rows: (part, set of failed filters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        lost = {n: 0 for n in names}
        for order in map("".join, permutations(names)):
            left = own
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[0]]
                left = [r for r in left if name not in r[0]]
                lost[name] += len(gone)
                out[part, order, step] = [
                    name, len(left), len(gone), sum(name in r[0] for r in own) - len(gone),
                    sum(r[0] == {name} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(lost[values[0]])
    return {key: tuple(values) for key, values in out.items()}


def as_audit(df):
    found = {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                                r.toxic_lost, r.shapley) for r in df.collect()}
    assert len(found) == df.count()
    return found


@pytest.mark.parametrize("names", ["A", "AB", "ABCD"])
def test_audit_of_masks(spark, names):
    rng = random.Random(len(names))
    rows = [(rng.choice(["", "x", "y"]), {n for n in names if rng.random() < 0.4}, rng.random() < 0.5, rng.random() < 0.2)
            for _ in range(200)]
    masks = [(part, sum(1 << names.index(n) for n in failed), 1, int(good), int(toxic), 9) for part, failed, good, toxic in rows]
    table = spark.createDataFrame(masks + [(None, 0, 0, 0, 0, 1)], "part string, mask int, n long, good long, toxic long, rank int")
    assert as_audit(filter_audit.interaction_audit(table, names)) == brute_audit(rows, names)


def test_audit_of_documents(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame(
        [(i, i % 2, i % 3 % 2, "x") for i in range(0, 60, 2)] + [(4, 1, None, ""), (4, None, 1, ""), (None, 1, 1, "")],
        "doc_id long, quality int, toxic int, text string")
    marks = {}
    for r in labels.collect():
        good, toxic = marks.get(r.doc_id, (False, False))
        marks[r.doc_id] = (good or r.quality == 1, toxic or r.toxic == 1)
    rows, listed = [], docs.select("doc_id", "text", "lang").collect()
    for r in listed:
        text = r.text or ""
        words = words_of(text)
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": r.doc_id is not None and any(
                o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == text for o in listed)}
        rows.append((r.lang or "", {n for n, f in failed.items() if f}, *(marks.get(r.doc_id, (False, False))
                                                                            if r.doc_id is not None else (False, False))))
    assert any("E" in r[1] for r in rows)
    got = filter_audit.interaction_audit(filter_audit.document_masks(docs, labels), "ABCDE")
    assert as_audit(got) == brute_audit(rows, "ABCDE")


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    masks = filter_audit.document_masks(spark.createDataFrame([], SCHEMA), labels)
    assert filter_audit.interaction_audit(masks, "ABCDE").count() == 0
    with pytest.raises(ValueError):
        filter_audit.interaction_audit(masks, "ABCDEFGH")
