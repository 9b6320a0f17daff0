"""Source mixing by given weights, and the two learners against plain loops over dictionaries."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexispark.llm import ftrl, ordinal, pfair
from lexispark.llm.hashed import distinct, word_features
from tests.llm.cases import corpus


def test_given_weights_hold_the_bound(spark):
    sizes = {"big": 900, "mid": 300, "small": 120, None: 200}
    weights = {"big": 1.0, "mid": 2.0, "small": 5.0, None: 0.5, "absent": 9.0}       # unlike the sizes
    rows = [(i, name) for name, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    mixed = pfair.mix_sources(docs, block=4, frame=64, weights=weights).orderBy("position").collect()
    assert len(mixed) == len(rows) and [r.position for r in mixed] == list(range(1, len(rows) + 1))
    counts = spark.createDataFrame([(k, n, weights[k]) for k, n in sizes.items()], "source string, n long, weight double")
    share = {r.source: Fraction(r.quanta, 64) for r in pfair.quanta(counts, 64).collect()}
    assert sum(share.values()) == 1 and share["small"] > share["mid"] > share["big"] > share[None]
    slots = {}
    for r in mixed:
        slots.setdefault(r.slot, r.source)
    ends = min(max(s for s, name in slots.items() if name == source) for source in sizes)      # a first source has run out
    taken = dict.fromkeys(sizes, 0)
    for slot in range(ends):
        taken[slots[slot]] += 1
        assert all(abs(taken[s] - share[s] * (slot + 1)) < 1 for s in sizes)
    table = spark.createDataFrame([(k, v) for k, v in weights.items()], "source string, weight double")
    assert pfair.mix_sources(docs, block=4, frame=64, weights=table).orderBy("position").collect() == mixed


def test_weights_that_do_not_fit_are_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    for weights in ({"a": 1.0}, {"a": 1.0, "b": 0.0}, {"a": 1.0, "b": -1.0}, {"a": 1.0, "b": math.inf}, {"a": 1.0, "b": math.nan}):
        with pytest.raises(ValueError):
            pfair.mix_sources(docs, weights=weights)
    twice = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "source string, weight double")
    with pytest.raises(ValueError):
        pfair.mix_sources(docs, weights=twice)
    monkeypatch.setattr(pfair, "MOST_SOURCES", 1)
    with pytest.raises(ValueError):
        pfair.mix_sources(docs)


def sample(spark, features, labels, bits):
    """Rows of (buckets, counts, label) in the order in which the learners get them."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn(
        "turn", F.xxhash64(F.col("doc_id").cast("string"))).collect()
    rows = []
    for r in docs:
        if r.doc_id in labels:
            _, buckets, counts = distinct(*features([r.text]), bits)
            rows.append((r.turn, labels[r.doc_id], buckets.tolist(), counts.tolist()))
    return [r[1:] for r in sorted(rows, key=lambda r: (r[0], r[1], len(r[2])))]


def test_toxicity_learner_against_a_plain_loop(spark):
    labels = {i: i % 3 % 2 for i, _ in corpus()}
    bits, features = ftrl.BITS, lambda texts: word_features(texts, ftrl.BITS, stems=ftrl.STEMS)
    rows = sample(spark, features, labels, bits)
    z, n, rate = {}, {}, (ftrl.ALPHA, ftrl.BETA, ftrl.L1, ftrl.L2)

    def weight(b):
        alpha, beta, l1, l2 = rate
        over = abs(z.get(b, 0.0)) - (0.0 if b == -1 else l1)
        return 0.0 if over <= 0 else -math.copysign(over, z[b]) / ((beta + math.sqrt(n[b])) / alpha + l2)

    for _ in range(ftrl.PASSES):
        for label, buckets, _ in rows:
            held = {b: weight(b) for b in [*buckets, -1]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(held.values()))))) - label
            for b, w in held.items():
                old = n.get(b, 0.0)
                z[b] = z.get(b, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / rate[0] * w
                n[b] = old + g * g
    want = {b: weight(b) for b in z if weight(b) != 0.0}
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    table = spark.createDataFrame([(i, v, "x") for i, v in labels.items()], "doc_id long, toxic int, text string")
    got = dict(ftrl.train(docs, table, F.col("toxic")))
    assert set(got) == set(want) and len(got) > 5
    assert all(abs(got[b] - want[b]) < 1e-9 for b in want)


def test_grade_learner_against_a_plain_loop(spark):
    labels = {i: i % 3 for i, _ in corpus()}
    rows = sample(spark, ordinal._features, labels, ordinal.BITS)
    grades = [r[0] for r in rows]
    sigmoid = lambda x: 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
    tail = [min(max(sum(g >= k for g in grades) / len(grades), 0.01), 0.99) for k in (1, 2)]
    first, second = (-math.log(t / (1 - t)) for t in tail)
    second = max(second + 1e-2, first)
    gap = math.log(max(second - first, 1e-2))
    w, seen, first_seen, gap_seen = {}, {}, 1e-8, 1e-8
    for _ in range(ordinal.PASSES):
        for g, buckets, counts in rows:
            total = max(sum(counts), 1)
            x = {b: math.sqrt(c / total) for b, c in zip(buckets, counts)}
            t = [first, first + math.exp(gap)]
            s = sum(w.get(b, 0.0) * v for b, v in x.items())
            upper = 1.0 if g == 0 else sigmoid(s - t[g - 1])
            lower = 0.0 if g == 2 else sigmoid(s - t[g])
            chance = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            for b, v in x.items():
                step = -(du - dl) / chance * v + ordinal.DECAY * w.get(b, 0.0)
                seen[b] = seen.get(b, 1e-8) + step * step
                w[b] = w.get(b, 0.0) - ordinal.RATE * step / math.sqrt(seen[b])
            dt = [0.0, 0.0]
            if g > 0:
                dt[g - 1] += du / chance
            if g < 2:
                dt[g] -= dl / chance
            first_seen += sum(dt) ** 2
            first -= 0.1 * ordinal.RATE * sum(dt) / math.sqrt(first_seen)
            step = dt[1] * math.exp(gap)
            gap_seen += step * step
            gap -= 0.1 * ordinal.RATE * step / math.sqrt(gap_seen)
    want = {b: v for b, v in w.items() if abs(v) > 1e-6} | {-1: first, -2: first + math.exp(gap)}
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    table = spark.createDataFrame([(i, v) for i, v in labels.items()], "doc_id long, quality int")
    got = dict(ordinal.train(docs, table, F.col("quality"), top=2))
    assert set(got) == set(want) and len(got) > 50
    assert all(abs(got[b] - want[b]) < 1e-9 for b in want)
    # what the model says of a text, from the same numbers
    for r in ordinal.grade(docs, list(got.items()), top=2).collect()[:20]:
        _, buckets, counts = distinct(*ordinal._features([r.text]), ordinal.BITS)
        s = sum(got.get(int(b), 0.0) * math.sqrt(c / max(counts.sum(), 1)) for b, c in zip(buckets, counts))
        assert r.tail == pytest.approx([sigmoid(s - got[-1]), sigmoid(s - got[-2])])
        assert r.expected_grade == pytest.approx(sum(r.tail))
