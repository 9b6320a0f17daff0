"""Pair statistics, false-discovery control and dispersion on known values."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import stats as st
from lexispark.operators.dispersion import dispersion_table
from lexispark.operators.fdr import benjamini_hochberg
from tests.conftest import rows

# n_a, n_b, n_ab, n_total, expected, pmi, g2
GOLDEN = [
    (116, 91, 72, 6216, 1.698198, 5.405920, 538.18725),
    (53, 40, 21, 6124, 0.346179, 5.922727, 153.97118),
    (116, 101, 14, 6216, 1.884813, 2.892933, 34.81999),
    (53, 50, 2, 6124, 0.432724, 2.208482, 3.08635),
]


def test_golden_pairs(spark):
    df = spark.createDataFrame([g[:4] for g in GOLDEN], "n_a long, n_b long, n_ab long, n_total long")
    a, b, ab, n = (F.col(c) for c in ("n_a", "n_b", "n_ab", "n_total"))
    got = df.withColumn("e", st.expected(a, b, n)).select(
        "n_ab", "e", st.pmi(ab, F.col("e")), st.g2(ab, a, b, n)).collect()
    by_n = {r[0]: r[1:] for r in got}
    for g in GOLDEN:
        e, pmi, g2 = by_n[g[2]]
        assert abs(e - g[4]) < 5e-7 and abs(pmi - g[5]) < 5e-7 and abs(g2 - g[6]) < 5e-6


def test_zero_pair_has_no_pmi_and_no_p(spark):
    df = spark.createDataFrame([(116, 97, 0, 6216)], "n_a long, n_b long, n_ab long, n_total long")
    a, b, ab, n = (F.col(c) for c in df.columns[:2] + ["n_ab", "n_total"])
    r = df.select(st.pmi(ab, st.expected(a, b, n)).alias("pmi"), st.g2(ab, a, b, n).alias("g2"),
                  st.hypergeom_sf(ab, a, b, n).alias("p")).first()
    assert r.pmi is None and r.p is None and r.g2 > 0


def exact_tail(x, a, b, n):
    k, m = min(a, b), max(a, b)
    ways = sum(math.comb(m, i) * math.comb(n - m, k - i) for i in range(x, k + 1))
    return Fraction(ways, math.comb(n, k))


def test_tail_against_exact_fractions():
    rng = random.Random(7)
    tables = [(72, 116, 91, 6216), (14, 116, 101, 6216), (2, 53, 50, 6124), (5, 5, 5, 5), (1, 1, 1, 1)]
    for _ in range(400):
        n = rng.randint(1, 900)
        a, b = rng.randint(1, n), rng.randint(1, n)
        tables.append((rng.randint(max(1, a + b - n), min(a, b)), a, b, n) if max(1, a + b - n) <= min(a, b) else (1, 1, 1, n))
    got = st.upper_tail(*(np.array(c, dtype=float) for c in zip(*tables)))
    for value, t in zip(got, tables):
        want = exact_tail(*t)
        assert abs(value - float(want)) <= 1e-11 * float(want) + 1e-15, t


def test_tail_of_huge_tables_is_finite_and_ordered():
    x = np.array([1_000_000.0, 1_001_000.0, 1_010_000.0, 2_000_000.0])
    p = st.upper_tail(x, np.full(4, 1e8), np.full(4, 1e8), np.full(4, 1e10))
    assert np.all(np.isfinite(p)) and np.all(np.diff(p) <= 0)
    assert abs(p[0] - 0.5) < 1e-3 and 0.1 < p[1] < 0.2


BH = [
    ([0.10, 0.20, 0.30, 0.40, 0.50], set()),
    ([0.005, 0.30, 0.40, 0.50, 0.60], {0}),
    ([0.0001, 0.0002, 0.0003], {0, 1, 2}),
    ([], set()),
    ([0.06] * 100, set()),
    ([0.001] * 100, set(range(100))),
]


def step_up(p, q=0.05):
    order = sorted(range(len(p)), key=lambda i: p[i])
    last = max((r for r, i in enumerate(order) if p[i] <= ((r + 1) / len(p)) * q), default=-1)
    return set(order[:last + 1])


def flagged(spark, families):
    data = [(f, i, p, True) for f, ps in families.items() for i, p in enumerate(ps)]
    data += [(f, -1, 0.0, False) for f in families]  # outside the family: never flagged, never counted
    df = spark.createDataFrame(data, "family string, i int, p double, in_family boolean")
    out = {f: set() for f in families}
    for r in benjamini_hochberg(df, ["family"]).where("fdr_significant").collect():
        out[r.family].add(r.i)
    return out


def test_bh_vectors(spark):
    got = flagged(spark, {str(i): p for i, (p, _) in enumerate(BH)})
    assert got == {str(i): want for i, (_, want) in enumerate(BH)}


def test_bh_random_families_with_ties(spark):
    rng = random.Random(3)
    families = {}
    for f in range(60):
        scale = rng.choice([0.01, 0.05, 0.2, 1.0])
        families[str(f)] = [round(rng.random() * scale, rng.choice([2, 3, 6])) for _ in range(rng.randint(1, 120))]
    assert flagged(spark, families) == {f: step_up(p) for f, p in families.items()}


def test_log_factorial(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 15, 16, 170, 10**6)], "n long")
    for r in df.select("n", st.log_factorial(F.col("n")).alias("v")).collect():
        assert r.v == pytest.approx(math.lgamma(r.n + 1), rel=1e-13, abs=1e-13)


def test_finding_classes(spark):
    data = [
        (1, True, True, False, "association", 9.0, 0.9), (2, True, False, True, "association", 9.0, 0.9),
        (3, True, True, True, "avoidance", 9.0, 0.1), (4, False, True, True, "avoidance", 9.0, 0.1),
        (5, False, False, None, "association", 1.5, 0.1), (6, False, False, None, "association", 2.5, 0.9),
        (7, False, True, None, "association", 2.5, 0.5), (8, False, True, None, "association", 2.5, None)]
    df = spark.createDataFrame(data, "i int, c boolean, s boolean, o boolean, d string, e double, t double")
    got = rows(df.select("i", st.finding_class(*[F.col(c) for c in "csodet"])))
    assert [g[1] for g in got] == ["flip_lost", "flip_gained", "flip_direction", "avoidance", "weak_data",
                                   "not_significant", "significant_concentrated", "significant"]


def test_dispersion_even_and_concentrated(spark):
    data = []
    for section in range(4):
        for u in range(5):
            data.append(("t", section * 10 + u, section, "even", True))
    data += [("t", 100 + u, 0, "only0", True) for u in range(10)]
    data += [("t", u, 0, "rare", True) for u in range(4)]
    sets = spark.createDataFrame(data, "item_type string, unit_id long, section int, item string, in_reduced boolean")
    got = {r["item"]: r for r in dispersion_table(sets).where("variant = 'raw'").collect()}
    assert set(got) == {"even", "only0"}
    assert got["even"].juilland_d == pytest.approx(1.0)
    weight0 = (5 + 10 + 4) / 34
    assert got["only0"].juilland_d == pytest.approx(0.0) and got["only0"].dp == pytest.approx(1 - weight0)
    assert got["even"].top_section == 0  # equal counts: the section reached first
