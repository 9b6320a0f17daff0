"""Likeness recomputed from the stored fingerprints alone."""

import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lexispark.llm import iblt, queries
from tests.conftest import SMALL


def spark_hash(key, salt):
    seed = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
    value = xxhash.xxh64(struct.pack("<i", salt), seed=seed).intdigest()
    return value - (1 << 64) if value >> 63 else value


def signed(text):
    value = int(text, 16)
    return value - (1 << 64) if value >> 63 else value


def recovered(fingerprint):
    """The digests that a fingerprint gives away; it must give away all."""
    count, size, rest = fingerprint.split("/")
    cells = {}
    for cell in filter(None, rest.split(";")):
        at, n, k, c = cell.split(":")
        cells[int(at)] = [int(n), signed(k), signed(c)]
    keys = set()
    while pure := [x[1] for x in cells.values() if x[0] == 1 and x[2] == spark_hash(x[1], 7)]:
        for key in set(pure):
            keys.add(key)
            for part in range(3):
                at = spark_hash(key, part) % int(size) + int(size) * part
                cells[at] = [cells[at][0] - 1, cells[at][1] ^ key, cells[at][2] ^ spark_hash(key, 7)]
    assert all(x == [0, 0, 0] for x in cells.values()) and len(keys) == int(count)
    return keys


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_is_that_of_the_returned_strings(spark):
    rows = queries.QUERIES["op6_fingerprints"](spark, SMALL).orderBy(F.desc("doc_id")).collect()
    own = [recovered(r.fingerprint) for r in rows]
    assert len(rows) > 100 and max(map(len, own)) > 24        # more than the smallest table has cells
    for i, r in enumerate(rows):
        assert r.near_edited == pytest.approx(likeness(own[i], recovered(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(likeness(own[i], own[(i + 1) % len(own)]))


def test_tables_grow_until_they_give_everything_away(spark):
    rng = random.Random(12)
    sets = [[rng.getrandbits(62) for _ in range(n)] for n in (0, 1, 7, 20, 25, 300, 5000)]
    df = spark.createDataFrame([(s, sets[-1][:100] + s) for s in sets], "a array<long>, b array<long>").select(
        "a", "b", iblt.fingerprint(F.col("a")).alias("f"), iblt.fingerprint(F.reverse("a")).alias("g"),
        iblt.difference(F.col("a"), F.array_distinct("b")).alias("d"))
    for r in df.collect():
        assert recovered(r.f) == set(r.a) and r.f == r.g
        assert (set(r.d.mine), set(r.d.theirs)) == (set(r.a) - set(r.b), set(r.b) - set(r.a)) and r.d.size is not None
