"""Near copies without ids of their own."""

import random


def test_one_of_each_group_without_own_ids(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(4)
    rows = []
    for ids in ([None] * 4, [7] * 4, [None, 9, None, 8], [7, None], [None], [7]):
        base = [f"w{rng.randrange(9000)}" for _ in range(200)]
        for place, key in enumerate(ids):
            copy = list(base)
            copy[place * 40 + 5] = f"other{place}"
            rows.append((key, " ".join(copy), "en", "s", len(rows)))
    rows += [rows[0], rows[4], (None, None, "en", "s", -1), (None, "", "en", "s", -2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_dedup(spark, docs, "").collect()
    groups = [0] * 4 + [1] * 4 + [2] * 4 + [3] * 2 + [4, 5]
    of_text = dict(zip((r[1] for r in rows), groups))
    assert sorted(of_text[r.text] for r in kept if r.text) == list(range(6))
    assert {of_text[r.text]: r.doc_id for r in kept if r.text} == {0: None, 1: 7, 2: 8, 3: 7, 4: None, 5: 7}
    assert sorted(r.n_chars for r in kept if not r.text) == [-2, -1]
