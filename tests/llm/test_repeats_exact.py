"""Windows that only look alike are no repeats."""

import numpy as np

from lexispark.llm import substring_dedup
from lexispark.llm.textkit import Joined, span_hashes, window_hashes, word_spans


def test_windows_of_equal_short_hash_are_no_repeat(spark):
    """Two texts of 35 words under one anchor whose window hashes agree in their upper 32 bits."""
    rest = [f"f{i}" for i in range(26)] + [f"a{i}" for i in range(7)] + ["z20472"]
    pairs = [(1836, 395812), (91483, 494106), (51366, 59670)]
    texts = [" ".join([f"v{i}", *rest]) for i in pairs[0]]
    joined = Joined(texts)
    starts, ends, _ = word_spans(joined)
    words = span_hashes(joined.codes, starts, ends)
    a, b = (int(window_hashes(words[i:i + 35], 35)[0]) for i in (0, 35))
    assert a >> 32 == b >> 32 and a != b
    rows = [(i, " ".join([f"v{i}", *rest])) for i in np.array(pairs).ravel().tolist()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # shorter windows of the same texts do repeat
    assert {r.n_removed for r in substring_dedup.remove_repeats(docs, length=34).collect()} == {34}
    for r in substring_dedup.remove_repeats(docs, length=35).collect():
        assert (r.n_removed, r.kept_text, r.repeat_bounds) == (0, r.text, [])


def test_similar_windows_of_unlike_surroundings(spark):
    """The same where the surroundings differ, so that windows are compared one by one."""
    rest = [f"f{i}" for i in range(26)] + [f"a{i}" for i in range(7)] + ["z20472"]
    rows = [(1, " ".join(["v1836", *rest, "p1", "p2"])), (2, " ".join(["v395812", *rest, "q1", "q2"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]
