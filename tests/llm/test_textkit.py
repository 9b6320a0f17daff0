"""Vectorised text pieces against the regular expressions they stand for."""

import random
import re

import numpy as np
import public_tokenizers
import regex

from lexispark.llm.textkit import Joined, pre_token_spans, sliding_argmin, span_hashes, window_hashes, word_spans

ALPHABET = "ab's tr'ellvdm  \n\t'12é٣.,!?-　\xa0ñ日'Ｓ\r\x00\x0b‍😀"


def texts(count=4000):
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(count)]
    return made + [None, "", " ", "\n\n", "x" * 3000, "'s", "''s", "we'll've  \n done"]


def pieces(joined, spans):
    starts, ends, first = spans
    return [[joined.text[starts[k]:ends[k]] for k in range(first[i], first[i + 1])] for i in range(len(first) - 1)]


def test_pre_tokens_are_the_matches_of_the_pattern():
    given = texts()
    joined = Joined(given)
    assert pieces(joined, pre_token_spans(joined)) == [regex.findall(public_tokenizers.PATTERN, t or "") for t in given]


def test_words_are_the_matches_of_the_pattern():
    given = texts()
    joined = Joined(given)
    assert pieces(joined, word_spans(joined)) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in given]


def test_equal_spans_have_equal_hashes_and_others_differ():
    joined = Joined(texts())
    starts, ends, _ = word_spans(joined)
    hashes = span_hashes(joined.codes, starts, ends).tolist()
    words = [joined.text[a:b] for a, b in zip(starts, ends)]
    assert len(set(hashes)) == len(set(words)) == len(set(zip(hashes, words)))


def test_windows_and_smallest_of_windows():
    values = np.random.default_rng(1).integers(0, 6, 500).astype(np.uint64)
    for width in (1, 2, 5, 28):
        view = np.lib.stride_tricks.sliding_window_view(values, width)
        assert (sliding_argmin(values, width) == view.argmin(1) + np.arange(len(view))).all()
        hashes = window_hashes(values, width).tolist()
        rows = [tuple(v) for v in view.tolist()]
        assert len(set(hashes)) == len(set(rows)) == len(set(zip(hashes, rows)))
    assert len(sliding_argmin(values[:3], 5)) == len(window_hashes(values[:3], 5)) == 0
