"""Fixed thresholds of a statistics build, kept in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    full_unit_min: int = 3      # identical units needed to call the text a phrase
    ngram_min_n: int = 2        # shortest unit-final n-gram
    ngram_max_n: int = 6        # longest unit-final n-gram
    ngram_min_units: int = 10   # units an n-gram must end in to qualify
    floor_item: int = 5         # units an item must occur in
    floor_cooc: int = 2         # units a pair must share to enter the FDR family
    fdr_q: float = 0.05
    # items of one unit handled together when pairing; larger units are cut into
    # blocks of about this many items and the blocks are paired in separate tasks
    pair_block: int = 256


RAW = "raw"
REDUCED = "phrase_reduced"
