"""Vectorised text pieces shared by the operators: words, pre-tokens, and hashes of both, for many texts at once.

Texts of a chunk are laid end to end as one array of code points, so a chunk costs a fixed number of numpy passes,
however many texts it has. Hashes are 64 bits wide and depend on the content alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_CHARS = 1 << 19     # characters handled together; a longer text is a chunk of its own

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASE = 0x1E3779B97F4A7C15      # below the prime
_powers: dict[bool, np.ndarray] = {}


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` characters of ``column`` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        share = np.cumsum(lengths.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(low, high - low)


class Joined:
    """Texts laid end to end, each followed by one separator; a null text counts as empty."""

    def __init__(self, texts: Sequence[str | None], fold_ascii: bool = False) -> None:
        self.text = "\n".join(t or "" for t in texts) + "\n"
        self.codes = np.frombuffer(self.text.encode("utf-32-le"), "<u4")
        if fold_ascii:
            upper = (self.codes >= 65) & (self.codes <= 90)
            self.codes = self.codes + np.uint32(32) * upper.astype(np.uint32)
        lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1      # where the separators stand
        self.starts = self.ends - lengths


def word_spans(joined: Joined) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, and per text the index of its first word (one more at the end)."""
    codes = joined.codes
    inside = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]           # the last character is a separator, so words are closed
    first = np.searchsorted(starts, joined.starts)
    return starts, ends, np.append(first, len(starts))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return x - _P * (x >= _P).astype(np.uint64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of residues modulo the prime, from halves of 32 bits; 2**61 counts as 1 and 2**64 as 8."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    lower = al * bl
    total = ((ah * bh) << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << half)
    return _reduced(total + (lower & _P) + (lower >> np.uint64(61)))


def power_table(size: int, inverse: bool = False) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo the prime."""
    known = _powers.get(inverse)
    if known is None or len(known) < size:
        base = pow(_BASE, -1, PRIME) if inverse else _BASE
        known = np.ones(1, np.uint64)
        while len(known) < max(size, CHUNK_CHARS * 2):       # each step doubles the table
            step = np.full(len(known), pow(base, len(known), PRIME), np.uint64)
            known = np.concatenate((known, times(known, step)))
        _powers[inverse] = known
    return known[:size]


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = values.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span, from prefix sums of a polynomial modulo the prime 2**61 - 1.

    A prime, because modulo a power of two there are short texts that collide whatever the base is (the Thue-Morse word
    and its complement). The sums are kept in halves of 32 bits, which cannot overflow below 2**32 values.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = times(_reduced(values.astype(np.uint64)) + np.uint64(1), power_table(len(values)))
    half, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
    high, low = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms >> half, out=high[1:])
    np.cumsum(terms & mask, out=low[1:])
    upper = _reduced(high[ends] - high[starts])
    shifted = (upper >> np.uint64(29)) + ((upper & np.uint64((1 << 29) - 1)) << half)     # times 2**32
    total = _reduced(_reduced(shifted) + _reduced(low[ends] - low[starts]))
    plain = times(total, power_table(len(values) + 1, True)[starts])
    return mix(plain + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values; entry i starts at value i."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(count)
    return span_hashes(words, at, at + width)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value among each ``width`` consecutive ones."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best, where, size = values, np.arange(len(values)), 1

    def pair(step: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        right = best[step:step + length] < best[:length]
        return (np.where(right, best[step:step + length], best[:length]),
                np.where(right, where[step:step + length], where[:length]))

    while size * 2 <= width:
        best, where = pair(size, len(best) - size)
        size *= 2
    if size < width:
        best, where = pair(width - size, count)
    return where[:count]


# ---- the pre-token pattern of byte-level vocabularies, without a regular expression per match ----

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, taken from the same properties that the pattern names."""
    import regex

    classes = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, everything):
            low, high = ord(everything[found.start()]), ord(everything[found.end() - 1])
            classes[low:high + 1] = kind
    classes[0xD800:0xE000] = OTHER
    return classes


def library_classes(whole: Callable[[list[str]], Sequence[bool]]) -> np.ndarray:
    """Class of every code point as a library's own pattern sees it, whatever its version of Unicode.

    ``whole(texts)`` says of each text whether it is one match of the pattern. Code points of one class behind a sign of
    that class are one match, so the classes of ``regex`` are confirmed some hundred at a time; where the library does not
    agree, the run is halved until single code points are left, which are tried behind a sign of each class.
    """
    guess = char_classes()
    classes = guess.copy()
    anchors = ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))
    codes = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    unclear = [codes[guess[codes] == SPACE]]
    for kind, anchor in anchors:
        own = codes[guess[codes] == kind]
        runs = np.array_split(own, max(1, len(own) // 256))
        while runs:
            agreed = whole([anchor + "".join(map(chr, run)) for run in runs])
            other = [run for run, same in zip(runs, agreed) if not same]
            unclear += [run for run in other if len(run) == 1]
            runs = [half for run in other if len(run) > 1 for half in np.array_split(run, 2)]
    rest = np.concatenate(unclear)
    classes[rest] = SPACE
    for kind, anchor in anchors:
        agreed = np.array(whole([anchor + chr(c) for c in rest]), bool)
        classes[rest[agreed]] = kind
    return classes


def packed_classes(classes: np.ndarray) -> tuple[bytes, bytes]:
    """Starts and classes of the runs of one class: a table small enough to travel with a task."""
    starts = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
    return starts.astype(np.int32).tobytes(), classes[starts].tobytes()


def unpacked_classes(packed: tuple[bytes, bytes]) -> np.ndarray:
    starts, kinds = np.frombuffer(packed[0], np.int32), np.frombuffer(packed[1], np.uint8)
    return np.repeat(kinds, np.diff(np.append(starts, 0x110000)))


def pre_token_spans(joined: Joined, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the usual byte-level pattern, and per text the index of its first match.

    ``classes`` is the class of every code point, by default those of Python's ``regex``.
    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its matches
    follow from runs of one class: the last blank before a run joins it, other white space stays apart, and an
    apostrophe that starts a match takes a contraction with it.
    """
    codes = joined.codes
    cls = (char_classes() if classes is None else classes)[codes]
    cls[joined.ends] = END
    size = len(codes)
    begins = np.ones(size, bool)
    begins[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == END)
    run_start = begins.copy()
    follows = np.zeros(size, bool)                   # a non-space run comes next
    follows[:-1] = run_start[1:] & (cls[1:] != SPACE) & (cls[1:] != END)
    last_space = (cls == SPACE) & follows
    begins[last_space] = True                        # the last white-space character before a run stands apart
    joins = last_space & (codes == 32)
    begins[np.flatnonzero(joins) + 1] = False        # ... and a blank joins the run
    # contractions: a run of one apostrophe at the start of a match
    quote = np.flatnonzero((codes == 39) & begins & (cls == OTHER))
    quote = quote[quote + 1 < size]
    quote = quote[cls[quote + 1] == LETTER]
    if len(quote):
        one = codes[quote + 1]
        two = codes[np.minimum(quote + 2, size - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) \
            | ((one == ord("l")) & (two == ord("l")))
        taken = np.where(single, 1, np.where(double, 2, 0))
        quote, taken = quote[taken > 0], taken[taken > 0]
        begins[quote + 1] = False
        after = quote + 1 + taken
        begins[after[after < size]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], size)
    real = cls[starts] != END
    starts, ends = starts[real], ends[real]
    return starts, ends, np.append(np.searchsorted(starts, joined.starts), len(starts))


# ---- encoding by distinct pre-tokens ---------------------------------------------------------

def gather(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[o:o + n]`` of all pairs, end to end."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(offsets - before, lengths) + np.arange(int(lengths.sum()))]


class HashSlots:
    """A growing map from 64-bit hashes to numbers, for whole arrays at once (open addressing).

    The table doubles before it is two thirds full, so a search always ends.
    """

    def __init__(self, bits: int) -> None:
        self.count = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slot = np.full(1 << bits, -1, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it has none."""
        at = self._place(keys)
        found = self.slot[at]
        rest = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            found[rest] = self.slot[at[rest]]
            rest = rest[(found[rest] >= 0) & (self.keys[at[rest]] != keys[rest])]
        return found

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Store new, distinct keys with their numbers."""
        bits = self.bits
        while 3 * (self.count + len(keys)) > 2 << bits:
            bits += 1
        if bits > self.bits:
            held = self.slot >= 0
            old = self.keys[held], self.slot[held]
            self._empty(bits)
            self._store(*old)
        self._store(keys, numbers.astype(np.int32))
        self.count += len(keys)

    def _store(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = self._place(keys)
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.slot[at[rest]] < 0]
            _, one = np.unique(at[free], return_index=True)     # one key per free place
            placed = free[one]
            self.keys[at[placed]], self.slot[at[placed]] = keys[placed], numbers[placed]
            rest = np.setdiff1d(rest, placed, assume_unique=True)
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)


LONG_PIECE = 48         # pre-tokens of more characters are told apart by themselves, not by a hash


class PieceEncoder:
    """Encodes texts by their distinct pre-tokens; ids of pre-tokens seen before are remembered.

    ``encode`` gets a list of new pre-tokens and returns the ids of each; ``classes`` are those of :func:`pre_token_spans`.
    What is remembered is forgotten before it holds more than ``limit`` pre-tokens, or 32 ids for each of so many.
    """

    def __init__(self, encode, classes: np.ndarray | None = None, limit: int = 1_000_000) -> None:
        self.encode, self.classes, self.limit = encode, classes, limit
        self.clear()

    def clear(self) -> None:
        self.slots = HashSlots(16)
        self.long: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = self.count = 0
        self.offsets = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)

    def _remember(self, pieces: list[str]) -> np.ndarray:
        """The numbers that new pre-tokens get."""
        found = self.encode(pieces)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total, at = int(lengths.sum()), self.count
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while at + len(pieces) > len(self.offsets):
            self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
            self.lengths = np.concatenate((self.lengths, np.zeros_like(self.lengths)))
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.lengths[at:at + len(pieces)] = lengths
        self.offsets[at:at + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.count += len(pieces)
        return np.arange(at, self.count)

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and the number of ids before each text (one more at the end)."""
        if self.count > self.limit or self.used > 32 * self.limit:
            self.clear()
        joined = Joined(texts)
        text = joined.text
        starts, ends, first = pre_token_spans(joined, self.classes)
        slot = np.zeros(len(starts), np.int64)
        short = ends - starts <= LONG_PIECE
        brief, large = np.flatnonzero(short), np.flatnonzero(~short)
        hashes = span_hashes(joined.codes, starts[brief], ends[brief])
        slot[brief] = self.slots.find(hashes)
        missing = np.flatnonzero(slot[brief] < 0)
        if len(missing):
            keys, example = np.unique(hashes[missing], return_index=True)
            example = brief[missing[example]]
            self.slots.add(keys, self._remember(
                [text[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist())]))
            slot[brief[missing]] = self.slots.find(hashes[missing])
        if len(large):
            pieces = [text[a:b] for a, b in zip(starts[large].tolist(), ends[large].tolist())]
            new = [p for p in dict.fromkeys(pieces) if p not in self.long]
            self.long.update(zip(new, self._remember(new).tolist()))
            slot[large] = [self.long[p] for p in pieces]
        lengths = self.lengths[slot]
        ids = gather(self.flat, self.offsets[slot], lengths)
        before = np.concatenate(([0], np.cumsum(lengths)))
        return ids, before[first]
