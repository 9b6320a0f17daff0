"""Byte-level BPE from a rank file: encoding with a segment tree per pre-token, and decoding.

The tree stands over byte positions and keeps, for every range, the smallest rank of a mergeable pair that starts in
it; the leftmost of equal ranks is found by descending to the left first. One merge changes three leaves: the merged
pair, its left neighbour, and the swallowed right part, so it costs a logarithm of the length, also for very long
pre-tokens. The ids of a pre-token depend on nothing else, so equal pre-tokens of a task share one merge run.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexispark.llm.textkit import PieceEncoder, gather, library_classes, packed_classes, text_chunks, unpacked_classes

_NONE = 1 << 30


class Ranks:
    """The vocabulary of one rank file: id of each byte string, and the id two neighbours merge into."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.merged: dict[int, int] = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.merged[left << 32 | right] = rank
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        size = max(self.ids.values()) + 1
        self.lengths = np.full(size, -1, np.int64)
        for token, rank in self.ids.items():
            self.lengths[rank] = len(token)
        kept = np.maximum(self.lengths, 0)
        self.offsets = np.cumsum(kept) - kept
        by_id = sorted((rank, token) for token, rank in self.ids.items())
        self.pool = np.frombuffer(b"".join(token for _, token in by_id), np.uint8)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        count = len(piece)
        part = [self.bytes[b] for b in piece]
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        size = 1 << (count - 1).bit_length()
        tree = [_NONE] * (2 * size)
        merged = self.merged.get
        for i in range(count - 1):
            tree[size + i] = merged(part[i] << 32 | part[i + 1], _NONE)
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left <= right else right

        def put(at: int, rank: int) -> None:
            node = size + at
            tree[node] = rank
            while node > 1:
                low = min(tree[node], tree[node ^ 1])
                node >>= 1
                if tree[node] == low:
                    return
                tree[node] = low

        while (rank := tree[1]) != _NONE:
            node = 1
            while node < size:
                node *= 2
                if tree[node] != rank:
                    node += 1
            at = node - size
            gone = after[at]
            part[at] = rank
            after[at] = nxt = after[gone]
            part[gone] = -1
            put(gone, _NONE)
            if nxt < count:
                before[nxt] = at
                put(at, merged(rank << 32 | part[nxt], _NONE))
            else:
                put(at, _NONE)
            if (prev := before[at]) >= 0:
                put(prev, merged(part[prev] << 32 | rank, _NONE))
        return [p for p in part if p >= 0]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and how many bytes each id gave; an unknown id raises ValueError."""
        if len(ids) and (int(ids.max()) >= len(self.lengths) or int(self.lengths[ids].min()) < 0):
            raise ValueError("id outside the vocabulary")
        lengths = self.lengths[ids]
        return gather(self.pool, self.offsets[ids], lengths), lengths


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=1)
def classes() -> tuple[bytes, bytes]:
    """The classes of all code points by the tiktoken library's tables, packed."""
    import public_tokenizers
    import tiktoken

    def whole(texts: list[str]) -> list[bool]:
        pieces = {t.encode() for t in texts if len(t.encode()) > 1}
        ranks = {bytes([i]): i for i in range(256)} | {p: 256 + i for i, p in enumerate(sorted(pieces))}
        probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return [len(ids) == 1 for ids in probe.encode_ordinary_batch(texts, num_threads=1)]

    return packed_classes(library_classes(whole))


@lru_cache(maxsize=2)
def _encoder(path: str, packed: tuple[bytes, bytes]) -> PieceEncoder:
    ranks = load_ranks(path)
    return PieceEncoder(lambda pieces: [ranks.encode_piece(p.encode()) for p in pieces], unpacked_classes(packed))


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``token_ids``, and with ``decoded``, the bytes that these ids stand for.

    ``path`` is a rank file that every executor can open. A null text counts as empty and has no ids; there are no
    special tokens; columns of ``docs`` with these two names are replaced.
    """
    added = ["token_ids"] + ["decoded"] * decoded
    base = docs.select(*[c for c in docs.columns if c not in added])
    fields = base.columns
    packed = classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks = _encoder(path, packed), load_ranks(path)
        for batch in text_chunks(batches, text, 1 << 19):
            ids, bounds = encoder(batch.column(text).to_pylist())
            columns = [batch.column(name) for name in fields] + [_lists(ids.view(np.int32), bounds, pa.int32())]
            if decoded:
                flat, lengths = ranks.decode(ids)
                ends = np.concatenate(([0], np.cumsum(lengths)))[bounds].astype(np.int32)
                columns.append(pa.Array.from_buffers(
                    pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())]))
            yield pa.RecordBatch.from_arrays(columns, [*fields, *added])

    schema = T.StructType([*base.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
                          + [T.StructField("decoded", T.BinaryType())] * decoded)
    return base.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """All rows with ``decoded``: the bytes of each id list; null for a null list or one with an id outside the vocabulary."""
    base = tokens.select(*[c for c in tokens.columns if c != "decoded"])
    fields = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)

        def one(values: list[int | None] | None) -> bytes | None:
            if values is None or None in values or (values and min(values) < 0):
                return None
            try:
                return ranks.decode(np.array(values, np.int64))[0].tobytes()
            except ValueError:
                return None

        for batch in batches:
            found = pa.array([one(v) for v in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in fields], found], [*fields, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.BinaryType())]))
