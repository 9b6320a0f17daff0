"""Token-id files: ids in the fewest bits that hold the vocabulary, written and read by Spark tasks.

A data set is a folder of shard files and one ``_manifest.json``. A shard is::

    blocks      packed ids, BLOCK ids each (the last may be short); every block starts on a byte
    footer      JSON: bits, block, n_docs, n_ids, then the binary tables below
    tables      doc ids (int64), one flag byte each (1: the id was null), doc starts (int64, n_docs + 1 of them)
    trailer     footer length (uint64), magic

All integers are little-endian; id i of a block occupies bits ``i * bits ..`` counted from the lowest bit of the first
byte. Block b begins at byte ``b * block * bits / 8``, so any id is found without reading what lies before it.

Shards come from one range of document ids per task and follow each other in the manifest; the global start of a
document is the id count of earlier shards plus its start in its own. The manifest holds one entry per shard and is
written at commit, from what successful tasks report: files of lost or repeated attempts are never referred to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lexispark.llm.textkit import PieceEncoder, library_classes, packed_classes, text_chunks, unpacked_classes

BLOCK = 1 << 16         # ids of a block; a multiple of 8, so that blocks end on bytes
ROWS_AT_ONCE = 500      # rows of an Arrow batch on the way to a file
MAGIC = b"TOKIDS01"
MANIFEST = "_manifest.json"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of ``bits`` bits, lowest bit first, padded to whole bytes."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` fields as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Shard:
    """Random access to one shard file."""

    def __init__(self, path: str) -> None:
        files, place = _filesystem(path)
        self.file = files.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        length = int.from_bytes(tail[:8], "little")
        footer = self.file.read_at(length, size - 16 - length)
        head, _, tables = footer.partition(b"\n")
        self.bits, self.block, self.n_docs, self.n_ids = (json.loads(head)[k] for k in ("bits", "block", "n_docs", "n_ids"))
        n = self.n_docs
        self.doc_ids = np.frombuffer(tables, "<i8", n)
        self.is_null = np.frombuffer(tables, np.uint8, n, 8 * n)
        self.starts = np.frombuffer(tables, "<i8", n + 1, 9 * n)

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids number low to high (exclusive) of the shard, from the blocks that hold them."""
        if high <= low:
            return np.zeros(0, np.uint32)
        step = self.block * self.bits // 8
        first, last = low // self.block, (high - 1) // self.block
        end = min((last + 1) * self.block, self.n_ids)
        need = (last - first) * step + ((end - last * self.block) * self.bits + 7) // 8
        data = self.file.read_at(need, first * step)
        return unpack(data, self.bits, end - first * self.block)[low - first * self.block:high - first * self.block]


@dataclass
class ShardWritten(WriterCommitMessage):
    order: int
    name: str
    n_docs: int
    n_ids: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int) -> None:
        self.path, self.bits = path.rstrip("/"), bits

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ShardWritten:
        files, place = _filesystem(self.path)
        files.create_dir(place, recursive=True)
        order = TaskContext.get().partitionId()
        name = f"shard-{order:06d}-{uuid.uuid4().hex}.tok"
        doc_ids, nulls, lengths, waiting, held = [], [], [], [], 0
        with files.open_output_stream(f"{place}/{name}") as out:
            for batch in iterator:
                keys = batch.column("doc_id")
                lists = batch.column("ids")
                counts = np.diff(lists.offsets.to_numpy())
                doc_ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                lengths.append(counts.astype("<i8"))
                waiting.append(lists.flatten().to_numpy().astype(np.uint32))
                held += len(waiting[-1])
                if held >= BLOCK:
                    ids = np.concatenate(waiting)
                    whole = held // BLOCK * BLOCK
                    for at in range(0, whole, BLOCK):
                        out.write(pack(ids[at:at + BLOCK], self.bits))
                    waiting, held = [ids[whole:]], held - whole
            if held:
                out.write(pack(np.concatenate(waiting), self.bits))
            sizes = np.concatenate([np.zeros(1, "<i8"), *lengths])
            n_docs, n_ids = len(sizes) - 1, int(sizes.sum())
            head = json.dumps({"bits": self.bits, "block": BLOCK, "n_docs": n_docs, "n_ids": n_ids}).encode() + b"\n"
            tables = b"".join(a.tobytes() for a in [*doc_ids, *nulls, np.cumsum(sizes).astype("<i8")])
            out.write(head + tables)
            out.write((len(head) + len(tables)).to_bytes(8, "little") + MAGIC)
        return ShardWritten(order, name, n_docs, n_ids)

    def commit(self, messages: list[ShardWritten | None]) -> None:
        files, place = _filesystem(self.path)
        shards, before = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.order):
            if m.n_docs:
                shards.append({"name": m.name, "n_docs": m.n_docs, "n_ids": m.n_ids, "start": before})
                before += m.n_ids
        files.create_dir(place, recursive=True)
        with files.open_output_stream(f"{place}/{MANIFEST}") as out:
            out.write(json.dumps({"bits": self.bits, "n_ids": before, "shards": shards}).encode())

    def abort(self, messages: list[ShardWritten | None]) -> None:
        files, place = _filesystem(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{place}/{m.name}")


class ShardPart(InputPartition):
    def __init__(self, path: str, start: int) -> None:
        self.path, self.start = path, start


class TokenReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[ShardPart]:
        files, place = _filesystem(self.path)
        with files.open_input_stream(f"{place}/{MANIFEST}") as read:
            shards = json.loads(read.read())["shards"]
        return [ShardPart(f"{self.path}/{s['name']}", s["start"]) for s in shards] or [ShardPart("", 0)]

    def read(self, partition: ShardPart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        shard = Shard(partition.path)
        low = 0
        while low < shard.n_docs:   # about two blocks of ids at a time, one text at least
            high = int(np.searchsorted(shard.starts, shard.starts[low] + 2 * BLOCK, "right")) - 1
            high = min(max(high, low + 1), shard.n_docs)
            bounds = shard.starts[low:high + 1]
            ids = shard.ids(int(bounds[0]), int(bounds[-1]))
            local = (bounds - bounds[0]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(shard.doc_ids[low:high], mask=shard.is_null[low:high].astype(bool)),
                pa.array(bounds[:-1] + partition.start), pa.array(np.diff(bounds)),
                pa.Array.from_buffers(pa.binary(), high - low, [
                    None, pa.py_buffer((local * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]),
            ], ["doc_id", "start", "n_tokens", "ids_le32"])
            low = high


class TokenFiles(DataSource):
    """``spark.read.format("token_files")``: doc_id, start, n_tokens, and the ids as little-endian 32-bit integers."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_le32 binary"

    def reader(self, schema: T.StructType) -> TokenReader:
        return TokenReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], int(self.options["bits"]))


@lru_cache(maxsize=2)
def classes(path: str) -> tuple[bytes, bytes]:
    """The classes of all code points by the tokenizer file's own splitting rule in the library's tables, packed."""
    from tokenizers import Tokenizer

    rule = Tokenizer.from_file(path).pre_tokenizer
    return packed_classes(library_classes(lambda texts: [len(rule.pre_tokenize_str(t)) == 1 for t in texts]))


@lru_cache(maxsize=2)
def _encoder(path: str, packed: tuple[bytes, bytes]) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return PieceEncoder(lambda pieces: [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)],
                        unpacked_classes(packed))


@lru_cache(maxsize=2)
def _whole_encoder(path: str):
    """The library as it comes, and a pattern of the file's added tokens (None if it has none)."""
    import re

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    contents = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # the case is ignored, so that a token met only after normalisation is not missed for its capitals
    return tokenizer, re.compile("|".join(map(re.escape, contents)), re.IGNORECASE) if contents else None


def _encode_with_added(path: str, packed: tuple[bytes, bytes], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds as of :class:`PieceEncoder`; texts that hold an added token are encoded whole by the library."""
    pieces, (tokenizer, added) = _encoder(path, packed), _whole_encoder(path)
    held = [i for i, t in enumerate(texts) if t and added.search(t)] if added else []
    if not held:
        return pieces(texts)
    rest = list(texts)
    for i in held:
        rest[i] = None
    ids, bounds = pieces(rest)
    found = [np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in held]
    lengths = np.diff(bounds)
    lengths[held] = [len(f) for f in found]
    ids = np.insert(ids, np.repeat(bounds[held], lengths[held]), np.concatenate(found))
    return ids, np.concatenate(([0], np.cumsum(lengths)))


def encode_texts(
    docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, ids) of each row: the ids of the whole text by a byte-level tokenizer file, then ``end_id``.

    Byte-level vocabularies encode each pre-token on its own, so the library is asked once per distinct pre-token of a
    task. The file's added tokens, such as ``<|endoftext|>``, get their own ids wherever a text holds them, as by the
    library's default. A null text counts as empty; repeated rows are encoded each.
    """
    packed = classes(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = partial(_encode_with_added, tokenizer, packed)
        for batch in text_chunks(batches, "text", 1 << 19):
            ids, bounds = encoder(batch.column(1).to_pylist())
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))],
                ["doc_id", "ids"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, text: str = "text", key: str = "doc_id"
) -> None:
    """Write all texts in ascending key order (null keys first, equal keys by text), one shard per range of keys.

    ``path`` is a folder that driver and executors share; files there that no manifest names are never read. An empty
    table gives an empty data set; other columns are not read.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    # texts and ids meet in three processes of a task, so few rows travel at a time while this is written
    rows_at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_at_once)
    spark.conf.set(rows_at_once, str(min(int(before), ROWS_AT_ONCE) if int(before) > 0 else ROWS_AT_ONCE))
    try:
        encode_texts(ordered, tokenizer, end_id).write.format("token_files").option(
            "bits", bits_for(vocabulary)).mode("append").save(path)
    finally:
        spark.conf.set(rows_at_once, before)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_le32 of a written data set."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(path)
