"""Adapters from the given tables to units, tokens and baskets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.session import settle, spread, tasks_for, with_global_sum
from lexispark.sources.tables import read_table

_stored: dict[tuple, object] = {}


def files_key(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Identity of the named tables' files: how many, and a digest of their paths, sizes and times of change."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{name}.parquet" for name in names])
    digest = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))
    return tuple(files.agg(F.count(F.lit(1)), digest).first())  # one row


def once(spark: SparkSession, sf_dir: str, names: tuple[str, ...], what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table made from the named ones on first use; made anew when a file of theirs changes."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    identity = files_key(spark, sf_dir, *names)
    if key not in _stored or _stored[key][0] != identity:
        _stored[key] = (identity, build())
    return _stored[key][1]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", *columns)


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, before: how many lines all documents with smaller ids have."""
    def build() -> DataFrame:
        docs = table(spark, sf_dir, "documents", "doc_id", "text")
        sizes = docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))
        return settle(with_global_sum(sizes, [F.col("doc_id")], "n", "before").select("doc_id", "before"))

    return once(spark, sf_dir, ("documents",), "line_offsets", build)


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, doc_id, section, text of the non-empty document lines, written once for all queries.

    The numbers of the lines need each document's number of lines before it, so texts meet these offsets by document
    once, when this table is made; whoever reads lines afterwards scans it without an exchange.
    """
    def build() -> DataFrame:
        docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").join(line_offsets(spark, sf_dir), "doc_id")
        lines = docs.select("doc_id", "source", "before", F.posexplode(F.split("text", "\n")).alias("i", "text"))
        return settle(lines.where(F.trim("text") != "").select(
            (F.col("before") + F.col("i") + 1).alias("unit_id"), "doc_id", F.col("source").alias("section"), "text"))

    return once(spark, sf_dir, ("documents",), "lines", build)


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty document lines: unit_id, doc_id, section, text, text_norm, words.

    Lines are numbered through all documents in the order of their ids, so neither the number of lines of a document
    nor the size of its id is bounded by the form of a unit id.
    """
    return stored_lines(spark, sf_dir).select(
        "unit_id", "doc_id", "section", "text", F.trim(F.lower("text")).alias("text_norm"),
        tx.tokens_of(F.lower("text")).alias("words"))


def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the lines: unit_id, section, pos (from 1), norm, root (first four letters), lemma."""
    return _tokens_of(line_units(spark, sf_dir))


def _tokens_of(units: DataFrame, *keep: str) -> DataFrame:
    return units.select("unit_id", "section", *keep, F.posexplode("words").alias("i", "norm")).select(
        "unit_id", "section", *keep, (F.col("i") + 1).alias("pos"), "norm",
        F.substring("norm", 1, 4).alias("root"), F.col("norm").alias("lemma"))


_TOKENS_IN_LINE = 16        # about as many; only the number of partitions depends on it


def line_tasks(spark: SparkSession, sf_dir: str, rows_in_line: int = _TOKENS_IN_LINE) -> int | None:
    """The number of partitions of :func:`lines_by_unit`, counted from the footers."""
    return tasks_for(spark, rows_in_line * stored_lines(spark, sf_dir).count())


def lines_by_unit(spark: SparkSession, sf_dir: str, rows_in_line: int = _TOKENS_IN_LINE) -> DataFrame:
    """unit_id, section, text of the lines, dealt by unit in as many partitions as ``rows_in_line`` rows a line need.

    What is made from these lines stays by unit: groupings and joins by unit move nothing but the short texts, once.
    """
    lines = stored_lines(spark, sf_dir).select("unit_id", "section", "text")
    return spread(lines, rows_in_line * lines.count(), "unit_id")


def tokens_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`line_tokens`, dealt by unit before the lines become tokens."""
    return _tokens_of(lines_by_unit(spark, sf_dir).withColumn("words", tx.tokens_of(F.lower("text"))))


def flagged_line_tokens(spark: SparkSession, sf_dir: str, ranges: DataFrame) -> DataFrame:
    """Tokens of the lines with ``kept``, false inside a masked range (unit_id, start_pos, end_pos).

    Lines meet their ranges as text, before they become tokens, and stay by unit: what groups tokens by unit afterwards
    moves nothing. The merge join keeps that so where the ranges are few enough to be broadcast.
    """
    held = ranges.groupBy("unit_id").agg(F.collect_list(F.struct("start_pos", "end_pos")).alias("ranges"))
    met = lines_by_unit(spark, sf_dir).join(held.hint("merge"), "unit_id", "left")
    tokens = _tokens_of(met.withColumn("words", tx.tokens_of(F.lower("text"))), "ranges")
    masked = F.exists("ranges", lambda r: F.col("pos").between(r["start_pos"], r["end_pos"]))
    return tokens.withColumn("kept", ~F.coalesce(masked, F.lit(False))).drop("ranges")


def basket_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tokens: unit = order, section = the customer's nation, items = brand and type.

    They leave by order, in partitions of a bounded number of lines; whoever groups or joins them by unit stays there.
    """
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey)
    sold = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return (
        spread(sold, lines.count(), "l_orderkey")     # counted from the footers
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("unit_id"),
            F.col("c_nationkey").alias("section"),
            F.col("l_linenumber").alias("pos"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("type"),
            F.col("p_size").alias("size"),
        )
    )
