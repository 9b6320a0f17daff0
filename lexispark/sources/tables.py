"""Reading and writing tables: CSV, JSON maps, parquet, and the write modes of a load."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.session import settle, with_global_rank

SPAN_TYPE = "array<struct<rule:string,start:int,end:int>>"


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Projected scan; the pruned columns are all that leaves the parquet files."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, low: int, high: int,
              partitions: int, **options: str) -> DataFrame:
    """Projected scan of a database table, split on an integer column (needs the driver jar)."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(partitions), **options)
    return reader.load()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted newlines; rows that do not fit end up in ``_corrupt_record``."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    return (
        spark.read.schema(full)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object ``unit id -> [spans]`` per record as rows (unit_id, spans)."""
    text = spark.read.text(path, wholetext=True)  # one object per file; a large map comes as several files
    return explode_json_map(text, F.col("value"))


def explode_json_map(df: DataFrame, json: Column, *keep: str) -> DataFrame:
    parsed = F.from_json(json, f"map<string,{SPAN_TYPE}>")
    rows = df.select(*keep, F.explode(parsed).alias("unit_key", "spans"))
    return rows.withColumn("unit_id", F.col("unit_key").cast("long")).drop("unit_key")


_POINTER = "current"       # names the folder of the version that readers see


class Refused(ValueError):
    """A staged version did not pass its audit; readers keep the old one."""


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    folder, files = _file_system(spark, path)
    files.delete(folder, True)


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Let readers of ``path`` see ``version``: one rename over the old pointer."""
    jvm = spark.sparkContext._jvm
    fresh, files = _file_system(spark, f"{path}/{_POINTER}.{uuid.uuid4().hex}")
    out = files.create(fresh)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fresh.toUri() if fresh.toUri().getScheme() else files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}")), options)


def current_path(spark: SparkSession, path: str) -> str | None:
    """The folder of the version in force, None before the first one."""
    pointer, files = _file_system(spark, f"{path}/{_POINTER}")
    if not files.exists(pointer):
        return None
    return f"{path}/{spark.read.text(str(files.makeQualified(pointer))).first()[0]}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version in force; a later swing of the pointer does not disturb who reads it."""
    found = current_path(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} has no published version")
    return spark.read.parquet(found)


def _staged(df: DataFrame, path: str, audit: Callable[[], str | None]) -> str:
    """Write ``df`` as a new version, audit it, point to it. The old version stays readable throughout."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{path}/{version}")
        if (problem := audit()) is not None:
            raise Refused(problem)
    except Exception:
        _delete(spark, f"{path}/{version}")
        raise
    _point(spark, path, version)
    return f"{path}/{version}"


def overwrite_table(df: DataFrame, path: str, least: int = 0) -> int:
    """Full idempotent reload that readers survive: write, audit, publish. Returns the number of rows.

    The rows are counted while they are written. A write that fails, or leaves fewer than ``least`` rows, changes nothing
    for readers. Read the table with :func:`read_published`; :func:`retire_versions` deletes what is no longer in force.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    _staged(counted, path, lambda: None if seen.get["rows"] >= least else f"{seen.get['rows']} rows, at least {least} wanted")
    return seen.get["rows"]


def retire_versions(spark: SparkSession, path: str) -> int:
    """Delete every version but the one in force; for a time when nobody reads an older one. Returns how many went."""
    kept = current_path(spark, path)
    folder, files = _file_system(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    old = [n for n in names if n.startswith("v-") and f"{path}/{n}" != kept]
    for name in old:
        _delete(spark, f"{path}/{name}")
    return len(old)


def insert_unique_published(rows: DataFrame, key: Sequence[str], path: str, most_missing: int | None = None) -> tuple[int, int]:
    """Reload a table by insert-or-ignore on ``key``; returns how many rows were asked and stored.

    Both are counted in the one pass that writes: what comes in before the key decides, and what goes out after it. If
    more than ``most_missing`` rows were ignored the version is refused and readers keep the old one.
    """
    asked, stored = Observation(), Observation()
    kept = insert_unique(rows.observe(asked, F.count(F.lit(1)).alias("n")), key).observe(stored, F.count(F.lit(1)).alias("n"))

    def audit() -> str | None:
        missing = asked.get["n"] - stored.get["n"]
        return f"{missing} rows share a key" if most_missing is not None and missing > most_missing else None

    _staged(kept, path, audit)
    return asked.get["n"], stored.get["n"]


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace exactly the partitions that occur in ``df`` and leave the others alone.

    Spark stages the new partitions and swaps them in when the whole write is done; one that fails changes nothing.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def replaced(base: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the table holds after :func:`replace_partitions`."""
    return base.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def insert_unique(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that survive an insert-or-ignore on ``key``: the smallest of each key's rows.

    A partial aggregate instead of ``dropDuplicates`` on sorted data: the choice does not depend
    on arrival order, and a key with very many copies is reduced before the shuffle.
    """
    rest = [c for c in rows.columns if c not in key]
    kept = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return kept.select(*key, "_row.*").select(*rows.columns)


def insert_gap(rows: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Audit of :func:`insert_unique` per ``by``: asked, stored and a flag row where they differ.

    Stored rows are those that the insert really keeps, so a key met in several groups counts in the group of its kept
    row only, and the stored counts of all groups sum to the size of the table.
    """
    asked = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("asked"))
    kept = insert_unique(rows, key).groupBy(*by).agg(F.count(F.lit(1)).alias("_stored"))
    same = [asked[c].eqNullSafe(kept[c]) for c in by]
    totals = asked.join(kept, reduce(Column.__and__, same), "left").select(
        *[asked[c] for c in by], "asked", F.coalesce("_stored", F.lit(0).cast("long")).alias("stored"))
    return totals.where("asked <> stored").withColumn("missing", F.col("asked") - F.col("stored"))


def update_from(base: DataFrame, delta: DataFrame, key: str, column: str) -> DataFrame:
    """``base`` with ``column`` taken from ``delta`` where the key matches; of several new values the largest counts."""
    new = delta.groupBy(key).agg(F.max(column).alias("_new"))
    return (
        base.join(new, key, "left")
        .withColumn(column, F.coalesce("_new", F.col(column)))
        .select(*base.columns)
    )


def update_partitions(spark: SparkSession, path: str, delta: DataFrame, key: str, column: str, by: Sequence[str]) -> int:
    """:func:`update_from` on a table stored in partitions ``by``; returns how many partitions were written anew.

    Keys are looked up first, from the key and partition columns alone; then only partitions that hold a key of the delta
    are read and replaced. Files of all others stay as they are. Their list is as long as the table has partitions.
    """
    base = spark.read.parquet(path)
    fresh = settle(delta.groupBy(key).agg(F.max(column).alias(column)))
    touched = base.select(key, *by).join(fresh.select(key), key, "left_semi").select(*by).distinct().collect()
    if not touched:
        return 0
    inside = reduce(Column.__or__, [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(r[c])) for c in by]) for r in touched])
    # stored before the partitions that it is read from are replaced
    replace_partitions(settle(update_from(base.where(inside), fresh, key, column)), path, by)
    return len(touched)


def register_sources(registry: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Get-or-create: the registry plus the missing entries, numbered on from the highest id."""
    missing = insert_unique(wanted.join(registry, list(key), "left_anti"), key)
    ranked = with_global_rank(missing, [F.col(k) for k in key], "_rank")
    top = registry.agg(F.max("source_id")).first()[0] or 0  # one number
    added = ranked.withColumn("source_id", F.col("_rank") + F.lit(top))
    return registry.unionByName(added.select(*registry.columns))
