"""Session set-up and the two helpers every operator may need: cutting lineage and global ranks."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "lexispark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; cluster sizing stays with spark-submit.

    Python workers find this package where the driver has it, whatever folder the job was started from. Workers on other
    machines need it there too, or as a zip by ``--py-files``.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(filter(None, [home, os.environ.get("PYTHONPATH")])))
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_scratch: dict[str, str] = {}
_settled: dict[str, list[str]] = {}     # folders written by each application


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="lexispark-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in :func:`scratch_dir`, known to :func:`release`."""
    path = f"{scratch_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The stored copy survives lost executors, has real size statistics for the join planner,
    and is pruned per use because it is columnar.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsettle(df: DataFrame) -> None:
    """Delete a table made by :func:`settle` that nothing reads any more."""
    spark = df.sparkSession
    known = _settled.get(spark.sparkContext.applicationId, [])
    names = {name.rpartition("/")[0].rpartition("/")[2] for name in df.inputFiles()}
    for path in [path for path in known if path.rpartition("/")[2] in names]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        known.remove(path)


def let_go(spark: SparkSession) -> None:
    """Spark deletes a job's shuffle files when its plan is collected as garbage; between large steps that is asked for."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Delete what this application has written to its scratch folders; returns how many there were.

    For the end of a job: results that still read such a table must be stored or fetched before.
    """
    paths = _settled.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


ROWS_IN_TASK = 1 << 18      # rows of a partition made by :func:`spread`


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions that ``rows`` rows need; None for a few tasks' worth, which is left to adaptive execution."""
    if rows <= 4 * ROWS_IN_TASK:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_IN_TASK))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by hash of ``keys`` in as many partitions as ``rows`` rows need, so that a task stays small at any size.

    Adaptive execution merges partitions by their compressed bytes; joins and groupings that hold what they read need
    many times that. A few tasks' worth of rows is left to it.
    """
    tasks = tasks_for(df.sparkSession, rows)
    return df if tasks is None else df.repartition(tasks, *keys)


def with_global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add a 1-based rank over a total order without sending all rows to one task.

    The sort is range partitioned; a row's rank is the number of rows in earlier partitions plus
    its place in its own. Only the per-partition counts (one row per partition) meet in one task.
    """
    place = F.monotonically_increasing_id()
    in_partition = place.bitwiseAND(F.lit((1 << 33) - 1))  # layout documented by Spark
    placed = settle(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", in_partition)
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    # one row per shuffle partition, so broadcasting is bounded by the partition count
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_part", "_place", "_before")
    )


def with_group_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add a 1-based rank within each group, without sorting a group, however large, in one task.

    It is the rank over all rows, ordered by group first, less that of the group's first row.
    """
    ranked = settle(with_global_rank(df, [*[F.col(c).asc_nulls_first() for c in by], *order], "_rank"))
    group = F.struct(*[F.col(c) for c in by])
    firsts = ranked.groupBy(group.alias("_group")).agg(F.min("_rank").alias("_first"))
    return ranked.join(firsts, group == F.col("_group")).withColumn(
        name, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first", "_group")


def with_place(df: DataFrame, name: str) -> DataFrame:
    """Add the 1-based place of each row in the order in which ``df`` was written or, if it is no stored table, stands.

    Readers deal out files by size, so the order of a table just read is that of the shard numbers in the file names,
    then of the rows in a file. Only one row per file or partition meets in one task.
    """
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        stored = F.col("_metadata.file_name")
        shard = F.regexp_extract(stored, r"^part-(\d+)", 1).try_cast("long")
        piece = F.regexp_extract(stored, r"-c(\d+)\.", 1).try_cast("long")     # a task may write several files
        placed = df.select("*", F.struct(shard, piece, stored).alias("_part"), F.col("_metadata.row_index").alias("_place"))
    else:
        in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        placed = settle(df.withColumn("_part", F.spark_partition_id()).withColumn("_place", in_partition))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_part", "_place", "_before")
    )


def with_global_sum(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before a row in a total order, without sorting all rows in one task.

    As in :func:`with_global_rank`, only one row per partition of the range sort meets in one task.
    """
    place = F.monotonically_increasing_id()
    placed = settle(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", place))
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_place", "_before")
    )


def running_total(df: DataFrame, key: str, pos: str, value: Column, name: str, block: int | None = 1024) -> DataFrame:
    """Exclusive running sum of ``value`` by integer position ``pos`` within ``key``.

    Two levels keep a single huge key from landing in one window: totals per block of positions
    are summed first, then each block is summed on its own. Without blocks a key is one window, for rows that are
    the pieces of one value per key; rows dealt by key then stay where they are.
    """
    if block is None:
        before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
        return df.where(F.col(key).isNotNull() & F.col(pos).isNotNull()).withColumn(
            name, F.coalesce(F.sum(value.cast("long")).over(before), F.lit(0)))
    rows = df.withColumn("_v", value.cast("long")).withColumn("_blk", F.floor(F.col(pos) / F.lit(block)))
    totals = rows.groupBy(key, "_blk").agg(F.sum("_v").alias("_t"))
    over_blocks = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, "_blk", F.coalesce(F.sum("_t").over(over_blocks), F.lit(0)).alias("_start"))
    in_block = Window.partitionBy(key, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, [key, "_blk"])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(in_block), F.lit(0)))
        .drop("_v", "_blk", "_start")
    )
