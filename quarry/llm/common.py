"""What the operators share: scratch tables, global row numbers, table readers and safe column names."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words are maximal runs of anything but space and the bytes 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only on one machine, where none is set (tests), a folder of our own.

    All scratch tables of an application are under its id, so whoever runs it can delete them in one step.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root or 'file:///tmp/checkpoints'}/quarry/{spark.sparkContext.applicationId}"


_made: list[list[tuple[str, DataFrame]]] = []


#: Rows of a file of a scratch table whose number of rows is known to be small.
FILE_ROWS = 250_000
#: Hadoop's local files have a file of checksums each, which starts a process of its own. Scratch tables have theirs in Parquet's pages.
PAGE_SUMS = {"parquet.page.write-checksum.enabled": "true", "parquet.page.verify-checksum.enabled": "true"}
BARE_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def staged(df: DataFrame, name: str, rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again: cuts lineage and survives lost executors.

    ``rows``: so many at most. They are made by up to twice as many tasks as there are cores and written as one file for each
    ``file_rows``: on a local file system each file starts processes (Hadoop sets modes by a command), which takes longer
    than some 1,000 rows, and until such a process runs its program it counts as a second copy of the executor.
    """
    spark = df.sparkSession
    if rows is not None:
        files, tasks = max(1, -(-rows // file_rows)), 2 * spark.sparkContext.defaultParallelism
        df = df.coalesce(max(tasks, files))
        if files < tasks:
            df = df.repartition(files)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    bare = BARE_FILES if spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl") is None else {}  # else the cluster's own
    df.write.options(**PAGE_SUMS, **bare).parquet(path)
    out = spark.read.options(**PAGE_SUMS).schema(df.schema).parquet(path)
    if _made:
        _made[-1].append((path, out))
    return out


FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: Spark deletes them when a write ends, not when garbage is collected."""
    before = spark.conf.get(FREES, "false")
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES, before)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Delete the tables staged within, but for those that the function given keeps: they pass to the block around."""
    _made.append([])
    kept: list[DataFrame] = []
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        for path, df in _made.pop():
            if any(df is x for x in kept):
                if _made:
                    _made[-1].append((path, df))
            else:
                _deleted(spark, path)


def _deleted(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def sampled(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """``size`` rows at most, those of smallest hash over ``columns``: the same however the rows are partitioned.

    A threshold on the hash leaves about twice as many rows, so what meets in one task doesn't grow with the tasks.
    """
    n = df.count()
    key = F.xxhash64(*columns)
    if n > 2 * size:
        df = df.where(F.pmod(key, F.lit(1 << 40)) < int((1 << 40) * (2 * size / n)))
    return df.orderBy(F.pmod(key, F.lit(1 << 40)), key).limit(size)


#: Rows of keys that are broadcast at most.
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose key is not among ``keys`` (one long column). Null keys stay.

    Few keys are broadcast, which moves no texts; more are joined by a shuffle.
    """
    dropped = staged(keys.toDF("__dropped").distinct(), name)
    few = dropped.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(dropped) if few else dropped, key == dropped["__dropped"], "left_anti")


#: Rows of one key that meet in one task at most, and how many keys are held to be hot at most, as a share of all rows.
HOT_ROWS, HOT_KEYS = 256, 100_000


def hot_limit(rows: int) -> int:
    """Keys of more rows than this are hot; as each takes that many, there are at most ``HOT_KEYS`` of them."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str | list[str], size: str, limit: int) -> DataFrame:
    """Join ``rows`` with the one row that ``keyed`` has for a key and its number of ``rows`` as ``size``.

    Those of hot keys are broadcast (``hot_limit`` bounds their number), so rows of one key meet nowhere. All others
    are joined by a shuffle.
    """
    hot = F.broadcast(keyed.where(F.col(size) > limit))
    rest = rows.join(F.broadcast(keyed.where(F.col(size) > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(keyed.where(F.col(size) <= limit), key))


def looked_up(rows: DataFrame, keyed: DataFrame, key: str | list[str], size: str, n_keys: int, n_rows: int) -> DataFrame:
    """``spread_join``, with all of ``keyed`` broadcast while its rows are few."""
    if n_keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keyed), key)
    return spread_join(rows, keyed, key, size, hot_limit(n_rows))


def ranked(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Add ``global_row`` (from 0, in the given order, without gaps) and return the number of rows.

    Rows are range-partitioned and sorted, never gathered in one task. They are written once, so that the
    partition bounds can't differ between two evaluations. What is broadcast is one row a partition.
    """
    there = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)
    sizes = there.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # one row a partition
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    out = there.join(F.broadcast(offsets), part == offsets["part"]).withColumn("global_row", F.col("first") + F.expr("_id & 8589934591"))
    return out.drop("part", "first", "_id"), there.count()
