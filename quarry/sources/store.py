"""Tables in the folder that driver and executors share, and the order of rows in a distributed table.

Lineage is cut with Parquet tables under ``spark.checkpoint.dir``: every task that reads one can be run again on another executor. A folder of
our own is chosen only where the session names none and driver and executors are one process (a ``local[n]`` master, as in tests).
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset on one machine, a new local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the function that makes its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def acquire(spark: SparkSession, lock: str, stale: float) -> bool:
    """Whether the lock is ours now. It is a folder, renamed from one of our own with a file that names us.

    Of several renames at once one makes the lock; the others' folders end up inside it, as file systems move a folder into one that is
    there. A lock older than ``stale`` seconds was left by a builder that died and is removed. Stores without such a rename need another lock.
    """
    files, at = hadoop(spark, lock)
    me = uuid.uuid4().hex
    if not files.exists(at(lock)):
        files.create(at(f"{lock}.{me}/{me}"), True).close()
        try:
            files.rename(at(f"{lock}.{me}"), at(lock))
        except Exception:  # another one made or removed the lock while we were renaming
            files.delete(at(f"{lock}.{me}"), True)
        if files.exists(at(f"{lock}/{me}")):
            return True
        files.delete(at(f"{lock}/{lock.rsplit('/', 1)[-1]}.{me}"), True)
    elif time.time() - files.getFileStatus(at(lock)).getModificationTime() / 1000 > stale:
        files.delete(at(lock), True)
    return False


def release(spark: SparkSession, lock: str) -> None:
    files, at = hadoop(spark, lock)
    files.delete(at(lock), True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back, so that it is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def with_positions(df: DataFrame, *order: Column | str, name: str = "ord") -> DataFrame:
    """``df`` with a dense long from 0 in the order of ``order``, which should be unique.

    A range sort deals the rows out and is written; then the rows of each range are counted, one number a range, and each row's position
    is its place in its range after the rows of the ranges before.
    """
    n = tasks(df.sparkSession)
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = stored(sorted_, "sorted").withColumn("__range", F.shiftright("__at", 33))
    counts = rows.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__range", before.alias("__before")))  # as many rows as ranges
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(offsets, "__range").withColumn(name, place.cast("long")).drop("__range", "__at", "__before")
