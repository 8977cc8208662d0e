"""Tables that cut lineage, written to the folder that driver and executors share, and distributed row numbers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


#: While a table is written: the shuffle files of that write go when it ends, as its rows are then in the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own if Spark runs on this machine alone, else an error: executors elsewhere wouldn't see it."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM has gone already
        pass


def _remove_all() -> None:
    while _folders:
        path, spark = _folders.popitem()
        _remove(spark, path)


#: Folders that are still there, with their sessions.
_folders: dict[str, SparkSession] = {}
atexit.register(_remove_all)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders[path] = spark
    return path


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the actions within go as each ends. Only the life of files depends on the setting, never a result."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lost executors don't lose it."""
    path = new_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() returned, when all that read them has been written in turn."""
    for table in tables:
        if spark := _folders.pop(table.shared_path, None):
            _remove(spark, table.shared_path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column of row numbers from 0 in the given order, or in the order of the partitions if none is given.

    Rows are sorted by range partitions; only the partitions' row counts (one row a partition) meet in one task.
    """
    place = f"__{name}_place"
    rows = written((df.orderBy(*order) if order else df).withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(place, 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__start"))
    first = rows.join(F.broadcast(starts), part == F.col("__part"))
    return first.withColumn(name, F.col("__start") + F.col(place).bitwiseAND((1 << 33) - 1)).drop("__part", "__start", place)
