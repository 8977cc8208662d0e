"""Collections stored as Parquet folders: <root>/<name>. A write makes a new version, moves the old one aside and then removes it, so a collection
can be written from itself, and a write that fails at any point loses nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _checked(name: str) -> str:
    if not name or any(c in name for c in "/\\:") or name.startswith((".", "_")):
        raise ValueError(f"not a collection name: {name!r}")
    return name


def write_collection(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> DataFrame:
    spark, path = df.sparkSession, f"{root}/{_checked(name)}"
    if mode == "append":
        df.write.mode("append").parquet(path)
        return spark.read.parquet(path)
    fresh = f"{root}/_new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    fs, target = _fs(spark, path)
    _recover(spark, root, name)
    old = _fs(spark, f"{root}/_old-{name}")[1]
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(_fs(spark, fresh)[1], target)
    fs.delete(old, True)
    return spark.read.parquet(path)


def _recover(spark: SparkSession, root: str, name: str) -> None:
    """After a write that ended between its two renames: the version before it is the collection again. After one that ended later: it is removed."""
    fs, target = _fs(spark, f"{root}/{name}")
    old = _fs(spark, f"{root}/_old-{name}")[1]
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)


def read_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    _recover(spark, root, _checked(name))
    return spark.read.parquet(f"{root}/{_checked(name)}")


def list_collections(spark: SparkSession, root: str) -> list[str]:
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def drop_collection(spark: SparkSession, root: str, name: str) -> bool:
    fs, path = _fs(spark, f"{root}/{_checked(name)}")
    return fs.exists(path) and fs.delete(path, True)


def write_pending(df: DataFrame, root: str, name: str) -> None:
    """Documents that a collection's model isn't trained on yet: few, in a hidden folder beside the collection, replaced as a whole."""
    fresh = f"{root}/_new-{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(fresh)
    drop_pending(df.sparkSession, root, name)
    fs, target = _fs(df.sparkSession, f"{root}/_pending-{_checked(name)}")
    fs.rename(_fs(df.sparkSession, fresh)[1], target)


def read_pending(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    fs, path = _fs(spark, f"{root}/_pending-{_checked(name)}")
    return spark.read.parquet(path.toString()) if fs.exists(path) else None


def drop_pending(spark: SparkSession, root: str, name: str) -> None:
    fs, path = _fs(spark, f"{root}/_pending-{_checked(name)}")
    fs.delete(path, True)
