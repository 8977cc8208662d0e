"""Folders of JSON and CSV files as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def read_json(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All .json files below a folder; a file holds one document or a list of them. Hidden files are skipped, files that don't parse give no rows."""
    reader = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = (reader.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])) if schema else reader).json(folder)
    if "_corrupt" not in rows.columns:
        return rows
    if len(rows.columns) == 1:
        return rows.limit(0).drop("_corrupt")
    good = [F.col(f"`{c}`").isNotNull() for c in rows.columns if c != "_corrupt"]
    return rows.where(F.col("_corrupt").isNull() | reduce(lambda a, b: a | b, good)).drop("_corrupt")


def read_variant(spark: SparkSession, folder: str) -> DataFrame:
    """One VARIANT column `doc` for JSON-lines files whose fields have no fixed types; null and missing stay distinct."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(folder).where(F.trim("value") != "").select(F.try_parse_json("value").alias("doc")).where(F.col("doc").isNotNull())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; lines with another number of values are dropped. Columns of numbers become double, of true and false boolean, others stay strings."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", enforceSchema=True)
    fields = [*raw.schema.fields, T.StructField("_corrupt", T.StringType())]
    rows = spark.read.csv(path, schema=T.StructType(fields), header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    rows = rows.where(F.col("_corrupt").isNull()).drop("_corrupt")
    kinds = rows.agg(*[F.bool_and(F.col(f"`{c}`").rlike(NUMBER)).alias(f"n{i}") for i, c in enumerate(rows.columns)], *[F.bool_and(F.lower(f"`{c}`").isin("true", "false")).alias(f"b{i}") for i, c in enumerate(rows.columns)]).first()
    cast = lambda i, c: F.col(f"`{c}`").cast("double") if kinds[f"n{i}"] else F.col(f"`{c}`").cast("boolean") if kinds[f"b{i}"] else F.col(f"`{c}`")
    return rows.select(*[cast(i, c).alias(c) for i, c in enumerate(rows.columns)])


def default_documents(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """What a collection without a model holds: _id, index, timestamp, random."""
    from ..functions.generate import object_id, uniform

    rows = spark.range(count)
    return rows.select(object_id(F.lit(seed), F.col("id")).alias("_id"), F.col("id").alias("index"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("timestamp"), uniform(seed, F.col("id"), "random").alias("random"))
