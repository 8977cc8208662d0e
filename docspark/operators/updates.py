"""Updates and deletes: a DataFrame of documents and an update give the DataFrame after it. Nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from .predicates import compile_filter, field_type, is_operators, literal
from .predicates import field as field_column
from .stages import with_value

OPERATORS = ("$set", "$unset", "$inc", "$push", "$pull")


def _new_value(op: str, c: Column, kind: T.DataType | None, value) -> Column:
    if op == "$set":
        return literal(value) if kind is None else literal(value).cast(kind)
    if op == "$unset":
        return F.lit(None).cast(kind or "string")
    if op == "$inc":
        return F.coalesce(c, F.lit(0)) + F.lit(value) if kind is not None else F.lit(value)
    if op == "$push":
        return F.array_append(F.coalesce(c, F.array().cast(kind)), literal(value).cast(kind.elementType)) if kind is not None else F.array(literal(value))
    if op == "$pull":
        return F.filter(c, lambda x: ~x.eqNullSafe(literal(value)))
    raise ValueError(f"unknown update operator: {op}")


def _changes(df: DataFrame, update: dict) -> list[tuple[str, Column, T.DataType | None]]:
    """(path, new value, old type). A document without operators is merged in."""
    if not update:
        raise ValueError("an empty update")
    if not is_operators(update):
        if any(k.startswith("$") for k in update):
            raise ValueError("an update has either operators or fields")
        update = {"$set": update}
    out = []
    for op, fields in update.items():
        if op not in OPERATORS:
            raise ValueError(f"unknown update operator: {op}")
        for path, value in fields.items():
            kind = field_type(path, df.schema)
            c = field_column(path, df.schema) if kind is not None else F.lit(None)
            if op in ("$push", "$pull") and kind is not None and not isinstance(kind, T.ArrayType):
                raise ValueError(f"{op} needs a list: {path}")
            if op in ("$unset", "$pull") and kind is None:
                continue
            out.append((path, _new_value(op, c, kind, value), kind))
    return out


def _selected(df: DataFrame, query: dict | None, multi: bool, order: list[str] | None) -> tuple[DataFrame, Column]:
    """df with a hidden number if need be, and which rows are meant: all that match, or the first of them in the given order (all columns, if none is given).

    For a single document the rows are written with a number each, not sorted: the least of the matching rows' keys, and of equal ones the least number, is an aggregation.
    """
    test = compile_filter(query, df.schema)
    if multi:
        return df, test
    keys = [F.col(f"`{c}`") for c in order or [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]]
    rows = written(df.withColumn("__number", F.monotonically_increasing_id()), "update")
    first = rows.where(test).agg(F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], "__number"))["__number"].alias("__first"))
    return rows.join(F.broadcast(first)), F.col("__number").eqNullSafe(F.col("__first"))  # one row


def update(df: DataFrame, query: dict | None, change: dict, multi: bool = True, upsert: bool = False, order: list[str] | None = None) -> DataFrame:
    """The documents after the update. With upsert, a document made from the update is added if nothing matches."""
    rows, meant = _selected(df, query, multi, order)
    rows = rows.withColumn("__meant", meant)
    changes = _changes(df, change)
    for i, (_, value, _) in enumerate(changes):  # all new values are made from the old document
        rows = rows.withColumn(f"__value_{i}", value)
    for i, (path, _, kind) in enumerate(changes):
        old = field_column(path, rows.schema) if kind is not None else F.lit(None)
        rows = with_value(rows, path, F.when(F.col("__meant"), F.col(f"__value_{i}")).otherwise(old))
    out = rows.drop("__meant", "__number", "__first", *[f"__value_{i}" for i in range(len(changes))])
    if not upsert:
        return out
    fresh = update_document(df, query, change)
    none = df.where(compile_filter(query, df.schema)).limit(1).select(F.lit(1).alias("__some"))
    return out.unionByName(fresh.join(none, F.lit(True), "left_anti"), allowMissingColumns=True)


def update_document(df: DataFrame, query: dict | None, change: dict) -> DataFrame:
    """One document: the equalities of the filter, then the update on an empty document."""
    fields = {k: v for k, v in (query or {}).items() if not k.startswith("$") and not isinstance(v, dict)}
    empty = df.sparkSession.range(1).select(*[(F.lit(fields[f.name]) if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return update(empty, {}, change)


def modified_count(df: DataFrame, query: dict | None, change: dict) -> DataFrame:
    """matched, modified: how many documents match, and how many of them the update would change."""
    test = compile_filter(query, df.schema)
    differs = F.lit(False)
    for path, value, kind in _changes(df, change):
        differs = differs | ~value.eqNullSafe(field_column(path, df.schema) if kind is not None else F.lit(None))
    return df.agg(F.count_if(test).alias("matched"), F.count_if(test & differs).alias("modified"))


def delete(df: DataFrame, query: dict | None, multi: bool = True, order: list[str] | None = None) -> DataFrame:
    """The documents that stay."""
    rows, meant = _selected(df, query, multi, order)
    return rows.where(~meant).drop("__number", "__first")
