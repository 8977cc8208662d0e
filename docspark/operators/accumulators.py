"""Accumulators of $group, $bucket and $bucketAuto as aggregate Columns. Unknown accumulators raise ValueError."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import Expressions

ORDERED = ("$first", "$last", "$push")


def accumulator(spec: dict, compile_expr: Expressions, order: list[Column], numeric_only_avg: bool = False) -> Column:
    """spec is {'$name': expression}. order holds the sort keys of the input, which $first, $last and $push follow.

    $avg divides by all documents of the group, a missing value counting as 0, unless numeric_only_avg is set.
    """
    if not isinstance(spec, dict) or len(spec) != 1:
        raise ValueError(f"an accumulator is one operator with an expression: {spec!r}")
    op, expr = next(iter(spec.items()))
    if op == "$count" or op == "$sum" and expr == 1 and not isinstance(expr, bool):
        return F.count(F.lit(1))
    c, kind = compile_expr(expr), compile_expr.type_of(expr)
    if op in ("$sum", "$avg") and kind is not None and not isinstance(kind, T.NumericType):
        c = F.lit(None).cast("double")  # only numbers add up
    if op == "$sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if op == "$avg":
        return F.avg(c) if numeric_only_avg else F.coalesce(F.sum(c), F.lit(0)) / F.count(F.lit(1))
    if op == "$min":
        return F.min(c)
    if op == "$max":
        return F.max(c)
    if op == "$stdDevPop":
        return F.stddev_pop(c)
    if op == "$stdDevSamp":
        return F.stddev_samp(c)
    if op == "$addToSet":
        return F.array_sort(F.collect_set(c))
    if op in ORDERED:
        rank = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]) if order else None
        if op == "$push":  # the struct keeps nulls, which collect_list alone drops
            rows = F.collect_list(F.struct(*([rank.alias("rank")] if rank is not None else []), c.alias("value")))
            return F.transform(F.array_sort(rows) if rank is not None else rows, lambda x: x["value"])
        if rank is None:
            return F.first(c) if op == "$first" else F.last(c)
        wrapped = F.struct(c.alias("value"))
        return (F.min_by(wrapped, rank) if op == "$first" else F.max_by(wrapped, rank))["value"]
    raise ValueError(f"unknown accumulator: {op}")
