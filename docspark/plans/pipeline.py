"""From a pipeline (a list of stage dictionaries) or a find request to one DataFrame; Catalyst plans it as a whole."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import compile_filter, generation_params
from ..operators.stages import STAGES, Context, lookup_filtered, lookup_joined, projected, skipped, sort_columns


def find(df: DataFrame, query: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Filter, then sort, then skip and limit, then project. limit None (or 0) means all."""
    out = df.where(compile_filter(query, df.schema, total=False)) if query else df
    if sort:
        out = out.orderBy(*sort_columns(out, sort))
    if skip and not limit:
        out = skipped(out, skip, [(path, direction == 1) for path, direction in (sort or {}).items()])
    elif limit:
        out = (out.offset(skip) if skip else out).limit(limit)
    return projected(out, projection, keep_id=True) if projection else out


def count(df: DataFrame, query: dict | None = None) -> int:
    return find(df, query).count()


def _stage(item: dict) -> tuple[str, object]:
    if not isinstance(item, dict) or len(item) != 1:
        raise ValueError(f"a stage is a dictionary with one operator: {item!r}")
    return next(iter(item.items()))


def validate(pipeline: list[dict]) -> None:
    """Raises ValueError for what isn't a pipeline or names an unknown stage."""
    if not isinstance(pipeline, (list, tuple)):
        raise ValueError("a pipeline is a list of stages")
    for i, item in enumerate(pipeline):
        name, spec = _stage(item)
        if name == "$facet":
            for sub in spec.values():
                validate(sub)
        elif name not in STAGES:
            raise ValueError(f"unknown stage {i}: {name}")


def aggregate(df: DataFrame, pipeline: list[dict], collections: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """Applies the stages in order. Options: output_dir, numeric_only_avg, seed.

    $lookup followed by $unwind of its result becomes a join, by a $match on its emptiness an anti or semi join.
    """
    validate(pipeline)
    return _apply(df, list(pipeline), Context(collections=dict(collections or {}), **options))


def _apply(df: DataFrame, stages: list[dict], context: Context) -> DataFrame:
    i = 0
    while i < len(stages):
        name, spec = _stage(stages[i])
        following = _stage(stages[i + 1]) if i + 1 < len(stages) else (None, None)
        if name == "$lookup" and following[0] == "$unwind" and (unwound := _unwinds(following[1], spec["as"])) is not None:
            df, i = lookup_joined(df, spec, context, unwound), i + 2
        elif name == "$lookup" and following[0] == "$match" and (empty := _tests_emptiness(following[1], spec["as"])) is not None:
            df, i = lookup_filtered(df, spec, context, empty), i + 2
        elif name == "$skip" and following[0] == "$limit":
            df, i = df.offset(spec).limit(following[1]), i + 2  # with a sort before it, a top-k
        elif name == "$facet":
            df, i = _facet(df, spec, context), i + 1
        else:
            df, i = STAGES[name](df, spec, context), i + 1
    return df


def _unwinds(spec, name: str) -> bool | None:
    """Whether an $unwind of the field `name` keeps documents without items; None if it is another field or wants an index."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    if spec["path"] != f"${name}" or spec.get("includeArrayIndex"):
        return None
    return bool(spec.get("preserveNullAndEmptyArrays"))


def _tests_emptiness(spec: dict, name: str) -> bool | None:
    if spec == {name: {"$size": 0}}:
        return True
    if spec in ({name: {"$not": {"$size": 0}}}, {"$nor": [{name: {"$size": 0}}]}, {"$not": {name: {"$size": 0}}}):
        return False
    return None


def facets(df: DataFrame, spec: dict[str, list[dict]], collections: dict[str, DataFrame] | None = None, **options) -> dict[str, DataFrame]:
    """The facets as DataFrames of their own: what to use where a facet is large."""
    context = Context(collections=dict(collections or {}), **options)
    return {name: _apply(df, list(stages), replace(context, order=[])) for name, stages in spec.items()}


def _facet(df: DataFrame, spec: dict, context: Context) -> DataFrame:
    """One document with an array for each facet, as the stage demands; each array is one value, so facets should end in groups, counts or limits."""
    rows = {}
    for name, stages in spec.items():
        part = _apply(df, list(stages), replace(context, order=[]))
        rows[name] = part.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in part.columns])).alias(name))
    # One row for each facet, with nulls for the others, folded into one.
    wide = [row.select(*[F.col(f"`{n}`") if n == name else F.lit(None).cast(other.schema[n].dataType).alias(n) for n, other in rows.items()]) for name, row in rows.items()]
    return reduce(DataFrame.union, wide).agg(*[F.first(f"`{n}`", ignorenulls=True).alias(n) for n in rows])


def generation_parameters(pipeline: list[dict]) -> tuple[dict, list[dict]]:
    """The generation parameters of the first $match, and the pipeline without them."""
    if pipeline and "$match" in pipeline[0]:
        params, rest = generation_params(pipeline[0]["$match"])
        return params, [{"$match": rest}, *pipeline[1:]]
    return {}, list(pipeline)
