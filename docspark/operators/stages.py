"""Pipeline stages: each takes a DataFrame and its specification and returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import numbered
from .accumulators import accumulator
from .expressions import Expressions
from .predicates import compile_filter, field_type
from .predicates import field as field_column


@dataclass
class Context:
    """What stages know beside their input: other collections, where outputs go, options, and the sort order so far."""

    collections: dict[str, DataFrame] = field(default_factory=dict)
    output_dir: str | None = None
    numeric_only_avg: bool = False
    seed: int | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)  # (path, ascending)


# Shapes


def _nested(paths: dict[str, Column | dict]) -> list[Column]:
    return [(F.struct(*_nested(v)) if isinstance(v, dict) else v).alias(k) for k, v in paths.items()]


def _tree(entries: list[tuple[str, Column]]) -> dict:
    out: dict = {}
    for path, column in entries:
        at = out
        *steps, last = path.split(".")
        for step in steps:
            at = at.setdefault(step, {})
        at[last] = column
    return out


def without(df: DataFrame, path: str) -> DataFrame:
    """df without a field; a path that isn't there changes nothing."""
    if field_type(path, df.schema) is None:
        return df
    top, _, rest = path.partition(".")
    return df.withColumn(top, F.col(f"`{top}`").dropFields(rest)) if rest else df.drop(top)


def with_value(df: DataFrame, path: str, value: Column) -> DataFrame:
    """df with a field set; missing parents become documents."""
    top, _, rest = path.partition(".")
    if not rest:
        return df.withColumn(top, value)
    if isinstance(field_type(top, df.schema), T.StructType):
        steps, depth = path.split("."), 1  # the deepest document that is there keeps its other fields
        while depth < len(steps) - 1 and isinstance(field_type(".".join(steps[: depth + 1]), df.schema), T.StructType):
            depth += 1
        below = ".".join(steps[depth + 1 :])
        made = F.struct(*_nested(_tree([(below, value)]))) if below else value
        return df.withColumn(top, F.col(f"`{top}`").withField(".".join(steps[1 : depth + 1]), made))
    return df.withColumn(top, F.struct(*_nested(_tree([(rest, value)]))))


def projected(df: DataFrame, spec: dict, keep_id: bool = False) -> DataFrame:
    """A projection: all 0 excludes; otherwise 1 keeps a field, 0 leaves it out, anything else is an expression. With keep_id, `_id` stays unless it is 0."""
    if not spec:
        raise ValueError("a projection names at least one field")
    if spec.get("__doc") == "$$ROOT":  # what a graphical client asks for: the whole document
        return df
    plain = {k: v for k, v in spec.items() if k != "_id" or not keep_id}
    if all(v in (0, False) and not isinstance(v, (str, dict)) for v in plain.values()) and not (keep_id and not plain and spec.get("_id")):
        return reduce(without, [k for k, v in spec.items() if v in (0, False)], df)
    expr = Expressions(df.schema)
    entries = []
    if keep_id and "_id" in df.columns and spec.get("_id", 1) not in (0, False):
        entries.append(("_id", F.col("_id")))
    for path, value in plain.items():
        if isinstance(value, (bool, int)) and value in (0, False):
            continue
        if isinstance(value, (bool, int)) and value in (1, True):
            if field_type(path, df.schema) is not None:
                entries.append((path, field_column(path, df.schema)))
        else:
            entries.append((path, expr(value)))
    return df.select(*_nested(_tree(entries)))


# Stages


def match(df, spec, context):
    return df.where(compile_filter(spec, df.schema, total=False))


def project(df, spec, context):
    return projected(df, spec)


def add_fields(df, spec, context):
    expr = Expressions(df.schema)  # every expression sees the input document
    top = {k: expr(v) for k, v in spec.items() if "." not in k}
    hidden = {f"__new_{i}": expr(v) for i, (k, v) in enumerate(spec.items()) if "." in k}
    out = df.withColumns({**hidden, **top})
    for name, path in zip(hidden, [k for k in spec if "." in k]):
        out = with_value(out, path, F.col(name))
    return out.drop(*hidden)


def unset(df, spec, context):
    return reduce(without, [spec] if isinstance(spec, str) else list(spec), df)


def replace_root(df, spec, context):
    root = spec["newRoot"] if isinstance(spec, dict) and "newRoot" in spec else spec
    made = df.select(Expressions(df.schema)(root).alias("__root"))
    if not isinstance(made.schema["__root"].dataType, T.StructType):
        raise ValueError("the new root must be a document")
    return made.select("__root.*")


def unwind(df, spec, context):
    spec = {"path": spec} if isinstance(spec, str) else spec
    path = spec["path"].removeprefix("$")
    keep, index = spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    if not isinstance(field_type(path, df.schema), T.ArrayType):
        return df if keep else df.limit(0)
    items = field_column(path, df.schema)
    made = (F.posexplode_outer if keep else F.posexplode)(items).alias("__index", "__item")
    out = with_value(df.select("*", made), path, F.col("__item"))
    out = out.withColumn(index, F.col("__index").cast("long")) if index else out
    return out.drop("__index", "__item")


def sort(df, spec, context):
    context.order = [(path, direction == 1) for path, direction in spec.items()]
    return df.orderBy(*sort_columns(df, spec))


def sort_columns(df: DataFrame, spec: dict) -> list[Column]:
    """Missing values come first ascending and last descending."""
    columns = [(field_column(p, df.schema) if field_type(p, df.schema) is not None else F.lit(None), d) for p, d in spec.items()]
    return [c.asc_nulls_first() if d == 1 else c.desc_nulls_last() for c, d in columns]


def limit(df, spec, context):
    return df.limit(spec)


def skip(df, spec, context):
    return skipped(df, spec, [(p, a) for p, a in context.order if field_type(p, df.schema) is not None])


def skipped(df: DataFrame, n: int, order: list[tuple[str, bool]]) -> DataFrame:
    """df without its first n rows. Rows are numbered by range partitions of the order, so none of the rest moves to one task; without an order, rows are numbered as they come."""
    keys = sort_columns(df, {p: 1 if ascending else -1 for p, ascending in order})
    rows = numbered(df, keys, "__skip").where(F.col("__skip") >= n)
    return (rows.orderBy("__skip") if keys else rows).drop("__skip")


#: Up to this number a sample is a top-k, whose rows meet in one task; beyond, rows are numbered in the order of the random keys.
TOP_K = 10_000


def sample(df, spec, context):
    # The least random keys: as many rows as asked for, all of them if there are no more.
    size, key = spec["size"], F.rand(context.seed)
    if size <= TOP_K:
        return df.orderBy(key).limit(size)
    return numbered(df.withColumn("__random", key), [F.col("__random")], "__place").where(F.col("__place") < size).drop("__random", "__place")


def _order_keys(df: DataFrame, context: Context) -> list[Column]:
    """Sort keys as ascending values; missing values come first ascending and last descending."""
    keys = []
    for path, ascending in context.order:
        kind = field_type(path, df.schema)
        if kind is None:
            continue
        c = field_column(path, df.schema)
        keys += [c] if ascending else [c.isNull(), descending(c, kind, path)]
    return keys


def descending(c: Column, kind: T.DataType, path: str) -> Column:
    """A value whose ascending order is the descending order of c."""
    if isinstance(kind, T.NumericType):
        return -c
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, (T.StringType, T.BinaryType)):  # the complement of the bytes; what goes on comes before what ends
        return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    raise ValueError(f"$first, $last and $push can't follow a descending sort by {path}: {kind.simpleString()}")


def _aggregates(df: DataFrame, spec: dict, context: Context) -> list[Column]:
    expr, keys = Expressions(df.schema), None
    out = []
    for name, acc in spec.items():
        if keys is None and isinstance(acc, dict) and next(iter(acc), "") in ("$first", "$last", "$push"):
            keys = _order_keys(df, context)
        out.append(accumulator(acc, expr, keys or [], context.numeric_only_avg).alias(name))
    return out


def group(df, spec, context):
    if "_id" not in spec:
        raise ValueError("$group needs an _id")
    aggregates = _aggregates(df, {k: v for k, v in spec.items() if k != "_id"}, context)
    if spec["_id"] is None:
        return df.groupBy(F.lit(None).cast("string").alias("_id")).agg(*aggregates or [F.count("*").alias("__n")]).drop("__n")
    keyed = df.withColumn("__key", Expressions(df.schema)(spec["_id"]))
    out = keyed.groupBy("__key").agg(*aggregates) if aggregates else keyed.select("__key").distinct()
    return out.withColumnRenamed("__key", "_id")


def count(df, spec, context):
    return df.agg(F.count("*").alias(spec))


def bucket(df, spec, context):
    expr, bounds = Expressions(df.schema), spec["boundaries"]
    if len(bounds) < 2 or sorted(bounds) != list(bounds):
        raise ValueError("$bucket needs at least two ascending boundaries")
    c, default = expr(spec["groupBy"]), spec.get("default")
    as_text = isinstance(default, str) and not isinstance(bounds[0], str)  # one column holds both kinds
    key = F.lit(None)
    for low, high in zip(bounds[-2::-1], bounds[:0:-1]):
        key = F.when((c >= low) & (c < high), F.lit(str(low) if as_text else low)).otherwise(key)
    rows = df.withColumn("__bucket", F.coalesce(key, F.lit(default)) if "default" in spec else key)
    rows = rows if "default" in spec else rows.where(F.col("__bucket").isNotNull())
    output = spec.get("output") or {}
    counts = [] if "count" in output else [F.count("*").alias("count")]
    return rows.groupBy(F.col("__bucket").alias("_id")).agg(*_aggregates(df, output, context), *counts)


def bucket_auto(df, spec, context):
    """Buckets of ceil(n / buckets) documents in sort order; _id is {min, max} of each. Ties are cut where they fall."""
    expr, n_buckets = Expressions(df.schema), spec["buckets"]
    keyed = df.withColumn("__by", expr(spec["groupBy"]))
    tie = [F.col(f"`{c.name}`") for c in df.schema.fields if not isinstance(c.dataType, (T.MapType, T.VariantType))]
    rows = numbered(keyed, [F.col("__by").asc_nulls_first(), *tie], "__row")
    size = -(-max(1, rows.count()) // n_buckets)
    made = rows.groupBy(F.floor(F.col("__row") / size).alias("__bucket")).agg(F.min("__by").alias("__min"), F.max("__by").alias("__max"), *_aggregates(df, spec.get("output") or {}, context), *([] if "count" in (spec.get("output") or {}) else [F.count("*").alias("count")]))
    return made.select(F.struct(F.col("__min").alias("min"), F.col("__max").alias("max")).alias("_id"), *[c for c in made.columns if not c.startswith("__")])


def _right(context: Context, name: str) -> DataFrame:
    if name not in context.collections:
        raise ValueError(f"$lookup: unknown collection {name}")
    return context.collections[name]


def lookup(df, spec, context):
    """Left outer join into an array of documents; missing keys match each other. Spark chooses how to join."""
    right = _right(context, spec["from"])
    key = field_column(spec["foreignField"], right.schema)
    grouped = right.select(key.alias("__foreign"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("__doc")).groupBy("__foreign").agg(F.collect_list("__doc").alias("__docs"))
    joined = df.join(grouped, field_column(spec["localField"], df.schema).eqNullSafe(F.col("__foreign")), "left")
    empty = F.array().cast(grouped.schema["__docs"].dataType)
    return with_value(joined, spec["as"], F.coalesce("__docs", empty)).drop("__foreign", "__docs")


def lookup_joined(df, spec, context, keep: bool, index: str | None = None):
    """$lookup and $unwind of its result: a plain join, without arrays."""
    right = _right(context, spec["from"])
    key = field_column(spec["foreignField"], right.schema)
    side = right.select(key.alias("__foreign"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("__doc"))
    joined = df.join(side, field_column(spec["localField"], df.schema).eqNullSafe(F.col("__foreign")), "left" if keep else "inner")
    return with_value(joined, spec["as"], F.col("__doc")).drop("__foreign", "__doc")


def lookup_filtered(df, spec, context, empty: bool):
    """$lookup and a $match for an empty (or not empty) result: an anti (or semi) join. The array of an anti join is empty for all."""
    right = _right(context, spec["from"])
    keys = right.select(field_column(spec["foreignField"], right.schema).alias("__foreign"))
    kept = df.join(keys, field_column(spec["localField"], df.schema).eqNullSafe(F.col("__foreign")), "left_anti" if empty else "left_semi")
    docs = T.ArrayType(right.schema)
    return with_value(kept, spec["as"], F.array().cast(docs)) if empty else lookup(kept, spec, context)


def coll_stats(df, spec, context):
    return df.agg(F.count("*").alias("count")).withColumn("n_fields", F.lit(len(df.columns)))


def out(df, spec, context):
    name = spec if isinstance(spec, str) else spec["coll"]
    return _stored(df, name, context)


def merge(df, spec, context):
    """Documents of the target whose `on` keys come in again are replaced; the others stay."""
    name = spec if isinstance(spec, str) else spec["into"]
    keys = spec.get("on", "_id") if isinstance(spec, dict) else "_id"
    keys = [keys] if isinstance(keys, str) else list(keys)
    if name in context.collections:
        old = context.collections[name].join(df.select(*keys), keys, "left_anti")
        return _stored(old.unionByName(df, allowMissingColumns=True), name, context)
    return _stored(df, name, context)


def _stored(df: DataFrame, name: str, context: Context) -> DataFrame:
    if context.output_dir is None:
        raise ValueError("$out and $merge need an output folder")
    from ..sources.collections import write_collection

    context.collections[name] = write_collection(df, context.output_dir, name)
    return context.collections[name]


STAGES = {
    "$match": match, "$project": project, "$addFields": add_fields, "$set": add_fields, "$unset": unset, "$replaceRoot": replace_root, "$replaceWith": replace_root, "$unwind": unwind,
    "$sort": sort, "$limit": limit, "$skip": skip, "$sample": sample, "$group": group, "$count": count, "$bucket": bucket, "$bucketAuto": bucket_auto, "$lookup": lookup, "$collStats": coll_stats, "$out": out, "$merge": merge,
}
