"""Statistics that a model is made of, each as a DataFrame: ranges, histograms, string shapes, n-grams, affixes, enums, formats.

Ties in top-n lists are cut by (count descending, key ascending).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 10
#: Fewer numbers than this have no histogram.
HISTOGRAM_LEAST = 10
TOP_PATTERNS, TOP_AFFIXES, TOP_NGRAMS, TOP_SAMPLES = 10, 10, 20, 20

# The formats, tried in this order, and the four code patterns.
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "uri": r"(?i)^https?://[^\s/$.?#].[^\s]*$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?(Z|[+-]\d{2}:\d{2})?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "time": r"^\d{2}:\d{2}:\d{2}(\.\d{3})?$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(25[0-5]|2[0-4]\d|[01]?\d?\d)$",
    "ipv6": r"(?i)^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$",
}
PATTERNS = [r"^[A-Z]{2,4}-\d{3,5}$", r"^[A-Z]\d{6}$", r"^\d{3}-\d{3}-\d{4}$", r"^[A-Z]{3}\d{3}$"]


def half_up(c: Column, digits: int) -> Column:
    """Rounds as floor(x * 10^digits + 0.5) does."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def present(df: DataFrame, path: str, weight: str | None = None) -> DataFrame:
    """The values v of one field that aren't null, and how often each row counts (w: a column, else 1)."""
    return df.select(F.col(path).alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).where(F.col("v").isNotNull())


def top(df: DataFrame, n: int, count: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(count), F.asc(key)).limit(n)


# Structure


#: What a VARIANT value of each scalar kind is read as.
VARIANT_TYPES = {"boolean": "boolean", "integer": "bigint", "number": "double", "string": "string"}


def variant_kind(c: Column) -> Column:
    """object, array, string, boolean, integer (whole numbers however written), number or null of a VARIANT; null where there is no value at all."""
    name = F.schema_of_variant(c)
    number = F.try_variant_get(c, "$", "double")
    kind = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
    return kind.when(name.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(number == F.floor(number), "integer").otherwise("number")).when(name.isNotNull(), "string")


def logical_type(c: Column, kind: T.DataType) -> Column:
    """The logical type of each value: a double that is whole is an integer."""
    if isinstance(kind, T.BooleanType):
        name = F.lit("boolean")
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        name = F.when(c == F.floor(c), "integer").otherwise("number")
    elif isinstance(kind, T.IntegralType):
        name = F.lit("integer")
    elif isinstance(kind, T.StringType):
        name = F.lit("string")
    elif isinstance(kind, T.ArrayType):
        name = F.lit("array")
    else:
        name = F.lit("object")
    return F.when(c.isNull(), "null").otherwise(name)


def fields(df: DataFrame) -> DataFrame:
    """Per top-level field: path, n, n_present, required, types (sorted logical types of its values). One pass over the data."""
    aggregates = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggregates += [F.count(c).alias(f"n{i}"), F.array_sort(F.collect_set(F.when(c.isNotNull(), logical_type(c, f.dataType)))).alias(f"t{i}")]
    row = df.agg(*aggregates)
    each = F.array(*[F.struct(F.lit(f.name).alias("path"), F.col("__n").alias("n"), F.col(f"n{i}").alias("n_present"), (F.col(f"n{i}") == F.col("__n")).alias("required"), F.col(f"t{i}").alias("types")) for i, f in enumerate(df.schema.fields)])
    return row.select(F.explode(each).alias("f")).select("f.*")


def arrays(df: DataFrame, path: str) -> DataFrame:
    """min_items, max_items, unique_items (whether any list is free of repeats)."""
    c = F.col(path)
    return df.where(c.isNotNull()).agg(F.min(F.size(c)).alias("min_items"), F.max(F.size(c)).alias("max_items"), F.bool_or(F.size(F.array_distinct(c)) == F.size(c)).alias("unique_items"))


# Numbers


def numbers(df: DataFrame, paths: list[str]) -> DataFrame:
    """Per field: path, n, minimum, maximum, average, standard_deviation (of a sample; 0 of one value). One pass."""
    aggregates = []
    for i, p in enumerate(paths):
        c = F.col(p).cast("double")
        aggregates += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.avg(c).alias(f"m{i}"), F.coalesce(F.stddev_samp(c), F.when(F.count(c) > 0, F.lit(0.0))).alias(f"s{i}")]
    row = df.agg(*aggregates)
    names = ["n", "minimum", "maximum", "average", "standard_deviation"]
    each = F.array(*[F.struct(F.lit(p).alias("path"), *[F.col(f"{k}{i}").alias(name) for k, name in zip("nabms", names)]) for i, p in enumerate(paths)])
    return row.select(F.explode(each).alias("f")).select("f.*")


def histogram(df: DataFrame, path: str, bins: int = BINS) -> DataFrame:
    """bin, range_start, range_end, n, freq_start, freq_end (cumulative per cent, two digits), total; empty bins are left out, the last bin is closed.

    A constant has one bin from 0 to 100 per cent; fewer than HISTOGRAM_LEAST numbers have none.
    """
    values = df.select(F.col(path).cast("double").alias("v")).where(F.col("v").isNotNull())
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total")).where(F.col("total") >= HISTOGRAM_LEAST)
    width = (F.col("hi") - F.col("lo")) / bins
    edge = lambda i: F.col("lo") + width * i
    rows = values.join(F.broadcast(bounds))  # one row
    place = reduce(lambda other, i: F.when(F.col("v") >= edge(i), F.lit(i)).otherwise(other), range(1, bins), F.lit(0))
    binned = rows.groupBy("lo", "hi", "total", F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(place).alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.col("total")
    running = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # at most `bins` rows
    one = F.col("lo") == F.col("hi")
    return binned.select("bin", half_up(F.when(one, F.col("lo")).otherwise(edge(F.col("bin"))), 4).alias("range_start"), half_up(F.when(one, F.col("hi")).otherwise(edge(F.col("bin") + 1)), 4).alias("range_end"), "n", half_up(running * 100.0 / F.col("total") - share, 2).alias("freq_start"), half_up(running * 100.0 / F.col("total"), 2).alias("freq_end"), "total")


def histograms(df: DataFrame, bounds: dict[str, tuple[float, float]], bins: int = BINS) -> dict[str, list[int]]:
    """Counts per bin of many fields, whose least and greatest values are known, in one pass."""
    aggregates, names = [], list(bounds)
    for i, name in enumerate(names):
        c, (low, high) = F.col(name).cast("double"), bounds[name]
        edges = [F.lit(low) + (high - low) / bins * k for k in range(bins)]
        for k in range(bins if high > low else 1):
            upper = c < edges[k + 1] if high > low and k + 1 < bins else F.lit(True)
            aggregates.append(F.count_if((c >= edges[k]) & upper).alias(f"h{i}_{k}"))
    row = df.agg(*aggregates).first() if aggregates else {}
    return {name: [row[f"h{i}_{k}"] for k in range(bins if bounds[name][1] > bounds[name][0] else 1)] for i, name in enumerate(names)}


def histogram_entropy(bins: DataFrame) -> DataFrame:
    """entropy, max_entropy (four digits) of a histogram's bins."""
    p = F.col("n") / F.col("total")
    return bins.agg(half_up(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)), 4).alias("entropy"), half_up(F.when(F.count("*") > 0, F.log2(F.count("*").cast("double"))).otherwise(0.0), 4).alias("max_entropy"))


def histogram_complexity(bins: list[dict], total: int, low: float, high: float, deviation: float, entropy: float) -> float:
    """Four weighted parts: entropy 0.4, bins 0.2, relative deviation 0.2, evenness 0.2."""
    if not bins:
        return 0.0
    score = 0.4 * entropy + 0.2 * min(len(bins) / min(total, 100), 1.0)
    if high not in (low, 0):
        score += 0.2 * min(deviation / (high - low), 1.0)
    even = total / len(bins)
    score += 0.2 * max(0.0, 1 - min(sum(((b["count"] - even) / even) ** 2 for b in bins) / len(bins), 1))
    return math.floor(score * 10_000 + 0.5) / 10_000


def multiple_of(df: DataFrame, paths: list[str]) -> DataFrame:
    """Per integer field: path, multiple_of: the greatest number over 1 and below the maximum that divides every value, else null.

    Each task folds its rows into one gcd a field; one row a task meets in the last step, after a shuffle (without one, the last task would read all of the table).
    """
    n = len(paths)
    schema = ", ".join(f"g{i} long, m{i} long" for i in range(n))

    def fold(batches):
        gcds, most = [0] * n, [None] * n
        for batch in batches:
            for i in range(n):
                g, m = batch.column(2 * i), batch.column(2 * i + 1)
                if len(g) > g.null_count:
                    gcds[i] = math.gcd(gcds[i], int(np.gcd.reduce(np.abs(g.drop_null().to_numpy()))))
                if len(m) > m.null_count:
                    top_value = int(m.drop_null().to_numpy().max())
                    most[i] = top_value if most[i] is None else max(most[i], top_value)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for i in range(n) for x in (gcds[i], most[i])], [f"{k}{i}" for i in range(n) for k in "gm"])

    values = df.select(*[F.col(p).cast("long").alias(f"{k}{i}") for i, p in enumerate(paths) for k in "gm"])
    row = values.mapInArrow(fold, schema).repartition(1).mapInArrow(fold, schema)
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.when((F.col(f"g{i}") > 1) & (F.col(f"g{i}") < F.col(f"m{i}")), F.col(f"g{i}")).alias("multiple_of")) for i, p in enumerate(paths)])
    return row.select(F.explode(each).alias("f")).select("f.*")


# Strings


def lengths(df: DataFrame, paths: list[str], weight: str | None = None) -> DataFrame:
    """Per field: path, n, n_distinct, min_length, max_length, average_length (two digits), in code points. n_distinct by a map-side combined count."""
    parts = []
    for p in paths:
        counts = value_counts(df, p, weight)
        size = F.length("value")
        parts.append(counts.agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), half_up(F.sum(size * F.col("n")) / F.sum("n"), 2).alias("average_length")).select(F.lit(p).alias("path"), "*"))
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, path: str, weight: str | None = None) -> DataFrame:
    return present(df, path, weight).groupBy(F.col("v").alias("value")).agg(F.sum("w").alias("n"))


def character_counts(df: DataFrame, path: str, weight: str | None = None) -> DataFrame:
    """ch, n, probability (four digits) of every code point."""
    counts = present(df, path, weight).select(F.explode(F.split("v", "")).alias("ch"), "w").where(F.col("ch") != "").groupBy("ch").agg(F.sum("w").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("ch", "n", half_up(F.col("n") / F.col("total"), 4).alias("probability"))


def shape(c: Column) -> Column:
    """Character classes (d digit, U upper, L lower, s white space, p other), runs of two and more as d{n}."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z\s]", "\u0001"), r"[0-9]", "\u0002"), r"[A-Z]", "\u0003"), r"[a-z]", "\u0004"), r"\s", "\u0005")
    runs = F.regexp_extract_all(F.translate(classes, "\u0001\u0002\u0003\u0004\u0005", "pdULs"), F.lit(r"(d+|U+|L+|s+|p+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.substring(r, 1, 1), F.when(F.length(r) > 1, F.concat(F.lit("{"), F.length(r).cast("string"), F.lit("}"))).otherwise(""))), "")


def shapes(df: DataFrame, path: str, weight: str | None = None) -> DataFrame:
    """pattern, n of the most frequent shapes."""
    return top(present(df, path, weight).groupBy(shape(F.col("v")).alias("pattern")).agg(F.sum("w").alias("n")), TOP_PATTERNS, "n", "pattern")


def affixes(df: DataFrame, path: str, kind: str, weight: str | None = None) -> DataFrame:
    """affix, n: prefixes or suffixes of one to three characters (no longer than the shortest value) that occur more than once."""
    values = present(df, path, weight)
    longest = values.agg(F.least(F.lit(3), F.min(F.length("v"))).alias("k"))
    rows = values.join(F.broadcast(longest)).where("k > 0").select("v", "w", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("size"))
    cut = F.left(F.col("v"), F.col("size")) if kind == "prefix" else F.right(F.col("v"), F.col("size"))
    return top(rows.groupBy(cut.alias("affix")).agg(F.sum("w").alias("n")).where("n > 1"), TOP_AFFIXES, "n", "affix")


def ngrams(df: DataFrame, path: str, sizes: tuple[int, ...] = (2, 3), limit: int | None = TOP_NGRAMS, weight: str | None = None) -> DataFrame:
    """gram, n: character n-grams that occur more than once."""
    values = present(df, path, weight)
    each = [_grams(F.col("v"), k) for k in sizes]
    counts = values.select(F.explode(F.concat(*each)).alias("gram"), "w").groupBy("gram").agg(F.sum("w").alias("n")).where("n > 1")
    return top(counts, limit, "n", "gram") if limit else counts


def _grams(c: Column, k: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1)))
    return F.when(F.length(c) >= k, F.transform(places, lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def entropy(counts: DataFrame) -> DataFrame:
    """entropy (bits, four digits), n, n_distinct of a table of counts n."""
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total)).agg(half_up(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)), 4).alias("entropy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"))


def character_entropy(c: Column) -> Column:
    """Shannon entropy of the characters of each value, without an exchange."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    sizes = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)).cast("double") / F.size(chars))
    return F.aggregate(sizes, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def format_of(df: DataFrame, paths: list[str]) -> DataFrame:
    """Per field: path, format: the one that every value has, or null. One pass."""
    found = F.lit(None).cast("string")
    row = df.agg(*[F.min(_format(F.col(p))).alias(f"a{i}") for i, p in enumerate(paths)], *[F.max(_format(F.col(p))).alias(f"b{i}") for i, p in enumerate(paths)])
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.when((F.col(f"a{i}") == F.col(f"b{i}")) & (F.col(f"a{i}") != ""), F.col(f"a{i}")).otherwise(found).alias("format")) for i, p in enumerate(paths)])
    return row.select(F.explode(each).alias("f")).select("f.*")


def _format(c: Column) -> Column:
    named = reduce(lambda other, item: F.when(c.rlike(item[1]), item[0]).otherwise(other), reversed(list(FORMATS.items())), F.lit(""))
    return F.when(c.isNotNull(), named)


def pattern_of(df: DataFrame, paths: list[str]) -> DataFrame:
    """Per field of three values or more: path, pattern: the first that every value matches, or null."""
    row = df.agg(*[F.when(F.count(p) >= 3, reduce(lambda other, r, p=p: F.when(F.bool_and(F.col(p).rlike(r)), r).otherwise(other), reversed(PATTERNS), F.lit(None))).alias(f"p{i}") for i, p in enumerate(paths)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"p{i}").alias("pattern")) for i, p in enumerate(paths)])).alias("f")).select("f.*")


def enum_of(df: DataFrame, path: str, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """path, n, n_distinct, is_enum, values (sorted; null if no enum): few distinct values for the number of values.

    At most 21 values are gathered, more can't be an enum.
    """
    counts = value_counts(df, path, weight)
    stats = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"))
    few = counts.select("value").orderBy("value").limit(21).agg(F.array_sort(F.collect_list("value")).alias("first_values"))
    d, n = F.col("n_distinct"), F.col("n")
    is_enum = (n > 0) & (((d / F.greatest(n, F.lit(1)) < threshold) & (d <= 20)) | ((d <= 5) & (n >= 3)))
    return stats.join(F.broadcast(few)).select(F.lit(path).alias("path"), "n", "n_distinct", is_enum.alias("is_enum"), F.when(is_enum, F.col("first_values")).alias("values"))


def relationships(df: DataFrame) -> DataFrame:
    """path, unique_ratio of fields whose names and values look like references to other documents."""
    named = [f.name for f in df.schema.fields if _looks_like_reference(f.name) and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    parts = [df.agg((F.count_distinct(F.col(f"`{c}`")) / F.count(F.col(f"`{c}`"))).alias("unique_ratio")).select(F.lit(c).alias("path"), "unique_ratio") for c in named]
    if not parts:
        return df.sparkSession.createDataFrame([], "path string, unique_ratio double")
    return reduce(DataFrame.unionByName, parts).where("unique_ratio > 0.5")


def _looks_like_reference(name: str) -> bool:
    low = name.lower()
    return low != "_id" and (low.endswith(("_id", "_ref", "_key")) or low.startswith(("parent_", "child_", "reference_", "related_")))
