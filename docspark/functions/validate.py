"""Outliers: rows scored against a model, all in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import field_type
from ..operators.predicates import field as field_column
from .profile import FORMATS, character_entropy, shape

VALID_SCORE, COMPLEXITY_FACTOR, MAX_Z = 2.0, 1.5, 3.0
#: Prefix of the column that tells whether a field's value is in the model's tables of values.
KNOWN = "__known_"
OUTLIER = "array<struct<path:string,field_type:string,deviation:double,value:string,reason:string>>"


def _outlier(path: str, kind: str, deviation: Column, value: Column, reason: Column) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(kind).alias("field_type"), deviation.cast("double").alias("deviation"), value.cast("string").alias("value"), reason.alias("reason"))


def number_outliers(path: str, c: Column, h: dict) -> list[tuple[Column, Column]]:
    """(condition, outlier) of a number against a histogram: outside its range, or too many deviations from its middle."""
    low, high, sd = float(h["minValue"]), float(h["maxValue"]), float(h.get("standardDeviation") or 0)
    c = c.cast("double")
    span = (high - low) or 1.0
    far = F.greatest(F.abs(c - low), F.abs(c - high)) / span
    out = [((c < low) | (c > high), _outlier(path, "number", far, c, F.concat(F.lit("value outside ["), F.lit(str(low)), F.lit(", "), F.lit(str(high)), F.lit("]"))))]
    if sd > 0:
        z = F.abs(c - (low + high) / 2) / sd
        out.append((z > MAX_Z, _outlier(path, "number", z / MAX_Z, c, F.concat(F.lit("z-score "), F.format_number(z, 2)))))
    return out


def string_outliers(path: str, c: Column, m: dict) -> list[tuple[Column, Column]]:
    """(condition, outlier) of a text: too complex, of unknown length, with unknown characters. Texts that the model knows, itself or by its tables of values, are never outliers."""
    known = c.isin(list(m["valueFrequency"])) if m.get("valueFrequency") else F.lit(False)
    if m.get("valueTables"):
        known = known | F.col(f"`{KNOWN}{path}`")
    middle = (m["minLength"] + m["maxLength"]) / 2 or 1
    complexity = character_entropy(c) * (1 + F.abs(F.length(c) - middle) / middle)
    expected = m.get("complexity") or 1e-9
    characters = F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")
    unknown = F.array_except(characters, F.array(*[F.lit(x) for x in m.get("uniqueCharacters", [])])) if m.get("uniqueCharacters") else F.array().cast("array<string>")
    reasons = F.concat_ws("; ", F.when(F.size(characters) / F.length(c) > 0.8, "high randomness"), F.when(~shape(c).isin(list(m["patterns"])), "unknown shape") if m.get("patterns") else F.lit(None), F.when(F.size(unknown) / F.length(c) > 0.3, "unusual characters"))
    return [
        (~known & (F.length(c) > 0) & (complexity > expected * COMPLEXITY_FACTOR), _outlier(path, "string", (complexity - expected) / expected, c, F.when(reasons == "", "unlike what was learned").otherwise(reasons))),
        (~known & ((F.length(c) < m["minLength"]) | (F.length(c) > m["maxLength"])), _outlier(path, "string", F.lit(1.0), c, F.concat(F.lit("length "), F.length(c).cast("string"), F.lit(f" outside [{m['minLength']}, {m['maxLength']}]")))),
        (~known & (F.size(unknown) > 0), _outlier(path, "string", F.lit(0.5), c, F.concat(F.lit("unknown characters: "), F.array_join(F.array_sort(unknown), ", ")))),
    ]


def _checks(model: dict, df: DataFrame, prefix: str = "") -> list[tuple[Column, Column]]:
    out = []
    for name, sub in (model.get("properties") or {}).items():
        path = f"{prefix}{name}"
        kind = field_type(path, df.schema)
        if kind is None:
            continue
        c = field_column(path, df.schema)
        for branch in sub.get("anyOf", [sub]):
            if branch.get("type") == "object" and isinstance(kind, T.StructType):
                out += _checks(branch, df, f"{path}.")
            elif "histogram" in branch and isinstance(kind, T.NumericType):
                whole = [c.isNotNull() & (c == F.floor(c) if branch["type"] == "integer" else c != F.floor(c))] if "anyOf" in sub else []
                out += [(reduce(lambda a, b: a & b, whole, test), o) for test, o in number_outliers(path, c, branch["histogram"])]
            elif "stringModel" in branch and isinstance(kind, T.StringType):
                out += string_outliers(path, c, branch["stringModel"])
    return out


def _item_checks(model: dict, df: DataFrame, prefix: str = "") -> list[Column]:
    """Lists of outliers among the items of lists of numbers and texts."""
    out = []
    for name, sub in (model.get("properties") or {}).items():
        path = f"{prefix}{name}"
        kind, items = field_type(path, df.schema), sub.get("items") or {}
        if isinstance(kind, T.StructType) and sub.get("type") == "object":
            out += _item_checks(sub, df, f"{path}.")
        if not isinstance(kind, T.ArrayType):
            continue
        c = field_column(path, df.schema)
        for branch in items.get("anyOf", [items]):
            number = "histogram" in branch and isinstance(kind.elementType, T.NumericType)
            if not number and not ("stringModel" in branch and isinstance(kind.elementType, T.StringType)):
                continue
            judge = (lambda x, h=branch.get("histogram"): number_outliers(f"{path}[]", x, h)) if number else (lambda x, m=branch.get("stringModel"): string_outliers(f"{path}[]", x, m))  # noqa: B023
            out += [_judged_items(c, judge, i) for i in range(len(judge(F.lit(None).cast(kind.elementType))))]
    return out


def _judged_items(c: Column, judge, i: int) -> Column:
    """The outliers of a list by the i-th test."""
    wrong = F.filter(c, lambda x: F.coalesce(judge(x)[i][0], F.lit(False)))
    return F.coalesce(F.transform(wrong, lambda x: judge(x)[i][1]), F.array().cast(OUTLIER))


def _with_known(df: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """df joined with the tables of values of the model's text fields; Spark chooses how."""
    for name, sub in (model.get("properties") or {}).items():
        path = f"{prefix}{name}"
        if sub.get("type") == "object" and field_type(path, df.schema) is not None:
            df = _with_known(df, sub, f"{path}.")
        tables = [t for b in sub.get("anyOf", [sub]) for t in (b.get("stringModel") or {}).get("valueTables", [])]
        if tables and isinstance(field_type(path, df.schema), T.StringType):
            values = df.sparkSession.read.parquet(*tables).select(F.col("value").alias("__value")).distinct().withColumn(KNOWN + path, F.lit(True))
            df = df.join(values, field_column(path, df.schema) == F.col("__value"), "left").drop("__value").withColumn(KNOWN + path, F.coalesce(F.col(f"`{KNOWN}{path}`"), F.lit(False)))
    return df


def score(df: DataFrame, model: dict) -> DataFrame:
    """df with outliers, score (mean deviation; 0 without outliers) and valid. Null fields aren't judged; items of lists are judged one by one."""
    columns, df = df.columns, _with_known(df, model)
    found = [F.when(F.coalesce(test, F.lit(False)), outlier) for test, outlier in _checks(model, df)]
    own = F.array_compact(F.array(*found)) if found else F.array().cast(OUTLIER)
    rows = df.withColumn("outliers", F.concat(own, *_item_checks(model, df))).select(*[f"`{c}`" for c in columns if c != "outliers"], "outliers")
    total = F.aggregate("outliers", F.lit(0.0), lambda acc, o: acc + o["deviation"])
    return rows.withColumn("score", F.when(F.size("outliers") > 0, total / F.size("outliers")).otherwise(0.0)).withColumn("valid", F.col("score") <= VALID_SCORE)


_TYPES = {"integer": T.IntegralType, "number": T.NumericType, "string": T.StringType, "boolean": T.BooleanType, "array": T.ArrayType, "object": (T.StructType, T.MapType)}


def check_samples(df: DataFrame, model: dict) -> DataFrame:
    """df with errors, the constraints of the model that a row breaks: required, type, bounds, lengths, pattern, format, enum."""
    tests: list[tuple[str, Column]] = []
    for name in model.get("required", []):
        missing = F.lit(True) if name not in df.columns else F.col(f"`{name}`").isNull()
        tests.append((f"{name}: required", missing))
    for name, m in (model.get("properties") or {}).items():
        kind = field_type(name, df.schema)
        if kind is None:
            continue
        if m.get("temporal"):
            continue
        c = F.col(f"`{name}`")
        if m.get("type") in _TYPES and not isinstance(kind, _TYPES[m["type"]]):
            whole = m["type"] == "integer" and isinstance(kind, T.NumericType)
            tests.append((f"{name}: type", c != F.floor(c) if whole else c.isNotNull()))
            if not whole:
                continue
        for key, test in (("minimum", lambda v, c=c: c < v), ("maximum", lambda v, c=c: c > v), ("minLength", lambda v, c=c: F.length(c) < v), ("maxLength", lambda v, c=c: F.length(c) > v), ("minItems", lambda v, c=c: F.size(c) < v), ("maxItems", lambda v, c=c: F.size(c) > v), ("pattern", lambda v, c=c: ~c.rlike(v)), ("enum", lambda v, c=c: ~c.isin(list(v)))):
            if m.get(key) is not None:
                tests.append((f"{name}: {key}", test(m[key])))
        if m.get("format") in FORMATS:
            tests.append((f"{name}: format", ~c.rlike(FORMATS[m["format"]])))
    errors = [F.when(F.coalesce(test, F.lit(False)), F.lit(what)) for what, test in tests]
    return df.withColumn("errors", F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>"))


def sample_report(df: DataFrame, model: dict) -> dict:
    """n, n_valid, rate and the first five kinds of errors."""
    rows = check_samples(df, model)
    totals = rows.agg(F.count("*").alias("n"), F.count_if(F.size("errors") == 0).alias("n_valid")).first()
    kinds = rows.select(F.explode("errors").alias("e")).groupBy("e").count().orderBy(F.desc("count"), "e").limit(5).collect()
    return {"n": totals["n"], "n_valid": totals["n_valid"], "rate": totals["n_valid"] / totals["n"] if totals["n"] else 1.0, "errors": {r["e"]: r["count"] for r in kinds}}

