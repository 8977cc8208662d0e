"""Models: a JSON-Schema-like description of documents with histograms and string statistics. Inference from a DataFrame, and merging of two models."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, written
from . import profile as P

#: Values that a model itself holds, with their frequencies, so that it stays a small document. All of them, where there are more, are in a table beside the model, if Options.values_dir names a folder.
KEPT_VALUES = 10_000
#: Whole numbers with more distinct values than this, by an approximate count that is within a few percent, are no enums (20 values are the most).
MAY_BE_ENUM = 40


@dataclass
class Options:
    enum_threshold: float = 0.5
    formats: bool = True
    patterns: bool = True
    string_models: bool = True
    histograms: bool = True
    relationships: bool = False
    values_dir: str | None = None  # a folder that driver and executors share


def infer(df: DataFrame, options: Options | None = None) -> dict:
    """The model of a DataFrame's documents. All statistics come from aggregations over all rows; the driver gets their results only."""
    options = options or Options()
    model = _object(df, options)
    if options.relationships:
        model["relationships"] = [r.asDict() for r in P.relationships(df).collect()]
    return model


def infer_documents(df: DataFrame, column: str = "doc", options: Options | None = None) -> dict:
    """The model of a VARIANT column: documents whose fields, items and roots may be of several types, which become an anyOf. Nulls say nothing of a type."""
    return _variant(df.select(F.col(column).alias("v")), options or Options())


def _variant(df: DataFrame, options: Options) -> dict:
    kind = P.variant_kind(F.col("v"))
    found = {r["kind"] for r in df.groupBy(kind.alias("kind")).count().collect()} - {None, "null"}  # a row a kind
    branches = []
    for k in sorted(found):
        rows = df.where(kind == k)
        if k in ("object", "array"):
            parts = written(df.sparkSession.sql(f"SELECT e.{'key' if k == 'object' else 'pos'} AS name, e.value AS v FROM {{rows}}, LATERAL variant_explode(v) AS e", rows=rows), "variant-parts")
            branches.append(_variant_object(rows, parts, options) if k == "object" else _variant_array(rows, parts, options))
            discard(parts)
        else:
            scalar = _object(rows.select(F.try_variant_get("v", "$", P.VARIANT_TYPES[k]).alias("v")), options)["properties"]["v"]
            branches.append({key: value for key, value in scalar.items() if key not in ("count", "present")})
    return branches[0] if len(branches) == 1 else {"anyOf": branches} if branches else {}


def _variant_object(rows: DataFrame, parts: DataFrame, options: Options) -> dict:
    n = rows.count()
    names = {r["name"]: r for r in parts.groupBy("name").agg(F.count("*").alias("n"), F.count_if(P.variant_kind(F.col("v")) != "null").alias("present")).collect()}  # a row a field of the model
    properties = {name: _variant(parts.where(F.col("name") == name).select("v"), options) | {"count": n, "present": r["present"]} for name, r in sorted(names.items())}
    return {"type": "object", "properties": properties, "required": sorted(name for name, r in names.items() if r["present"] == n)}


def _variant_array(rows: DataFrame, parts: DataFrame, options: Options) -> dict:
    size = F.size(F.try_variant_get("v", "$", "array<variant>"))
    stats = rows.agg(F.min(size).alias("low"), F.max(size).alias("high")).first()
    items = _variant(parts.select("v"), options)
    return {"type": "array", "minItems": stats["low"], "maxItems": stats["high"], **({"items": items} if items else {})}


@dataclass
class _Branch:
    """The values of one scalar field that have one logical type, as a column of a view."""

    field: str
    kind: str
    column: str
    values: F.Column


def _object(df: DataFrame, options: Options) -> dict:
    found = {r["path"]: r for r in P.fields(df).collect()} if df.columns else {}
    properties: dict[str, dict] = {}
    branches: list[_Branch] = []
    for f in df.schema.fields:
        stats, c = found[f.name], F.col(f"`{f.name}`")
        if not stats["n_present"]:
            continue  # nothing is known of a field that is always null
        if isinstance(f.dataType, T.StructType):
            properties[f.name] = _object(df.where(c.isNotNull()).select(f"`{f.name}`.*"), options)
        elif isinstance(f.dataType, T.ArrayType):
            properties[f.name] = _array(df, f, options)
        else:
            properties[f.name] = {}
            branches += _branches(f, c, list(stats["types"]), len(branches))
    models = _scalars(df.select(*[b.values.alias(b.column) for b in branches]), df.schema, branches, options) if branches else {}
    for name in properties:
        mine = [models[b.column] for b in branches if b.field == name]
        if mine:
            properties[name] = mine[0] if len(mine) == 1 else {"anyOf": mine}
        properties[name] |= {"count": found[name]["n"], "present": found[name]["n_present"]}
    return {"type": "object", "properties": properties, "required": sorted(n for n, r in found.items() if r["required"] and r["n"])}


def _branches(f: T.StructField, c: F.Column, kinds: list[str], first: int) -> list[_Branch]:
    one = len(kinds) == 1
    return [_Branch(f.name, k, f"c{first + i}", c if one else F.when(P.logical_type(c, f.dataType) == k, c)) for i, k in enumerate(kinds)]


def _array(df: DataFrame, f: T.StructField, options: Options) -> dict:
    stats = P.arrays(df, f"`{f.name}`").first()
    out = {"type": "array", "minItems": stats["min_items"], "maxItems": stats["max_items"]}
    if stats["unique_items"]:
        out["uniqueItems"] = True
    element = f.dataType.elementType
    items = df.select(F.explode(f"`{f.name}`").alias("v"))
    if isinstance(element, T.StructType):
        out["items"] = _object(items.where("v IS NOT NULL").select("v.*"), options)
    elif isinstance(element, T.ArrayType):
        out["items"] = _array(items.where("v IS NOT NULL"), T.StructField("v", element), options)
    else:
        known = _object(items, options)["properties"].get("v")
        if known:
            out["items"] = {k: v for k, v in known.items() if k not in ("count", "present")}
    return out


def _scalars(view: DataFrame, schema: T.StructType, branches: list[_Branch], options: Options) -> dict[str, dict]:
    """Models by column of the view. All numbers share three passes over the data, all texts two; each text column is counted once, and the rest comes from the counts."""
    out: dict[str, dict] = {b.column: {"type": b.kind} for b in branches}
    dates = [b.column for b in branches if isinstance(schema[b.field].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    numeric = [b.column for b in branches if b.kind in ("integer", "number")]
    whole = [b.column for b in branches if b.kind == "integer"]
    texts = [b.column for b in branches if b.kind == "string"]
    if dates:  # a date is an object; its range is kept in seconds
        row = view.agg(*[f(F.unix_timestamp(F.col(c).cast("timestamp"))).alias(f"{c}_{name}") for c in dates for name, f in (("minimum", F.min), ("maximum", F.max))]).first()
        for c in dates:
            out[c] |= {"temporal": True, "minimum": row[f"{c}_minimum"], "maximum": row[f"{c}_maximum"]}
    if numeric:
        stats = {r["path"]: r for r in P.numbers(view, numeric).collect()}
        for c in numeric:
            cast = int if c in whole else float
            out[c] |= {"minimum": cast(stats[c]["minimum"]), "maximum": cast(stats[c]["maximum"])}
        if whole:
            for r in P.multiple_of(view, whole).collect():
                if r["multiple_of"]:
                    out[r["path"]]["multipleOf"] = r["multiple_of"]
        if options.histograms:
            bounds = {c: (stats[c]["minimum"], stats[c]["maximum"]) for c in numeric if stats[c]["n"] >= P.HISTOGRAM_LEAST}
            for c, counts in P.histograms(view, bounds).items():
                out[c]["histogram"] = histogram_model(counts, stats[c])
    if texts and options.formats:
        for r in P.format_of(view, texts).collect():
            if r["format"]:
                out[r["path"]]["format"] = r["format"]
    if texts and options.patterns:
        for r in P.pattern_of(view, texts).collect():
            if r["pattern"]:
                out[r["path"]]["pattern"] = r["pattern"]
    for c in texts:
        counts = written(P.value_counts(view, c), "value-counts")
        stats = P.lengths(counts, ["value"], "n").first()
        out[c] |= {"minLength": stats["min_length"], "maxLength": stats["max_length"]}
        if options.string_models:
            out[c]["stringModel"] = string_model(counts, stats)
            if options.values_dir and stats["n_distinct"] > KEPT_VALUES:
                path = f"{options.values_dir}/values-{uuid.uuid4().hex}"
                counts.write.parquet(path)
                out[c]["stringModel"]["valueTables"] = [path]
        _add_enum(out[c], P.enum_of(counts, "value", options.enum_threshold, "n").first())
    few = view.agg(*[F.approx_count_distinct(c).alias(c) for c in whole]).first() if whole else {}
    for c in whole:
        if few[c] <= MAY_BE_ENUM:
            _add_enum(out[c], P.enum_of(view, c, options.enum_threshold).first())
    return out


def _add_enum(m: dict, enum) -> None:
    if enum["is_enum"]:
        m["enum"] = list(enum["values"])


def histogram_model(counts: list[int], stats) -> dict:
    """The bins of counts over the range of stats; empty bins are left out."""
    total, low, high = sum(counts), float(stats["minimum"]), float(stats["maximum"])
    width, before, rows = (high - low) / len(counts), 0, []
    for i, n in enumerate(counts):
        if n:
            rows.append({"rangeStart": _four(low + width * i), "rangeEnd": _four(low + width * (i + 1)), "count": n, "freqStart": math.floor(before * 10_000 / total + 0.5) / 100, "freqEnd": math.floor((before + n) * 10_000 / total + 0.5) / 100})
        before += n
    entropy = _four(-sum(r["count"] / total * math.log2(r["count"] / total) for r in rows) or 0.0)
    return {
        "bins": rows, "totalCount": total, "minValue": low, "maxValue": high, "standardDeviation": stats["standard_deviation"], "entropyScore": entropy, "maxEntropy": _four(math.log2(len(rows))),
        "complexity": P.histogram_complexity(rows, total, low, high, stats["standard_deviation"], entropy),
    }


def _four(x: float) -> float:
    return math.floor(x * 10_000 + 0.5) / 10_000


def string_model(counts: DataFrame, stats) -> dict:
    """From the values and their numbers (value, n)."""
    kept = {r["value"]: r["n"] for r in P.top(counts, KEPT_VALUES, "n", "value").collect()}
    chars = {r["ch"]: r for r in P.character_counts(counts, "value", "n").collect()}
    entropy = P.entropy(counts).first()["entropy"]
    tops = lambda rows, key: {r[key]: r["n"] for r in rows.collect()}
    samples = list(kept)[: P.TOP_SAMPLES]
    model = {
        "minLength": stats["min_length"], "maxLength": stats["max_length"], "averageLength": stats["average_length"], "totalSamples": stats["n"], "uniqueValueCount": stats["n_distinct"],
        "characterFrequency": {c: r["n"] for c, r in chars.items()}, "characterProbability": {c: r["probability"] for c, r in chars.items()}, "uniqueCharacters": sorted(chars),
        "patterns": tops(P.shapes(counts, "value", "n"), "pattern"), "nGrams": tops(P.ngrams(counts, "value", weight="n"), "gram"), "prefixes": tops(P.affixes(counts, "value", "prefix", "n"), "affix"), "suffixes": tops(P.affixes(counts, "value", "suffix", "n"), "affix"),
        "valueFrequency": kept, "sampleValues": samples, "entropyScore": entropy,
    }
    model["maxEntropy"] = _four(max([entropy, *map(_entropy_of, samples), math.log2(len(chars)) if chars else 0.0]))
    model["complexity"] = string_complexity(model)
    return model


def _entropy_of(text: str) -> float:
    return -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text)) if text else 0.0


def string_complexity(m: dict) -> float:
    """Weighted parts, 1 at most: value entropy 0.3, length spread 0.2, characters 0.2, shapes 0.15, unique values 0.15."""
    score = 0.0
    if m["uniqueValueCount"] > 1:
        score += 0.3 * min(m["entropyScore"] / math.log2(m["uniqueValueCount"]), 1.0)
    if m["averageLength"]:
        score += 0.2 * min((m["maxLength"] - m["minLength"]) / m["averageLength"], 1.0)
        score += 0.2 * min(len(m["uniqueCharacters"]) / min(m["averageLength"] * 2, 100), 1.0)
    score += 0.15 * min(len(m["patterns"]) / 10, 1.0)
    if m["totalSamples"]:
        score += 0.15 * m["uniqueValueCount"] / m["totalSamples"]
    return _four(min(score, 1.0))


# Merging


def merge(a: dict | None, b: dict | None) -> dict | None:
    """The model of both models' documents: bounds widen, counts add, fields required by both stay required, different types become an anyOf."""
    if not a or not b:
        return a or b
    kinds = {tuple(sorted(x.get("type") for x in m["anyOf"])) if "anyOf" in m else (m.get("type"),) for m in (a, b)}
    if len(kinds) > 1 or "anyOf" in a or "anyOf" in b:
        return _any_of(a, b)
    out = {**b, **a}
    for low in ("minimum", "minLength", "minItems"):
        if low in a and low in b:
            out[low] = min(a[low], b[low])
    for high in ("maximum", "maxLength", "maxItems"):
        if high in a and high in b:
            out[high] = max(a[high], b[high])
    for total in ("count", "present"):
        if total in a and total in b:
            out[total] = a[total] + b[total]
    if "multipleOf" in a or "multipleOf" in b:
        g = math.gcd(int(a.get("multipleOf", 1)), int(b.get("multipleOf", 1)))
        out.pop("multipleOf", None)
        if g > 1:
            out["multipleOf"] = g
    for same in ("format", "pattern"):
        if a.get(same) != b.get(same):
            out.pop(same, None)
    if a.get("type") == "object":
        pa, pb = a.get("properties", {}), b.get("properties", {})
        out["properties"] = {k: merge(pa.get(k), pb.get(k)) for k in [*pa, *(k for k in pb if k not in pa)]}
        out["required"] = sorted(set(a.get("required", [])) & set(b.get("required", [])))
    if "items" in a or "items" in b:
        out["items"] = merge(a.get("items"), b.get("items"))
    if "enum" in a and "enum" in b:
        out["enum"] = sorted(set(a["enum"]) | set(b["enum"]))
    else:
        out.pop("enum", None)
    if "histogram" in a and "histogram" in b:
        out["histogram"] = merge_histograms(a["histogram"], b["histogram"])
    if "stringModel" in a and "stringModel" in b:
        out["stringModel"] = merge_string_models(a["stringModel"], b["stringModel"])
    return out


def _any_of(a: dict, b: dict) -> dict:
    merged: dict = {}
    for branch in [*a.get("anyOf", [a]), *b.get("anyOf", [b])]:
        branch = {k: v for k, v in branch.items() if k not in ("count", "present")}
        merged[branch.get("type")] = merge(merged[branch.get("type")], branch) if branch.get("type") in merged else branch
    out: dict = {"anyOf": [merged[k] for k in sorted(merged, key=str)]}
    for total in ("count", "present"):
        if total in a and total in b:
            out[total] = a[total] + b[total]
    return out


def merge_histograms(a: dict, b: dict) -> dict:
    """Both histograms' counts in ten bins over their common range; a bin's count is shared out evenly over its width."""
    low, high, total = min(a["minValue"], b["minValue"]), max(a["maxValue"], b["maxValue"]), a["totalCount"] + b["totalCount"]
    n = P.BINS if high > low else 1
    width = (high - low) / n or 1.0
    counts = [0.0] * n
    for x in [*a["bins"], *b["bins"]]:
        size = x["rangeEnd"] - x["rangeStart"]
        for i in range(n):
            start, end = low + i * width, low + (i + 1) * width
            if size <= 0:
                inside = 1.0 if start <= x["rangeStart"] < end or i == n - 1 and x["rangeStart"] >= end else 0.0
            else:
                inside = max(0.0, min(end, x["rangeEnd"]) - max(start, x["rangeStart"])) / size
            counts[i] += x["count"] * inside
    mean = [(h["minValue"] + h["maxValue"]) / 2 if not h["bins"] else sum(x["count"] * (x["rangeStart"] + x["rangeEnd"]) / 2 for x in h["bins"]) / h["totalCount"] for h in (a, b)]
    both = (a["totalCount"] * mean[0] + b["totalCount"] * mean[1]) / total
    spread = sum((h["totalCount"] - 1) * h["standardDeviation"] ** 2 + h["totalCount"] * (m - both) ** 2 for h, m in zip((a, b), mean))
    deviation = math.sqrt(spread / (total - 1)) if total > 1 else 0.0
    bins, before = [], 0.0
    for i, c in enumerate(counts):
        if round(c) > 0:
            bins.append({"rangeStart": _four(low + i * width), "rangeEnd": _four(low + (i + 1) * width), "count": round(c), "freqStart": round(before * 100 / total, 2), "freqEnd": round((before + c) * 100 / total, 2)})
        before += c
    entropy = _four(-sum(x["count"] / total * math.log2(x["count"] / total) for x in bins) or 0.0)
    return {"bins": bins, "totalCount": total, "minValue": low, "maxValue": high, "standardDeviation": deviation, "entropyScore": entropy, "maxEntropy": _four(math.log2(len(bins))) if bins else 0.0, "complexity": P.histogram_complexity(bins, total, low, high, deviation, entropy)}


def merge_string_models(a: dict, b: dict) -> dict:
    add = lambda k: {x: a[k].get(x, 0) + b[k].get(x, 0) for x in [*a[k], *(y for y in b[k] if y not in a[k])]}
    first = lambda d, n: dict(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n])
    total, chars, values = a["totalSamples"] + b["totalSamples"], add("characterFrequency"), add("valueFrequency")
    out = {
        "minLength": min(a["minLength"], b["minLength"]), "maxLength": max(a["maxLength"], b["maxLength"]), "averageLength": round((a["averageLength"] * a["totalSamples"] + b["averageLength"] * b["totalSamples"]) / total, 2), "totalSamples": total,
        "characterFrequency": chars, "characterProbability": {c: _four(n / sum(chars.values())) for c, n in chars.items()}, "uniqueCharacters": sorted(chars),
        "patterns": first(add("patterns"), P.TOP_PATTERNS), "nGrams": first(add("nGrams"), P.TOP_NGRAMS), "prefixes": first(add("prefixes"), P.TOP_AFFIXES), "suffixes": first(add("suffixes"), P.TOP_AFFIXES), "valueFrequency": first(values, KEPT_VALUES),
    }
    if tables := [*a.get("valueTables", []), *b.get("valueTables", [])]:
        out["valueTables"] = tables
    out["uniqueValueCount"] = max(len(values), a["uniqueValueCount"], b["uniqueValueCount"])
    out["sampleValues"] = list(out["valueFrequency"])[: P.TOP_SAMPLES]
    out["entropyScore"] = _four(-sum(n / total * math.log2(n / total) for n in values.values()) or 0.0)
    out["maxEntropy"] = _four(max([out["entropyScore"], *map(_entropy_of, out["sampleValues"]), math.log2(len(chars)) if chars else 0.0]))
    out["complexity"] = string_complexity(out)
    return out


def train(df: DataFrame, existing: dict | None = None, options: Options | None = None) -> dict:
    """A model of df, merged into an existing one."""
    return merge(existing, infer(df, options))


def infer_folders(frames: list[DataFrame], options: Options | None = None) -> dict:
    """Models of several sources, merged; without sources an empty object."""
    return reduce(merge, [infer(f, options) for f in frames], None) or {"type": "object"}


# Quality


def split(df: DataFrame, validation: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    a, b = df.randomSplit([1 - validation, validation], seed)
    return a, b


def coverage(df: DataFrame, model: dict) -> DataFrame:
    """path, coverage (share of rows with the field) and per_document, the mean number of the model's fields that a row has."""
    names = [n for n in model.get("properties", {}) if n in df.columns]
    row = df.agg(*[F.avg(F.col(f"`{n}`").isNotNull().cast("double")).alias(f"c{i}") for i, n in enumerate(names)], *([] if names else [F.count("*").alias("n")]))
    each = F.array(*[F.struct(F.lit(n).alias("path"), F.col(f"c{i}").alias("coverage")) for i, n in enumerate(names)]) if names else F.array().cast("array<struct<path:string,coverage:double>>")
    total = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(len(names))], F.lit(0.0))
    return row.select(F.explode(each).alias("f"), total.alias("per_document")).select("f.*", "per_document")


def quality(model: dict) -> dict:
    """complexity, coverage, specificity, completeness and their mean, each from 0 to 1."""
    fields = list(model.get("properties", {}).values())
    if not fields:
        return dict.fromkeys(("complexity", "coverage", "specificity", "completeness", "overall"), 0.0)
    n = len(fields)
    out = {
        "complexity": min(n / 20, 1.0),
        "coverage": len(model.get("required", [])) / n,
        "specificity": sum(any(k in f for k in ("minimum", "minLength", "enum", "format", "pattern", "anyOf", "minItems")) for f in fields) / n,
        "completeness": sum(any(k in f for k in ("histogram", "stringModel", "items", "properties", "anyOf")) or f.get("type") == "boolean" for f in fields) / n,
    }
    return out | {"overall": sum(out.values()) / 4}


def recommendations(model: dict, n_samples: int = 0) -> list[str]:
    """What would make the model better."""
    q, out = quality(model), []
    if n_samples and n_samples < 10:
        out.append("Add samples: fewer than 10 give no histograms.")
    if q["specificity"] < 0.5:
        out.append("Most fields have no constraints: add more varied samples.")
    if q["completeness"] < 0.5:
        out.append("Most fields have no distribution: train with more samples.")
    if q["coverage"] < 0.3:
        out.append("Few fields are always there: check that samples are of one kind.")
    return out
