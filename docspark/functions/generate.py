"""Documents from a model: every value is a Column of the row number and the seed, so a document doesn't depend on partitions or order.

The random numbers are hashes of (seed, row number, path), not a sequence.
"""

from __future__ import annotations

import json
import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import generation_params, is_operators

#: A field that isn't required is there with this probability.
OPTIONAL = 0.8
LETTERS, DIGITS, SPACES, OTHERS = string.ascii_letters, string.digits, " ", "-_.,:/"
DAY = 86_400
EPOCH = 1_704_067_200  # 2024-01-01


def uniform(seed: int, row: Column, *path) -> Column:
    """A number from 0 to below 1 that depends on its arguments only."""
    keys = [p if isinstance(p, Column) else F.lit(p) for p in path]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), row, *keys), 11) / float(1 << 53)


def object_id(seed: Column, row: Column) -> Column:
    """24 hexadecimal digits."""
    return F.lower(F.substring(F.concat(F.lpad(F.hex(F.xxhash64(seed, row)), 16, "0"), F.lpad(F.hex(F.xxhash64(row, seed)), 16, "0")), 1, 24))


def validate_model(model: dict, path: str = "$") -> list[str]:
    """What makes a model impossible to generate from."""
    errors = []
    for low, high in (("minimum", "maximum"), ("minLength", "maxLength"), ("minItems", "maxItems")):
        if low in model and high in model and model[low] > model[high]:
            errors.append(f"{path}: {low} is above {high}")
    if model.get("multipleOf") is not None and model["multipleOf"] <= 0:
        errors.append(f"{path}: multipleOf must be positive")
    if any(model.get(k, 0) < 0 for k in ("minLength", "minItems")):
        errors.append(f"{path}: a length is negative")
    if "histogram" in model and not model["histogram"].get("bins"):
        errors.append(f"{path}: the histogram has no bins")
    if "enum" in model and not model["enum"]:
        errors.append(f"{path}: the enum is empty")
    for name, sub in (model.get("properties") or {}).items():
        errors += validate_model(sub, f"{path}.{name}")
    for i, sub in enumerate(model.get("anyOf") or []):
        errors += validate_model(sub, f"{path}.anyOf[{i}]")
    return errors + (validate_model(model["items"], f"{path}[]") if isinstance(model.get("items"), dict) else [])


class Generator:
    def __init__(self, seed: int = 0, entropy: float | None = None):
        self.seed, self.entropy = seed, entropy

    def u(self, row: Column, *path) -> Column:
        return uniform(self.seed, row, *path)

    def pick(self, items: list, row: Column, *path) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in items]), (F.floor(self.u(row, *path) * len(items)) + 1).cast("int"))

    def weighted(self, weights: dict, row: Column, *path) -> Column:
        """A key with a probability by its weight."""
        total, at, items = sum(weights.values()), 0.0, []
        for k, w in weights.items():
            at += w / total
            items.append({"upto": at, "key": k})
        # Two levels of about the same size, as one literal each: a draw looks at two short lists.
        size = max(1, math.isqrt(len(items)))
        parts = [{"upto": items[i : i + size][-1]["upto"], "items": items[i : i + size]} for i in range(0, len(items), size)]
        table, x = F.from_json(F.lit(json.dumps(parts)), "array<struct<upto:double,items:array<struct<upto:double,key:string>>>>"), self.u(row, *path)
        inner = F.get(F.filter(table, lambda t: t["upto"] > x), F.lit(0))["items"]
        return F.coalesce(F.get(F.filter(inner, lambda t: t["upto"] > x), F.lit(0))["key"], F.lit(list(weights)[-1]))

    # Values

    def value(self, m: dict, row: Column, path: str) -> Column:
        if m.get("enum"):
            return self.pick(m["enum"], row, path)
        if m.get("anyOf"):
            return self.any_of(m["anyOf"], row, path)
        kind = m.get("type")
        if kind == "integer":
            return self.integer(m, row, path)
        if kind == "number":
            return self.number(m, row, path)
        if kind == "boolean":
            return self.u(row, path) > 0.5
        if kind == "string":
            return self.text(m, row, path)
        if kind == "array":
            return self.array(m, row, path)
        if m.get("temporal"):
            return F.timestamp_seconds(F.lit(m["minimum"]) + F.floor(self.u(row, path) * (m["maximum"] - m["minimum"] + 1)))
        if kind == "object":
            return F.struct(*[c.alias(k) for k, c in self.properties(m, row, path).items()]) if m.get("properties") else F.lit(None).cast("string")
        return F.lit(None).cast("string")

    def properties(self, m: dict, row: Column, path: str) -> dict[str, Column]:
        required = set(m.get("required", []))
        out = {}
        for name, sub in m.get("properties", {}).items():
            at = f"{path}.{name}"
            c = self.value(sub, row, at)
            out[name] = c if name in required else F.when(self.u(row, at, "there") < OPTIONAL, c)
        return out

    def any_of(self, branches: list[dict], row: Column, path: str) -> Column:
        numeric = all(b.get("type") in ("integer", "number") for b in branches)
        values = [self.value(b, row, f"{path}|{i}").cast("double" if numeric else "string") for i, b in enumerate(branches)]
        which = F.floor(self.u(row, path, "branch") * len(values))
        return reduce(lambda other, item: F.when(which == item[0], item[1]).otherwise(other), list(enumerate(values))[1:], values[0])

    def in_histogram(self, h: dict, row: Column, path: str) -> Column:
        bins = F.array(*[F.struct(*[F.lit(float(b[k])).alias(k) for k in ("rangeStart", "rangeEnd", "freqStart", "freqEnd")]) for b in h["bins"]])
        x = self.u(row, path, "bin") * 100
        chosen = F.coalesce(F.get(F.filter(bins, lambda b: (b["freqStart"] <= x) & (x < b["freqEnd"])), F.lit(0)), F.element_at(bins, -1))
        return chosen["rangeStart"] + self.u(row, path) * (chosen["rangeEnd"] - chosen["rangeStart"])

    def integer(self, m: dict, row: Column, path: str) -> Column:
        low, high = m.get("minimum", 0), m.get("maximum", max(100, m.get("minimum", 0)))
        step = m.get("multipleOf")
        if m.get("histogram", {}).get("bins"):
            x = F.floor(self.in_histogram(m["histogram"], row, path) + 0.5)
            if step:
                x = F.floor(x / step + 0.5) * step
            return F.least(F.greatest(x, F.lit(int(low))), F.lit(int(high))).cast("long")
        if step:
            first, last = -(-low // step), high // step
            return ((F.floor(self.u(row, path) * (last - first + 1)) + first) * step).cast("long")
        return (F.floor(self.u(row, path) * (int(high) - int(low) + 1)) + int(low)).cast("long")

    def number(self, m: dict, row: Column, path: str) -> Column:
        low, high = m.get("minimum", 0.0), m.get("maximum", max(100.0, m.get("minimum", 0.0)))
        if m.get("histogram", {}).get("bins"):
            x = self.in_histogram(m["histogram"], row, path)
        else:
            x = F.lit(float(low)) + self.u(row, path) * (high - low)
        if m.get("multipleOf"):
            x = F.floor(x / m["multipleOf"] + 0.5) * m["multipleOf"]
        return F.least(F.greatest(F.floor(x * 100 + 0.5) / 100, F.lit(float(low))), F.lit(float(high)))

    def array(self, m: dict, row: Column, path: str) -> Column:
        low, high = m.get("minItems", 1), m.get("maxItems", max(5, m.get("minItems", 1)))
        n = (F.floor(self.u(row, path, "size") * (high - low + 1)) + low).cast("int")
        items = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: self.value(m.get("items") or {"type": "string"}, F.xxhash64(row, i), f"{path}[]"))
        return F.when(n > 0, items).otherwise(F.slice(items, 1, 0))

    # Texts

    def text(self, m: dict, row: Column, path: str) -> Column:
        if m.get("format"):
            return self.formatted(m["format"], row, path)
        if m.get("pattern"):
            return self.from_regex(m["pattern"], row, path)
        if m.get("stringModel"):
            return self.from_string_model(m["stringModel"], row, path)
        low, high = m.get("minLength", 5), m.get("maxLength", max(20, m.get("minLength", 5)))
        n = F.floor(self.u(row, path, "length") * (high - low + 1)) + low
        return self.characters(LETTERS + DIGITS, n, row, path)

    def characters(self, alphabet: str, n, row: Column, path: str) -> Column:
        n = n.cast("int") if isinstance(n, Column) else F.lit(n)
        table = F.array(*[F.lit(c) for c in alphabet])
        made = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(table, (F.floor(self.u(row, path, "char", i) * len(alphabet)) + 1).cast("int"))), "")
        return F.when(n > 0, made).otherwise("")

    def from_string_model(self, m: dict, row: Column, path: str) -> Column:
        """Low entropy repeats known values, medium entropy follows shapes, high entropy makes new text."""
        entropy = m.get("entropyScore", 0.0)
        if self.entropy is not None:  # 0 to 1 of what the model can reach
            entropy = self.entropy * max(m.get("maxEntropy", 0.0), 4.0)
        values = m.get("valueFrequency") or {}
        if (entropy < 2 or not m.get("characterProbability")) and values:
            return self.weighted(values, row, path)
        if entropy < 4 and m.get("patterns"):
            return self.from_shapes(m, row, path)
        return self.from_characters(m, row, path)

    def from_shapes(self, m: dict, row: Column, path: str) -> Column:
        chars = "".join(m.get("uniqueCharacters", []))
        alphabets = {"U": [c for c in chars if c in string.ascii_uppercase] or string.ascii_uppercase, "L": [c for c in chars if c in string.ascii_lowercase] or string.ascii_lowercase, "d": [c for c in chars if c in DIGITS] or DIGITS, "s": SPACES, "p": [c for c in chars if not c.isspace() and c not in LETTERS + DIGITS] or OTHERS}
        shape = self.weighted(m["patterns"], row, path, "shape")
        expanded = [(p, self._runs([("".join(alphabets[k]), n, n) for k, n in _shape_runs(p)], row, f"{path}/{j}")) for j, p in enumerate(m["patterns"])]
        return reduce(lambda other, item: F.when(shape == item[0], item[1]).otherwise(other), expanded[1:], expanded[0][1])

    def from_characters(self, m: dict, row: Column, path: str) -> Column:
        """Character by character: after a character follows what followed it in the model's n-grams, else any character by its probability."""
        low, high = m["minLength"], m["maxLength"]
        n = (F.floor(self.u(row, path, "length") * (high - low + 1)) + low).cast("int")
        follow: dict[str, str] = {}
        for gram, k in (m.get("nGrams") or {}).items():
            for a, b in zip(gram, gram[1:]):
                follow[a] = follow.get(a, "") + b * min(k, 8)
        probable = "".join(c * max(1, round(p * 200)) for c, p in m["characterProbability"].items())
        after = F.create_map(*[F.lit(x) for pair in (follow or {"": " "}).items() for x in pair])
        draw = lambda table, i: F.substring(table, (F.floor(self.u(row, path, "char", i) * F.length(table)) + 1).cast("int"), F.lit(1))
        step = lambda acc, i: F.concat(acc, draw(F.coalesce(F.try_element_at(after, F.right(acc, F.lit(1))), F.lit(probable)), i))
        start = self.weighted(m["prefixes"], row, path, "prefix") if m.get("prefixes") else F.lit("")
        body = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step)
        text = F.substring(body, F.lit(1), n)
        if m.get("suffixes"):
            suffix = self.weighted(m["suffixes"], row, path, "suffix")
            text = F.when((self.u(row, path, "ending") < 0.3) & (F.length(suffix) <= n), F.concat(F.substring(text, F.lit(1), n - F.length(suffix)), suffix)).otherwise(text)
        return text

    def from_regex(self, pattern: str, row: Column, path: str) -> Column:
        """A text for a simple pattern: literals, classes, \\d \\w \\s, {n}, {m,n}, ?, * and +. Anchors make no characters."""
        return self._runs(_regex_runs(pattern), row, path)

    def _runs(self, runs: list[tuple[str, int, int]], row: Column, path: str) -> Column:
        parts = []
        for i, (alphabet, low, high) in enumerate(runs):
            at = f"{path}#{i}"
            n = low if low == high else F.floor(self.u(row, at, "length") * (high - low + 1)) + low
            parts.append(F.lit(alphabet * low) if len(alphabet) == 1 and low == high else self.characters(alphabet, n, row, at))
        return F.concat(*parts) if parts else F.lit("")

    def formatted(self, kind: str, row: Column, path: str) -> Column:
        u = lambda k: self.u(row, path, k)
        below = lambda k, n: F.floor(u(k) * n).cast("int")
        word = lambda k, low=4, high=9: self.characters(string.ascii_lowercase, F.floor(u(k + "n") * (high - low + 1)) + low, row, f"{path}/{k}")
        moment = F.timestamp_seconds(F.lit(EPOCH) + F.floor(u("time") * 365 * DAY))
        hexes = F.lower(F.concat(F.lpad(F.hex(F.xxhash64(F.lit(self.seed), row, F.lit(path), F.lit("a"))), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(self.seed), row, F.lit(path), F.lit("b"))), 16, "0")))
        if kind == "email":
            return F.concat(word("name"), F.lit("."), below("n", 1000).cast("string"), F.lit("@"), word("host"), F.lit(".com"))
        if kind in ("uri", "url"):
            return F.concat(F.lit("https://www."), word("host"), F.lit(".com/"), word("page"))
        if kind == "hostname":
            return F.concat(word("host"), F.lit("."), word("zone"), F.lit(".com"))
        if kind == "uuid":
            return F.regexp_replace(hexes, r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-a$4-$5")
        if kind == "date-time":
            return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        if kind == "date":
            return F.date_format(moment, "yyyy-MM-dd")
        if kind == "time":
            return F.date_format(moment, "HH:mm:ss")
        if kind == "ipv4":
            return F.concat_ws(".", *[(below(f"o{i}", 254) + 1).cast("string") for i in range(4)])
        if kind == "ipv6":
            return F.array_join(F.regexp_extract_all(hexes, F.lit(r".{4}"), F.lit(0)), ":")
        raise ValueError(f"unknown format: {kind}")


def _shape_runs(pattern: str) -> list[tuple[str, int]]:
    out, i = [], 0
    while i < len(pattern):
        kind, i = pattern[i], i + 1
        n = 1
        if i < len(pattern) and pattern[i] == "{":
            close = pattern.index("}", i)
            n, i = int(pattern[i + 1 : close]), close + 1
        out.append((kind, n))
    return out


def _regex_runs(pattern: str) -> list[tuple[str, int, int]]:
    classes = {"d": DIGITS, "w": LETTERS + DIGITS + "_", "s": " "}
    out, i = [], 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c in "^$":
            continue
        if c == "\\":
            alphabet, i = classes.get(pattern[i], pattern[i]), i + 1
        elif c == "[":
            close = pattern.index("]", i)
            body, i, alphabet, k = pattern[i:close], close + 1, "", 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    alphabet, k = alphabet + "".join(map(chr, range(ord(body[k]), ord(body[k + 2]) + 1))), k + 3
                elif body[k] == "\\":
                    alphabet, k = alphabet + classes.get(body[k + 1], body[k + 1]), k + 2
                else:
                    alphabet, k = alphabet + body[k], k + 1
        else:
            alphabet = LETTERS + DIGITS if c == "." else c
        low = high = 1
        if i < len(pattern) and pattern[i] in "{?*+":
            if pattern[i] == "{":
                close = pattern.index("}", i)
                bounds, i = pattern[i + 1 : close].split(","), close + 1
                low, high = int(bounds[0]), int(bounds[-1] or int(bounds[0]) + 5)
            else:
                low, high, i = *{"?": (0, 1), "*": (0, 5), "+": (1, 5)}[pattern[i]], i + 1
        out.append((alphabet, low, high))
    return out


# Constraints of a filter


def constraints(query: dict) -> dict[str, dict]:
    """What a filter's top-level comparisons demand of fields: {path: {equals | in | minimum, maximum, above, below}}. $ne, $nin, $regex, $exists and logic only filter afterwards."""
    out: dict[str, dict] = {}
    for key, value in generation_params(query)[1].items():
        if key.startswith("$"):
            continue
        if not is_operators(value):
            out[key] = {"equals": value}
            continue
        names = {"$eq": "equals", "$in": "in", "$gte": "minimum", "$lte": "maximum", "$gt": "above", "$lt": "below"}
        found = {names[op]: arg for op, arg in value.items() if op in names}
        if "$between" in value:
            found |= {"minimum": value["$between"][0], "maximum": value["$between"][1]}
        if found:
            out[key] = found
    return out


def constrained(model: dict, demands: dict[str, dict]) -> dict:
    """The model narrowed to the demands, so that what is generated meets them."""
    properties, required = dict(model.get("properties", {})), set(model.get("required", []))
    for name, d in demands.items():
        sub = dict(properties.get(name, {}))
        if sub.get("anyOf") and all(b.get("type") in ("integer", "number") for b in sub["anyOf"]):
            sub = {"type": "number", "minimum": min(b["minimum"] for b in sub["anyOf"]), "maximum": max(b["maximum"] for b in sub["anyOf"])}
        if "equals" in d:
            if d["equals"] is None:
                properties.pop(name, None)
                continue
            sub = {"type": _type_of(d["equals"]), "enum": [d["equals"]]}
        elif "in" in d:
            sub = {"type": _type_of(d["in"][0]), "enum": [x for x in d["in"] if x is not None]}
        elif sub.get("type") in ("integer", "number") or sub.get("anyOf") or not sub:
            whole = sub.get("type") == "integer"
            gap = 1 if whole else 0.01
            low = max([x for x in (d.get("minimum"), d["above"] + gap if "above" in d else None) if x is not None], default=None)
            high = min([x for x in (d.get("maximum"), d["below"] - gap if "below" in d else None) if x is not None], default=None)
            old_low, old_high = sub.get("minimum", 0), sub.get("maximum", 100)
            low = (min(old_low, high) if low is None else max(low, old_low) if low <= old_high else low) if low is not None or high is not None else old_low
            high = max(old_high, low) if high is None else min(high, old_high) if high >= old_low else high
            step = sub.get("multipleOf")
            inside = low <= old_low and high >= old_high
            sub = {"type": sub.get("type", "number"), "minimum": low, "maximum": max(low, high), **({"histogram": sub["histogram"]} if inside and "histogram" in sub else {}), **({"multipleOf": step} if step and high - low >= step else {})}
        properties[name] = sub
        required.add(name)
    return {**model, "properties": properties, "required": sorted(required)}


def _type_of(value) -> str:
    return "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "string"


def generate(spark: SparkSession, model: dict, count: int, seed: int = 0, entropy: float | None = None, query: dict | None = None, with_id: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """count documents of the model (or one for each id of rows). seed and entropy in the query win over the arguments; its comparisons narrow the model."""
    errors = validate_model(model)
    if errors:
        raise ValueError("; ".join(errors))
    params, _ = generation_params(query or {})
    seed, entropy = int(params.get("seed", seed)), params.get("entropy", entropy)
    if query:
        model = constrained(model, constraints(query))
    row = F.col("id")
    made = Generator(seed, entropy).properties(model, row, "$")
    base = spark.range(count) if rows is None else rows
    ids = [object_id(F.lit(seed), row).alias("_id")] if with_id and "_id" not in made else []
    return base.select(*ids, *[c.alias(k) for k, c in made.items()])
