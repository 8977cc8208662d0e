"""Filters: dictionaries in MongoDB's query language become one boolean Column.

Logic is two-valued: a comparison with a missing value is false, `$ne`, `$nin`, `$not` and `$nor` of it are true. Below a negation every leaf is made so;
elsewhere in a filter of rows leaves stay plain comparisons, which sources can evaluate.
Unknown operators raise ValueError.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of a filter that steer generation and select nothing.
GENERATION_KEYS = ("$seed", "$entropy", "_seed", "_entropy")

_TYPE_NAMES = {  # names of $type and the Spark types they stand for
    "double": (T.DoubleType, T.FloatType, T.DecimalType), "int": (T.IntegerType, T.ShortType, T.ByteType), "long": (T.LongType,), "string": (T.StringType,), "bool": (T.BooleanType,), "boolean": (T.BooleanType,),
    "date": (T.TimestampType, T.TimestampNTZType, T.DateType), "array": (T.ArrayType,), "object": (T.StructType, T.MapType), "number": (T.NumericType,), "binData": (T.BinaryType,),
}


def field(path: str, schema: T.StructType | None = None) -> Column:
    """The column of a dotted path; a numeric step is an index into an array."""
    steps = path.split(".")
    column = F.col(f"`{steps[0]}`")
    kind = schema[steps[0]].dataType if schema is not None and steps[0] in schema.names else None
    for step in steps[1:]:
        if step.isdigit() and (kind is None or isinstance(kind, T.ArrayType)):
            column = F.get(column, int(step))
            kind = kind.elementType if kind is not None else None
        else:
            column = column.getField(step)
            kind = kind[step].dataType if isinstance(kind, T.StructType) and step in kind.names else None
    return column


def field_type(path: str, schema: T.StructType) -> T.DataType | None:
    """The type of a dotted path, or None where the schema has no such field."""
    kind: T.DataType | None = schema
    for step in path.split("."):
        if isinstance(kind, T.StructType):
            kind = kind[step].dataType if step in kind.names else None
        elif isinstance(kind, T.ArrayType) and step.isdigit():
            kind = kind.elementType
        else:
            return None
    return kind


def generation_params(query: dict) -> tuple[dict, dict]:
    """(parameters, the rest of the filter); of two spellings the one with the underscore wins."""
    params = {}
    for key in GENERATION_KEYS:
        if key in query:
            params[key.lstrip("$_")] = query[key]
    return params, {k: v for k, v in query.items() if k not in GENERATION_KEYS}


def compile_filter(query: dict | None, schema: T.StructType, total: bool = True) -> Column:
    """The filter as a Column that is never null (without total, null may stand for false). An empty filter is true."""
    terms = [_term(key, value, schema, total) for key, value in generation_params(query or {})[1].items()]
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def _sure(test: Column, total: bool) -> Column:
    return F.coalesce(test, F.lit(False)) if total else test


def _all(queries: list[dict], schema: T.StructType, total: bool) -> list[Column]:
    if not isinstance(queries, (list, tuple)) or not queries:
        raise ValueError("$and, $or and $nor take a list of filters")
    return [compile_filter(q, schema, total) for q in queries]


def _term(key: str, value, schema: T.StructType, total: bool) -> Column:
    if key == "$and":
        return reduce(lambda a, b: a & b, _all(value, schema, total))
    if key == "$or":
        return reduce(lambda a, b: a | b, _all(value, schema, total))
    if key == "$nor":
        return ~reduce(lambda a, b: a | b, _all(value, schema, True))
    if key == "$not":
        return ~compile_filter(value, schema)
    if key.startswith("$"):
        raise ValueError(f"unknown operator in a filter: {key}")
    top = key.partition(".")[0]
    if isinstance(field_type(top, schema), T.VariantType):
        return _variant_condition(top, key[len(top) + 1 :], value, total)
    kind = field_type(key, schema)
    if kind is None:  # no document has it
        return _condition(F.lit(None), value, None, total)
    return _condition(field(key, schema), value, kind, total)


_VARIANT_TYPES = {"int": ["BIGINT"], "long": ["BIGINT"], "double": ["DOUBLE", "DECIMAL"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "string": ["STRING"], "bool": ["BOOLEAN"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"]}


def _variant_condition(top: str, path: str, value, total: bool) -> Column:
    """A condition on a place in a VARIANT column, where null and missing differ: `$exists` holds for null, equality with null for both."""
    place = "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in path.split(".") if s)
    raw = F.try_variant_get(F.col(f"`{top}`"), place, "variant")
    terms = []
    for op, arg in (value if is_operators(value) else {"$eq": value}).items():
        if op == "$options":
            continue
        if op == "$exists":
            terms.append(raw.isNotNull() if arg else raw.isNull())
        elif op == "$type":
            names = [n for name in (arg if isinstance(arg, (list, tuple)) else [arg]) for n in _VARIANT_TYPES[name]]
            terms.append(F.coalesce(F.schema_of_variant(raw).rlike(f"^(?:{'|'.join(names)})"), F.lit(False)))
        elif op == "$not":
            terms.append(~_variant_condition(top, path, arg, True))
        elif arg is None and op in ("$eq", "$ne"):
            null = raw.isNull() | F.coalesce(F.is_variant_null(raw), F.lit(False))
            terms.append(null if op == "$eq" else ~null)
        else:
            first = next((x for x in (arg if isinstance(arg, (list, tuple)) else [arg]) if x is not None), None)
            kind = T.BooleanType() if isinstance(first, bool) else T.DoubleType() if isinstance(first, (int, float)) else T.StringType()
            typed = F.try_variant_get(F.col(f"`{top}`"), place, kind.simpleString())
            same = F.schema_of_variant(raw).rlike({"boolean": "^BOOLEAN", "double": "^(?:BIGINT|DOUBLE|DECIMAL)", "string": "^STRING"}[kind.simpleString()])
            terms.append(_operator(F.when(same, typed), op, arg, kind, value, total))
    return reduce(lambda a, b: a & b, terms)


def is_operators(value) -> bool:
    return isinstance(value, dict) and bool(value) and all(k.startswith("$") for k in value)


def _condition(c: Column, value, kind: T.DataType | None, total: bool) -> Column:
    if not is_operators(value):
        return _equals(c, value, kind, total)
    terms = [_operator(c, op, arg, kind, value, total) for op, arg in value.items() if op != "$options"]
    return reduce(lambda a, b: a & b, terms)


def literal(value) -> Column:
    """A Python value as a Column: dictionaries become structs, lists arrays."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)


def _comparable(kind: T.DataType | None, value) -> bool:
    """Whether values of the type and the operand can be compared; if not, they are never equal or ordered."""
    if kind is None or isinstance(kind, (T.NullType, T.VariantType)):
        return True
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType))
    if isinstance(value, (list, tuple)):
        return isinstance(kind, T.ArrayType)
    if isinstance(value, dict):
        return isinstance(kind, T.StructType) and list(value) == kind.names
    return True


def _equals(c: Column, value, kind: T.DataType | None, total: bool = True) -> Column:
    if value is None:
        return c.isNull()
    if not _comparable(kind, value):
        return F.lit(False)
    if isinstance(value, (list, tuple)) and not value:
        return _sure(F.size(c) == 0, total)
    return _sure(c == literal(value), total)


def _order(c: Column, value, kind, test, total: bool) -> Column:
    if value is None or not _comparable(kind, value):
        return F.lit(False)
    return _sure(test(c, literal(value)), total)


def _in(c: Column, values, kind, total: bool = True) -> Column:
    if not isinstance(values, (list, tuple)):
        raise ValueError("$in and $nin take a list")
    plain = [v for v in values if v is not None and _comparable(kind, v)]
    found = F.lit(False)
    if plain:
        found = _sure(c.isin(plain), total) if not any(isinstance(v, (dict, list, tuple)) for v in plain) else reduce(lambda a, b: a | b, [_equals(c, v, kind, total) for v in plain])
    return found | c.isNull() if any(v is None for v in values) else found


def _pattern(pattern: str, options: str) -> str:
    flags = "".join(f for f in "imsx" if f in (options or ""))
    return f"(?{flags})" + pattern if flags else pattern


def _has_type(c: Column, names, kind: T.DataType | None) -> Column:
    names = names if isinstance(names, (list, tuple)) else [names]
    terms = []
    for name in names:
        if name == "null":
            terms.append(c.isNull())
            continue
        if name not in _TYPE_NAMES:
            raise ValueError(f"unknown $type: {name}")
        whole = isinstance(kind, (T.DoubleType, T.FloatType)) and name == "int"  # decided by the value, as 23.0 is an integer
        terms.append(F.coalesce(c == F.floor(c), F.lit(False)) if whole else c.isNotNull() & F.lit(isinstance(kind, _TYPE_NAMES[name])))
    return reduce(lambda a, b: a | b, terms)


def _operator(c: Column, op: str, arg, kind: T.DataType | None, whole: dict, total: bool) -> Column:
    array = isinstance(kind, T.ArrayType)
    if op == "$eq":
        return _equals(c, arg, kind, total)
    if op == "$ne":
        return ~_equals(c, arg, kind)
    if op == "$gt":
        return _order(c, arg, kind, lambda a, b: a > b, total)
    if op == "$gte":
        return _order(c, arg, kind, lambda a, b: a >= b, total)
    if op == "$lt":
        return _order(c, arg, kind, lambda a, b: a < b, total)
    if op == "$lte":
        return _order(c, arg, kind, lambda a, b: a <= b, total)
    if op == "$between":
        return _order(c, arg[0], kind, lambda a, b: a >= b, total) & _order(c, arg[1], kind, lambda a, b: a <= b, total)
    if op == "$in":
        return _in(c, arg, kind, total)
    if op == "$nin":
        return ~_in(c, arg, kind)
    if op == "$exists":
        return c.isNotNull() if arg else c.isNull()
    if op == "$type":
        return _has_type(c, arg, kind)
    if op == "$regex":
        return F.coalesce(c.rlike(_pattern(arg, whole.get("$options", ""))), F.lit(False)) if isinstance(kind, T.StringType) else F.lit(False)
    if op == "$text":
        return F.coalesce(F.contains(F.lower(c), F.lower(F.lit(arg if isinstance(arg, str) else arg["$search"]))), F.lit(False)) if isinstance(kind, T.StringType) else F.lit(False)
    if op == "$size":
        return F.coalesce(F.size(c) == arg, F.lit(False)) if array else F.lit(False)
    if op == "$all":
        return F.coalesce(reduce(lambda a, b: a & b, [F.array_contains(c, literal(v)) for v in arg], F.lit(True)), F.lit(False)) if array else F.lit(False)
    if op == "$elemMatch":
        if not array:
            return F.lit(False)
        return _sure(F.exists(c, lambda x: _element(x, arg, kind.elementType)), total)
    if op == "$not":
        return ~_condition(c, arg, kind, True)
    raise ValueError(f"unknown operator in a filter: {op}")


def _element(x: Column, query, kind: T.DataType) -> Column:
    if is_operators(query) or not isinstance(query, dict):
        return _condition(x, query, kind, True)
    terms = []
    for path, value in query.items():
        inner = field_type(path, kind) if isinstance(kind, T.StructType) else None
        if inner is None:
            terms.append(_condition(F.lit(None), value, None, True))
            continue
        at = x
        for step in path.split("."):
            at = at.getField(step)
        terms.append(_condition(at, value, inner, True))
    return reduce(lambda a, b: a & b, terms, F.lit(True))
