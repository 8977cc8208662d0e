"""Expressions of pipeline stages as Columns: field paths, documents, lists and the `$` operators. Unknown operators raise ValueError."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import field, field_type, literal


class Expressions:
    """Compiles expressions over the documents of one schema."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def __call__(self, expr) -> Column:
        if isinstance(expr, str) and expr.startswith("$$"):
            name, _, path = expr[2:].partition(".")
            if name not in ("ROOT", "CURRENT"):
                raise ValueError(f"unknown variable: {expr}")
            return self.path(path) if path else F.struct(*[F.col(f"`{c}`") for c in self.schema.names])
        if isinstance(expr, str) and expr.startswith("$"):
            return self.path(expr[1:])
        if isinstance(expr, dict):
            if len(expr) == 1 and next(iter(expr)).startswith("$"):
                return self.operator(*next(iter(expr.items())))
            return F.struct(*[self(v).alias(k) for k, v in expr.items()])
        if isinstance(expr, (list, tuple)):
            return F.array(*[self(x) for x in expr])
        return literal(expr)

    def path(self, path: str) -> Column:
        return field(path, self.schema) if field_type(path, self.schema) is not None else F.lit(None)

    def type_of(self, expr) -> T.DataType | None:
        """The type of a field path; None for anything else."""
        return field_type(expr[1:], self.schema) if isinstance(expr, str) and expr.startswith("$") and not expr.startswith("$$") else None

    def truthy(self, expr) -> Column:
        """null, false, 0, NaN and the empty string are false; documents and lists are true."""
        c, kind = self(expr), self.type_of(expr)
        if isinstance(expr, bool) or isinstance(kind, T.BooleanType) or (isinstance(expr, dict) and next(iter(expr), "") in _BOOLEAN):
            return F.coalesce(c, F.lit(False))
        if isinstance(kind, T.NumericType) or (isinstance(expr, (int, float)) or isinstance(expr, dict) and next(iter(expr), "") in _NUMERIC):
            return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))
        if isinstance(kind, T.StringType) or isinstance(expr, str) and not expr.startswith("$"):
            return F.coalesce(c != "", F.lit(False))
        return c.isNotNull()

    def operator(self, op: str, arg) -> Column:
        args = list(arg) if isinstance(arg, (list, tuple)) else [arg]
        one = args[0] if len(args) == 1 else None
        if op in _COMPARE:
            a, b = (self(x) for x in args)
            return _COMPARE[op](a, b)
        if op == "$add":
            return reduce(lambda a, b: a + b, [self(x) for x in args])
        if op == "$subtract":
            return self(args[0]) - self(args[1])
        if op == "$multiply":
            return reduce(lambda a, b: a * b, [self(x) for x in args])
        if op == "$divide":
            return F.try_divide(self(args[0]).cast("double"), self(args[1]).cast("double"))
        if op == "$mod":
            return F.try_mod(self(args[0]), self(args[1]))
        if op == "$concat":
            return F.concat(*[self(x).cast("string") for x in args])
        if op == "$substr":
            s, start, n = self(args[0]).cast("string"), self(args[1]), self(args[2])
            return F.substring(s, F.when(start < 0, start).otherwise(start + 1), n)
        if op == "$toLower":
            return F.lower(self(one).cast("string"))
        if op == "$toUpper":
            return F.upper(self(one).cast("string"))
        if op == "$and":
            return reduce(lambda a, b: a & b, [self.truthy(x) for x in args], F.lit(True))
        if op == "$or":
            return reduce(lambda a, b: a | b, [self.truthy(x) for x in args], F.lit(False))
        if op == "$not":
            return ~self.truthy(one)
        if op == "$cond":
            test, yes, no = (arg["if"], arg["then"], arg["else"]) if isinstance(arg, dict) else args
            return F.when(self.truthy(test), self(yes)).otherwise(self(no))
        if op == "$ifNull":
            return F.coalesce(*[self(x) for x in args])
        if op == "$size":
            kind = self.type_of(one)
            return F.coalesce(F.size(self(one)), F.lit(0)) if kind is None or isinstance(kind, T.ArrayType) else F.lit(0)
        if op == "$arrayElemAt":
            return F.get(self(args[0]), self(args[1]))
        if op in _DATE:
            return _DATE[op](self(one))
        if op == "$literal":
            return literal(arg)
        raise ValueError(f"unknown expression operator: {op}")


_COMPARE = {
    "$eq": lambda a, b: a.eqNullSafe(b), "$ne": lambda a, b: ~a.eqNullSafe(b),
    "$gt": lambda a, b: F.coalesce(a > b, F.lit(False)), "$gte": lambda a, b: F.coalesce(a >= b, F.lit(False)), "$lt": lambda a, b: F.coalesce(a < b, F.lit(False)), "$lte": lambda a, b: F.coalesce(a <= b, F.lit(False)),
}
_DATE = {"$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$minute": F.minute, "$second": F.second}
_BOOLEAN = {*_COMPARE, "$and", "$or", "$not"}
_NUMERIC = {"$add", "$subtract", "$multiply", "$divide", "$mod", "$size", *_DATE}
