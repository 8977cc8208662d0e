"""Random filters select the rows that a plain reading of the language selects."""

import operator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docspark.plans import find

ROWS = [(i, a, s) for i, (a, s) in enumerate((a, s) for a in (None, -1, 0, 3, 7) for s in (None, "", "a", "ab", "B"))]
VALUES = {"a": st.sampled_from([-1, 0, 2, 3, 7]), "s": st.sampled_from(["", "a", "ab", "b"])}
ORDER = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def conditions(field):
    value = VALUES[field]
    return st.one_of(
        value, st.none(), st.builds(lambda op, v: {op: v}, st.sampled_from(["$eq", "$ne", *ORDER]), value), st.builds(lambda op, v: {op: v}, st.sampled_from(["$in", "$nin"]), st.lists(st.one_of(value, st.none()), max_size=3)),
        st.builds(lambda b: {"$exists": b}, st.booleans()), st.builds(lambda op, v: {"$not": {op: v}}, st.sampled_from(list(ORDER)), value),
    )


leaf = st.sampled_from(["a", "s"]).flatmap(lambda f: conditions(f).map(lambda c: {f: c}))
filters = st.recursive(leaf, lambda q: st.one_of(st.builds(lambda op, qs: {op: qs}, st.sampled_from(["$and", "$or", "$nor"]), st.lists(q, min_size=1, max_size=3)), q.map(lambda x: {"$not": x})), max_leaves=5)


def meets(value, c):
    if not isinstance(c, dict):
        return value is None if c is None else value == c
    ((op, arg),) = c.items()
    if op == "$not":
        return not meets(value, arg)
    if op in ORDER:
        return value is not None and ORDER[op](value, arg)
    return {"$eq": lambda: value == arg, "$ne": lambda: value != arg, "$in": lambda: value in arg, "$nin": lambda: value not in arg, "$exists": lambda: (value is not None) == arg}[op]()


def selects(row, q):
    ((key, arg),) = q.items()
    if key == "$and":
        return all(selects(row, x) for x in arg)
    if key == "$or":
        return any(selects(row, x) for x in arg)
    if key == "$nor":
        return not any(selects(row, x) for x in arg)
    if key == "$not":
        return not selects(row, arg)
    return meets(row[{"a": 1, "s": 2}[key]], arg)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "i int, a int, s string").coalesce(1)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(q=filters)
def test_filters_select_what_they_say(rows, q):
    assert sorted(r["i"] for r in find(rows, q).collect()) == [r[0] for r in ROWS if selects(r, q)]
