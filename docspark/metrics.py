"""What a query did: counts gathered while it runs, latency percentiles of recorded times, and its plan."""

from __future__ import annotations

import statistics
import time
from collections import defaultdict, deque
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .operators.stages import Context
from .plans.pipeline import _apply, validate

#: Times kept for each name.
KEPT = 1000


class Metrics:
    """Counters and the last times by name, on the driver."""

    def __init__(self):
        self.counters: dict[str, int] = defaultdict(int)
        self.times: dict[str, deque[float]] = defaultdict(lambda: deque(maxlen=KEPT))

    def count(self, name: str, by: int = 1) -> None:
        self.counters[name] += by

    @contextmanager
    def timed(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.times[name].append(time.perf_counter() - start)
            self.counters[name] += 1

    def summary(self, name: str) -> dict[str, float]:
        values = sorted(self.times[name])
        if not values:
            return {}
        at = lambda q: values[min(len(values) - 1, int(q * len(values)))]
        return {"n": len(values), "mean": statistics.fmean(values), "median": statistics.median(values), "p95": at(0.95), "p99": at(0.99)}


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df, and an observation that holds its row count once an action has run on it: no second pass."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("n")), watch


def explain(df: DataFrame, pipeline: list[dict], collections: dict[str, DataFrame] | None = None) -> str:
    """The physical plan of a whole pipeline, as Catalyst made it."""
    validate(pipeline)
    out = _apply(df, list(pipeline), Context(collections=dict(collections or {})))
    return out._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def percentiles(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, median, p95, p99 of a column of latencies, by a mergeable sketch."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *[F.percentile_approx(value, q, 10_000).alias(name) for name, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))])
