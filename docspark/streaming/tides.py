"""Tides: documents generated along a clock, by steps that are active for a time. Also event-time windows over a stream of events."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.generate import generate, uniform
from ..scratch import written

JITTER = 0.1
#: Ticks whose steps are summed up in one block when jitter adds up.
BLOCK = 10_000


@dataclass
class Step:
    step_id: str
    start: datetime
    end: datetime
    model: dict | None = None
    model_path: str = ""
    weight: float = 1.0
    documents: int = 1
    probability: float = 1.0
    entropy: float | None = None
    tags: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class Tide:
    name: str
    start: datetime
    end: datetime
    interval_ms: int
    steps: list[Step]
    seed: int = 0
    jitter: bool = False
    entropy: float | None = None
    metadata: bool = False

    def validate(self) -> list[str]:
        errors = []
        if self.start >= self.end:
            errors.append("the tide ends before it starts")
        if self.interval_ms <= 0:
            errors.append("the interval must be positive")
        if not self.steps:
            errors.append("a tide needs a step")
        if len({s.step_id for s in self.steps}) < len(self.steps):
            errors.append("step ids repeat")
        for s in self.steps:
            if s.start >= s.end:
                errors.append(f"step {s.step_id} ends before it starts")
            if not 0 <= s.probability <= 1:
                errors.append(f"step {s.step_id}: the probability isn't from 0 to 1")
            if s.documents <= 0:
                errors.append(f"step {s.step_id}: no documents per interval")
            if s.model is None and not s.model_path:
                errors.append(f"step {s.step_id} has no model")
        return errors

    def checked(self) -> Tide:
        if errors := self.validate():
            raise ValueError("; ".join(errors))
        return self


def _micros(t: datetime) -> int:
    from calendar import timegm

    return timegm(t.utctimetuple()) * 1_000_000 + t.microsecond


def tide_ticks(spark: SparkSession, tide: Tide) -> DataFrame:
    """tick, ts: the clock. Jitter moves each interval by up to ten per cent, and the moves add up."""
    tide.checked()
    start, step = _micros(tide.start), tide.interval_ms * 1000
    n = -(-(_micros(tide.end) - start) // step)
    if not tide.jitter:
        return spark.range(n).select(F.col("id").alias("tick"), F.timestamp_micros(F.lit(start) + F.col("id") * step).alias("ts"))
    n = int(n / (1 - JITTER)) + 1
    moved = (F.floor((1 + JITTER * (2 * uniform(tide.seed, F.col("id"), "jitter") - 1)) * step)).cast("long")
    rows = written(spark.range(n).select(F.col("id").alias("tick"), F.floor(F.col("id") / BLOCK).alias("block"), moved.alias("length")), "ticks")
    # Sums within blocks in parallel; only one row a block meets in one task.
    blocks = rows.groupBy("block").agg(F.sum("length").alias("total"))
    before = blocks.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("length").over(Window.partitionBy("block").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.withColumn("inside", inside).join(before, "block").select("tick", (F.lit(start) + F.col("offset") + F.col("inside")).alias("micros"))
    return at.where(F.col("micros") < _micros(tide.end)).select("tick", F.timestamp_micros("micros").alias("ts"))


def _chosen(tide: Tide) -> Column:
    """The index of the step that fires at a tick: of the active ones one by weight. Null if none is active."""
    micros = F.unix_micros("ts")
    races = []
    for i, s in enumerate(tide.steps):
        key = -F.log(F.greatest(uniform(tide.seed, F.col("tick"), s.step_id, "weight"), F.lit(1e-300))) / (s.weight or 1.0)
        active = (micros >= _micros(s.start)) & (micros < _micros(s.end))
        races.append(F.when(active, F.struct(key.alias("key"), F.lit(i).alias("step"))))
    return F.array_min(F.array(*races))["step"]  # array_min leaves nulls out


def tide_events(spark: SparkSession, tide: Tide, ticks: DataFrame | None = None) -> DataFrame:
    """tick, ts, step, n: a row for each document to come, without an exchange. A probability of 0 counts as 1."""
    rows = (ticks if ticks is not None else tide_ticks(spark, tide)).withColumn("step", _chosen(tide)).where(F.col("step").isNotNull())
    by_step = lambda f: F.element_at(F.array(*[F.lit(f(s)) for s in tide.steps]), F.col("step") + 1)
    fires = uniform(tide.seed, F.col("tick"), "fires") <= by_step(lambda s: float(s.probability or 1.0))
    return rows.where(fires).withColumn("n", F.explode(F.sequence(F.lit(1), by_step(lambda s: s.documents))))


def tide_documents(spark: SparkSession, tide: Tide, max_documents: int | None = None) -> DataFrame:
    """ts, step_id, document (JSON), and with metadata model_path, tags and properties. Each step's documents come from its own model."""
    events = tide_events(spark, tide)
    if max_documents:
        events = events.orderBy("tick", "n").limit(max_documents)
    parts = []
    for i, s in enumerate(tide.steps):
        mine = events.where(F.col("step") == i).withColumn("id", F.xxhash64("tick", "n"))
        made = generate(spark, s.model or {"type": "object"}, 0, tide.seed + i, s.entropy if s.entropy is not None else tide.entropy, rows=mine, with_id=False).columns
        from ..functions.generate import Generator

        values = Generator(tide.seed + i, s.entropy if s.entropy is not None else tide.entropy).properties(s.model or {}, F.col("id"), "$")
        document = F.to_json(F.struct(*[values[c].alias(c) for c in made])) if made else F.lit("{}")
        extra = [F.lit(s.model_path).alias("model_path"), F.array(*[F.lit(t) for t in s.tags]).cast("array<string>").alias("tags"), F.lit(str(s.properties)).alias("properties")] if tide.metadata else []
        parts.append(mine.select("ts", F.lit(s.step_id).alias("step_id"), document.alias("document"), *extra))
    return reduce(DataFrame.unionByName, parts)


def tide_statistics(spark: SparkSession, tide: Tide, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """step_id, intervals, estimated: how many documents a range of time (the whole tide) is expected to give."""
    low, high = _micros(start or tide.start), _micros(end or tide.end)
    rows = [(s.step_id, _micros(s.start), _micros(s.end), s.documents, float(s.probability or 1.0)) for s in tide.steps]
    steps = spark.createDataFrame(rows, "step_id string, s long, e long, documents long, p double")
    overlap = F.greatest(F.least("e", F.lit(high)) - F.greatest("s", F.lit(low)), F.lit(0))
    intervals = F.floor(overlap / (tide.interval_ms * 1000))
    return steps.select("step_id", intervals.alias("intervals"), F.floor(intervals * F.col("documents") * F.col("p")).alias("estimated"))


def stream_ticks(spark: SparkSession, tide: Tide, rows_per_batch: int = 1000) -> DataFrame:
    """The clock as a stream: tick and ts, rows_per_batch a micro-batch."""
    tide.checked()
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("startTimestamp", 0).option("advanceMillisPerBatch", 1000).load()
    at = F.lit(_micros(tide.start)) + F.col("value") * (tide.interval_ms * 1000)
    return source.select(F.col("value").alias("tick"), F.timestamp_micros(at).alias("ts")).where(at < _micros(tide.end))


# Event-time windows


def windowed(events: DataFrame, ts: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """window_start, window_end, keys, n (and total) per tumbling or sliding window, for batches and streams; a stream drops what comes later than `late`."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    totals = [F.sum(value).alias("total")] if value else []
    return rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), *totals).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *[c for c in ("total",) if value])


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end, n: events of a key no further apart than the gap."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
