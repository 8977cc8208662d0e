"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (first 64 normalised characters, SHA-256, id), sorted by Spark's
external sort, and neighbours are compared in full. Splitters go to the driver, so they can't hold whole texts: beyond 64 characters the digest stands for the rest of the order. The id in the splitters lets a text with very many copies
spread over partitions; the first and last run of each partition (two rows a partition, with one full text each) are compared in full and stitched together afterwards.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy, written

PREFIX = 64
#: Whether the text was null; a name that no table of documents uses.
NULL = "__text_was_null__"


def normalised(text) -> F.Column:
    """Null counts as empty; A-Z become a-z, nothing else changes."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, keep: str, carry: bool) -> DataFrame:
    norm = normalised(F.col(text_col))
    order = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.substring(norm, 1, PREFIX).alias("head"), F.sha2(norm, 256).alias("sha"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(text_col).isNull().alias(NULL)).alias("row")] if carry else []),
    )
    dealt = rows.repartitionByRange("head", "sha", order).sortWithinPartitions("head", "sha", order)
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("summary", T.StringType()), T.StructField("part", T.LongType()), T.StructField("id", id_type), T.StructField("sha", T.StringType()), T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("edge", T.BooleanType())]
    if carry:
        fields += [T.StructField("text", T.StringType()), T.StructField("row", rows.schema["row"].dataType)]
    return dealt.mapInArrow(tidy(lambda batches: _runs(batches, carry)), T.StructType(fields))


def _runs(batches, carry: bool):
    """Compares neighbours in full and yields a row for each document, and a summary row (with the run's normalised text) for the first and last run of the partition.

    With carry, only the first row of each run is yielded, with all its columns.
    """
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []  # rows of the run that is still open (with carry, its first row)
    held_n, held_text, last, closed = 0, None, None, 0

    def out(b: pa.RecordBatch, firsts: np.ndarray, sizes: np.ndarray, edge: bool) -> pa.RecordBatch:
        """firsts: for each row the index of its run's first row."""
        n = b.num_rows
        cols = [pa.nulls(n, pa.string()), pa.array(np.full(n, part)), b["id"], b["sha"], b["id"].take(pa.array(firsts)), pa.array(sizes.astype(np.int64)), pa.array(firsts == np.arange(n)), pa.array(np.full(n, edge))]
        names = ["summary", "part", "id", "sha", "keep_id", "group_size", "first", "edge"]
        if carry:
            cols, names = [*cols, b["text"], b["row"]], [*names, "text", "row"]
        return pa.RecordBatch.from_arrays(cols, names)

    def close(edge: bool):
        first = held[0].slice(0, 1)
        one = out(first, np.zeros(1, int), np.full(1, held_n), edge)
        if edge:
            yield pa.RecordBatch.from_arrays([held_text, *(pa.nulls(1, c.type) if name in ("text", "row") else c for name, c in zip(one.schema.names[1:], one.columns[1:]))], one.schema.names)
        if carry:
            yield one
            return
        for i, b in enumerate(held):
            x = out(b, np.zeros(b.num_rows, int), np.full(b.num_rows, held_n), edge)
            if i:  # the run's first row is in the first batch
                x = x.set_column(4, "keep_id", pa.array([first["id"][0].as_py()] * b.num_rows, first["id"].type)).set_column(6, "first", pa.array(np.zeros(b.num_rows, bool)))
            yield x

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        norm = pc.ascii_lower(b["text"])
        same = np.zeros(n, bool)
        same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same[0] = last is not None and norm[0].as_py() == last
        starts = np.flatnonzero(~same)
        head = int(starts[0]) if len(starts) else n
        if head:
            held_n += head
            if not carry:
                held.append(b.slice(0, head).select(["id", "sha"]))
        if not len(starts):
            continue
        if held:
            yield from close(edge=not closed)
            closed += 1
        if len(starts) > 1:
            begin, cuts = starts[0], starts
            if not closed:  # the very first run of the partition goes on its own
                held, held_n, held_text = [b.slice(begin, starts[1] - begin)], int(starts[1] - begin), norm.slice(begin, 1)
                yield from close(edge=True)
                closed, cuts = 1, starts[1:]
            if len(cuts) > 1:
                sizes = np.diff(cuts)
                if carry:
                    yield out(b.take(pa.array(cuts[:-1])), np.arange(len(sizes)), sizes, False)
                else:
                    inner = b.slice(cuts[0], cuts[-1] - cuts[0])
                    yield out(inner, np.repeat(cuts[:-1] - cuts[0], sizes), np.repeat(sizes, sizes), False)
                closed += len(sizes)
        at = int(starts[-1])
        held, held_n, held_text = [b.slice(at, 1 if carry else n - at)], n - at, norm.slice(at, 1)
        last = norm[n - 1].as_py()
    if held:
        yield from close(edge=True)


def _stitched(runs: DataFrame) -> DataFrame:
    """Joins the runs that cross partitions: at most two summary rows a partition, so the broadcast side is bounded by the partition count."""
    runs = written(runs, "exact-runs")
    # Runs of one text, compared in full. A run's partitions are in the order of the ids, so its first partition holds the row that stays.
    edges = runs.where("summary IS NOT NULL").select("part", "sha", "keep_id", "group_size", F.col("summary").alias("norm"))
    whole = edges.groupBy("norm").agg(F.min(F.struct("part", "keep_id")).alias("head"), F.sum("group_size").alias("all_n"), F.collect_set(F.struct("part", "sha")).alias("parts"))
    whole = whole.select("head", "all_n", F.explode("parts").alias("at")).select("head", "all_n", F.col("at.part").alias("edge_part"), F.col("at.sha").alias("edge_sha"))
    rows = runs.where("summary IS NULL")
    joined = rows.join(F.broadcast(whole), F.col("edge") & (F.col("part") == F.col("edge_part")) & (F.col("sha") == F.col("edge_sha")), "left")
    return joined.withColumns({
        "keep_id": F.when(F.col("edge"), F.col("head.keep_id")).otherwise(F.col("keep_id")),
        "group_size": F.when(F.col("edge"), F.col("all_n")).otherwise(F.col("group_size")),
        "kept": F.col("first") & (~F.col("edge") | (F.col("part") == F.col("head.part"))),
    })


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts count as empty, so they are equal to empty texts. Null ids take part; a group of null ids only has a null keep_id. Of rows that share text and id
    exactly one is kept. An empty table gives an empty result. Other columns of docs are ignored, whatever their names.
    """
    rows = _stitched(_sorted_runs(docs, id_col, text_col, keep, carry=False))
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs without the rows whose text equals that of a kept row; all columns and the original text stay."""
    kept = _stitched(_sorted_runs(docs, id_col, text_col, keep, carry=True)).where("kept")
    return kept.select(*[(F.when(~F.col(f"row.{NULL}"), F.col("text")) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
