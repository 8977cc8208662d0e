"""Keys that more than one document has, found with one shuffle of packed columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Keys that a task gathers before it deals them out (16 bytes each).
HELD_KEYS = 1 << 20
#: Bits of a broadcast bitmap: some for each key that it holds, between these (128 kB and 64 MB). Fuller ones let more rows pass, and the joins that follow drop them.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 20, 29, 16


def slices(spark) -> int:
    """Slices of the key range that packed keys are dealt out by: some for each shuffle partition."""
    return 1 << max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())


def cut(keys: np.ndarray, count: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Of sorted unsigned 64-bit keys: the slices that have any, and where each begins and ends."""
    which, starts = np.unique(keys >> np.uint64(64 - (count.bit_length() - 1)), return_index=True)
    return which.astype(np.int64), [*starts], [*starts[1:], len(keys)]


def by_slice(rows: DataFrame) -> DataFrame:
    """Packed rows dealt out by slice and sorted by Spark, which spills, so a task holds one slice at a time."""
    return rows.repartition("slice").sortWithinPartitions("slice")


def slice_groups(batches, columns: list[str]) -> Iterator[list[list[bytes]]]:
    """For each slice of rows sorted by slice: the lists of its packed columns."""
    at, held = None, []
    for batch in batches:
        for k, *packed in zip(batch["slice"].to_pylist(), *(batch[c].to_pylist() for c in columns)):
            if k != at and held:
                yield [list(x) for x in zip(*held)]
                held = []
            at = k
            held.append(packed)
    if held:
        yield [list(x) for x in zip(*held)]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal sorted keys."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.append(starts[1:], len(keys)) - 1


def first_ids(rows: DataFrame, key: str, keyed: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """key, first_id: the keys (random 64-bit numbers) under which at least two ids of rows are, and the smallest of them.

    keyed gives the keys and ids of a batch (by default its columns `key` and id). A task sends a key at most twice for each HELD_KEYS of them, with its smallest and its
    largest id, so no number of rows under one key gathers anywhere.
    """
    n = slices(rows.sparkSession)
    keyed = keyed or (lambda batch: (batch[key].to_numpy().view(np.uint64), batch["id"].to_numpy()))

    def dealt(held):
        keys, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        starts, ends = runs(keys)
        keep = np.unique(np.concatenate([starts, ends[ids[starts] != ids[ends]]]))
        keys, ids = keys[keep], ids[keep]
        which, i, j = cut(keys, n)
        return pa.RecordBatch.from_arrays([pa.array(which), *(pa.array([x[a:b].tobytes() for a, b in zip(i, j)], pa.binary()) for x in (keys, ids))], ["slice", "keys", "ids"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append(keyed(batch))
            size += len(held[-1][0])
            if size >= HELD_KEYS:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def meet(batches):
        for parts in slice_groups(batches, ["keys", "ids"]):
            keys, ids = (np.frombuffer(b"".join(x), t) for x, t in zip(parts, (np.uint64, np.int64)))
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            starts, ends = runs(keys)
            keep = starts[ids[starts] != ids[ends]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(ids[keep])], [key, "first_id"])

    return by_slice(rows.mapInArrow(tidy(pack), "slice long, keys binary, ids binary")).mapInArrow(tidy(meet), f"{key} long, first_id long")


class Bitmap:
    """A bitmap of 64-bit keys for tasks: all of its keys pass, and few others."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, np.uint64(64 - bits)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(keys: DataFrame, key: str):
    """A broadcast Bitmap of a column of random 64-bit keys, sized by their number."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_KEY * keys.count() - 1).bit_length()))
    at = F.shiftrightunsigned(F.col(key), 64 - bits)
    words = keys.select(at.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Bitmap(out, bits))
