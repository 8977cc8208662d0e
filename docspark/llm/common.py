"""Helpers shared by the operators: tables, the shared folder, word and shingle hashes."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..scratch import discard, new_folder, shared_dir, written

__all__ = ["Words", "byte_parts", "discard", "many_shingles", "mixed", "new_folder", "shared_dir", "shingles", "table", "tidy", "word_hashes", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run):
    """run, a function of Arrow batches, that hands its memory back to the system when its task ends: idle Python workers are kept, and so would be what they hold."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def byte_parts(batch: pa.RecordBatch, column: str, size: int, rows: int = 2000):
    """Where each part of batch begins, and the part: at most so many rows, and of the text column about so many bytes. A longer text is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy().astype(np.int64))
    at = done = 0
    while at < batch.num_rows:
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))))
        yield at, batch.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


_MIX = np.uint64(0x9E3779B97F4A7C15)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A random permutation of the 64-bit numbers for each seed."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95) & (2**64 - 1))
    x = (x ^ (x >> _S32)) * _MIX
    x = (x ^ (x >> _S29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _S32)


_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random number for each byte, the same for A-Z as for a-z, 0 for white space.
_VALUES = np.where(_IS_SPACE, np.uint64(0), mixed(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64), 11) | np.uint64(1))
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at once.
_BLOCK = 1 << 20


def word_hashes(texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as 64-bit hashes, and for each text where its first one is (and the end).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; null texts have none. A word's hash is a polynomial in random numbers of its bytes, by array steps over all
    bytes; texts are worked on in blocks that end between words, so a long text takes no more memory at once than a short one.
    """
    space = pa.scalar(" ", pa.large_string())
    column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string())
    column = pc.binary_join_element_wise(pc.fill_null(column, ""), space, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        blank = _IS_SPACE[data[at : at + _BLOCK]]
        size = _BLOCK
        while at + size < len(data) and not blank.any():  # a word longer than a block
            size *= 2
            blank = _IS_SPACE[data[at : at + size]]
        blank = blank[: len(blank) - int(blank[::-1].argmax())]  # up to the last white space; all texts end with one
        first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        if len(first):
            values = _VALUES[data[at : at + len(blank)]][first[0] :]
            place = np.arange(len(values)) - np.repeat(first - first[0], np.diff(np.append(first, len(blank))))
            powers = np.full(int(np.diff(np.append(first, len(blank))).max()), _BASE)
            powers[0] = 1
            hashes.append(mixed(np.add.reduceat(values * np.cumprod(powers)[place], first - first[0]), 12))
            starts.append(first + at)
        at += len(blank)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


class Words:
    """Word sequences of texts as arrays of hashes (see word_hashes)."""

    def hashes(self, text: str | None) -> np.ndarray:
        return word_hashes([text])[0]

    def many(self, texts: pa.Array | list) -> list[np.ndarray]:
        flat, at = word_hashes(texts)
        return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each place where `size` words begin; of fewer words, one hash of the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = words[: n - width + 1].copy()
    for k in range(1, width):
        out = (out ^ (out >> _S29)) * _MIX + words[k : n - width + 1 + k]
    if width < size:
        out = out + np.uint64(width)
    return mixed(out)


def many_shingles(texts: pa.Array | list, size: int) -> list[np.ndarray]:
    """shingles() of each text's words, worked out for all texts at once."""
    flat, at = word_hashes(texts)
    out = shingles(np.concatenate([flat, np.zeros(size - 1, np.uint64)]), size) if len(flat) else flat
    return [out[i : j - size + 1] if j - i >= size else shingles(flat[i:j], size) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
