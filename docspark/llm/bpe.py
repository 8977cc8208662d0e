"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is split by the vocabulary's pattern. In each piece the tree holds, for every live byte position, the rank of the
pair that starts there; its root is the leftmost minimum. A merge updates three leaves (the merged token, its right neighbour, which
dies, and its left neighbour), each in logarithmic time, so pieces of millions of bytes stay affordable.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

#: Children of a tree node: min() of a short slice is one fast call.
FAN = 16
NONE = 1 << 62
#: Encoded pieces that a worker remembers, in each of two generations (about 300 bytes each).
REMEMBERED = 80_000
#: Up to so many bytes a list of pair ranks is faster than the tree.
SHORT = 96


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankTree:
    """Minimum of rank << 32 | position over live positions, with point updates."""

    def __init__(self, keys: list[int]):
        self.levels = [keys]
        while len(self.levels[-1]) > FAN:
            below = self.levels[-1]
            self.levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])

    def least(self) -> int:
        return min(self.levels[-1])

    def put(self, at: int, key: int) -> None:
        below = self.levels[0]
        below[at] = key
        for level in self.levels[1:]:
            at //= FAN
            level[at] = min(below[at * FAN : at * FAN + FAN])
            below = level


def _encode_short(piece: bytes, rank) -> list[int]:
    """encode_piece() of a short piece: a list of its tokens and one of their pairs' ranks."""
    tokens = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != NONE:
        at = pairs.index(least)
        tokens[at] += tokens.pop(at + 1)
        del pairs[at]
        if at:
            pairs[at - 1] = rank(tokens[at - 1] + tokens[at], NONE)
        if at < len(pairs):
            pairs[at] = rank(tokens[at] + tokens[at + 1], NONE)
    return list(map(rank, tokens))


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece; equal ranks merge from the left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank = ranks.get
    if n <= SHORT:
        return _encode_short(piece, rank)
    end = list(range(1, n + 1))  # where the token that begins here ends
    start = list(range(-1, n))  # where the token that ends here begins; start[i] belongs to end i
    tree = RankTree([(r << 32 | i) if (r := rank(piece[i : i + 2])) is not None else NONE for i in range(n - 1)] or [NONE])
    last = n - 1
    while (key := tree.least()) != NONE:
        at = key & 0xFFFFFFFF
        middle = end[at]
        stop = end[middle]
        end[at] = stop
        start[stop] = at
        if middle < last:
            tree.put(middle, NONE)
        if stop < n and (r := rank(piece[at : end[stop]])) is not None:
            tree.put(at, r << 32 | at)
        else:
            tree.put(at, NONE)
        if at:
            left = start[at]
            r = rank(piece[left:stop])
            tree.put(left, NONE if r is None else r << 32 | left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Pieces(dict):
    """The ids of pieces as packed int32. Recent pieces are looked up; when there are too many, the older generation goes."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = array("i", encode_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found

    def rest(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Encodes texts by a rank table and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split, self.pieces = regex.compile(pattern).findall, Pieces(ranks)

    def packed(self, text: str | None) -> bytes:
        self.pieces.rest()
        return b"".join(map(self.pieces.__getitem__, self.split(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def column(self, texts: pa.Array) -> pa.Array:
        rows = [self.packed(text) for text in texts.to_pylist()]
        ends = np.cumsum([0, *(len(row) // 4 for row in rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id; null where no token has it."""
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return pa.array(tokens, pa.large_binary())


def decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """Each row's bytes: all tokens lie one after the other, so a row is a slice of them."""
    values = ids.flatten()
    taken = tokens.take(values)
    if taken.null_count:
        raise ValueError("an id that the vocabulary doesn't have")
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    offsets = at[np.concatenate([[0], np.cumsum(sizes)])]
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(offsets)), taken.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(ids.is_valid(), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch[c] for c in keep), column], [*keep, name])


def _schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _parts(batch: pa.RecordBatch, rows: int = 500):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs and a column ids_col, array<int>, with the ids of the whole text.

    Null and empty texts give an empty array. A column of docs with the name ids_col is replaced; all others stay. The vocabulary file is read
    on the driver and broadcast: its size is fixed and doesn't depend on the data.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            for part in _parts(batch):
                yield _with(part, ids_col, encoder.column(part[text_col]))

    return docs.mapInArrow(tidy(run), _schema_with(docs, ids_col, T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """rows and a binary column bytes_col with the bytes that ids_col stands for. Null ids give null; an unknown id is an error."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        tokens = token_bytes(ranks.value)
        for batch in batches:
            for part in _parts(batch):
                yield _with(part, bytes_col, decoded(part[ids_col], tokens))

    return rows.mapInArrow(tidy(run), _schema_with(rows, bytes_col, T.BinaryType()))


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256, from encode() and decode()."""
    encoded = encode(docs.select(id_col, text_col), ranks_path, pattern, text_col).drop(text_col)
    return decode(encoded, ranks_path).select(
        id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
