"""N-gram Jaccard join with a token-group matrix; exact.

1. Every document becomes its set of distinct n-word shingle hashes. Equal sets are one class, represented by its smallest id.
2. Similar classes are partitioned into groups: of the MinHash bands of a class the most shared one names its cluster (if the class has a second band in common with the cluster's
   leader: in a larger corpus more classes share one band by chance), and clusters are cut into groups of bounded size. The members of a group are compared with each other and with the cluster's leader, whole sets; those of the largest component that this gives are a
   subgroup, the others together one more; a class that shares no band is a subgroup of its own. Through the leaders, the groups of a cluster of near copies fall into one component at once.
3. The matrix has a row for each (token, subgroup) of the subgroup's token union, as far as the overlap bound needs it: to link, two documents must share k tokens
   of their prefixes (the first n - ceil(t n) + k tokens in one global order), so two subgroups whose unions of prefixes share fewer can't hold a link and stay closed.
   So do subgroups of one component. Pairs that share enough are opened: their members are compared with each other, whole sets, in one step.
4. The order is by hash, except that tokens which many documents share (a common line) come last. Counted are the documents of every token in the part of the
   hash range where prefixes lie, and of all tokens of documents whose prefixes reach further. The order changes the cost, never the result.
5. An opened pair gives no more links than tie its members together; all links give the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, many_shingles, mixed, tidy, written
from .components import components
from .meeting import HELD_KEYS, by_slice, runs, slice_groups, slices
from .sieve import passing, sieved

BANDS, ROWS = 8, 2
#: Bands that a class shares with the leader of its cluster at least. Others stay by themselves: this changes the cost, never the result.
SHARED_BANDS = 2
#: Documents and tokens of a group, about.
GROUP_DOCS, GROUP_TOKENS = 256, 32_768
#: Prefixes are longer than one common token needs by this percentage of the set and as many tokens more, so that as many must be common: a shared line doesn't make candidates.
EXTRA, MORE = 3, 4
#: Of each document the tokens in the lowest part of the hash range are kept: what a prefix takes on average, and this percentage more.
SPARE = 5
#: A token that more documents have comes last in the order,
WIDE = 32
#: or, if there are more of them, the widest this many (4 bytes each, broadcast).
WIDE_LIMIT = 200_000
#: Salts by which the rows of one cluster are dealt out for a join.
SALTS = 16
#: A text of up to so many bytes for each of its tokens is shuffled itself, as Spark compresses it; tokens (8 bytes each) are random numbers.
TEXT_BYTES = 12
_KEY_SHIFT = np.uint64(32)
_ODD = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 7) | np.uint64(1)


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set that it links to."""
    return -(-percent * n // 100)


def shared_least(n: int, percent: int) -> int:
    """Prefix tokens that a set of n shares at least with a set that it links to (of both sets the lower number)."""
    return min(needed(n, percent), n * EXTRA // 100 + MORE)


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """Prefix lengths of a set as the larger and as the smaller one of a pair.

    Sets that share o tokens share at least k of their first n - o + k, in any common order.
    """
    k = shared_least(n, percent)
    return n - needed(n, percent) + k, min(n, n - -(-2 * percent * n // (100 + percent)) + k)


def token_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    out = [np.sort(x) for x in many_shingles(texts, n)]
    return [x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x for x in out]


def _is_wide(tokens: np.ndarray, wide: np.ndarray) -> np.ndarray:
    if not len(wide):
        return np.zeros(len(tokens), bool)
    keys = (tokens >> _KEY_SHIFT).astype(np.uint32)
    return (wide[np.minimum(np.searchsorted(wide, keys), len(wide) - 1)] == keys)


def _bands(tokens: np.ndarray) -> list[int]:
    least = np.array([(tokens * odd).min() for odd in _ODD], np.uint64).reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least)]


def _heads(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n_shingles, sig (16 bytes that name the set), low (its lowest tokens, in order), bands (of those tokens: a sample of the set that is the same in similar sets)."""

    until = np.uint64((1 << 64) // 100 * (100 - percent + EXTRA + SPARE))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, sigs, lows, bands = [], [], [], []
                for tokens in token_sets(part["text"], n):
                    size = len(tokens)
                    sizes.append(size)
                    sigs.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    links = size > 0 and _can_link(size, percent)
                    low = tokens[: max(prefix_sizes(size, percent)[0], int(np.searchsorted(tokens, until)))] if links else None
                    lows.append(low.view(np.int64) if links else None)
                    bands.append(_bands(low) if links else None)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(lows, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["id", "n_shingles", "sig", "low", "bands"])

    return docs.mapInArrow(tidy(run), "id long, n_shingles long, sig binary, low array<long>, bands array<long>")


def _can_link(n: int, percent: int) -> bool:
    """Whether a set of n can link to a different set: n of n + 1 shingles must be enough, or n - 1 of n."""
    return 100 * n >= percent * (n + 1) or (n > 1 and 100 * (n - 1) >= percent * n)


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id and the whole token set (packed) of the documents that ids names, and a few more."""
    rows, sieve = sieved(docs, ids)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = passing(batch.slice(at, 500), sieve.value)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([t.tobytes() for t in token_sets(part["text"], n)], pa.binary())], ["id", "tokens"])

    return rows.mapInArrow(tidy(run), "id long, tokens binary")


def _texts_or_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Like _sets(), for a shuffle: text where that is shorter than the token set, else tokens; the other one is null. _token_sets_of() reads both."""
    rows, sieve = sieved(docs, ids)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = passing(batch.slice(at, 500), sieve.value)
                sets = token_sets(part["text"], n)
                long = pc.greater(pc.fill_null(pc.binary_length(part["text"]), 0), pa.array([TEXT_BYTES * len(t) for t in sets], pa.int64()))
                tokens = pa.array([t.tobytes() if x else None for t, x in zip(sets, long.to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part["id"], pc.if_else(long, None, part["text"]), tokens], ["id", "text", "tokens"])

    return rows.mapInArrow(tidy(run), "id long, text string, tokens binary")


def _token_sets_of(rows: pa.Table, n: int) -> list[np.ndarray]:
    sets = token_sets(rows["text"].combine_chunks(), n)
    return [own if tokens is None else np.frombuffer(tokens, np.uint64) for own, tokens in zip(sets, rows["tokens"].to_pylist())]


def _groups(known: DataFrame, reps: DataFrame) -> DataFrame:
    """id, grp, leader of the classes in clusters of several: clusters by the most shared band of a leader of whom a class has SHARED_BANDS, cut into groups. leader is set in clusters of more groups than one."""
    sized = known.where(F.col("low").isNotNull()).select("id", F.col("n_shingles").alias("n"), "bands").join(reps, "id", "left_semi")
    banded = sized.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1")
    near = banded.join(shared, "band").groupBy("id", "leader").agg(F.max("members").alias("members"), F.count("*").alias("bands")).where(F.col("bands") >= SHARED_BANDS)
    chosen = near.groupBy("id").agg(F.max_by("leader", F.struct("members", -F.col("leader"))).alias("cluster"))
    member = written(sized.select("id", "n").join(chosen, "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "jaccard-clusters")
    cuts = member.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).where("docs > 1")
    cuts = cuts.select("cluster", F.ceil(F.greatest(F.col("docs") / GROUP_DOCS, F.col("tokens") / GROUP_TOKENS)).alias("parts"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    grp = F.xxhash64("cluster", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")))
    found = written(member.join(cuts, ["cluster", "salt"]).select("id", grp.alias("grp"), F.when(F.col("parts") > 1, F.col("cluster")).alias("leader")), "jaccard-groups")
    discard(member)
    return found


_PACKED = "sub long, grp long, mixed boolean, ids array<long>, sizes array<int>, tokens binary, index array<long>, rest array<long>, low int, high int, k int, a array<long>, b array<long>"
_LINKS = "a long, b long"


def _packed_groups(sets: DataFrame, n: int, percent: int, wide) -> DataFrame:
    """The subgroups of groups of sets (grp, id, guest, and text or tokens): sub (the smallest id), its members' ids, sizes and tokens, the union of their prefixes, and the links found so far.

    The largest component is a subgroup, if it has two members at least; all other members are a mixed one. A guest (a leader) is compared with the group's members, but isn't one of them.
    """

    def pack(group: pa.Table) -> pa.Table:
        ids, guests = group["id"].to_pylist(), group["guest"].to_pylist()
        sets = _token_sets_of(group, n)
        sizes = [len(t) for t in sets]
        links = spanning_links(ids, sizes, np.concatenate(sets), ids, sizes, np.concatenate(sets), percent)
        root = {i: i for i in ids}

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in links:
            root[max(find(i), find(j))] = min(find(i), find(j))
        parts: dict[int, list[int]] = {}
        for k in sorted(range(len(ids)), key=lambda k: ids[k]):
            if not guests[k]:
                parts.setdefault(find(ids[k]), []).append(k)
        largest = max(parts, key=lambda top: (len(parts[top]), -top), default=None)
        alone = largest is None or len(parts[largest]) < 2
        rest = sorted((k for top, part in parts.items() if alone or top != largest for k in part), key=lambda k: ids[k])
        rows = []
        subgroups = ([] if alone else [(False, parts[largest])]) + ([(True, rest)] if rest else [])
        for at, (mixed_one, mine) in enumerate(subgroups):
            index, further = (np.unique(np.concatenate(x)) for x in zip(*(_split_prefix(sets[k], sizes[k], percent, wide.value) for k in mine)))
            own = [(i, j) for i, j in links if i != j] if not at else []
            rows.append({
                "sub": ids[mine[0]], "grp": group["grp"][0].as_py(), "mixed": mixed_one, "ids": [ids[k] for k in mine], "sizes": [sizes[k] for k in mine], "tokens": b"".join(sets[k].tobytes() for k in mine), "index": index, "rest": np.setdiff1d(further, index),
                "low": min(sizes[k] for k in mine), "high": max(sizes[k] for k in mine), "k": min(shared_least(sizes[k], percent) for k in mine), "a": [i for i, _ in own], "b": [j for _, j in own],
            })
        return pa.Table.from_pylist(rows, _PACKED_ARROW)

    return sets.groupBy("grp").applyInArrow(pack, _PACKED)


_PACKED_ARROW = pa.schema([("sub", pa.int64()), ("grp", pa.int64()), ("mixed", pa.bool_()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("index", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64())), ("low", pa.int32()), ("high", pa.int32()), ("k", pa.int32()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])


def spanning_links(ids_a, sizes_a, tokens_a, ids_b, sizes_b, tokens_b, percent: int) -> list[tuple[int, int]]:
    """Links between the documents of two packed groups, no more than tie together what they link."""
    sizes_a, sizes_b = np.array(sizes_a), np.array(sizes_b)
    rows_b = np.repeat(np.arange(len(sizes_b)), sizes_b)
    order = np.argsort(tokens_b, kind="stable")
    tokens_b, rows_b = tokens_b[order], rows_b[order]
    shared = np.zeros((len(sizes_a), len(sizes_b)), np.int64)
    at = 0
    for i, size in enumerate(sizes_a):
        mine = tokens_a[at : at + size]
        at += size
        low, high = np.searchsorted(tokens_b, mine, "left"), np.searchsorted(tokens_b, mine, "right")
        n = high - low
        hits = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        shared[i] = np.bincount(rows_b[hits], minlength=len(sizes_b))
    links = np.argwhere(100 * shared >= percent * (sizes_a[:, None] + sizes_b[None, :] - shared))
    found, parent = [], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in links:
        a, b = root(ids_a[i]), root(ids_b[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((ids_a[i], ids_b[j]))
    return found


def _as_links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _links_between(docs: DataFrame, pairs: DataFrame, packed: DataFrame, n: int, percent: int) -> DataFrame:
    """Opens the pairs (g, h) of subgroups and compares their members."""
    wanted = written(pairs.select(F.col("g").alias("sub")).union(pairs.select("h")).distinct(), "jaccard-opened")
    known = packed.join(wanted, "sub", "left_semi").select("sub", "ids", "sizes", "tokens")
    alone = wanted.join(packed.select("sub"), "sub", "left_anti").withColumnRenamed("sub", "id")
    singles = written(_sets(docs, alone, n).join(alone, "id", "left_semi"), "jaccard-sets")
    subgroups = singles.select(F.col("id").alias("sub"), F.array("id").alias("ids"), F.array((F.octet_length("tokens") / 8).cast("int")).alias("sizes"), "tokens").unionByName(known)
    side = lambda k, s: subgroups.select(F.col("sub").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "sizes", "tokens")])
    opened = pairs.join(side("g", "a"), "g").join(side("h", "b"), "h")
    columns = [f"{c}_{s}" for s in "ab" for c in ("ids", "sizes", "tokens")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = []
                for ids_a, sizes_a, a, ids_b, sizes_b, b in zip(*(batch[c].slice(at, 64).to_pylist() for c in columns)):
                    found += spanning_links(ids_a, sizes_a, np.frombuffer(a, np.uint64), ids_b, sizes_b, np.frombuffer(b, np.uint64), percent)
                yield _as_links(found)

    links = written(opened.select(*columns).mapInArrow(tidy(run), _LINKS), "jaccard-links")
    discard(wanted, singles)
    return links


def _wide(heads: DataFrame) -> np.ndarray:
    """Keys (the upper 32 bits) of the tokens that more than WIDE documents have among `low`. Tasks add up the keys they have gathered and deal them out, packed, by slices of the range."""
    n = slices(heads.sparkSession)
    shift = np.uint32(32 - (n.bit_length() - 1))

    def dealt(held):
        keys, sums = np.unique(np.concatenate(held), return_counts=True)
        which, starts = np.unique(keys >> shift, return_index=True)
        ends = [*starts[1:], len(keys)]
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), *(pa.array([x[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()) for x in (keys, sums.astype(np.uint32)))], ["slice", "keys", "sums"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch["low"].flatten().to_numpy().view(np.uint64) >> _KEY_SHIFT).astype(np.uint32))
            size += len(held[-1])
            if size >= HELD_KEYS:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def count(batches):
        for parts in slice_groups(batches, ["keys", "sums"]):
            keys, sums = (np.frombuffer(b"".join(x), np.uint32) for x in parts)
            order = np.argsort(keys, kind="stable")
            keys, sums = keys[order], np.concatenate([[0], np.cumsum(sums[order], dtype=np.int64)])
            starts, ends = runs(keys)
            total = sums[ends + 1] - sums[starts]
            keep = total > WIDE
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts][keep].astype(np.int64)), pa.array(total[keep])], ["key", "n"])

    packed = heads.where(F.col("low").isNotNull()).select("low").mapInArrow(tidy(pack), "slice long, keys binary, sums binary")
    counts = written(by_slice(packed).mapInArrow(tidy(count), "key long, n long"), "jaccard-wide")  # written, so that the shuffle files go
    keys = np.sort(counts.orderBy(F.desc("n"), "key").limit(WIDE_LIMIT).toPandas()["key"].to_numpy(np.int64).astype(np.uint32))
    discard(counts)
    return keys


def _split_prefix(tokens: np.ndarray, size: int, percent: int, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The prefix of a set of `size` tokens, of which `tokens` are the lowest: the part that counts for the smaller of a pair, and the rest. None if more tokens are needed."""
    probe, index = prefix_sizes(size, percent)
    last = _is_wide(tokens, wide)
    if len(tokens) < size and len(tokens) - last.sum() < probe:
        return None
    tokens = np.concatenate([tokens[~last], tokens[last]])[:probe]
    return tokens[:index].view(np.int64), tokens[index:].view(np.int64)


class _Prefixes:
    """Prefixes of sets in the order that puts the wide tokens (broadcast) last."""

    def __init__(self, docs: DataFrame, heads: DataFrame, n: int, percent: int):
        self.docs, self.heads, self.n, self.percent = docs, heads.where(F.col("low").isNotNull()), n, percent
        share = docs.sparkSession.sparkContext.broadcast
        known = _wide(self.heads)
        reach = written(self._from_low(self.heads, share(known)).where(F.col("index").isNull()).select("id").distinct(), "jaccard-reach")
        more = _wide(self._from_text(reach, None).select("low")) if not reach.isEmpty() else known[:0]
        discard(reach)
        self.wide = share(np.union1d(known, more))

    _schema = "id long, n_shingles long, index array<long>, rest array<long>"

    @staticmethod
    def _out(ids, sizes, found):
        lists = [pa.array([f and f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], ["id", "n_shingles", "index", "rest"])

    def _from_low(self, rows, wide, sieve=None):
        percent, out = self.percent, self._out

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    part = passing(part, sieve.value) if sieve else part
                    low, sizes = part["low"], part["n_shingles"].to_pylist()
                    flat, ends = low.flatten().to_numpy().view(np.uint64), np.cumsum([0, *pc.list_value_length(low).to_pylist()])
                    yield out(part["id"], sizes, [_split_prefix(flat[i:j], size, percent, wide.value) for i, j, size in zip(ends[:-1], ends[1:], sizes)])

        return rows.select("id", "n_shingles", "low", *(["slot"] if sieve else [])).mapInArrow(tidy(run), self._schema)

    def _from_text(self, ids, wide):
        percent, n, out = self.percent, self.n, self._out
        rows, sieve = sieved(self.docs, ids)

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = passing(batch.slice(at, 500), sieve.value)
                    sets = token_sets(part["text"], n)
                    if wide is None:  # whole sets, to be counted
                        yield pa.RecordBatch.from_arrays([part["id"], pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["id", "low"])
                    else:
                        yield out(part["id"], [len(x) for x in sets], [_split_prefix(x, len(x), percent, wide.value) for x in sets])

        return rows.mapInArrow(tidy(run), "id long, low array<long>" if wide is None else self._schema).join(ids, "id", "left_semi")

    def of(self, ids: DataFrame) -> list[DataFrame]:
        """Two tables id, n_shingles, index, rest of ids and a few more: from the low tokens (index is null where those don't suffice), and from the whole text for those.

        The ids pass a sieve, so the tokens needn't be shuffled for a join.
        """
        rows, sieve = sieved(self.heads, ids)
        first = written(self._from_low(rows, self.wide, sieve), "jaccard-prefixes")
        short = written(first.where(F.col("index").isNull()).select("id").distinct(), "jaccard-reach")
        further = written(self._from_text(short, self.wide), "jaccard-prefixes")
        discard(short)
        return [first, further]


def _met(prefixes: DataFrame) -> DataFrame:
    """token, sub, small of the prefix tokens that at least two subgroups have. small: the token counts where a document of the subgroup is the smaller of a pair.

    Tasks deal out packed columns by slices of the token range; a slice is sorted and its single tokens go. Wide tokens come last in the order, so
    a token is in few prefixes, and near copies by the thousand are few subgroups.
    """
    bits = slices(prefixes.sparkSession).bit_length() - 1

    def pack(batches):
        for batch in batches:
            ids = batch["sub"].to_numpy()
            tokens, owners, smalls = [], [], []
            for name, small in (("index", True), ("rest", False)):
                tokens.append(batch[name].flatten().to_numpy().view(np.uint64))
                owners.append(np.repeat(ids, pc.list_value_length(batch[name]).to_numpy()))
                smalls.append(np.full(len(tokens[-1]), small))
            tokens, owners, smalls = np.concatenate(tokens), np.concatenate(owners), np.concatenate(smalls)
            order = np.argsort(tokens)
            tokens, owners, smalls = tokens[order], owners[order], smalls[order]
            which, starts = np.unique(tokens >> np.uint64(64 - bits), return_index=True)
            ends = [*starts[1:], len(tokens)]
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), *(pa.array([x[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()) for x in (tokens, owners, smalls))], ["slice", "tokens", "owners", "smalls"])

    def meet(batches):
        for parts in slice_groups(batches, ["tokens", "owners", "smalls"]):
            tokens, owners, smalls = (np.frombuffer(b"".join(x), t) for x, t in zip(parts, (np.uint64, np.int64, bool)))
            order = np.lexsort((owners, tokens))
            tokens, owners, smalls = tokens[order], owners[order], smalls[order]
            # A subgroup's token counts once, however many rows tell it.
            new = np.flatnonzero(np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])])) if len(tokens) else np.empty(0, np.int64)
            tokens, owners, smalls = tokens[new], owners[new], np.logical_or.reduceat(smalls, new) if len(new) else smalls
            starts, ends = runs(tokens)
            keep = np.repeat(owners[starts] != owners[ends], ends - starts + 1)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(owners[keep]), pa.array(smalls[keep])], ["token", "sub", "small"])

    packed = prefixes.select("sub", "index", "rest").mapInArrow(tidy(pack), "slice long, tokens binary, owners binary, smalls binary")
    return by_slice(packed).mapInArrow(tidy(meet), "token long, sub long, small boolean")


def _candidates(met: DataFrame, subgroups: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, h) of subgroups (sub, grp, low, high, k, component) whose unions of prefixes share enough tokens for a link, and whose sizes allow one.

    A mixed subgroup has no component. Subgroups of one component and of one group stay closed. Under each token the component with most subgroups doesn't meet itself: only the others meet all.
    """
    matrix = written(met.join(subgroups, "sub"), "jaccard-matrix")
    counts = matrix.groupBy("token", "component").agg(F.count("*").alias("n"))
    known = F.when(F.col("component").isNotNull(), F.struct("n", "component"))
    most = counts.groupBy("token").agg(F.sum("n").alias("all_n"), F.max(known).alias("most")).where("all_n > coalesce(most.n, 0) AND all_n > 1").select("token", F.col("most.component").alias("most"))
    other = F.col("most").isNull() | F.col("component").isNull() | (F.col("component") != F.col("most"))
    meeting = written(matrix.join(most, "token").withColumn("other", other).drop("most"), "jaccard-meeting")
    side = lambda s: meeting.select("token", *[F.col(c).alias(f"{c}_{s}") for c in meeting.columns if c != "token"])
    differ = lambda c: F.col(f"{c}_a").isNull() | F.col(f"{c}_b").isNull() | (F.col(f"{c}_a") != F.col(f"{c}_b"))
    fits = differ("component") & differ("grp") & (~F.col("other_b") | (F.col("sub_a") < F.col("sub_b"))) & (F.col("small_a") | F.col("small_b"))
    fits &= (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
    left, right = side("a").where("other_a"), side("b")
    meetings = left.join(right, (left["token"] == right["token"]) & fits).groupBy(F.least("sub_a", "sub_b").alias("g"), F.greatest("sub_a", "sub_b").alias("h")).agg(F.count("*").alias("common"), F.min(F.least("k_a", "k_b")).alias("k"))
    pairs = written(meetings.where(F.col("common") >= F.col("k")).select("g", "h"), "jaccard-pairs")
    discard(matrix, meeting)
    return pairs


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable over links, itself included).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct n-word shingles. Words are runs of
    characters other than ASCII white space, A-Z lower-cased; a text of fewer than n words has one shingle, the whole sequence. Null and empty texts have an empty set and
    link with nothing. Shingles are compared by 64-bit hashes. Rows with a null id have a null component_id and link with nothing; rows that share an id are one node.
    An empty table gives an empty result; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    if not isinstance(id_type, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    heads = written(_heads(docs, n, percent), "jaccard-heads")
    known = heads.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    classes = known.groupBy("sig").agg(F.min("id").alias("rep"))
    same = written(known.select("id", "sig").join(classes, "sig").select("id", "rep").distinct(), "jaccard-classes")
    reps = same.where(F.col("id") == F.col("rep")).select("id")

    prefixes = _Prefixes(docs, known, n, percent)
    groups = _groups(known, reps)
    seats = groups.select("id", "grp", F.lit(False).alias("guest")).union(groups.where("leader IS NOT NULL").select("leader", "grp", F.lit(True)).distinct())
    seats = seats.groupBy("id", "grp").agg(F.min("guest").alias("guest"))
    packed = written(_packed_groups(_texts_or_sets(docs, groups.select("id").union(groups.select("leader").dropna()).distinct(), n).join(seats, "id"), n, percent, prefixes.wide), "jaccard-packed")
    within = packed.select(F.explode(F.arrays_zip("a", "b")).alias("link")).select("link.a", "link.b")
    labels = components(within)
    alone = written(reps.join(groups.select("id"), "id", "left_anti"), "jaccard-alone")
    found = prefixes.of(alone)
    sized = written(heads.select("id", "n_shingles"), "jaccard-sizes")
    k = F.least(F.ceil(F.col("n_shingles") * percent / 100), F.floor(F.col("n_shingles") * EXTRA / 100) + MORE).cast("int")
    size = F.col("n_shingles").cast("int")
    single = known.where(F.col("low").isNotNull()).join(alone, "id", "left_semi").select(F.col("id").alias("sub"), F.lit(None).cast("long").alias("grp"), F.lit(False).alias("mixed"), size.alias("low"), size.alias("high"), k.alias("k"))
    subgroups = written(packed.select("sub", "grp", "mixed", "low", "high", "k").unionByName(single), "jaccard-subgroups")
    discard(heads, alone)
    rows = packed.select("sub", "index", "rest")
    for part in found:
        rows = rows.unionByName(part.where(F.col("index").isNotNull()).select(F.col("id").alias("sub"), "index", "rest"))
    labelled = subgroups.join(labels.withColumnRenamed("node", "sub"), "sub", "left").withColumn("component", F.when(~F.col("mixed"), F.coalesce("component", "sub"))).drop("mixed")
    pairs = _candidates(_met(rows), labelled, percent)
    discard(subgroups, *found)
    links = _links_between(docs, pairs, packed, n, percent)
    discard(pairs, packed, groups)

    # An id with several texts is one node, so it ties its classes together.
    least = same.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where(F.col("a") < F.col("b")).select("id", "a")
    tied = same.join(least, "id").select("a", F.col("rep").alias("b"))
    joined = components(links.unionByName(tied).unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = same.join(joined.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return sized.join(named, "id", "left").select(F.col("id").cast(id_type).alias(id_col), "n_shingles", F.coalesce("component", "id").cast(id_type).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component of texts: that of the smallest id (nulls last), then of the smallest hash of the text.

    Rows are judged by their texts: rows that share an id but not a component each stay, and rows with a null id are judged too. Of rows that repeat id and text, one stays.
    Texts without words link with nothing, so all such rows stay.
    """
    key = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    found = written(jaccard_components(rows.select("key", "text"), "key", "text", n, percent).where("n_shingles > 0").select("key", "component_id").distinct(), "jaccard-texts")
    judged = written(rows.select("id", "key").join(found, "key"), "jaccard-judged")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    firsts = judged.groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("component_id", "first.id", "first.key")
    # A component's first row, in the shape of its other rows: each row is held against it.
    gone = judged.join(firsts.withColumnsRenamed({"id": "first_id", "key": "first_key"}), "component_id").where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))))
    gone = written(gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "jaccard-gone")
    left = docs.join(gone, F.col(id_col).eqNullSafe(gone["gone_id"]) & (key == gone["gone_key"]), "left_anti")
    twice = judged.join(firsts, [judged["component_id"] == firsts["component_id"], judged["id"].eqNullSafe(firsts["id"]), judged["key"] == firsts["key"]], "left_semi").groupBy("id", "key").count().where("count > 1").select(F.col("id").alias("twice_id"), F.col("key").alias("twice_key"))
    twice = written(twice, "jaccard-twice")
    if twice.isEmpty():
        return left
    same = F.col(id_col).eqNullSafe(twice["twice_id"]) & (key == twice["twice_key"])
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
