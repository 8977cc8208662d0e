"""Near-duplicate passages across documents (substring deduplication) with compact windows.

The tokens of a text are its 5-word shingles, and each of HASHES random hashes orders them. In the Cartesian tree over a hash, the subtree of token c spans the
tokens around c that have no smaller hash: a compact window (l, c, r), which says that c has the least hash in every subsequence that begins in [l, c] and ends in [c, r].
Only windows wide enough for a passage matter, so subtrees are followed that far. Of each window the interval of places is kept where a passage of the
least length can begin: for one hash these intervals are disjoint, and passages that are alike lie, for most hashes, in windows of one least hash.
Windows whose hash no other document has are dropped; the rest is joined by interval within each document: where the intervals of two hashes overlap there is
a joint signature, and documents with one joint signature (two agreeing hashes) are candidates. The candidate pairs
(document, smallest id of the signature) are verified on the words. Places of a document where that verified nothing are keyed anew by whole passages, which exact repeats always
share, and by finer signatures, and compared with the smallest id that has the key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, mixed, shingles, tidy, written
from .meeting import bitmap, first_ids
from .sieve import passing, sieved

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 4
#: Shingles between two shared ones that a passage may bridge: three changed words.
GAP = 15
#: Keys of three further hashes for places that a first pair left unverified: at similarity 0.8 at least one agrees with a chance of 1 - (1 - 0.8^3)^6 = 0.986.
FINER = 6
#: Pairs of one first document that meet in one task, about; more are dealt out with copies of its words.
PAIRS_A_TASK = 2_000
#: Words of a chunk of texts that are worked on at once.
CHUNK_WORDS = 200_000


def tree_spans(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the Cartesian tree's nodes whose subtrees span at least `width` tokens; l and r are followed up to width - 1 tokens from c.

    A hash of 0 ends a text: no span crosses it. Of equal hashes the first is the root.
    """
    reach = width - 1
    size = reach.bit_length()
    h = np.concatenate([np.zeros(1 << size, np.uint64), hashes, np.zeros(1 << size, np.uint64)])
    least = [h]  # least[k][i]: of the 2**k tokens from i
    for k in range(size):
        least.append(np.minimum(least[-1][: -(1 << k)], least[-1][1 << k :]))
    at = np.arange(1 << size, (1 << size) + len(hashes))
    # A node of that span has no smaller hash in half of it on one side at least.
    half = max(k for k in range(size + 1) if 2 << k <= width)
    near = 1 << half
    at = at[(hashes > 0) & ((least[half][at - near] > hashes) | (least[half][at + 1] >= hashes))]
    mine, left, right = h[at], at.copy(), at + 1
    for k in range(size - 1, -1, -1):
        further = least[k][left - (1 << k)] > mine
        left -= further.astype(np.int64) << k
        further = least[k][right] >= mine
        right += further.astype(np.int64) << k
    left, right = np.maximum(left, at - reach), np.minimum(right - 1, at + reach)
    wide = right - left >= reach
    return at[wide] - (1 << size), left[wide] - (1 << size), right[wide] - (1 << size)


def compact_windows(hashes: np.ndarray, width: int, good: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, p, q): subsequences of `width` tokens that begin at p to q have their least hash at c. Neighbouring intervals of equal hashes, as in repeated text, are one.

    Tokens that aren't good end a text: no subsequence holds one.
    """
    c, l, r = tree_spans(np.where(good, np.minimum(hashes, np.uint64(2**64 - 2)) + np.uint64(1), np.uint64(0)), width)
    p, q = l, np.minimum(c, r - width + 1)
    if len(c):
        starts = np.flatnonzero(np.concatenate([[True], (hashes[c[1:]] != hashes[c[:-1]]) | (p[1:] != q[:-1] + 1)]))
        c, p, q = c[starts], p[starts], q[np.append(starts[1:], len(q)) - 1]
    return c, p, q


def joint_signatures(keys: np.ndarray, ps: np.ndarray, qs: np.ndarray, fns: np.ndarray) -> np.ndarray:
    """Signatures of the pairs of windows of different hashes whose intervals overlap."""
    return np.unique(joint_places(keys, ps, qs, fns)[0])


def joint_places(keys: np.ndarray, ps: np.ndarray, qs: np.ndarray, fns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joint signatures of windows of different hashes whose intervals overlap, and the first and last place of the overlap: an interval join of disjoint intervals for each two hashes."""
    by_fn, found, low, high = [], [], [], []
    for fn in range(HASHES):
        mine = np.flatnonzero(fns == fn)
        by_fn.append(mine[np.argsort(ps[mine], kind="stable")])
    for i in range(HASHES):
        for j in range(i + 1, HASHES):
            x, y = by_fn[i], by_fn[j]
            begin = np.searchsorted(qs[y], ps[x], side="left")
            n = np.maximum(np.searchsorted(ps[y], qs[x], side="right") - begin, 0)
            a = np.repeat(x, n)
            b = y[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
            found.append(mixed(keys[a]) + keys[b])
            low.append(np.maximum(ps[a], ps[b]))
            high.append(np.minimum(qs[a], qs[b]))
    return np.concatenate(found), np.concatenate(low), np.concatenate(high)


def _chunks(lengths: list[int], most: int = CHUNK_WORDS):
    """Slices of rows with about `most` words each."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(lengths):
        yield begin, len(lengths)


def _joined_tokens(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of all texts in one row, whether one begins at a place (not in the last words of a text), and where each text begins (and the end)."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = np.concatenate([*texts, np.zeros(SHINGLE - 1, np.uint64)])
    tokens = shingles(words, SHINGLE)[: starts[-1]]
    good = np.ones(starts[-1], bool)
    for k in range(1, SHINGLE):
        ends = starts[1:] - k
        good[ends[ends >= 0]] = False
    return tokens, good, starts


def _key(hashes: np.ndarray, fn: int) -> np.ndarray:
    """The hash with its lowest two bits saying which hash it is."""
    return hashes & ~np.uint64(3) | np.uint64(fn)


_WINDOWS = "id long, keys binary, places binary"


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per document: id, keys (64 bits each; the lowest two tell the hash) and places (first and last, 32 bits each) of its windows, packed."""
    width = min_words - SHINGLE + 1

    def of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, good, starts = _joined_tokens(texts)
        owners, keys, places = [], [], []
        for fn in range(HASHES):
            h = mixed(tokens, fn + 1)
            c, p, q = compact_windows(h, width, good)
            owner = np.searchsorted(starts, c, side="right") - 1
            owners.append(owner)
            keys.append(_key(h[c], fn))
            places.append(np.column_stack([p - starts[owner], q - starts[owner]]).astype(np.uint32))
        owners, keys, places = np.concatenate(owners), np.concatenate(keys), np.concatenate(places)
        order = np.argsort(owners, kind="stable")
        return np.searchsorted(owners[order], np.arange(len(texts) + 1)), keys[order], places[order]

    def run(batches):
        words = Words()
        for batch in batches:
            texts, ids = batch["text"], batch["id"].to_numpy(zero_copy_only=False)
            for i in range(0, batch.num_rows, 500):
                hashed = [(k, h) for k, h in zip(ids[i : i + 500], words.many(texts.slice(i, 500))) if len(h) >= min_words]
                for a, b in _chunks([len(h) for _, h in hashed]):
                    cuts, keys, places = of([h for _, h in hashed[a:b]])
                    lists = [[x[m:n].tobytes() for m, n in zip(cuts[:-1], cuts[1:])] for x in (keys, places)]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hashed[a:b]], pa.int64()), *(pa.array(x, pa.binary()) for x in lists)], ["id", "keys", "places"])

    return docs.mapInArrow(tidy(run), _WINDOWS)


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(x) for x in rows], np.int64) // np.dtype(kind).itemsize


def _window_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys, n = _flat(batch["keys"], np.uint64)
    return keys, np.repeat(batch["id"].to_numpy(), n)


def _signatures(windows: DataFrame, shared) -> DataFrame:
    """id, signature, place (first << 32 | last) of documents, from those of their windows whose keys pass the bitmap of shared ones."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, n = _flat(part["keys"], np.uint64)
                places = _flat(part["places"], np.uint32)[0].reshape(-1, 2)
                owner = np.repeat(np.arange(part.num_rows), n)
                keep = np.flatnonzero(shared.value.passes(keys))
                # Documents stand one after another on one line, so one interval join serves them all.
                base = owner[keep].astype(np.int64) << 32
                signatures, low, high = joint_places(keys[keep], base + places[keep, 0], base + places[keep, 1], keys[keep] & np.uint64(3))
                ids = part["id"].to_numpy()[low >> 32]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(signatures.view(np.int64)), pa.array((low & 0xFFFFFFFF) << 32 | high & 0xFFFFFFFF)], ["id", "signature", "place"])

    return windows.mapInArrow(tidy(run), "id long, signature long, place long")


def _in_step(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """For how many places a from i and b from j are equal."""
    n, step, most = 0, 64, min(len(a) - i, len(b) - j)
    while n < most:
        m = min(step, most - n)
        differ = np.flatnonzero(a[i + n : i + n + m] != b[j + n : j + n + m])
        if len(differ):
            return n + int(differ[0])
        n, step = n + m, step * 2
    return n


def whole_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash for each place where `width` tokens begin, of all of them in their order."""
    out, size = tokens, 1
    while size < width:
        step = min(size, width - size)
        out, size = mixed(out[: len(out) - step]) + out[step:] if len(out) > step else out[:0], size + step
    return mixed(out, 100)


class Places:
    """Where runs of a text's shingles are in another text b: all places count, the best of them is told."""

    def __init__(self, b: np.ndarray):
        self.b = b
        self.order = np.argsort(b, kind="stable")
        self.sorted = b[self.order]
        self.twice = len(b) > 1 and bool((self.sorted[1:] == self.sorted[:-1]).any())

    def first(self, a: np.ndarray) -> np.ndarray:
        """The first place of each of a, or -1."""
        if not len(self.b):
            return np.full(len(a), -1)
        at = np.minimum(np.searchsorted(self.sorted, a), len(self.b) - 1)
        return np.where(self.sorted[at] == a, self.order[at], -1)

    def after(self, token, place: int) -> int:
        """The first place of a token from `place` on, or -1."""
        low, high = np.searchsorted(self.sorted, token, "left"), np.searchsorted(self.sorted, token, "right")
        k = low + np.searchsorted(self.order[low:high], place)
        return int(self.order[k]) if k < high else -1

    def longest(self, a: np.ndarray) -> np.ndarray:
        """For each place of a: where in b a run of as many shingles (a power of two up to 32) as possible begins that begins here, or -1."""
        where = self.first(a)
        x, y, size = a, self.b, 1
        while size < 32 and len(x) > size and len(y) > size:
            x, y, size = mixed(x[: len(x) - size]) + x[size:], mixed(y[: len(y) - size]) + y[size:], size * 2
            longer = Places(y).first(x)
            where[: len(x)] = np.where(longer >= 0, longer, where[: len(x)])
        return where


def similar_passages(left: np.ndarray, right: np.ndarray, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Passages of left's words that right has: (start, end, start in right, end in right, Jaccard similarity), ends exclusive, in words.

    Runs of shared shingles are bridged over GAP shingles; of a bridged run that isn't similar enough as a whole (or repeats itself) the similar stretches are found, and
    every run of min_words words that right has anywhere, exactly.
    """
    if len(left) < min_words or len(right) < min_words:
        return []
    a, b = (shingles(x.astype(np.uint64), SHINGLE) for x in (left, right))
    return _found(a, b, Places(b), min_words - SHINGLE + 1, similarity)[0]


def pair_passages(left: np.ndarray, right: np.ndarray, min_words: int, similarity: float) -> tuple[list[tuple], list[tuple]]:
    """similar_passages() in both directions. Where no shingle stands twice in either text there is one way to align them, and one direction gives the other."""
    if len(left) < min_words or len(right) < min_words:
        return [], []
    a, b = (shingles(x.astype(np.uint64), SHINGLE) for x in (left, right))
    return _both_ways(a, Places(a), b, Places(b), min_words - SHINGLE + 1, similarity)


def _both_ways(a: np.ndarray, of_a: Places, b: np.ndarray, of_b: Places, width: int, similarity: float) -> tuple[list[tuple], list[tuple]]:
    """pair_passages() of shingles whose places are known."""
    once = not (of_a.twice or of_b.twice)
    found, mirrored = _found(a, b, of_b, width, similarity, once)
    if mirrored and once:
        return found, [(s2, e2, s, e, score) for s, e, s2, e2, score in found]
    return found, _found(b, a, of_a, width, similarity, once)[0]


def _found(a: np.ndarray, b: np.ndarray, places: Places, width: int, similarity: float, once: bool = False) -> tuple[list[tuple[int, int, int, int, float]], bool]:
    """The passages of similar_passages(), and whether they hold all places of b too. once: no shingle stands twice in a or in b, so sets needn't be made to count them."""
    where = places.first(a)
    hit = np.flatnonzero(where >= 0)
    found, mirrored = [], not places.twice
    if not len(hit):
        return found, mirrored
    cuts = np.flatnonzero(np.diff(hit) > GAP) + 1
    for first, last in zip([0, *cuts], [*cuts, len(hit)]):
        run = hit[first:last]
        start, end = int(run[0]), int(run[-1]) + 1
        if end - start < width:
            continue  # too short, and so are its parts
        block = np.sort(where[run])
        parted = np.flatnonzero(np.diff(block) > GAP) + 1
        if len(parted):
            block = max(np.split(block, parted), key=len)
        if once:  # of the run's places in b, those in the block are shared: block has no others
            shared, either = len(block), end - start + int(block[-1] - block[0]) + 1
        else:
            x, y = np.unique(a[start:end]), np.unique(b[block[0] : block[-1] + 1])
            shared, either = len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)
        score = shared / (either - shared)
        if score >= similarity:
            found.append((start, end + SHINGLE - 1, int(block[0]), int(block[-1]) + SHINGLE, float(score)))
            mirrored &= not len(parted)
            continue
        if places.twice:
            parts, exact = _in_step_parts(a[:end], run, places), _exact_parts(a, start, end, b, width)
        else:  # each shingle of b has one place, so there is one way to align it
            edges = np.flatnonzero((np.diff(run) > 1) | (np.diff(where[run]) != 1)) + 1
            firsts, lasts = run[[0, *edges]], run[np.append(edges, len(run)) - 1]
            parts = list(zip(firsts.tolist(), where[firsts].tolist(), (lasts - firsts + 1).tolist()))
            exact = [(s, s + n, t, t + n, 1.0) for s, t, n in parts if n >= width]
        similar = _similar_parts(a, b, parts, width, similarity)
        exact = [x for x in exact if not any(s <= x[0] and x[1] <= e for s, e, *_ in similar)]
        found += [(s, e + SHINGLE - 1, s2, e2 + SHINGLE - 1, score) for s, e, s2, e2, score in [*similar, *exact]]
    return found, mirrored


def _in_step_parts(a: np.ndarray, run: np.ndarray, places: Places) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length): a run of shared shingles, cut where the texts stop running in step.

    Each part goes on, within GAP, where the one before it ended in b, or else begins where b has the longest run from here.
    """
    begin, b = int(run[0]), places.b
    best = places.longest(a[begin:])  # a ends with the run
    parts, until = [], -1
    for i in run.tolist():
        if i < until:
            continue
        place = -1
        if parts:
            s, t, n = parts[-1]
            if t + i - s < len(b) and b[t + i - s] == a[i]:
                place = t + i - s
            elif 0 <= (next_one := places.after(a[i], t + n)) <= t + n + GAP:
                place = next_one
        if place < 0:
            place = int(best[i - begin])
        n = _in_step(a, i, b, place)
        parts.append((i, place, n))
        until = i + n
    return parts


def _exact_parts(a: np.ndarray, start: int, end: int, b: np.ndarray, width: int) -> list[tuple[int, int, int, int, float]]:
    """Stretches of a[start:end] that cover every run of `width` shingles that b has too, wherever it has them."""
    mine = whole_hashes(a[start:end], width)
    where = Places(whole_hashes(b, width)).first(mine)
    found, at = [], 0
    for i in np.flatnonzero(where >= 0).tolist():
        if i < at:
            continue
        n = _in_step(a[:end], start + i, b, int(where[i]))
        if n >= width:
            found.append((start + i, start + i + n, int(where[i]), int(where[i]) + n, 1.0))
        at = i + max(n - width, 0) + 1
    return found


def _similar_parts(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int]], width: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Of parts in step (start in a, start in b, length): the stretches of at least `width` shingles, from a shared one to a shared one, that are similar, as few as cover all of them.

    Parts are aligned while both texts go on by GAP shingles at most. A stretch of m shared shingles, la and lb long, is similar if (1 + similarity) m >= similarity (la + lb): a value for
    its end less one for its start, so the farthest end of every start is found by a binary search.
    """
    found, chain = [], []
    for part in [*parts, None]:
        if chain and (part is None or not (0 <= part[0] - chain[-1][0] - chain[-1][2] <= GAP and 0 <= part[1] - chain[-1][1] - chain[-1][2] <= GAP)):
            x, y = (np.concatenate([np.arange(p[side], p[side] + p[2]) for p in chain]) for side in (0, 1))
            k = np.arange(len(x))
            begin, end = (1 + similarity) * k - similarity * (x + y), (1 + similarity) * (k + 1) - similarity * (x + y + 2)
            best = np.maximum.accumulate(end[::-1])  # of the ends from the last back to each
            last = len(x) - 1 - np.searchsorted(best, begin - 1e-9)
            good = np.flatnonzero((last >= k) & (x[np.minimum(last, len(x) - 1)] + 1 - x >= width))
            covered, at = -1, 0
            while (more := np.flatnonzero(last[good[at:]] > covered)).size:
                first = at + int(more[0])
                stop = max(int(np.searchsorted(good, covered, side="right")), first + 1)
                pick = first + int(np.argmax(last[good[first:stop]]))
                i, j = int(good[pick]), int(last[good[pick]])
                u, v = np.unique(a[x[i] : x[j] + 1]), np.unique(b[y[i] : y[j] + 1])
                shared = len(np.intersect1d(u, v, assume_unique=True))
                score = shared / (len(u) + len(v) - shared)
                if score >= similarity:
                    found.append((int(x[i]), int(x[j]) + 1, int(y[i]), int(y[j]) + 1, float(score)))
                covered, at = j, pick + 1
            chain = []
        if part is not None:
            chain.append(part)
    return found


def _packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, words of the documents of ids, and few others."""
    rows, sieve = sieved(docs, ids)

    def pack(batches):
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = passing(batch.slice(at, 500), sieve.value)
                # 32 bits a word: a shingle of five compares 160.
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([h.astype(np.uint32).tobytes() for h in words.many(part["text"])], pa.binary())], ["id", "words"])

    return rows.mapInArrow(tidy(pack), "id long, words binary")


def _uncovered(places: np.ndarray, passages: list[tuple], min_words: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Stretches of starting places (first, last) that lie in places (first << 32 | last) and where no passage holds min_words words, and which of the places have no other."""
    low, high = places >> 32, places & 0xFFFFFFFF
    size = int(high.max()) + 2
    held = np.zeros(size + 1, np.int64)
    np.add.at(held, low, 1)
    np.add.at(held, high + 1, -1)
    over = np.zeros(size + 1, np.int64)
    for s, e, *_ in passages:
        if s < size:
            over[s] += 1
            over[min(e - min_words + 1, size)] -= 1
    covered = np.cumsum(over)[:size] > 0
    n_covered = np.concatenate([[0], np.cumsum(covered)])
    none = n_covered[high + 1] == n_covered[low]
    edge = np.diff(np.concatenate([[0], ((np.cumsum(held)[:size] > 0) & ~covered).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())), none


_PASSAGES = "id long, start_word long, end_word long, other_id long, other_start long, other_end long, jaccard double, place long, whole boolean"


def _dealt(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the words x of a and y of b. The pairs of one a are dealt out, about PAIRS_A_TASK together, with copies of its words."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).alias("parts")).where("parts > 1")
    salted = pairs.join(parts, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).drop("parts")
    firsts = packed.select(F.col("id").alias("a"), F.col("words").alias("x")).join(parts, "a", "left")
    firsts = firsts.select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(packed.select(F.col("id").alias("b"), F.col("words").alias("y")), "b").join(firsts, ["a", "salt"])


def _verified(packed: DataFrame, pairs: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """The passages of pairs (a, b, places in b), and rows (id is b) for the stretches of those places that no passage of b with a covers: place (first << 32 | last).

    whole tells stretches that are places of which nothing is covered.
    """

    width = min_words - SHINGLE + 1

    def compare(batches):
        last = None  # pairs of one a follow each other
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                part = batch.slice(at, 64)
                for a, b, x, y, places in zip(*(part[c].to_pylist() for c in ("a", "b", "x", "y", "places"))):
                    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                    if len(x) < min_words or len(y) < min_words:
                        theirs, mine = [], []
                    else:
                        if last is None or last[0] != a or len(last[3]) != len(x) or (last[3] != x).any():
                            s = shingles(x.astype(np.uint64), SHINGLE)
                            last = a, s, Places(s), x
                        s = shingles(y.astype(np.uint64), SHINGLE)
                        theirs, mine = _both_ways(last[1], last[2], s, Places(s), width, similarity)
                    out += [(a, s, e, b, s2, e2, score, None, None) for s, e, s2, e2, score in theirs]
                    out += [(b, s, e, a, s2, e2, score, None, None) for s, e, s2, e2, score in mine]
                    if places:
                        places = np.array(places, np.int64)
                        open_ones, none = _uncovered(places, mine, min_words)
                        out += [(b, None, None, a, None, None, None, i << 32 | j, False) for i, j in open_ones]
                        out += [(b, None, None, a, None, None, None, place, True) for place in places[none].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 9, types)], names)

    names = ["id", "start_word", "end_word", "other_id", "other_start", "other_end", "jaccard", "place", "whole"]
    types = [pa.int64()] * 6 + [pa.float64(), pa.int64(), pa.bool_()]
    return _dealt(pairs, packed).select("a", "b", "x", "y", "places").mapInArrow(tidy(compare), _PASSAGES)


def _finer_keys(words: list[np.ndarray], min_words: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For all starting places of texts, one after another: a key of the whole passage, FINER keys of three further hashes each, and whether a passage begins there."""
    width = min_words - SHINGLE + 1
    tokens, good, _ = _joined_tokens(words)
    begins = np.zeros(len(good), bool)
    sums = np.concatenate([[0], np.cumsum(good)])
    if len(good) >= width:
        begins[: len(good) - width + 1] = sums[width:] - sums[:-width] == width

    def padded(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.zeros(len(good) - len(x), np.uint64)])

    def least(seed: int) -> np.ndarray:
        out, size = mixed(tokens[: len(good)], seed), 1
        while size < width and len(out):
            step = min(size, width - size)
            out, size = np.minimum(out[: max(len(out) - step, 0)], out[step:]), size + step
        return padded(out)

    near = [mixed(mixed(mixed(least(110 + 3 * t), t) + least(111 + 3 * t)) + least(112 + 3 * t)) for t in range(FINER)]
    return padded(whole_hashes(tokens[: len(good)], width)), near, begins


def _keys_of_open(packed: DataFrame, left: DataFrame, min_words: int) -> DataFrame:
    """id, key of the places of left (id, place, whole): a key of each whole passage and, where nothing of a place was verified, the finer ones."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                words = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in part["words"].to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                whole, near, begins = _finer_keys(words, min_words)
                marks = []
                for column in ("open", "unmet"):
                    ends, spans = part[column].value_lengths().to_numpy(), part[column].flatten().to_numpy()
                    base, mark = np.repeat(starts[:-1], ends), np.zeros(starts[-1] + 1, np.int64)
                    np.add.at(mark, np.minimum(base + (spans >> 32), starts[-1]), 1)
                    np.add.at(mark, np.minimum(base + (spans & 0xFFFFFFFF) + 1, starts[-1]), -1)
                    marks.append((np.cumsum(mark)[:-1] > 0) & begins)
                owners = np.repeat(part["id"].to_numpy(), np.diff(starts))
                ids, keys = [owners[marks[0]]], [whole[marks[0]]]
                for x in near:
                    new = marks[1].copy()
                    new[1:] &= (x[1:] != x[:-1]) | ~marks[1][:-1]
                    ids.append(owners[new])
                    keys.append(x[new])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64))], ["id", "key"])

    # A document's own places: as many as its length allows.
    spans = lambda whole: F.coalesce(F.collect_set(F.when(F.col("whole") == whole, F.col("place"))), F.array().cast("array<long>"))
    gathered = left.groupBy("id").agg(spans(False).alias("open"), spans(True).alias("unmet"))
    return packed.join(gathered, "id").mapInArrow(tidy(run), "id long, key long")


def _keys_of_all(packed: DataFrame, wanted, min_words: int) -> DataFrame:
    """id, key of all places of all packed documents whose key passes the bitmap of wanted ones."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                words = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in part["words"].to_pylist()]
                whole, near, begins = _finer_keys(words, min_words)
                owners = np.repeat(part["id"].to_numpy(), [len(w) for w in words])
                ids, keys = [], []
                for x in (whole, *near):
                    new = begins.copy()
                    new[1:] &= (x[1:] != x[:-1]) | ~begins[:-1]
                    at_ = np.flatnonzero(new)
                    at_ = at_[wanted.value.passes(x[at_])]
                    ids.append(owners[at_])
                    keys.append(x[at_])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64))], ["id", "key"])

    return packed.mapInArrow(tidy(run), "id long, key long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Passages of at least min_words words that another document has too, or nearly (Jaccard of the 5-word shingles at least `similarity`).

    A row per passage: id, start_word, end_word (exclusive), other_id, other_start, other_end, jaccard. Within a class of documents that may share a passage, every document is
    paired with the class's smallest id, in both directions. Starting places of a document that this leaves without a passage are classes anew: by keys of the whole passage, among all
    places of all these documents, so every run of min_words words that another document has lies in a passage of the result (whatever other documents there are); and by keys of three further hashes (near ones,
    with a chance of 0.986 at similarity 0.8). Words are runs of characters other than ASCII white space, A-Z lower-cased. Null, empty and
    shorter texts, and rows with a null id, have no passages; rows that share an id are one document, in which repeats don't count. An empty table gives an empty result; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    if not isinstance(id_type, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    windows = written(_windows(docs, min_words), "passage-windows")
    known = written(first_ids(windows, "key", _window_keys), "passage-keys")
    signatures = written(_signatures(windows, bitmap(known, "key")), "passage-signatures")
    discard(windows, known)
    classes = written(first_ids(signatures, "signature"), "passage-classes")
    first = signatures.join(classes, "signature").where(F.col("first_id") < F.col("id")).select(F.col("first_id").alias("a"), F.col("id").alias("b"), "place")
    # A pair's places: as many as the length of b allows.
    first = written(first.groupBy("a", "b").agg(F.collect_set("place").alias("places")), "passage-pairs")
    discard(signatures, classes)
    packed = written(_packed(docs, first.select(F.col("a").alias("id")).union(first.select(F.col("b").alias("id"))).distinct()), "passage-words")
    checked = written(_verified(packed, first, min_words, similarity), "passages")
    left = checked.where(F.col("place").isNotNull()).select("id", "place", "whole")
    keys = written(_keys_of_open(packed, left, min_words), "passage-open-keys")
    others = written(_keys_of_all(packed, bitmap(keys.distinct(), "key"), min_words), "passage-finer-keys")
    finer = written(first_ids(others, "key"), "passage-finer-classes")
    # One of the two has an open place under the key.
    met = keys.join(finer, "key")
    pairs = met.select(F.col("first_id").alias("a"), F.col("id").alias("b"))
    of_first = met.where(F.col("id") == F.col("first_id")).select("key", "first_id").distinct()
    pairs = pairs.union(others.join(of_first, "key").select(F.col("first_id").alias("a"), F.col("id").alias("b"))).where("a < b").distinct()
    pairs = written(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti").withColumn("places", F.array().cast("array<long>")), "passage-finer-pairs")
    discard(keys, others, finer)
    again = written(_verified(packed, pairs, min_words, similarity), "finer-passages")
    discard(packed, first, pairs)
    found = checked.where(F.col("place").isNull()).unionByName(again)
    return found.select(F.col("id").cast(id_type).alias(id_col), "start_word", "end_word", F.col("other_id").cast(id_type).alias("other_id"), "other_start", "other_end", "jaccard")
