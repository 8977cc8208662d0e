"""Language identification with bit-sliced Bloom filters of byte n-grams.

All languages share one filter: slot i holds a bitmask (of as many 64-bit words as the languages need) with bit l set if language l's Bloom filter has slot i set. The AND of an n-gram's slots is
the mask of all languages that contain it. A text's languages are counted n-gram by n-gram, each count is corrected for the false positives that
a filter of that fill gives, and the largest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_parts, mixed, tidy

#: Labelled rows that the filters are fitted on, about: the one bounded sample.
TRAIN_ROWS = 20_000
#: A language contains an n-gram that makes up at least this share of its n-grams, so a filter holds at most 1 / MIN_SHARE of them,
MIN_SHARE = 1e-5
#: and at least this part of the share in the language where it is most frequent (else it is a foreign word).
MIN_PART = 0.125
HASHES = 3
SLOTS_PER_GRAM = 8
#: Languages in one word of the mask.
WORD_BITS = 64
#: Bytes of text that are worked on at once (an array step takes up to 8 bytes for each, and several are alive).
BLOCK = 1 << 18

#: ASCII bytes that are no letters become a space.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-grams of all texts, and for each text the index of its first one (and the end).

    Texts are lower-cased and stand between spaces; a window counts if its two middle bytes are no space.
    """
    space = pa.scalar(" ", pa.large_string())
    texts = pc.binary_join_element_wise(space, pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), space, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    cuts = offsets[1:-1]
    found, starts = [np.empty(0, np.uint32)], np.zeros(len(offsets), np.int64)
    n = 0
    for at in range(0, len(data) - 3, BLOCK):  # windows that begin in this block
        part = _FOLD[data[at : at + BLOCK + 3]]
        good = (part[1:-2] != 32) & (part[2:-1] != 32)
        for back in (1, 2, 3):  # windows that would reach into the next text
            cut = cuts[np.searchsorted(cuts, at + back) : np.searchsorted(cuts, at + len(good) + back)] - back - at
            good[cut] = False
        where = np.flatnonzero(good)
        wide = part.astype(np.uint32)
        packed = wide[where]
        for k in (1, 2, 3):
            packed |= wide[where + k] << np.uint32(8 * k)
        inside = slice(np.searchsorted(offsets, at), np.searchsorted(offsets, at + BLOCK))
        starts[inside] = n + np.searchsorted(where, offsets[inside] - at)
        found.append(packed)
        n += len(packed)
    starts[np.searchsorted(offsets, max(0, -(-(len(data) - 3) // BLOCK) * BLOCK)) :] = n
    return np.concatenate(found), starts


def _added(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of each."""
    flat, numbers = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(flat, kind="stable")
    flat, numbers = flat[order], numbers[order]
    new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    return flat[new], np.add.reduceat(numbers, new) if len(new) else numbers


def _slots(packed: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mixed(packed.astype(np.uint64))
    low = np.uint64((1 << bits) - 1)
    return [(h >> np.uint64(i * 21)) & low for i in range(HASHES)]


@dataclass
class LanguageFilters:
    languages: list[str]
    common: str | None  # the most frequent language, for texts of which no n-gram is known
    tables: list[np.ndarray]  # a word of the mask for each slot; languages beyond the first 64 are in further words
    false_rate: np.ndarray  # for each language

    @classmethod
    def of(cls, found: dict[str, np.ndarray], common: str | None) -> LanguageFilters:
        names = sorted(found)
        most = max([1, *map(len, found.values())])
        bits = min(21, max(10, int(np.ceil(np.log2(most * SLOTS_PER_GRAM)))))
        tables, fill = [], []
        for at in range(0, len(names), WORD_BITS):
            part = names[at : at + WORD_BITS]
            width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(part) <= 8 * t().itemsize)
            table = np.zeros(1 << bits, width)
            for i, name in enumerate(part):
                for slot in _slots(found[name], bits):
                    table[slot] |= width(1 << i)
                fill.append(float(((table >> width(i)) & width(1)).mean()))
            tables.append(table)
        return cls(names, common, tables, np.array(fill) ** HASHES)

    def predict(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
        if not self.languages:
            return [None] * len(texts), np.zeros(len(texts))
        packed, at = grams(texts)
        n = np.diff(at)
        bits = int(np.log2(len(self.tables[0])))
        counts = np.zeros((len(self.languages), len(texts)))
        for begin in range(0, len(packed), BLOCK):
            slots = _slots(packed[begin : begin + BLOCK], bits)
            bounds = np.clip(at - begin, 0, len(slots[0]))
            for word, table in enumerate(self.tables):
                mask = table[slots[0]]
                for slot in slots[1:]:
                    mask &= table[slot]
                for i in range(word * WORD_BITS, min(len(self.languages), (word + 1) * WORD_BITS)):
                    bit = table.dtype.type(i - word * WORD_BITS)
                    sums = np.concatenate([[0], np.cumsum((mask >> bit) & table.dtype.type(1), dtype=np.int64)])
                    counts[i] += np.diff(sums[bounds])
        counts = np.maximum(0, (counts - n * self.false_rate[:, None]) / np.maximum(1e-9, 1 - self.false_rate[:, None]))
        total, best = counts.sum(0), counts.argmax(0)
        score = np.where(total > 0, counts.max(0) / np.where(total > 0, total, 1), 0.0)
        return [self.languages[b] if t > 0 else self.common for b, t in zip(best, total)], score


def held_out(id_col: str) -> F.Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def counted(batches):
    """lang, gram, n of batches of text and lang: of each batch a row for each n-gram of a language. Beside those rows, memory is bounded by BLOCK."""
    for batch in batches:
        langs = batch["lang"].dictionary_encode()
        row_lang, held, numbers = langs.indices.to_numpy().astype(np.uint64), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for at, part in byte_parts(batch, "text", BLOCK):
            packed, starts = grams(part["text"])
            owner = np.repeat(row_lang[at : at + part.num_rows], np.diff(starts))
            for begin in range(0, len(packed), BLOCK):
                keys, sums = np.unique(owner[begin : begin + BLOCK] << np.uint64(32) | packed[begin : begin + BLOCK], return_counts=True)
                held.append(keys)
                numbers.append(sums)
                if sum(map(len, held[1:])) > max(BLOCK, 2 * len(held[0])):
                    held, numbers = ([x] for x in _added(held, numbers))
        keys, sums = _added(held, numbers)
        for at in range(0, len(keys), BLOCK):
            own = keys[at : at + BLOCK]
            names = langs.dictionary.take(pa.array((own >> np.uint64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([names, pa.array((own & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(sums[at : at + BLOCK])], ["lang", "gram", "n"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> LanguageFilters:
    """Fits the filters on about train_rows rows of labelled, drawn by a hash of the id; rows with a null language or text don't count.

    Each language has its own rate: all rows of rare languages, and as many of each other one as fit in train_rows together. The driver gets a row for each language,
    and at most 1 / MIN_SHARE n-grams of each. Without any labelled row there are no languages.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(sizes.values()) > train_rows:
        share, rest = train_rows, len(sizes)
        for n in sorted(sizes.values()):  # what rare languages leave goes to the others
            if n * rest > share:
                break
            share, rest = share - n, rest - 1
        parts = [(lang, 1_000_000 if n * rest <= share else int(1_000_000 * share / rest / n) + 1) for lang, n in sizes.items()]
        rates = F.broadcast(rows.sparkSession.createDataFrame(parts, "lang string, rate long"))
        rows = rows.join(rates, "lang").where(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1_000_000)) < F.col("rate"))

    counts = rows.select("text", "lang").mapInArrow(tidy(counted), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))  # a row a language
    shares = shares.withColumn("top", F.max("share").over(Window.partitionBy("gram"))).where((F.col("share") >= MIN_SHARE) & (F.col("share") >= MIN_PART * F.col("top")))
    table = shares.select("lang", "gram", "total").toArrow()
    langs = table["lang"].combine_chunks().dictionary_encode()
    codes, learned, totals = langs.indices.to_numpy(), table["gram"].to_numpy().astype(np.uint32), table["total"].to_numpy()
    found, frequent = {}, {}
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        mine = np.flatnonzero(codes == code)
        found[lang], frequent[lang] = learned[mine], int(totals[mine[0]])
    return LanguageFilters.of(found, max(sorted(frequent), key=frequent.get, default=None))


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with a language and a score from 0 to 1 (the share of the corrected counts that the language has).

    Of languages with equal counts the first by name is taken; a text with letters of which no n-gram is known has the most frequent language, with score 0. The language is `und`, with score 0, if the text is null or has no letter, or nothing was learned. Columns of the names lang_col and score_col are replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    fields = [f for f in docs.schema.fields if f.name not in (lang_col, score_col)]

    def run(batches):
        model = shared.value
        for batch in batches:
            for _, part in byte_parts(batch, text_col, BLOCK, 256):
                langs, scores = model.predict(part[text_col])
                yield pa.RecordBatch.from_arrays([*(part[f.name] for f in fields), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(f.name for f in fields), lang_col, score_col])

    told = docs.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))
    known = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.col(lang_col).isNotNull()
    return told.withColumns({lang_col: F.when(known, F.col(lang_col)).otherwise("und"), score_col: F.when(known, F.col(score_col)).otherwise(0.0)})


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score; fitted on the rows that aren't held out."""
    filters = train(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), text_col, lang_col, id_col)
    return identify(docs.select(id_col, text_col), filters, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
