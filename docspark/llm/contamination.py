"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment. Built-in functions only.

Items are short and documents long, so only items are sketched. Items are partitioned by size (powers of two of their shingle counts). In each
partition an item's sketch is its k smallest shingle hashes, where k is one more than the shingles that an item of that partition may lack at the
threshold: a document that contains enough of the item holds at least one of them, so the search misses nothing. Candidates are verified one by one, by the shingles that document and item share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WORDS = 5
CONTAINMENT = 0.8
#: Sketch rows (16 bytes each) up to which the sketches are broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 500_000


def words_of(text: F.Column) -> F.Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: F.Column, n: int = WORDS) -> F.Column:
    """A hash for each place where n words begin; of fewer words one hash of them all; without words none."""
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), at)).when(F.size(words) > 0, F.array(F.xxhash64(words, F.lit(n)))).otherwise(F.array().cast("array<bigint>"))


def sketches(items: DataFrame, id_col: str, text_col: str, n: int = WORDS, threshold: float = CONTAINMENT) -> DataFrame:
    """Per item: item, text_key, shingles (distinct hashes), n_shingles, size_class, sketch."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.xxhash64(text_col).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("item", "text_key", F.array_distinct(shingle_hashes(F.col("words"), n)).alias("shingles")).dropDuplicates(["item", "text_key"]).where(F.size("shingles") > 0)
    rows = rows.withColumn("n_shingles", F.size("shingles")).withColumn("size_class", F.floor(F.log2(F.col("n_shingles").cast("double"))).cast("int"))
    most_missing = F.floor((F.pow(F.lit(2.0), F.col("size_class") + 1) - 1) * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")
    return rows.withColumn("sketch", F.slice(F.array_sort("shingles"), F.lit(1), most_missing + 1))


def _text_key(text) -> list[F.Column]:
    """128 bits that name a text: whether it holds an item depends on nothing else."""
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit("contamination"), text).alias("key2")]


KEY = ["key1", "key2"]


def _contained(texts: DataFrame, items: DataFrame, item_col: str, item_text_col: str, n: int, threshold: float) -> DataFrame:
    """key1, key2, item, n_shingles, overlap, containment for texts (key1, key2, text); of items that share an id the best one."""
    sketched = written(sketches(items, item_col, item_text_col, n, threshold), "item-sketches")
    keys = sketched.select("item", "text_key", F.explode("sketch").alias("h"))
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    hashed = texts.select(*KEY, words_of(F.col("text")).alias("words"))
    candidates = written(hashed.select(*KEY, F.explode(shingle_hashes(F.col("words"), n)).alias("h")).join(keys, "h").select(*KEY, "item", "text_key").distinct(), "contamination-candidates")
    # Each candidate is checked by itself: the shingles of its document against those of its item.
    opened = hashed.join(candidates.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY).select(*KEY, shingle_hashes(F.col("words"), n).alias("held"))
    pairs = candidates.join(sketched.select("item", "text_key", "shingles", "n_shingles"), ["item", "text_key"]).join(opened, KEY)
    pairs = pairs.select(*KEY, "item", F.col("n_shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("shingles", "held")).cast("long").alias("overlap"))
    best = pairs.withColumn("containment", F.col("overlap") / F.col("n_shingles")).where(F.col("containment") >= threshold)
    best = best.groupBy(*KEY, "item").agg(F.max(F.struct("containment", "overlap", "n_shingles")).alias("best"))
    return best.select(*KEY, "item", "best.n_shingles", "best.overlap", "best.containment")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS, threshold: float = CONTAINMENT) -> DataFrame:
    """Pairs (id, item) where the document holds at least `threshold` of the item's distinct n-word shingles: n_shingles, overlap, containment.

    Words are lower-case runs of letters and digits. Null and empty texts hold nothing; a text of fewer than n words has one shingle, the whole sequence. Rows with a null
    id or item id are left out. Repeated rows give one pair; of rows that share an id but not the text, each is searched on its own and the best pair is returned.
    Empty tables give an empty result; other columns are ignored.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *_text_key(F.col(text_col)), F.col(text_col).alias("text"))
    found = written(_contained(rows.select(*KEY, "text"), items, item_col, item_text_col, n, threshold), "contained-items")
    best = rows.select("id", *KEY).join(found, KEY).groupBy("id", "item").agg(F.max(F.struct("containment", "overlap", "n_shingles")).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.n_shingles", "best.overlap", "best.containment")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose text contains an item. Every row is judged by its own text: rows of one id apart, and rows with a null id too."""
    found = written(_contained(docs.select(*_text_key(F.col(text_col)), F.col(text_col).alias("text")), items, item_col, item_text_col, WORDS, CONTAINMENT).select(*KEY).distinct(), "contaminated")
    key1, key2 = _text_key(F.col(text_col))
    return docs.join(found, (key1 == found["key1"]) & (key2 == found["key2"]), "left_anti")
