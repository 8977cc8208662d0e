"""License scan: sparse TF-IDF cosine of headers, statements and licence files to templates, then inheritance from the nearest ancestor directory. Built-in functions only.

A file is compared at four levels: whole (licence files), by blocks (paragraphs and comment blocks, their lines joined), by the sentences of blocks, and by the sentences of lines. Where a
larger unit matches a template, the smaller ones in it don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .license_texts import templates

#: Words that every template has one of, so a unit without any of them is like none.
STATEMENT = r"licen[sc]|spdx|public domain|hereby granted|permission|redistribut|copying|free software"
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense|notice)[^/]*$"
COSINE = 0.6
#: From this cosine on a licence file is its template and no more; below, its blocks are looked at too.
SAME = 0.9
#: Characters by which a very long sentence is cut into overlapping pieces of twice that length.
PIECE = 400
LINES, SENTENCES, BLOCKS, WHOLE = 0, 1, 2, 3


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(templates(), "license_id string, text string").withColumn("template", F.xxhash64("license_id", "text"))


def statement_share(text: F.Column) -> F.Column:
    """Which part of a text, by characters, are lines with a licence word."""
    stated = F.filter(F.split(text, r"\n"), lambda line: F.lower(line).rlike(STATEMENT))
    share = F.aggregate(stated, F.lit(0), lambda n, line: n + F.length(line)) / F.greatest(F.length(text), F.lit(1))
    return F.when(F.lower(text).rlike(STATEMENT), share).otherwise(0.0)  # most texts have no such word, and their lines aren't looked at


def _words(text: F.Column) -> F.Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")


def _terms(words: F.Column) -> F.Column:
    """Words and word pairs. words must be a column, not an expression, or it would be worked out for each pair."""
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def statements(files: DataFrame, path_col: str = "path", text_col: str = "text", license_file: str = LICENSE_FILE) -> DataFrame:
    """path, block, level, statement: the units of the whole text that may state a licence, each once. The whole file is block -1."""
    stated = lambda c: F.lower(c).rlike(STATEMENT)
    rows = files.where(stated(F.col(text_col))).select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    # Comment marks at the ends of lines go; an empty line ends a block.
    plain = F.regexp_replace(F.regexp_replace("text", r"(?m)^[ \t]*(?:/\*+|\*+/|\*|//+|#+|--+|;+|%+|<!--|\.\.|\"{3})[ \t]?", ""), r"(?m)[ \t]*(?:\*+/|-->)?[ \t\r]*$", "")
    blocks = rows.select("path", plain.alias("text")).select("path", F.posexplode(F.split("text", r"\n\s*\n")).alias("block", "text")).where(stated(F.col("text")))
    end = r"(?<=[.!?;])\s+"
    joined = F.trim(F.regexp_replace("text", r"\s*\n\s*", " "))
    unit = lambda level, items: F.transform(items, lambda x: F.struct(F.lit(level).alias("level"), x.alias("statement")))
    units = F.concat(unit(LINES, F.split("text", r"\n|" + end)), unit(SENTENCES, F.split(joined, end)), unit(BLOCKS, F.array(joined)))
    units = blocks.select("path", "block", F.explode(units).alias("unit")).select("path", "block", "unit.*").where(stated(F.col("statement")))
    long_one = (F.length("statement") > 2 * PIECE) & (F.col("level") < BLOCKS)
    pieces = F.when(long_one, F.transform(F.sequence(F.lit(1), F.length("statement"), F.lit(PIECE)), lambda i: F.col("statement").substr(i, F.lit(2 * PIECE)))).otherwise(F.array("statement"))
    units = units.select("path", "block", "level", F.explode(pieces).alias("statement")).where(stated(F.col("statement")))
    whole = rows.where(F.col("path").rlike(license_file)).select("path", F.lit(-1).alias("block"), F.lit(WHOLE).alias("level"), F.col("text").alias("statement"))
    return units.unionByName(whole).distinct()


def direct_licenses(files: DataFrame, templates: DataFrame, path_col: str = "path", text_col: str = "text", cosine: float = COSINE, license_file: str = LICENSE_FILE) -> DataFrame:
    """path, license_id, score: the best template of each file with a unit that reaches the cosine; license_ids: all licences that its units name.

    Equal units are weighed once for all files. Document frequencies count the distinct units of all files and the templates. Of equal scores the last identifier by name counts.
    """
    stated = written(statements(files, path_col, text_col, license_file).withColumn("sid", F.xxhash64("statement")), "license-statements")
    texts = stated.groupBy("sid").agg(F.first("statement").alias("text")).select(F.lit(False).alias("known"), "sid", "text").unionByName(templates.select(F.lit(True).alias("known"), F.col("template").alias("sid"), "text"))
    counts = texts.select("known", "sid", _words(F.col("text")).alias("words")).select("known", "sid", F.explode(_terms(F.col("words"))).alias("term")).groupBy("known", "sid", "term").agg(F.count("*").alias("tf"))
    total = texts.count()
    weights = counts.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    vectors = written(counts.join(weights, "term").select("known", "sid", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")), "license-vectors")
    norms = vectors.groupBy("known", "sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    side = lambda known, name: vectors.where(F.col("known") == known).select("term", F.col("sid").alias(name), F.col("w").alias(f"w_{name}"))
    norm = lambda known, name: norms.where(F.col("known") == known).select(F.col("sid").alias(name), F.col("norm").alias(f"n_{name}"))
    dots = side(False, "s").join(side(True, "t"), "term").groupBy("s", "t").agg(F.sum(F.col("w_s") * F.col("w_t")).alias("dot"))
    scored = dots.join(norm(False, "s"), "s").join(norm(True, "t"), "t").withColumn("score", F.col("dot") / (F.col("n_s") * F.col("n_t"))).where(F.col("score") >= cosine)
    named = scored.join(templates.select(F.col("template").alias("t"), "license_id"), "t").groupBy("s").agg(F.max_by(F.struct("license_id", "score"), F.struct("score", "license_id")).alias("best"))
    matched = stated.select("path", "block", "level", F.col("sid").alias("s")).join(named, "s")
    # In each block the largest units that match, and the whole file before its blocks.
    found = matched.groupBy("path", "block").agg(F.max("level").alias("top"), F.collect_set(F.struct("level", "best")).alias("all"))
    found = found.select("path", "top", F.explode(F.filter("all", lambda x: x["level"] == F.col("top"))["best"]).alias("best"))
    files_found = found.groupBy("path").agg(F.collect_set(F.struct("top", "best")).alias("all"))
    same = F.exists("all", lambda x: (x["top"] == WHOLE) & (x["best"]["score"] >= SAME))
    kept = F.filter("all", lambda x: ~same | (x["top"] == WHOLE))["best"]
    best = F.array_max(F.transform(kept, lambda x: F.struct(x["score"].alias("score"), x["license_id"].alias("license_id"))))
    return files_found.select("path", best["license_id"].alias("license_id"), best["score"].alias("score"), F.array_sort(F.array_distinct(kept["license_id"])).alias("license_ids"))


def scan(files: DataFrame, templates: DataFrame, path_col: str = "path", text_col: str = "text", cosine: float = COSINE, license_file: str = LICENSE_FILE) -> DataFrame:
    """Per distinct path: path, license_id, score, how ('direct', 'inherited' or 'none'), from_path (the licence file that an inherited one comes from), license_ids (all that the file itself names).

    A file without a statement of its own inherits from the licence files of its directory, or else of the nearest ancestor directory that has any; of several in one
    directory the best score counts, then the smallest path. Null and empty texts state nothing; rows with a null path are left out, repeated paths are one file. An empty table gives
    an empty result; other columns are ignored.
    """
    files = files.where(F.col(path_col).isNotNull())
    direct = written(direct_licenses(files, templates, path_col, text_col, cosine, license_file), "direct-licenses")
    folder = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    owners = direct.where(F.col("path").rlike(license_file)).groupBy(folder(F.col("path")).alias("folder")).agg(F.min_by(F.struct("license_id", "score", F.col("path").alias("from_path")), F.struct(-F.col("score"), "path")).alias("own"))
    paths = files.select(F.col(path_col).alias("path")).distinct().join(direct, "path", "left")
    # Each file without a licence meets the folders on its path; the deepest one that has a licence file counts.
    up = paths.where(F.col("license_id").isNull()).select("path", F.split(folder(F.col("path")), "/").alias("steps"))
    up = up.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.struct(k.alias("depth"), F.concat_ws("/", F.slice("steps", F.lit(1), k)).alias("folder")))).alias("at")).select("path", "at.*")
    inherited = up.join(owners, "folder").groupBy("path").agg(F.max_by("own", "depth").alias("own"))
    return paths.join(inherited, "path", "left").select(
        "path", F.coalesce("license_id", "own.license_id").alias("license_id"), F.coalesce("score", "own.score").alias("score"),
        F.when(F.col("license_id").isNotNull(), "direct").when(F.col("own").isNotNull(), "inherited").otherwise("none").alias("how"), F.when(F.col("license_id").isNull(), F.col("own.from_path")).alias("from_path"), "license_ids",
    )
