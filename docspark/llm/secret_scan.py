"""Secret scan: regular expressions name candidates, a random forest removes the false ones. Built-in functions and spark.ml only.

Features of a candidate: its length and character mix, its transitions between character classes, the share of it that dictionary words cover, its path, and the words
around it. The forest is trained from labelled findings; labelled_examples() makes a fixed set of them by rule.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Words that announce a secret, words that announce something that only looks like one, paths of examples and locks, and token prefixes.
SECRET_WORDS = ["secret", "token", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "auth", "bearer", "client_secret"]
OTHER_WORDS = ["sha1", "sha256", "sha512", "md5", "checksum", "digest", "commit", "revision", "integrity", "hash", "uuid", "guid", "etag", "version", "example", "sample", "dummy", "placeholder", "changeme", "phone", "card", "isbn", "order", "invoice"]
OTHER_PATHS = ["test", "spec", "fixture", "example", "sample", "mock", "doc", "lock", "vendor", "dist"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "ya29.", "eyJ", "npm_", "pypi-", "SG."]

ASSIGNED = r"""(?i)(?:secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer)["']?\s{0,3}(?:=>|:=|[:=]|\s)\s{0,3}["']?[^\s"'<>]{8,}"""
LONG = r"[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = f"{ASSIGNED}|{LONG}"
BEFORE, AFTER = 60, 30
#: Dictionary words are in at least this share of the documents, and in this many of a small table.
DICTIONARY_SHARE, DICTIONARY_LEAST = 2e-4, 3
TRAIN_ROWS = 6_000
TREES, DEPTH = 40, 8
KEEP = 0.5

FEATURES = ["length", "digit_share", "upper_share", "other_share", "distinct_share", "transitions", "longest_run", "hex", "dictionary", "prefix", "assigned", "quoted", "secret_word", "other_word", "other_path", "separators"]


def dictionary(docs: DataFrame, text_col: str = "text", share: float = DICTIONARY_SHARE, least: int = DICTIONARY_LEAST) -> DataFrame:
    """word: lower-case runs of three or more letters that at least this share of the documents has (and at least `least` of them)."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+"))).alias("word")).where(F.length("word").between(3, 64))
    total = docs.select(F.count("*").alias("total"))
    return words.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(least), F.col("total") * share)).select("word")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """id, path, value, start (characters from 1), before, after: a row per occurrence of a candidate, with its own place and context.

    Long runs without a digit count only where they are assigned to a secret's name.
    """
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")).alias("path"), F.col(text_col).alias("text"))
    # The parts between the matches and the matches themselves make up the text: their lengths, added up, are the places.
    rows = rows.where(F.col("text").rlike(CANDIDATE)).select("id", "path", "text", F.split("text", CANDIDATE, -1).alias("parts"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("matches"))
    steps = F.zip_with("parts", "matches", lambda part, match: F.struct(F.length(part).alias("gap"), F.coalesce(F.length(match), F.lit(0)).alias("n")))
    none = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts"))
    added = lambda done, step: F.struct((done["next"] + step["gap"] + step["n"]).alias("next"), F.concat(done["starts"], F.array(done["next"] + step["gap"])).alias("starts"))
    rows = rows.withColumn("starts", F.aggregate(steps, none, added, lambda done: done["starts"]))
    found = F.filter(F.arrays_zip("matches", "starts"), lambda m: m["matches"].rlike("[0-9]") | m["matches"].rlike(ASSIGNED))
    rows = rows.select("id", "path", "text", F.explode(found).alias("at")).select("id", "path", "text", F.col("at.matches").alias("match"), F.col("at.starts").alias("at"))
    value = F.regexp_replace("match", r"""(?i)^(?:secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer)["']?\s{0,3}(?:=>|:=|[:=]|\s)\s{0,3}["']?""", "")
    rows = rows.withColumn("start", F.col("at") + F.length("match") - F.length(value)).withColumn("value", F.regexp_replace(value, r"[.,;:!?)\]}]+$", "")).where(F.length("value") >= 8)
    return rows.select("id", "path", "value", "start", F.expr(f"substring(text, greatest(1, start - {BEFORE}), least({BEFORE}, start - 1))").alias("before"), F.expr(f"substring(text, start + length(value), {AFTER})").alias("after"))


def _any(text, words: list[str]):
    return F.lower(text).rlike("|".join(w.replace("_", "[_ -]?") for w in words)).cast("double")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the feature columns. words is the dictionary: candidates are cut into runs of letters and joined with it."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "[^abc]", "d")
    rows = found.withColumn("key", F.xxhash64("value"))
    parts = rows.select("key", "value").distinct().select("key", F.explode(F.split(F.lower(F.regexp_replace("value", r"([a-z])([A-Z])", "$1 $2")), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    covered = parts.join(words, "word").groupBy("key").agg(F.sum(F.length("word")).cast("double").alias("covered"))
    rows = rows.join(covered, "key", "left").drop("key")
    return rows.withColumns({
        "length": n,
        "digit_share": share("[^0-9]"),
        "upper_share": share("[^A-Z]"),
        "other_share": share("[A-Za-z0-9]"),
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
        "transitions": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n,
        "longest_run": F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), F.length)) / n,
        "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "dictionary": F.least(F.coalesce(F.col("covered") / n, F.lit(0.0)), F.lit(1.0)),
        "prefix": v.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + ")").cast("double"),
        "assigned": F.col("before").rlike(r"""["']?\s{0,3}(?:=>|:=|[:=])\s{0,3}["']?$""").cast("double"),
        "quoted": (F.col("before").rlike("""["']$""") & F.col("after").rlike("""^["']""")).cast("double"),
        "secret_word": _any(F.substring("before", -25, 25), SECRET_WORDS),
        "other_word": F.greatest(_any(F.substring("before", -25, 25), OTHER_WORDS), _any(v, ["example", "sample", "xxxx", "changeme", "placeholder"])),
        "other_path": _any(F.col("path"), OTHER_PATHS),
        "separators": share(r"[^/_+.-]") * 1.0,
    }).drop("covered")


def labelled_examples(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 17) -> DataFrame:
    """Labelled findings by rule: id, path, value, start, before, after, label (1: a secret). Each row follows from its number and the seed."""
    i = F.col("id")
    digest = lambda k: F.sha2(F.concat_ws("-", F.lit(seed), i, F.lit(k)), 512)
    pick = lambda k, items: F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(F.xxhash64(F.lit(seed), i, F.lit(k)), F.lit(len(items))) + 1).cast("int"))
    hexes = F.substring(digest("v"), 1, 128).substr(F.lit(1), pick("n", [24, 32, 40, 48, 64, 96]))
    b64 = F.regexp_replace(F.base64(F.unhex(digest("v"))), r"\s", "").substr(F.lit(1), pick("n", [20, 24, 32, 40, 48, 64]))
    words = ["under", "there", "hence", "green", "river", "stone", "light", "paper", "north", "table", "silver", "window", "garden", "letter", "market"]
    compound = F.concat(*[pick(f"w{k}", words) for k in range(4)], F.lit("_"), pick("w9", ["1", "2", "v3", "2024"]))
    digits = F.translate(digest("v"), "abcdef", "123456").substr(F.lit(1), pick("n", [16, 18, 20, 24]))
    uuid = F.regexp_replace(F.substring(digest("v"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    name = pick("name", ["token", "secret", "password", "api_key", "access_key", "client_secret", "auth_token"])
    assign = pick("assign", [' = "', " = '", ": ", '="', "="])
    plain = pick("plain", ["the ", "see ", "with id ", "of number ", "build ", "at ", "text and "])
    kinds = [  # value, before, label
        (hexes, F.concat(plain, name, assign), 1), (F.upper(hexes), F.concat(plain, F.upper(name), assign), 1), (b64, F.concat(plain, name, assign), 1), (F.concat(pick("p", PREFIXES), b64), F.concat(plain, pick("pn", ["key ", "use ", "Bearer ", "key="])), 1), (hexes, F.concat(plain, F.lit("authorization: bearer ")), 1),
        (hexes, F.concat(plain, pick("o", [f"{w} " for w in OTHER_WORDS[:12]])), 0), (uuid, F.concat(plain, pick("o2", ["uuid ", "guid=", "id: "])), 0), (compound, F.concat(plain, pick("o3", ["name = ", "see ", "the "])), 0), (digits, plain, 0), (F.concat(compound, F.lit("/"), compound), plain, 0),
        (F.concat(pick("x", ["example", "xxxxxxxx", "changeme", "placeholder", "sample"]), F.lit("-"), pick("y", ["token-1234", "key-00000000", "secret-1111"])), F.concat(name, assign), 0), (F.concat(compound, compound), F.concat(name, assign), 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    chosen = lambda j: F.element_at(F.array(*[F.struct(v.alias("value"), b.alias("before"), F.lit(y).alias("label")) for v, b, y in kinds]), (kind + 1).cast("int"))[j]
    table = spark.range(0, rows, 1, 4).select("id", pick("path", ["src/app.py", "config/prod.yml", "docs/readme.md", "tests/test_api.py", "web", ""]).alias("path"), chosen("value").alias("value"), chosen("before").alias("before"), chosen("label").alias("label"))
    return table.select("id", "path", "value", F.lit(1).alias("start"), "before", F.when(F.col("before").rlike("""["']$"""), F.substring("before", -1, 1)).otherwise(" ").alias("after"), "label")


def train(labelled: DataFrame, words: DataFrame, seed: int = 17) -> PipelineModel:
    """A forest from labelled findings (columns of candidates() and label); hand it a bounded number of them."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    rows = assembler.transform(written(features(labelled, words), "labelled-findings"))
    return PipelineModel([assembler, forest.fit(rows)])


def scan(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, keep: float = KEEP) -> DataFrame:
    """The findings that the forest keeps: id, path, start, n_chars, secret, probability.

    Null and empty texts have none; rows with a null id are scanned too; repeated rows give repeated findings, and a candidate repeated in one text a finding for each place. A probability of
    exactly `keep` is kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    words = written(dictionary(docs, text_col), "dictionary")
    model = train(labelled, words)
    found = written(candidates(docs, id_col, text_col, path_col), "secret-candidates")  # read twice: for the features and for their words
    judged = model.transform(features(found, words))
    judged = judged.withColumn("probability", vector_to_array("probability")[1]).where(F.col("probability") >= keep)
    return judged.select(F.col("id").alias(id_col), "path", F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("n_chars"), F.col("value").alias("secret"), "probability")
