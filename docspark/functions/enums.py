"""Whether a field's values are an enumeration: frequency metrics, patterns of the distinct values, and decision rules by the number of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import value_counts


# The standard sets, and the patterns of codes and of words.
STANDARD_SETS = {
    "booleans": ["true", "false", "yes", "no", "1", "0", "on", "off"],
    "months": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
    "weekdays": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"],
    "countries": ["United States", "Canada", "Mexico", "United Kingdom", "France", "Germany", "Spain", "Italy", "China", "Japan", "India", "Brazil", "Australia", "USA", "US", "UK", "GB", "FR", "DE", "ES", "IT", "CN", "JP", "IN", "BR", "AU"],
    "states": ["Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA"],
    "currencies": ["USD", "EUR", "GBP", "JPY", "CNY", "AUD", "CAD", "CHF", "HKD", "SGD"],
    "http_methods": ["GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD"],
    "http_status": ["200", "201", "204", "301", "302", "400", "401", "403", "404", "500", "502", "503"],
    "priorities": ["low", "medium", "high", "critical", "urgent", "1", "2", "3", "4", "5"],
    "sizes": ["small", "medium", "large", "extra-large", "XS", "S", "M", "L", "XL", "XXL"],
    "genders": ["male", "female", "other", "M", "F", "O"],
    "directions": ["north", "south", "east", "west", "N", "S", "E", "W", "NE", "NW", "SE", "SW"],
}
CODE_PATTERNS = [r"^[A-Z_]+$", r"^[A-Z][A-Z0-9_]*$", r"^\w+_\w+$", r"^[A-Z][a-z]+(?:[A-Z][a-z]+)*$"]
WORDS_PATTERN = r"^[A-Za-z\s,.'\"-]+$"


def metrics(df: DataFrame, path: str) -> DataFrame:
    """n, n_distinct, unique_ratio, entropy, length_mean, length_sd, concentration (share of the distinct values that cover 80 % of the rows), power_law."""
    counts = value_counts(df, path).withColumn("value", F.col("value").cast("string"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    rows = counts.join(F.broadcast(total))
    p = F.col("n") / F.col("total")
    basic = rows.agg(
        F.first("total").alias("n"), F.first("distinct").alias("n_distinct"), (F.first("distinct") / F.first("total")).alias("unique_ratio"), (-F.sum(p * F.log2(p))).alias("entropy"),
        (F.sum(F.length("value") * F.col("n")) / F.first("total")).alias("length_mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.pow(F.length("value"), F.lit(2)) * F.col("n")) / F.first("total") - F.pow(F.sum(F.length("value") * F.col("n")) / F.first("total"), F.lit(2)))).alias("length_sd"),
    )
    return basic.join(F.broadcast(concentration(counts))).join(F.broadcast(power_law(counts)))


def concentration(counts: DataFrame) -> DataFrame:
    """Share of the distinct values, most frequent first, that it takes to cover 80 % of the rows.

    Values of one frequency are alike, so only the frequencies are put in order: a row for each distinct frequency.
    """
    by_n = counts.groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = by_n.select("n", "k", F.coalesce(F.sum(F.col("n") * F.col("k")).over(w), F.lit(0)).alias("before"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("values_before"), F.sum(F.col("n") * F.col("k")).over(everything).alias("total"), F.sum("k").over(everything).alias("distinct"))
    crossing = rows.where((F.col("before") < 0.8 * F.col("total")) & (F.col("before") + F.col("n") * F.col("k") >= 0.8 * F.col("total")))
    return crossing.agg(F.max((F.col("values_before") + F.ceil((0.8 * F.col("total") - F.col("before")) / F.col("n"))) / F.col("distinct")).alias("concentration"))


def power_law(counts: DataFrame) -> DataFrame:
    """Absolute slope of log frequency by log rank over the 100 most frequent values; 0 below ten values."""
    first = counts.orderBy(F.desc("n"), "value").limit(100)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))  # at most 100 rows
    return ranked.agg(F.when(F.count("*") >= 10, F.abs(F.coalesce(F.regr_slope(F.log("n"), F.log(F.col("rank").cast("double"))), F.lit(0.0)))).otherwise(0.0).alias("power_law"))


def patterns(df: DataFrame, path: str) -> DataFrame:
    """is_standard_set, is_code, is_natural_language, is_structured, coherence of the distinct values."""
    values = value_counts(df, path).select(F.col("value").cast("string").alias("v"))
    in_set = [F.avg(F.lower("v").isin([x.lower() for x in items]).cast("double")) > 0.5 for items in STANDARD_SETS.values()]
    # Whatever is neither letter nor digit becomes a mark that no letter becomes.
    layout = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("v", "[^A-Za-z0-9]", "*"), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    is_code = F.greatest(*[F.col("v").rlike(p) for p in CODE_PATTERNS])
    shortest = F.min(F.length("v"))
    common = lambda a, b: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    back = F.reverse("v")
    rows = values.agg(
        F.greatest(*[x.cast("int") for x in in_set]).cast("boolean").alias("is_standard_set"), (F.avg(is_code.cast("double")) > 0.7).alias("is_code"), (F.avg((F.col("v").rlike(WORDS_PATTERN) & F.contains("v", F.lit(" "))).cast("double")) > 0.5).alias("is_natural_language"),
        ((F.count("*") >= 3) & ((F.count_distinct(layout) <= 3) | (F.count_distinct(layout) / F.count("*") < 0.2))).alias("is_structured"), F.count("*").alias("k"), shortest.alias("short"), F.min("v").alias("v1"), F.max("v").alias("v2"), F.min(back).alias("r1"), F.max(back).alias("r2"),
    )
    # What the least and the greatest value share from the start, all values share.
    shared = F.greatest(common(F.col("v1"), F.col("v2")), common(F.col("r1"), F.col("r2")))
    return rows.select("is_standard_set", "is_code", "is_natural_language", "is_structured", F.when((F.col("k") < 2) | (F.col("short") == 0), 0.0).otherwise(F.least(shared, F.col("short")) / F.col("short")).alias("coherence"))


def detect(df: DataFrame, path: str) -> DataFrame:
    """path, is_enum, confidence, kind, reason, with the metrics and patterns that decide."""
    rows = metrics(df, path).join(F.broadcast(patterns(df, path)))
    c = F.col
    no, yes = (lambda conf, why: F.struct(F.lit(False).alias("is_enum"), F.lit(conf).alias("confidence"), F.lit("not_enum").alias("kind"), F.lit(why).alias("reason"))), (lambda conf, why, kind: F.struct(F.lit(True).alias("is_enum"), F.lit(conf).alias("confidence"), F.lit(kind).alias("kind"), F.lit(why).alias("reason")))
    small = (
        F.when(c("unique_ratio") > 0.8, no("very_low", "too many distinct values")).when(c("is_standard_set"), yes("high", "a standard set", "standard_set")).when(c("is_code") & (c("n_distinct") <= 50), yes("high", "codes", "application_enum"))
        .when((c("n_distinct") <= 20) & (c("concentration") < 0.3), yes("medium", "few, concentrated values", "application_enum")).when(c("is_natural_language"), no("low", "natural language")).when((c("n_distinct") <= 30) & (c("entropy") < 3), yes("low", "low entropy", "application_enum")).otherwise(no("very_low", "no sign of an enum"))
    )
    medium = (
        F.when((c("unique_ratio") > 0.5) | (c("n_distinct") > 1000), no("very_low", "too many distinct values")).when(c("is_standard_set"), yes("high", "a standard set", "standard_set")).when((c("power_law") > 1.5) & (c("n_distinct") <= 100), yes("medium", "power law", "application_enum"))
        .when(c("is_code") & (c("n_distinct") <= 200), yes("medium", "codes", "application_enum")).when((c("entropy") < 4) & (c("n_distinct") <= 50), yes("medium", "low entropy", "application_enum")).otherwise(no("low", "no sign of an enum"))
    )
    large = (
        F.when(c("n_distinct") > 500, no("very_low", "too many distinct values")).when(c("is_standard_set") & (c("coherence") > 0.3), yes("high", "a standard set", "standard_set")).when((c("power_law") > 2.0) & (c("n_distinct") <= 50), yes("medium", "power law", "application_enum"))
        .when(c("is_structured") & (c("n_distinct") <= 20), yes("low", "structured values", "natural_constraint")).otherwise(no("very_low", "no sign of an enum"))
    )
    verdict = F.when(c("n") <= 1_000, small).when(c("n") <= 100_000, medium).otherwise(large)
    return rows.select(F.lit(path).alias("path"), verdict.alias("verdict"), *rows.columns).select("path", "verdict.*", *rows.columns)
