"""The registered queries of the operators, each over its whole table with production parameters, and SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import license_scan, secret_scan
from .bpe import round_trip_digests
from .common import table
from .contamination import contained_items
from .exact_dedup import exact_groups
from .html_text import main_texts
from .jaccard import jaccard_components
from .language import languages
from .passages import repeated_passages
from .warc import archived_pages


def op1_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark, sf_dir):
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_html_extraction(spark, sf_dir):
    return main_texts(table(spark, sf_dir, "pages"))


def op4_warc_archives(spark, sf_dir):
    return archived_pages(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op6_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.labelled_examples(spark), path_col="source")
    return found.select("doc_id", "start", "n_chars", F.sha2("secret", 256).alias("secret_sha256"), F.round("probability", 6).alias("probability"))


def op7_language_id(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_license_scan(spark, sf_dir):
    """Documents have no paths: they are laid out as /source/lang/doc_id.txt, and texts of which at least half are licence statements as licence files."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(license_scan.statement_share(F.col("text")) >= 0.5, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    files = docs.select(F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), name).alias("path"), "text")
    found = license_scan.scan(files, license_scan.template_table(spark))
    return found.select(F.regexp_extract("path", r"(\d+)(?:\.txt)?$", 1).cast("long").alias("doc_id"), "path", "license_id", F.round("score", 6).alias("score"), "how", "from_path")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_html_extraction": op3_html_extraction,
    "op4_warc_archives": op4_warc_archives,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL = {
    "op4_warc_archives": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT html, max(page_id) AS response FROM t WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
        SELECT page_id, octet_length(encode(t.html)) AS payload_bytes, sha1(t.html) AS payload_digest,
               CASE WHEN page_id <> response THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
        FROM t LEFT JOIN g ON t.html = g.html""",
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)""",
    "op8_decontamination": r"""
        WITH w AS (
            SELECT 'doc' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents
            UNION ALL
            SELECT 'item', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
        s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                                                     WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
        n AS (SELECT id, count(*) AS n_shingles FROM s WHERE kind = 'item' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, n_shingles, count(*) AS overlap, count(*) / n_shingles AS containment
        FROM s d JOIN s i ON d.shingle = i.shingle AND d.kind = 'doc' AND i.kind = 'item' JOIN n ON n.id = i.id
        GROUP BY d.id, i.id, n_shingles HAVING count(*) / n_shingles >= 0.8""",
}
