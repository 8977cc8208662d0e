"""The training-data operators on small tables: brute force, exact round trips, odd inputs."""

import hashlib
import io
import os
import re
import time
import tracemalloc
import zipfile

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.llm import bpe, contamination, exact_dedup, html_text, jaccard, language, license_scan, passages, secret_scan, warc
from docspark.llm.common import Words, mixed, shingles
from docspark.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return ["w%05d" % x for x in rng.integers(0, 50_000, n)]


# 5 exact dedup


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_exact_groups_equal_brute_force(spark, partitions):
    texts = ["Same", "same", "SAME", None, "", "É", "é", "x"] * 5 + ["hot"] * 300 + ["y" * 200_000, "Y" * 200_000]
    df = documents(spark, texts)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: r for r in exact_dedup.exact_groups(df, keep="max").collect()}
        kept = exact_dedup.exact_dedup(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    norm = [bytes(t or "", "utf8").lower() for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(same), len(same), i == max(same), hashlib.sha256(t).hexdigest())
    assert sorted(r["doc_id"] for r in kept) == sorted({t: i for i, t in reversed(list(enumerate(norm)))}.values())
    assert all(r["text"] == texts[r["doc_id"]] for r in kept)


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert exact_dedup.exact_groups(df, keep="max").where("kept").count() == 2
    assert sorted(exact_dedup.exact_dedup(df).collect(), key=str) == sorted([(1, "a"), (None, "b")], key=str)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


# 2 BPE


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello  world!\n\n it's 123", "a" * 3000, "ab" * 2000, "漢字 😀 é́", "<|endoftext|>", " \t\r\n ", "x" * 17, "\x00\x7f"]
    df = documents(spark, texts).withColumn("ids", F.lit(1))
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    for r in out.collect():
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == own.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(df, RANKS, public_tokenizers.PATTERN).collect()}
    ids = own.encode_ordinary(texts[2])
    assert digests[2]["n_tokens"] == len(ids) and digests[2]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digests[1]["n_tokens"] == 0 and digests[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_segment_tree_keeps_its_minimum():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1000, 500).tolist()
    tree = bpe.RankTree(list(keys))
    for at, key in zip(rng.integers(0, 500, 300).tolist(), rng.integers(0, 2000, 300).tolist()):
        keys[at] = key
        tree.put(at, key)
        assert tree.least() == min(keys)


def test_decoding_nulls_and_unknown_ids(spark):
    out = bpe.decode(spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>"), RANKS).collect()
    assert [r["decoded"] for r in out] == [None, b"", b'!"']
    with pytest.raises(Exception):  # noqa: B017
        bpe.decode(spark.createDataFrame([([99_999],)], "ids array<int>"), RANKS).collect()


# 3 HTML

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy <b>now</b></div>
%s<aside class="sidebar">More</aside><div id="comments"><p>First comment, and a long one that has much to say about all this.</p></div>
<form>Name <input name="a"></form><div class="cookie-notice">We use cookies</div><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("article", "text"),
    [
        ("<article><h1>Title</h1><p>One  two\n three &lt;four&gt;.</p><p><b>Bold<br>line<p>Next &eacute;&nbsp;x</p></article>", "Title\nOne two three <four>.\nBold line\nNext é x"),
        ("<div class='story'><p>The first paragraph of a story, long enough to weigh something.</p><p>The second one, also with some words in it.</p><ul><li>a</li><li>b</li></ul></div>", "The first paragraph of a story, long enough to weigh something.\nThe second one, also with some words in it.\na\nb"),
        ("<article><h1>W</h1><p>Short.</p></article>", "W\nShort."),
        ("<article></article>", ""),
    ],
)
def test_extraction(article, text):
    assert html_text.extract(PAGE % article) == text


def test_extraction_of_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "no tags at all"), (4, "u", "<p>open <b>forever" + " x" * 50_000), (5, "u", "<" * 1000), (6, "u", "<div>" * 5000 + "deep")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_text.main_texts(df).collect()}
    assert out[1]["text"] == out[2]["text"] == "" and out[3]["text"] == "no tags at all" and out[6]["text"] == "deep"
    assert out[4]["n_chars"] == len("open forever") + 100_000
    assert html_text.main_texts(df.limit(0)).count() == 0


LONG = ["The first paragraph of it is long enough to weigh more than anything beside it on this page, by far.", "A second one follows the first and adds some more words to it, as articles do all the time.", "And a third one ends what was to be said here, with a last sentence that is of some length too."]
P3 = "".join(f"<p>{x}</p>" for x in LONG)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<div class='layout has-sidebar'><article><h1>Title</h1>{P3}</article></div>", ["Title", *LONG]),
        (f"<div class='page sidebar'><h1>Title</h1>{P3}</div>", ["Title", *LONG]),
        (f"<form action='/'><div><h1>Title</h1>{P3}</div></form>", ["Title", *LONG]),
        (f"<article><div class='article-header'><h1>Title</h1></div>{P3}<p class='alert'>Mind this.</p><blockquote class='social'>Quoted.</blockquote><div class='ad'>Buy</div></article>", ["Title", *LONG, "Mind this.", "Quoted."]),
        (f"<main><article><h1>Title</h1>{P3}</article><div>Read more of our stories on other days.</div></main>", ["Title", *LONG]),
        (f"<section>{P3}</section><section>{P3.replace('first', 'next')}</section><ul><li><a href='/a'>Home</a></li><li><a href='/b'>All news</a></li></ul>", [*LONG, *[x.replace("first", "next") for x in LONG]]),
        (f"<div id='s'><h1>Title</h1>{P3}</div><div><a href='/x'>One more</a> <a href='/y'>And more</a></div>", ["Title", *LONG]),
        (f"<article>{P3}</article><section class='comments'>{P3 * 5}</section><footer>{P3}</footer>", LONG),
        (f"<h1>Title</h1>{P3}<ul><li><a href='/a'>Home page</a></li><li><a href='/b'>All news</a></li></ul>", ["Title", *LONG]),
        (f"<article><h1>Title</h1>{P3}<p><a href='/z'>A paragraph that is one link</a></p><ul><li>x</li></ul><table><tr><td>1<td>2<tr><td>3</table></article>", ["Title", *LONG, "A paragraph that is one link", "x", "1", "2", "3"]),
    ],
)
def test_density_decides_and_names_are_weak(body, text):
    assert html_text.extract(f"<html><head><title>T</title></head><body>{body}</body></html>") == "\n".join(text)


@pytest.mark.parametrize("page", ["<a " * 66_000, "<b>" * 30_000 + "</i>" * 30_000, "<ul><li>" * 25_000, """<a ">" '>'""" * 20_000, "<div>" * 20_000 + "<li></li>" * 20_000, "<i><div>" + "<b>" * 25_000 + "</i>" * 25_000, "<p " * 60_000 + ">"])
def test_pages_take_time_in_proportion(page):
    def seconds(x):
        start = time.process_time()
        html_text.extract(x)
        return time.process_time() - start

    assert seconds(page) < 4 * seconds(page[: len(page) // 2]) + 1


def test_extraction_replaces_a_text_column(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "old")], "page_id long, url string, html string, text string")
    assert html_text.extract_text(df).collect()[0].asDict() == {"page_id": 1, "url": "u", "html": "<p>a</p>", "text": "a"}
    assert html_text.main_texts(df).columns == ["page_id", "url", "text", "n_chars"]


# 4 WARC


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "u\r\nX: 1", "small"), (5, "u", "small"), (None, "u", big), (7, "u", "é" * 600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(df, f"file://{tmp_path}", archive_bytes=300)
    assert archives.count() > 3
    out = {r["page_id"]: r for r in warc.read_records(warc.find_archives(spark, f"file://{tmp_path}/*.wacz")).collect()}
    assert len(out) == 7
    assert (out[2]["record_type"], out[1]["record_type"], out[1]["refers_to"], out[None]["refers_to"]) == ("response", "revisit", 2, 2)
    assert out[1]["payload_bytes"] == 2003 and out[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert out[4]["record_type"] == out[5]["record_type"] == "response" and out[4]["payload"] == b"small"
    assert out[3]["payload_bytes"] == 0 and bytes(out[7]["payload"]).decode() == "é" * 600
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("a", "b/c", "d"):
            z.writestr(name, name * 50)
        z.comment = b"PK a comment"
    found = warc.directory(data, len(data.getvalue()))
    assert set(found) == {"a", "b/c", "d"}
    assert warc._range(data, *warc.stored_range(data, found["b/c"])) == b"b/c" * 50
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"nothing"), 7)


# 7 language


def test_language_filters(spark):
    texts = {"en": "the cat sat on the mat and thought about the weather ", "de": "der hund lief über die straße und bellte die katze an ", "xx": "zuk mol tirra bakku zuk nolla "}
    rows = [(i, texts[k] * 3, k, "s", 0) for i, k in enumerate(["en", "de", "xx"] * 30)]
    rows += [(1000, None, "en", "s", 0), (1001, "123 !?", None, "s", 0), (1002, "漢字", "en", "s", 0), (1003, "", "de", "s", 0)]
    out = {r["doc_id"]: r for r in language.languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i]["lang_pred"] == k for i, k in enumerate(["en", "de", "xx"] * 30))
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1003)] == ["und"] * 3 and out[1002]["lang_pred"] in texts
    assert all(0 <= r["score"] <= 1 for r in out.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    nothing = spark.createDataFrame([(1, "abc", None, "s", 0)], SCHEMA)
    assert language.languages(nothing).first()["lang_pred"] == "und" and language.languages(nothing.limit(0)).count() == 0


def test_grams_stay_within_texts():
    packed, at = language.grams(pa.array(["abcd", None, "", "ef"]))
    apart = [language.grams(pa.array([x]))[0] for x in ("abcd", None, "", "ef")]
    assert packed.tolist() == np.concatenate(apart).tolist() and np.diff(at).tolist() == [len(x) for x in apart]


def test_jaccard_groups_ask_for_a_second_band_and_ship_texts(spark):
    rows = [(1, [1, 2, 3]), (2, [1, 2, 9]), (3, [3, 7, 8]), (4, [5, 7, 6])]  # 3 and 4 share one band each with others, by chance
    known = spark.createDataFrame([(i, 10, [i], bands) for i, bands in rows], "id long, n_shingles long, low array<long>, bands array<long>")
    found = jaccard._groups(known, known.select("id")).collect()
    assert {r["id"] for r in found} == {1, 2} and len({r["grp"] for r in found}) == 1  # all four before

    texts = {1: "One two three four five six", 2: "a b c d " * 5000, 3: "", 4: None, 5: "x"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    sent = jaccard._texts_or_sets(docs, docs.select("id"), 4).orderBy("id").toArrow()
    assert [x is None for x in sent["text"].to_pylist()] == [False, True, False, True, False]  # a long text of few tokens goes as its set
    assert [x is None for x in sent["tokens"].to_pylist()] == [True, False, True, True, True]
    assert [x.tolist() for x in jaccard._token_sets_of(sent, 4)] == [x.tolist() for x in jaccard.token_sets(pa.array([texts[i] for i in sent["id"].to_pylist()]), 4)]


def test_language_memory_follows_blocks_not_batches(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij éß"), rng.integers(1, 9))) for _ in range(3000)]
    texts = [None if k % 11 == 0 else " ".join(rng.choice(words, rng.integers(0, 400))) for k in range(300)]
    whole, at = language.grams(pa.array(texts))
    filters = language.LanguageFilters.of({"x": np.unique(whole[::2]), "y": np.unique(whole[::3])}, "x")
    told, scores = filters.predict(pa.array(texts))
    monkeypatch.setattr(language, "BLOCK", 64)  # blocks end within texts and words
    again, at_again = language.grams(pa.array(texts))
    assert again.tolist() == whole.tolist() and at_again.tolist() == at.tolist()
    told_again, scores_again = filters.predict(pa.array(texts))
    assert told_again == told and scores_again.tolist() == scores.tolist()
    monkeypatch.undo()

    many = pa.array([" ".join(rng.choice(words, 700)) for _ in range(2000)])  # one batch of the pipeline, about 7 MB
    size = many.get_total_buffer_size()

    def peak(run):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(lambda: language.grams(many)) < 10 * size  # bytes for each byte of text: 5, and 17 before
    batch = pa.RecordBatch.from_arrays([many, pa.array(["x", "y"] * 1000)], ["text", "lang"])
    counted = {}

    def count():
        for part in language.counted([batch]):
            for lang, gram, n in zip(*(part[c].to_pylist() for c in ("lang", "gram", "n"))):
                assert (lang, gram) not in counted  # one row for each n-gram of a batch
                counted[lang, gram] = n

    assert peak(count) < 8 * size  # 2, and 18 before
    packed, starts = language.grams(many)
    keys, sums = np.unique(packed[starts[0] : starts[1]], return_counts=True)
    assert sum(counted.values()) == len(packed) and all(counted["x", int(k)] >= s for k, s in zip(keys, sums))


def test_languages_of_the_held_out_documents(spark):
    """Accuracy on the rows that nothing was learned from, by their labels."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(told) > 200 and sum(r["lang"] == r["lang_pred"] for r in told) >= 0.98 * len(told)


def test_more_languages_than_a_word_holds():
    """100 languages of made-up syllables; the counts equal those of exact sets, but for false positives of the filters."""
    rng = np.random.default_rng(8)
    syllables = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)] for _ in range(100)]
    text = lambda k, n: " ".join(a + b for a, b in rng.choice(syllables[k], (n, 2)))
    learned = {f"l{k:03d}": np.unique(language.grams(pa.array([text(k, 400)]))[0]) for k in range(100)}
    filters = language.LanguageFilters.of(learned, "l000")
    texts = [text(k, 20) for k in range(100)]
    told, score = filters.predict(pa.array(texts))
    exact = [max(sorted(learned), key=lambda name: np.isin(language.grams(pa.array([t]))[0], learned[name]).sum()) for t in texts]
    assert len(filters.tables) == 2 and told == exact == sorted(learned) and (score > 0.3).all()


def test_training_keeps_rare_languages(spark):
    rows = [(i, "alpha beta gamma delta", "xx", "s", 0) for i in range(2000)] + [(9000 + i, "zuk mol tirra bakku", "yy", "s", 0) for i in range(4)]
    filters = language.train(spark.createDataFrame(rows, SCHEMA), train_rows=100)
    assert filters.languages == ["xx", "yy"] and filters.predict(pa.array(["mol tirra"]))[0] == ["yy"] and filters.common == "xx"


def test_languages_of_odd_tables(spark):
    """Ties go to the first name; repeated rows, null ids and columns of the results' names."""
    assert language.LanguageFilters.of({"b": np.array([1], np.uint32), "a": np.array([1], np.uint32)}, "a").languages == ["a", "b"]
    df = spark.createDataFrame([(1, "abcd abcd", "b"), (1, "abcd abcd", "a"), (None, "abcd", "a"), (1, "abcd abcd", "a")], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    out = language.languages(df).collect()
    assert len(out) == 4 and {r["lang_pred"] for r in out} == {"a"}
    told = language.identify(df, language.train(df))
    assert told.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and told.count() == 4


# 8 contamination


def test_containment_equals_brute_force(spark):
    item = words(1, 30)
    other = words(2, 6)
    docs = [" ".join(words(10, 200) + item + words(11, 200)), " ".join(item[:26]), " ".join(item[:20]), " ".join(words(5, 40)), None, "", " ".join(item).upper() + "!", " ".join(other), "two words"]
    df = documents(spark, docs)
    items = spark.createDataFrame([(1, " ".join(item)), (2, ", ".join(other)), (3, None), (4, "Two  words."), (5, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["containment"], 6) for r in contamination.contained_items(df, items).collect()}
    assert got == {(0, 1): 1.0, (0, 5): 1.0, (1, 1): round(22 / 26, 6), (1, 5): round(22 / 26, 6), (6, 1): 1.0, (6, 5): 1.0, (7, 2): 1.0, (8, 4): 1.0}
    assert sorted(r["doc_id"] for r in contamination.decontaminate(df, items).collect()) == [2, 3, 4, 5]
    assert contamination.contained_items(df, items.limit(0)).count() == 0 and contamination.contained_items(df.limit(0), items).count() == 0


def test_contamination_of_odd_tables(spark):
    """Each row is judged by its own text, whatever its id; clashing columns, a very long text."""
    item = " ".join(words(31, 20))
    rows = [(1, item), (1, "clean"), (None, item), (None, "clean too"), (2, " ".join(words(32, 100_000)) + " " + item), (3, None), (3, item.upper()), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "item", "key1", "h", "words", "overlap"):
        df = df.withColumn(name, F.lit("x"))
    items = spark.createDataFrame([(7, item, 1), (7, "some other item of some words", 1), (None, "clean", 1)], "item_id long, text string, doc_id long")
    left = contamination.decontaminate(df, items)
    assert left.columns == df.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, "clean too"), (1, "clean"), (3, ""), (4, "")]
    assert {(r["doc_id"], r["item_id"], r["overlap"]) for r in contamination.contained_items(df, items).collect()} == {(1, 7, 16), (2, 7, 16), (3, 7, 16)}


# 9 Jaccard


def brute_components(texts, n, percent):
    w = Words()
    sets = {i: set(shingles(w.hashes(t), n).tolist()) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("wide", "group"), [(64, 256), (2, 5)])
def test_jaccard_equals_brute_force(spark, monkeypatch, wide, group):
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "GROUP_DOCS", group)
    rng = np.random.default_rng(7)
    texts = ["", None, "one", "One two", "one two", "a b c d e f g", "a b c d e f h", " ".join(words(3, 40))] * 2
    for base in range(6):
        text = words(100 + base, int(rng.integers(20, 150)))
        for _ in range(12):
            copy = list(text)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 5))):
                copy[at] = "z%d" % rng.integers(0, 1000)
            texts.append(" ".join(["common", "line", "of", "all", "the", "documents", "here"] + copy))
    texts += [" ".join(["common", "line", "of", "all", "the", "documents", "here", *words(i, 8)]) for i in range(30)]
    expected = brute_components(dict(enumerate(texts)), 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, texts), n=4, percent=85).collect()}
    assert got == expected
    assert len({c for _, c in got.values()}) < len(texts) - 20


def test_jaccard_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (1, "q r s t u v", "z"), (2, "q r s t u v", "w")], "doc_id long, text string, rep string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(df, n=4, percent=85).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    assert sorted((str(r["doc_id"]) for r in jaccard.one_of_each(df).collect())) == ["1", "1"]  # rows with a null id are judged by their texts


def test_one_of_each_judges_rows_by_their_texts(spark):
    """Repeated and null ids, equal rows, texts without words, clashing columns."""
    x, y = " ".join(words(41, 60)), " ".join(words(42, 60))
    near = x + " more"
    rows = [(1, x), (5, near), (5, y), (None, near + " still"), (None, "lonely text of its own"), (6, y), (7, None), (8, None), (9, ""), (5, y), (2, " ".join(words(43, 9)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("__gone", F.lit(3))
    left = jaccard.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted([(1, x), (5, y), (0, "lonely text of its own"), (7, ""), (8, ""), (9, ""), (2, rows[-1][1])])
    assert jaccard.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [40, 80])
def test_opened_pairs_grow_with_the_groups_not_their_pairs(spark, monkeypatch, size):
    """One template with a word changed in each copy, cut into groups of five, and some copies that are too far from the others: leaders tie the groups together, so no pair of groups within a component is opened."""
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 5)
    base = words(55, 150)
    texts = [" ".join([*base[: i % 140], f"copy{i}", *base[i % 140 + 1 :]]) for i in range(size)] + [" ".join([*base[:60], *words(600 + i, 90)]) for i in range(4)]
    opened = []
    inner = jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda *args: opened.append(inner(*args)) or opened[-1])
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    out = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(documents(spark, texts)).collect()}
    assert out == {i: c for i, (_, c) in brute_components(dict(enumerate(texts)), 5, 80).items()}
    assert opened[0].count() <= 4 * size / 5  # the four others with each group; all pairs of groups would be size / 5 times as many


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


# 1 passages


def test_compact_windows_cover_every_subsequence():
    rng = np.random.default_rng(1)
    for hashes in (rng.integers(0, 1 << 60, 200).astype(np.uint64), rng.integers(0, 6, 150).astype(np.uint64), np.zeros(60, np.uint64)):
        width = 10
        cs, ps, qs = passages.compact_windows(hashes, width)
        places = {}
        for c, p, q in zip(cs, ps, qs):
            for x in range(p, q + 1):
                assert x not in places
                places[x] = hashes[c]
        assert places == {x: hashes[x : x + width].min() for x in range(len(hashes) - width + 1)}


def test_joint_signatures_equal_brute_force():
    rng = np.random.default_rng(2)
    keys, spans, fns = [], [], []
    for fn in range(passages.HASHES):
        cuts = np.sort(rng.choice(200, 12, replace=False))
        for a, b in zip(cuts[::2], cuts[1::2]):
            keys.append(rng.integers(0, 1 << 62))
            spans.append((a, b))
            fns.append(fn)
    keys, ps, qs, fns = np.array(keys, np.uint64), np.array([s[0] for s in spans]), np.array([s[1] for s in spans]), np.array(fns)
    with np.errstate(over="ignore"):
        brute = {int(mixed(keys[i : i + 1])[0] + keys[j]) & (2**64 - 1) for i in range(len(keys)) for j in range(len(keys)) if fns[i] < fns[j] and ps[i] <= qs[j] and ps[j] <= qs[i]}
    assert set(passages.joint_signatures(keys, ps, qs, fns).tolist()) == brute


def test_repeated_passages(spark):
    passage, near = words(1, 60), words(2, 80)
    changed = near[:40] + ["changed"] + near[41:]
    texts = [" ".join(words(10, 100) + passage + words(11, 30)), " ".join(words(12, 7) + passage), " ".join(words(13, 300)), " ".join(near + words(14, 50)), " ".join(words(15, 50) + changed), " ".join(passage[:40]), None, "", "same line again\n" * 100, "same line again\n" * 90]
    out = passages.repeated_passages(documents(spark, texts)).collect()
    assert {r["doc_id"] for r in out} == {0, 1, 3, 4, 8, 9}
    first = next(r for r in out if r["doc_id"] == 0)
    assert (first["start_word"], first["end_word"], first["other_id"], first["other_start"], first["jaccard"]) == (100, 160, 1, 7, 1.0)
    assert any(r["doc_id"] == 3 and r["other_id"] == 4 and r["end_word"] - r["start_word"] >= 78 for r in out)
    assert passages.repeated_passages(documents(spark, texts).limit(0)).count() == 0


def test_passages_beside_a_partial_hub(spark):
    """A line of the smallest ids that ends short of a passage must not hide the passage of the others."""
    for seed in range(4):
        passage = words(100 + seed, 50)
        texts = [" ".join([*words(1000 * seed + i, 40), *(passage[:44] if i < 3 else passage), *words(2000 * seed + 7 + i, 40)]) for i in range(6)]
        found = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(documents(spark, texts)).collect()}
        assert {i for i, _ in found} == {3, 4, 5}


def every_repeat(texts, n=passages.MIN_WORDS):
    """For each text, the starts of runs of n words that another text has."""
    runs = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in ((t or "").lower().split() for t in texts)]
    owners = {}
    for i, found in enumerate(runs):
        for run in found:
            owners.setdefault(run, set()).add(i)
    return [{k for k, run in enumerate(found) if len(owners[run]) > 1} for found in runs]


def uncovered(texts, rows, n=passages.MIN_WORDS):
    """Starts of repeated runs that no found passage of their text holds."""
    wanted = every_repeat(texts)
    for r in rows:
        wanted[r["doc_id"]] -= set(range(r["start_word"], r["end_word"] - n + 1))
    return [w for w in wanted if w]


def test_a_passage_whose_half_stands_twice(spark):
    passage = words(77, 90)
    texts = [" ".join(passage), " ".join([*words(78, 30), *passage[:45], *words(79, 60), *passage, *words(80, 20)])]
    rows = passages.repeated_passages(documents(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == {0, 1} and not uncovered(texts, rows)


@pytest.mark.parametrize("hub", [False, True])
def test_a_further_row_hides_no_exact_repeat(spark, hub):
    passage = words(177, 50)
    changed = [*passage[:17], "x1", *passage[18:33], "x2", *passage[34:]]
    texts = [" ".join([*words(180 + i, 40), *p, *words(190 + i, 40)]) for i, p in enumerate([changed if hub else words(999, 50), passage, passage])]
    rows = passages.repeated_passages(documents(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} >= {1, 2} and not uncovered(texts, rows)


def test_every_exact_repeat_lies_in_a_passage(spark):
    """Texts pasted together from overlapping pieces of a few sources, with edits: near copies, hubs and repeats beside each other; and all documents of the small table."""
    rng = np.random.default_rng(41)
    sources, texts = [words(500 + k, 400) for k in range(6)], []
    for _ in range(150):
        text = []
        for _ in range(int(rng.integers(1, 5))):
            piece = sources[rng.integers(6)]
            i = int(rng.integers(0, 340))
            part = list(piece[i : i + int(rng.integers(30, 130))])
            for k in rng.integers(0, len(part), int(rng.integers(0, 4))):
                part[k] = "edit%d" % rng.integers(1000)
            text += [*part, *words(int(rng.integers(1 << 30)), int(rng.integers(0, 40)))]
        texts.append(" ".join(text))
    rows = passages.repeated_passages(documents(spark, texts)).collect()
    assert sum(map(len, every_repeat(texts))) > 1000 and not uncovered(texts, rows)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = [r["text"] for r in table.orderBy("doc_id").collect()]
    ids = {r["doc_id"]: i for i, r in enumerate(table.orderBy("doc_id").collect())}
    rows = [r.asDict() | {"doc_id": ids[r["doc_id"]]} for r in passages.repeated_passages(table).collect()]
    assert rows and not uncovered(given, rows)


def test_passages_of_odd_tables(spark):
    """Null and repeated ids, columns that clash with inner names, and a very long text."""
    passage, long_one = " ".join(words(1, 60)), " ".join(words(2, 120_000))
    rows = [(None, passage), (1, passage), (1, "other " + passage), (2, passage), (3, long_one), (4, long_one), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "key", "place", "signature", "a", "words", "slice"):
        df = df.withColumn(name, F.lit(1))
    out = passages.repeated_passages(df).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3, 4} and all(r["other_id"] != r["doc_id"] for r in out)
    assert any((r["doc_id"], r["start_word"], r["end_word"], r["other_id"]) == (3, 0, 120_000, 4) for r in out)


def test_similar_parts_of_a_failing_run_equal_brute_force():
    """A passage of one changed word between template text in which every eighth word differs, in random variants, against all windows."""
    width = passages.MIN_WORDS - passages.SHINGLE + 1
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 1 << 32, 300).astype(np.uint32)
        y = x.copy()
        y[4:100:8] += 1
        y[204:300:8] += 1
        y[[146, 146 + 5 * seed]] += 1
        for left, right in ((x, y), (y, x), (x, np.delete(y, 120))):
            a, b = (shingles(t.astype(np.uint64), passages.SHINGLE).tolist() for t in (left, right))
            place = {h: j for j, h in enumerate(b)}
            hits = [i for i, h in enumerate(a) if h in place]
            brute = set()
            for n, i in enumerate(hits):
                for m, k in enumerate(hits[n:], 1):
                    if k + 1 - i >= width and m / (k + 1 - i + place[a[k]] + 1 - place[a[i]] - m) >= passages.SIMILARITY:
                        brute.update(range(i, k + 1))
            found = passages.similar_passages(left, right)
            assert brute and set().union(*(range(s, e - passages.SHINGLE + 1) for s, e, *_ in found)) == brute


def test_recall_of_passages_at_the_threshold(spark):
    """Pairs of passages of similarity 0.804 (one changed word of 50), against a brute force that compares each pair on the words."""
    texts, n = [], 400
    for k in range(n):
        passage = words(3000 + k, 50)
        changed = [*passage[:25], f"changed{k}", *passage[26:]]
        texts += [" ".join(words(5000 + 2 * k + side, 30) + p + words(7000 + 2 * k + side, 30)) for side, p in enumerate((passage, changed))]
    assert all(passages.similar_passages(*(Words().hashes(t).astype(np.uint32) for t in texts[2 * k : 2 * k + 2])) for k in range(n))
    found = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(documents(spark, texts)).collect()}
    assert len(found & {(2 * k, 2 * k + 1) for k in range(n)}) >= 0.95 * n


# 6 secrets


def test_secrets(spark):
    hexes = hashlib.sha1(b"x").hexdigest()
    texts = [f'some text token = "{hexes}" and more', f"git commit {hexes} fixed it", "the wonderful_compound_name_2024 is no secret", None, "", f"API_KEY: {hexes.upper()}", "password = example-token-1234", "4785380592391139 is a number"]
    found = secret_scan.scan(documents(spark, texts), secret_scan.labelled_examples(spark), path_col="source")
    rows = {r["doc_id"]: r for r in found.collect()}
    assert set(rows) == {0, 5} and rows[0]["secret"] == hexes and texts[0][rows[0]["start"] - 1 :].startswith(hexes)
    assert secret_scan.candidates(documents(spark, texts).limit(0)).count() == 0


def test_secrets_at_each_place(spark):
    """A secret twice in a text, after a checksum's name first, and as part of an earlier longer run."""
    value = hashlib.sha1(b"y").hexdigest()
    texts = [f'é😀 token = "{value}" and\ntoken = "{value}" end', f'checksum sha256 {value} and later token = "{value}"', f'run x{value}y then token = "{value}"']
    places = [(i, m.start() + 1) for i, t in enumerate(texts) for m in re.finditer(rf"(?<![a-z0-9]){value}(?![a-z0-9])", t)]
    rows = {(r["id"], r["start"]): r for r in secret_scan.candidates(documents(spark, texts)).collect() if r["value"] == value}
    assert sorted(rows) == places and len(rows) == 5
    assert all(texts[i][: s - 1].endswith(r["before"]) and texts[i][s - 1 + len(value) :].startswith(r["after"]) for (i, s), r in rows.items())
    found = {(r["doc_id"], r["start"]) for r in secret_scan.scan(documents(spark, texts), secret_scan.labelled_examples(spark)).collect() if r["secret"] == value}
    assert found == set(places) - {places[2]}


def test_secrets_of_odd_tables(spark):
    """An empty table, null ids, repeated rows, clashing columns; a probability of exactly the bound is kept."""
    value = hashlib.sha1(b"z").hexdigest()
    df = spark.createDataFrame([(None, f'token = "{value}"'), (1, f'token = "{value}"'), (1, f'token = "{value}"'), (2, None)], "doc_id long, text string")
    for name in ("value", "start", "path", "before", "key", "label", "probability", "word"):
        df = df.withColumn(name, F.lit("x"))
    labelled = secret_scan.labelled_examples(spark)
    rows = secret_scan.scan(df, labelled).collect()
    assert [r["doc_id"] for r in rows].count(1) == 2 and len(rows) == 3
    assert len(secret_scan.scan(df, labelled, keep=rows[0]["probability"]).collect()) == 3
    assert secret_scan.scan(df.limit(0), labelled).count() == 0


def test_secrets_by_hand(spark):
    """Lines written by hand, not by the rules that label the training rows: precision and recall over all candidates."""
    from labelled_lines import OTHERS, SECRETS

    lines = [(i, line, value, label) for i, (line, value, label) in enumerate([(a, b, 1) for a, b in SECRETS] + [(a, b, 0) for a, b in OTHERS])]
    found = {(r["doc_id"], r["secret"]) for r in secret_scan.scan(spark.createDataFrame([(i, line) for i, line, *_ in lines], "doc_id long, text string"), secret_scan.labelled_examples(spark)).collect()}
    hit = sum(any(i == j and (v in value or value in v) for j, v in found) for i, _, value, label in lines if label)
    wrong = len({i for i, _ in found} & {i for i, *_, label in lines if not label})
    print("secrets found", hit, "of", len(SECRETS), "wrong", wrong, "of", len(OTHERS))
    assert hit >= 0.7 * len(SECRETS) and hit / (hit + wrong) >= 0.7


# 10 licences


def test_licenses(spark):
    rows = [("/a/LICENSE", "Released under the MIT License."), ("/a/x.py", "print(1)"), ("/a/b/c/y.py", None), ("/a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0. Copyright."), ("/a/b/z.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"), ("/q/w.py", "we licensed a car"), (None, "MIT License"), ("/a/x.py", "print(1)")]
    files = spark.createDataFrame(rows, "path string, text string")
    out = {r["path"]: r for r in license_scan.scan(files, license_scan.template_table(spark)).collect()}
    assert {p: (r["license_id"], r["how"]) for p, r in out.items()} == {
        "/a/LICENSE": ("MIT", "direct"), "/a/x.py": ("MIT", "inherited"), "/a/b/c/y.py": ("Apache-2.0", "inherited"), "/a/b/LICENSE.txt": ("Apache-2.0", "direct"), "/a/b/z.py": ("GPL-3.0", "direct"), "/q/w.py": (None, "none"),
    }
    assert out["/a/b/c/y.py"]["from_path"] == "/a/b/LICENSE.txt"
    assert license_scan.scan(files.limit(0), license_scan.template_table(spark)).count() == 0


def test_full_texts_headers_and_several_licenses(spark):
    from docspark.llm import license_texts

    known = license_texts.templates()
    assert all(re.search(license_scan.STATEMENT, text.lower()) for _, text in known)
    full = {k: max((t for s, t in known if s == k), key=len) for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib")}
    header = max((t for s, t in known if s == "GPL-3.0-or-later"), key=len)
    only = header.replace("either version 3 of the License, or (at your option) any later version", "version 3 of the License")
    wrapped = lambda text, mark: "\n".join(f"{mark} {line}" for line in re.findall(r".{1,70}(?: |$)", text.replace("\n", " ")))
    rows = [(f"/{k}/LICENSE", "Copyright (c) 2024 Someone\n\n" + text) for k, text in full.items()]
    rows += [("/g/a.c", wrapped(header, " *") + "\n\nint main;"), ("/g/b.py", wrapped(only, "#") + "\n\nx = 1"), ("/w/c.txt", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.")]
    rows += [("/m/x.c", "// Licensed under the MIT License.\n\n// The rest:\n\n" + next(t for s, t in known if s == "Apache-2.0" and len(t) > 300)), ("/s/x.rs", "// SPDX-License-Identifier: MPL-2.0\nfn main() {}"), ("/n/long.txt", "license " * 50_000), ("/n/LICENSE-0", None)]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("block", F.lit(1)).withColumn("license_id", F.lit("x"))
    out = {r["path"]: r for r in license_scan.scan(files, license_scan.template_table(spark)).collect()}
    assert {p: r["license_id"] for p, r in out.items() if r["how"] == "direct"} == {**{f"/{k}/LICENSE": k for k in full}, "/g/a.c": "GPL-3.0-or-later", "/g/b.py": "GPL-3.0", "/w/c.txt": "GPL-3.0", "/m/x.c": "MIT", "/s/x.rs": "MPL-2.0"}
    assert out["/m/x.c"]["license_ids"] == ["Apache-2.0", "MIT"] and out["/n/long.txt"]["how"] == "none"


# Queries and the pipeline


def test_stages_on_odd_tables(spark, tmp_path):
    """All stages but the last, and the last, on repeated ids, null ids, nulls, an empty table and further columns."""
    import corpus_pipeline

    item = " ".join(words(61, 30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    x = " ".join(words(62, 60))
    rows = [(1, x), (1, x.upper()), (5, x + " more"), (5, "another text"), (None, item), (None, "kept text"), (7, None), (8, ""), (9, "123"), (5, "one " + item)]
    learned = {(i, text) for i, text in zip(range(20, 24), ("some words", "to learn from", "and a few", "more of them"))}
    rows += sorted(learned)
    df = spark.createDataFrame([(i, t, "en", "s", 0, "extra") for i, t in rows], SCHEMA + ", ids string")
    for docs, expected in ((df, {(1, x), (5, "another text"), (None, "kept text")} | learned), (df.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, stage(spark, docs, str(tmp_path))
            assert name == "bpe_tokens" or docs.columns == before
        assert {(r["doc_id"], r["text"]) for r in docs.collect()} == expected and docs.where("n_tokens <> size(ids)").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    import regex
    import tiktoken

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    texts, seen = {}, set()
    for r in rows:
        norm = (r["text"] or "").encode().lower()
        if r["text"] and regex.search(r"\p{L}", r["text"]) and norm not in seen:
            seen.add(norm)
            texts[r["doc_id"]] = r["text"]
    texts = {i: texts[i] for i, (_, c) in brute_components(texts, 5, 80).items() if c == i}

    def five(text):
        w = [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    parts = [s for s in map(five, items) if s]
    texts = {i: t for i, t in texts.items() if not any(len(s & five(t)) >= 0.8 * len(s) for s in parts)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in texts.items()}


def test_jaccard_drops_its_token_tables(spark):
    """Heads and prefixes are the largest tables; neither is left when the result is read."""
    from docspark import scratch

    before = set(scratch._folders)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join([*words[i % 3 : i % 3 + 200], f"x{i // 6}"])) for i in range(12)] + [(99, " ".join(words[::-1]))], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    left = [p for p in set(scratch._folders) - before if "jaccard-heads" in p or "jaccard-prefixes" in p or "jaccard-unions" in p]
    assert not left and found[99] == 99 and {found[i] for i in range(12)} == {0}


def test_passages_of_texts_without_repeats_are_counted_alike():
    import numpy as np

    rng = np.random.default_rng(5)
    for k in range(60):
        a = rng.integers(1, 1 << 40, 400).astype(np.uint64)
        b = np.concatenate([a[200:], a[:190]]) if k % 3 == 0 else np.delete(a, rng.integers(0, 400, 1 + k))
        assert passages._found(a, b, passages.Places(b), 46, 0.8, True) == passages._found(a, b, passages.Places(b), 46, 0.8, False)


def test_short_pieces_merge_as_the_tree_does(monkeypatch):
    import random

    draw = random.Random(3)
    ranks = {bytes([c]): i for i, c in enumerate(b"abcd")}
    for size in (2, 2, 3, 3, 4, 5):
        for _ in range(12):
            ranks.setdefault(bytes(draw.choices(b"abcd", k=size)), len(ranks))
    pieces = [bytes(draw.choices(b"abcd", k=draw.randint(1, 90))) for _ in range(400)]
    short = [bpe.encode_piece(p, ranks) for p in pieces]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert short == [bpe.encode_piece(p, ranks) for p in pieces]


def test_pipeline_bounds_its_batches(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, then in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            spark.conf.set(key, given)
            corpus_pipeline.tokenised(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)
