"""Profiles, models, generation, validation, enums, tides, sources and the client on small tables."""

import json
import math
from datetime import datetime as D

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from docspark import prompts, samples
from docspark.client import Client
from docspark.functions import enums, generate, model, profile, validate
from docspark.sources import files
from docspark.streaming import tides


@pytest.fixture(scope="module")
def things(spark):
    rows = [(i, f"AB-{100 + i % 5}", float(i * 10) if i % 4 else None, i % 3 == 0, ["x", "y"][: i % 3]) for i in range(40)]
    return spark.createDataFrame(rows, "k int, code string, price double, flag boolean, tags array<string>")


def test_inference(things):
    m = model.infer(things)
    p = m["properties"]
    assert m["required"] == ["code", "flag", "k", "tags"]
    assert (p["k"]["type"], p["k"]["minimum"], p["k"]["maximum"]) == ("integer", 0, 39)
    assert p["price"]["multipleOf"] == 10 and p["price"]["histogram"]["totalCount"] == 30
    assert p["code"]["pattern"] == profile.PATTERNS[0] and p["code"]["enum"] == ["AB-100", "AB-101", "AB-102", "AB-103", "AB-104"]
    assert p["tags"]["minItems"] == 0 and p["tags"]["maxItems"] == 2
    assert p["code"]["stringModel"]["patterns"] == {"U{2}pd{3}": 40}
    json.dumps(m)


def test_always_null_fields_are_unknown(spark):
    m = model.infer(spark.createDataFrame([(1, None)], "a int, b string"))
    assert list(m["properties"]) == ["a"] and m["required"] == ["a"]
    assert model.infer(spark.createDataFrame([], "a int"))["properties"] == {}


def test_histogram_of_a_constant_and_of_few_numbers(spark):
    one = profile.histogram(spark.createDataFrame([(5.0,)] * 12, "v double"), "v").collect()
    assert [(r["n"], r["freq_start"], r["freq_end"]) for r in one] == [(12, 0.0, 100.0)]
    assert profile.histogram(spark.createDataFrame([(5.0,)] * 9, "v double"), "v").count() == 0


@pytest.mark.parametrize(("text", "fmt"), [("a@b.co", "email"), ("https://x.org/a", "uri"), ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("2024-01-01T00:00:00Z", "date-time"), ("2024-01-01", "date"), ("12:00:00", "time"), ("10.0.0.255", "ipv4"), ("10.0.0.256", None), ("1:2:3:4:5:6:7:8", "ipv6"), ("x", None)])
def test_formats(spark, text, fmt):
    assert profile.format_of(spark.createDataFrame([(text,)], "v string"), ["v"]).first()["format"] == fmt


def test_shapes(spark):
    out = spark.createDataFrame([("Ab1 c-99",), ("",)], "v string").select(profile.shape(F.col("v"))).collect()
    assert [r[0] for r in out] == ["ULdsLpd{2}", ""]


def test_character_entropy(spark):
    out = [r[0] for r in spark.createDataFrame([("aabb",), ("aaaa",), ("",)], "v string").select(profile.character_entropy(F.col("v"))).collect()]
    assert out == [1.0, 0.0, 0.0]


def test_merge_equals_the_model_of_the_union(things):
    a, b = model.infer(things.where("k < 20")), model.infer(things.where("k >= 20"))
    merged, whole = model.merge(a, b)["properties"], model.infer(things)["properties"]
    for key in ("minimum", "maximum", "multipleOf", "count", "present"):
        assert merged["price"][key] == whole["price"][key]
    for key in ("characterFrequency", "valueFrequency", "totalSamples", "minLength", "entropyScore", "patterns"):
        assert merged["code"]["stringModel"][key] == whole["code"]["stringModel"][key]
    assert merged["price"]["histogram"]["totalCount"] == 30
    assert merged["price"]["histogram"]["standardDeviation"] == pytest.approx(whole["price"]["histogram"]["standardDeviation"], rel=0.1)


def test_merge_of_different_types_keeps_both():
    merged = model.merge({"type": "integer", "minimum": 1, "maximum": 2}, {"type": "string", "minLength": 1, "maxLength": 4})
    assert [b["type"] for b in merged["anyOf"]] == ["integer", "string"]
    assert model.merge(None, {"type": "string"}) == {"type": "string"}


def test_generation_doesnt_depend_on_partitions(spark, things):
    m = model.infer(things)
    a = generate.generate(spark, m, 200, seed=9).orderBy("_id").collect()
    b = generate.generate(spark, m, 200, seed=9, rows=spark.range(0, 200, 1, 7).repartition(3)).orderBy("_id").collect()
    assert a == b
    assert a != generate.generate(spark, m, 200, seed=10).orderBy("_id").collect()


def test_generated_documents_are_valid(spark, things):
    m = model.infer(things)
    report = validate.sample_report(generate.generate(spark, m, 300, seed=2), m)
    assert report["rate"] == 1.0 and report["n"] == 300
    again = model.infer(generate.generate(spark, m, 300, seed=2))["properties"]
    assert again["k"]["minimum"] >= 0 and again["k"]["maximum"] <= 39


@pytest.mark.parametrize("entropy", [0.0, 0.6, 1.0])
def test_entropy_levels_keep_lengths(spark, entropy):
    m = {"properties": {"s": {"type": "string", "minLength": 2, "maxLength": 6, "stringModel": model.string_model(spark.createDataFrame([("ab12", 1), ("Xy", 1), ("q-9zzz", 1)], "value string, n long"), {"min_length": 2, "max_length": 6, "average_length": 4.0, "n": 3, "n_distinct": 3})}}, "required": ["s"]}
    out = [r["s"] for r in generate.generate(spark, m, 100, seed=1, entropy=entropy).collect()]
    assert all(2 <= len(s) <= 6 for s in out)
    assert entropy or set(out) <= {"ab12", "Xy", "q-9zzz"}


def test_constraints_narrow_the_model(spark, things):
    m = model.infer(things)
    query = {"k": {"$gt": 10, "$lte": 20}, "code": {"$in": ["AB-101", "AB-102"]}, "new": "v", "price": {"$gte": 50}, "flag": {"$ne": True}}
    rows = generate.generate(spark, m, 200, query={**query, "$seed": 4}).collect()
    assert all(10 < r["k"] <= 20 and r["code"] in ("AB-101", "AB-102") and r["new"] == "v" and r["price"] >= 50 for r in rows)


@pytest.mark.parametrize("fmt", ["email", "uri", "uuid", "date-time", "date", "time", "ipv4", "ipv6"])
def test_generated_formats(spark, fmt):
    out = generate.generate(spark, {"properties": {"x": {"type": "string", "format": fmt}}, "required": ["x"]}, 50)
    assert profile.format_of(out, ["x"]).first()["format"] == fmt


@pytest.mark.parametrize("pattern", [r"^[A-Z]{2,4}-\d{3,5}$", r"^\d{3}-\d{3}-\d{4}$", r"^[a-f0-9]+x?$"])
def test_generated_patterns(spark, pattern):
    out = generate.generate(spark, {"properties": {"x": {"type": "string", "pattern": pattern}}, "required": ["x"]}, 50)
    assert out.where(~F.col("x").rlike(pattern)).count() == 0


def test_impossible_models_are_refused(spark):
    for bad in ({"minimum": 3, "maximum": 1}, {"multipleOf": 0}, {"enum": []}, {"minLength": -1}, {"histogram": {"bins": []}}):
        with pytest.raises(ValueError):
            generate.generate(spark, {"properties": {"x": {"type": "integer", **bad}}}, 1)


def test_outliers(spark, things):
    m = model.infer(things)
    rows = spark.createDataFrame([(5, "AB-100", 100.0), (5000, "AB-100", 100.0), (5, "completely different €", None)], "k int, code string, price double")
    out = validate.score(rows, m).collect()
    assert [bool(r["outliers"]) for r in out] == [False, True, True]
    assert out[0]["valid"] and not out[1]["valid"]
    assert {o["field_type"] for o in out[2]["outliers"]} == {"string"}


def test_sample_errors(spark):
    m = {"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "string", "enum": ["x"]}, "c": {"type": "string", "format": "email"}}}
    rows = spark.createDataFrame([(1.0, "x", "a@b.co"), (2.5, "y", "q"), (None, None, None)], "a double, b string, c string")
    assert [r["errors"] for r in validate.check_samples(rows, m).collect()] == [["a: minimum"], ["a: type", "b: enum", "c: format"], ["a: required"]]


def test_enum_rules(spark):
    days = spark.createDataFrame([(d,) for d in ["Monday", "Tuesday", "Friday"] * 10], "v string")
    assert enums.detect(days, "v").first()["kind"] == "standard_set"
    unique = spark.createDataFrame([(f"word number {i}",) for i in range(50)], "v string")
    assert not enums.detect(unique, "v").first()["is_enum"]
    assert enums.patterns(spark.createDataFrame([("abcX",), ("abcY",)], "v string"), "v").first()["coherence"] == 0.75


def test_tide(spark):
    step = tides.Step("s", D(2024, 1, 1), D(2024, 1, 1, 1), {"properties": {"x": {"type": "integer", "minimum": 1, "maximum": 3}}, "required": ["x"]}, tags=["t"])
    tide = tides.Tide("t", D(2024, 1, 1), D(2024, 1, 1, 2), 60_000, [step], seed=1, metadata=True)
    out = tides.tide_documents(spark, tide)
    assert out.count() == 60 and set(out.columns) == {"ts", "step_id", "document", "model_path", "tags", "properties"}
    assert all(1 <= json.loads(r["document"])["x"] <= 3 for r in out.collect())
    assert tides.tide_documents(spark, tide, max_documents=7).count() == 7
    tide.jitter = True
    ticks = [r["ts"] for r in tides.tide_ticks(spark, tide).orderBy("tick").collect()]
    gaps = [(b - a).total_seconds() for a, b in zip(ticks, ticks[1:])]
    assert min(gaps) >= 54 and max(gaps) <= 66 and len(set(gaps)) > 10
    with pytest.raises(ValueError):
        tides.tide_ticks(spark, tides.Tide("x", D(2024, 1, 2), D(2024, 1, 1), 0, []))


def test_weighted_steps(spark):
    steps = [tides.Step(n, D(2024, 1, 1), D(2024, 1, 2), {}, weight=w) for n, w in (("a", 3.0), ("b", 1.0))]
    out = tides.tide_events(spark, tides.Tide("t", D(2024, 1, 1), D(2024, 1, 2), 30_000, steps, seed=3)).groupBy("step").count().collect()
    shares = {r["step"]: r["count"] / 2880 for r in out}
    assert shares[0] == pytest.approx(0.75, abs=0.05)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/")
    stream = tides.windowed(source, "ts", "1 day", keys=("event_type",), late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = tides.windowed(events, "ts", "1 day", keys=("event_type",))
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "sub" / "b.json").write_text('{"x": 3}')
    (tmp_path / "bad.json").write_text("# no json")
    assert sorted(r["x"] for r in files.read_json(spark, str(tmp_path)).collect()) == [1, 2, 3]
    (tmp_path / "c.csv").write_text('n,ok,s\n1.5,true,"a ""q"", b"\n2,false,x\n3,true\n')
    out = files.read_csv(spark, str(tmp_path / "c.csv"))
    assert dict(out.dtypes) == {"n": "double", "ok": "boolean", "s": "string"}
    assert [r["s"] for r in out.collect()] == ['a "q", b', "x"]


def test_client(spark, tmp_path):
    client = Client(spark, f"file://{tmp_path}")
    users = client.shop.users
    assert users.find_one({}) is None and users.count_documents() == 0
    assert users.insert(spark.createDataFrame([(f"n{i}", i) for i in range(12)], "name string, age int")) == 12
    assert users.count_documents({"age": {"$gte": 6}}) == 6
    assert users.update({"age": 3}, {"$set": {"name": "three"}})["modified"] == 1
    assert users.find_one({"age": 3})["name"] == "three"
    assert users.delete({"age": {"$lt": 2}}) == 2 and users.count_documents() == 10
    assert users.aggregate([{"$group": {"_id": None, "n": {"$sum": 1}}}]).first()["n"] == 10
    assert [len(b) for b in users.find({}, batch_size=4).batches()] == [4, 4, 2]
    assert users.model()["properties"]["age"]["maximum"] == 11
    assert client.list_database_names() == ["shop"] and client.shop.list_collection_names() == ["users"]
    client.models.save("shop", "made", users.model())
    rows = client.shop.made.find_frame({"$seed": 1, "age": {"$gte": 5}}, limit=20).collect()
    assert len(rows) == 20 and all(r["age"] >= 5 for r in rows)
    users.drop()
    assert users.count_documents() == 0
    with pytest.raises(ValueError):
        client.shop["../x"].insert(spark.range(1))


def test_prompts(spark):
    a = prompts.analyze("Create a user model with name, email, age and isActive. The age is between 18 and 65.")
    assert a.domain == "user" and {"name": "string", "email": "email", "age": "integer"}.items() <= a.fields.items()
    assert a.model["properties"]["age"]["minimum"] == 18
    assert prompts.analyze("an order has many items").relationships == [{"type": "one_to_many", "from": "order", "to": "item"}]
    assert prompts.analyze("").domain == "general"
    assert samples.from_prompt(spark, "a product with name and price", 4).count() == 4
    assert samples.diverse(spark, "a product with price", 2, 3).count() == 6
    assert samples.constrained(spark, "a product with price", {"price": {"minimum": 5, "maximum": 6, "type": "number"}}, 5).where("price < 5 OR price > 6").count() == 0


def test_quality_and_coverage(spark, things):
    m = model.infer(things)
    q = model.quality(m)
    assert 0 < q["overall"] <= 1 and not math.isnan(q["overall"])
    assert {r["path"]: r["coverage"] for r in model.coverage(things, m).collect()}["price"] == 0.75
    assert model.recommendations({"properties": {}}, 3)


def test_metrics(spark, things):
    from docspark.metrics import Metrics, explain, observed, percentiles

    m = Metrics()
    for _ in range(3):
        with m.timed("q"):
            pass
    assert m.summary("q")["n"] == 3 and m.counters["q"] == 3 and m.summary("none") == {}
    df, watch = observed(things)
    df.write.format("noop").mode("overwrite").save()
    assert watch.get["n"] == 40
    assert "HashAggregate" in explain(things, [{"$group": {"_id": "$code", "n": {"$sum": 1}}}])
    assert percentiles(things, "k").first()["median"] == 19


def test_models_beyond_the_values_they_hold(spark, tmp_path, monkeypatch):
    """All values count where a model holds only some: in its table of values, and after a merge."""
    monkeypatch.setattr(model, "KEPT_VALUES", 10)
    df = spark.range(300).select(F.concat(F.lit("v-"), F.col("id").cast("string")).alias("name"))
    odd = spark.createDataFrame([("v-7",), ("v-299",), ("ÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿ",)], "name string")
    held = model.infer(df, model.Options(values_dir=f"file://{tmp_path}"))["properties"]["name"]["stringModel"]
    assert len(held["valueFrequency"]) == 10 and len(held["valueTables"]) == 1
    tight = {"properties": {"name": {"type": "string", "stringModel": held | {"maxLength": 2}}}}
    assert [r["valid"] and not r["outliers"] for r in validate.score(odd, tight).collect()] == [True, True, False]
    assert validate.score(odd, tight).columns == ["name", "outliers", "score", "valid"]
    merged = model.merge_string_models(held, held)
    assert merged["valueTables"] == held["valueTables"] * 2


def test_whole_numbers_far_apart_are_an_enum(spark):
    df = spark.range(100).select((F.col("id") % 3 * 1000).alias("k"))
    assert model.infer(df)["properties"]["k"]["enum"] == [0, 1000, 2000]


def test_multiples_are_folded_by_the_tasks_of_the_table(spark):
    """The values say which task reads them: if one task read all partitions, all would be 0."""

    def numbered(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([6 * TaskContext.get().partitionId()] * batch.num_rows, pa.int64())], ["k"])

    rows = spark.range(0, 80, 1, 8).mapInArrow(numbered, "k long")
    assert profile.multiple_of(rows, ["k"]).first()["multiple_of"] == 6


def test_weighted_draws_from_many_values(spark):
    known = {"type": "object", "properties": {"name": {"type": "string", "stringModel": {"minLength": 1, "maxLength": 9, "entropyScore": 0.0, "valueFrequency": {f"x{i}": 1 for i in range(2000)}}}}, "required": ["name"]}
    made = generate.generate(spark, known, 5000, seed=1)
    assert made.select("name").distinct().count() > 1700 and made.where(~F.col("name").rlike("^x[0-9]+$")).count() == 0


def test_training_adds_up_small_inserts(spark, tmp_path):
    client = Client(spark, f"file://{tmp_path}")
    some = client.shop.some
    for k in range(3):
        some.insert(spark.range(4 * k, 4 * k + 4).select(F.col("id").alias("age")))
        assert (some.model() is None) == (k < 2)
    assert some.model()["properties"]["age"]["maximum"] == 11 and some.count_documents() == 12 and client.shop.list_collection_names() == ["some"]
    client.models.save("shop", "made", some.model())
    assert client.shop.made.count_documents() == 100 and client.shop.made.count_documents({"age": {"$gte": 5}}) == client.shop.made.find_frame({"age": {"$gte": 5}}).count()
    assert client.shop.nothing.count_documents() == 0


def test_models_of_documents_without_fixed_types(spark):
    """Roots, fields and items of several types; lists of lists; nulls."""
    docs = ['{"a": 1, "b": [1, "x", null], "c": {"d": true}}', '{"a": "one", "b": [], "c": null}', '{"a": 2.0, "e": [[1, 2], [3]]}', '"text"', "[1.5]", "null"]
    df = spark.createDataFrame([(d,) for d in docs], "text string").select(F.parse_json("text").alias("doc"))
    by_type = {b["type"]: b for b in model.infer_documents(df)["anyOf"]}
    assert set(by_type) == {"object", "string", "array"} and by_type["array"]["items"]["type"] == "number"
    fields = by_type["object"]["properties"]
    assert by_type["object"]["required"] == ["a"] and [b["type"] for b in fields["a"]["anyOf"]] == ["integer", "string"] and fields["a"]["anyOf"][0]["maximum"] == 2
    assert {b["type"] for b in fields["b"]["items"]["anyOf"]} == {"integer", "string"} and (fields["b"]["minItems"], fields["b"]["maxItems"]) == (0, 3)
    assert fields["c"]["properties"]["d"]["type"] == "boolean" and fields["c"]["present"] == 1
    assert fields["e"]["items"]["type"] == "array" and fields["e"]["items"]["items"]["type"] == "integer"
    typed = spark.createDataFrame([([[1, 2], [3]],)], "m array<array<int>>")
    assert model.infer(typed)["properties"]["m"]["items"]["items"]["type"] == "integer"
    assert model.infer_documents(df.limit(0)) == {}
