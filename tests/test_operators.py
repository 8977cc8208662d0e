"""Operators on small tables, with nulls, missing fields and what must be refused."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docspark.operators import stages, updates
from docspark.plans import aggregate, find
from docspark.plans.pipeline import generation_parameters


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [Row(_id=1, name="Ann", age=30, tags=["a", "b"], home=Row(city="Rome", zip=None)), Row(_id=2, name=None, age=None, tags=[], home=None), Row(_id=3, name="Bob", age=7, tags=None, home=Row(city=None, zip=5))],
        "_id int, name string, age int, tags array<string>, home struct<city:string,zip:int>",
    )


def ids(df):
    return sorted(r["_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ({}, [1, 2, 3]), ({"age": 30}, [1]), ({"age": None}, [2]), ({"age": {"$gt": 5}}, [1, 3]), ({"age": {"$ne": 30}}, [2, 3]), ({"age": {"$nin": [30, 7]}}, [2]), ({"age": {"$in": [7, None]}}, [2, 3]),
        ({"$not": {"age": {"$gt": 5}}}, [2]), ({"$nor": [{"age": 30}, {"name": "Bob"}]}, [2]), ({"age": {"$not": {"$gt": 10}}}, [2, 3]), ({"home.city": "Rome"}, [1]), ({"home.zip": {"$exists": True}}, [3]), ({"nowhere": {"$exists": False}}, [1, 2, 3]),
        ({"nowhere": {"$gt": 1}}, []), ({"tags": ["a", "b"]}, [1]), ({"tags": []}, [2]), ({"tags": {"$size": 0}}, [2]), ({"tags": {"$all": ["a"]}}, [1]), ({"tags": {"$elemMatch": {"$eq": "b"}}}, [1]), ({"tags.0": "a"}, [1]), ({"name": {"$regex": "^a", "$options": "i"}}, [1]),
        ({"name": {"$type": "string"}}, [1, 3]), ({"age": "30"}, []), ({"age": {"$between": [7, 20]}}, [3]), ({"$seed": 4, "_entropy": 0.5, "age": 7}, [3]), ({"home": {"city": "Rome", "zip": None}}, [1]),
    ],
)
def test_filters(people, query, expected):
    assert ids(find(people, query)) == expected


@pytest.mark.parametrize("query", [{"age": {"$near": 1}}, {"$where": "1"}, {"$or": []}, {"age": {"$type": "odd"}}])
def test_unknown_operators_are_refused(people, query):
    with pytest.raises(ValueError):
        find(people, query)


def test_projection(people):
    assert find(people, {}, {"name": 1}).columns == ["_id", "name"]
    assert find(people, {}, {"name": 1, "_id": 0}).columns == ["name"]
    assert find(people, {}, {"age": 0, "tags": 0}).columns == ["_id", "name", "home"]
    assert find(people, {"_id": 1}, {"home.city": 1, "_id": 0}).collect() == [Row(home=Row(city="Rome"))]
    assert "city" not in find(people, {}, {"home.city": 0}).schema["home"].dataType.names


def test_null_sorts_first_ascending_and_last_descending(people):
    assert [r["_id"] for r in find(people, sort={"age": 1}).collect()] == [2, 3, 1]
    assert [r["_id"] for r in find(people, sort={"age": -1}).collect()] == [1, 3, 2]


def test_unwind(people):
    assert aggregate(people, [{"$unwind": "$tags"}]).count() == 2
    assert aggregate(people, [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}]).count() == 4
    assert aggregate(people, [{"$unwind": "$age"}]).count() == 0


def test_push_keeps_nulls_and_order(people):
    pushed = aggregate(people, [{"$sort": {"_id": -1}}, {"$group": {"_id": None, "ages": {"$push": "$age"}, "first": {"$first": "$age"}, "last": {"$last": "$_id"}}}]).first()
    assert pushed["ages"] == [7, None, 30]
    assert (pushed["first"], pushed["last"]) == (7, 1)


def test_average_counts_missing_as_zero(people):
    assert aggregate(people, [{"$group": {"_id": None, "a": {"$avg": "$age"}}}]).first()["a"] == pytest.approx(37 / 3)
    assert aggregate(people, [{"$group": {"_id": None, "a": {"$avg": "$age"}}}], numeric_only_avg=True).first()["a"] == pytest.approx(18.5)


def test_lookup_keeps_documents_without_match(spark, people):
    right = spark.createDataFrame([(30, "x"), (30, "y"), (8, "z")], "k int, v string")
    out = aggregate(people, [{"$lookup": {"from": "r", "localField": "age", "foreignField": "k", "as": "m"}}], {"r": right})
    assert {r["_id"]: len(r["m"]) for r in out.collect()} == {1: 2, 2: 0, 3: 0}


def test_facet_and_empty_count(people):
    out = aggregate(people, [{"$facet": {"n": [{"$count": "k"}], "young": [{"$match": {"age": {"$lt": 10}}}, {"$project": {"name": 1}}]}}]).first()
    assert out["n"][0]["k"] == 3
    assert out["young"][0]["name"] == "Bob"
    assert aggregate(people, [{"$match": {"age": 1000}}, {"$count": "k"}]).first()["k"] == 0


def test_bucket_auto_sizes(spark):
    df = spark.createDataFrame([(i, 7 - i) for i in range(7)], "k int, v int")
    out = aggregate(df, [{"$bucketAuto": {"groupBy": "$v", "buckets": 3}}]).collect()
    assert sorted(r["count"] for r in out) == [1, 3, 3]


@pytest.mark.parametrize("pipeline", [[{"$nope": 1}], [{"$match": {}, "$limit": 1}], {"$match": {}}, [{"$group": {"x": {"$sum": 1}}}], [{"$group": {"_id": None, "x": {"$median": "$age"}}}], [{"$project": {"x": {"$pow": [1, 2]}}}], [{"$out": "x"}]])
def test_bad_pipelines_are_refused(people, pipeline):
    with pytest.raises(ValueError):
        aggregate(people, pipeline).collect()


def test_out_and_merge(spark, people, tmp_path):
    root = f"file://{tmp_path}"
    small = people.select("_id", "name")
    assert aggregate(small, [{"$out": "copy"}], output_dir=root).count() == 3
    fresh = spark.createDataFrame([(3, "Rob"), (4, "Dan")], "_id int, name string")
    old = spark.read.parquet(f"{root}/copy")
    merged = aggregate(fresh, [{"$merge": {"into": "copy"}}], {"copy": old}, output_dir=root)
    assert {r["_id"]: r["name"] for r in merged.collect()} == {1: "Ann", 2: None, 3: "Rob", 4: "Dan"}


def test_updates(people):
    out = {r["_id"]: r for r in updates.update(people, {"age": {"$gt": 5}}, {"$inc": {"age": 1}, "$set": {"home.city": "Oslo"}, "$push": {"tags": "z"}}).collect()}
    assert (out[1]["age"], out[3]["age"], out[2]["age"]) == (31, 8, None)
    assert out[3]["tags"] == ["z"] and out[1]["home"]["city"] == "Oslo"
    assert updates.update(people, {"_id": 1}, {"$pull": {"tags": "a"}}).where("_id = 1").first()["tags"] == ["b"]
    assert updates.update(people, {"_id": 1}, {"$unset": {"name": ""}}).where("name IS NULL").count() == 2
    assert updates.update(people, {}, {"name": "X"}, multi=False, order=["_id"]).where("name = 'X'").count() == 1
    assert updates.update(people, {"_id": 9}, {"$set": {"name": "New"}}, upsert=True).where("_id = 9 AND name = 'New'").count() == 1
    assert updates.update(people, {"_id": 1}, {"$set": {"name": "New"}}, upsert=True).count() == 3
    assert updates.delete(people, {"age": {"$lt": 10}}).count() == 2
    assert updates.modified_count(people, {}, {"$set": {"age": 7}}).first().asDict() == {"matched": 3, "modified": 2}
    with pytest.raises(ValueError):
        updates.update(people, {}, {"$rename": {"a": "b"}})


def test_generation_parameters():
    assert generation_parameters([{"$match": {"$seed": 3, "a": 1}}, {"$limit": 1}]) == ({"seed": 3}, [{"$match": {"a": 1}}, {"$limit": 1}])


def test_expressions_on_nulls(people):
    out = aggregate(people, [{"$project": {"c": {"$concat": ["$name", "!"]}, "t": {"$cond": ["$age", "yes", "no"]}, "n": {"$ifNull": ["$age", 0]}, "s": {"$size": "$tags"}, "d": {"$divide": ["$age", 0]}}}]).collect()
    assert [r["c"] for r in out] == ["Ann!", None, "Bob!"]
    assert [r["t"] for r in out] == ["yes", "no", "yes"]
    assert [r["s"] for r in out] == [2, 0, 0] and all(r["d"] is None for r in out)


def test_filter_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = aggregate(orders, [{"$match": {"o_orderkey": {"$gt": 5}}}, {"$project": {"o_orderkey": 1}}])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


@pytest.mark.parametrize(
    ("query", "expected"),
    [({"doc.a": 5}, [1]), ({"doc.a": {"$gt": 4.5}}, [1, 4]), ({"doc.a": {"$exists": True}}, [1, 2, 4, 5]), ({"doc.a": {"$exists": False}}, [3]), ({"doc.a": None}, [2, 3]), ({"doc.a": {"$type": "number"}}, [1, 4]), ({"doc.a": "5"}, [5]), ({"doc.a": {"$ne": 5}}, [2, 3, 4, 5]), ({"doc.b.0": "x"}, [3])],
)
def test_variant_columns_tell_null_from_missing(spark, query, expected):
    rows = [(1, '{"a": 5}'), (2, '{"a": null}'), (3, '{"b": ["x"]}'), (4, '{"a": 7.5}'), (5, '{"a": "5"}')]
    df = spark.createDataFrame(rows, "_id int, s string").select("_id", F.parse_json("s").alias("doc"))
    assert ids(find(df, query)) == expected


def test_skip_leaves_the_rows_where_they_are(spark):
    """Without a limit no exchange gathers all rows in one task."""
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    out = aggregate(df, [{"$sort": {"k": -1}}, {"$skip": 990}])
    assert [r["k"] for r in out.collect()] == list(range(9, -1, -1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]
    assert aggregate(df, [{"$skip": 995}]).count() == 5 and aggregate(df, [{"$skip": 2000}]).count() == 0
    assert [r["k"] for r in aggregate(df, [{"$sort": {"k": 1}}, {"$skip": 3}, {"$limit": 2}]).collect()] == [3, 4]


def test_samples_beyond_a_top_k(spark, monkeypatch):
    monkeypatch.setattr(stages, "TOP_K", 10)
    df = spark.range(500)
    for size, n in ((5, 5), (100, 100), (900, 500)):
        out = aggregate(df, [{"$sample": {"size": size}}], seed=1)
        assert out.columns == ["id"] and out.count() == out.distinct().count() == n


def test_descending_orders_of_every_kind(spark):
    """Values that begin with others, nulls last, booleans, binaries and dates."""
    rows = [(1, "ab", True, b"\x01", None), (2, "abc", False, b"\x01\x02", 5), (3, None, None, None, 1), (4, "b", True, b"\x00", 9), (5, "é", False, b"\xff", 2)]
    df = spark.createDataFrame(rows, "k int, s string, b boolean, y binary, n int")
    for path in ("s", "y", "n"):
        sorted_keys = [r["k"] for r in aggregate(df, [{"$sort": {path: -1, "k": 1}}]).collect()]
        out = aggregate(df, [{"$sort": {path: -1, "k": 1}}, {"$group": {"_id": None, "all": {"$push": "$k"}, "first": {"$first": "$k"}, "last": {"$last": "$k"}}}]).first()
        assert (out["all"], out["first"], out["last"]) == (sorted_keys, sorted_keys[0], sorted_keys[-1])
    assert aggregate(df, [{"$sort": {"b": -1, "k": 1}}, {"$group": {"_id": None, "all": {"$push": "$k"}}}]).first()["all"] == [1, 4, 2, 5, 3]


def test_one_of_equal_documents_is_changed(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (0, "b"), (None, "a")], "k int, v string")
    out = updates.update(df, {"k": 1}, {"$set": {"v": "z"}}, multi=False).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "z"), (1, "a"), (0, "b"), (None, "a")], key=str)
    assert updates.delete(df, {"v": "a"}, multi=False).count() == 3
    assert updates.delete(df, {"v": "none"}, multi=False).count() == 4


def test_a_write_that_failed_between_its_renames(spark, tmp_path):
    from docspark.sources.collections import read_collection, write_collection

    root = f"file://{tmp_path}"
    write_collection(spark.range(3), root, "c")
    (tmp_path / "c").rename(tmp_path / "_old-c")  # the old version was moved aside, the new one never came
    assert read_collection(spark, root, "c").count() == 3
    assert write_collection(read_collection(spark, root, "c").union(spark.range(2)), root, "c").count() == 5
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c"]


def test_nested_fields_keep_their_neighbours(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("x"), F.struct(F.lit(2).alias("y")).alias("in")).alias("d"))
    out = aggregate(df, [{"$addFields": {"d.new.deep": 3, "d.in.z": 4}}]).first()["d"].asDict(recursive=True)
    assert out == {"x": 1, "in": {"y": 2, "z": 4}, "new": {"deep": 3}}
