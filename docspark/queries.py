"""The registered queries of the library's own operators, each over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import enums, generate, model, profile, validate
from .operators import updates
from .plans import aggregate, facets, find
from .plans.pipeline import count
from .scratch import new_folder
from .sources.collections import read_collection
from .sources.files import default_documents, read_csv, read_json
from .streaming import tides

QUERIES = {}
ORACLE_SQL = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, *tables: str):
    """Registers a function of the named tables under its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables]) if tables else f(spark)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


D = datetime

# Flagship


@query(
    """SELECT l_returnflag AS rf, l_linestatus AS ls, sum(l_quantity) AS sum_qty, sum(l_extendedprice) / count(*) AS avg_price, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "lineitem",
)
def pricing_summary(lineitem):
    return aggregate(lineitem, [
        {"$match": {"l_shipdate": {"$lte": D(1998, 9, 2)}}},
        {"$group": {"_id": {"rf": "$l_returnflag", "ls": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "avg_price": {"$avg": "$l_extendedprice"}, "n": {"$sum": 1}}},
        {"$sort": {"_id": 1}},
        {"$project": {"rf": "$_id.rf", "ls": "$_id.ls", "sum_qty": 1, "avg_price": 1, "n": 1}},
    ])


# find and predicates


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10", "orders")
def find_filter_sort_limit(orders):
    return find(orders, {"o_totalprice": {"$gt": 1000}, "o_orderstatus": {"$ne": "P"}}, {"o_orderkey": 1, "o_totalprice": 1}, {"o_totalprice": -1, "o_orderkey": 1}, skip=10, limit=50)


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 1", "customer")
def find_one(customer):
    return find(customer, {"c_nationkey": 7}, {"c_custkey": 1}, {"c_custkey": 1}, limit=1)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal <= 5000 AND c_acctbal >= 1000.5 AND c_acctbal < 4999", "customer")
def predicates_compare(customer):
    return find(customer, {"c_acctbal": {"$gt": 1000, "$lte": 5000, "$gte": 1000.5, "$lt": 4999}}, {"c_custkey": 1, "c_acctbal": 1})


@query(
    """SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_acctbal < 100) AND NOT (c_mktsegment = 'BUILDING' OR c_acctbal > 9000)
       AND NOT (c_mktsegment = 'MACHINERY' AND c_nationkey = 3) AND (c_acctbal >= 0 AND c_nationkey <> 4)""",
    "customer",
)
def predicates_logical(customer):
    return find(customer, {"$or": [{"c_nationkey": 3}, {"c_acctbal": {"$lt": 100}}], "$nor": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$gt": 9000}}], "$not": {"c_mktsegment": "MACHINERY", "c_nationkey": 3}, "$and": [{"c_acctbal": {"$gte": 0}}, {"c_nationkey": {"$ne": 4}}]}, {"c_custkey": 1})


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 500 AND 8000", "customer")
def predicates_in_nin_between(customer):
    return find(customer, {"c_nationkey": {"$in": [1, 2, 3]}, "c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}, "c_acctbal": {"$between": [500, 8000]}}, {"c_custkey": 1})


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_brand, '(?i)^brand#[13]') AND contains(lower(p_type), 'a')", "part")
def predicates_regex_text(part):
    return find(part, {"p_brand": {"$regex": "^brand#[13]", "$options": "i"}, "p_type": {"$text": "A"}}, {"p_partkey": 1, "p_name": 1})


@query(
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality = 1""",
    "documents", "labels",
)
def predicates_exists_missing(documents, labels):
    joined = documents.select("doc_id").join(labels, "doc_id", "left")
    return find(joined, {"$or": [{"quality": {"$exists": False}}, {"quality": {"$eq": 1}}]}, {"doc_id": 1, "quality": 1})


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)", "documents", "labels")
def predicates_missing_passes_ne(documents, labels):
    return find(documents.select("doc_id").join(labels, "doc_id", "left"), {"quality": {"$ne": 1}}, {"doc_id": 1})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice = floor(l_extendedprice)", "lineitem")
def predicates_type_whole(lineitem):
    return find(lineitem, {"l_extendedprice": {"$type": "int"}, "l_returnflag": {"$type": "string"}}, {"l_orderkey": 1, "l_linenumber": 1, "l_extendedprice": 1})


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x > 0.3 AND x < 0.31)) > 0 AND embedding[1] > 0", "embeddings")
def predicates_arrays(embeddings):
    return find(embeddings, {"embedding": {"$size": 64, "$elemMatch": {"$gt": 0.3, "$lt": 0.31}}, "embedding.0": {"$gt": 0}}, {"vec_id": 1})


@query("SELECT o_custkey, len(list(o_orderstatus)) AS n FROM orders GROUP BY 1 HAVING list_contains(list(o_orderstatus), 'F') AND list_contains(list(o_orderstatus), 'O')", "orders")
def predicates_all(orders):
    pushed = aggregate(orders, [{"$group": {"_id": "$o_custkey", "states": {"$push": "$o_orderstatus"}}}, {"$match": {"states": {"$all": ["F", "O"]}}}])
    return aggregate(pushed, [{"$project": {"o_custkey": "$_id", "n": {"$size": "$states"}}}])


@query("SELECT count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50", "events")
def predicates_variant(events):
    doc = F.variant_get(F.parse_json("props"), "$.k", "int")
    return aggregate(events.withColumn("k", doc), [{"$match": {"k": {"$gte": 50}}}, {"$count": "n"}])


# Shapes


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity % 7 AS rest, l_extendedprice / l_quantity AS unit FROM lineitem", "lineitem")
def project_expr(lineitem):
    return aggregate(lineitem, [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, "rest": {"$mod": ["$l_quantity", 7]}, "unit": {"$divide": ["$l_extendedprice", "$l_quantity"]}}}])


@query("SELECT s_suppkey, s_nationkey FROM supplier", "supplier")
def project_exclusion(supplier):
    return aggregate(supplier, [{"$project": {"s_name": 0, "s_acctbal": 0}}])


@query("SELECT o_orderkey, o_totalprice + 10 AS o_totalprice, o_totalprice AS old_price, year(o_orderdate) AS y FROM orders", "orders")
def add_fields(orders):
    return aggregate(orders, [{"$addFields": {"old_price": "$o_totalprice", "o_totalprice": {"$add": ["$o_totalprice", 10]}, "extra.y": {"$year": "$o_orderdate"}}}, {"$set": {"y": "$extra.y"}}, {"$project": {"o_orderkey": 1, "o_totalprice": 1, "old_price": 1, "y": 1}}])


@query("SELECT c_custkey, c_name, c_nationkey FROM customer", "customer")
def unset_fields(customer):
    return aggregate(customer, [{"$unset": ["c_acctbal", "c_mktsegment"]}])


@query("SELECT n_name AS name, n_regionkey AS region FROM nation", "nation")
def replace_root(nation):
    return aggregate(nation, [{"$addFields": {"doc": {"name": "$n_name", "region": "$n_regionkey"}}}, {"$replaceRoot": {"newRoot": "$doc"}}])


@query("SELECT vec_id, i - 1 AS place, embedding[i] AS x FROM embeddings, unnest(range(1, 65)) AS r(i)", "embeddings")
def unwind_index(embeddings):
    return aggregate(embeddings, [{"$unwind": {"path": "$embedding", "includeArrayIndex": "place"}}, {"$project": {"vec_id": 1, "place": 1, "x": "$embedding"}}])


@query(
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "customer", "orders",
)
def unwind_preserve(customer, orders):
    return aggregate(customer, [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}}], {"orders": orders})


# Joins


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", "customer", "orders")
def lookup_array(customer, orders):
    return aggregate(customer, [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$project": {"c_custkey": 1, "n_orders": {"$size": "$o"}}}], {"orders": orders})


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "orders", "customer", "nation")
def lookup_inner(orders, customer, nation):
    return aggregate(orders, [
        {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"},
        {"$lookup": {"from": "nation", "localField": "c.c_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$unwind": "$n"},
        {"$project": {"o_orderkey": 1, "c_name": "$c.c_name", "n_name": "$n.n_name"}},
    ], {"customer": customer, "nation": nation})


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "customer", "orders")
def lookup_anti(customer, orders):
    return aggregate(customer, [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$size": 0}}}, {"$project": {"c_custkey": 1}}], {"orders": orders})


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "customer", "orders")
def lookup_semi(customer, orders):
    return aggregate(customer, [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$not": {"$size": 0}}}}, {"$project": {"c_custkey": 1}}], {"orders": orders})


@query(
    """SELECT * FROM (SELECT 'customer_ref' AS path, count(DISTINCT o_custkey) / count(o_custkey) AS unique_ratio FROM orders
       UNION ALL SELECT 'order_id', count(DISTINCT o_orderkey) / count(o_orderkey) FROM orders) WHERE unique_ratio > 0.5""",
    "orders",
)
def relationships(orders):
    return profile.relationships(orders.withColumnsRenamed({"o_custkey": "customer_ref", "o_orderkey": "order_id"}))


# Groups


@query("SELECT l_suppkey AS _id, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1", "lineitem")
def group_basic(lineitem):
    return aggregate(lineitem, [{"$group": {"_id": "$l_suppkey", "n": {"$count": {}}, "qty": {"$sum": "$l_quantity"}}}])


@query("SELECT count(*) AS n, max(o_totalprice) AS top FROM orders", "orders")
def group_null(orders):
    return aggregate(orders, [{"$group": {"_id": None, "n": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}, {"$unset": "_id"}])


@query("SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2", "orders")
def group_computed(orders):
    return aggregate(orders, [{"$group": {"_id": {"y": {"$year": "$o_orderdate"}, "p": "$o_orderpriority"}, "n": {"$sum": 1}}}, {"$project": {"y": "$_id.y", "p": "$_id.p", "n": 1}}])


@query("SELECT l_returnflag AS _id, sum(l_quantity) AS s, sum(l_discount) / count(*) AS a, min(l_tax) AS lo, max(l_tax) AS hi, count(*) AS n FROM lineitem GROUP BY 1", "lineitem")
def acc_sum_avg_min_max_count(lineitem):
    return aggregate(lineitem, [{"$group": {"_id": "$l_returnflag", "s": {"$sum": "$l_quantity"}, "a": {"$avg": "$l_discount"}, "lo": {"$min": "$l_tax"}, "hi": {"$max": "$l_tax"}, "n": {"$count": {}}}}])


@query("SELECT d.lang AS _id, sum(coalesce(l.quality, 0)) / count(*) AS a FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1", "documents", "labels")
def acc_avg_missing(documents, labels):
    return aggregate(documents.select("doc_id", "lang").join(labels, "doc_id", "left"), [{"$group": {"_id": "$lang", "a": {"$avg": "$quality"}}}])


@query("SELECT user_id AS _id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1", "events")
def acc_first_last(events):
    return aggregate(events, [{"$sort": {"ts": 1, "event_id": 1}}, {"$group": {"_id": "$user_id", "first_value": {"$first": "$value"}, "last_value": {"$last": "$value"}}}])


@query("SELECT conv_id AS _id, array_to_string(list(role ORDER BY turn), ',') AS roles, array_to_string(list_sort(list(DISTINCT role)), ',') AS distinct_roles FROM conversations GROUP BY 1", "conversations")
def acc_push_addtoset(conversations):
    out = aggregate(conversations, [{"$sort": {"turn": 1}}, {"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}, "distinct_roles": {"$addToSet": "$role"}}}])
    return out.select("_id", F.array_join("roles", ",").alias("roles"), F.array_join("distinct_roles", ",").alias("distinct_roles"))


@query("SELECT l_linestatus AS _id, round(stddev_pop(l_quantity), 6) AS pop, round(stddev_samp(l_quantity), 6) AS samp FROM lineitem GROUP BY 1", "lineitem")
def acc_stddev(lineitem):
    out = aggregate(lineitem, [{"$group": {"_id": "$l_linestatus", "pop": {"$stdDevPop": "$l_quantity"}, "samp": {"$stdDevSamp": "$l_quantity"}}}])
    return out.select("_id", F.round("pop", 6).alias("pop"), F.round("samp", 6).alias("samp"))


@query(
    """SELECT CASE WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN 10 WHEN p_size < 40 THEN 20 END AS _id, count(*) AS count, max(p_retailprice) AS top
       FROM part WHERE p_size >= 1 AND p_size < 40 GROUP BY 1""",
    "part",
)
def bucket(part):
    return aggregate(part, [{"$bucket": {"groupBy": "$p_size", "boundaries": [1, 10, 20, 40], "output": {"top": {"$max": "$p_retailprice"}, "count": {"$sum": 1}}}}])


@query("SELECT CASE WHEN c_acctbal >= 0 AND c_acctbal < 1000 THEN '0' WHEN c_acctbal >= 1000 AND c_acctbal < 5000 THEN '1000' ELSE 'other' END AS _id, count(*) AS count FROM customer GROUP BY 1", "customer")
def bucket_default(customer):
    return aggregate(customer, [{"$bucket": {"groupBy": "$c_acctbal", "boundaries": [0, 1000, 5000], "default": "other"}}])


@query(
    """WITH r AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part)
       SELECT min(v) AS low, max(v) AS high, count(*) AS count FROM r GROUP BY floor(rn / ceil(n / 7.0))""",
    "part",
)
def bucket_auto(part):
    out = aggregate(part, [{"$bucketAuto": {"groupBy": "$p_retailprice", "buckets": 7}}])
    return out.select(F.col("_id.min").alias("low"), F.col("_id.max").alias("high"), "count")


@query(
    """SELECT 'by_status' AS facet, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 2 UNION ALL
       SELECT 'by_year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM orders""",
    "orders",
)
def facet(orders):
    spec = {"by_status": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}], "by_year": [{"$group": {"_id": {"$year": "$o_orderdate"}, "n": {"$sum": 1}}}], "all": [{"$group": {"_id": None, "n": {"$sum": 1}}}]}
    one = aggregate(orders, [{"$facet": spec}])
    parts = [one.select(F.explode(name).alias("x")).select(F.lit(name).alias("facet"), F.col("x._id").cast("string").alias("k"), F.col("x.n").alias("n")) for name in facets(orders, spec)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT count(*) AS errors FROM events WHERE event_type = 'error'", "events")
def count_stage(events):
    return aggregate(events, [{"$match": {"event_type": "error"}}, {"$count": "errors"}])


@query("SELECT count(*) AS count, 11 AS n_fields FROM lineitem", "lineitem")
def coll_stats(lineitem):
    return aggregate(lineitem, [{"$collStats": {}}])


# Order


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "orders")
def topk(orders):
    return aggregate(orders, [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 100}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 40", "orders")
def sort_skip_limit(orders):
    return aggregate(orders, [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$skip": 40}, {"$limit": 25}, {"$project": {"o_orderkey": 1}}])


@query(None, "customer")
def sample(customer):
    return aggregate(customer, [{"$sample": {"size": 100}}], seed=7)


# Expressions


@query("SELECT l_orderkey, l_linenumber, (l_quantity + l_tax + 1) * 2 - l_discount AS x, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio FROM lineitem", "lineitem")
def expr_arith(lineitem):
    return aggregate(lineitem, [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "x": {"$subtract": [{"$multiply": [{"$add": ["$l_quantity", "$l_tax", 1]}, 2]}, "$l_discount"]}, "ratio": {"$divide": ["$l_tax", "$l_discount"]}}}])


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, c_name || '/' || c_mktsegment AS both_names, substring(c_name, 3, 4) AS part FROM customer", "customer")
def expr_string(customer):
    return aggregate(customer, [{"$project": {"c_custkey": 1, "up": {"$toUpper": "$c_name"}, "low": {"$toLower": "$c_mktsegment"}, "both_names": {"$concat": ["$c_name", "/", "$c_mktsegment"]}, "part": {"$substr": ["$c_name", 2, 4]}}}])


@query(
    "SELECT p_partkey, p_size > 20 AS gt, p_size >= 20 AS gte, p_size < 20 AS lt, p_size <= 20 AS lte, p_size = 20 AS eq, p_size <> 20 AS ne, p_size > 10 AND p_retailprice <> 0 AS both_true, p_size > 40 OR p_name <> '' AS one_true, NOT p_size > 20 AS neg FROM part",
    "part",
)
def expr_compare_logic(part):
    s = "$p_size"
    return aggregate(part, [{"$project": {"p_partkey": 1, "gt": {"$gt": [s, 20]}, "gte": {"$gte": [s, 20]}, "lt": {"$lt": [s, 20]}, "lte": {"$lte": [s, 20]}, "eq": {"$eq": [s, 20]}, "ne": {"$ne": [s, 20]}, "both_true": {"$and": [{"$gt": [s, 10]}, "$p_retailprice"]}, "one_true": {"$or": [{"$gt": [s, 40]}, "$p_name"]}, "neg": {"$not": [{"$gt": [s, 20]}]}}}])


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE 'other' END AS q, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)", "documents", "labels")
def expr_cond(documents, labels):
    return aggregate(documents.select("doc_id").join(labels, "doc_id", "left"), [{"$project": {"doc_id": 1, "q": {"$cond": {"if": {"$eq": ["$quality", 1]}, "then": "good", "else": "other"}}, "toxic": {"$ifNull": ["$toxic", -1]}}}])


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events", "events")
def expr_date(events):
    return aggregate(events, [{"$project": {"event_id": 1, "y": {"$year": "$ts"}, "m": {"$month": "$ts"}, "d": {"$dayOfMonth": "$ts"}, "h": {"$hour": "$ts"}, "mi": {"$minute": "$ts"}, "s": {"$second": "$ts"}}}])


@query("SELECT vec_id, len(embedding) AS n, embedding[3] AS third, embedding[100] AS beyond FROM embeddings", "embeddings")
def expr_array(embeddings):
    return aggregate(embeddings, [{"$project": {"vec_id": 1, "n": {"$size": "$embedding"}, "third": {"$arrayElemAt": ["$embedding", 2]}, "beyond": {"$arrayElemAt": ["$embedding", 99]}}}])


# Updates


@query(
    "SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_nationkey = 5 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer",
    "customer",
)
def update_set_inc(customer):
    return updates.update(customer, {"c_nationkey": 5}, {"$set": {"c_mktsegment": "VIP"}, "$inc": {"c_acctbal": 100}}).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT count(*) FILTER (c_nationkey < 3) AS matched, count(*) FILTER (c_nationkey < 3 AND c_mktsegment <> 'BUILDING') AS modified FROM customer", "customer")
def update_counts(customer):
    return updates.modified_count(customer, {"c_nationkey": {"$lt": 3}}, {"$set": {"c_mktsegment": "BUILDING"}})


@query("SELECT vec_id, len(embedding) + 1 AS n, 2.5 AS last_item FROM embeddings WHERE label = 1 UNION ALL SELECT vec_id, len(embedding), CAST(embedding[-1] AS DOUBLE) FROM embeddings WHERE label <> 1", "embeddings")
def update_push(embeddings):
    out = updates.update(embeddings, {"label": 1}, {"$push": {"embedding": 2.5}})
    return out.select("vec_id", F.size("embedding").alias("n"), F.element_at("embedding", -1).cast("double").alias("last_item"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey <> (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 0)", "supplier")
def delete_one(supplier):
    return updates.delete(supplier, {"s_acctbal": {"$gt": 0}}, multi=False, order=["s_suppkey"]).select("s_suppkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 2000)", "customer")
def delete_multi(customer):
    return updates.delete(customer, {"c_acctbal": {"$lt": 2000}}).select("c_custkey")


# Profiles


@query(
    """SELECT 'doc_id' AS path, count(*) AS n, count(doc_id) AS n_present, count(*) = count(doc_id) AS required, 'integer' AS types FROM documents LEFT JOIN labels USING (doc_id) UNION ALL
       SELECT 'lang', count(*), count(lang), count(*) = count(lang), 'string' FROM documents LEFT JOIN labels USING (doc_id) UNION ALL
       SELECT 'quality', count(*), count(quality), count(*) = count(quality), 'integer' FROM documents LEFT JOIN labels USING (doc_id)""",
    "documents", "labels",
)
def infer_required(documents, labels):
    found = profile.fields(documents.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id", "left"))
    return found.withColumn("types", F.array_join("types", ","))


@query(
    "SELECT 'l_extendedprice' AS path, array_to_string(list_sort(list(DISTINCT CASE WHEN l_extendedprice = floor(l_extendedprice) THEN 'integer' ELSE 'number' END)), ',') AS types FROM lineitem",
    "lineitem",
)
def infer_types(lineitem):
    return profile.fields(lineitem.select("l_extendedprice")).select("path", F.array_join("types", ",").alias("types"))


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS path, count({c}) AS n, min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum, round(avg({c}), 6) AS average, round(stddev_samp({c}), 6) AS standard_deviation FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "lineitem",
)
def infer_numeric(lineitem):
    return profile.numbers(lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumns({c: F.round(c, 6) for c in ("average", "standard_deviation")})


@query("SELECT min(len(embedding)) AS min_items, max(len(embedding)) AS max_items, bool_or(len(list_distinct(embedding)) = len(embedding)) AS unique_items FROM embeddings", "embeddings")
def infer_arrays(embeddings):
    return profile.arrays(embeddings, "embedding")


_HISTOGRAM = """
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS total FROM lineitem),
    h AS (SELECT CASE """ + " ".join(f"WHEN l_extendedprice >= lo + (hi - lo) / 10 * {i} THEN {i}" for i in range(9, 0, -1)) + """ ELSE 0 END AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)"""


@query(_HISTOGRAM + " SELECT bin, n, floor((lo + (hi - lo) / 10 * bin) * 10000 + 0.5) / 10000 AS range_start, floor(sum(n) OVER (ORDER BY bin) * 100.0::DOUBLE / total * 100 + 0.5) / 100 AS freq_end FROM h, b", "lineitem")
def infer_histogram(lineitem):
    return profile.histogram(lineitem, "l_extendedprice").select("bin", "n", "range_start", "freq_end")


@query(_HISTOGRAM + " SELECT floor(-sum(n / total * log2(n / total)) * 10000 + 0.5) / 10000 AS entropy, floor(log2(count(*)) * 10000 + 0.5) / 10000 AS max_entropy FROM h, b", "lineitem")
def histogram_entropy(lineitem):
    return profile.histogram_entropy(profile.histogram(lineitem, "l_extendedprice"))


@query(
    """WITH g AS (SELECT list_reduce(list(DISTINCT x), lambda a, b: gcd(a, b)) AS g, max(x) AS m FROM (SELECT CAST(l_quantity * 5 AS BIGINT) AS x FROM lineitem)),
       p AS (SELECT list_reduce(list(DISTINCT x), lambda a, b: gcd(a, b)) AS g, max(x) AS m FROM (SELECT CAST(l_linenumber AS BIGINT) AS x FROM lineitem))
       SELECT 'q5' AS path, CASE WHEN g > 1 AND g < m THEN g END AS multiple_of FROM g UNION ALL SELECT 'l_linenumber', CASE WHEN g > 1 AND g < m THEN g END FROM p""",
    "lineitem",
)
def infer_multiple_of(lineitem):
    return profile.multiple_of(lineitem.withColumn("q5", (F.col("l_quantity") * 5).cast("long")), ["q5", "l_linenumber"])


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS path, count(*) AS n, count(DISTINCT {c}) AS n_distinct, min(length({c})) AS min_length, max(length({c})) AS max_length, floor(avg(length({c})) * 100 + 0.5) / 100 AS average_length FROM part" for c in ("p_name", "p_type")),
    "part",
)
def infer_string_lengths(part):
    return profile.lengths(part, ["p_name", "p_type"])


@query(
    """WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1)
       SELECT ch, n, floor(n / sum(n) OVER () * 10000 + 0.5) / 10000 AS probability FROM n""",
    "documents",
)
def char_freq(documents):
    return profile.character_counts(documents, "text")


@query(
    """WITH g AS (SELECT substring(p_name, i, k) AS gram FROM part, (VALUES (2), (3)) AS s(k), unnest(range(1, length(p_name) - k + 2)) AS r(i))
       SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, gram LIMIT 20""",
    "part",
)
def infer_ngrams(part):
    return profile.ngrams(part, "p_name")


@query(
    """WITH k AS (SELECT least(3, min(length(c_name))) AS k FROM customer),
       a AS (SELECT left(c_name, i) AS affix FROM customer, k, unnest(range(1, k + 1)) AS r(i)), b AS (SELECT right(c_name, i) AS affix FROM customer, k, unnest(range(1, k + 1)) AS r(i))
       (SELECT 'prefix' AS kind, affix, count(*) AS n FROM a GROUP BY 2 HAVING count(*) > 1 ORDER BY n DESC, affix LIMIT 10) UNION ALL
       (SELECT 'suffix', affix, count(*) AS n FROM b GROUP BY 2 HAVING count(*) > 1 ORDER BY n DESC, affix LIMIT 10)""",
    "customer",
)
def infer_affixes(customer):
    each = [profile.affixes(customer, "c_name", kind).select(F.lit(kind).alias("kind"), "affix", "n") for kind in ("prefix", "suffix")]
    return each[0].unionByName(each[1])


@query(
    """WITH t AS (SELECT regexp_extract_all(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name, '[^0-9A-Za-z\\s]', '~', 'g'), '[0-9]', '!', 'g'), '[A-Z]', '%', 'g'), '[a-z]', '&', 'g'), '\\s', '^', 'g'), '~!%&^', 'pdULs'), 'd+|U+|L+|s+|p+') AS runs FROM customer)
       SELECT array_to_string(list_transform(runs, lambda r: r[1] || CASE WHEN length(r) > 1 THEN '{' || length(r) || '}' ELSE '' END), '') AS pattern, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10""",
    "customer",
)
def infer_shapes(customer):
    return profile.shapes(customer, "c_name")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1", "events")
def infer_value_freq(events):
    return profile.value_counts(events, "event_type")


@query(
    """WITH c AS (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment), t AS (SELECT sum(n) AS total FROM c)
       SELECT floor(-sum(n / total * log2(n / total)) * 10000 + 0.5) / 10000 AS entropy, sum(n)::BIGINT AS n, count(*) AS n_distinct FROM c, t""",
    "customer",
)
def string_entropy(customer):
    return profile.entropy(profile.value_counts(customer, "c_mktsegment"))


@query(
    """SELECT 'event_type' AS path, count(*) AS n, count(DISTINCT event_type) AS n_distinct, (count(DISTINCT event_type) / count(*) < 0.5 AND count(DISTINCT event_type) <= 20) OR (count(DISTINCT event_type) <= 5 AND count(*) >= 3) AS is_enum,
       array_to_string(list_sort(list(DISTINCT event_type)), ',') AS values FROM events""",
    "events",
)
def infer_enum(events):
    return profile.enum_of(events, "event_type").withColumn("values", F.array_join("values", ","))


@query("SELECT 'url' AS path, CASE WHEN bool_and(regexp_matches(url, '(?i)^https?://[^\\s/$.?#].[^\\s]*$')) THEN 'uri' END AS format FROM pages UNION ALL SELECT 'html', NULL", "pages")
def infer_format(pages):
    return profile.format_of(pages, ["url", "html"])


@query("SELECT 'code' AS path, CASE WHEN bool_and(regexp_matches('AB-' || (1000 + s_suppkey), '^[A-Z]{2,4}-\\d{3,5}$')) THEN '^[A-Z]{2,4}-\\d{3,5}$' END AS pattern FROM supplier", "supplier")
def infer_pattern(supplier):
    return profile.pattern_of(supplier.select(F.concat(F.lit("AB-"), (F.col("s_suppkey") + 1000).cast("string")).alias("code")), ["code"])


@query(
    """WITH c AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c),
       r AS (SELECT n, sum(n) OVER (ORDER BY n DESC, v) AS upto, row_number() OVER (ORDER BY n DESC, v) AS rank FROM c)
       SELECT (SELECT min(rank) FROM r, t WHERE upto >= 0.8 * total) / (SELECT k FROM t) AS concentration""",
    "part",
)
def enum_concentration(part):
    return enums.concentration(profile.value_counts(part, "p_type"))


@query(
    """WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 100), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, v) AS rank FROM c)
       SELECT round(CASE WHEN count(*) >= 10 THEN abs(regr_slope(ln(n), ln(rank))) ELSE 0 END, 6) AS power_law FROM r""",
    "part",
)
def enum_power_law(part):
    return enums.power_law(profile.value_counts(part, "p_brand")).select(F.round("power_law", 6).alias("power_law"))


@query(
    """WITH c AS (SELECT length(event_type) AS len, count(*) AS n, event_type FROM events GROUP BY 1, 3), t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
       SELECT first(total)::BIGINT AS n, first(k) AS n_distinct, first(k) / first(total) AS unique_ratio, round(-sum(n / total * log2(n / total)), 5) AS entropy, round(sum(len * n) / first(total), 6) AS length_mean FROM c, t""",
    "events",
)
def enum_metrics(events):
    return enums.metrics(events, "event_type").select("n", "n_distinct", "unique_ratio", F.round("entropy", 5).alias("entropy"), F.round("length_mean", 6).alias("length_mean"))


@query("SELECT 'o_orderstatus' AS path, TRUE AS is_enum, count(*) AS n, count(DISTINCT o_orderstatus) AS n_distinct FROM orders", "orders")
def enum_detect(orders):
    return enums.detect(orders, "o_orderstatus").select("path", "is_enum", "n", "n_distinct")


# Models


@query(
    """SELECT count(*) AS n, min(o_totalprice) AS minimum, max(o_totalprice) AS maximum FROM orders""",
    "orders",
)
def merge_models(orders):
    halves = [model.infer(orders.where(F.col("o_orderkey") % 2 == k).select("o_totalprice"), model.Options(string_models=False)) for k in (0, 1)]
    whole = model.merge(*halves)["properties"]["o_totalprice"]
    branches = whole.get("anyOf", [whole])
    return orders.sparkSession.createDataFrame([(whole["count"], float(min(b["minimum"] for b in branches)), float(max(b["maximum"] for b in branches)))], "n long, minimum double, maximum double")


_TRAINED = """WITH t AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, stddev_samp(l_extendedprice) AS sd FROM lineitem WHERE l_extendedprice < 60000)"""


@query(
    _TRAINED + """ SELECT l_orderkey, l_linenumber, (CASE WHEN l_extendedprice < lo OR l_extendedprice > hi THEN 1 ELSE 0 END) + (CASE WHEN abs(l_extendedprice - (lo + hi) / 2) / sd > 3 THEN 1 ELSE 0 END) AS n_outliers
        FROM lineitem, t""",
    "lineitem",
)
def validate_range_zscore(lineitem):
    """All rows against the statistics of those below a price."""
    stats = profile.numbers(lineitem.where(F.col("l_extendedprice") < 60000), ["l_extendedprice"]).first()
    known = {"properties": {"l_extendedprice": {"type": "number", "histogram": {"minValue": stats["minimum"], "maxValue": stats["maximum"], "standardDeviation": stats["standard_deviation"]}}}}
    return validate.score(lineitem, known).select("l_orderkey", "l_linenumber", F.size("outliers").alias("n_outliers"))


@query(
    """SELECT c_custkey, c_acctbal >= 1000 AND length(c_name) <= 18 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AS ok FROM customer""",
    "customer",
)
def validate_samples(customer):
    demands = {"required": ["c_custkey"], "properties": {"c_acctbal": {"type": "number", "minimum": 1000}, "c_name": {"type": "string", "maxLength": 18}, "c_mktsegment": {"type": "string", "enum": ["BUILDING", "MACHINERY"]}}}
    return validate.check_samples(customer, demands).select("c_custkey", (F.size("errors") == 0).alias("ok"))


@query(
    """SELECT c_custkey, list_sort(list_distinct(list_filter(string_split(c_name, ''), lambda x: x <> '' AND NOT contains('Cust0123456', x)))) = [] AS ok FROM customer""",
    "customer",
)
def validate_characters(customer):
    known = {"properties": {"c_name": {"type": "string", "stringModel": {"minLength": 1, "maxLength": 100, "uniqueCharacters": list("Cust0123456"), "complexity": 1e9}}}}
    unknown = F.exists("outliers", lambda o: o["reason"].startswith("unknown characters"))
    return validate.score(customer, known).select("c_custkey", (~unknown).alias("ok"))


# Generation and tides


@query(None, "lineitem")
def generate_lineitem(lineitem):
    """As many documents as the table has rows, from the model of the whole table."""
    known = model.infer(lineitem)
    return generate.generate(lineitem.sparkSession, known, lineitem.count(), seed=42)


@query("SELECT count(*) AS n, count(*) AS n_ids, true AS met FROM customer", "customer")
def generate_constrained_bounds(customer):
    made = generate_constrained(customer)
    met = (F.col("c_acctbal") >= 100) & (F.col("c_acctbal") < 500) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_nationkey") == 3)
    return made.agg(F.count("*").alias("n"), F.count_distinct("_id").alias("n_ids"), F.bool_and(met).alias("met"))


@query(None, "customer")
def generate_constrained(customer):
    known = model.infer(customer)
    made = generate.generate(customer.sparkSession, known, customer.count(), seed=1, query={"c_acctbal": {"$gte": 100, "$lt": 500}, "c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}, "c_nationkey": 3})
    return made


@query("SELECT i AS index FROM range(1000) AS r(i)")
def default_scan(spark):
    return default_documents(spark, 1000).select("index")


_STEPS = [
    tides.Step("night", D(2024, 1, 1), D(2024, 1, 1, 6), {"type": "object", "properties": {"x": {"type": "integer", "minimum": 1, "maximum": 9}}, "required": ["x"]}, documents=2, probability=0.5),
    tides.Step("day", D(2024, 1, 1, 6), D(2024, 1, 2), {"type": "object", "properties": {"y": {"type": "boolean"}}, "required": ["y"]}, documents=3),
]
_TIDE = tides.Tide("days", D(2024, 1, 1), D(2024, 1, 2), 60_000, _STEPS, seed=5)


@query("SELECT 'night' AS step_id, 360 AS intervals, 360 AS estimated UNION ALL SELECT 'day', 1080, 3240")
def tide_statistics(spark):
    return tides.tide_statistics(spark, _TIDE)


@query("SELECT i AS tick, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * i AS ts FROM range(1440) AS r(i)")
def tide_ticks(spark):
    return tides.tide_ticks(spark, _TIDE).select("tick", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT 'day' AS step_id, 3240 AS n")
def tide_day_documents(spark):
    return tides.tide_documents(spark, _TIDE).where("step_id = 'day'").groupBy("step_id").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", "events")
def windowed_events(events):
    out = tides.windowed(events, "ts", "1 hour", keys=("event_type",), value="value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    "events",
)
def session_events(events):
    out = tides.sessions(events, "ts", "user_id", "6 hours")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# Orders of text, skips, samples


@query(
    """SELECT o_orderstatus AS _id, arg_min(o_orderkey, rn) AS first_key, arg_max(o_orderkey, rn) AS last_key
       FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC, o_orderkey) AS rn FROM orders) GROUP BY 1""",
    "orders",
)
def acc_first_last_text(orders):
    return aggregate(orders, [{"$sort": {"o_orderpriority": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_orderstatus", "first_key": {"$first": "$o_orderkey"}, "last_key": {"$last": "$o_orderkey"}}}])


@query("SELECT conv_id AS _id, string_agg(role || turn, ',' ORDER BY role DESC, turn) AS said FROM conversations GROUP BY 1", "conversations")
def acc_push_text(conversations):
    rows = conversations.withColumn("said", F.concat("role", F.col("turn").cast("string")))
    return aggregate(rows, [{"$sort": {"role": -1, "turn": 1}}, {"$group": {"_id": "$conv_id", "said": {"$push": "$said"}}}]).withColumn("said", F.array_join("said", ","))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 300", "orders")
def sort_skip(orders):
    return aggregate(orders, [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 300}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 500", "orders")
def find_skip(orders):
    return find(orders, sort={"o_orderdate": 1, "o_orderkey": 1}, skip=500, projection={"o_orderkey": 1})


@query("SELECT 50 AS n, 50 AS n_distinct, 50 AS n_known", "customer")
def sample_rows(customer):
    some = aggregate(customer, [{"$sample": {"size": 50}}], seed=3)
    return some.join(customer.select("c_custkey", F.lit(1).alias("known")), "c_custkey", "left").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("n_distinct"), F.count("known").alias("n_known"))


# Shapes and filters


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 5", "customer")
def find_exclusion(customer):
    return find(customer, {"c_nationkey": {"$lt": 5}}, {"c_acctbal": 0, "c_mktsegment": 0, "c_nationkey": 0})


@query("SELECT * FROM nation WHERE n_regionkey = 1", "nation")
def find_whole_document(nation):
    return find(nation, {"n_regionkey": 1}, {"__doc": "$$ROOT"})


@query("SELECT r_regionkey, r_name AS name, [r_regionkey, 7][2] AS second, r_name || '!' AS deep FROM region", "region")
def expr_root_and_lists(region):
    out = aggregate(region, [{"$project": {"r_regionkey": 1, "doc": "$$ROOT", "pair": ["$r_regionkey", 7]}}, {"$addFields": {"doc.mark.deep": {"$concat": ["$doc.r_name", "!"]}}}, {"$unset": "doc.r_regionkey"}])
    return out.select("r_regionkey", F.col("doc.r_name").alias("name"), F.get("pair", F.lit(1)).alias("second"), F.col("doc.mark.deep").alias("deep"))


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 2", "nation")
def predicates_deep_equality(nation):
    rows = aggregate(nation, [{"$addFields": {"at": {"region": "$n_regionkey", "is": {"known": True}}}}])
    return find(rows, {"at": {"region": 2, "is": {"known": True}}}, {"n_nationkey": 1})


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000", "orders")
def count_query(orders):
    return orders.sparkSession.createDataFrame([(count(orders, {"o_orderstatus": "F", "o_totalprice": {"$gt": 1000}}),)], "n long")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 90", "events")
def predicates_variant_path(events):
    rows = events.withColumn("doc", F.parse_json("props"))
    return find(rows, {"doc.k": {"$gte": 90, "$exists": True}, "doc.other": {"$exists": False}}, {"event_id": 1})


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "documents", "labels")
def lookup_anti_labels(documents, labels):
    stages = [{"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "l"}}, {"$match": {"l": {"$size": 0}}}, {"$project": {"doc_id": 1}}]
    return aggregate(documents, stages, {"labels": labels})


@query(
    """SELECT c.c_custkey, i.k AS k, i.word AS word FROM customer c LEFT JOIN (SELECT c_custkey, unnest(range(2)) AS k, unnest([c_mktsegment, 'x']) AS word FROM customer WHERE c_acctbal > 5000) i USING (c_custkey)""",
    "customer",
)
def unwind_outer_index(customer):
    rows = customer.withColumn("words", F.when(F.col("c_acctbal") > 5000, F.array("c_mktsegment", F.lit("x"))))
    return aggregate(rows, [{"$unwind": {"path": "$words", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "k"}}, {"$project": {"c_custkey": 1, "k": 1, "word": "$words"}}])


@query("SELECT vec_id, label, embedding[1] AS head FROM embeddings WHERE label = 4", "embeddings")
def predicates_array_equality(embeddings):
    rows = embeddings.withColumn("pair", F.array("label", F.lit(1)))
    return find(rows, {"pair": [4, 1]}).select("vec_id", "label", F.get("embedding", F.lit(0)).alias("head"))


# Updates


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS c_mktsegment, c_acctbal FROM customer", "customer")
def update_unset(customer):
    return updates.update(customer, {"c_nationkey": 3}, {"$unset": {"c_mktsegment": ""}}).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT vec_id, CASE WHEN label = 3 THEN 2 ELSE 3 END AS n FROM embeddings", "embeddings")
def update_pull(embeddings):
    rows = embeddings.withColumn("tags", F.array("label", F.lit(100), F.lit(200)))
    return updates.update(rows, {}, {"$pull": {"tags": 3}}).select("vec_id", F.size("tags").alias("n"))


@query("SELECT * FROM supplier UNION ALL SELECT -1, 'fresh', 7, NULL", "supplier")
def update_upsert(supplier):
    return updates.update(supplier, {"s_suppkey": -1, "s_nationkey": 7}, {"$set": {"s_name": "fresh"}}, upsert=True)


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN 'merged' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_nationkey = 7 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier", "supplier")
def update_merge(supplier):
    return updates.update(supplier, {"s_nationkey": 7}, {"s_name": "merged", "s_acctbal": 1.5})


@query("SELECT s_suppkey, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 100) THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier", "supplier")
def update_first(supplier):
    return updates.update(supplier, {"s_acctbal": {"$gt": 100}}, {"$set": {"s_acctbal": 0.0}}, multi=False, order=["s_suppkey"]).select("s_suppkey", "s_acctbal")


# Sources and sinks


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'merged' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'new', 5", "nation")
def out_and_merge(nation):
    """`$out` writes a collection, `$merge` replaces some of its documents and adds one; then it is read back."""
    spark, root = nation.sparkSession, new_folder(nation.sparkSession, "collections")
    target = aggregate(nation, [{"$out": "nations"}], output_dir=root)
    change = aggregate(nation, [{"$match": {"n_regionkey": 0}}, {"$set": {"n_name": "merged"}}]).unionByName(spark.createDataFrame([(99, "new", 5)], "n_nationkey int, n_name string, n_regionkey int"))
    aggregate(change, [{"$merge": {"into": "nations", "on": "n_nationkey"}}], {"nations": target}, output_dir=root)
    return read_collection(spark, root, "nations")


@query("SELECT n_nationkey, n_name FROM nation", "nation")
def json_source(nation):
    """A JSON document of regions with lists of nations, written and read back."""
    folder = new_folder(nation.sparkSession, "json")
    regions = nation.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    regions.agg(F.collect_list(F.struct("*")).alias("docs")).write.json(folder)  # five regions: one file of one document
    docs = read_json(nation.sparkSession, folder).select(F.explode("docs").alias("doc"))
    return docs.select(F.explode("doc.nations").alias("n")).select(F.col("n.n_nationkey").cast("int").alias("n_nationkey"), "n.n_name")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, s_acctbal, s_acctbal > 0 AS in_credit, s_name || ', \"x\"' AS quoted FROM supplier", "supplier")
def csv_source(supplier):
    """Numbers, booleans, commas and quotes, written with a header and read back."""
    folder = new_folder(supplier.sparkSession, "csv")
    rows = supplier.select("s_suppkey", "s_name", "s_acctbal", (F.col("s_acctbal") > 0).alias("in_credit"), F.concat("s_name", F.lit(', "x"')).alias("quoted"))
    rows.write.csv(folder, header=True, quote='"', escape='"')
    return read_csv(supplier.sparkSession, folder)


# Models


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1", "customer")
def merge_value_frequencies(customer):
    halves = [model.infer(customer.where(F.col("c_custkey") % 2 == k).select("c_mktsegment")) for k in (0, 1)]
    merged = model.merge(*halves)["properties"]["c_mktsegment"]["stringModel"]["valueFrequency"]
    return customer.sparkSession.createDataFrame(list(merged.items()), "value string, n long")


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) WHERE ch <> '' GROUP BY 1", "part")
def merge_characters(part):
    halves = [model.infer(part.where(F.col("p_partkey") % 2 == k).select("p_name")) for k in (0, 1)]
    merged = model.merge(*halves)["properties"]["p_name"]["stringModel"]["characterFrequency"]
    return part.sparkSession.createDataFrame(list(merged.items()), "ch string, n long")


@query("SELECT count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, round(stddev_samp(c_acctbal), 0) > 0 AS spread, count(*) AS in_bins FROM customer", "customer")
def merge_histograms(customer):
    rows = customer.select(F.col("c_acctbal").cast("double").alias("v"), "c_custkey")
    halves = [model.infer(rows.where(F.col("c_custkey") % 2 == k).select("v"))["properties"]["v"] for k in (0, 1)]
    branches = [[b for b in h.get("anyOf", [h]) if "histogram" in b] for h in halves]
    by_type = {}
    for b in [x for half in branches for x in half]:
        by_type[b["type"]] = model.merge_histograms(by_type[b["type"]], b["histogram"]) if b["type"] in by_type else b["histogram"]
    both = list(by_type.values())
    missing = sum(h["count"] for h in halves) - sum(h["totalCount"] for h in both)  # branches of fewer than ten values have no histogram
    low = min(x["minimum"] for h in halves for x in h.get("anyOf", [h]))
    high = max(x["maximum"] for h in halves for x in h.get("anyOf", [h]))
    off = abs(sum(b["count"] for h in both for b in h["bins"]) - sum(h["totalCount"] for h in both))
    n = sum(h["totalCount"] for h in both) + missing
    return customer.sparkSession.createDataFrame([(n, float(low), float(high), max(h["standardDeviation"] for h in both) > 0, n if off <= 10 else -1)], "n long, low double, high double, spread boolean, in_bins long")


@query("SELECT c_custkey, (CASE WHEN length(c_mktsegment) > 9 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(c_mktsegment, '[^A-LN-Z]') THEN 1 ELSE 0 END) AS n_outliers, length(c_mktsegment) <= 9 AND NOT regexp_matches(c_mktsegment, '[^A-LN-Z]') AS clean FROM customer", "customer")
def validate_text(customer):
    """Lengths and unknown characters through the library's own scoring."""
    known = {"properties": {"c_mktsegment": {"type": "string", "stringModel": {"minLength": 1, "maxLength": 9, "uniqueCharacters": list("ABCDEFGHIJKLNOPQRSTUVWXYZ"), "complexity": 1e9}}}}
    return validate.score(customer, known).select("c_custkey", F.size("outliers").alias("n_outliers"), (F.col("score") == 0).alias("clean"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x < -0.2 OR x > 0.2)) AS n_outliers FROM embeddings", "embeddings")
def validate_items(embeddings):
    """The items of lists, one by one."""
    known = {"properties": {"embedding": {"type": "array", "items": {"type": "number", "histogram": {"minValue": -0.2, "maxValue": 0.2, "standardDeviation": 0}}}}}
    rows = embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return validate.score(rows, known).select("vec_id", F.size("outliers").alias("n_outliers"))


@query("SELECT c_custkey, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND length(c_mktsegment) > 1 AS judged FROM customer", "customer")
def validate_known_values(customer):
    """Values that the model was trained on are never outliers."""
    known = {"properties": {"c_mktsegment": {"type": "string", "stringModel": {"minLength": 1, "maxLength": 1, "valueFrequency": {"BUILDING": 1, "MACHINERY": 1}, "complexity": 1e9}}}}
    return validate.score(customer, known).select("c_custkey", (F.size("outliers") > 0).alias("judged"))


@query("SELECT 'c_acctbal' AS path, avg(CASE WHEN c_acctbal > 1000 THEN 1.0 ELSE 0 END) AS coverage FROM customer UNION ALL SELECT 'c_custkey', 1", "customer")
def model_coverage(customer):
    rows = customer.select("c_custkey", F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("c_acctbal"))
    return model.coverage(rows, {"properties": {"c_custkey": {}, "c_acctbal": {}}}).select("path", "coverage")


@query("SELECT count(*) AS n, count(*) AS n_distinct FROM orders", "orders")
def train_split(orders):
    a, b = model.split(orders.select("o_orderkey"))
    return a.union(b).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_distinct"))


@query("SELECT k AS path, k AS format FROM (SELECT unnest(['email', 'uri', 'uuid', 'date-time', 'date', 'time', 'ipv4', 'ipv6']) AS k)", "supplier")
def infer_all_formats(supplier):
    """A column of each format made from the keys."""
    k, n = F.col("s_suppkey"), F.lpad(F.hex("s_suppkey"), 4, "0")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day, clock = F.concat(F.lit("2024-05-"), two(k % 28 + 1)), F.concat(two(k % 24), F.lit(":"), two(k % 60), F.lit(":00"))
    made = {
        "email": F.concat(F.lit("s"), k.cast("string"), F.lit("@example.org")), "uri": F.concat(F.lit("https://example.org/"), k.cast("string")), "uuid": F.concat(F.lit("123e4567-e89b-12d3-a456-42661417"), n), "date-time": F.concat(day, F.lit("T"), clock, F.lit("Z")), "date": day, "time": clock,
        "ipv4": F.concat(F.lit("10.0."), (k % 200).cast("string"), F.lit(".7")), "ipv6": F.concat(F.lit("2001:db8:0:0:0:0:0:"), n),
    }
    names = {name: f"f{i}" for i, name in enumerate(made)}
    found = profile.format_of(supplier.select(*[c.alias(names[name]) for name, c in made.items()]), list(names.values()))
    return found.select(F.element_at(F.create_map(*[F.lit(x) for name, col in names.items() for x in (col, name)]), F.col("path")).alias("path"), "format")


# Generation, held against what it must keep


@query("SELECT count(*) AS n, count(*) AS n_ids, true AS in_range, true AS in_enum, true AS same_again FROM customer", "customer")
def generate_customer_ranges(customer):
    """As many documents as customers, with ids of their own, within the bounds and values of the table; the seed gives the same ones again."""
    known, n = model.infer(customer), customer.count()
    made, again = (generate.generate(customer.sparkSession, known, n, seed=9) for _ in range(2))
    bounds = customer.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.min("c_nationkey").alias("first"), F.max("c_nationkey").alias("last"), F.collect_set("c_mktsegment").alias("segments")).first()  # five segments
    differs = made.join(again.select("_id", F.col("c_acctbal").alias("other")), "_id").where(~F.col("c_acctbal").eqNullSafe(F.col("other"))).count()
    inside = F.col("c_acctbal").between(bounds["lo"], bounds["hi"]) & F.col("c_nationkey").between(bounds["first"], bounds["last"])
    return made.agg(F.count("*").alias("n"), F.count_distinct("_id").alias("n_ids"), F.bool_and(inside).alias("in_range"), F.bool_and(F.col("c_mktsegment").isin(bounds["segments"])).alias("in_enum"), F.lit(differs == 0).alias("same_again"))


@query("SELECT event_type, true AS close FROM events GROUP BY 1", "events")
def generate_shares(events):
    """Values of an enum come as often as they should: each as often as any other."""
    kinds = events.select("event_type").distinct().count()
    made = generate.generate(events.sparkSession, model.infer(events.select("event_type")), 20_000, seed=4)
    return made.groupBy("event_type").agg((F.abs(F.count("*") / 20_000 - 1 / kinds) < 0.02).alias("close"))


@query("SELECT k AS format, 500 AS n FROM (SELECT unnest(['email', 'uri', 'uuid', 'date-time', 'date', 'time', 'ipv4', 'ipv6']) AS k)")
def generate_formats(spark):
    """Texts of each format, counted where they have it."""
    names = list(profile.FORMATS)
    known = {"type": "object", "properties": {f"f{i}": {"type": "string", "format": k} for i, k in enumerate(names)}, "required": [f"f{i}" for i in range(len(names))]}
    made = generate.generate(spark, known, 500, seed=2)
    each = F.array(*[F.struct(F.lit(k).alias("format"), F.col(f"f{i}").rlike(profile.FORMATS[k]).alias("ok")) for i, k in enumerate(names)])
    return made.select(F.explode(each).alias("f")).where("f.ok").groupBy("f.format").agg(F.count("*").alias("n"))


@query("SELECT min(len(embedding)) AS shortest, max(len(embedding)) AS longest, count(*) AS n FROM embeddings", "embeddings")
def generate_arrays(embeddings):
    made = generate.generate(embeddings.sparkSession, model.infer(embeddings.select("embedding")), embeddings.count(), seed=6)
    return made.agg(F.min(F.size("embedding")).alias("shortest"), F.max(F.size("embedding")).alias("longest"), F.count("*").alias("n"))


@query("SELECT 400 AS n, true AS in_lengths, true AS in_pattern, true AS multiples, true AS nested", "part")
def generate_text_patterns(part):
    """Lengths of a text model, a pattern, multiples, and a document within the document."""
    known = {"type": "object", "properties": {
        "name": model.infer(part.select("p_name"))["properties"]["p_name"], "code": {"type": "string", "pattern": "^[A-Z]{2,4}-\\d{3,5}$"}, "step": {"type": "integer", "minimum": 0, "maximum": 90, "multipleOf": 15},
        "inner": {"type": "object", "properties": {"flag": {"type": "boolean"}}, "required": ["flag"]},
    }, "required": ["name", "code", "step", "inner"]}
    lengths = part.agg(F.min(F.length("p_name")).alias("low"), F.max(F.length("p_name")).alias("high")).first()
    made = generate.generate(part.sparkSession, known, 400, seed=8)
    return made.agg(F.count("*").alias("n"), F.bool_and(F.length("name").between(lengths["low"], lengths["high"])).alias("in_lengths"), F.bool_and(F.col("code").rlike("^[A-Z]{2,4}-[0-9]{3,5}$")).alias("in_pattern"), F.bool_and(F.col("step") % 15 == 0).alias("multiples"), F.bool_and(F.col("inner.flag").isNotNull()).alias("nested"))


@query("SELECT step_id, true AS close FROM (SELECT unnest(['day', 'night']) AS step_id)")
def tide_probabilities(spark):
    """The night's steps come with a probability of a half."""
    made = tides.tide_documents(spark, _TIDE).groupBy("step_id").agg(F.count("*").alias("n"))
    wanted = F.when(F.col("step_id") == "night", 360.0).otherwise(3240.0)
    return made.select("step_id", (F.abs(F.col("n") / wanted - 1) < 0.2).alias("close"))
