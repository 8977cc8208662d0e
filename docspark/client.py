"""Client().database.collection: the facade over stored documents and models.

A collection with stored documents answers from them; one that only has a model answers with generated documents.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import model as models
from .functions.generate import generate, object_id
from .operators import updates
from .plans import aggregate, find
from .plans.pipeline import generation_parameters
from .operators.predicates import generation_params
from .sources.collections import drop_collection, drop_pending, list_collections, read_collection, read_pending, write_collection, write_pending
from .sources.models import ModelStore

#: Documents that a find over a model returns if no limit is given.
DEFAULT_LIMIT = 100
#: Inserted documents after which a collection's model is trained on them.
TRAIN_AT = 10


class Client:
    def __init__(self, spark: SparkSession, root: str, models_root: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.models = ModelStore(models_root or self.root.removeprefix("file://") + "/_models")

    def __getitem__(self, name: str) -> Database:
        return Database(self, name)

    def __getattr__(self, name: str) -> Database:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def list_database_names(self) -> list[str]:
        return sorted({*list_collections(self.spark, self.root), *self.models.databases()})

    def drop_database(self, name: str) -> None:
        for collection in self[name].list_collection_names():
            self[name][collection].drop()

    def command(self, name: str) -> dict:
        """The few service commands that make sense without a server."""
        answers = {"ping": {}, "hello": {"isWritablePrimary": True}, "buildInfo": {"version": self.spark.version}, "connectionStatus": {"authInfo": {}}, "hostInfo": {"system": {"numCores": self.spark.sparkContext.defaultParallelism}}}
        if name not in answers:
            raise ValueError(f"no such command: {name}")
        return {**answers[name], "ok": 1}


class Database:
    def __init__(self, client: Client, name: str):
        self.client, self.name = client, name

    def __getitem__(self, name: str) -> Collection:
        return Collection(self, name)

    def __getattr__(self, name: str) -> Collection:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def list_collection_names(self) -> list[str]:
        return sorted({*list_collections(self.client.spark, f"{self.client.root}/{self.name}"), *self.client.models.collections(self.name)})


class Cursor:
    """Documents in batches, without gathering them all on the driver."""

    def __init__(self, df: DataFrame, batch_size: int = 101):
        self.df, self.batch_size = df, batch_size

    def __iter__(self) -> Iterator[Row]:
        return iter(self.df.toLocalIterator(prefetchPartitions=True))

    def batches(self) -> Iterator[list[Row]]:
        batch: list[Row] = []
        for row in self:
            batch.append(row)
            if len(batch) == self.batch_size:
                yield batch
                batch = []
        if batch:
            yield batch


class Collection:
    def __init__(self, database: Database, name: str):
        self.database, self.name, self.client = database, name, database.client
        self.spark, self.folder = self.client.spark, f"{self.client.root}/{database.name}"

    # Sources

    def stored(self) -> DataFrame | None:
        return read_collection(self.spark, self.folder, self.name) if self.name in list_collections(self.spark, self.folder) else None

    def model(self) -> dict | None:
        return self.client.models.get(self.database.name, self.name)

    def documents(self, query: dict | None = None, count: int = DEFAULT_LIMIT) -> DataFrame | None:
        """Stored documents, or else `count` generated ones that meet the query, or None."""
        if (df := self.stored()) is not None:
            return df
        if (known := self.model()) is not None:
            return generate(self.spark, known, count, query=query)
        return None

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "_id string")

    # Reading

    def find_frame(self, query: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
        source = self.documents(query, (limit or DEFAULT_LIMIT) + skip)
        if source is None:
            return self._empty()
        return find(source, generation_params(query or {})[1], projection, sort, skip, limit)

    def find(self, query=None, projection=None, sort=None, skip=0, limit=None, batch_size=101) -> Cursor:
        return Cursor(self.find_frame(query, projection, sort, skip, limit), batch_size)

    def find_one(self, query: dict | None = None, projection: dict | None = None) -> Row | None:
        return self.find_frame(query, projection, limit=1).first()

    def count_documents(self, query: dict | None = None) -> int:
        """Of stored documents those that match; of a collection that only has a model, those that find() gives."""
        if (df := self.stored()) is not None:
            return find(df, query).count()
        return self.find_frame(query, limit=DEFAULT_LIMIT).count()

    def aggregate(self, pipeline: list[dict], count: int = DEFAULT_LIMIT, collections: dict[str, DataFrame] | None = None, **options) -> DataFrame:
        params, rest = generation_parameters(pipeline)
        first = rest[0]["$match"] if rest and "$match" in rest[0] else {}
        source = self.documents({**first, **{f"${k}": v for k, v in params.items()}}, count)
        others = {n: self.database[n].stored() for n in list_collections(self.spark, self.folder)}
        return aggregate(self._empty() if source is None else source, rest, {**others, **(collections or {})}, output_dir=self.folder, **options)

    # Writing

    def insert(self, documents: DataFrame) -> int:
        """Appends documents (with an _id where they have none). Once TRAIN_AT documents have come since the model was last trained, it is trained on them."""
        n = documents.count()
        if not n:
            return 0
        if "_id" not in documents.columns:
            documents = documents.select(object_id(F.lit(0), F.xxhash64(F.struct("*"), F.uuid())).alias("_id"), "*")
        old = self.stored()
        if old is None:
            write_collection(documents, self.folder, self.name)
        elif old.schema == documents.schema:
            write_collection(documents, self.folder, self.name, "append")
        else:
            write_collection(old.unionByName(documents, allowMissingColumns=True), self.folder, self.name)
        waiting = read_pending(self.spark, self.folder, self.name)
        if waiting is not None:
            documents = waiting.unionByName(documents, allowMissingColumns=True)
        if n >= TRAIN_AT or documents.limit(TRAIN_AT).count() == TRAIN_AT:
            self.train(documents)
            drop_pending(self.spark, self.folder, self.name)
        else:
            write_pending(documents, self.folder, self.name)
        return n

    def train(self, documents: DataFrame) -> dict:
        known = models.train(documents, self.model())
        self.client.models.save(self.database.name, self.name, known)
        return known

    def _rewrite(self, change) -> dict:
        df = self.stored()
        if df is None:
            return {"matched": 0, "modified": 0}
        return change(df)

    def update(self, query: dict, change: dict, multi: bool = True, upsert: bool = False) -> dict:
        def run(df):
            counts = updates.modified_count(df, query, change).first().asDict()
            write_collection(updates.update(df, query, change, multi, upsert), self.folder, self.name)
            return counts if multi else {k: min(v, 1) for k, v in counts.items()}

        return self._rewrite(run)

    def delete(self, query: dict, multi: bool = True) -> int:
        def run(df):
            matched = find(df, query).count()
            write_collection(updates.delete(df, query, multi), self.folder, self.name)
            return {"matched": matched if multi else min(matched, 1)}

        return self._rewrite(run)["matched"]

    def drop(self) -> None:
        drop_collection(self.spark, self.folder, self.name)
        drop_pending(self.spark, self.folder, self.name)
        self.client.models.delete(self.database.name, self.name)

    def stats(self) -> dict:
        df = self.stored()
        return {"count": 0 if df is None else df.count(), "fields": [] if df is None else df.columns, "model": self.client.models.stats(self.database.name, self.name)}
