"""Sample documents from prompts, from other samples, under constraints, and in diverse batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import model as models
from .functions.generate import generate
from .prompts import analyze

CONSTRAINT_KEYS = ("minimum", "maximum", "minLength", "maxLength", "pattern", "enum", "format", "minItems", "maxItems", "multipleOf")


def from_prompt(spark: SparkSession, prompt: str, count: int = 5, seed: int = 0, refine: bool = False) -> DataFrame:
    """Documents that a prompt describes. With refine they are generated again from a model trained on a first lot."""
    known = analyze(prompt).model
    first = generate(spark, known, count, seed, with_id=False)
    if not refine:
        return first
    return generate(spark, merge_models(known, models.infer(first)), count, seed + 1, with_id=False)


def from_analysis(spark: SparkSession, prompt: str) -> DataFrame:
    """One document with the names of its model and collection."""
    a = analyze(prompt)
    name = a.entities[0] if a.entities else "document"
    return generate(spark, a.model, 1, with_id=False).select("*", F.lit(name).alias("_modelName"), F.lit(f"{name}s").alias("_collection"))


def from_samples(samples: DataFrame, count: int, seed: int = 0) -> DataFrame:
    return generate(samples.sparkSession, models.infer(samples), count, seed)


def with_constraints(model: dict, constraints: dict[str, dict]) -> dict:
    """The model with a field's constraints set: {field: {minimum, maxLength, enum, required, ...}}."""
    properties, required = dict(model.get("properties", {})), set(model.get("required", []))
    for name, c in constraints.items():
        if unknown := set(c) - {*CONSTRAINT_KEYS, "required", "type"}:
            raise ValueError(f"unknown constraints of {name}: {sorted(unknown)}")
        kept = {k: v for k, v in properties.get(name, {"type": "string"}).items() if k not in ("histogram", "stringModel", "anyOf")}
        properties[name] = kept | {k: v for k, v in c.items() if k != "required"}
        if c.get("required"):
            required.add(name)
        elif c.get("required") is False:
            required.discard(name)
    return {**model, "properties": properties, "required": sorted(required)}


def constrained(spark: SparkSession, prompt: str, constraints: dict[str, dict], count: int = 5, seed: int = 0) -> DataFrame:
    return generate(spark, with_constraints(analyze(prompt).model, constraints), count, seed, with_id=False)


def diverse(spark: SparkSession, prompt: str, batches: int = 3, count: int = 5, seed: int = 0) -> DataFrame:
    """batches lots of count documents, each with its own seed and numbers from a wider range than the one before; column _batch."""
    known, parts = analyze(prompt).model, []
    for i in range(batches):
        wider = {n: {**p, "maximum": p["maximum"] + type(p["maximum"])((p["maximum"] - p["minimum"]) * i / batches)} if "maximum" in p and "minimum" in p else p for n, p in known["properties"].items()}
        parts.append(generate(spark, {**known, "properties": wider}, count, seed + i, with_id=False).withColumn("_batch", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def merge_models(described: dict, inferred: dict) -> dict:
    """A described and an inferred model: the inferred field wins, but what only the description says (a format, an enum) stays; required are those of both."""
    properties = dict(described.get("properties", {}))
    for name, p in inferred.get("properties", {}).items():
        old = properties.get(name, {})
        properties[name] = {**{k: v for k, v in old.items() if k in ("format", "enum", "pattern") and p.get("type") == old.get("type")}, **p}
    return {**described, "properties": properties, "required": sorted(set(described.get("required", [])) | set(inferred.get("required", [])) & set(properties))}


def train_from_prompt(spark: SparkSession, prompt: str, rounds: int = 3, count: int = 100, seed: int = 0) -> dict:
    """A model from a prompt, refined: generate, train on what was generated, and again."""
    known = analyze(prompt).model
    for i in range(rounds):
        known = merge_models(known, models.infer(generate(spark, known, count, seed + i, with_id=False)))
    return known


def train_family(spark: SparkSession, prompts: dict[str, str], **options) -> tuple[dict[str, dict], dict[str, str]]:
    """(models, errors) by name: one prompt that fails doesn't stop the others."""
    made, failed = {}, {}
    for name, prompt in prompts.items():
        try:
            made[name] = train_from_prompt(spark, prompt, **options)
        except ValueError as e:
            failed[name] = str(e)
    return made, failed
