"""Fact files: JSON lines of ``{"key": ..., "value": ...}``, references nested or as ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.schema.model import Ref, Schema
from factloom.sources.store import Database, Written, nested_type


def read_facts(spark: SparkSession, schema: Schema, predicate: str, path: str, depth: int = 3, streaming: bool = False) -> DataFrame:
    """The facts of a JSON-lines path; references are whole facts down to ``depth``, then ids. A malformed line is an error."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(nested_type(schema, Ref(predicate), depth + 1)).option("mode", "FAILFAST").json(path)


def ingest_json(db: Database, predicate: str, path: str, depth: int = 3) -> Written:
    return db.write({predicate: read_facts(db.spark, db.schema, predicate, path, depth)})
