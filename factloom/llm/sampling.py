"""Bounded, deterministic samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def per_class_sample(keys: DataFrame, label: str, per_class: int, total: int) -> DataFrame:
    """At most ``per_class`` rows of ``keys`` (``doc_id`` and ``label``) of each label, ``total`` in all, by the hash of their ids.

    Two passes over the two columns: the first counts the labels, the second keeps about as many as are wanted of each
    before the exact cut, so that only about a sample is ever sorted.
    """
    counts = {r[0]: r[1] for r in keys.groupBy(label).count().collect()}  # a number for each label
    if not counts:
        return keys.select("doc_id", label).limit(0)
    want = max(1, min(per_class, total // len(counts)))
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * want / n + 40 / n)))))
    number = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    kept = keys.select("doc_id", label, number.alias("_u")).where(F.col("_u") < F.element_at(share, F.col(label)))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_u", "doc_id"))
    return kept.withColumn("_r", rank).where(F.col("_r") <= want).select("doc_id", label).distinct()
