"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 1_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most_rows: int) -> DataFrame:
    """``doc_id, text, y`` of about ``most_rows`` labelled rows at most, chosen by a hash of the id.

    Rows with a null label are left out; of several labels of an id the greatest counts, and of several
    rows of an id the one of the least text, so that no id gives more than one row.  The chosen ids are few by construction,
    so they are broadcast to the documents.
    """
    found = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null").where(allowed)
    total = found.count()
    share = min(STEPS, STEPS * most_rows // max(total, 1))
    chosen = found.where(F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(STEPS)) < share).groupBy("doc_id").agg(F.max("y").alias("y"))
    met = docs.join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
