"""Corpus pipeline: quality rules, quality classifier, line dedup, n-gram Jaccard join, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the
stage before has kept.  Documents are told apart by id and text together, so that texts that share an id, or have none, get verdicts of their own; rows that
repeat both are one document for the rules, and one of them is packed.  A null text has no words and goes with the first stage; an empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import jaccard_join, line_dedup, packing, quality_classifier, quality_rules
from blockloom.llm.common import row_key
from blockloom.session import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with the key ``__key`` of id and text."""
    return docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias("__key"))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of ``_keyed`` whose key is the one column of ``keys``."""
    return docs.join(keys.toDF("__kept").distinct(), F.col("__key") == F.col("__kept"), "left_semi")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their host's verdict."""
    docs = _keyed(docs)
    return _only(docs, quality_rules.apply_rules(docs, carry=("__key",)).where("kept").select("__key")).select(*COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = quality_classifier.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return quality_classifier.accepted(docs.select(*COLUMNS), forest)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose first near copy stands elsewhere; a document that loses all its words goes."""
    return line_dedup.clean(docs.select(*COLUMNS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each class of near duplicates."""
    return _only(_keyed(docs), keep(jaccard_join.representatives(docs), "representatives")).dropDuplicates(["__key"]).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("packing", packing_stage),
]

#: The classifier, the edit join and the packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
