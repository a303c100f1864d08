"""Operators on the rows of blocks: filter, dedupe, pad, sort, rename.

Prefix lists are small tables that users write by hand; they travel as literals
inside expressions, so no row is shuffled for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.schema import ROW_COLUMNS


def check_prefixes(prefixes: list[str]) -> list[str]:
    """The list itself; raises if an entry is empty or the prefix of another, which would make matches ambiguous."""
    for i, p in enumerate(prefixes):
        if not p:
            raise ValueError("a prefix is empty")
        if any(q.startswith(p) for j, q in enumerate(prefixes) if i != j):
            raise ValueError(f"{p!r} is a prefix of another entry")
    return prefixes


def prefix_index(name: Column, prefixes: list[str]) -> Column:
    """Position of the entry that ``name`` begins with, -1 if there is none."""
    return reduce(lambda rest, p: F.when(name.startswith(p[1]), p[0]).otherwise(rest), reversed([*enumerate(check_prefixes(prefixes))]), F.lit(-1)).cast("int")


def _renumbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``row_index`` from 0 again inside each block, in the given order."""
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(*order)) - 1
    return rows.withColumn("row_index", rank.cast("long"))


def filter_rows(rows: DataFrame, prefixes: list[str], keep_first: bool = True) -> DataFrame:
    """Drop rows whose name begins with one of ``prefixes``; ``keep_first`` protects the reference."""
    kept = prefix_index(F.col("sequence_name"), prefixes) < 0
    return _renumbered(rows.where(kept | (F.col("row_index") == 0) if keep_first else kept), "row_index")


def dedupe_rows(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """Keep the first row of each prefix in a block; rows without a prefix stay."""
    rows = rows.withColumn("p", prefix_index(F.col("sequence_name"), prefixes))
    nth = F.row_number().over(Window.partitionBy("block_id", "p").orderBy("row_index"))
    return _renumbered(rows.withColumn("nth", nth).where("p < 0 or nth = 1").drop("p", "nth"), "row_index")


def pad_rows(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """Add an all-gap row for each prefix that a block lacks, after its other rows in the order of the list."""
    listed = F.array(*[F.lit(p) for p in check_prefixes(prefixes)])
    found = F.array_distinct(F.collect_list(F.when(F.col("p") >= 0, F.get(listed, F.col("p")))))
    blocks = rows.withColumn("p", prefix_index(F.col("sequence_name"), prefixes)).groupBy("block_id").agg(found.alias("found"), F.max("row_index").alias("top"), F.max(F.length("bases")).alias("w"))
    missing = blocks.select("block_id", "top", "w", F.posexplode(F.filter(listed, lambda p: ~F.array_contains(F.col("found"), p))).alias("k", "sequence_name"))
    padding = missing.select("block_id", (F.col("top") + 1 + F.col("k")).alias("row_index"), "sequence_name", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(True).alias("strand"), F.lit(0).cast("long").alias("sequence_length"), F.expr("repeat('-', w)").alias("bases"))
    return rows.select(*ROW_COLUMNS).unionByName(padding)


def sort_rows(rows: DataFrame, prefixes: list[str] | None = None, keep_first: bool = True) -> DataFrame:
    """Order rows by prefix (those without one first), name, strand (+ first) and start; ``keep_first`` pins the reference."""
    order = [prefix_index(F.col("sequence_name"), prefixes)] if prefixes else []
    pinned = [F.col("row_index") != 0] if keep_first else []
    return _renumbered(rows, *pinned, *order, F.col("sequence_name"), F.col("strand").desc(), F.col("start"), F.col("row_index"))


def sort_pipeline(rows: DataFrame, sort_by: list[str], filter_by: list[str] | None = None, pad: bool = False, dedupe: bool = False, keep_first: bool = True) -> DataFrame:
    """Filter, pad, sort and dedupe, in this order."""
    if filter_by:
        rows = filter_rows(rows, filter_by, keep_first)
    if pad:
        rows = pad_rows(rows, sort_by)
    rows = sort_rows(rows, sort_by, keep_first)
    return dedupe_rows(rows, sort_by) if dedupe else rows


def rename(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Replace whole names, else the genome before a dot, by ``names`` (``old, new``); the shortest match of a dotted prefix wins.

    ``names`` is a plain join side: Spark broadcasts it by its size.
    """
    parts = F.split("sequence_name", "\\.")
    candidates = F.concat(F.array("sequence_name"), F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), ".")))
    candidates = F.when(F.size(parts) > 1, candidates).otherwise(F.array("sequence_name"))
    distinct = rows.select("sequence_name").distinct().select("sequence_name", F.posexplode(candidates).alias("k", "old"))
    found = distinct.join(names, "old").groupBy("sequence_name").agg(F.min_by(F.struct("old", "new"), "k").alias("m"))
    renamed = F.coalesce(F.expr("concat(m.new, substring(sequence_name, length(m.old) + 1))"), F.col("sequence_name"))
    return rows.join(found, "sequence_name", "left").withColumn("sequence_name", renamed).select(*rows.columns)
