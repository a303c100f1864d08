"""Wiggle tracks on reference columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.columns import packed_with_reference

#: Bases of a bin in which blocks and runs of a track meet.
BIN = 1 << 16


def values_by_block(rows: DataFrame, track: DataFrame) -> DataFrame:
    """``block_id, values``: the track's value (null: none) at each reference base of a block that the track touches.

    ``track``: ``sequence_name, start, end, value``, runs of bases that share a value.  Blocks and runs meet in bins, a record for each block and run, and a run is
    spread inside the block's array.  Runs don't overlap; of repeated ones the one of the least value counts.
    """
    first, last = lambda a: F.expr(f"{a} div {BIN}"), lambda b: F.expr(f"({b} - 1) div {BIN}")
    blocks = rows.where("row_index = 0 and length > 0").select("block_id", "sequence_name", F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"))
    blocks = blocks.withColumn("bin", F.explode(F.sequence(first("a"), last("b"))))
    runs = track.where("end > start").select(F.col("sequence_name").alias("name"), F.col("start").alias("x"), F.col("end").alias("y"), "value").withColumn("nth", F.explode(F.sequence(first("x"), last("y"))))
    hit = (F.col("sequence_name") == F.col("name")) & (F.col("bin") == F.col("nth")) & (F.col("x") < F.col("b")) & (F.col("y") > F.col("a")) & (F.col("bin") == F.greatest(first("a"), first("x")))
    met = blocks.join(runs, hit).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct((F.greatest("x", "a") - F.col("a")).alias("x"), (F.least("y", "b") - F.col("a")).alias("y"), "value"))).alias("runs"))
    ended = lambda k: F.when(k > 0, F.get("runs", k - 1)["y"]).otherwise(0)
    nothing = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    spread = F.transform("runs", lambda r, k: F.concat(nothing(r["x"] - ended(k)), F.array_repeat(r["value"].cast("double"), (r["y"] - F.greatest(r["x"], ended(k))).cast("int"))))
    return met.select("block_id", F.flatten(spread).alias("values"))


def annotate(rows: DataFrame, track: DataFrame, tag: str) -> DataFrame:
    """Every column of ``rows`` with ``tags``: the track's value at its reference base, if any.

    ``track`` holds single positions (``sequence_name, pos, value``) or runs (``sequence_name, start, end, value``).
    """
    runs = track.select("sequence_name", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value") if "pos" in track.columns else track
    blocks = packed_with_reference(rows).join(values_by_block(rows, runs), "block_id", "left").withColumn("ref", F.transform("columns", lambda c: F.substring(c, 1, F.lit(1))))
    value = F.transform("offsets", lambda o, k: F.when(F.get("ref", k) != "-", F.get("values", o)))
    out = blocks.select("block_id", "ref_start", F.posexplode(F.arrays_zip("columns", "offsets", "ref", value.alias("value"))).alias("col", "x"))
    at = F.col("x.value")
    tags = F.when(at.isNotNull(), F.array(F.struct(F.lit(tag).alias("key"), F.format_string("%f", at).alias("value")))).otherwise(F.expr("cast(array() as array<struct<key: string, value: string>>)"))
    return out.select("block_id", F.col("col").cast("long").alias("col"), F.col("x.columns").alias("bases"), (F.col("ref_start") + F.col("x.offsets")).alias("ref_pos"), F.col("x.ref").alias("ref_base"), tags.alias("tags"))
