"""Tensors for training: windows of encoded columns with labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators import columns


def examples(rows: DataFrame, tagged: DataFrame | None = None, label: Callable[[Column], Column] | None = None, length: int = 1, step: int = 1, one_hot: bool = False, only_reference: bool = False) -> DataFrame:
    """``window, x, label``: encoded columns of each window, and ``label`` applied to its columns' tags.

    ``x`` is an array (window) of arrays (rows) of codes, or of one-hot vectors.
    """
    cols = columns.columns(rows, only_reference=only_reference)
    if tagged is not None and label is not None:
        cols = cols.join(tagged.select("block_id", "col", "tags"), ["block_id", "col"], "left").withColumn("label", label(F.col("tags")))
    else:
        cols = cols.withColumn("label", F.lit(None).cast("double"))
    packed = cols.select("block_id", "col", F.struct("bases", "label").alias("bases"))
    whole = columns.windows(packed, length, step)
    encode = columns.one_hots if one_hot else columns.codes
    return whole.select("window", F.transform("bases", lambda c: encode(c["bases"])).alias("x"), F.transform("bases", lambda c: c["label"]).alias("label"))


def batches(data: DataFrame, rows_at_once: int = 1024) -> Iterator[list]:
    """Stream examples to the driver in batches, one partition at a time."""
    held = []
    for r in data.toLocalIterator(prefetchPartitions=True):
        held.append(r)
        if len(held) == rows_at_once:
            yield held
            held = []
    if held:
        yield held
