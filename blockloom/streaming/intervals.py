"""Reference intervals kept as files arrive: blocks that follow each other without a gap become one interval.

Each contig's open interval is the state.  An interval is given out, once, when a later block shows that it has ended; so the sink is append-only, and a
query that restarts from its checkpoint goes on with the intervals that were open.  Blocks of a contig must arrive in the order of their starts from
one trigger to the next; inside a trigger they may come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockloom.streaming.stats import read

OUT = "sequence_name string, start bigint, end bigint"


def reference_places(blocks: DataFrame) -> DataFrame:
    """``sequence_name, start, end`` of each block's first row, from its text (``value``)."""
    first = F.get(F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^s[ \t]")), F.lit(0))
    f = F.split(F.trim(first), "[ \\t]+")
    places = blocks.select(F.get(f, F.lit(1)).alias("sequence_name"), F.get(f, F.lit(2)).cast("long").alias("start"), F.get(f, F.lit(3)).cast("long").alias("length"))
    return places.where("sequence_name is not null").select("sequence_name", "start", (F.col("start") + F.col("length")).alias("end"))


def ended(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The intervals of a contig that end with this trigger's blocks."""
    found = sorted((s, e) for part in parts for s, e in zip(part["start"], part["end"]))
    begin, end = state.get if state.exists else (None, None)
    out = []
    for s, e in found:
        if begin is not None and s == end:
            end = e
        else:
            if begin is not None:
                out.append((key[0], begin, end))
            begin, end = s, e
    if begin is not None:
        state.update((int(begin), int(end)))
    if out:
        yield pd.DataFrame(out, columns=["sequence_name", "start", "end"])


def intervals(places: DataFrame) -> DataFrame:
    """A stream of the intervals that have ended."""
    return places.groupBy("sequence_name").applyInPandasWithState(ended, OUT, "start bigint, end bigint", "append", GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, directory: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the intervals of the files in ``directory`` to ``out`` (Parquet): of those that are there, or of all that will arrive."""
    writer = intervals(reference_places(read(spark, directory))).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
