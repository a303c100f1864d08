"""Parts shared by the text operators."""

from __future__ import annotations

import re

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that extra columns can't clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: the id and the text, so that different texts of one id don't mix."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))), F.lit(k))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_broadcast(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``most`` rows, else for a join by sorting: files are many times smaller than the rows that a plan would broadcast by their size."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def sliced(batches: Iterator[pa.RecordBatch], rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` and about ``size`` bytes (one row at least), which bounds what a worker holds at once."""
    for b in batches:
        parts = -(-b.get_total_buffer_size() // size) if b.num_rows else 0
        step = max(1, min(rows, b.num_rows // max(parts, 1)))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            if part.num_rows > 1 and part.nbytes > 2 * size:  # long rows stand together
                for i in range(part.num_rows):
                    yield part.slice(i, 1)
            else:
                yield part
