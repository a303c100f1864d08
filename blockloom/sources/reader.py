"""One reader for both text formats, and indexes of their files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.links import diff_links
from blockloom.operators.regions import build_index, clip, clip_all, parse_region
from blockloom.schema import ROW_COLUMNS
from blockloom.sources import indexed, lists, maf, taf

EVER = 1 << 62


def header(spark: SparkSession, path: str) -> dict[str, str]:
    """Tags of the first line, whichever format it is of."""
    return _format(spark, path).header(spark, path)


def read(spark: SparkSession, path: str, region: str | None = None, links: bool = False, index: str | None = None) -> DataFrame:
    """Rows of a file of either format, told by its first word.

    ``region`` (as text, see ``parse_region``) keeps the blocks on it, cut to it.  With an ``index`` only the parts of the file that can hold them are read,
    and ``block_id`` is the place of a block in the file.  ``links`` adds ``l_row_index``: the row of
    the block before that a row continues, among the blocks that are kept; null where there is none.
    """
    if region is None:
        rows = (_ranges(spark, path) if index else _format(spark, path).read(spark, path)).select(*ROW_COLUMNS)
    else:
        name, start, end = parse_region(region)
        end = EVER if end is None else end
        whole = _ranges(spark, path, index, [(name, start, end)]) if index else _format(spark, path).read(spark, path)
        rows = clip(whole.select(*ROW_COLUMNS), name, start, end)
    return rows.join(diff_links(rows), ["block_id", "row_index"]) if links else rows


def read_intervals(spark: SparkSession, path: str, intervals: Sequence[tuple[str, int, int]], index: str | None = None) -> DataFrame:
    """Rows with ``ord``, the number of the interval (name, start, length) that they belong to and are cut to; intervals may overlap and repeat.

    Blocks follow in the order of ``ord, block_id``.  An interval without length gives nothing.
    """
    regions = [(n, s, s + length) for n, s, length in intervals if length > 0]
    wanted = spark.createDataFrame([(k, n, s, s + length) for k, (n, s, length) in enumerate(intervals) if length > 0], "ord bigint, name string, region_start bigint, region_end bigint")
    whole = _ranges(spark, path, index, regions) if index else _format(spark, path).read(spark, path)
    return clip_all(whole.select(*ROW_COLUMNS), wanted)


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """``name, pos, offset`` of the places of a file where reading can begin."""
    indexed.register(spark)
    return spark.read.format("alignment").option("anchors", "true").load(path)


def write_index(spark: SparkSession, path: str, index: str, spacing: int = 10_000) -> None:
    """Index a file (plain or in BGZF blocks; plain gzip raises ValueError), with an entry every ``spacing`` bases of a contig."""
    lists.write_index(build_index(anchors(spark, path), spacing), index)


def sequence_lengths(spark: SparkSession, path: str, index: str) -> DataFrame:
    """``sequence_name, sequence_length`` of the indexed contigs; of the file only the begin of each contig is read."""
    firsts = [*{n: p for n, p, _ in sorted(indexed.index_entries(index), reverse=True)}.items()]
    rows = _ranges(spark, path, index, [(n, p, p + 1) for n, p in firsts])
    return rows.where("row_index = 0").groupBy("sequence_name").agg(F.min_by("sequence_length", "block_id").alias("sequence_length"))


def _ranges(spark: SparkSession, path: str, index: str | None = None, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    indexed.register(spark)
    source = spark.read.format("alignment")
    if index:
        source = source.option("index", index)
    return (source if regions is None else source.option("regions", json.dumps(regions))).load(path)


def _format(spark: SparkSession, path: str):
    """The module of the file's format."""
    found = {"maf": maf, "taf": taf}.get(taf.sniff(spark, path))
    if found is None:
        raise ValueError(f"neither of the alignment formats: {path}")
    return found
