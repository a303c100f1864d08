"""Regions: parsing, overlap, clipping, several regions at once, and the sparse index."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.masks import with_reference
from blockloom.session import bounded_broadcast, keep

BIN, LINES, SHARD = 1_000_000, 100_000, 64 << 20


def parse_region(text: str) -> tuple[str, int, int | None]:
    """``name``, ``name:start`` (one base) or ``name:start-end`` as (name, start, end); the last colon counts."""
    name, colon, span = text.rpartition(":")
    if not colon:
        if not text:
            raise ValueError("empty region")
        return text, 0, None
    start, dash, end = span.partition("-")
    try:
        a = int(start)
        b = int(end) if dash else a + 1
    except ValueError:
        raise ValueError(f"not a region: {text!r}") from None
    if not name or a < 0 or b <= a:
        raise ValueError(f"not a region: {text!r}")
    return name, a, b


def overlapping(rows: DataFrame, name: str, start: int = 0, end: int | None = None) -> DataFrame:
    """All rows of the blocks whose reference row overlaps the region."""
    hit = (F.col("row_index") == 0) & (F.col("sequence_name") == name) & (F.col("start") + F.col("length") > start)
    if end is not None:
        hit &= F.col("start") < end
    return rows.join(rows.where(hit).select("block_id"), "block_id", "left_semi")


def _clipped(rows: DataFrame, start, end, keys: list[str]) -> DataFrame:
    """Cut columns so that the reference lies in [start, end); ``rows`` has ``ref_bases, ref_start, ref_length``."""
    places = F.filter(F.sequence(F.lit(0), F.length("ref_bases") - 1), lambda i: F.substring(F.col("ref_bases"), i + 1, F.lit(1)) != "-")
    rows = rows.withColumn("places", places)
    left, right = F.greatest(F.lit(0), start - F.col("ref_start")), F.greatest(F.lit(0), F.col("ref_start") + F.col("ref_length") - end)
    rows = rows.withColumn("a", F.when(left > 0, F.get("places", (left - 1).cast("int")) + 1).otherwise(0)).withColumn("b", F.when(right > 0, F.get("places", (F.size("places") - right).cast("int"))).otherwise(F.length("bases")))
    kept, before = F.expr("substring(bases, a + 1, b - a)"), F.expr("replace(substring(bases, 1, a), '-', '')")
    rows = rows.withColumn("kept", kept).withColumn("n", F.length(F.expr("replace(substring(bases, a + 1, b - a), '-', '')")).cast("long"))
    cut = (left > 0) | (right > 0)
    return rows.select(
        *keys, "block_id", "row_index", "sequence_name", (F.col("start") + F.length(before)).cast("long").alias("start"),
        F.when(cut, F.col("n")).otherwise(F.col("length")).alias("length"), "strand", "sequence_length",
        F.when(cut & (F.col("n") == 0), F.expr("repeat('-', b - a)")).otherwise(F.col("kept")).alias("bases"),
    )


def clip(rows: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """The region's blocks, trimmed to it; columns where the reference has a gap stay next to a cut."""
    inside = with_reference(overlapping(rows, name, start, end), "bases", "start", "length")
    return _clipped(inside, F.lit(start), F.lit(end), [])


def clip_all(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """``clip`` for each of ``regions`` (``ord, name, region_start, region_end``), in one pass; a block may serve several.

    Reference rows and regions meet in bins of ``BIN`` bases, and count in the first bin that they share.
    """
    ref = rows.where("row_index = 0 and length > 0").select("block_id", "sequence_name", "start", "length")
    ref = ref.withColumn("bin", F.explode(F.expr(f"sequence(start div {BIN}, (start + length - 1) div {BIN})")))
    wanted = regions.where("region_end > region_start").withColumn("bin", F.explode(F.expr(f"sequence(region_start div {BIN}, (region_end - 1) div {BIN})")))
    hit = (ref["sequence_name"] == wanted["name"]) & (ref["bin"] == wanted["bin"]) & (F.col("start") < F.col("region_end")) & (F.col("start") + F.col("length") > F.col("region_start"))
    pairs = ref.join(wanted, hit).where(ref["bin"] == F.expr(f"greatest(start div {BIN}, region_start div {BIN})")).select("block_id", "ord", "region_start", "region_end")
    whole = with_reference(rows, "bases", "start", "length").join(pairs, "block_id")
    return _clipped(whole, F.col("region_start"), F.col("region_end"), ["ord"])


_FUNCTION = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("upto", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("last_name", pa.string()), ("last_pos", pa.int64())])


def _steps(pos: np.ndarray, spacing: int) -> tuple[list[int], list[int]]:
    """Where the entries among a contig's anchors end, if the first of them must be at ``t`` or behind: ``ends[k]`` for the first ``upto[k]`` not below ``t``."""
    reached = np.maximum.accumulate(pos)
    follows = np.searchsorted(reached, reached + spacing)
    ends = reached.copy()
    for i in range(len(pos) - 1, -1, -1):
        if follows[i] < len(pos):
            ends[i] = ends[follows[i]]
    last = np.append(ends[1:] != ends[:-1], True)
    return reached[last].tolist(), ends[last].tolist()


def _chosen(anchors: Iterable[tuple[str, int]], spacing: int, name: str | None, at: int) -> Iterator[bool]:
    """Whether each anchor is an entry, after an entry at ``name, at`` (None: there is none)."""
    for n, p in anchors:
        take = n != name or p - at >= spacing
        if take:
            name, at = n, p
        yield take


def _by_shard(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[list]]]:
    """The columns ``names`` of one shard after the other."""
    records = ((r[0], r[1:]) for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("shard", *names))))
    for shard, group in groupby(records, lambda r: r[0]):
        yield shard, [[*c] for c in zip(*(r for _, r in group))]


def build_index(anchors: DataFrame, spacing: int = 10_000, shard: int = SHARD) -> DataFrame:
    """Index entries of ``name, pos, offset``: in the order of ``offset``, the first anchor wherever the contig changes, then one at least ``spacing`` bases after the last.

    The choice depends on the entry before.  So each shard of ``shard`` bytes says how it ends for any entry that it can come after, a step function
    with no more steps than it has anchors in its last ``spacing`` bases.  The functions are composed along the file, a record per shard, and then all shards choose
    their entries at the same time.
    """
    rows = anchors.select("name", "pos", "offset").withColumn("shard", F.expr(f"offset div {shard}"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "offset")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (names, pos) in _by_shard(batches, ["name", "pos"]):
            n = next((i for i, x in enumerate(names) if x != names[0]), len(names))
            upto, ends = _steps(np.asarray(pos[:n]), spacing)
            last = (None, None)
            if n < len(names):  # further contigs begin afresh, so the end is known
                rest = [*zip(names, pos)][n:]
                last = [a for a, take in zip(rest, _chosen(rest, spacing, None, 0)) if take][-1]
            yield pa.RecordBatch.from_pylist([dict(zip(_FUNCTION.names, (key, names[0], upto, ends, *last)))], schema=_FUNCTION)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = None, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                out.append((r["shard"], name, at))
                k = bisect_left(r["upto"], at + spacing) if name == r["name"] else 0
                if r["last_name"] is not None:
                    name, at = r["last_name"], r["last_pos"]
                elif k < len(r["ends"]):
                    name, at = r["name"], r["ends"][k]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64()))], names=["shard", "from_name", "from_pos"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (names, pos, offsets, before, at) in _by_shard(batches, ["name", "pos", "offset", "from_name", "from_pos"]):
            kept = [a for a, take in zip(zip(names, pos, offsets), _chosen(zip(names, pos), spacing, before[0], at[0])) if take]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), (pa.string(), pa.int64(), pa.int64()))], names=["name", "pos", "offset"])

    per_shard = dealt.mapInArrow(functions, "shard bigint, name string, upto array<bigint>, ends array<bigint>, last_name string, last_pos bigint")
    begun = keep(per_shard.coalesce(1).sortWithinPartitions("shard").mapInArrow(composed, "shard bigint, from_name string, from_pos bigint"), "index-shards")
    met = rows.join(bounded_broadcast(begun, 200_000), "shard").repartition("shard").sortWithinPartitions("shard", "offset")
    return met.mapInArrow(choose, "name string, pos bigint, offset bigint")


def index_lines(entries: DataFrame) -> DataFrame:
    """Delta-coded index ``name, pos, offset`` as text parts ``line_no, name, pos, offset``, in the order of ``offset``: ``*`` repeats the name, with differences.

    Lines are numbered inside shards of bytes and shifted by the shards before, so only one record per shard is ordered as a whole.
    """
    sharded = entries.withColumn("shard", F.expr(f"offset div {SHARD}"))
    last = F.max_by(F.struct("name", "pos", "offset"), "offset")
    along = Window.orderBy("shard")
    shards = sharded.groupBy("shard").agg(F.count("*").alias("n"), last.alias("last")).select("shard", (F.sum("n").over(along) - F.col("n")).alias("before"), F.lag("last").over(along).alias("last"))
    order = Window.partitionBy("shard").orderBy("offset")
    numbered = sharded.join(shards, "shard").withColumn("line_no", F.row_number().over(order) - 1 + F.col("before"))
    numbered = numbered.withColumn("p", F.coalesce(F.lag(F.struct("name", "pos", "offset")).over(order), "last")).withColumn("same", F.coalesce(F.col("p.name") == F.col("name"), F.lit(False)))
    return numbered.select("line_no", F.when(F.col("same"), "*").otherwise(F.col("name")).alias("name"), *((F.col(c) - F.when(F.col("same"), F.col(f"p.{c}")).otherwise(0)).alias(c) for c in ("pos", "offset")))


def expand_index(lines: DataFrame) -> DataFrame:
    """Absolute ``name, pos, offset`` from delta-coded ``line_no, name, pos, offset``.

    Contigs are numbered in two levels: inside shards of lines, then over one record per shard.
    """
    sharded = lines.withColumn("shard", F.expr(f"line_no div {LINES}")).withColumn("first", (F.col("name") != "*").cast("long"))
    totals = sharded.groupBy("shard").agg(F.sum("first").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    grouped = sharded.join(before, "shard").withColumn("g", F.sum("first").over(Window.partitionBy("shard").orderBy("line_no")) + F.col("before"))
    inside = Window.partitionBy("g").orderBy("line_no")
    return grouped.select(F.first("name").over(inside).alias("name"), F.sum("pos").over(inside).alias("pos"), F.sum("offset").over(inside).alias("offset"))
