"""Column-major alignment text with differential coordinates.

A line holds the bases of one column.  A line with ``;`` begins a block: its rows
are those of the block before, changed by operations in order (``i`` insert, ``s``
substitute, ``d`` delete, ``g``/``G`` skip a gap).  Lines that give the
coordinates of every row need nothing from before them; they are where a file is
cut into tasks, for reading and for writing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.functions.align import wavefront
from blockloom.operators.links import shard_links
from blockloom.operators.shards import CELLS, block_starts, by_shard, values, with_halo
from blockloom.sources.lines import write_lines

ROWS = "block_id bigint, row_index bigint, sequence_name string, start bigint, length bigint, strand boolean, sequence_length bigint, bases string, left_gap_sequence string, l_row_index bigint"
PLAIN = re.compile(r"[A-Za-z*-]+").fullmatch
TAGS = "block_id bigint, col bigint, tags array<struct<key: string, value: string>>"


def header(spark: SparkSession, path: str) -> dict[str, str]:
    """Tags of the first line (``#taf key:value ...``)."""
    first = spark.read.text(path).head()
    words = first["value"].split() if first else []
    return dict(w.split(":", 1) for w in words[1:]) if words and words[0] == "#taf" else {}


def sniff(spark: SparkSession, path: str) -> str:
    """``taf``, ``maf`` or ``unknown`` by the first word."""
    first = spark.read.text(path).head()
    word = (first["value"].split() or [""])[0] if first else ""
    return {"#taf": "taf", "##maf": "maf"}.get(word, "unknown")


def _bases(tokens: list[str], end: int, rle: bool) -> str:
    return "".join(tokens[i] * int(tokens[i + 1]) for i in range(0, end, 2)) if rle else tokens[0]


def decode_lines(lines: Iterable[tuple[int, str]], rle: bool = False) -> Iterator[tuple[int, list[dict], list[tuple[int, list[dict]]]]]:
    """Blocks as (number of their first line, rows, tagged columns) from numbered lines.

    Before the first block no rows are known: deletions and gaps there refer to nothing and are skipped.
    """
    rows: list[dict] = []
    block, columns, tags = None, [], []

    def finish() -> tuple:
        for r, bases in zip(rows, map("".join, zip(*columns)) if rows else []):
            r["bases"], r["length"] = bases, len(bases) - bases.count("-")
        return block, rows, tags

    for number, line in lines:
        if not rle and PLAIN(line):  # nothing but bases
            columns.append(line)
            continue
        tokens = line.split()
        if not tokens or tokens[0].startswith("#"):
            continue
        at = tokens.index("@") if "@" in tokens else len(tokens)
        semi = tokens.index(";") if ";" in tokens[:at] else at
        if semi < at:
            known = block is not None
            if known:
                yield finish()
            rows = [{"sequence_name": r["sequence_name"], "start": r["start"] + r["length"], "strand": r["strand"], "sequence_length": r["sequence_length"], "left_gap_sequence": None, "l_row_index": i} for i, r in enumerate(rows)] if known else []
            block, columns, tags = number, [], []
            j = semi + 1
            while j < at:
                op, i = tokens[j], int(tokens[j + 1])
                j += 2
                if op in "is":
                    place = {"sequence_name": tokens[j], "start": int(tokens[j + 1]), "strand": tokens[j + 2] == "+", "sequence_length": int(tokens[j + 3]), "left_gap_sequence": None}
                    j += 4
                    if op == "i" or not known:
                        rows.insert(i, place | {"l_row_index": None})
                    else:
                        rows[i] = place | {"l_row_index": rows[i]["l_row_index"]}
                elif op == "d":
                    if known:
                        del rows[i]
                else:
                    if known and op == "G":
                        rows[i]["left_gap_sequence"] = tokens[j]
                    if known:
                        rows[i]["start"] += len(tokens[j]) if op == "G" else int(tokens[j])
                    j += 1
        if at < len(tokens):
            pairs = [t.split(":") for t in tokens[at + 1 :]]
            if any(len(p) != 2 for p in pairs):
                raise ValueError(f"a tag needs exactly one colon: {line!r}")
            tags.append((len(columns), [{"key": k, "value": v} for k, v in pairs]))
        columns.append(_bases(tokens, semi, rle))
    if block is not None:
        yield finish()


def _decoded(lines: DataFrame, rle: bool, want_tags: bool) -> DataFrame:
    """Decode ``seg, id, value``, one line or several (numbered on from ``id``); a segment begins where all coordinates are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for b in batches for r in zip(*(values(b.column(c)) for c in ("seg", "id", "value"))))
        for _, segment in groupby(records, itemgetter(0)):
            lines = ((number + k, line) for _, number, value in segment for k, line in enumerate(value.split("\n")))
            out, cells = [], 0
            for block, rows, tags in decode_lines(lines, rle):
                if want_tags:
                    out += [(block, c, t) for c, t in tags]
                else:
                    out += [(block, i, *(r.get(c) for c in names)) for i, r in enumerate(rows)]
                    cells += sum(len(r.get("bases") or "") for r in rows)
                if len(out) >= 10_000 or cells > CELLS:
                    yield made(out)
                    out, cells = [], 0
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    tag = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
    i, s = pa.int64(), pa.string()
    schema = pa.schema([("block_id", i), ("col", i), ("tags", tag)] if want_tags else [("block_id", i), ("row_index", i), ("sequence_name", s), ("start", i), ("length", i), ("strand", pa.bool_()), ("sequence_length", i), ("bases", s), ("left_gap_sequence", s), ("l_row_index", i)])
    names = schema.names[2:]
    dealt = lines.select("seg", "id", "value").repartition("seg").sortWithinPartitions("seg", "id")
    return dealt.mapInArrow(run, TAGS if want_tags else ROWS)


def _is_anchor(rle: bool):
    """Whether a line gives the coordinates of each of its rows."""
    body = F.split(F.trim(F.split("value", " @").getItem(0)), " ; ")
    given = F.size(F.regexp_extract_all(F.concat(F.lit(" "), F.coalesce(F.get(body, F.lit(1)), F.lit("")), F.lit(" ")), F.lit(r" [is] (?=\d+ \S+ \d+ [+-] )"), F.lit(0)))
    first = F.get(body, F.lit(0))
    runs = F.split(first, " ")
    rows = F.aggregate(F.transform(F.sequence(F.lit(1), F.size(runs) - 1, F.lit(2)), lambda i: F.get(runs, i).cast("int")), F.lit(0), lambda a, x: a + x) if rle else F.length(first)
    return (F.size(body) > 1) & (given >= rows)


def segments(spark: SparkSession, path: str, rle: bool) -> DataFrame:
    """Numbered lines with the segment that they belong to: counted inside partitions, then shifted by the partitions before."""
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("id", 33)).withColumn("new", _is_anchor(rle).cast("long"))
    totals = lines.groupBy("pid").agg(F.sum("new").alias("n"))
    before = totals.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))  # one record per partition
    return lines.withColumn("k", F.sum("new").over(Window.partitionBy("pid").orderBy("id"))).join(before, "pid").withColumn("seg", F.col("k") + F.col("before"))


def read(spark: SparkSession, path: str, tags: bool = False) -> DataFrame:
    """Rows (or tagged columns) of a file, with ``block_id`` growing along it."""
    rle = header(spark, path).get("run_length_encode_bases") == "1"
    return _decoded(segments(spark, path, rle), rle, tags)


def column_text(bases: str, rle: bool) -> str:
    if not rle:
        return bases
    out, at = [], 0
    for i in range(1, len(bases) + 1):
        if i == len(bases) or bases[i] != bases[at]:
            out.append(f"{bases[at]} {i - at}")
            at = i
    return " ".join(out)


def coordinates(before: list[dict], rows: list[dict], repeat: int, everything: bool = False) -> str:
    """The operations that turn the rows of the block before into ``rows`` (``l_row_index`` names what a row continues).

    ``since`` counts a row's bases since its coordinates were given; over ``repeat`` they are given again.  ``everything`` gives all coordinates.
    """
    ops, kept = [], {r["l_row_index"] for r in rows if r["l_row_index"] is not None}
    gone = 0
    for i in range(len(before)):
        if i in kept:
            gone += 1
        else:
            ops.append(f"d {gone}")
    for i, r in enumerate(rows):
        place = f"{i} {r['sequence_name']} {r['start']} {'+' if r['strand'] else '-'} {r['sequence_length']}"
        if r["l_row_index"] is None:
            ops.append(f"i {place}")
            r["since"], everything = 0, everything or i == 0
            continue
        p = before[r["l_row_index"]]
        end = p["start"] + p["length"]
        follows = p["strand"] == r["strand"] and end <= r["start"] and p["sequence_name"] == r["sequence_name"]
        everything = everything or (not follows and i == 0)
        r["since"] = p["since"] + p["length"] if follows else 0
        if not follows or everything or 0 < repeat < r["since"]:
            ops.append(f"s {place}")
            r["since"], everything = 0, everything or i == 0
        elif r["start"] > end:
            gap = r.get("left_gap_sequence")
            ops.append(f"G {i} {gap}" if isinstance(gap, str) and gap else f"g {i} {r['start'] - end}")
    return " ; " + " ".join(ops) if ops else " ;"


def link(left: list[dict], right: list[dict], substitutions: bool = True) -> list[int | None]:
    """For each right row the index of the left row that it continues, in order; see ``operators.links``."""
    follows = lambda x, y: x["strand"] == y["strand"] and x["start"] + x["length"] <= y["start"] and x["sequence_name"] == y["sequence_name"]
    if len(left) == len(right) and all(map(follows, left, right)):
        return list(range(len(right)))
    to: list[int | None] = [None] * len(right)
    for i, j in wavefront(left, right, follows, 1, 1 if substitutions else 10**8):
        if i is not None and j is not None:
            to[j] = i
    return to


def text(rows: DataFrame, repeat: int = 10_000, rle: bool = False, tags: DataFrame | None = None, omit: bool = False) -> DataFrame:
    """``block_id`` (dense number of the block), ``value``, its lines, and the ``shard`` that they were written in.

    A shard knows the block before it.  Its first block gives all coordinates, so that shards are written and read by themselves.
    ``omit`` leaves coordinates and tags out, which is for looking at only.
    """
    own = ["block_id", "row_index", "sequence_name", "start", "length", "strand", "sequence_length", "bases"]
    gaps = F.col("left_gap_sequence") if "left_gap_sequence" in rows.columns else F.lit(None).cast("string")
    given = rows.select(*own, gaps.alias("left_gap_sequence"))
    if tags is not None:
        line = F.array_join(F.transform("tags", lambda t: F.concat(t["key"], F.lit(":"), t["value"])), " ")
        tagged = tags.groupBy("block_id").agg(F.map_from_entries(F.collect_list(F.struct("col", line))).alias("column_tags"))
        given = given.join(tagged, "block_id", "left")
    else:
        given = given.withColumn("column_tags", F.lit(None).cast("map<bigint, string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_shard(batches):
            left = shard_links(table)[0].tolist()
            starts, halo = block_starts(table)
            starts = starts.tolist()
            fields = [*own[2:7], "left_gap_sequence"]
            meta = [dict(zip(fields, r)) for r in zip(*(values(table.column(c)) for c in fields))]
            texts, tagged = table.column("bases").to_numpy().tolist(), table.column("column_tags")
            tagless = omit or tagged.null_count == len(tagged)
            numbers, out, last = table.column("n_before")[-1].as_py(), [], []
            for b, (lo, hi) in enumerate(zip(starts, starts[1:])):
                block = meta[lo:hi]
                for r, i in zip(block, left[lo:hi]):
                    r["l_row_index"], r["since"] = i - starts[b - 1] if i >= 0 else None, 0
                if b >= halo:
                    ops = "" if omit else coordinates(last, block, repeat, b == halo)
                    labels = {} if tagless else dict(tagged[lo].as_py() or ())
                    out.append((numbers + b - halo, _lines(texts[lo:hi], ops, rle, labels)))
                last = block
            for k in range(0, len(out), 1_000):
                ids, made = zip(*out[k : k + 1_000])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.string()), pa.array([table.column("shard")[0].as_py()] * len(ids), pa.int64())], names=["block_id", "value", "shard"])

    return with_halo(given).mapInArrow(run, "block_id bigint, value string, shard bigint")


def _lines(rows: list[str], ops: str, rle: bool, labels: dict[int, str]) -> str:
    """The lines of a block: its rows turned to columns as one array of bytes, the operations after the first."""
    n, data = len(rows), "".join(rows).encode()
    if len({*map(len, rows)}) > 1 or len(data) != n * len(rows[0]):
        raise ValueError("rows of unequal width in a block")
    turned = np.frombuffer(data, np.uint8).reshape(n, -1).T
    if not rle and not labels:
        lines = np.full((turned.shape[0], n + 1), 10, np.uint8)
        lines[:, :n] = turned
        text = lines.tobytes().decode()
        return text[:n] + ops + text[n:-1]
    columns = (c.tobytes().decode() for c in turned)
    return "\n".join(column_text(c, rle) + (ops if k == 0 else "") + (f" @ {labels[k]}" if labels.get(k) else "") for k, c in enumerate(columns))


def decode(blocks: DataFrame, rle: bool = False) -> DataFrame:
    """Rows of ``text``'s output; ``block_id`` is the block's number there."""
    lines = blocks.select(F.col("shard").alias("seg"), F.expr("block_id << 24").alias("id"), "value")
    return _decoded(lines, rle, False).withColumn("block_id", F.shiftright("block_id", 24))


def write(rows: DataFrame, path: str, tags: dict[str, str] | None = None, rle: bool = False, repeat: int = 10_000, column_tags: DataFrame | None = None, compression: str = "none") -> None:
    """Write text files that follow each other in block order, the header first."""
    tags = dict(tags or {"version": "1"}) | ({"run_length_encode_bases": "1"} if rle else {})
    first = rows.sparkSession.createDataFrame([(-1, "#taf " + " ".join(f"{k}:{v}" for k, v in tags.items()))], "block_id bigint, value string")
    out = first.unionByName(text(rows, repeat, rle, column_tags).select("block_id", "value"))
    write_lines(out, path, compression)
