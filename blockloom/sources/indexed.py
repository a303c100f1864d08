"""A data source of alignment files that reads byte ranges: ``spark.read.format("alignment")``.

Both text formats, plain or in BGZF blocks.  A file is cut into ranges, which tasks read by themselves; with an ``index`` and conditions on the reference
(``ref_name = ...``, ``ref_start < ...``, ``ref_end > ...``, where ``ref_start, ref_end`` are those of a row's block) only the ranges that can hold such blocks are read.
Conditions reach the source if ``spark.sql.python.filterPushdown.enabled`` is set; the option ``regions`` (JSON: name, start, end) works without it.
``block_id`` is the place where a block begins, so it doesn't depend on the cut.

The option ``anchors`` gives ``name, pos, offset`` of the places where reading can begin instead: of each block of a row-major file the end of the
block before (0 for the first), of a column-major file the lines that give the coordinates of all their rows.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from blockloom.sources.bytes import END_MARKER, Plain, blocks_of, located, opened
from blockloom.sources.taf import decode_lines

ROWS = "block_id bigint, row_index bigint, sequence_name string, start bigint, length bigint, strand boolean, sequence_length bigint, bases string, left_gap_sequence string, l_row_index bigint, ref_name string, ref_start bigint, ref_end bigint"
ANCHORS = "name string, pos bigint, offset bigint"
_I, _S = pa.int64(), pa.string()
_ROWS = pa.schema([("block_id", _I), ("row_index", _I), ("sequence_name", _S), ("start", _I), ("length", _I), ("strand", pa.bool_()), ("sequence_length", _I), ("bases", _S), ("left_gap_sequence", _S), ("l_row_index", _I), ("ref_name", _S), ("ref_start", _I), ("ref_end", _I)])
_ANCHORS = pa.schema([("name", _S), ("pos", _I), ("offset", _I)])
SPLIT, MOST_ROWS, EVER = 32 << 20, 5_000, 1 << 62

Entry = tuple[str, int, int]  # name, position, place
Region = tuple[str, int, int]


@dataclass
class Range(InputPartition):
    """Lines that begin in [``lo``, ``hi``) if ``lo`` is known to be a line's begin (``exact``), else in (``lo``, ``hi``], from 0 on in the first range."""

    lo: int
    hi: int
    exact: bool


def index_entries(path: str) -> Iterator[Entry]:
    """Absolute entries of an index file, or of the parts of a folder in their order."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    parts = [inner] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("part-"))
    name, pos, offset = "", 0, 0
    for part in parts:
        with system.open_input_stream(part) as f:
            for line in f.read().decode().splitlines():
                if line:
                    n, p, o = line.split("\t")
                    name, pos, offset = (name, pos + int(p), offset + int(o)) if n == "*" else (n, int(p), int(o))
                    yield name, pos, offset


def ranges_of(entries: list[Entry], regions: list[Region], end: int, split: int = SPLIT) -> list[Range]:
    """The ranges from index entry to index entry that can hold blocks of the regions, joined up to ``split`` bytes.

    A region begins at its contig's last entry that isn't after it, or else at the contig's first one, and ends at the first entry of the file behind
    the last one before its end.
    """
    places = sorted(o for _, _, o in entries)
    by_name = {n: sorted((p, o) for _, p, o in group) for n, group in groupby(sorted(entries), lambda e: e[0])}
    wanted: set[int] = set()
    for name, start, stop in regions:
        own = by_name.get(name, [])
        if stop <= start or not own or own[0][0] >= stop:
            continue
        first = max(0, bisect_right(own, (start, EVER)) - 1)
        wanted |= {o for p, o in own[first:] if p < stop}
    out: list[Range] = []
    for o in sorted(wanted):
        k = bisect_right(places, o)
        hi = places[k] if k < len(places) else end
        if out and out[-1].hi == o and hi - out[-1].lo <= split:
            out[-1].hi = hi
        else:
            out.append(Range(o, hi, True))
    return out


def own_lines(text: Plain, part: Range) -> Iterator[tuple[int, str, bool]]:
    """Lines from a range's begin to the end of the file, and whether they are its own."""
    at = part.lo if part.exact or not part.lo else text.after(part.lo)
    for place, line in text.lines(at) if at is not None else ():
        yield place, line, place < part.hi if part.exact else place <= part.hi


def is_block_line(line: str) -> bool:
    return line[:1] == "a" and line[1:2] in ("", " ", "\t", "\r")


def row_major_blocks(text: Plain, part: Range) -> Iterator[tuple[int, list[dict]]]:
    """Place and rows of the blocks whose first line is the range's own; unequal widths raise ValueError."""
    block, rows = None, []
    for place, line, own in own_lines(text, part):
        blank = not line.strip()
        if block is not None and (blank or is_block_line(line)):
            if rows:
                yield block, rows
            block, rows = None, []
        if block is None and not own:
            return
        if is_block_line(line):
            block = place
        elif block is not None and line[:2] in ("s ", "s\t"):
            _, name, start, length, strand, size, bases = line.split()
            rows.append({"sequence_name": name, "start": int(start), "length": int(length), "strand": strand == "+", "sequence_length": int(size), "bases": bases, "left_gap_sequence": None, "l_row_index": None})
            if len(bases) != len(rows[0]["bases"]):
                raise ValueError(f"rows of unequal width in the block at {block}")
    if block is not None and rows:
        yield block, rows


def anchor(line: str, rle: bool) -> tuple[str, int, bool] | None:
    """Name, start and strand of the first row if the line gives the coordinates of all its rows."""
    words = line.split()
    if ";" not in words or words[0].startswith("#"):
        return None
    at = words.index(";")
    ops = words[at + 1 : words.index("@", at)] if "@" in words[at:] else words[at + 1 :]
    given, first, k = 0, None, 0
    while k < len(ops):
        if ops[k] in "is":
            given += 1
            if ops[k + 1] == "0":
                first = ops[k + 2], int(ops[k + 3]), ops[k + 4] == "+"
            k += 6
        else:
            k += 2 if ops[k] == "d" else 3
    return first if given == (sum(map(int, words[1:at:2])) if rle else len(words[0])) else None


def column_major_blocks(text: Plain, part: Range, rle: bool) -> Iterator[tuple[int, list[dict]]]:
    """Place and rows of the blocks from the range's first anchor to the first one behind it."""

    def lines() -> Iterator[tuple[int, str]]:
        begun = False
        for place, line, own in own_lines(text, part):
            if (not begun or not own) and anchor(line, rle):
                if not own:
                    return
                begun = True
            if begun:
                yield place, line
            elif not own:
                return

    for block, rows, _ in decode_lines(lines(), rle):
        yield block, rows


def row_major_anchors(text: Plain, part: Range) -> Iterator[Entry]:
    """Each own block's first row, with the place of the line that ended the block before."""
    ended, inside = _ended_before(text, part)
    block = -1 if inside else None  # -1: it needs no anchor any more
    for place, line, own in own_lines(text, part):
        if block is None and not own:
            return
        if is_block_line(line):
            block = place if own else -1
        elif block is not None and block >= 0 and line[:2] in ("s ", "s\t"):
            _, name, start, _, strand, *_ = line.split()
            if strand != "+":
                raise ValueError(f"the reference of the block at {block} is on the negative strand")
            yield name, int(start), ended
            block = -1
        elif block is not None and not line.strip():
            ended, block = place, None


def _ended_before(text: Plain, part: Range) -> tuple[int, bool]:
    """The place of the line that ended the last block before a range's own lines (0: there is none), and whether a block goes on into the range.

    It is looked for in ever longer stretches before the range.
    """
    first = part.lo if part.exact or not part.lo else text.after(part.lo)
    back = 1 << 16
    while part.lo and first is not None:
        cut = text.back(part.lo, back)
        at, ended, inside = text.after(cut) if cut else 0, None, None
        for place, line in text.lines(at) if at is not None else ():
            if place >= first:
                break
            if not line.strip():
                ended, inside = (place, False) if inside else (ended, inside)
            elif is_block_line(line) or inside is None and line[:2] in ("s ", "s\t"):
                inside = True
        if inside or ended is not None or not cut:
            return ended or 0, bool(inside)
        back *= 4
    return 0, False


def column_major_anchors(text: Plain, part: Range, rle: bool) -> Iterator[Entry]:
    for place, line, own in own_lines(text, part):
        if not own:
            return
        if found := anchor(line, rle):
            if not found[2]:
                raise ValueError(f"the reference of the block at {place} is on the negative strand")
            yield found[0], found[1], place


class AlignmentReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.index = options["path"], options.get("index")
        self.split, self.anchors = int(options.get("split", SPLIT)), options.get("anchors", "false") == "true"
        self.regions: list[Region] | None = [tuple(r) for r in json.loads(options["regions"])] if options.get("regions") else None
        self.name, self.low, self.high = None, 0, EVER  # what conditions say

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ref_name",):
                self.name = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("ref_start",):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("ref_end",):
                self.low = max(self.low, f.value - isinstance(f, GreaterThanOrEqual))
            yield f  # ranges hold more than is asked for, so Spark checks again

    def wanted(self) -> list[Region] | None:
        """The regions to read; None: all."""
        if self.name is None:
            return self.regions
        asked = (self.name, self.low, self.high)
        return [asked] if self.regions is None else [(n, max(a, self.low), min(b, self.high)) for n, a, b in self.regions if n == self.name]

    def partitions(self) -> list[Range]:
        text = opened(self.path)
        wanted = self.wanted()
        if self.index and wanted is not None:
            return ranges_of([*index_entries(self.index)], wanted, text.end, self.split) or [Range(0, -1, True)]
        cuts = sorted({text.cut(at) for at in range(0, text.size, self.split)} | {text.end})
        return [Range(lo, hi, False) for lo, hi in zip(cuts, cuts[1:])] or [Range(0, -1, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.hi < 0:
            return
        text = opened(self.path)
        head = next(text.lines(0), (0, ""))[1].split()
        kind = {"#taf": "taf", "##maf": "maf"}.get(head[0] if head else "")
        if kind is None:
            raise ValueError(f"neither of the alignment formats: {self.path}")
        rle = kind == "taf" and "run_length_encode_bases:1" in head
        if self.anchors:
            found = row_major_anchors(text, partition) if kind == "maf" else column_major_anchors(text, partition, rle)
            yield from _batched((dict(zip(_ANCHORS.names, e)) for e in found), _ANCHORS)
        else:
            found = row_major_blocks(text, partition) if kind == "maf" else column_major_blocks(text, partition, rle)
            wanted = self.wanted()
            yield from _batched((r for block, rows in found if rows and _asked(rows[0], wanted) for r in _with_reference(block, rows)), _ROWS)


def _asked(reference: dict, regions: list[Region] | None) -> bool:
    """Whether the block overlaps one of the regions."""
    return regions is None or any(reference["sequence_name"] == n and reference["start"] < b and reference["start"] + reference["length"] > a for n, a, b in regions)


def _with_reference(block: int, rows: list[dict]) -> Iterator[dict]:
    first = rows[0]
    same = {"block_id": block, "ref_name": first["sequence_name"], "ref_start": first["start"], "ref_end": first["start"] + first["length"]}
    for k, r in enumerate(rows):
        yield r | same | {"row_index": k}


def _batched(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in records:
        held.append(r)
        if len(held) == MOST_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


class AlignmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alignment"

    def schema(self) -> str:
        return ANCHORS if self.options.get("anchors") == "true" else ROWS

    def reader(self, schema) -> AlignmentReader:
        return AlignmentReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class BgzfWriter(DataSourceArrowWriter):
    """A part file of BGZF blocks per task, whose lines are those of ``value``; parts get their names when all tasks are done."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        temporary, final = f"{folder}/_temporary-{task.taskAttemptId()}", f"{folder}/part-{task.partitionId():05d}.bgz"
        with system.open_output_stream(temporary, compression=None) as out:
            rest = b""
            for batch in iterator:
                rest += "".join(f"{v}\n" for v in batch.column("value").to_pylist() if v is not None).encode()
                whole = len(rest) // (1 << 16) * (1 << 16)
                out.write(blocks_of(rest[:whole]))
                rest = rest[whole:]
            out.write(blocks_of(rest) + END_MARKER)
        return Written(temporary, final)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                system, _ = located(self.path)
                system.move(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                system, _ = located(self.path)
                system.delete_file(m.temporary)


class BgzfSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> BgzfWriter:
        return BgzfWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the formats ``alignment`` and ``bgzf`` known to a session, and let conditions reach the former."""
    spark.dataSource.register(AlignmentSource)
    spark.dataSource.register(BgzfSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
