"""Exact dedup by Grace hashing: records are dealt into buckets, and a bucket into spill files, until each fits an open-addressing table.

Texts are equal if they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted; a null text is empty.
The row with the most code points in its original text stays, then the one with the least ``doc_id`` (null last), then any
one of them; so of repeated rows one stays.

* Tasks fold their own copies in a table first, so that a text is sent once by a task (once for every ``HELD`` bytes of
  different texts), however many copies there are.  What a task sends is a *part*: a whole text with the number of its rows and
  the best of them.  Documents keep the number of their part; they never travel with the text.
* Parts of a bucket meet in one task.  When its table outgrows ``HELD``, the bucket is dealt into ``FAN`` spill files
  by another hash, each of which is treated alike.  Equal texts are folded before anything is spilt, so a group takes the memory of one text.
* A hit in a table counts only if the complete contents are equal.

Spill files belong to one task, which removes them and makes them anew if it is repeated; the parts are a stored table.
"""

from __future__ import annotations

import hashlib
import io
import os
import pickle
import shutil
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import shuffle_partitions, sliced, texts
from blockloom.session import keep

#: Bytes of different texts that a table holds; an entry counts as its text and OVERHEAD.
HELD, OVERHEAD, FAN = 32 << 20, 200, 16
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
PART_SCHEMA = "doc_id bigint, n_chars bigint, row bigint, part bigint, text_sha256 string, bucket int, blob binary"
BLOB = pa.schema([("hash", pa.uint64()), ("part", pa.int64()), ("n_rows", pa.int64()), ("n_chars", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("content", pa.large_binary())])
LAST = float("inf")  # a null id comes after all others

#: Hash, content, parts, number of rows, and the place of the best row in the order: code points (negative), id, row.
Record = tuple[int, bytes, list[int], int, tuple[int, float, int]]


class ContentTable:
    """Open addressing with linear probing; entries are numbered in the order of their arrival."""

    def __init__(self, slots: int = 1024) -> None:
        self.slots, self.mask = array("q", [-1]) * slots, slots - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.size = 0

    def __len__(self) -> int:
        return len(self.contents)

    def place(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of ``content`` and whether it is new."""
        at = h & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            at = (at + 1) & self.mask
        e = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.size += len(content) + OVERHEAD
        if 2 * len(self.contents) > self.mask:
            self._grow()
        return e, True

    def _grow(self) -> None:
        slots = 4 * len(self.slots)
        self.slots, self.mask = array("q", [-1]) * slots, slots - 1
        for e, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = e


def place_of(n_chars: int, doc_id: int | None, row: int) -> tuple[int, float, int]:
    return -n_chars, LAST if doc_id is None else doc_id, row


def settled(records: Iterable[Record], held: int = HELD, level: int = 1) -> Iterator[Record]:
    """The groups of a bucket, each a record that holds all parts of its text."""
    table, groups = ContentTable(), []
    records = iter(records)
    for h, content, parts, n, best in records:
        e, new = table.place(h, content)
        if new:
            groups.append([parts, n, best])
        else:
            group = groups[e]
            group[0].extend(parts)
            group[1] += n
            group[2] = min(group[2], best)
        if table.size > held and len(table) > 1:
            break
    else:
        yield from ((h, c, *g) for h, c, g in zip(table.hashes, table.contents, groups))
        return
    folder = tempfile.mkdtemp(prefix="grace-")
    try:
        files = [os.path.join(folder, str(i)) for i in range(FAN)]
        writers = [zstandard.ZstdCompressor(1).stream_writer(open(f, "wb"), closefd=True) for f in files]
        for held_back in (((h, c, *g) for h, c, g in zip(table.hashes, table.contents, groups)), records):
            for record in held_back:
                pickle.dump(record, writers[xxhash.xxh3_64_intdigest(record[1], level) % FAN], 5)
        del table, groups
        for w in writers:
            w.close()
        for f in files:
            yield from settled(_read(f), held, level + 1)
            os.remove(f)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _read(file: str) -> Iterator[Record]:
    with open(file, "rb") as raw, io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw), 1 << 16) as f:
        while f.peek(1):
            yield pickle.load(f)


def _blobs(table: ContentTable, state: list[list], first: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The entries of a task's table by bucket, as compressed batches."""
    by: dict[int, list[int]] = {}
    for e, h in enumerate(table.hashes):
        by.setdefault((h >> 32) * buckets >> 32, []).append(e)
    for bucket, entries in by.items():
        best = [state[e][1] for e in entries]
        columns = [
            [table.hashes[e] for e in entries],
            [first + e for e in entries],
            [state[e][0] for e in entries],
            [-b[0] for b in best],
            [None if b[1] == LAST else b[1] for b in best],
            [b[2] for b in best],
            [table.contents[e] for e in entries],
        ]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, BLOB, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOB)], schema=BLOB))
        yield bucket, sink.getvalue().to_pybytes()


def parts(docs: DataFrame, buckets: int, held: int = HELD) -> DataFrame:
    """A row per document with the number of its part, and rows ``bucket, blob`` that hold the parts' texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("text_sha256", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        row = first = task
        table, state = ContentTable(), []

        def sent() -> Iterator[pa.RecordBatch]:
            for bucket, blob in _blobs(table, state, first, buckets):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:5]), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], schema=schema)

        for batch in sliced(batches, 2_000):
            ids, chars = batch.column("doc_id").to_pylist(), pc.utf8_length(batch.column("text")).to_pylist()
            contents = [t.translate(None, BLANKS) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            n = len(ids)
            mine = []
            for k, (doc_id, n_chars, content) in enumerate(zip(ids, chars, contents)):
                e, new = table.place(xxhash.xxh3_64_intdigest(content), content)
                best = place_of(n_chars, doc_id, row + k)
                if new:
                    state.append([1, best])
                else:
                    state[e][0] += 1
                    state[e][1] = min(state[e][1], best)
                mine.append(first + e)
            digests = [hashlib.sha256(c).hexdigest() for c in contents]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chars, pa.int64()), pa.array(range(row, row + n), pa.int64()), pa.array(mine, pa.int64()), pa.array(digests, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
            row += n
            if table.size > held:
                yield from sent()
                first += len(table)
                table, state = ContentTable(), []
        yield from sent()

    return texts(docs).mapInArrow(run, PART_SCHEMA)


def groups(blobs: DataFrame, buckets: int, held: int = HELD) -> DataFrame:
    """``part, keep_id, keep_row, group_size`` for each part of the stored ``bucket, blob``."""
    schema = pa.schema([("part", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in batches:
            for blob in batch.column(0):
                for rows in pa.ipc.open_stream(blob.as_buffer()):
                    columns = [rows.column(k).to_pylist() for k in range(len(BLOB))]
                    for h, part, n, n_chars, doc_id, row, content in zip(*columns):
                        yield h, content, [part], n, place_of(n_chars, doc_id, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, _, members, n, (_, doc_id, row) in settled(records(batches), held):
            out += [(part, None if doc_id == LAST else doc_id, row, n) for part in members]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return blobs.repartitionById(buckets, "bucket").select("blob").mapInArrow(run, "part bigint, keep_id bigint, keep_row bigint, group_size bigint")


def dedup(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``; an empty table gives no rows.

    ``keep_id`` is null if the row that stays has no id.  Columns of ``docs`` other than ``doc_id, text`` aren't read.
    ``held`` bounds the bytes of different texts in one table.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    stored = keep(parts(docs, buckets, held), "parts")
    found = groups(stored.where("bucket is not null").select("bucket", "blob"), buckets, held)
    rows = stored.where("bucket is null").select("doc_id", "row", "part", "text_sha256")
    return rows.join(found, "part").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
