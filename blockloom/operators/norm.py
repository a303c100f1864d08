"""Merging of adjacent blocks by a speculative parallel fold.

Merging is an ordered fold: a block either joins the open one or closes it and opens itself.  What the fold does from
a block on that it opens depends on nothing before it.  So shards of consecutive blocks are folded at the same time, each as if its first block
opened; then the start of each shard is folded again from the block that its predecessor leaves open, until both runs open the same block.
From there on the first run was right.  A shard in which the runs never meet leaves another block open than was thought, and its successor starts again;
this ends, because each round settles at least the first shard that isn't.

The start of a shard is mostly enough for both runs to meet, so a later round reads only the first of its blocks, and all of them where that wasn't enough.

The fold works on names, coordinates and widths.  It hands on the bases of each row with the place where they go, and Spark puts them together, so no task
holds the bases of a merged block, only those of one given block at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.align import star, wavefront
from blockloom.functions.partial_order import partial_order
from blockloom.operators.blocks import gapless, tags_without_gap_columns
from blockloom.operators.shards import some_blocks, values, whole_blocks
from blockloom.schema import ROW_COLUMNS
from blockloom.session import bounded_broadcast, keep

#: Blocks ids of a shard, the part of them (one of so many) that a later round reads first, and the bases of records that are held.
SHARD, HEAD, HELD = 2_000, 8, 1 << 22
LEAST = -(1 << 63)
PIECE, CHAIN, END = 0, 1, 2  # kinds of records


@dataclass(frozen=True)
class Policy:
    """When two neighbours merge: enough shared rows, one of them short enough, no gap too wide.

    ``aligner`` aligns the bases between blocks: ``partial_order``, or ``star`` (each to the longest).
    """

    most_block: int = 200
    most_gap: int = 30
    least_shared: int = 1
    least_fraction: float = 0.0
    prune: bool = False
    aligner: str = "partial_order"


@dataclass
class Row:
    """A row of a block, or of the open block (``chain``: the row that it began with)."""

    name: str
    start: int
    length: int
    strand: bool
    size: int
    chain: tuple[int, int]
    gap_bases: str | None = None
    bases: str | None = None

    @cached_property
    def key(self) -> tuple:
        return self.name, not self.strand, self.start


def in_order(rows: list[Row]) -> list[Row]:
    """Rows by name, strand (+ first) and start, the first one pinned."""
    return rows[:1] + sorted(rows[1:], key=lambda r: r.key)


def follows(left: Row, right: Row) -> bool:
    return left.strand == right.strand and left.start + left.length <= right.start and left.name == right.name


def gap(left: Row, right: Row) -> int:
    return right.start - left.start - left.length


def links(left: list[Row], right: list[Row]) -> list[int | None]:
    """For each right row the left row that it continues, by an ordered alignment without substitutions.

    Rows that nothing can pair with cost the same in any alignment, so they are left out.
    """
    if len(left) == len(right) and all(map(follows, left, right)):
        return [*range(len(right))]
    by: dict[str, list[int]] = {r.name: [] for r in right}
    for i, l in enumerate(left):
        if l.name in by:
            by[l.name].append(i)
    pairs = {(i, j) for j, r in enumerate(right) for i in by[r.name] if follows(left[i], r)}
    a, b = sorted({i for i, _ in pairs}), sorted({j for _, j in pairs})
    to: list[int | None] = [None] * len(right)
    if len(a) == len(b) and all((i, j) in pairs for i, j in zip(a, b)):
        made = zip(a, b)
    else:
        place, places = {i: x for x, i in enumerate(a)}, {j: y for y, j in enumerate(b)}
        made = ((a[x], b[y]) for x, y in in_both(len(a), len(b), frozenset((place[i], places[j]) for i, j in pairs)))
    for i, j in made:
        to[j] = i
    return to


@lru_cache(maxsize=1 << 14)
def in_both(n: int, m: int, pairs: frozenset[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that a cheapest ordered alignment of ``n`` and ``m`` rows without substitutions makes."""
    return [(i, j) for i, j in wavefront(range(n), range(m), lambda i, j: (i, j) in pairs, 1, 10**8) if i is not None and j is not None]


def pruned(left: list[Row], rows: list[Row], to: list[int | None], most_gap: int) -> list[Row] | None:
    """Without the rows whose gap is too wide, if each is a copy (not the first row) of a genome that keeps another; else None."""
    genome = [r.name.split(".", 1)[0] for r in rows]
    wide = [i is not None and gap(left[i], r) > most_gap for r, i in zip(rows, to)]
    passing = {g for g, w in zip(genome, wide) if not w}
    drop = [k for k, w in enumerate(wide) if w]
    if not drop or any(k == 0 or genome.count(genome[k]) < 2 or genome[k] not in passing for k in drop):
        return None
    return [r for k, r in enumerate(rows) if not wide[k]]


def without_gap_columns(rows: list[Row], numbers: list[int]) -> list[int]:
    """Cut the rows to the columns in which one of them has a base (one stays if there are none), and say which of ``numbers`` those are."""
    if any("-" not in r.bases for r in rows):
        return numbers
    used = [c for c, column in enumerate(zip(*(r.bases for r in rows))) if any(b != "-" for b in column)] or [0]
    if len(used) < len(numbers):
        for r in rows:
            r.bases = "".join(r.bases[c] for c in used)
        numbers = [numbers[c] for c in used]
    return numbers


@lru_cache(maxsize=1 << 12)
def aligned(strings: tuple[str, ...], aligner: str) -> list[str]:
    return {"partial_order": partial_order, "star": star}[aligner]([*strings])


@dataclass
class Fold:
    """The fold's state and what it has said: ``pieces`` place rows, ``chains`` describe the rows of closed blocks."""

    policy: Policy
    block: int | None = None  # the first block of the open one
    rows: list[Row] = field(default_factory=list)
    width: int = 0
    pieces: list[tuple] = field(default_factory=list)
    chains: list[tuple] = field(default_factory=list)

    def state(self) -> str:
        return json.dumps([self.block, self.width, [[r.name, r.start, r.length, r.strand, r.size, *r.chain] for r in self.rows]])

    def resume(self, state: str) -> None:
        self.block, self.width, rows = json.loads(state)
        self.rows = [Row(*r[:5], (r[5], r[6])) for r in rows]

    def take(self, block: int, rows: list[Row], width: int) -> list[int] | None:
        """Fold the next block in; the rows that it opens with if it does, else None."""
        rows, numbers = in_order(rows), None
        if self.block is not None:
            merged, rows, width, numbers = self._merged(block, rows, width)
            if merged:
                return None
            self.close()
        self.block, self.width = block, width
        self.rows = [Row(r.name, r.start, r.length, r.strand, r.size, r.chain) for r in rows]
        self.pieces += [(*r.chain, block, *r.chain, 0, None, numbers, r.bases) for r in rows]
        return [r.chain[1] for r in rows]

    def close(self) -> None:
        self.chains += [(k, self.block, *r.chain, r.name, r.start, r.length, r.strand, r.size, self.width) for k, r in enumerate(self.rows)]
        self.block, self.rows = None, []

    def _merged(self, block: int, rows: list[Row], width: int) -> tuple[bool, list[Row], int, list[int] | None]:
        p, left, numbers = self.policy, self.rows, None
        to = links(left, rows)
        shared = sum(i is not None for i in to)
        if shared < p.least_shared or shared < (len(left) + len(rows) - shared) * p.least_fraction or min(self.width, width) > p.most_block:
            return False, rows, width, None
        widest = lambda: max((gap(left[i], r) for r, i in zip(rows, to) if i is not None), default=0)
        while p.prune and widest() > p.most_gap:
            fewer = pruned(left, rows, to, p.most_gap)
            if fewer is None:
                break
            rows, numbers = fewer, without_gap_columns(fewer, [*range(width)] if numbers is None else numbers)
            width, to = len(numbers), links(left, fewer)
        if widest() > p.most_gap:
            return False, rows, width, numbers
        # new rows stand behind the row that the one before them continues
        after: dict[int, list[Row]] = {}
        continued: dict[int, Row] = {}
        at = -1
        for r, i in zip(rows, to):
            if i is None:
                after.setdefault(at, []).append(r)
            else:
                continued[i] = r
                at = i
        between, order = [], [*after.get(-1, ())]
        for i, l in enumerate(left):
            order.append(l)
            if (r := continued.get(i)) is not None and (n := gap(l, r)):
                given = r.gap_bases
                between.append((i, (given if isinstance(given, str) and len(given) == n else "N" * n).upper()))
            if i in after:
                order += after[i]
        middles = dict(zip((i for i, _ in between), aligned(tuple(b for _, b in between), p.aligner) if between else ()))
        begin = self.width + max(map(len, middles.values()), default=0)
        for new in after.values():
            for r in new:
                self.pieces.append((*r.chain, self.block, *r.chain, begin, None, numbers, r.bases))
                r.gap_bases = r.bases = None  # a row of the open block from now on
        for i, r in continued.items():
            l = left[i]
            self.pieces.append((*r.chain, self.block, *l.chain, begin, middles.get(i), numbers, r.bases))
            l.length = r.start + r.length - l.start
        self.rows, self.width = in_order(order), begin + width
        return True, rows, width, numbers


RECORD = "shard bigint, kind int, block_id bigint, row_index bigint, into bigint, chain_block bigint, chain_row bigint, begin bigint, middle string, numbers array<int>, bases string, sequence_name string, start bigint, length bigint, strand boolean, sequence_length bigint, width bigint, state string, came string, opens string"
_I, _S = pa.int64(), pa.string()
_SCHEMA = pa.schema(
    [("shard", _I), ("kind", pa.int32()), ("block_id", _I), ("row_index", _I), ("into", _I), ("chain_block", _I), ("chain_row", _I), ("begin", _I), ("middle", _S), ("numbers", pa.list_(pa.int32())), ("bases", _S)]
    + [("sequence_name", _S), ("start", _I), ("length", _I), ("strand", pa.bool_()), ("sequence_length", _I), ("width", _I), ("state", _S), ("came", _S), ("opens", _S)]
)


def _said(shard: int, fold: Fold) -> Iterator[tuple]:
    for piece in fold.pieces:
        yield shard, PIECE, *piece, *[None] * 9
    for rank, into, chain_block, chain_row, *place, width in fold.chains:
        yield shard, CHAIN, None, rank, into, chain_block, chain_row, *[None] * 4, *place, width, None, None, None
    fold.pieces, fold.chains = [], []


def _run(policy: Policy, head: bool = False):
    """Fold the sorted rows of shards, without their all-gap columns.

    A shard's first record may hold the ``state`` that it starts from, the blocks that the first run ``opens`` and the state in which that run ends (``came``).
    The last record of a shard holds the state at its end, the state that it came from, and the blocks that it opened; ``block_id`` is where it met the first run.
    With ``head`` the rows are the first of their shard only; if they end before the runs meet, the state at the end is null.
    """

    names = ["shard", "block_id", "row_index", "sequence_name", "start", "length", "strand", "sequence_length", "left_gap_sequence", "bases", "state", "came", "opens"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for table, starts in some_blocks(whole_blocks(batches)):
            table = gapless(table, starts)
            yield from zip(*(table.column(n).to_numpy().tolist() if n == "bases" else values(table.column(n)) for n in names))

    def folded(shard: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        fold, opened, came, known, met, final, said = Fold(policy), {}, None, {}, None, None, 0
        for block, group in groupby(rows, itemgetter(1)):
            if block is None:
                *_, came, final, opens = next(group)
                known = json.loads(opens)
                fold.resume(came)
                continue
            if met is not None:
                continue  # the first run has said the rest
            made = [Row(name, start, length, strand, size, (block, row), gap_bases, bases) for _, _, row, name, start, length, strand, size, gap_bases, bases, *_ in group]
            width = len(made[0].bases)
            said += width * len(made)
            with_ = fold.take(block, made, width)
            if with_ is not None:
                opened[str(block)] = with_
                if known.get(str(block)) == with_:
                    met = block
                    fold.pieces = [p for p in fold.pieces if p[2] != block]
            if len(fold.pieces) > 10_000 or said > HELD:
                yield from _said(shard, fold)
                said = 0
        yield from _said(shard, fold)
        end = final if met is not None else None if head else fold.state()
        yield shard, END, met, *[None] * 14, end, came, json.dumps(opened)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = [], 0
        for shard, rows in groupby(records(batches), itemgetter(0)):
            for record in folded(shard, rows):
                held.append(record)
                cells += len(record[10] or "") + len(record[8] or "")
                if len(held) >= 10_000 or cells > HELD:
                    yield _batch(held)
                    held, cells = [], 0
        if held:
            yield _batch(held)

    return run


def _batch(records: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*records), _SCHEMA)], schema=_SCHEMA)


def _closing(policy: Policy):
    """Close the block that the last shard leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, state in zip(batch.column("shard").to_pylist(), batch.column("state").to_pylist()):
                fold = Fold(policy)
                fold.resume(state)
                fold.close()
                yield _batch([*_said(shard, fold)])

    return run


#: Records of shards that are broadcast at most, counted first.
MOST_SHARDS = 200_000


@dataclass
class Merging:
    """A finished fold: ``rows()`` of the merged blocks, ``tags()`` moved along."""

    said: DataFrame
    given: DataFrame

    def rows(self) -> DataFrame:
        """Rows of the merged blocks; a merged block has the id of its first one."""
        text = F.concat(F.coalesce("middle", F.lit("")), "bases")
        at = F.col("begin") - F.coalesce(F.length("middle"), F.lit(0))
        chain = F.struct("row_index", "sequence_name", "start", "length", "strand", "sequence_length", F.col("width").cast("int").alias("width"))
        piece = F.when(F.col("kind") == PIECE, F.struct(at.alias("at"), text.alias("text")))
        both = self.said.select("into", "chain_block", "chain_row", piece.alias("piece"), F.when(F.col("kind") == CHAIN, chain).alias("chain"))
        joined = both.groupBy("into", "chain_block", "chain_row").agg(F.array_sort(F.collect_list("piece")).alias("parts"), F.max("chain").alias("chain"))
        end = lambda x: x["at"] + F.length(x["text"])
        filled = F.transform("parts", lambda x, k: F.concat(F.repeat(F.lit("-"), (x["at"] - F.when(k > 0, end(F.get("parts", k - 1))).otherwise(0)).cast("int")), x["text"]))
        joined = joined.select(F.col("into").alias("block_id"), "chain.*", F.array_join(filled, "").alias("bases"))
        return joined.withColumn("bases", F.rpad("bases", F.col("width"), F.lit("-"))).select(*ROW_COLUMNS)

    def tags(self, tags: DataFrame) -> DataFrame:
        """``block_id, col, tags`` of the merged blocks from those of the original ones; those of dropped columns go."""
        placed = self.said.where(F.col("kind") == PIECE).groupBy("block_id").agg(F.first("into").alias("into"), F.first("begin").alias("begin"), F.first("numbers").alias("numbers"))
        col = F.col("col").cast("int")
        at = F.when(F.col("numbers").isNull(), col).otherwise(F.array_position("numbers", col).cast("int") - 1)
        found = tags_without_gap_columns(self.given, tags).join(placed, "block_id").withColumn("at", at).where("at >= 0")
        return found.select(F.col("into").alias("block_id"), (F.col("begin") + F.col("at")).alias("col"), "tags")


def merging(rows: DataFrame, policy: Policy = Policy(), shard: int = SHARD) -> Merging:
    """Fold ``rows``; ``left_gap_sequence``, where it exists, gives the bases between a row and the one before it."""
    extra = ["left_gap_sequence"] if "left_gap_sequence" in rows.columns else []
    given = rows.select(*ROW_COLUMNS, *extra)
    none = F.lit(None).cast("string")
    light = given.select(
        F.expr(f"floor(block_id / {shard})").cast("long").alias("shard"), "block_id", "row_index", "sequence_name", "start", "length", "strand", "sequence_length", "bases",
        *(extra or [none.alias("left_gap_sequence")]), none.alias("state"), none.alias("came"), none.alias("opens"),
    )
    deal = lambda df, head=False: keep(df.repartition("shard").sortWithinPartitions("shard", "block_id", "row_index").mapInArrow(_run(policy, head), RECORD), "merge-round")
    rounds, heads = [deal(light)], True
    ends = lambda k: rounds[k].where(F.col("kind") == END).select("shard", "block_id", "state", "came", "opens", F.lit(k).alias("round"))
    first = ends(0)
    latest = first
    along = Window.orderBy("shard")  # one record per shard, numbers only
    while True:
        marks = latest.select("shard", F.xxhash64("state").alias("leaves"), F.when(F.col("came").isNotNull(), F.xxhash64("came")).alias("from"))
        before = marks.select("shard", "from", F.lag("shard").over(along).alias("before"), F.lag("leaves").over(along).alias("leaves"))
        stale = keep(before.where("before is not null and (from is null or from <> leaves)").select("shard", "before"), "merge-stale")
        n = stale.count()
        if not n:
            break
        small = F.broadcast if n <= MOST_SHARDS else lambda df: df
        state = small(stale).join(latest.select(F.col("shard").alias("before"), F.col("state")), "before").join(first.select("shard", F.col("state").alias("came"), "opens"), "shard")
        again = lambda which: light.join(small(which.select("shard")), "shard", "left_semi").unionByName(state.join(small(which.select("shard")), "shard", "left_semi").select("shard", "state", "came", "opens"), allowMissingColumns=True)
        if heads:
            made = deal(again(stale).where(F.col("block_id").isNull() | (F.col("block_id") - F.col("shard") * shard < max(1, shard // HEAD))), True)
            left = keep(made.where((F.col("kind") == END) & F.col("state").isNull()).select("shard"), "merge-stale")
            more = left.count()
            if more:
                made = made.join(small(left), "shard", "left_anti").unionByName(deal(again(left)))
            heads = 2 * more < n
        else:
            made = deal(again(stale))
        rounds.append(made)
        new = ends(len(rounds) - 1)
        latest = new.unionByName(latest.join(small(stale.select("shard")), "shard", "left_anti"))
        if len(rounds) % 8 == 0:
            latest = keep(latest, "merge-ends")
    told = bounded_broadcast(latest.select("shard", F.col("block_id").alias("met"), "round"), MOST_SHARDS)
    parts = [r.where(F.col("kind") < END).join(told.where(F.col("round") == k) if k else told, "shard") for k, r in enumerate(rounds)]
    # the first run counts from where a later one met it
    parts[0] = parts[0].where((F.col("round") == 0) | (F.coalesce("into", F.lit(LEAST)) >= F.col("met")))
    last = latest.orderBy(F.desc("shard")).limit(1).select("shard", "state").mapInArrow(_closing(policy), RECORD)
    columns = last.columns
    said = last
    for p in parts:
        said = said.unionByName(p.select(*columns))
    return Merging(said, given)


def merge_blocks(rows: DataFrame, policy: Policy = Policy(), shard: int = SHARD) -> DataFrame:
    """Rows of the merged blocks; see ``merging``."""
    return merging(rows, policy, shard).rows()


def merged_tags(rows: DataFrame, tags: DataFrame, policy: Policy = Policy(), shard: int = SHARD) -> DataFrame:
    """``block_id, col, tags`` of the blocks that ``merge_blocks`` makes of ``rows``; ``merging`` gives both in one pass."""
    return merging(rows, policy, shard).tags(tags)
