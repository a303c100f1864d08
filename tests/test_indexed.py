"""Files read by ranges, indexes and BGZF blocks."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import regions
from blockloom.schema import ROW_COLUMNS
from blockloom.sources import bytes as places
from blockloom.sources import indexed, lists, maf, reader, taf

N_BLOCKS = 400


def alignment(seed=1, n=N_BLOCKS):
    """Blocks of two contigs along the reference, with gaps."""
    rng, out, at = random.Random(seed), [], {}
    for k in range(n):
        contig = f"ref.c{k * 2 // n}"
        rows = []
        for i, name in enumerate([contig, "x.a", "y.b"][: rng.choice([2, 3])]):
            bases = "".join(rng.choice("ACGT-") for _ in range(20)) if i else "".join(rng.choice("ACGTT-") for _ in range(19)) + "A"
            strand = i == 0 or rng.random() < 0.9
            start = at.get((name, strand), 0) + rng.choice([0, 0, 3])
            length = 20 - bases.count("-")
            at[name, strand] = start + length
            rows.append((name, start, length, strand, 100_000, bases))
        out.append(rows)
    return out


def maf_text(blocks, ends="\n"):
    s = "".join("a" + ends + "".join("s\t" + "\t".join(map(str, (n, a, m, "+" if d else "-", z, b))) + ends for n, a, m, d, z, b in rows) + ends for rows in blocks)
    return "##maf version=1" + ends + ends + s


def expected_maf_index(text, spacing):
    """The rule, walked sequentially over the text."""
    out, at, ended, name, pos, block = [], 0, 0, None, 0, None
    for line in text.splitlines(keepends=True):
        if line.startswith("a"):
            block = True
        elif block and line.startswith("s\t"):
            _, n, p, *_ = line.split()
            if n != name or int(p) - pos >= spacing:
                name, pos = n, int(p)
                out.append((name, pos, ended))
            block = False
        elif block is not None and not line.strip():
            ended, block = at, None
        at += len(line)
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("sequence_name", "start", "length", "strand", "sequence_length", "bases").collect()))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The same alignment in both formats, plain and in BGZF blocks."""
    folder = tmp_path_factory.mktemp("files")
    blocks = alignment()
    text = maf_text(blocks)
    (folder / "x.maf").write_text(text)
    table = spark.createDataFrame([(b, k, *r) for b, rows in enumerate(blocks) for k, r in enumerate(rows)], "block_id bigint, row_index bigint, sequence_name string, start bigint, length bigint, strand boolean, sequence_length bigint, bases string")
    lines = [v for _, v in sorted((r.block_id, r.value) for r in taf.text(table, repeat=40).collect())]
    column_text = "#taf version:1\n" + "\n".join(lines) + "\n"
    (folder / "x.taf").write_text(column_text)
    for name, t in (("x.maf", text), ("x.taf", column_text)):
        data = t.encode()
        parts = [data[k : k + 3_000] for k in range(0, len(data), 3_000)]  # small blocks
        (folder / f"{name}.bgz").write_bytes(b"".join(map(places.blocks_of, parts)) + places.END_MARKER)
    return folder, blocks


@pytest.mark.parametrize("name", ["x.maf", "x.taf", "x.maf.bgz", "x.taf.bgz"])
@pytest.mark.parametrize("split", [700, 5_000, 1 << 20])
def test_any_cut_gives_the_same_rows(spark, files, name, split):
    folder, blocks = files
    indexed.register(spark)
    df = spark.read.format("alignment").option("split", split).load(str(folder / name))
    assert rows_of(df) == sorted(r for rows in blocks for r in rows)
    order = df.where("row_index = 0").orderBy("block_id").select("start").collect()
    assert [r.start for r in order] == [rows[0][1] for rows in blocks]
    made = spark.read.format("alignment").option("split", split).option("anchors", "true").load(str(folder / name)).orderBy("offset").collect()
    whole = spark.read.format("alignment").option("anchors", "true").load(str(folder / name)).orderBy("offset").collect()
    assert made == whole and len(made) > 20


@pytest.mark.parametrize("name", ["x.maf", "x.taf", "x.maf.bgz", "x.taf.bgz"])
def test_index_and_seek(spark, files, name, tmp_path):
    folder, blocks = files
    path, index = str(folder / name), str(tmp_path / "x.tai")
    reader.write_index(spark, path, index, spacing=200)
    entries = [*indexed.index_entries(index)]
    text = places.opened(path)
    if name == "x.maf":
        assert entries == expected_maf_index((folder / name).read_text(), 200)
    assert {n for n, _, _ in entries} == {"ref.c0", "ref.c1"} and len(entries) > 20
    for n, p, o in entries[:: 7 if "maf" in name else 1]:
        line = next(text.lines(o))[1]
        assert line == "" or line.startswith("##maf") if "maf" in name else indexed.anchor(line, False)[:2] == (n, p)
    assert sorted(map(tuple, lists.read_index(spark, index).collect())) == sorted(entries)
    rng = random.Random(3)
    for _ in range(6):
        contig, start = rng.choice(["ref.c0", "ref.c1"]), rng.randrange(0, 3_500)
        region = f"{contig}:{start}-{start + rng.randrange(1, 300)}"
        assert rows_of(reader.read(spark, path, region, index=index)) == rows_of(reader.read(spark, str(folder / "x.maf"), region))
    assert reader.read(spark, path, "ref.c9:1-5", index=index).count() == reader.read(spark, path, "ref.c0:900000-900010", index=index).count() == 0
    lengths = {r.sequence_name: r.sequence_length for r in reader.sequence_lengths(spark, path, index).collect()}
    assert lengths == {"ref.c0": 100_000, "ref.c1": 100_000}


@pytest.mark.parametrize("name", ["x.maf", "x.taf.bgz"])
def test_conditions_prune_ranges(spark, files, name, tmp_path):
    folder, blocks = files
    path, index = str(folder / name), str(tmp_path / "x.tai")
    reader.write_index(spark, path, index, spacing=100)
    source = indexed.AlignmentReader({"path": path, "index": index, "split": "1"})
    read = lambda: sum(len(b) for p in source.partitions() for b in source.read(p))
    everything = read()
    source.name, source.low, source.high = "ref.c1", 1000, 1100
    some = source.partitions()
    size = lambda parts: sum((p.hi >> 16 if "bgz" in name else p.hi) - (p.lo >> 16 if "bgz" in name else p.lo) for p in parts)
    assert 1 <= len(some) <= 3 and size(some) < 0.1 * places.opened(path).size and read() < 0.1 * everything
    indexed.register(spark)
    df = spark.read.format("alignment").option("index", index).option("split", 1).load(path).where("ref_name = 'ref.c1' and ref_start < 1100 and ref_end > 1000")
    assert df.rdd.getNumPartitions() == len(some)
    assert rows_of(df) == sorted(r for rows in blocks for r in rows if rows[0][0] == "ref.c1" and rows[0][1] < 1100 and rows[0][1] + rows[0][2] > 1000)


def test_bytes_read_grow_with_the_region(tmp_path):
    blocks = alignment(2, 8_000)
    path = tmp_path / "big.maf"
    path.write_text(maf_text(blocks))
    starts = expected_maf_index(path.read_text(), 1_000)
    (tmp_path / "big.tai").write_text("".join(f"{n}\t{p}\t{o}\n" for n, p, o in starts))
    taken = []
    for wide in (100, 10_000, 40_000):
        source = indexed.AlignmentReader({"path": str(path), "index": str(tmp_path / "big.tai"), "regions": json.dumps([("ref.c0", 5_000, 5_000 + wide)])})
        n = 0
        for part in source.partitions():
            text = places.opened(str(path))
            assert [*indexed.row_major_blocks(text, part)]
            n += text.taken
        taken.append(n)
    assert taken[0] < 0.25 * path.stat().st_size and taken[0] < taken[1] < taken[2]


def test_intervals_in_their_order(spark, files, tmp_path):
    """Random lists of intervals, with repeats, base by base along the reference."""
    folder, blocks = files
    path, index = str(folder / "x.taf.bgz"), str(tmp_path / "x.tai")
    reader.write_index(spark, path, index, spacing=150)
    at = {}
    for rows in blocks:
        name, start, length, *_, bases = rows[0]
        at.update({(name, start + k): b for k, b in enumerate(bases.replace("-", ""))})
    rng = random.Random(4)
    for use in (index, None):
        intervals = [("ref.c0", rng.randrange(0, 1500), rng.randrange(0, 60)) for _ in range(8)]
        intervals.append(intervals[2])
        found = reader.read_intervals(spark, path if use else str(folder / "x.maf"), intervals, use).where("row_index = 0").orderBy("ord", "block_id").collect()
        got = [(r.ord, "ref.c0", r.start + k, b) for r in found for k, b in enumerate(r.bases.replace("-", ""))]
        assert got == [(o, n, p, at[n, p]) for o, (n, s, length) in enumerate(intervals) for p in range(s, s + length) if (n, p) in at]


def test_writing_bgzf(spark, files, tmp_path):
    folder, blocks = files
    rows = maf.read(spark, str(folder / "x.maf"))
    maf.write(rows, str(tmp_path / "out"), compression="bgzf")
    parts = sorted(p for p in (tmp_path / "out").iterdir())
    assert parts and all(p.name.endswith(".bgz") and p.read_bytes().endswith(places.END_MARKER) for p in parts)
    joined = tmp_path / "whole.maf.bgz"
    joined.write_bytes(b"".join(p.read_bytes() for p in parts))
    assert gzip.decompress(joined.read_bytes()).decode().startswith("##maf version=1\n")
    indexed.register(spark)
    assert rows_of(spark.read.format("alignment").option("split", 2_000).load(str(joined))) == rows_of(rows)
    taf.write(rows, str(tmp_path / "taf"), compression="bgzf")
    joined.write_bytes(b"".join(p.read_bytes() for p in sorted((tmp_path / "taf").iterdir())))
    assert rows_of(spark.read.format("alignment").load(str(joined))) == rows_of(rows)


def test_bgzf_blocks():
    data = random.Random(1).randbytes(200_000) + b"x" * 300_000
    made = places.blocks_of(data) + places.END_MARKER
    assert gzip.decompress(made) == data
    at = 0
    while at < len(made):
        n = places.block_size(made[at : at + 64])
        assert n <= 1 << 16
        at += n


def test_plain_gzip_has_no_index(spark, tmp_path):
    path = tmp_path / "x.maf.gz"
    path.write_bytes(gzip.compress(b"##maf version=1\n\na\ns r 0 1 + 9 A\n\n"))
    with pytest.raises(ValueError, match="gzip"):
        places.opened(str(path))
    assert reader.read(spark, str(path)).count() == 1  # read as a whole


@pytest.mark.parametrize("shard", [1, 700, 1 << 40])
def test_index_spacing_is_the_sequential_walk(spark, shard):
    rng, anchors, at = random.Random(7), [], {}
    for k in range(600):
        name = rng.choice("ab") if k % 150 > 140 else "abc"[k // 200]
        at[name] = at.get(name, 0) + rng.choice([1, 10, 10, 50]) - (rng.random() < 0.05) * 30  # some step back
        anchors.append((name, at[name], 10 * k))
    expected = [a for a, take in zip(anchors, regions._chosen(((n, p) for n, p, _ in anchors), 100, None, 0)) if take]
    df = spark.createDataFrame(anchors, "name string, pos bigint, offset bigint").repartition(5)
    found = regions.build_index(df, 100, shard)
    assert sorted(map(tuple, found.collect()), key=lambda e: e[2]) == expected
    lines = [tuple(r)[1:] for r in regions.index_lines(found).orderBy("line_no").collect()]
    assert lines[0] == expected[0] and sum(n == "*" for n, _, _ in lines) == sum(a[0] == b[0] for a, b in zip(expected, expected[1:]))
    back = regions.expand_index(regions.index_lines(found))
    assert sorted(map(tuple, back.collect()), key=lambda e: e[2]) == expected


def test_odd_line_ends(spark, tmp_path):
    """Windows line ends and separators that hold blanks."""
    blocks = alignment(5, 30)
    for name, text in (("crlf", maf_text(blocks, "\r\n")), ("blanks", maf_text(blocks).replace("\n\n", "\n \t\n"))):
        path = tmp_path / f"{name}.maf"
        path.write_bytes(text.encode())
        assert rows_of(maf.read(spark, str(path))) == sorted(r for rows in blocks for r in rows)
        indexed.register(spark)
        assert rows_of(spark.read.format("alignment").option("split", 300).load(str(path))) == sorted(r for rows in blocks for r in rows)
