"""Alignment operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.functions import align, scalars
from blockloom.operators import annotate, blocks, columns, coverage, dataset, links, masks, norm, paf, plotstats, regions, rows, selection, stats
from blockloom.sources import lists, maf, newick, reader, taf, wiggle
from blockloom.streaming import stats as streaming

COVERAGE = """##maf version=1 scoring=N/A

a
s\tdog.chr1\t0\t5\t+\t10\tACG-TA
s\tcat.a.chr1\t0\t6\t+\t10\tACCTTA
s\tmouse.chr1\t0\t5\t+\t10\tA-GTTA

a
s\tdog.chr1\t5\t5\t+\t10\tACG-TA
s\tcat.a.chr2\t0\t6\t+\t10\tACCTTA
s\tmouse.chr3\t0\t5\t+\t10\tA-GTCA
s\tmouse.chr4\t0\t5\t+\t10\tA-GTTA

a
s\tdog.chr2\t0\t5\t+\t10\tACG-TA
s\tcat.a.chr3\t0\t6\t+\t10\tACCTTA
s\tmouse.chr4\t0\t5\t+\t10\tA-GTTA
s\tdog.chr3\t0\t5\t+\t10\tACG-TA

"""

GAPPY = """##maf version=1

a
s\tcow.chr1\t10\t4\t+\t100\t-AC-GT--
s\tdog.chr1\t20\t4\t+\t100\t-AC-GT--

a
s\tcow.chr2\t5\t3\t+\t200\tAC--G
s\tdog.chr2\t5\t3\t+\t200\tAC--G

a
s\tcow.chr2\t8\t2\t+\t200\t-TT-
s\tdog.chr2\t8\t2\t+\t200\t-TT-

"""


def read(spark, tmp_path, text):
    path = tmp_path / "in.maf"
    path.write_text(text)
    return maf.read(spark, str(path))


def plain(df):
    """Rows with dense block numbers, sorted."""
    found = df.select(*rows.ROW_COLUMNS).collect()
    number = {b: i for i, b in enumerate(sorted({r.block_id for r in found}))}
    return sorted((number[r.block_id], r.row_index, r.sequence_name, r.start, r.length, r.strand, r.bases) for r in found)


def frame(spark, *data):
    return spark.createDataFrame(list(data), "block_id bigint, row_index bigint, sequence_name string, start bigint, length bigint, strand boolean, sequence_length bigint, bases string")


def test_coverage_tables(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    lines = lambda **k: {r.value for r in coverage.table_text(coverage.coverage(aln, **k)).collect()}
    listed = lines(genomes=["cat.a"])
    assert "_Total_\t20\t20\tmouse\t0.6000\t1.0000\t0.2000\t1.0000\t12\t12\t4\t4" in listed
    assert "dog.chr1\t10\t10\tcat.a\t1.0000\t0.8000\t1.0000\t0.8000\t10\t8\t10\t8" in listed
    assert len(listed) == 9
    sex = lines(sex=["dog.chr1"])
    assert "_Autosomes_\t10\t10\tcat\t0.5000\t0.8000\t0.0000\t0.0000\t5\t4\t0\t0" in sex and len(sex) == 15
    by_reference = coverage.coverage(aln, reference="mouse").where("contig = '_Total_' and query = 'mouse'").first()
    assert by_reference.aligned == by_reference.identical


def test_stats_and_intervals(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    s = stats.alignment_stats(aln).first()
    assert (s.blocks, s.columns, s.bases + s.gaps) == (3, 18, 6 * 11)
    assert s.column_depth == pytest.approx(6 * 11 / 18, rel=1e-6)
    assert [tuple(r) for r in stats.contiguous_intervals(aln).orderBy("sequence_name").collect()] == [("dog.chr1", 0, 10), ("dog.chr2", 0, 5)]
    assert {tuple(r) for r in stats.named_intervals(aln).collect()} == {("dog.chr1", 0, 10), ("dog.chr2", 0, 5)}
    assert {tuple(r) for r in stats.sequence_lengths(aln).collect()} == {("dog.chr1", 10), ("dog.chr2", 10)}
    empty = stats.alignment_stats(aln.limit(0)).first()
    assert (empty.blocks, empty.columns, empty.columns_per_block) == (0, 0, 0.0)


def test_merge_drops_gap_columns_and_joins_neighbours(spark, tmp_path):
    merged = plain(norm.merge_blocks(read(spark, tmp_path, GAPPY)))
    assert [x[6] for x in merged] == ["ACGT", "ACGT", "ACGTT", "ACGTT"]
    assert [x[4] for x in merged] == [4, 4, 5, 5]


def test_merge_aligns_bases_between(spark):
    aln = frame(spark, (0, 0, "a.1", 0, 2, True, 50, "AC"), (0, 1, "b.1", 0, 2, True, 50, "AC"), (1, 0, "a.1", 5, 2, True, 50, "GT"), (1, 1, "b.1", 4, 2, True, 50, "GT"), (1, 2, "c.1", 9, 1, True, 50, "G-"))
    out = plain(norm.merge_blocks(aln))
    assert {x[2]: (x[3], x[4]) for x in out} == {"a.1": (0, 7), "b.1": (0, 6), "c.1": (9, 1)}
    assert len({len(x[6]) for x in out}) == 1
    assert len(plain(norm.merge_blocks(aln, norm.Policy(most_gap=1)))) == 5


def test_prune_drops_far_copies(spark):
    aln = frame(spark, (0, 0, "a.1", 0, 2, True, 900, "AC"), (0, 1, "b.1", 0, 2, True, 900, "AC"), (0, 2, "b.2", 0, 2, True, 900, "AC"), (1, 0, "a.1", 2, 2, True, 900, "GT"), (1, 1, "b.1", 2, 2, True, 900, "GT"), (1, 2, "b.2", 500, 2, True, 900, "GT"))
    assert len(plain(norm.merge_blocks(aln))) == 6
    out = plain(norm.merge_blocks(aln, norm.Policy(prune=True)))
    assert [(x[2], x[6]) for x in out] == [("a.1", "ACGT"), ("b.1", "ACGT"), ("b.2", "AC--")]


def tagged(spark, *places):
    """A tag with the column's number at each of these (block, column)."""
    return spark.createDataFrame([(b, c, [("was", str(c))]) for b, c in places], "block_id bigint, col bigint, tags array<struct<key: string, value: string>>")


def moved(tags, *keys):
    return sorted((*(r[k] for k in keys), r["col"], r["tags"][0]["value"]) for r in tags.collect())


def test_tags_follow_their_columns(spark):
    aln = frame(spark, (0, 0, "r.1", 0, 4, True, 100, "A-C-GT"), (0, 1, "s.1", 0, 5, True, 100, "A-CTGT"), (1, 0, "r.1", 9, 0, True, 100, "--"), (1, 1, "s.1", 9, 0, True, 100, "--"))
    tags = tagged(spark, *[(0, c) for c in range(6)], (1, 0), (1, 1))
    assert moved(blocks.tags_without_gap_columns(aln, tags), "block_id") == [(0, 0, "0"), (0, 1, "2"), (0, 2, "3"), (0, 3, "4"), (0, 4, "5"), (1, 0, "0")]
    assert moved(blocks.unnormalised_tags(aln, tags), "block_id", "segment") == [(0, 0, 0, "0"), (0, 1, 0, "2"), (0, 2, 0, "4"), (0, 2, 1, "5")]
    assert moved(blocks.unnormalised_tags(aln, tags.limit(0)), "block_id", "segment") == []


def test_tags_follow_merged_blocks(spark):
    aln = frame(
        spark, (0, 0, "a.1", 0, 2, True, 900, "A-C"), (0, 1, "b.1", 0, 2, True, 900, "A-C"), (0, 2, "b.2", 0, 2, True, 900, "A-C"),
        (1, 0, "a.1", 4, 2, True, 900, "G-T"), (1, 1, "b.1", 2, 2, True, 900, "G-T"), (1, 2, "b.2", 500, 1, True, 900, "-A-"),
    )
    tags = tagged(spark, *[(b, c) for b in (0, 1) for c in range(3)])
    apart = moved(norm.merged_tags(aln, tags), "block_id")
    assert apart == [(0, 0, "0"), (0, 1, "2"), (1, 0, "0"), (1, 1, "1"), (1, 2, "2")]
    # the far copy goes, and with it the column that it alone fills; two bases stand between the blocks
    policy = norm.Policy(prune=True)
    assert [x[6] for x in plain(norm.merge_blocks(aln, policy))] == ["ACNNGT", "AC--GT", "AC----"]
    assert moved(norm.merged_tags(aln, tags, policy), "block_id") == [(0, 0, "0"), (0, 1, "2"), (0, 4, "0"), (0, 5, "2")]


def test_merged_block_that_begins_with_a_new_row(spark):
    aln = frame(spark, (0, 0, "a.1", 0, 2, True, 50, "AC"), (1, 0, "z.1", 7, 2, True, 50, "GT"), (1, 1, "a.1", 2, 2, True, 50, "GT"))
    out = norm.merge_blocks(aln).collect()
    assert {r.block_id for r in out} == {0} and {(r.sequence_name, r.bases) for r in out} == {("a.1", "ACGT"), ("z.1", "--GT")}


def test_unnormalise(spark):
    aln = frame(spark, (0, 0, "r.1", 0, 4, True, 100, "AC--GT"), (0, 1, "s.1", 0, 6, True, 100, "ACTTGT"), (0, 2, "t.1", 0, 3, True, 100, "-C--GT"), (1, 0, "r.1", 9, 0, True, 100, "--"), (1, 1, "s.1", 9, 2, True, 100, "AC"))
    out = sorted((r.segment, r.row_index, r.sequence_name, r.start, r.bases) for r in blocks.unnormalise(aln).collect())
    assert out == [(0, 0, "r.1", 0, "AC"), (0, 1, "s.1", 0, "AC"), (0, 2, "t.1", 0, "-C"), (1, 0, "r.1", 2, "GT"), (1, 1, "s.1", 4, "GT"), (1, 2, "t.1", 1, "GT")]


def test_rows(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    assert {x[2] for x in plain(rows.filter_rows(aln, ["mouse", "dog"], True))} == {"dog.chr1", "dog.chr2", "cat.a.chr1", "cat.a.chr2", "cat.a.chr3"}
    assert len(plain(rows.dedupe_rows(aln, ["mouse", "dog"]))) == 9
    padded = plain(rows.pad_rows(aln, ["dog", "horse"]))
    assert sum(x[2] == "horse" and x[6] == "------" for x in padded) == 3
    ordered = plain(rows.sort_rows(aln, ["mouse", "cat"], keep_first=False))
    assert [x[2] for x in ordered if x[0] == 2] == ["dog.chr2", "dog.chr3", "mouse.chr4", "cat.a.chr3"]
    with pytest.raises(ValueError):
        rows.check_prefixes(["cat", "cat.a"])
    named = rows.rename(aln, spark.createDataFrame([("cat.a", "felis"), ("dog.chr2", "wolf")], "old string, new string"))
    assert {"felis.chr1", "wolf", "dog.chr1"} <= {x[2] for x in plain(named)}


def test_masks(spark):
    aln = frame(spark, (0, 0, "r", 0, 3, True, 9, "AC-G"), (0, 1, "s", 0, 3, True, 9, "aC-T"), (0, 2, "t", 0, 4, True, 9, "ACTT"))
    assert [x[6] for x in plain(masks.mask_reference(aln))] == ["AC-G", "a**T", "**TT"]
    assert [x[6] for x in plain(masks.mask_lineage(aln, {"r": None, "s": "r", "t": "s"}))] == ["AC-G", "**-T", "**T*"]


def test_pairwise(spark):
    aln = frame(spark, (0, 0, "t", 2, 4, False, 10, "AC-GT-"), (0, 1, "q", 1, 4, True, 10, "AGC-T-"))
    r = paf.pairs(aln).first()
    assert (r.strand, r.target_start, r.target_end, r.query_start, r.query_end, r.matches, r.block_length, r.cigar) == ("-", 4, 8, 1, 5, 3, 5, "cg:Z:1M1D1I2M")
    assert paf.pairs(aln, differences=True).first().cigar == "cs:Z:=T-G+C*CG=A"


def test_columns_windows_codes(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    cols = columns.columns(aln, names=True)
    first = [(r.bases, r.ref_pos) for r in cols.where("ref_pos < 5 and names[0] = 'dog.chr1'").orderBy("block_id", "col").collect()]
    assert first == [("AAA", 0), ("CC-", 1), ("GCG", 2), ("-TT", 3), ("TTT", 3), ("AAA", 4)]
    assert columns.columns(aln, only_reference=True).count() == 15
    w = columns.windows(cols, 4, 3).orderBy("window").collect()
    assert [len(x.bases) for x in w] == [4] * 5 and w[1].bases[0] == "-TT"
    assert cols.select(columns.codes(F.lit("aCGt-N"))).first()[0] == [0, 1, 2, 3, 4, 5]
    assert cols.select(columns.one_hots(F.lit("C"))).first()[0] == [[0, 1, 0, 0, 0, 0]]
    assert {r.bases for r in columns.column_at(aln, -1).collect()} == {"AAA", "AAAA"}
    tagged = annotate.annotate(aln, spark.createDataFrame([("dog.chr1", 3, 2.5)], "sequence_name string, pos bigint, value double"), "score")
    assert [(r.bases, r.tags[0].value) for r in tagged.where("size(tags) > 0").collect()] == [("TTT", "2.500000")]
    data = dataset.examples(aln, tagged, lambda t: columns.tag_label(t, "score"), 2, 2)
    assert data.count() == 9 and sum(sum(r.label) for r in data.collect()) == 2.5
    assert sum(len(b) for b in dataset.batches(data, 4)) == 9




def test_regions(spark, tmp_path):
    assert regions.parse_region("a:b:3-9") == ("a:b", 3, 9) and regions.parse_region("c:4") == ("c", 4, 5) and regions.parse_region("c") == ("c", 0, None)
    for bad in ("", "c:5-5", "c:-1-4", "c:x", ":1-2"):
        with pytest.raises(ValueError):
            regions.parse_region(bad)
    aln = read(spark, tmp_path, COVERAGE)
    clipped = plain(regions.clip(aln, "dog.chr1", 2, 7))
    assert [(x[2], x[3], x[4], x[6]) for x in clipped] == [("dog.chr1", 2, 3, "G-TA"), ("cat.a.chr1", 2, 4, "CTTA"), ("mouse.chr1", 1, 4, "GTTA"), ("dog.chr1", 5, 2, "AC"), ("cat.a.chr2", 0, 2, "AC"), ("mouse.chr3", 0, 1, "A-"), ("mouse.chr4", 0, 1, "A-")]
    assert plain(regions.clip(aln, "dog.chr9", 2, 7)) == []
    wanted = spark.createDataFrame([(0, "dog.chr1", 1, 2), (1, "dog.chr1", 1, 2), (2, "dog.chr2", 0, 9)], "ord bigint, name string, region_start bigint, region_end bigint")
    assert {r["ord"]: r["count"] for r in regions.clip_all(aln, wanted).groupBy("ord").count().collect()} == {0: 3, 1: 3, 2: 4}
    anchors = spark.createDataFrame([("c", p, p * 10) for p in range(0, 100, 7)] + [("d", 50, 999)], "name string, pos bigint, offset bigint")  # d follows c in the file
    entries = regions.build_index(anchors, 20)
    assert sorted((r.name, r.pos) for r in entries.collect()) == [("c", 0), ("c", 21), ("c", 42), ("c", 63), ("c", 84), ("d", 50)]
    lists.write_index(entries, str(tmp_path / "x.tai"))
    assert sorted(map(tuple, lists.read_index(spark, str(tmp_path / "x.tai")).collect())) == sorted(map(tuple, entries.collect()))


def test_union_of_regions_is_the_whole(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    parts = [regions.clip(aln, "dog.chr1", a, a + 1) for a in range(10)]
    total = sum(r.length for p in parts for r in p.where("row_index = 0").collect())
    assert total == 10


def test_text_round_trips(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    maf.write(aln, str(tmp_path / "out.maf"), {"version": "1"})
    assert plain(maf.read(spark, str(tmp_path / "out.maf"))) == plain(aln)
    for rle in (False, True):
        path = str(tmp_path / f"out{rle}.taf")
        taf.write(aln, path, rle=rle)
        assert taf.sniff(spark, path) == "taf"
        assert plain(taf.read(spark, path)) == plain(aln)
    assert maf.header(spark, str(tmp_path / "in.maf"))["scoring"] == "N/A"


def test_reader_of_both_formats(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    paths = [str(tmp_path / "both.maf"), str(tmp_path / "both.taf")]
    maf.write(aln, paths[0])
    taf.write(aln, paths[1])
    strip = lambda df, *more: sorted(tuple(r[c] for c in ("sequence_name", "start", "length", "strand", "bases", *more)) for r in df.collect())
    for path in paths:
        assert strip(reader.read(spark, path)) == strip(aln)
        assert strip(reader.read(spark, path, region="dog.chr1:6-8")) == strip(regions.clip(aln, *regions.parse_region("dog.chr1:6-8")))
        whole = reader.read(spark, path, region="dog.chr1", links=True)
        assert {r.sequence_name for r in whole.where("l_row_index = 0").collect()} == {"dog.chr1"}
    assert reader.header(spark, paths[0])["version"] == "1"
    (tmp_path / "other.txt").write_text("neither\n")
    with pytest.raises(ValueError):
        reader.read(spark, str(tmp_path / "other.txt"))


def test_tags_survive_text(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    first = aln.agg(F.min("block_id")).first()[0]
    tags = spark.createDataFrame([(first, 2, [("k", "v"), ("x", "1")])], "block_id bigint, col bigint, tags array<struct<key: string, value: string>>")
    path = str(tmp_path / "t.taf")
    taf.write(aln, path, column_tags=tags)
    back = taf.read(spark, path, tags=True).collect()
    assert [(r.col, [tuple(t) for t in r.tags]) for r in back] == [(2, [("k", "v"), ("x", "1")])]
    one = spark.createDataFrame([([("k", "v")],)], "tags array<struct<key: string, value: string>>").select(columns.set_tag(F.col("tags"), "k", F.lit("w")).alias("t")).first().t
    assert [tuple(t) for t in one] == [("k", "w")]


def test_differential_coordinates():
    lines = ["AA ; i 0 a 0 + 9 i 1 b 3 - 9", "C-", "GG ; g 0 2 G 1 TT", "T ; d 1 s 0 c 1 + 5 @ k:v"]
    found = [*taf.decode_lines(enumerate(lines))]
    assert [[(r["sequence_name"], r["start"], r["bases"]) for r in b] for _, b, _ in found] == [[("a", 0, "AC"), ("b", 3, "A-")], [("a", 4, "G"), ("b", 6, "G")], [("c", 1, "T")]]
    assert found[1][1][1]["left_gap_sequence"] == "TT" and found[2][2] == [(0, [{"key": "k", "value": "v"}])]
    with pytest.raises(ValueError):
        list(taf.decode_lines([(0, "A ; i 0 a 0 + 9 @ bad")]))


def test_links_and_gaps(spark):
    aln = frame(spark, (0, 0, "a", 0, 2, True, 20, "AC"), (0, 1, "b", 0, 2, False, 20, "AC"), (5, 0, "a", 4, 2, True, 20, "AC"), (5, 1, "b", 3, 2, False, 20, "AC"), (9, 0, "c", 0, 1, True, 20, "A"), (9, 1, "a", 6, 1, True, 20, "A"))
    assert sorted((r.block_id, r.row_index, r.l_row_index) for r in links.fast_links(aln).collect()) == [(5, 0, 0), (5, 1, 1)]
    assert sorted((r.block_id, r.row_index, r.gap) for r in links.gap_lengths(aln).collect()) == [(5, 0, 2), (5, 1, 1)]
    seq = spark.createDataFrame([("a", "ACGTACGTACGTACGTACGT"), ("b", "AAAAAAAAAAAAAAAAAGAA")], "name string, seq string")
    assert sorted((r.row_index, r.left_gap_sequence) for r in links.gap_bases(aln, seq).collect()) == [(0, "GT"), (1, "C")]
    assert links.gap_bases(aln, seq, 1).count() == 1
    found = {(r.block_id, r.row_index): r.l_row_index for r in links.diff_links(aln, False).collect()}
    assert found[(5, 0)] == 0 and found[(5, 1)] == 1 and found[(9, 1)] == 0 and found[(9, 0)] is None


def test_links_follow_rows_that_come_and_go(spark):
    aln = frame(spark, (0, 0, "a", 0, 2, True, 20, "AC"), (0, 1, "b", 0, 2, True, 20, "AC"), (1, 0, "a", 5, 2, True, 20, "AC"), (1, 1, "n", 3, 2, True, 20, "AC"), (1, 2, "b", 3, 2, True, 20, "AC"), (2, 0, "b", 9, 1, True, 20, "A"))
    assert {(r.block_id, r.common, r.max_gap) for r in links.common_rows(aln).collect()} == {(0, 0, 0), (1, 2, 3), (2, 1, 4)}
    assert {(r.block_id, r.common) for r in links.common_rows(aln, same_index=True).collect()} == {(0, 0), (1, 1), (2, 0)}
    assert {(r.block_id, r.row_index, r.gap) for r in links.gap_lengths(aln).collect()} == {(1, 0, 3), (1, 2, 1), (2, 0, 4)}
    seq = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "AAGGTTCCAA")], "name string, seq string")
    assert {(r.block_id, r.row_index, r.left_gap_sequence) for r in links.gap_bases(aln, seq).collect()} == {(1, 0, "GTA"), (1, 2, "G"), (2, 0, "TCCA")}
    assert links.common_rows(aln.limit(0)).count() == 0


def test_gap_bases_meet_pieces_of_sequences(spark, monkeypatch):
    """Gaps inside a piece, over several, up to the end and beyond it, on both strands; pieces given or cut."""
    monkeypatch.setattr(links, "PIECE", 4)
    text = "ACGTTGCAACGTGGC"
    ends = [(0, 3), (3, 5), (3, 9), (7, 8), (8, 12), (11, 15), (13, 18), (16, 18)]
    table = [t for k, (a, b) in enumerate(ends) for t in ((2 * k, 0, "s", a - 1, 1, True, 15, "A"), (2 * k + 1, 0, "s", b, 1, True, 15, "A"))]
    table += [t for k, (a, b) in enumerate(ends[:6], 20) for t in ((2 * k, 0, "s", a - 1, 1, False, 15, "A"), (2 * k + 1, 0, "s", b, 1, False, 15, "A"))]
    table += [(90, 0, "unknown", 0, 1, True, 9, "A"), (91, 0, "unknown", 3, 1, True, 9, "A")]
    back = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {2 * k + 1: text[a:b] for k, (a, b) in enumerate(ends)} | {2 * k + 1: back[a:b] for k, (a, b) in enumerate(ends[:6], 20)} | {91: None}
    pieces = [("s", k, text[4 * k : 4 * k + 4]) for k in range(4)]
    for seq in (spark.createDataFrame([("s", text)], "name string, seq string"), spark.createDataFrame(pieces, "name string, piece long, seq string")):
        got = {r.block_id: r.left_gap_sequence for r in links.gap_bases(frame(spark, *table), seq, -1).collect() if r.block_id % 2}
        assert got == want


def test_gap_bases_broadcast_no_pieces_and_make_only_those_that_gaps_touch(spark, monkeypatch):
    """Two names of a few bytes stand for many pieces, of which the gaps touch the first ones."""
    monkeypatch.setattr(links, "PIECE", 64)
    aln = frame(spark, (0, 0, "a", 0, 2, True, 640, "AC"), (0, 1, "b", 60, 2, True, 640, "AC"), (1, 0, "a", 4, 2, True, 640, "AC"), (1, 1, "b", 66, 2, True, 640, "AC"))
    pieces = spark.createDataFrame([("a",), ("b",)], "name string").withColumn("piece", F.explode(F.expr("sequence(0L, 9L)")))
    seq = "repeat(if(piece = 0, 'AC', 'GT'), 32)"
    for table, made in ((pieces.withColumn("seq", F.expr(seq)), "seq"), (pieces, f"if(piece < 2, {seq}, raise_error('touched by no gap'))")):
        found = links.gap_bases(aln, table, made=made)
        assert sorted((r.row_index, r.left_gap_sequence) for r in found.collect()) == [(0, "AC"), (1, "ACGT")]
        joins = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "piece" in x]
        assert joins and not any("Broadcast" in x for x in joins)


def test_links_are_cheapest_alignments(spark):
    """Against the plain recursion over both row lists, on random blocks."""
    random.seed(11)
    table = [(b, i, random.choice("abc"), random.randint(0, 4) + 3 * b, random.randint(1, 3), random.random() < 0.9, 99, "A") for b in range(0, 60, 2) for i in range(random.randint(1, 5))]
    got: dict = {}
    for r in links.diff_links(frame(spark, *table)).collect():
        got.setdefault(r.block_id, {})[r.row_index] = r.l_row_index
    assert {(b, i) for b, rows in got.items() for i in rows} == {t[:2] for t in table}
    for block in range(0, 60, 2):
        left, right = ([t for t in table if t[0] == b] for b in (block - 2, block))
        ok = [[x[5] == y[5] and x[3] + x[4] <= y[3] and x[2] == y[2] for y in right] for x in left]
        p = list(range(len(right) + 1))
        for i in range(len(left)):
            q = [i + 1]
            for j in range(len(right)):
                q.append(min(p[j] + (not ok[i][j]), p[j + 1] + 1, q[-1] + 1))
            p = q
        to = [(l, j) for j, l in sorted(got[block].items()) if l is not None]
        assert to == sorted(to) and len({l for l, _ in to}) == len(to)
        assert sum(not ok[l][j] for l, j in to) + len(left) + len(right) - 2 * len(to) == p[-1]


def test_alignment_is_cheapest():
    def cost(a, b, g, x):
        p = [j * g for j in range(len(b) + 1)]
        for i in range(1, len(a) + 1):
            q = [i * g]
            for j in range(1, len(b) + 1):
                q.append(min(p[j - 1] + (x if a[i - 1] != b[j - 1] else 0), p[j] + g, q[-1] + g))
            p = q
        return p[-1]

    random.seed(5)
    for _ in range(500):
        a, b = ("".join(random.choice("AT") for _ in range(random.randint(0, 10))) for _ in range(2))
        g, x = random.randint(1, 4), random.randint(1, 10)
        pairs = align.wavefront(a, b, gap=g, mismatch=x)
        assert sum(g if None in p else x * (a[p[0]] != b[p[1]]) for p in pairs) == cost(a, b, g, x)
        made = align.star([a, b, a[::-1]])
        assert [s.replace("-", "") for s in made] == [a, b, a[::-1]] and len({*map(len, made)}) == 1


def test_small_sources(spark, tmp_path):
    (tmp_path / "w").write_text("fixedStep chrom=c start=3 step=2 span=2\n1.5\n2\nvariableStep chrom=d\n7 9\n")
    assert sorted(map(tuple, wiggle.read(spark, str(tmp_path / "w"), "g.").collect())) == [("g.c", 2, 1.5), ("g.c", 3, 1.5), ("g.c", 4, 2.0), ("g.c", 5, 2.0), ("g.d", 6, 9.0)]
    (tmp_path / "f").write_text(">a one\nAC\nGT\n>b\nTT\n")
    fasta = lists.check_unique(lists.fasta(spark, str(tmp_path / "f")))
    assert sorted(map(tuple, fasta.collect())) == [("a", "ACGT"), ("b", "TT")]
    with pytest.raises(ValueError):
        lists.check_unique(fasta.union(fasta))
    (tmp_path / "n").write_text("a\tb\n\nbad\nc\td\n")
    assert sorted(map(tuple, lists.name_map(spark, str(tmp_path / "n")).collect())) == [("a", "b"), ("c", "d")]
    (tmp_path / "p").write_text("one\ntwo\n")
    assert lists.prefixes(spark, str(tmp_path / "p")) == ["one", "two"]
    (tmp_path / "b").write_text("c 1 5\nc 7 9\n")
    assert [(r.name, r.region_start) for r in lists.bed(spark, str(tmp_path / "b")).orderBy("ord").collect()] == [("c", 1), ("c", 7)]


def test_newick():
    t = newick.parse("((a:1,b:2)x:3,c:4)r;")
    assert t.text() == "((a:1.0,b:2.0)x:3.0,c:4.0)r:0.0;" and t.text(lengths=False) == "((a,b)x,c)r;"
    assert newick.parents(t) == {"r": None, "x": "r", "a": "x", "b": "x", "c": "r"}
    assert [n.label for n in t.walk("post")] == ["a", "b", "x", "c", "r"] and newick.sort_list(t, "mid") == ["a", "x", "b", "r", "c"]
    r = t.rerooted("x")
    assert r.text(lengths=False) == "(a,b,(c)r)x;" and r.find("r").length == 3.0
    assert newick.sort_list(t, inner=False, suffix=".") == ["a.", "b.", "c."]


def test_plot_tables(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    covered = plotstats.species_coverage(aln)
    assert {r.species: r.covered for r in covered.collect()} == {"cat": 18, "mouse": 20, "dog": 5}
    assert [r.species for r in plotstats.top_species(covered, 2).orderBy("rank").collect()] == ["mouse", "cat"]
    assert [r.species for r in plotstats.spread_species(covered, 2).collect()] == ["mouse", "dog"]
    binned = plotstats.bins(aln, 5)
    assert sum(r.aligned for r in binned.where("species = 'cat'").collect()) == 15
    assert plotstats.bin_summary(binned, 5).count() == 3
    runs = plotstats.collinear_runs(aln, 3)
    assert runs.agg(F.sum("n_rows")).first()[0] == 8
    assert plotstats.secondary_runs_dropped(runs, 100).count() == runs.select("sequence_name").distinct().count()
    assert plotstats.orientation(aln).where("majority = '+'").count() == plotstats.orientation(aln).count()
    spots = spark.createDataFrame([("a", 10, 20), ("a", 1000, 1010)], "sequence_name string, start bigint, end bigint")
    assert sorted(r.x for r in plotstats.layout(spots, 50).collect()) == [0, 60]


def test_scalars(spark):
    df = spark.createDataFrame([("AAC-",)], "b string")
    assert df.select(scalars.run_length(F.col("b"))).first()[0] == "A 2 C 1 - 1"
    assert df.select(scalars.run_length_decode(F.lit("A 2 C 1 - 1"))).first()[0] == "AAC-"
    assert df.select(scalars.reverse_complement(F.col("b"))).first()[0] == "-GTT"
    assert df.select(scalars.genome_in(F.lit("x.y.z"), ["x.y", "x"])).first()[0] == "x"
    assert df.select(scalars.default_genome(F.lit(".x"))).first()[0] == ".x"
    assert "\u001b[31m" in df.select(scalars.coloured(F.col("b"))).first()[0]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.maf").write_text(COVERAGE)
    q = streaming.start(spark, str(tmp_path / "in"), "totals", str(tmp_path / "check"))
    try:
        q.processAllAvailable()
        (tmp_path / "in" / "two.maf").write_text(COVERAGE)
        q.processAllAvailable()
        got = {r.contig: (r.blocks, r.columns, r.bases) for r in spark.table("totals").collect()}
    finally:
        q.stop()
    assert got == {"dog.chr1": (4, 24, 74), "dog.chr2": (2, 12, 42)}


def test_partition_count_changes_nothing(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    made = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        made.append((plain(norm.merge_blocks(aln)), sorted(map(tuple, coverage.coverage(aln, thresholds=[0, 3]).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1]


def test_wiggle_of_several_splits(spark, tmp_path):
    """Positions of a fixedStep section don't depend on how the file is split, nor on comments."""
    text = ["fixedStep chrom=c start=11 step=2"]
    for i in range(6000):
        text += [str(i)] + ["# a comment", ""] * (i % 1000 == 7)
    (tmp_path / "w").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path / "w")).rdd.getNumPartitions() > 3
        got = sorted((r.pos, r.value) for r in wiggle.read(spark, str(tmp_path / "w")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(10 + 2 * i, float(i)) for i in range(6000)]


def test_runs_of_a_track_are_spread_inside_blocks(spark):
    """Runs that span blocks, bins and gaps give each reference base the value that its position has."""
    rng = random.Random(9)
    table, at = [], 60_000
    for b in range(40):
        bases = ["".join(rng.choice("ACGT-") for _ in range(rng.choice([12, 900]))) or "A" for _ in range(1)]
        bases.append("".join(rng.choice("AC-") for _ in bases[0]))
        for k, x in enumerate(bases):
            table.append((b, k, "ref.c" if k == 0 else "x.c", at if k == 0 else 5, len(x.replace("-", "")), True, 10**6, x))
        at += len(bases[0].replace("-", "")) + rng.choice([0, 0, 7])
    track, p = [], 59_000
    while p < at + 500:
        n = rng.choice([1, 1, 5, 300, 2_000])
        if rng.random() < 0.7:
            track.append(("ref.c", p, p + n, float(rng.randrange(100)) / 4))
        p += n
    track.append(("other.c", 0, 10**6, 1.0))
    value = {q: v for n, a, z, v in track if n == "ref.c" for q in range(a, z)}
    aln = spark.createDataFrame(table, "block_id bigint, row_index bigint, sequence_name string, start bigint, length bigint, strand boolean, sequence_length bigint, bases string")
    got = annotate.annotate(aln, spark.createDataFrame(track, "sequence_name string, start bigint, end bigint, value double"), "v").collect()
    expected = {}
    for b, k, _, start, *_, bases in table:
        if k == 0:
            for c, x in enumerate(bases):
                pos = start + len(bases[:c].replace("-", ""))
                expected[b, c] = (pos, x, [f"{value[pos]:f}"] if x != "-" and pos in value else [])
    assert {(r.block_id, r.col): (r.ref_pos, r.ref_base, [t.value for t in r.tags]) for r in got} == expected
    points = spark.createDataFrame([("ref.c", q, v) for q, v in value.items()], "sequence_name string, pos bigint, value double")
    assert sorted(map(str, annotate.annotate(aln, points, "v").collect())) == sorted(map(str, got))


@pytest.mark.parametrize("bins", [2, 512])
def test_medians_are_exact(spark, bins):
    rng = random.Random(6)
    groups = {"even": [1.0, 2.0], "one": [5.5], "ties": [3.0] * 50 + [4.0] * 50, "wide": [rng.gauss(0, 1) * 10 ** rng.randrange(-9, 10) for _ in range(301)], "ints": [float(rng.randrange(40)) for _ in range(1000)], None: [7.0, -7.0, 1e300, -1e300], "far": [0.0, 1e-300, 1e300, 1.7e308, -1.7e308]}
    table = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    got = {r.g: r.median for r in selection.medians(spark.createDataFrame(table, "g string, x double").repartition(3), ["g"], "x", bins).collect()}
    middle = lambda v: 0.5 * sorted(v)[(len(v) - 1) // 2] + 0.5 * sorted(v)[len(v) // 2]
    assert got == {g: middle(v) for g, v in groups.items()}


@pytest.mark.parametrize("span", [7, 100, 10**7])
def test_runs_and_layout_do_not_depend_on_stretches(spark, span):
    rng = random.Random(8)
    table = [(b, k, f"x.{rng.randrange(2)}" if k else "ref.c", rng.randrange(600), rng.randrange(0, 9), rng.random() < 0.6, 1000, "A") for b in range(120) for k in range(3)]
    aln = spark.createDataFrame(table, "block_id bigint, row_index bigint, sequence_name string, start bigint, length bigint, strand boolean, sequence_length bigint, bases string")
    expected = []
    for key in sorted({(r[2], r[5]) for r in table if r[1]}):
        run = None
        for b, k, _, start, length, *_ in sorted((r for r in table if r[1] and (r[2], r[5]) == key), key=lambda r: (r[3], r[0], r[1])):
            if run is not None and 0 <= start - last <= 5:
                run[1:] = max(run[1], start + length), run[2] + 1, run[3] + length
            else:
                run = [start, start + length, 1, length]
                expected.append((key, run))
            last = start + length
    runs = plotstats.collinear_runs(aln, 5, span)
    assert sorted((r.sequence_name, r.strand, r.start, r.end, r.n_rows, r.aligned) for r in runs.collect()) == sorted((*k, *r) for k, r in expected)
    kept = sorted(plotstats.secondary_runs_dropped(runs, 6).select("sequence_name", "aligned", "start").collect())
    longest = {n: max(r[3] for (m, _), r in expected if m == n) for n in {k[0] for k, _ in expected}}
    assert {r.sequence_name: max(x.aligned for x in kept if x.sequence_name == r.sequence_name) for r in kept} == longest
    assert sum(r.aligned >= 6 for r in kept) == sum(r[3] >= 6 for _, r in expected)
    spans = [(n, r[0], r[1]) for (n, _), r in expected]
    shown = plotstats.layout(spark.createDataFrame(spans, "sequence_name string, start bigint, end bigint"), 4, span).collect()
    x, reach = {}, {}
    for n, a, z in sorted(spans):
        if n not in reach:
            reach[n], x[n, a, z], first, saved = z, 0, a, 0
        else:
            saved += max(0, max(0, a - reach[n]) - 4)
            x[n, a, z], reach[n] = a - first - saved, max(reach[n], z)
    assert {(r.sequence_name, r.start, r.end): r.x for r in shown} == x


def test_reports_names_and_masks(spark, tmp_path):
    aln = read(spark, tmp_path, COVERAGE)
    lines = [r.value for r in stats.stats_text(stats.alignment_stats(aln)).orderBy("n").collect()]
    assert lines == ["Total blocks:\t3", "Total columns:\t18", "Avg. columns/block:\t6.000000", "Total bases:\t58", "Total gaps:\t8", "Avg. column depth:\t3.666667", "Avg. bases/column:\t3.222222", "Avg. gaps/column:\t0.444444"]
    assert sorted(r.value for r in stats.bed_text(stats.contiguous_intervals(aln)).collect()) == ["dog.chr1\t0\t10", "dog.chr2\t0\t5"]
    assert sorted(r.value for r in stats.lengths_text(stats.sequence_lengths(aln)).collect()) == ["dog.chr1\t10", "dog.chr2\t10"]
    odd = aln.withColumn("sequence_name", F.when(F.col("row_index") == 0, F.concat(F.lit("_Total_"), F.when(F.col("sequence_name") == "dog.chr2", "_").otherwise(""))).otherwise(F.col("sequence_name")))
    contigs = {r.contig for r in coverage.coverage(odd, sex=["_Total_"]).collect()}
    assert contigs == {"_Total_", "_Total__", "_Total___", "_Sex_Chroms_", "_Autosomes_"}
    species = lambda **k: {r.species: r.covered for r in plotstats.species_coverage(aln, **k).collect()}
    assert species() == {"cat": 18, "mouse": 20, "dog": 5} and species(reference="dog") == {"cat": 18, "mouse": 20} and species(only=["dog"], reference="dog") == {"dog": 5}
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    tree = {"dog.": None, "cat.": "dog.", "mouse.": "dog."}
    assert same(masks.mask(aln, True, tree), masks.mask_reference(aln)) and same(masks.mask(aln, parent_of=tree), masks.mask_lineage(aln, tree)) and masks.mask(aln) is aln
    plain_text = taf.text(aln, omit=True).orderBy("block_id").first().value
    assert plain_text.split("\n") == ["AAA", "CC-", "GCG", "-TT", "TTT", "AAA"]


def test_a_header_may_hold_the_mark_of_a_record(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">one a > b >c\nAC\nGT\n>two\nTT\n\n>three\n")
    assert sorted(map(tuple, lists.fasta(spark, str(path)).collect())) == [("one", "ACGT"), ("three", ""), ("two", "TT")]
