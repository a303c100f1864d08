"""Small files with their known results, from text to text."""

import pytest
from pyspark.sql import functions as F

from blockloom.operators import blocks, norm, rows
from blockloom.sources import maf, taf

HEAD = "#taf version:1\n"


def both(spark, tmp_path, text):
    path = tmp_path / "in.taf"
    path.write_text(text)
    return taf.read(spark, str(path)), taf.read(spark, str(path), tags=True)


def shown(aln, tags=None):
    return "\n".join(v for _, v in sorted((r.block_id, r.value) for r in taf.text(aln, tags=tags).collect())) + "\n"


def test_tags_through_a_merge(spark, tmp_path):
    aln, tags = both(spark, tmp_path, HEAD + "AA ; i 0 s1.c1 0 + 100 i 1 s2.c1 0 + 100 @ c:0\n-- @ c:allgap\nCC @ c:1\nGG ; @ c:2\nTT @ c:3\n")
    made = norm.merging(aln)
    assert shown(made.rows(), made.tags(tags)) == "AA ; i 0 s1.c1 0 + 100 i 1 s2.c1 0 + 100 @ c:0\nCC @ c:1\nGG @ c:2\nTT @ c:3\n"


def test_tags_through_a_split(spark, tmp_path):
    aln, tags = both(spark, tmp_path, HEAD + "AA ; i 0 ref.c1 0 + 100 i 1 s2.c1 0 + 100 @ c:zero\n-T @ c:refgap\nCC @ c:one\n")
    number = lambda df: df.withColumn("block_id", F.col("block_id") * 1000 + F.col("segment")).drop("segment")
    out = number(blocks.unnormalise(aln)), number(blocks.unnormalised_tags(aln, tags))
    assert shown(*out) == "AA ; i 0 ref.c1 0 + 100 i 1 s2.c1 0 + 100 @ c:zero\nCC ; g 1 1 @ c:one\n"


def test_a_block_of_gaps_keeps_the_bases_before_it(spark, tmp_path):
    text = HEAD + "AA ; i 0 s1.c1 0 + 100 i 1 s2.c1 0 + 100\nCC\n-- ; G 0 TTTTT G 1 TTTTT\n--\nGG ; G 0 CCC G 1 CCC\nTT\n"
    out = norm.merge_blocks(both(spark, tmp_path, text)[0]).collect()
    assert [(r.length, len(r.bases.replace("-", ""))) for r in out] == [(12, 12)] * 2
    assert {r.bases.replace("-", "") for r in out} == {"ACTTTTTCCCGT"}


def test_columns_that_lose_their_last_base_go(spark, tmp_path):
    path = tmp_path / "in.maf"
    path.write_text("##maf version=1 scoring=N/A\n\na\ns\tsimCow.chr1\t0\t6\t+\t100\tAC--GTAC--\ns\tsimDog.chr1\t0\t6\t+\t100\tAC--GTAC--\ns\tsimMouse.chr1\t0\t10\t+\t100\tACTTGTACGG\n\n")
    kept = rows.filter_rows(maf.read(spark, str(path)), ["simMouse"])
    assert [r.value for r in maf.text(norm.merge_blocks(kept)).collect()] == ["a\ns\tsimCow.chr1\t0\t6\t+\t100\tACGTAC\ns\tsimDog.chr1\t0\t6\t+\t100\tACGTAC\n"]


@pytest.mark.parametrize("rle", [False, True])
def test_both_formats_say_the_same(spark, tmp_path, rle):
    """Text to rows to the other text and back, with gaps, substitutions, inserts, deletes and a repeat of coordinates."""
    text = HEAD + "".join([
        "AAA ; i 0 r.c 0 + 90 i 1 x.c 5 + 80 i 2 y.c 9 - 70\n", "C-T\n", "GG ; d 2 g 1 2\n", "TTG ; i 2 z.c 1 + 60\n", "AA ; d 1 s 0 r.d 7 + 50\n", "CC ; G 1 TT\n", "A- ; s 0 r.d 9 + 50 s 1 z.c 5 + 60\n",
    ])
    aln, _ = both(spark, tmp_path, text)
    order = ["sequence_name", "start", "length", "strand", "sequence_length", "bases"]
    plain = lambda df: [tuple(r) for r in df.orderBy("block_id", "row_index").select(*order).collect()]
    assert plain(aln) == [
        ("r.c", 0, 2, True, 90, "AC"), ("x.c", 5, 1, True, 80, "A-"), ("y.c", 9, 2, False, 70, "AT"), ("r.c", 2, 1, True, 90, "G"), ("x.c", 8, 1, True, 80, "G"), ("r.c", 3, 1, True, 90, "T"), ("x.c", 9, 1, True, 80, "T"), ("z.c", 1, 1, True, 60, "G"),
        ("r.d", 7, 1, True, 50, "A"), ("z.c", 2, 1, True, 60, "A"), ("r.d", 8, 1, True, 50, "C"), ("z.c", 5, 1, True, 60, "C"), ("r.d", 9, 1, True, 50, "A"), ("z.c", 5, 0, True, 60, "-"),
    ]
    taf.write(aln, str(tmp_path / "again"), rle=rle, repeat=1)
    assert plain(taf.read(spark, str(tmp_path / "again"))) == plain(aln)
    maf.write(aln.drop("left_gap_sequence", "l_row_index"), str(tmp_path / "maf"))
    assert plain(maf.read(spark, str(tmp_path / "maf"))) == plain(aln)
