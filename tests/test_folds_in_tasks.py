"""Steps that work inside tasks: against plain versions, and without the joins and expansions that they replace."""

import random

import numpy as np

from blockloom import session
from blockloom.operators import coverage, links, masks, norm, plotstats
from blockloom.schema import ROWS
from blockloom.sources import taf

ALN = [
    (0, 0, "ref.c0", 0, 5, True, 50, "ACG-TN"),
    (0, 1, "a.c0", 0, 4, True, 50, "aC-TT-"),
    (0, 2, "a.c1", 9, 3, True, 50, "--GTA-"),
    (1, 0, "ref.c0", 5, 4, True, 50, "ACGT"),
    (1, 1, "a.c0", 4, 2, True, 50, "A--T"),
    (2, 0, "ref.c0", 30, 2, True, 50, "AC"),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_rows_take_no_join(spark):
    """the fold hands the bases on, so they aren't looked up again."""
    found = norm.merging(spark.createDataFrame(ALN, ROWS), norm.Policy(), shard=1).rows()
    body = plan(found.select("bases"))
    assert "SortMergeJoin" not in body and "ShuffledHashJoin" not in body
    assert sorted((r.block_id, r.row_index) for r in found.collect())[0] == (0, 0)


def test_small_lists_are_linked_as_by_the_aligner():
    """rows of small blocks are linked by patterns, and as before."""
    rng = random.Random(3)
    for _ in range(300):
        n, m = rng.randrange(1, 7), rng.randrange(1, 7)
        rows = [(rng.randrange(3), rng.randrange(2), x, x + 2) for x in (rng.randrange(9) for _ in range(n + m))]
        for substitutions in (True, False):
            expected = links.aligned(rows[:n], rows[n:], substitutions)
            here, to = links._small_links(np.array([0, n, n + m]), np.array([1]), tuple(np.array(c) for c in zip(*rows)), substitutions)
            assert here.tolist() == [*range(n, n + m)]
            assert [None if x < 0 else x for x in to.tolist()] == expected


def test_decoding_does_not_explode_lines(spark):
    """blocks of lines go to the decoder whole."""
    back = taf.decode(taf.text(spark.createDataFrame(ALN, ROWS)))
    assert "Generate posexplode" not in plan(back)
    assert sorted((r.block_id, r.row_index, r.bases) for r in back.collect()) == sorted((r[0], r[1], r[7]) for r in ALN)


def test_coverage_of_blocks_in_one_pass(spark):
    """blocks are folded without a window or expressions for each base."""
    made = coverage.block_coverage(spark.createDataFrame(ALN, ROWS))
    assert "Window" not in plan(made)
    found = {(r.block_id, r.genome): (r.aligned, r.identical, r.single_aligned, r.single_identical, r.first, r.last, r.inner) for r in made.collect()}
    assert found[0, "a"] == (4, 4, 0, 0, 0, 3, [])
    assert found[1, "a"] == (2, 2, 2, 2, 5, 8, [2])
    assert found[0, "ref"] == (4, 4, 4, 4, 0, 3, [])
    assert found[2, "ref"] == (2, 2, 2, 2, 30, 31, [])


def test_coverage_by_a_listed_reference(spark):
    made = {(r.block_id, r.genome): (r.contig, r.aligned) for r in coverage.block_coverage(spark.createDataFrame(ALN, ROWS), reference="a").collect()}
    assert made == {(0, "a"): ("a.c0", 4), (0, "ref"): ("a.c0", 3), (1, "a"): ("a.c0", 2), (1, "ref"): ("a.c0", 2)}


def test_bins_are_counted_once(spark):
    """the summary reads stored bins, and bins don't spell bases out in expressions."""
    aln = spark.createDataFrame(ALN, ROWS)
    made = plotstats.bins(aln, 3)
    assert "zip_with" not in plan(made)
    assert sorted(map(tuple, made.collect())) == [(0, "a", 3, 3), (1, "a", 3, 2), (2, "a", 1, 1)]
    assert "mapInArrow" not in plan(plotstats.bin_summary(made, 3)).replace("MapInArrow", "mapInArrow")


def test_lineage_is_masked_without_a_join(spark):
    """a block's rows are shuffled once."""
    made = masks.mask_lineage(spark.createDataFrame(ALN, ROWS), {"ref.": None, "a.": "ref."})
    assert "Join" not in plan(made)
    found = {(r.block_id, r.row_index): r.bases for r in made.collect()}
    assert found == {(0, 0): "ACG-TN", (0, 1): "**-T*-", (0, 2): "--*TA-", (1, 0): "ACGT", (1, 1): "*--*", (2, 0): "AC"}


def test_large_tables_are_dealt_into_more_tasks(spark, monkeypatch):
    """the rows that a task sorts don't grow with the table."""
    monkeypatch.setattr(session, "TASK", 10)
    assert session.dealt(spark.range(200), 200, "id").rdd.getNumPartitions() == 20
