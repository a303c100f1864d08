"""Operators that work on whole blocks inside tasks, against plain versions; blocks lie across batches."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from blockloom.functions import scalars
from blockloom.operators import columns, paf
from blockloom.schema import ROWS


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def blocks(bases: str, uneven: bool = False) -> list[tuple]:
    random.seed(5)
    out = []
    for block in (0, 1, 5, 6, 9, 40):
        width = random.randint(1, 9)
        for i in range(random.randint(1, 8)):
            text = "".join(random.choice(bases) for _ in range(max(0, width - (uneven and random.randint(0, 2)))))
            out.append((block, i, f"s{i % 3}", 10 * block + i, len(text.replace("-", "")), random.random() < 0.6, 900, text))
    return out


def plain_pair(t: tuple, q: tuple, differences: bool) -> tuple:
    a, b = (x[7] if t[5] else x[7][::-1] for x in (t, q))
    wide = max(len(a), len(b))
    runs, n, matches = [], 0, 0
    for x, y in zip(a.ljust(wide, "-"), b.ljust(wide, "-")):
        if x == y == "-":
            continue
        e = "I" if x == "-" else "D" if y == "-" else "*" if differences and x != y else "M"
        n, matches = n + 1, matches + (e in "M*")
        if not runs or runs[-1][0] != e or e == "*":
            runs.append([e, "", 0])
        runs[-1][1] += x + y if e == "*" else x if e == "D" else y
        runs[-1][2] += 1
    text = "".join({"M": "=", "I": "+", "D": "-"}.get(e, e) + s if differences else f"{k}{e}" for e, s, k in runs)
    begin = lambda r: r[3] if r[5] else r[6] - r[3] - r[4]
    return (t[0], t[1], q[1], q[2], q[6], begin(q), begin(q) + q[4], "+" if q[5] == t[5] else "-", t[2], t[6], begin(t), begin(t) + t[4], matches, n, ("cs:Z:" if differences else "cg:Z:") + text)


@pytest.mark.parametrize("bases,uneven", [("ACGTN-", False), ("AC--", True), ("A-é😀", False)])
@pytest.mark.parametrize("all_to_all", [False, True])
@pytest.mark.parametrize("differences", [False, True])
def test_pairs_are_those_of_a_plain_loop(spark, small_batches, monkeypatch, bases, uneven, all_to_all, differences):
    monkeypatch.setattr(paf, "PAIRS", 4)
    table = blocks(bases, uneven)
    got = paf.pairs(spark.createDataFrame(table, ROWS), all_to_all, differences)
    want = [plain_pair(t, q, differences) for t in table for q in table if t[0] == q[0] and t[1] < q[1] and (all_to_all or t[1] == 0)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pairs_are_made_without_a_join(spark):
    plan = paf.pairs(spark.createDataFrame(blocks("AC-"), ROWS), True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_pairs_of_missing_bases_have_no_cigar(spark):
    rows = [(0, 0, "a", 0, 1, True, 9, "A"), (0, 1, "b", 0, 1, True, 9, None), (0, 2, "c", 0, 0, True, 9, "")]
    got = {r.query_row: (r.matches, r.block_length, r.cigar) for r in paf.pairs(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: (None, None, None), 2: (0, 1, "cg:Z:1D")}
    assert paf.pairs(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.parametrize("bases,uneven", [("ACGTN-", False), ("AC--", True), ("A-é😀", False)])
@pytest.mark.parametrize("cells", [5, 1 << 21])
def test_columns_are_those_of_a_plain_loop(spark, small_batches, monkeypatch, bases, uneven, cells):
    monkeypatch.setattr(columns, "CELLS", cells)
    table = [t for t in blocks(bases, uneven) if t[7] or t[1]]
    want, packed = [], []
    for block in sorted({t[0] for t in table if t[1] == 0}):
        rows = [t for t in table if t[0] == block]
        texts = [t[7] or " " for t in rows]  # a blank for the one column of an empty row
        of = ["".join(x[i] for x in texts if i < len(x)).replace(" ", "") for i in range(len(texts[0]))]
        ahead = [len(texts[0][:i].replace("-", "")) for i in range(len(texts[0]))]
        want += [(block, i, x, rows[0][3] + k, x[0]) for i, (x, k) in enumerate(zip(of, ahead))]
        packed.append((block, of, rows[0][3], [t[2] for t in rows], ahead))
    rows = spark.createDataFrame([t for t in table if t[0] in {p[0] for p in packed}], ROWS)
    assert sorted(map(tuple, columns.columns(rows).collect())) == want
    assert sorted(map(tuple, columns.columns(rows, names=True).drop("names").collect())) == want
    got = columns.packed_with_reference(rows).select("block_id", "columns", "ref_start", "names", "offsets")
    assert sorted(map(tuple, got.collect())) == packed


def test_columns_of_missing_rows(spark):
    rows = [(0, 0, "a", 0, 1, True, 9, None), (0, 1, "b", 0, 1, True, 9, "A"), (1, 0, "a", 3, 2, True, 9, "AC"), (1, 1, "b", 3, 2, True, 9, None), (2, 1, "b", 3, 2, True, 9, "G-")]
    got = sorted(map(tuple, columns.columns(spark.createDataFrame(rows, ROWS)).collect()))
    assert got == [(1, 0, "A", 3, "A"), (1, 1, "C", 4, "C"), (2, 0, "G", None, "G"), (2, 1, "-", None, "-")]
    assert columns.columns(spark.createDataFrame([], ROWS)).count() == 0


def test_columns_go_through_one_shuffle_and_no_collected_lists(spark):
    plan = columns.columns(spark.createDataFrame(blocks("AC-"), ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1


def test_codes_and_runs_are_those_of_each_base(spark):
    texts = ["ACGT-NacgtX", "AA--é😀😀ß1", "G", "\n\nA"]
    code = lambda c: "ACGT-".find(c.upper()) if c.upper() in [*"ACGT-"] else 5
    df = spark.createDataFrame([(t,) for t in texts], "b string")
    got = df.select("b", columns.codes(F.col("b")).alias("c"), columns.one_hots(F.col("b")).alias("h"), scalars.run_length(F.col("b")).alias("r")).collect()
    for r in got:
        assert r.c == [code(c) for c in r.b] and r.h == [[float(k == code(c)) for k in range(6)] for c in r.b]
        assert r.r == " ".join(f"{c} {len([*g])}" for c, g in groupby(r.b))
    plan = df.select(columns.codes(F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan  # no step of an interpreter for each base
