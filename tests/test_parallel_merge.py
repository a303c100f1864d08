"""The speculative parallel fold against the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.functions.align import wavefront
from blockloom.operators import norm
from blockloom.schema import ROWS
from blockloom.sources import taf
from tests import sequential_fold

GAPPED = ROWS + ", left_gap_sequence string"


def random_blocks(seed, n=60):
    """Blocks whose rows come, go, jump and repeat; some columns are all gaps, ids have holes."""
    rng = random.Random(seed)
    names = ["ref.c0", "ref.c1", "a.c0", "a.c1", "b.c0", "b.c0", "c.c0"]
    at, blocks, block_id = {}, [], rng.randrange(5)
    for _ in range(n):
        chosen = [rng.choice(names[:2]) if rng.random() < 0.1 else "ref.c0", *rng.sample(names[2:], rng.randrange(0, 5))]
        width = rng.choice([3, 5, 8, 30])
        rows = []
        for k, name in enumerate(chosen):
            strand = rng.random() < 0.85
            bases = "".join(rng.choice("ACGT-") for _ in range(width))
            if rng.random() < 0.1:
                bases = "-" * width
            start = at.get((name, strand), 0) + rng.choice([0, 0, 0, 1, 2, 4, 12])
            length = len(bases.replace("-", ""))
            at[name, strand] = start + length
            gap = "".join(rng.choice("acgt") for _ in range(rng.choice([0, 1, 2, 4])))
            rows.append((block_id, k, name, start, length, strand, 10_000, bases, gap or None))
        blocks.append(rows)
        block_id += rng.choice([1, 1, 1, 2, 9])
    return blocks


POLICIES = [norm.Policy(most_block=20, most_gap=3), norm.Policy(most_block=20, most_gap=2, prune=True), norm.Policy(most_gap=50), norm.Policy(most_gap=4, least_shared=2, least_fraction=0.4), norm.Policy(most_block=6, most_gap=11, prune=True, aligner="star")]


@pytest.mark.parametrize("k", range(len(POLICIES)))
@pytest.mark.parametrize("shard", [4, 1000])
def test_parallel_fold_is_the_plain_one(spark, k, shard):
    policy, blocks = POLICIES[k], random_blocks(k)
    names = [c.split()[0] for c in GAPPED.split(", ")]
    merged = sequential_fold.fold([[dict(zip(names, r)) for r in b] for b in blocks], policy)
    expected = sorted((m.block_id, i, *(r[c] for c in names[2:8])) for m in merged for i, r in enumerate(m.rows))
    df = spark.createDataFrame([r for b in blocks for r in b], GAPPED).repartition(3)
    tags = spark.createDataFrame([(b[0][0], c, [{"key": "t", "value": f"{b[0][0]}:{c}"}]) for b in blocks for c in range(len(b[0][7]))], "block_id bigint, col bigint, tags array<struct<key: string, value: string>>")
    found = norm.merging(df, policy, shard)
    assert sorted(map(tuple, found.rows().collect())) == expected
    assert 1 < len(merged) < len(blocks)
    moved = sorted((m.block_id, begin + n, f"{part}:{c}") for m in merged for part, begin, numbers in m.parts for n, c in enumerate(numbers))
    assert sorted(found.tags(tags).select("block_id", "col", F.col("tags")[0]["value"]).collect()) == moved


def test_a_block_may_stay_open_over_many_shards(spark):
    """All blocks become one, and each shard's first run is wrong."""
    rows = [(b, k, name, 4 * b, 4, True, 1000, "ACGT", None) for b in range(40) for k, name in enumerate(["ref.c", "x.c"])]
    out = norm.merge_blocks(spark.createDataFrame(rows, GAPPED), norm.Policy(), shard=4).orderBy("row_index").collect()
    assert [(r.block_id, r.row_index, r.start, r.length, r.bases) for r in out] == [(0, k, 0, 160, "ACGT" * 40) for k in (0, 1)]
    assert norm.merge_blocks(spark.createDataFrame([], GAPPED)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_rows_without_a_partner_do_not_move_links(seed):
    rng = random.Random(seed)
    for _ in range(200):
        row = lambda i: norm.Row(rng.choice("abc") + ".x", rng.randrange(9), rng.randrange(3), rng.random() < 0.8, 99, (0, i))
        left, right = [row(i) for i in range(rng.randrange(9))], [row(i) for i in range(rng.randrange(7))]
        plain = [{"sequence_name": r.name, "start": r.start, "length": r.length, "strand": r.strand} for r in left + right]
        assert norm.links(left, right) == taf.link(plain[: len(left)], plain[len(left) :], substitutions=False)
    assert wavefront([], []) == []
