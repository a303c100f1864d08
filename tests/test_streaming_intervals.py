"""Streaming intervals against those of the whole file, over restarts."""

import random

from blockloom.operators import stats
from blockloom.sources import maf
from blockloom.streaming import intervals


def block(name, start, length):
    return f"a\ns\t{name}\t{start}\t{length}\t+\t100000\t{'A' * length}\n\n"


def test_intervals_go_on_after_a_restart(spark, tmp_path):
    rng, at, blocks = random.Random(3), {}, []
    for _ in range(90):
        name = rng.choice(["ref.a", "ref.b"])
        start = at.get(name, 0) + rng.choice([0, 0, 0, 6])
        blocks.append((name, start, rng.randrange(1, 9)))
        at[name] = start + blocks[-1][2]
    source = tmp_path / "in"
    source.mkdir()
    closing = "".join(block(n, 90_000, 1) for n in at)  # what shows that the last intervals have ended
    parts = [blocks[:30], blocks[30:37], blocks[37:], None]
    for k, part in enumerate(parts):
        text = closing if part is None else "".join(block(*b) for b in part)
        (source / f"{k}.maf").write_text("##maf version=1\n\n" + text)
        query = intervals.start(spark, str(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("sequence_name", "start", "end").collect()))
    ordered = sorted(blocks, key=lambda b: b[0])  # contigs one after the other, as in a file
    (tmp_path / "whole.maf").write_text("##maf version=1\n\n" + "".join(block(*b) for b in ordered))
    expected = sorted(map(tuple, stats.contiguous_intervals(maf.read(spark, str(tmp_path / "whole.maf"))).collect()))
    assert got == expected and len(got) > 10
