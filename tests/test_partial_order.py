"""Partial-order alignment against all alignments with all paths."""

import functools
import random

import pytest

from blockloom.functions.partial_order import SCORES, Graph, code, gap_cost, partial_order
from blockloom.operators import norm
from blockloom.sources import maf


def pair_score(a, b):
    """The best score of two strings with any gaps, by trying all of them."""

    @functools.lru_cache(None)
    def best(i, j, last):
        """Of the rests from i and j, where ``last`` tells in which string the step before left a gap, so that gaps of one kind aren't split."""
        found = [0] if i == len(a) and j == len(b) else []
        if i < len(a) and j < len(b):
            found.append(SCORES[code(a[i])][code(b[j])] + best(i + 1, j + 1, ""))
        if last != "a":
            found += [best(i + n, j, "a") - gap_cost(n) for n in range(1, len(a) - i + 1)]
        if last != "b":
            found += [best(i, j + n, "b") - gap_cost(n) for n in range(1, len(b) - j + 1)]
        return max(found, default=-(10**9))

    return int(best(0, 0, ""))


def all_paths(graph):
    """Every string that the graph holds as a path."""

    def back(v):
        for p in graph.before[v]:
            for s in [""] if p < 0 else back(p):
                yield s + graph.base[v]

    return {s for v in graph.ends for s in back(v)}


@pytest.mark.parametrize("seed", range(40))
def test_each_string_is_aligned_best(seed):
    rng = random.Random(seed)
    letters = rng.choice(["AC", "ACGT", "ACGTN"])
    base = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))
    graph, made = Graph(), []
    for _ in range(4):
        s = "".join(c if rng.random() < 0.8 else rng.choice(letters) for c in base)
        at = rng.randrange(len(s) + 1)
        s = rng.choice([s, s[:at] + rng.choice(letters) * rng.randrange(1, 3) + s[at:], s[: at - 1] + s[at:]]) or "A"
        if made:
            assert graph.score(s) == max(pair_score(s, p) for p in all_paths(graph))
        made.append(s)
        graph.add(s)
        assert set(made) <= all_paths(graph)
        ranks = {c: k for k, c in enumerate(graph.columns())}
        assert len(ranks) == len(graph.members) and all(p < 0 or ranks[graph.column[p]] < ranks[graph.column[v]] for v, before in enumerate(graph.before) for p in before)
    rows = partial_order(made)
    assert len({*map(len, rows)}) == 1 and [r.replace("-", "") for r in rows] == made
    assert all(any(r[k] != "-" for r in rows) for k in range(len(rows[0])))


def test_gaps_of_two_pieces():
    assert gap_cost(1) == 430 and gap_cost(27) == 1210 and gap_cost(28) == 1228 and gap_cost(0) == 0
    rows = partial_order(["A" * 5 + "C" * 60 + "G" * 5, "A" * 5 + "G" * 5])
    assert rows[1] == "A" * 5 + "-" * 60 + "G" * 5  # one long gap
    assert pair_score("A" * 40 + "C", "C") == SCORES[1][1] - gap_cost(40)


def test_runs_of_one_base_are_what_the_graph_makes_of_them():
    for lengths in ([3, 1, 2], [1, 4], [5, 5, 2, 1]):
        strings = ["N" * n for n in lengths]
        graph, paths = Graph(), {}
        for i in sorted(range(len(strings)), key=lambda i: -lengths[i]):
            paths[i] = graph.add(strings[i])
        rank = {c: k for k, c in enumerate(graph.columns())}
        assert [[rank[c] for c in paths[i]] for i in range(len(strings))] == [[*range(max(lengths) - n, max(lengths))] for n in lengths]


DUPES = """##maf version=1

a
s\tAnc0.c\t0\t6\t+\t4151\tGTCAAG
s\tAnc2.c1\t5\t6\t+\t4655\tGTCAAG
s\tAnc2.c11\t5\t6\t+\t4655\tGTCAAG
s\tmr.c\t177\t6\t+\t18234\tGTCAAG
s\tcow.chr6\t45\t6\t-\t60261\tGTGAAG

a
s\tAnc0.c\t6\t1\t+\t4151\tA
s\tAnc2.c1\t11\t1\t+\t4655\tA
s\tAnc2.c11\t100\t1\t+\t4655\tG
s\tmr.c\t184\t1\t+\t18234\tA
s\tcow.chr6\t51\t1\t-\t60261\tT

"""


def test_a_copy_with_a_wide_gap_is_pruned(spark, tmp_path):
    path = tmp_path / "dupes.maf"
    path.write_text(DUPES)
    out = norm.merge_blocks(maf.read(spark, str(path)), norm.Policy(prune=True)).orderBy("row_index").collect()
    assert [(r.sequence_name, r.start, r.length, r.bases) for r in out] == [
        ("Anc0.c", 0, 7, "GTCAAG-A"),
        ("Anc2.c1", 5, 7, "GTCAAG-A"),
        ("Anc2.c11", 5, 6, "GTCAAG--"),
        ("cow.chr6", 45, 7, "GTGAAG-T"),
        ("mr.c", 177, 8, "GTCAAGNA"),
    ]
