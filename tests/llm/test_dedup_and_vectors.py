"""Exact dedup, hard negatives and vector codes against brute force, and on awkward tables."""

import hashlib
import math
import os
import random
import re
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import grace_dedup, hard_negatives, vector_codes, vectors

DOCS = "doc_id bigint, text string, lang string, part bigint, row bigint, bucket int, keep_id string"


def brute_groups(rows):
    by = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        text = text or ""
        by[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id is None, doc_id, k))
    out = Counter()
    for text, members in by.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0, m[3]))
        for i, m in enumerate(members):
            out[(m[2], members[0][2], len(members), i == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def found_groups(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def awkward_texts():
    long = "long text " * 30_000
    texts = [None, "", " \n\t\x0b\x0c\r ", "a b", "ab", "a\x85b", "a\xa0b", "a b ", " ab", long, long.replace(" ", "\n"), long + "x", "Ünï 😀", "Ünï😀", "\x00", "aB"]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(None, "a b "), (None, "a b "), (3, "a b"), (3, "a b"), (7, "a b  "), (-5, "a b  "), (4, "other text of the same id"), (None, None)]


def test_exact_dedup_is_brute_force_on_awkward_rows(spark):
    rows = awkward_texts()
    df = spark.createDataFrame([(i, t, None, 1, 2, 3, "x") for i, t in rows], DOCS).repartition(3)
    assert found_groups(grace_dedup.dedup(df)) == brute_groups(rows)
    assert grace_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_dedup_spills_and_recurses(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot text", "hot  text", f"text {rng.randrange(400)}", f"text\t{rng.randrange(400)} ", str(k)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found_groups(grace_dedup.dedup(df, held=4_000)) == brute_groups(rows)  # about 20 entries in a table


def test_spill_files_fold_and_go(tmp_path, monkeypatch):
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    rng = random.Random(2)
    records = [(7 if k % 50 < 33 else k % 50, b"c%d" % (k % 50), [k], 1, (0, k, k)) for k in range(2000)]  # most contents share one hash
    rng.shuffle(records)
    got = {c: (sorted(p), n, best) for _, c, p, n, best in grace_dedup.settled(records, held=900)}
    assert got == {b"c%d" % i: (list(range(i, 2000, 50)), 40, (0, i, i)) for i in range(50)}
    assert os.listdir(tmp_path) == []


def test_table_compares_contents():
    table = grace_dedup.ContentTable(4)
    assert [table.place(5, c)[0] for c in (b"a", b"b", b"a", b"c")] == [0, 1, 0, 2]
    for k in range(1000):
        assert table.place(k, b"%d" % k) == (3 + k, True)
    assert all(table.place(k, b"%d" % k) == (3 + k, False) for k in range(1000)) and table.place(5, b"b") == (1, False)


VECTORS = "vec_id bigint, embedding array<float>, label int, row bigint, v string, anchor int"


def awkward_vectors(n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 16).astype(np.float32)], int(rng.integers(0, 4))) for k in range(n)]
    rows += [(200, None, 1), (201, [1.0, None] * 8, 1), (202, [math.nan] * 16, 1), (203, [math.inf] * 16, 2), (204, rows[0][1], None), (50, rows[50][1], rows[50][2]), (50, rows[7][1], 3), (None, rows[9][1], 0), (None, rows[9][1], 0), (250, [], 2), (251, [0.5, -0.25], 2), (-50, rows[3][1], 1), (300, [0.0] * 16, 1)]
    return rows + [rows[5], rows[5], rows[7], rows[14]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)


def whole(rows):
    return [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def last(i):
    return (i is None, i or 0)


def brute_negatives(rows):
    rows = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in whole(rows) if label is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for k, (i, v, label) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = sorted(((dot(v, w), j, other) for n, (j, w, other) in enumerate(rows) if n != k), key=lambda s: (-s[0], last(s[1])))
        for score, j, _ in [s for s in scored if s[2] == label][:5]:
            for rank, (negative, m, _) in enumerate([s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score][:3], 1):
                out[(i, j, rank, m, score, negative)] += 1
    return out


@pytest.mark.parametrize("block", [hard_negatives.BLOCK, 40])
def test_hard_negatives_are_brute_force(spark, block):
    rows = awkward_vectors()
    found = hard_negatives.mine(frame(spark, rows), block=block).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    expected = brute_negatives(rows)
    assert Counter(map(tuple, found.collect())) == expected and len(expected) > 20


def test_hard_negatives_of_odd_tables(spark):
    assert hard_negatives.mine(frame(spark, [])).count() == 0
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 1), (50, None, 1)])).count() == 0  # no anchor takes part
    ties = [(k, [1.0], k % 2) for k in range(51)] + [(k, [0.75], k % 2) for k in range(60, 70)]
    found = hard_negatives.mine(frame(spark, ties)).orderBy("anchor_id", "positive_id", "rank").collect()
    assert Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found) == brute_negatives(ties)
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(frame(spark, [(50, [1e9], 1), (1, [1e9], 1)])).count()


def test_best_keeps_the_first_of_equals():
    rng, best = np.random.default_rng(5), hard_negatives.Best(3, 4)
    seen = [[] for _ in range(3)]
    for _ in range(20):
        ids = np.sort(rng.integers(0, 1000, 9))
        scores = rng.integers(0, 6, (3, 9)).astype(float)
        for a in range(3):
            seen[a] += [(-s, i) for s, i in zip(scores[a], ids)]
        best.offer(np.arange(3), scores, ids)
    assert [[*zip((-best.scores[a]).tolist(), best.ids[a].tolist())] for a in range(3)] == [sorted(s)[:4] for s in seen]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = whole(rows)
    width = parts * max(1, -(-max(len(v) for _, v, _ in rows) // parts))
    rows = sorted(((i, v + [0] * (width - len(v)), label) for i, v, label in rows), key=lambda r: (last(r[0]), r[1]))
    cut = width // parts
    cuts = [[v[p * cut : (p + 1) * cut] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cuts[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        to = [[near(p, c[p])[1] for c in cuts] for p in range(parts)]
        for p in range(parts):
            for k in set(to[p]):
                mine = [c[p] for c, e in zip(cuts, to[p]) if e == k]
                books[p][k] = [sum(xs) // len(mine) for xs in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = [(i, label, [near(p, c[p]) for p in range(parts)]) for (i, _, label), c in zip(rows, cuts)]
    totals = Counter()
    for _, label, n in done:
        totals[label] += sum(d for d, _ in n)
    return Counter((i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), totals[label], sha) for i, label, n in done)


@pytest.mark.parametrize("n", [120, 5])
def test_vector_codes_are_brute_force(spark, n):
    rows = awkward_vectors(max(n, 60), 7) if n > 60 else [(k, [k / 7, -k / 3, 0.1], k % 2) for k in range(n)]
    found = vector_codes.compress(frame(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(map(tuple, found.collect())) == brute_codes(rows)


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.compress(frame(spark, [])).count() == 0
    assert vector_codes.compress(frame(spark, [(1, None, 1), (2, [math.nan], 1)])).count() == 0
    same = [(k, [0.5] * 16, None) for k in range(70)]  # all entries are equal: the least index
    assert Counter(map(tuple, vector_codes.compress(frame(spark, same)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == brute_codes(same)
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(frame(spark, [(1, [1e30], 1)])).count()


@pytest.mark.parametrize("seed", range(6))
def test_annuli_find_the_nearest(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-9, 10, (rng.integers(1, 65), 4)) * (1 if seed % 2 else 1000)
    x = rng.integers(-12, 13, (500, 4)) * (1 if seed % 2 else 1000)
    e, d = vector_codes.Annuli.of(entries).nearest(x)
    all_d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (e == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()


def test_scaled_vectors():
    a = pa.array([[0.1, -0.1], None, [None, 1.0], [], [math.nan], [1.0, 2.0, 3.0]], pa.list_(pa.float32()))
    for offset in (0, 1):
        good, x = vectors.scaled(a[offset:])
        assert (good + offset).tolist() == [0, 3, 5][offset:]
        assert x.tolist() == [[25, -26, 0], [0, 0, 0], [256, 512, 768]][offset:]
    assert vectors.matrix(vectors.column(x)).tolist() == x.tolist()


def test_spark_keeps_columns_apart(spark):
    """Extra columns with the operators' own names don't reach the results."""
    df = frame(spark, awkward_vectors()).withColumn("error", F.lit(1)).withColumn("code", F.lit("z")).withColumn("largest", F.lit(0))
    assert set(vector_codes.compress(df).columns) == {"vec_id", "code", "error", "label_error", "codebooks_sha256"}
    assert hard_negatives.mine(df).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
