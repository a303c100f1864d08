"""The text operators against brute force, and on awkward tables."""

import base64
import hashlib
import itertools
import json
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockloom.llm import blobs, boosting, bpe, cutting_stock, fingerprint, jaccard_join, language_model, line_dedup, lines, packing, quality_classifier, quality_rules, rank_queue, toxicity, warc_fixity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node bigint, y int, digest string"
WORDS = "the of and to in that it is was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + ("." if i % 11 == 10 else ""))
        out.append("\n" if i % 23 == 22 else " ")
    return "".join(out).strip()


def awkward():
    """Nulls in any column, empty and long texts, ties, repeated rows, odd characters."""
    long = prose(20_000, 1) + " " + "x" * 30_000
    base = prose(120, 2)
    near = base.replace(" the ", " a ", 1)
    texts = [None, "", "   \n\t ", long, base, base, near, prose(90, 3), "Ünïcödé  ﬁ Σίσυφος ́ é é \x1c\x85\xa0 😀 中文 <|endoftext|>", "one two", "idiot " + prose(80, 4), "a\nb\na\n\n b"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), None, None, None, None) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, base, None, None, None, 1.0, 2, 3, "x"), (7, "another text of the same id " + prose(60, 5), None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 10)) for i in range(12)] + [(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id bigint, quality int, toxic int")


PLAIN = [(r[0], r[1] or "") for r in awkward()]


def test_bitmap_is_a_priority_queue():
    rng, b, held = random.Random(1), rank_queue.Bitmap(300_000), set()
    for _ in range(3000):
        if rng.random() < 0.6:
            x = rng.randrange(300_000)
            held.add(x)
            b.add(x)
        else:
            least = min(held, default=-1)
            assert b.pop() == least
            held.discard(least)


def test_byte_bpe_is_tiktoken(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for i, t in PLAIN:
        ids = known.encode_ordinary(t)
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect())) == expected
    assert bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0
    small = bpe.ByteBPE(path, public_tokenizers.PATTERN, cache_entries=5)  # a full cache changes nothing
    for text, ids in zip([t for _, t in PLAIN], small.encode([t for _, t in PLAIN])):
        assert ids.tolist() == known.encode_ordinary(text)


@pytest.mark.parametrize("batch", [[" hello world"], [" "], ["", " ", " hello world", "hello world ", " a"]])
def test_byte_bpe_takes_a_leading_blank(batch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.ByteBPE(path, public_tokenizers.PATTERN)
    got = list(ours.encode(batch))
    assert [i.tolist() for i in got] == [known.encode_ordinary(t) for t in batch]
    assert [ours.decode(i).decode() for i in got] == batch


@pytest.mark.parametrize("text", ["  a  b\n\n c ", "aaaa aaaaaaa", "it's I'LL 'S 12345", "a\x1cb \x1f c", " \x85 x\xa0y", "\n \n", "tail \n", "a \t b\r\n", "ab" * 4000])
def test_both_tokenizers_on_white_space(text):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.byte_bpe(path, public_tokenizers.PATTERN)
    assert [i.tolist() for i in ours.encode([text])] == [known.encode_ordinary(text)]
    assert ours.decode(next(iter(ours.encode([text])))) == text.encode()
    words = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(words)
    assert [np.frombuffer(i, "<u4").tolist() for i in bpe.word_bpe(words).encode([text])] == [library.encode(text, add_special_tokens=False).ids]


def test_both_tokenizers_on_random_strings():
    rng = random.Random(5)
    parts = [" ", "  ", "\t", "\n", "\xa0", "\x85", "a", "It", "'s", "'LL", "12", ".", ",", "<|endoftext|>", "<|startoftext|>", "ñandú", "ÜBER", "ß", "日本", "e\u0301", "ﬁ", "İ", "🙂", "\x00", "...", "word", "Word,", "end."]
    batch = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(3000)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [i.tolist() for i in bpe.byte_bpe(path, public_tokenizers.PATTERN).encode(batch)] == [known.encode_ordinary(t) for t in batch]
    words = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(words)
    assert [np.frombuffer(i, "<u4").tolist() for i in bpe.word_bpe(words).encode(batch)] == [library.encode(t, add_special_tokens=False).ids for t in batch]


def test_a_cache_keeps_its_bound():
    cache = bpe.Cache(5)
    for n in (3, 12, 40):
        cache.learn([str(i) for i in range(n)], lambda keys: [k.encode() for k in keys])
        assert len(cache) <= 5 and [cache[str(i)] for i in range(n)] == [b"%d" % i for i in range(n)]


def test_packing_places_every_id_once(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = packing.pack(docs, path, keep_ids=True).collect()
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for i, t in {(i, t) for i, t in PLAIN if i not in (4, 7, None)}:
        parts = sorted((r.start, r.ids, r.doc_tokens) for r in found if r.doc_id == i)
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        assert [x for p in parts for x in p[1]] == ids and {p[2] for p in parts} == {len(ids)}
    assert sum(r.doc_tokens for r in found if r.start == 0) == sum(r.length for r in found)
    assert packing.pack(empty, path).count() == 0


def test_cutting_stock_is_tight():
    rng = np.random.default_rng(4)
    sizes = np.arange(1, 129)
    demand = rng.integers(0, 60, len(sizes))
    plan = cutting_stock.solve(sizes[demand > 0], demand[demand > 0], 128)
    assert (sum(n * p for p, n in plan) == demand[demand > 0]).all()
    assert all((p * sizes[demand > 0]).sum() <= 128 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.03 * (sizes * demand).sum() / 128 + 1
    prices = rng.random(6)
    value, pattern = cutting_stock.best_pattern(prices, np.array([3, 4, 5, 7, 9, 11]), 20)
    brute = max(sum(p * c for p, c in zip(prices, (a, b, c, d, e, f))) for a in range(7) for b in range(6) for c in range(5) for d in range(3) for e in range(3) for f in range(2) if 3 * a + 4 * b + 5 * c + 7 * d + 9 * e + 11 * f <= 20)
    assert value == pytest.approx(brute) and prices @ pattern == pytest.approx(brute)


def test_fingerprints(spark, docs, empty):
    import unicodedata

    def digest(t):
        c = re.sub("[\x20\x09-\x0d]+", " ", unicodedata.normalize("NFC", t).casefold()).strip(" ").encode()
        first = xxhash.xxh64_intdigest(c, seed=42)
        second = xxhash.xxh64_intdigest(c, seed=xxhash.xxh64_intdigest(b"wide", seed=42))
        return f"{first:016x}{second:016x}"

    rows = sorted(((-1 if i is None else i), t) for i, t in PLAIN if i is not None)
    some = docs.where("doc_id is not null")
    expected = Counter()
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        expected[i, len(t), hashlib.sha256(e.encode()).hexdigest(), digest(t), digest(e), float(digest(t) == digest(e)), float(digest(t) == digest(n))] += 1
    got = fingerprint.edited_report(some).collect()
    assert Counter(tuple(r) for r in got) == expected
    assert fingerprint.edited_report(docs).count() == len(PLAIN) and fingerprint.edited_report(empty).count() == 0
    assert fingerprint.fingerprints(docs).select("doc_id", "fingerprint").where("doc_id = 4").distinct().count() == 1
    spoilt = docs.limit(0)
    assert fingerprint.collided(fingerprint.texts(spoilt)).count() == 0 and fingerprint.collided(fingerprint.texts(docs)).count() == 0


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", t)


def test_quality_rules_counts(spark, docs, empty):
    expected = Counter()
    for i, t in PLAIN:
        w = words_of(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(tri)
        repeated = len({k + d for k, x in enumerate(tri) if times[x] > 1 for d in range(3)})
        lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        expected[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated, failed] += 1
    got = quality_rules.apply_rules(docs)
    assert Counter(tuple(r)[:7] for r in got.collect()) == expected
    assert got.where("base_failed and kept").count() == 0
    assert quality_rules.apply_rules(empty).count() == 0


def test_hosts_are_shrunk_and_blocked(spark):
    rows = [(i, prose(100, i), "en", "good", 0) for i in range(40)] + [(100 + i, "bad", "en", "bad", 0) for i in range(60)] + [(200 + i, prose(100, 500 + i), "en", "bad", 0) for i in range(2)] + [(300, "bad", "en", "tiny", 0)]
    out = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert all(out[i].kept for i in range(40)) and not any(out[i].kept for i in range(100, 300) if i in out)
    assert out[300].host_rate < 1 and out[0].host_rate > 0 and out[100].host_rate > 0.8


def test_classifiers_on_awkward_tables(docs, empty, labels):
    for scored, k, r in ((toxicity.score(docs, labels), 5, 0), (quality_classifier.score(docs, labels), 4, 2)):
        got = scored.collect()
        assert len(got) == len(PLAIN) and all(0 <= x.score <= 1 for x in got)
        assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % k == r) for x in got if x.doc_id is not None)
    for f in (toxicity.score, quality_classifier.score):
        assert f(empty, labels).count() == 0
        assert f(docs, labels.limit(0)).count() == len(PLAIN)


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(3)
    docs, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        docs.append([*(rng.integers(100, 130, 5).tolist()), *([1] if a else []), *([2] if b else [])])
        docs[-1] = sorted(set(docs[-1]))
        y.append(float(a and b))
    m = toxicity.fit(docs[:1200], np.array(y[:1200]), epochs=300)
    assert ((m.score(docs[1200:]) >= 0.5) == (np.array(y[1200:]) == 1)).mean() > 0.97


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        t = prose(rng.randint(60, 200), i)
        if bad:
            t = " ".join(w + "***" for w in t.split())
        if toxic:
            t += " you worthless scum " + rng.choice(WORDS)
        rows.append((i, t, "en", "s", len(t)))
        marks.append((i, int(not bad), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    m = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    for scored, label in ((toxicity.score(d, m), "toxic"), (quality_classifier.score(d, m), "quality")):
        held = scored.where("held_out").join(m, "doc_id").select((F.col("predicted") == F.col(label)).alias("ok"))
        n, ok = held.agg(F.count("*"), F.sum(F.col("ok").cast("int"))).first()
        assert n > 50 and ok / n > 0.95


def test_forest_fits_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = boosting.fit(x[:1500], y[:1500])
    assert ((f.score(x[1500:]) > 0.5) == (y[1500:] == 1)).mean() > 0.95
    assert boosting.fit(x[:5], np.ones(5)).score(x[:2]).tolist() == pytest.approx([11 / 12] * 2)


def brute_lines(rows):
    """Removed lines by comparing all pairs of lines; ``rows`` are (id, rank of the text among those of its id, text)."""
    places = sorted({(i is None, i or 0, r, k, tuple(x.split())) for i, r, t in rows for k, x in enumerate((t or "").split("\n")) if x.split()})
    lines = sorted({p[-1] for p in places}, key=len)
    up = {w: w for w in lines}

    def top(w):
        while up[w] != w:
            w = up[w]
        return w

    for k, a in enumerate(lines):
        most = len(a) * 2 // 10  # a similarity of 0.8
        for b in lines[k + 1 :]:
            if len(b) - len(a) <= most and most and edit(a, b) <= most:
                up[top(b)] = top(a)
    first = {}
    for *place, w in places:
        first[top(w)] = min(first.get(top(w), tuple(place)), tuple(place))
    return {tuple(place): first[top(w)] for *place, w in places if first[top(w)] != tuple(place)}


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(4000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        most = rng.randint(1, 4)
        assert line_dedup.distance(a, b, most) == min(edit(a, b), most + 1)


def test_parsed_lines(docs):
    rows = [t for _, t in PLAIN] + ["", "a\nb c\n\nd", "\n", "x\u00a0y z"]
    got = lines.parse(pa.array(rows, pa.string()).slice(1))
    expected = [(r, k, len(x.split())) for r, t in enumerate(rows[1:]) for k, x in enumerate(t.encode().split(b"\n")) if x.split()]
    assert list(zip(got.row.tolist(), got.number.tolist(), got.n.tolist())) == expected
    words = [w for t in rows[1:] for w in t.encode().split()]
    assert len(set(zip(words, got.words.tolist()))) == len(set(words)) == len(set(got.words.tolist()))
    assert len(lines.parse(pa.array([], pa.string())).n) == 0 and len(lines.parse(pa.array([None, ""], pa.string())).n) == 0


@pytest.mark.parametrize("block", [4096, 4])
def test_line_dedup_is_brute_force(spark, empty, block, monkeypatch):
    """Lines of 1 to 220 words, ids that repeat with other texts, null ids, repeated rows."""
    monkeypatch.setattr(line_dedup, "BUCKET_BLOCK", block)
    rng, rows = random.Random(6), []
    stock = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in [*range(1, 31), 5, 9, 14, 15, 16, 45, 80, 220]]
    for i in range(60):
        of = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(stock).split()
            for _ in range(rng.choice([0, 0, 1, 2, 3, len(w) // 5])):
                k = rng.randrange(len(w) or 1)
                w[k : k + rng.randint(0, 1)] = [rng.choice(WORDS)] * rng.randint(0, 1)
            of.append(" ".join(w))
        rows.append((None if i % 20 == 7 else i // 2 if i % 5 == 0 else i, "\n".join(of)))
    rows += [rows[3], rows[3], (70, None), (None, "")]
    d = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    rank = {(r.doc_id, r.text): r.t for r in d.select("doc_id", "text", line_dedup.row_key(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    expected = brute_lines([(i, rank[i, t], t) for i, t in rows])
    report = line_dedup.removals(d).collect()
    got = {(r.doc_id is None, r.doc_id or 0, r.t, x.line_no): (x.first_doc_id, x.first_line_no) for r in report for x in r.removed}
    assert got == {k: (None if f[0] else f[1], f[3]) for k, f in expected.items()} and len(expected) > 60
    assert len(report) == len(rows)
    kept = lambda i, t: t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i is None, i or 0, rank[i, t], k) not in expected)
    cleaned = line_dedup.clean(d).collect()
    assert Counter((r.doc_id, r.text) for r in cleaned) == Counter((i, kept(i, t)) for i, t in rows)
    assert all(r.n_chars == len(r.text or "") for r in cleaned)


def test_line_dedup_links_long_lines_at_four_fifths(spark):
    rng, rows, linked = random.Random(12), [], {}
    for k, n in enumerate([14, 15, 16, 17, 19, 20, 40, 63, 64, 100, 250, 700]):
        line = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(n)]
        most = n * 2 // 10  # a similarity of 0.8
        for j, edits in enumerate([most, min(3, most), most + 1]):
            new = list(line)
            for x in rng.sample(range(n), edits):
                new[x] = f"new{j}"
            rows += [(1000 * k + 10 * j, " ".join(line)), (1000 * k + 10 * j + 1, " ".join(new))]
            assert edit(line, new) == edits
            linked[1000 * k + 10 * j + 1] = edits <= most
        longer = line + ["more"] * (n // 5)
        rows.append((1000 * k + 31, " ".join(longer)))
        linked[1000 * k + 31] = True
    got = {r.doc_id: r.n_removed for r in line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    # the copy with one edit too many may still be linked through another copy
    pairs = {i: t.split() for i, t in rows}
    for i, yes in linked.items():
        if not yes:
            yes = any(edit(pairs[i], w) <= min(len(pairs[i]), len(w)) * 2 // 10 for j, w in pairs.items() if j != i and j // 1000 == i // 1000)
        assert got[i] == yes, (i, len(pairs[i]))


def test_banded_distance_with_wide_bands():
    rng = random.Random(13)
    for _ in range(60):
        a = [rng.choice(WORDS[:20]) for _ in range(rng.randint(15, 120))]
        b = list(a)
        for _ in range(rng.randint(0, 25)):
            k = rng.randrange(len(b))
            b[k : k + rng.randint(0, 1)] = [rng.choice(WORDS)] * rng.randint(0, 1)
        most = min(len(a), len(b)) // 5
        assert line_dedup.distance(a, b, most) == min(edit(a, b), most + 1)


def test_line_dedup_on_awkward_tables(docs, empty):
    assert line_dedup.report(docs).count() >= len({i for i, _ in PLAIN})
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert line_dedup.report(empty).count() == 0 and line_dedup.clean(empty).count() == 0


def brute_links(rows):
    sets = {k: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for k, (_, t) in enumerate(rows) if (w := words_of(t))}
    linked = {k: set() for k in range(len(rows))}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                linked[a].add(b)
                linked[b].add(a)
    return linked


def test_jaccard_join_is_brute_force(spark, empty):
    rng, rows = random.Random(9), []
    for g in range(12):
        base = [rng.choice(WORDS) + str(g) for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), ""), (len(rows) + 1, "one two"), (len(rows) + 2, "one two")]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    linked = brute_links(rows)
    root = {}
    for k in range(len(rows)):
        todo, seen = [k], {k}
        while todo:
            for x in linked[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        root[k] = min(seen)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(d).collect()}
    assert got == {k: (root[k], len(linked[k])) for k in range(len(rows))}
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.recall() > 0.99


def test_jaccard_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "EXACT_BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 4)
    base = prose(100, 77).split()
    rows = []
    for i in range(30):
        w = list(base)
        w[i * 3] = f"w{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    linked = brute_links(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(d).collect()} == {k: (0, len(linked[k])) for k in range(30)}


def test_jaccard_join_on_awkward_tables(docs):
    got = jaccard_join.join(docs).collect()
    assert len(got) == len(PLAIN)
    assert {r.class_id for r in got if r.doc_id in (4, 5, 6)} == {4}


def test_language_model(spark, docs, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, words_of(t.translate(low)) + [None]) for i, t in PLAIN]
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(x for i, t in toks if not held(i) for x in t)
    n, v = sum(c.values()), len(c)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in language_model.score(docs, head=50).collect())
    assert got == sorted((-1 if i is None else i, len(t), sum(c[x] > 0 for x in t), round(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6)) for i, t in toks)
    assert language_model.score(empty).count() == 0


def test_every_training_round_sees_all_training_documents(spark, monkeypatch):
    rows = [(i, prose(1_500, i)) for i in range(12)]
    training = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    seen, sums, real, driver = [], language_model.sums_of_counts, language_model.expected, os.getpid()

    def counted(docs, model):
        got = sums(docs, model)
        seen.append(got[2].sum())
        return got

    def on_workers(*args):
        assert os.getpid() != driver, "trained on the driver"
        return real(*args)

    monkeypatch.setattr(language_model, "sums_of_counts", counted)
    monkeypatch.setattr(language_model, "expected", on_workers)
    assert language_model.score(spark.createDataFrame(rows, "doc_id bigint, text string"), head=50, tolerance=-1e9).count() == len(rows)
    assert seen == [pytest.approx(sum(len(words_of(t)) + 1 for t in training))] * 14


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    m = language_model.Model({}, norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    sequences = [rng.integers(0, 5, k).astype(np.int32) for k in (1, 4, 3, 6)]
    for part, steps, lengths in language_model.grouped(sequences):
        for i, ll in zip(part, language_model.likelihood(m, steps, lengths)):
            s, total = sequences[i], 0.0
            for z in itertools.product(range(3), repeat=len(s)):
                p = m.start[z[0]] * m.emit[s[0], z[0]]
                for t in range(1, len(s)):
                    p *= m.move[z[t - 1], z[t]] * m.emit[s[t], z[t]]
                total += p
            assert ll == pytest.approx(np.log(total))
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in sequences:  # expected counts by all paths
        total, parts = 0.0, (np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)))
        for z in itertools.product(range(3), repeat=len(s)):
            p = m.start[z[0]] * m.emit[s[0], z[0]]
            for t in range(1, len(s)):
                p *= m.move[z[t - 1], z[t]] * m.emit[s[t], z[t]]
            total += p
            parts[0][z[0]] += p
            for t in range(len(s)):
                parts[2][s[t], z[t]] += p
                if t:
                    parts[1][z[t - 1], z[t]] += p
        for whole, part in zip((start, move, emit), parts):
            whole += part / total
    for whole, got in zip((start, move, emit), language_model.expected(m, sequences)[:3]):
        assert np.allclose(whole, got, rtol=1e-4)
    for chunk in (1, 2, 3, 4, 100):  # chunks of a long sequence change nothing
        for whole, got in zip((start, move, emit), language_model.expected(m, sequences, chunk, np.float64)[:3]):
            assert np.allclose(whole, got)
        for part, steps, lengths in language_model.grouped(sequences):
            assert np.allclose(language_model.likelihood(m, steps, lengths, chunk), language_model.likelihood(m, steps, lengths))


@pytest.mark.parametrize("head", [20, 10_000])
def test_language_model_score_is_the_models_probability(spark, monkeypatch, head):
    """The score by a plain recursion over the trained model, with and without tail classes, and its gain on texts held out."""
    rng, rows = random.Random(8), []
    topics = [WORDS[:30], WORDS[30:60], WORDS[60:90]]
    for i in range(120):
        rows.append((i, " ".join(rng.choice(topics[i % 3]) + (f"{rng.randrange(40)}x" if rng.random() < 0.05 else "") for _ in range(rng.randint(5, 60)))))
    models, real = [], language_model.maximised
    monkeypatch.setattr(language_model, "maximised", lambda *a: models.append(real(*a)) or models[-1])
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), states=3, head=head, rounds=6).collect()}
    m = models[-1]
    counts = Counter(w for i, t in rows if not got[i].held_out for w in [*language_model.tokens(t), b""])
    n_head, size, kinds = len(m.symbol_of), Counter(), Counter()
    for w, c in counts.items():
        if w not in m.symbol_of:
            size[language_model.shape(w)] += c
            kinds[language_model.shape(w)] += 1
    assert (head == 10_000) == (not size)
    for i, t in rows:
        total, a = 0.0, None
        for w in [*language_model.tokens(t), b""]:
            if w in m.symbol_of:
                s = m.symbol_of[w]
            else:
                k = language_model.shape(w)
                s = n_head + k
                total += np.log10((counts[w] + 0.5) / (size[k] + 0.5 * (kinds[k] + 1)))
            a = (m.start if a is None else a @ m.move) * m.emit[s]
            total += np.log10(a.sum())
            a = a / a.sum()
        assert got[i].score == pytest.approx(total, abs=1e-6)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 20


def test_blobs_fold_in_pieces(monkeypatch):
    """A bucket that outgrows its bound is folded on the way; the keys met are the same."""
    rng = np.random.default_rng(3)
    r = np.zeros(6000, line_dedup.KEYED)
    r["k"], r["node"] = rng.integers(0, 900, 6000) * rng.integers(1, 1 << 50), rng.integers(0, 40, 6000)
    r["k"][:2500], r["node"][:2500] = 7 << 40, rng.integers(0, 2000, 2500)
    r["k"] &= ~1
    expected = {}
    for k, node in r.tolist():
        expected.setdefault(k >> 1, set()).add(node)
    expected = {(k, x) for k, xs in expected.items() if len(xs) > 1 for x in xs}
    for buckets, most in ((1, 1 << 20), (5, 1 << 20), (5, 1000), (1, 500)):
        monkeypatch.setattr(blobs, "BUCKET_BYTES", most)
        sent = sorted((x for at in range(0, 6000, 700) for x in zip(*blobs.packed(r[at : at + 700], r["k"][at : at + 700], buckets).to_pydict().values())), key=lambda x: x[0])
        batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in sent], pa.int32()), pa.array([x for _, x in sent], pa.binary())], names=["bucket", "blob"])
        got = [(k >> 1, x) for out in blobs.folded(iter([batch]), line_dedup.KEYED, line_dedup.met) for k, x in out.tolist()]
        assert set(got) == expected


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    sequences = [np.repeat(rng.integers(0, 2), 40) * 5 + rng.integers(0, 5, 40) for _ in range(60)]
    sequences = [s.astype(np.int32) for s in sequences]
    unigram = np.full(10, 0.1)
    m = language_model.initial({}, unigram, 2)
    seen = []
    for _ in range(12):
        seen.append(sum(language_model.likelihood(m, s, n).sum() for _, s, n in language_model.grouped(sequences)))
        m = language_model.maximised({}, *language_model.expected(m, sequences)[:3], unigram)
    assert seen[-1] > seen[0] + 500


def test_fixity_audit(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(700)] + [(None, None, None), (5, "http://h/5", "<p>5</p>"), (9, "again", "x")], "page_id bigint, url string, html string")
    assert warc_fixity.audit(pages, pages).where("status <> 'ok'").count() == 0
    other = pages.where("page_id is null or page_id <> 77").withColumn("html", F.when(F.col("page_id") == 300, "rot").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(5000, "u", "h")], "page_id bigint, url string, html string"))
    out = warc_fixity.audit(pages, other)
    assert {(r.page_id, r.status) for r in out.where("status <> 'ok'").collect()} == {(77, "missing"), (300, "corrupt"), (5000, "extra")}
    assert out.count() == 702
    one = out.where("page_id = 301").first()
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:301>\r\nWARC-Target-URI: http://h/301\r\nContent-Length: 10\r\n\r\n<p>301</p>\r\n\r\n"
    assert one.digest == hashlib.sha256(record).hexdigest() and one.length == len(record)
    assert warc_fixity.audit(pages.limit(0), pages.limit(0)).count() == 0
    assert warc_fixity.audit(pages, pages.limit(0)).where("status = 'missing'").count() == 701


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    rows, marks = [], []
    for i in range(120):
        t = prose(150, i) if i % 10 else "bad text"
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        marks.append((i, int(i % 10 > 0), 0))
    near = rows[1][1].split(" ")
    near[20] = near[70] = "changed"
    rows += [(200, rows[3][1], "en", "s1", 0), (201, " ".join(near), "en", "s1", 0), (202, None, None, None, None)]
    rng.shuffle(rows)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    ids = {r.doc_id for r in out}
    assert ids >= {i for i in range(120) if i % 10} and not ids & {0, 10, 20, 200, 202}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "line dedup", "n-gram Jaccard join", "packing"]
    empty = tmp_path / "none"
    spark.createDataFrame([], schema).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_training_stays_finite_on_texts_that_alternate(seed):
    """Six vocabularies that never mix, but for one text that alternates between two of them, and the counts of a large corpus."""
    rng = np.random.default_rng(seed)
    sequences = [np.append(rng.integers(0, 20, 40) + 20 * (k % 6), 120).astype(np.int32) for k in range(300)]
    sequences.append(np.append(np.tile([3, 27], 60), 120).astype(np.int32))
    unigram = np.bincount(np.concatenate(sequences), minlength=121) + 0.5
    unigram /= unigram.sum()
    for scale in (1, 1e4, 1e8):
        m = language_model.initial({}, unigram, 6, seed)
        for _ in range(14):
            start, move, emit, total = language_model.expected(m, sequences)
            assert np.isfinite(total) and np.isclose(emit.sum(), sum(map(len, sequences)))
            m = language_model.maximised({}, start * scale, move * scale, emit * scale, unigram)
        plain = [sum(language_model.likelihood(m, s, n).sum() for _, s, n in language_model.grouped([x])) for x in sequences[-2:]]
        assert np.isfinite(plain).all()


def test_counts_that_are_not_finite_are_an_error():
    m = language_model.initial({}, np.full(3, 1 / 3), 2)
    m.move[:] = np.nan
    with pytest.raises(FloatingPointError):
        language_model.expected(m, [np.array([0, 1, 2], np.int32)])
