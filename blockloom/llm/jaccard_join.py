"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles.  Each run splits sets
recursively: at a node of the path tree a set follows those of its shingles
whose random value under that node is below ``BRANCH / size``, so that similar
sets follow a shared shingle together.  After ``DEPTH`` splits the sets of a
bucket are compared by brute force on small sketches; larger buckets are compared
in blocks.  ``RUNS`` repetitions bring the recall of a pair at the threshold over
0.99 (see ``recall``).  Candidate components are then verified exactly on whole
shingle sets, in blocks, where every pair is looked at once and only counts and
spanning links leave a task.

Documents of equal words are one text with a number of copies.

Defined cases: a null text is empty; a text without words links to nothing and is
a class of its own; a text of fewer than five words has one shingle, all of its
words; repeated rows count as copies; texts are found again by id and text together, so that rows that share an id, or have none, keep their own links; a class
whose documents have no ids has the null id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import WORD, mix, row_key, sliced, texts
from blockloom.llm.components import components, spanning_links
from blockloom.session import keep

WIDTH, THRESHOLD = 5, 0.8
RUNS, DEPTH, BRANCH = 12, 3, 1.5
BINS, SKETCH_LEAST = 128, 0.6
BUCKET_BLOCK, EXACT_BLOCK = 4096, 256
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def recall(threshold: float = THRESHOLD, runs: int = RUNS, depth: int = DEPTH, branch: float = BRANCH) -> float:
    """Probability that a pair at the threshold (one set inside the other, the worst case) meets in some bucket."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-branch * threshold * alive)
    return 1 - (1 - alive) ** runs


def shingles(text: str) -> tuple[np.ndarray, int]:
    """Sorted distinct shingle hashes of a text, and a hash of its words (0 without words)."""
    words = WORD.findall(text)
    if not words:
        return np.zeros(0, np.uint64), 0
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(w) - WIDTH + 1, 1)
    total = np.full(n, len(w) if len(w) < WIDTH else 0, np.uint64)
    for i in range(min(WIDTH, len(w))):
        total += w[i : i + n] * _ODD[i]
    content = xxhash.xxh3_64_intdigest(" ".join(words)) >> 1
    return np.unique(mix(total)), content or 1


def sketch(sh: np.ndarray) -> bytes:
    """One-permutation minima: 16 bits for each of ``BINS`` bins, all ones where a bin is empty."""
    h = mix(sh ^ np.uint64(0x5DEECE66D))
    out = np.full(BINS, 0xFFFF, np.uint16)
    np.minimum.at(out, (h % np.uint64(BINS)).astype(np.int64), np.minimum(h >> np.uint64(48), np.uint64(0xFFFE)).astype(np.uint16))
    return out.tobytes()


def paths(sh: np.ndarray, runs: int = RUNS, depth: int = DEPTH, branch: float = BRANCH) -> np.ndarray:
    """The leaves that a set reaches in all runs."""
    keys = mix(np.arange(1, runs + 1, dtype=np.uint64) * _ODD[0])
    limit = np.uint64(min(branch / len(sh), 1.0) * (2**64 - 1025))
    for _ in range(depth):
        if len(keys) == 0:
            break
        step = max(1, 2_000_000 // len(sh))
        found = []
        for at in range(0, len(keys), step):
            r = (sh[None, :] ^ keys[at : at + step, None]) * _ODD[1]
            found.append(mix(r[r <= limit]))
        keys = np.concatenate(found)
    return np.unique(keys)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, t, node, sketch, paths`` of ``doc_id, t, text``; ``node`` identifies the text's words (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2_000):
            node, sketches, found = [], [], []
            for text in b.column("text").to_pylist():
                sh, content = shingles(text)
                node.append(content or None)
                sketches.append(sketch(sh) if content else None)
                found.append(paths(sh).astype(np.int64) if content else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(node, pa.int64()), pa.array(sketches, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "t", "node", "sketch", "paths"])

    return docs.select("doc_id", "t", "text").mapInArrow(run, "doc_id bigint, t bigint, node bigint, sketch binary, paths array<bigint>")


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches (rows, broadcast) estimate a similarity of ``SKETCH_LEAST`` or more."""
    full = np.uint16(0xFFFF)
    same = ((a == b) & (a != full)).sum(axis=-1)
    either = ((a != full) | (b != full)).sum(axis=-1)
    return same >= SKETCH_LEAST * either


def streamed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``keys`` into whole groups; several groups may come together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        last = [b.column(k)[b.num_rows - 1].as_py() for k in keys]
        mask = np.ones(b.num_rows, bool)
        for k, v in zip(keys, last):
            mask &= b.column(k).to_numpy(zero_copy_only=False) == v
        start = int(mask.argmax())  # sorted: the last group is a suffix
        if start > 0:
            yield pa.Table.from_batches([*held, b.slice(0, start)])
            held = []
        elif held and [held[-1].column(k)[0].as_py() for k in keys] != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), t.num_rows)


def blocked(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Add block pairs ``i <= j``: groups of more than ``block`` rows are cut into blocks, and each pair of blocks is one group."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    return rows.withColumn("own", own).withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", size)


def candidates(nodes: DataFrame) -> DataFrame:
    """Links ``a, b`` between nodes (``node, sketch, paths``) that share a bucket and look alike."""
    rows = nodes.select("node", F.explode("paths").alias("path"))
    many = rows.groupBy("path").count().where("count > 1")
    rows = blocked(rows.join(many, "path"), "path", "count", BUCKET_BLOCK)
    rows = rows.join(nodes.select("node", "sketch"), "node")
    keys = ["path", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in streamed(batches, keys):
            cuts = group_starts(t, keys)
            node = t.column("node").to_numpy()
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, BINS)
            links: set[tuple[int, int]] = set()
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                if b - a > 1:
                    links.update((min(x), max(x)) for x in spanning_links(node[a:b], lambda i, s=sk[a:b]: alike(s[i], s)))
            if links:
                x, y = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    dealt = rows.select(*keys, "node", "sketch").repartition(*keys).sortWithinPartitions(*keys, "node")  # groups share their least node
    return dealt.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix of the pairs at ``THRESHOLD`` or more, by exact set sizes and intersections."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    names, column = np.unique(flat, return_inverse=True)
    shared = np.zeros((m, m))
    step = max(256, 8_000_000 // m)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, len(names), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        block = np.zeros((m, min(step, len(names) - at)), np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        shared += block @ block.T
    # in integers: intersection over union against the threshold in hundredths
    union = sizes[:, None] + sizes[None, :] - shared
    return 100 * shared >= round(100 * THRESHOLD) * union


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    m, seen, out = len(linked), np.zeros(len(linked), bool), []
    for root in range(m):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            out += [(i, int(j)) for j in new]
            todo += new.tolist()
    return out


def verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Exact links inside candidate components.

    ``members``: ``node, root, t`` (the key of a document that has the node's words), ``copies``, ``size`` (nodes in the component).
    Returns ``a, b, links``: spanning links with ``links`` null, and for each node ``a`` (``b`` null) the
    number of documents in other nodes that it links to.
    """
    rows = docs.join(members.where("size > 1"), "t").select("text", "node", "root", "copies", "size")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1_000):
            made = [shingles(t) for t in b.column("text").to_pylist()]
            ok = np.array([c == n for (_, c), n in zip(made, b.column("node").to_pylist())], bool)  # keys are hashes
            kept = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column("node"), kept.column("root"), kept.column("copies"), kept.column("size"), pa.array([s.tobytes() for (s, _), k in zip(made, ok) if k], pa.binary())], names=["node", "root", "copies", "size", "set"])

    made = blocked(rows.mapInArrow(sets, "node bigint, root bigint, copies bigint, size bigint, set binary"), "root", "size", EXACT_BLOCK)
    keys = ["root", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in streamed(batches, keys):
            cuts = group_starts(t, keys)
            node, own, copies = (t.column(c).to_numpy() for c in ("node", "own", "copies"))
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            out: list[tuple] = []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                _, first = np.unique(node[a:b], return_index=True)
                at = a + first
                linked = similar([np.frombuffer(t.column("set")[int(k)].as_py(), np.uint64) for k in at])
                np.fill_diagonal(linked, False)
                if i[a] != j[a]:
                    linked &= own[at][:, None] != own[at][None, :]
                weight = linked @ copies[at]
                out += [(int(node[at[x]]), None, int(weight[x])) for x in np.flatnonzero(weight)]
                out += [(int(node[at[x]]), int(node[at[y]]), None) for x, y in spanning(linked)]
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[k : k + 10_000])], names=["a", "b", "links"])

    dealt = made.select(*keys, "node", "own", "copies", "set").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(compare, "a bigint, b bigint, links bigint")


def classed(docs: DataFrame) -> DataFrame:
    """``doc_id, t`` (its ``row_key``), ``class_node, class_id, n_links`` for every document; ``class_node`` tells classes apart (null without words)."""
    docs = texts(docs).withColumn("t", row_key(F.col("doc_id"), F.col("text")))
    made = keep(features(docs), "features")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first")
    nodes = made.where("node is not null").groupBy("node").agg(first, F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    nodes = keep(nodes.select("node", "first.doc_id", "first.t", "copies", "sketch", "paths"), "nodes")
    roots = components(candidates(nodes))
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    members = roots.join(sizes, "root").join(nodes.select("node", "t", "copies"), "node")
    found = keep(verified(docs, members), "links")
    classes = components(found.where("b is not null").select("a", "b"))
    least = classes.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    info = nodes.select("node", "doc_id", "copies").join(classes.join(least, "root").select("node", "root", F.lit(True).alias("classed"), "class_id"), "node", "left").join(counts, "node", "left")
    info = info.select("node", F.coalesce("root", "node").alias("class_node"), F.when(F.col("classed"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    with_words = made.where("node is not null").select("doc_id", "t", "node").join(info, "node").select("doc_id", "t", "class_node", "class_id", "n_links")
    none = F.lit(None).cast("long")
    return with_words.unionByName(made.where("node is null").select("doc_id", "t", none.alias("class_node"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` for every document.

    ``class_id`` is the least id of the documents that are linked directly or
    through others; ``n_links`` counts the other documents whose similarity to this one is ``THRESHOLD`` or more.
    """
    return classed(docs).select("doc_id", "class_id", "n_links")


def representatives(docs: DataFrame) -> DataFrame:
    """``t``: the ``row_key`` of one document of each class, of the least id (null last), and of every document without words."""
    found = classed(docs)
    first = found.where("class_node is not null").groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first"))
    return first.select("first.t").union(found.where("class_node is null").select("t").distinct())
