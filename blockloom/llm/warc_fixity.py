"""Merkle fixity audit of WARC replicas.

Pages become WARC records, ordered by id inside files of ``FILE_IDS`` consecutive
ids, with their byte offsets.  A leaf is the SHA-256 of the record of one id; a
node covers a range of ``FANOUT`` children, ordered as the offsets are, up to one
root.  Two replicas are compared from the root down: a level is looked at only
below nodes that differ, until the damaged records are found.

Defined cases: null urls and bodies are empty; a null id is the id -1; several
records of one id make one leaf of their number and combined digests, so that
repeated rows, however many, stay one row; records that only one replica has are
``missing`` or ``extra``; an empty replica differs at the root; two empty
replicas give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.session import keep

FANOUT, FILE_IDS = 16, 4096


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The WARC response record of one page."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """``node, digest, length, n_records``: one leaf for each page id."""
    page_id = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    rows = pages.select(page_id.alias("node"), record(page_id, F.col("url"), F.col("html")).alias("r"))
    rows = rows.select("node", F.sha2("r", 256).alias("d"), F.octet_length("r").cast("long").alias("l"))
    word = F.conv(F.substring("d", 1, 15), 16, 10).cast("long")
    found = rows.groupBy("node").agg(F.count("*").alias("n_records"), F.sum("l").alias("length"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.bit_xor(word).alias("x"))
    several = F.sha2(F.concat_ws("|", F.col("n_records").cast("string"), F.col("lo"), F.col("hi"), F.col("x").cast("string"), F.col("length").cast("string")), 256)
    return found.select("node", F.when(F.col("n_records") == 1, F.col("lo")).otherwise(several).alias("digest"), "length", "n_records")


def parents(level: DataFrame) -> DataFrame:
    """The next level: each node digests its ordered children (``FANOUT`` at most)."""
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    text = F.array_join(F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"])), "\n")
    return level.groupBy(F.expr(f"cast(floor(node / {FANOUT}) as bigint)").alias("parent")).agg(F.sha2(text, 256).alias("digest")).select(F.col("parent").alias("node"), "digest")


def levels(leaf: DataFrame, height: int) -> list[DataFrame]:
    out = [leaf.select("node", "digest")]
    for _ in range(height):
        out.append(keep(parents(out[-1]), "level"))
    return out


def height_of(*tables: DataFrame) -> int:
    """Levels above the leaves until one node (or one on either side of 0) covers all ids."""
    ends = [t.agg(F.min("node").alias("a"), F.max("node").alias("b")).first() for t in tables]
    most, height = max([abs(x) + 1 for r in ends for x in r if x is not None], default=1), 1
    while FANOUT**height < most:
        height += 1
    return height


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """``node, ours, theirs`` of the leaves that differ, found by descending from the root."""

    def compare(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.select("node", F.col("digest").alias("ours")).join(y.select("node", F.col("digest").alias("theirs")), "node", "full")
        return both.where(~F.col("ours").eqNullSafe(F.col("theirs")))

    def below(level: DataFrame, bad: DataFrame) -> DataFrame:
        return level.withColumn("parent", F.expr(f"cast(floor(node / {FANOUT}) as bigint)")).join(bad.select(F.col("node").alias("parent")), "parent", "left_semi")

    bad = compare(a[-1], b[-1])
    return reduce(lambda bad, pair: keep(compare(below(pair[0], bad), below(pair[1], bad)), "differing"), reversed([*zip(a[:-1], b[:-1])]), bad)


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row for each record of either replica (``page_id, url, html``), with its place and ``status``.

    What a replica doesn't have is ``""``, 0, or the offset -1.
    """
    a, b = keep(leaves(ours), "leaves"), keep(leaves(theirs), "leaves")
    height = height_of(a, b)
    up, other = levels(a, height), levels(b, height)
    bad = differing(up, other)
    file_id = F.expr(f"cast(floor(node / {FILE_IDS}) as bigint)")
    along = Window.partitionBy("file_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = a.withColumn("file_id", file_id).withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)))
    ranges = up[1].select(F.col("node").alias("range_id"), F.col("digest").alias("range_digest"))
    rows = placed.join(bad.select("node", F.lit(True).alias("differs"), "theirs"), "node", "full").withColumn("range_id", F.expr(f"cast(floor(node / {FANOUT}) as bigint)")).join(ranges, "range_id", "left")
    status = F.when(F.col("differs").isNull(), "ok").when(F.col("digest").isNull(), "extra").when(F.col("theirs").isNull(), "missing").otherwise("corrupt")
    replica = F.when(F.col("differs").isNull(), F.col("digest")).otherwise(F.col("theirs"))
    return rows.select(F.col("node").alias("page_id"), F.coalesce("file_id", file_id).alias("file_id"), *(F.coalesce(c, F.lit(d)).cast("long").alias(c) for c, d in (("offset", -1), ("length", 0), ("n_records", 0))), *(F.coalesce(c, F.lit("")).alias(n) for c, n in ((F.col("digest"), "digest"), (replica, "replica_digest"), (F.col("range_digest"), "range_digest"))), status.alias("status"))


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with known damage: by the first two hex digits of the id's MD5, modulo 40, 3 loses the record, 4 and 5 change its body, 6 adds a record."""
    k = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2), 16, 10).cast("int") % 40
    body = F.coalesce(F.col("html"), F.lit(""))
    kept = pages.where(k.isNull() | (k != 3)).select("page_id", "url", F.when(k == 4, F.concat(F.lit("x"), body)).when(k == 5, F.reverse(body)).otherwise(F.col("html")).alias("html"))
    more = pages.where(k == 6).select((F.col("page_id") + 1_000_000_000).alias("page_id"), "url", "html")
    return kept.unionByName(more)
