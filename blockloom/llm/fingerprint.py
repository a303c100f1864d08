"""Document fingerprints: canonical exact digest (native).

A text is brought to a canonical form (Unicode composition, case folding, ASCII
white space folded to single blanks and trimmed), hashed by two xxhash64 with
different seeds into 128 bits, and documents with equal digests are compared
byte by byte.  Should different canonical texts ever share a digest, a SHA-256
of the canonical bytes is appended to theirs.

Defined cases: null text counts as empty; an empty text has the fingerprint of
the empty string; repeated rows have equal fingerprints; ties in ``doc_id`` are
ordered by text; the document after the last one is the first; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import shuffle_partitions, texts
from blockloom.session import keep

SALT = 16


def canonical(text: Column) -> Column:
    """NFC, full case folding, ASCII white space folded."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\x20\x09-\x0D]+", " "))


def digest(canon: Column) -> Column:
    """128 bits in hex: two xxhash64, the second with its own seed."""
    part = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit("wide"), canon)))


def collided(docs: DataFrame) -> DataFrame:
    """Digests whose bucket holds more than one canonical text, by comparing the bytes.

    ``docs`` has ``doc_id, text``.  Only buckets of two or more documents are looked at; the
    semi join is salted, and the comparison is a partial aggregation, so that a
    large group of copies sends one text per task.
    """
    hashed = docs.select("doc_id", "text", digest(canonical(F.col("text"))).alias("digest"))
    many = hashed.groupBy("digest").count().where("count > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")
    rows = hashed.withColumn("salt", salt).join(many, ["digest", "salt"], "left_semi")
    return (
        rows.select("digest", canonical(F.col("text")).alias("canon"))
        .groupBy("digest")
        .agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
        .where("least <> most")
        .select("digest", F.lit(True).alias("clash"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text`` in ascending ``doc_id``, the last row followed by the first.

    Rows are dealt into ranges of ``doc_id`` (boundaries from approximate
    percentiles); each range looks ahead inside itself, and the head of the next
    range serves its last row.
    """
    n = 4 * shuffle_partitions(docs.sparkSession)
    found = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("p")).first()
    cuts = sorted(set(found["p"] or []))
    part = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = docs.withColumn("part", F.coalesce(part, F.lit(-1)))
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    along = Window.orderBy("part")  # one row per range
    first = F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(along), first)["text"].alias("next_head"))
    inside = Window.partitionBy("part").orderBy("doc_id", "text")
    rows = rows.select("part", "doc_id", "text", F.lead("text").over(inside).alias("later"))
    return rows.join(heads, "part").select("doc_id", "text", F.coalesce("later", "next_head").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, canon, fingerprint``: the operator's general form."""
    docs = texts(docs)
    clash = collided(docs)
    canon = canonical(F.col("text"))
    rows = docs.withColumn("digest", digest(canon)).join(clash, "digest", "left")
    mark = F.when(F.col("clash"), F.concat(F.lit("-"), F.sha2(canon, 256))).otherwise("")
    return rows.select("doc_id", "text", canon.alias("canon"), F.concat("digest", mark).alias("fingerprint"))


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness (0 or 1: the digest is exact)."""
    docs = texts(docs)
    clash = keep(collided(docs), "clash")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 4 as int))"), F.expr("substring(next_text, 1, cast(length(text) div 4 as int))"))
    canon, canon_edited, canon_next = (canonical(F.col(c)) for c in ("text", "edited", "next_text"))
    same = lambda a, b: F.when(a == b, 1.0).otherwise(0.0)
    rows = (
        with_next(docs)
        .withColumn("edited", edited)
        .select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), canon.alias("a"), canon_edited.alias("b"), canon_next.alias("c"))
        .select("doc_id", "n_chars", "edited_sha256", digest(F.col("a")).alias("digest"), digest(F.col("b")).alias("edited_digest"), same(F.col("a"), F.col("b")).alias("near_edited"), same(F.col("a"), F.col("c")).alias("near_next"), F.sha2(F.col("a"), 256).alias("sha_a"), F.sha2(F.col("b"), 256).alias("sha_b"))
    )
    if clash.isEmpty():
        return rows.select("doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
    for d, sha, out in (("digest", "sha_a", "fingerprint"), ("edited_digest", "sha_b", "edited_fingerprint")):
        rows = rows.join(clash.withColumnRenamed("digest", d), d, "left").withColumn(out, F.concat(d, F.when(F.col("clash"), F.concat(F.lit("-"), sha)).otherwise(""))).drop("clash")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
