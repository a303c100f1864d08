"""Quality rules at host level (native).

Each document is measured inside its own row by array functions, so nothing but
counts leaves a task.  Failures are added up by host, each host's rate is shrunk
by a beta prior whose two parameters are fitted to the hosts' rates by moments,
and the host's verdict is joined back to its documents:

* ``blocked`` (shrunk rate over ``block_rate``): no document is kept;
* ``strict`` (at least ``strict_rate``): a document that fails one rule goes;
* ``trusted``: a document that fails two rules goes.

Defined cases: a null text has no words and fails the base rules; a null host is
the host ``""``; a single host, or hosts of equal rates, take the weakest
informed prior (``least_strength``); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import WORD_PATTERN, bounded_broadcast
from blockloom.session import keep

BLOCK_RATE, STRICT_RATE, LEAST_STRENGTH, MOST_STRENGTH, BROADCAST_HOSTS = 0.8, 0.02, 2.0, 10_000.0, 10_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column) -> Column:
    """Number of words inside three-word windows that are found twice or more."""
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))

    def places(s: Column) -> Column:
        kept = F.transform(s, lambda x, k: F.when((x["t"] == F.get(s, k - 1)["t"]) | (x["t"] == F.get(s, k + 1)["t"]), x["i"]))
        return F.sort_array(F.filter(kept, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        widths = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.sort_array(windows), lambda s: let(places(s), covered))


def measures(text: Column) -> Column:
    """Struct of the base counts of one text."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), 1)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_PATTERN))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))


def document_rules(docs: DataFrame, host: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rule failures of each document, with its host and the columns ``carry``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), measures(text).alias("m"), *carry)
    rows = rows.select("doc_id", "host", *carry, "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_lines", "m.l.n_dup_lines", "m.w.n_repeat_words")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = [10 * F.col("n_symbols") > F.col("n_words"), 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))]
    failed = sum((r.cast("int") for r in rules), base.cast("int"))
    return rows.withColumn("base_failed", base).withColumn("n_failed", failed)


def host_rates(rows: DataFrame) -> DataFrame:
    """``host, n_docs, n_bad, host_rate``: rates of documents that fail any rule, shrunk by the fitted beta prior."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum((F.col("n_failed") > 0).cast("long")).alias("n_bad"))
    rate = F.col("n_bad") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    fitted = F.when((F.col("v") > 0) & (F.col("m") > 0) & (F.col("m") < 1), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(LEAST_STRENGTH))
    prior = moments.select("m", F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), fitted)).alias("strength"))
    # one row of moments beside every host
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_bad", ((F.col("n_bad") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))).alias("host_rate"))


def apply_rules(docs: DataFrame, host: str = "source", block_rate: float = BLOCK_RATE, strict_rate: float = STRICT_RATE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its counts, its host's shrunk rate and ``kept``, and the columns ``carry`` of ``docs``."""
    rows = keep(document_rules(docs, host, carry), "rules")
    hosts = bounded_broadcast(host_rates(rows).select("host", "host_rate"), BROADCAST_HOSTS)
    passes = (F.col("host_rate") <= block_rate) & F.when(F.col("host_rate") >= strict_rate, F.col("n_failed") == 0).otherwise(F.col("n_failed") < 2)
    return rows.join(hosts, "host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passes).alias("kept"), "host", "n_failed", F.round("host_rate", 9).alias("host_rate"), *carry
    )
