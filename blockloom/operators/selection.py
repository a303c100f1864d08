"""Exact medians by distributed selection: bounded counts of value ranges, never the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.session import keep

BINS = 512


def medians(rows: DataFrame, by: list[str], value: str, bins: int = BINS) -> DataFrame:
    """``by`` and ``median`` of ``value`` (nulls don't count; the mean of the middle two of an even number) for each group that has one.

    A group's range is cut into ``bins`` bins, of which each pass keeps a count, the least and the greatest value.  The bin that holds the middle is cut again,
    until it holds one value or the middle lies at its ends; a group is settled after a few passes, of which each sends ``bins`` records a group and task at most.
    """
    data = keep(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")), "values")
    state = data.groupBy(*by).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("n"))
    state = keep(state.select(*by, "lo", "hi", F.lit(0).cast("long").alias("below"), F.floor((F.col("n") - 1) / 2).alias("a"), F.floor(F.col("n") / 2).alias("b"), F.lit(None).cast("double").alias("va"), F.lit(None).cast("double").alias("vb")), "selection")
    done = state.limit(0)
    while True:
        settled = (F.col("lo") == F.col("hi")) | (F.col("va").isNotNull() & F.col("vb").isNotNull())
        ended = state.where(settled)
        state = state.where(~settled)
        done = done.unionByName(ended)
        if not state.limit(1).count():
            break
        names = [f"__{c}" for c in by]
        open_ = state.select(*(F.col(c).alias(n) for c, n in zip(by, names)), "lo", "hi")
        met = data.join(open_, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)]).where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        at = F.least(F.floor((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))  # halves can't overflow
        counts = met.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        up_to = F.sum("c").over(Window.partitionBy(*by).orderBy("bin"))  # bins records a group
        counts = counts.withColumn("end", up_to).withColumn("begin", F.col("end") - F.col("c"))
        both = counts.join(state.select(*(F.col(c).alias(n) for c, n in zip(by, names)), "below", "a", "b", "va", "vb"), [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)])
        low, high = F.col("a") - F.col("below"), F.col("b") - F.col("below")
        holds = lambda k: (F.col("begin") <= k) & (k < F.col("end"))
        # the middle two may lie in two bins: then they are their ends
        ends = lambda k: F.when(k == F.col("begin"), F.col("least")).when(k == F.col("end") - 1, F.col("most"))
        picked = both.where(holds(low) | holds(high)).groupBy(*by).agg(
            F.max(F.when(holds(low), F.struct("least", "most", "begin"))).alias("x"), F.max(F.when(holds(low), ends(low))).alias("va"), F.max(F.when(holds(high), ends(high))).alias("vb"),
            F.max("below").alias("below"), F.max("a").alias("a"), F.max("b").alias("b"),
        )
        state = keep(picked.select(*by, F.col("x.least").alias("lo"), F.col("x.most").alias("hi"), (F.col("below") + F.col("x.begin")).alias("below"), "a", "b", "va", "vb"), "selection")
    return done.select(*by, F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), 0.5 * F.col("va") + 0.5 * F.col("vb")).otherwise(F.col("lo")).alias("median"))
