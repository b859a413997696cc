"""Exact quantiles (linear interpolation) with bounded memory per group.

``percentile`` keeps a value->count map of the whole group in one task:
fine for integer counts, unbounded for USD totals (one entry per wallet).
Here a ``percentile_approx`` pass first brackets each target rank in a
value band: the approximation's rank error is at most n / accuracy, so
the values at ranks floor(h) and floor(h)+1 (h = p * (n - 1)) lie between
the approximate quantiles at p -/+ margin / accuracy, widened by one
distinct value on each side (which covers rounding of the rank at small
n).  A last pass counts the rows below each band and gathers the band
itself as (value, count) pairs: about 2 x MARGIN / ACCURACY (8 in 100,000)
of the group's distinct values, so 8,000 for a group of 100 million; the exact interpolated quantile is then read off the band.  Same result as
``percentile`` / DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000
MARGIN = 4


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
                    prefix: str | None = None, accuracy: int = ACCURACY,
                    margin: int = MARGIN) -> DataFrame:
    """One row per group: ``keys`` + ``{prefix}{i}`` (double) for each prob.
    Without keys: one row (global).  Groups whose values are all NULL get
    NULL quantiles."""
    keys = list(keys)
    prefix = prefix if prefix is not None else f"{col}_q"
    eps = margin / accuracy
    k = len(probs)
    base = df.select(*keys, F.col(col).cast("double").alias("__x")).where(F.col("__x").isNotNull())

    def attach(frame: DataFrame, small: DataFrame, names: list[str]) -> DataFrame:
        """Band edges onto rows.  They have one row per group with two numbers
        per probability, and the callers' groups are features, personas and
        clusters, so they are broadcast: the rows stay where they are, and
        no feature or persona lands in one task."""
        if keys:
            return frame.join(F.broadcast(small.select(*keys, *names)), keys)
        return frame.select("*", *[small.select(c).scalar().alias(c) for c in names])

    lo_p = [max(p - eps, 0.0) for p in probs]
    hi_p = [min(p + eps, 1.0) for p in probs]
    lo = [f"__lo{i}" for i in range(k)]
    hi = [f"__hi{i}" for i in range(k)]
    bounds = base.groupBy(*keys).agg(F.percentile_approx("__x", lo_p + hi_p, accuracy).alias("__b"))
    # band edges: approximate quantiles at p -/+ eps, open at the ends
    edges = bounds.select(
        *keys,
        *[(F.lit(float("-inf")) if lo_p[i] <= 0 else F.col("__b")[i]).alias(lo[i]) for i in range(k)],
        *[(F.lit(float("inf")) if hi_p[i] >= 1 else F.col("__b")[k + i]).alias(hi[i]) for i in range(k)])
    rows = attach(base, edges, lo + hi)
    # widen each band by one distinct value on both sides
    widen = rows.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("__x") < F.col(lo[i]), F.col("__x"))), F.first(lo[i])).alias(lo[i])
          for i in range(k)],
        *[F.coalesce(F.min(F.when(F.col("__x") > F.col(hi[i]), F.col("__x"))), F.first(hi[i])).alias(hi[i])
          for i in range(k)])
    rows = attach(base, widen, lo + hi)
    below = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col("__x") < F.col(lo[i])).alias(f"__below{i}") for i in range(k)])
    member = F.filter(F.array(*[F.when((F.col("__x") >= F.col(lo[i])) & (F.col("__x") <= F.col(hi[i])),
                                       F.lit(i)) for i in range(k)]), lambda v: v.isNotNull())
    band = (rows.select(*keys, "__x", F.explode(member).alias("__i"))
            .groupBy(*keys, "__i", "__x").agg(F.count(F.lit(1)).alias("__c")))
    # cumulative count inside each band (a few thousand distinct values)
    w = Window.partitionBy(*keys, "__i").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    band = band.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0)))

    # target positions inside each band (0-based)
    pos = below.select(*keys, "__n", F.posexplode(F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.col(f"__below{i}").alias("below"))
        for i, p in enumerate(probs)])).alias("__i", "__t"))
    h = F.col("__t.p") * (F.col("__n") - 1)
    pos = pos.select(*keys, "__i", (F.floor(h) - F.col("__t.below")).alias("__j0"),
                     (F.ceil(h) - F.col("__t.below")).alias("__j1"), (h - F.floor(h)).alias("__f"))
    j = band.join(pos, keys + ["__i"])

    def at(idx: str):
        return F.max(F.when((F.col("__before") <= F.col(idx)) & (F.col(idx) < F.col("__before") + F.col("__c")),
                            F.col("__x")))
    vals = j.groupBy(*keys, "__i").agg(at("__j0").alias("__v0"), at("__j1").alias("__v1"),
                                        F.first("__f").alias("__f"))
    vals = vals.withColumn("__q", F.col("__v0") + F.col("__f") * (F.col("__v1") - F.col("__v0")))
    wide = vals.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(f"{prefix}{i}")
                                     for i in range(k)])
    if keys:
        # groups with only NULL values still get a row
        return df.select(*keys).distinct().join(wide, keys, "left")
    return wide   # a global aggregate: always exactly one row


def exact_quantiles_wide(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                         probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Quantiles of several columns at once: the columns are unpivoted to
    (feature, value) so all of them share the two passes; result columns
    ``{col}_q{i}``, one row per group."""
    keys = list(keys)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in cols])).alias("__fv"))
    long = long.select(*keys, F.col("__fv.f").alias("__feature"), F.col("__fv.v").alias("__value"))
    q = exact_quantiles(long, keys + ["__feature"], "__value", probs, "__q", accuracy)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("__feature") == c, F.col(f"__q{i}"))).alias(f"{c}_q{i}")
                                  for c in cols for i in range(len(probs))])
