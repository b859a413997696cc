"""Feature summaries and transforms at wallet grain.

Statistics that a later step needs as constants (means, deviations,
percentile cut-offs) are one-row aggregates used as scalar subqueries:
Catalyst merges them into a single aggregate, runs it once and inlines the
values, so the wallet table is never joined to a stats table and no value
passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.config import (BUSINESS_FEATURES, CLUSTER_FEATURES, LOG_FEATURES, SEGMENT_REST,
                              SEGMENT_TOP1, SEGMENT_TOP10)
from chainlens.functions.exprs import log1p_filled
from chainlens.functions.quantiles import exact_quantiles

SUMMARY_QUANTILES = [0.25, 0.5, 0.75, 0.9, 0.99]


def feature_summary(df: DataFrame, cols: list[str], exact: bool = True,
                    accuracy: int = 10000) -> DataFrame:
    """Per column: count, mean, median, q1, q3, iqr, p90, p99, min, max and
    sample std, one row per column.

    Moments come from ONE global aggregate (partial per task, merged once)
    whose single row is turned long with ``stack``.  Quantiles are exact
    (linear interpolation, like pandas) with bounded memory
    (``functions.quantiles``); ``exact=False`` uses ``percentile_approx``."""
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    rows = ", ".join(f"'{c}', n{i}, mean{i}, min{i}, max{i}, sd{i}" for i, c in enumerate(cols))
    moments = df.agg(*aggs).selectExpr(f"stack({len(cols)}, {rows}) AS (column, count, mean, min, max, sd)")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("cv")
    ).select("cv.column", "cv.value")
    if exact:
        q = exact_quantiles(long, ["column"], "value", SUMMARY_QUANTILES, "q")
    else:
        q = long.groupBy("column").agg(
            F.percentile_approx("value", SUMMARY_QUANTILES, accuracy).alias("qa")).select(
            "column", *[F.col("qa")[i].cast("double").alias(f"q{i}") for i in range(len(SUMMARY_QUANTILES))])
    j = moments.join(q, "column", "left")   # len(cols) rows on each side
    r = lambda c: F.round(F.col(c), 2)
    return j.select(
        "column", F.col("count").cast("bigint").alias("count"), r("mean").alias("mean"),
        r("q1").alias("median"), r("q0").alias("q1"), r("q2").alias("q3"),
        F.round(F.col("q2") - F.col("q0"), 2).alias("iqr"), r("q3").alias("p90"),
        r("q4").alias("p99"), F.col("min").alias("min"), F.col("max").alias("max"),
        r("sd").alias("std_dev"))


def log1p_features(features: DataFrame) -> DataFrame:
    """Variant A transform: natural log1p of the heavy-tailed features, all
    clustering inputs with NaN/NULL -> 0."""
    cols = [log1p_filled(c).alias(f"{c}_log") if c in LOG_FEATURES
            else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
            for c in BUSINESS_FEATURES]
    return features.select("wallet", *cols)


def log10_features(features_b: DataFrame) -> DataFrame:
    """Variant B clustering inputs (base-10 guarded logs), NULL -> 0."""
    return features_b.select(
        "wallet", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CLUSTER_FEATURES])


def log_ranges(features: DataFrame) -> DataFrame:
    """Min / max of each heavy-tailed feature before and after log1p."""
    aggs = []
    for c in LOG_FEATURES:
        v = log1p_filled(c)
        aggs += [F.min(F.col(c).cast("double")).alias(f"a{c}"), F.max(F.col(c).cast("double")).alias(f"b{c}"),
                 F.min(v).alias(f"c{c}"), F.max(v).alias(f"d{c}")]
    rows = ", ".join(f"'{c}', a{c}, b{c}, c{c}, d{c}" for c in LOG_FEATURES)
    return features.agg(*aggs).selectExpr(
        f"stack({len(LOG_FEATURES)}, {rows}) AS (feature, min_before, max_before, min_after, max_after)")


def standardize(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """(x - mean) / population std; a constant column maps to 0 (its std is
    replaced by 1), as scikit-learn's scaler does."""
    keep = keep if keep is not None else ["wallet"]
    out = []
    for c in cols:
        mean = df.select(F.avg(c)).scalar()
        sd = df.select(F.stddev_pop(c)).scalar()
        out.append(((F.col(c) - mean) / F.when(sd > 0, sd).otherwise(F.lit(1.0))).alias(c))
    return df.select(*keep, *out)


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair (i < j), one pass, long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = ", ".join(f"'{a}', '{b}', c{k}" for k, (a, b) in enumerate(pairs))
    return one.selectExpr(f"stack({len(pairs)}, {rows}) AS (feature_a, feature_b, corr)")


def volume_segments(features: DataFrame, col: str = "total_send_usd") -> DataFrame:
    """>= P99 -> top 1%, >= P90 -> top 10%, else the rest (exact percentiles
    with linear interpolation, inlined as scalar subqueries)."""
    q = exact_quantiles(features, [], col, [0.9, 0.99], "q")
    p90, p99 = q.select("q0").scalar(), q.select("q1").scalar()
    seg = (F.when(F.col(col) >= p99, SEGMENT_TOP1)
           .when(F.col(col) >= p90, SEGMENT_TOP10)
           .otherwise(SEGMENT_REST))
    return features.withColumn("business_segment", seg)
