"""Persona x loyalty report tables.

Input is the final wallet table (``personas.loyalty_persona``).  Every
report aggregates to a handful of groups first; pivots and percent columns
then work on those few rows.  Numeric columns stay numeric; formatted text
is an extra column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.config import (BUSINESS_FEATURES, DEFAULT, DISPLAY_NAMES, LOYALTY_METRICS,
                              LOYALTY_MULTI, PERSONAS, REPORT_FEATURES, Params)
from chainlens.functions.exprs import avg_money, format_usd, money_sum, parse_usd, ratio_or_zero, share_of_total
from chainlens.functions.quantiles import exact_quantiles_wide

ALL = "All"
#: Columns holding USD: their means come from exact decimal sums.
MONEY = {"total_send_usd", "total_amount_usd"}


def mean2(c) -> F.Column:
    """Mean rounded to 2 dp; exact (decimal) for money columns."""
    if isinstance(c, str) and c in MONEY:
        return avg_money(c)
    return F.round(F.avg(c), 2)


def crosstab(df: DataFrame, row: str, col: str, col_values: Sequence,
             col_names: Sequence[str] | None = None) -> DataFrame:
    """Counts of row x col with an All row and an All column; missing cells 0.

    ``cube`` computes cells and both margins in one aggregation (partial
    aggregation map-side, a few rows after); the pivot then runs on those
    rows with the column values given up front (no extra job to find them)."""
    col_names = list(col_names or [str(v) for v in col_values])
    cells = (df.cube(row, col)
             .agg(F.count(F.lit(1)).alias("n"), F.grouping(row).alias("gr"), F.grouping(col).alias("gc"))
             .select(F.when(F.col("gr") == 1, F.lit(ALL)).otherwise(F.col(row).cast("string")).alias(row),
                     F.when(F.col("gc") == 1, F.lit("__all")).otherwise(F.col(col).cast("string")).alias("__c"),
                     "n"))
    wide = cells.groupBy(row).pivot("__c", [str(v) for v in col_values] + ["__all"]).agg(F.first("n"))
    return wide.select(row, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("bigint").alias(name)
                              for v, name in zip(col_values, col_names)],
                       F.coalesce(F.col("__all"), F.lit(0)).cast("bigint").alias(ALL))


def normalized_crosstab(df: DataFrame, row: str, col: str, col_values: Sequence,
                        col_names: Sequence[str] | None = None) -> DataFrame:
    """Percent of each cell within its row (rows sum to 100), wide."""
    col_names = list(col_names or [str(v) for v in col_values])
    cells = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    tot = df.groupBy(row).agg(F.count(F.lit(1)).alias("row_n"))
    pct = cells.join(tot, row).select(row, F.col(col).cast("string").alias("__c"),
                                      (F.col("n") * 100.0 / F.col("row_n")).alias("pct"))
    wide = pct.groupBy(row).pivot("__c", [str(v) for v in col_values]).agg(F.first("pct"))
    return wide.select(row, *[F.round(F.coalesce(F.col(str(v)), F.lit(0.0)), 2).alias(name)
                              for v, name in zip(col_values, col_names)])


def loyalty_volume(t: DataFrame) -> DataFrame:
    r = lambda e: F.round(e, 2)
    return t.groupBy("loyalty_type", "persona").agg(
        F.count("total_amount_usd").alias("wallets"),
        mean2("total_amount_usd").alias("mean_amount_usd"),
        r(money_sum("total_amount_usd")).alias("sum_amount_usd"),
        r(F.avg("total_tx_count")).alias("mean_tx_count"),
        F.sum("total_tx_count").cast("bigint").alias("sum_tx_count"),
        r(F.avg("n_platforms")).alias("mean_platforms"))


def persona_summary(t: DataFrame) -> DataFrame:
    r = lambda e: F.round(e, 2)
    g = t.groupBy("persona").agg(
        F.count("wallet_").alias("wallets"),
        r(F.avg(F.when(F.col("loyalty_type") == LOYALTY_MULTI, 1.0).otherwise(0.0)) * 100).alias("multi_platform_pct"),
        mean2("total_amount_usd").alias("mean_amount_usd"),
        r(F.avg("total_tx_count")).alias("mean_tx_count"),
        r(F.avg("n_platforms")).alias("mean_platforms"),
        *[mean2(c).alias(f"{c}_mean") for c in BUSINESS_FEATURES])
    med = exact_quantiles_wide(t, ["persona"], ["total_amount_usd", "total_tx_count"], [0.5])
    j = g.join(med, "persona")
    return j.select("persona", "wallets", "multi_platform_pct", "mean_amount_usd",
                    r(F.col("total_amount_usd_q0")).alias("median_amount_usd"), "mean_tx_count",
                    r(F.col("total_tx_count_q0")).alias("median_tx_count"), "mean_platforms",
                    *[f"{c}_mean" for c in BUSINESS_FEATURES])


def persona_profile(t: DataFrame, key: str = "persona") -> DataFrame:
    return t.where(F.col(key).isNotNull()).groupBy(key).agg(*[mean2(c).alias(c) for c in BUSINESS_FEATURES])


def _characteristics(t: DataFrame, key: str, key_expr, money_name: str) -> DataFrame:
    """count, % of all wallets (1 dp), means of the report features (2 dp,
    then 1 dp for counts) and the mean volume as '$#,##0' text."""
    g = t.groupBy(key_expr.alias(key)).agg(
        F.count(F.lit(1)).alias("Count"),
        *[mean2(c).alias(c) for c in REPORT_FEATURES])
    g = share_of_total(g, "Count", "%", 1)
    cols = [key, "Count", "%"]
    for c in REPORT_FEATURES:
        if c == "total_send_usd":
            cols.append(format_usd(F.round(F.col(c), 0), 0).alias(money_name))
        else:
            cols.append(F.round(F.col(c), 1).alias(DISPLAY_NAMES[c]))
    return g.select(*cols)


def persona_characteristics(t: DataFrame) -> DataFrame:
    """Persona table of the report; wallets without a persona are left out
    first (a NULL group key would form its own row in Spark)."""
    return _characteristics(t.where(F.col("persona").isNotNull()), "persona", F.col("persona"),
                            DISPLAY_NAMES["total_send_usd"])


def persona_loyalty_table(t: DataFrame) -> DataFrame:
    key = F.concat_ws(" + ", "persona", "loyalty_type")
    return _characteristics(t.where(F.col("persona").isNotNull() & F.col("loyalty_type").isNotNull()),
                            "persona_loyalty", key, "Avg Volume")


def loyalty_profile(t: DataFrame, metrics: Sequence[str] = LOYALTY_METRICS) -> DataFrame:
    """mean / median / sample std of each metric per loyalty type, flattened
    ``{metric}_{stat}`` names, 2 dp (exact medians, bounded memory)."""
    t = t.where(F.col("loyalty_type").isNotNull())
    aggs = []
    for c in metrics:
        aggs += [mean2(c).alias(f"{c}_mean"),
                 F.round(F.stddev_samp(F.col(c).cast("double")), 2).alias(f"{c}_std")]
    g = t.groupBy("loyalty_type").agg(*aggs)
    med = exact_quantiles_wide(t, ["loyalty_type"], list(metrics), [0.5])
    j = g.join(med, "loyalty_type")
    cols = []
    for c in metrics:
        cols += [F.col(f"{c}_mean"), F.round(F.col(f"{c}_q0"), 2).alias(f"{c}_median"), F.col(f"{c}_std")]
    return j.select("loyalty_type", *cols)


def marginal_effects(t: DataFrame, p: Params = DEFAULT, personas: Sequence[str] = PERSONAS) -> DataFrame:
    """Within each persona: multi-platform mean / home-only mean, for volume
    and origin chains (means rounded to 2 dp first, 0 when the home-only
    mean is 0).  Personas lacking one of the two groups are reported with
    ``pair_present = false`` and NULL ratios."""
    means = (t.where(F.col("persona").isNotNull() & F.col("loyalty_type").isNotNull())
             .groupBy("persona").agg(
                 *[(avg_money if c in MONEY else lambda e: F.round(F.avg(e), 2))(
                     F.when(F.col("loyalty_type") == lt, F.col(c))).alias(f"{c}__{i}")
                   for i, lt in enumerate([p.home_only_label, LOYALTY_MULTI])
                   for c in ("total_send_usd", "origin_chains")],
                 F.count_if(F.col("loyalty_type") == p.home_only_label).alias("n_home"),
                 F.count_if(F.col("loyalty_type") == LOYALTY_MULTI).alias("n_multi")))
    spark = t.sparkSession
    names = spark.createDataFrame([(x,) for x in personas], "persona string")
    j = names.join(means, "persona", "left")
    present = F.coalesce((F.col("n_home") > 0) & (F.col("n_multi") > 0), F.lit(False))
    vol = ratio_or_zero(F.col("total_send_usd__1"), F.col("total_send_usd__0"))
    ch = ratio_or_zero(F.col("origin_chains__1"), F.col("origin_chains__0"))
    return j.select("persona", present.alias("pair_present"),
                    F.col("total_send_usd__0").alias("home_only_volume"),
                    F.col("total_send_usd__1").alias("multi_volume"),
                    F.when(present, F.round(vol, 4)).alias("volume_ratio"),
                    F.col("origin_chains__0").alias("home_only_origins"),
                    F.col("origin_chains__1").alias("multi_origins"),
                    F.when(present, F.round(ch, 4)).alias("origin_ratio"))


def crosstab_long(ct: DataFrame, row: str, value_cols: Sequence[str], col_name: str,
                  relabel: dict | None = None) -> DataFrame:
    """Wide crosstab -> long: drop the All row/column, unpivot, relabel the
    column values for display, percent of the grand total (1 dp) and a
    'count\n(pct%)' label with thousands separators."""
    body = ct.where(F.col(row) != ALL).select(row, *value_cols)
    long = body.unpivot(row, list(value_cols), col_name, "count")
    if relabel:
        m = F.create_map(*[F.lit(x) for kv in relabel.items() for x in kv])
        long = long.withColumn(col_name, F.coalesce(F.element_at(m, F.col(col_name)), F.col(col_name)))
    long = share_of_total(long, "count", "pct", 1)
    return long.withColumn("label", F.concat(F.format_number("count", 0), F.lit("\n("),
                                             F.col("pct").cast("string"), F.lit("%)")))


def loyalty_display_names(p: Params = DEFAULT) -> dict:
    """Display names of the loyalty types in the report."""
    return {p.home_only_label: f"{p.home_platform.title()} Only", LOYALTY_MULTI: "Multi-platform"}


def loyalty_table_ordered(table: DataFrame, p: Params = DEFAULT,
                          personas: Sequence[str] = PERSONAS) -> DataFrame:
    """Persona + loyalty table for the report: volume text parsed back to a
    number, renamed, ordered persona-major then loyalty, helpers dropped."""
    split = F.split(F.col("persona_loyalty"), r" \+ ")
    pk = F.array_position(F.array(*[F.lit(x) for x in personas]), split.getItem(0))
    lk = F.array_position(F.array(F.lit(p.home_only_label), F.lit(LOYALTY_MULTI)), split.getItem(1))
    out = (table.withColumn("avg_volume_usd", parse_usd("Avg Volume"))
           .withColumn("persona", split.getItem(0)).withColumn("loyalty_type", split.getItem(1))
           .withColumnRenamed("Count", "wallets").withColumnRenamed("%", "pct_of_wallets")
           .withColumn("__p", pk).withColumn("__l", lk)
           .orderBy("__p", "__l").drop("__p", "__l", "Avg Volume", "persona_loyalty"))
    return out


def persona_distribution(t: DataFrame) -> DataFrame:
    """Count and percent per persona, the number of personas, and a flag on
    the most common one (ties -> first by name)."""
    g = t.where(F.col("persona").isNotNull()).groupBy("persona").agg(F.count(F.lit(1)).alias("wallets"))
    g = share_of_total(g, "wallets", "percentage", 2)
    n_personas = g.select(F.count(F.lit(1))).scalar()
    top = g.orderBy(F.desc("wallets"), "persona").limit(1).select("persona").scalar()
    return g.withColumn("n_personas", n_personas).withColumn("is_most_common", F.col("persona") == top)


def segment_cluster_crosstab(t: DataFrame, k: int) -> DataFrame:
    """Volume segment x cluster counts; one column per cluster of the model."""
    from chainlens.operators.features import volume_segments
    seg = volume_segments(t)
    return crosstab(seg, "business_segment", "cluster_id", list(range(k)),
                    [f"cluster_{i}" for i in range(k)])
