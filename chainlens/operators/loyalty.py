"""Competitor extract, home + competitor union and loyalty classes.

Everything here works at wallet x platform x route grain, which is already
aggregated: the raw rows are shuffled once (by the group keys, after
partial aggregation) and every later step is small per wallet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.config import (COMPETITOR_USAGE_COLUMNS, DEFAULT, LOYALTY_MULTI,
                              PLATFORM_PATTERN, PLATFORM_PATTERN_LABEL, Params)
from chainlens.functions.distincts import dealt, distinct_counts
from chainlens.functions.exprs import money_sum, share_of_total
from chainlens.operators.wallets import exclude_wallets, in_window


# ---------------------------------------------------------------------------
# Competitor extract and load checks
# ---------------------------------------------------------------------------


def normalize_platform(c) -> F.Column:
    """Any spelling matching the pattern (case-insensitive) -> one label."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.ilike(PLATFORM_PATTERN), F.lit(PLATFORM_PATTERN_LABEL)).otherwise(c)


def competitor_usage(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Outbound, verified transfers of the listed platforms between listed
    chains in ``[competitor_start, competitor_end)``; USD summed and
    transactions counted distinct per wallet x platform x route.

    The platform list is case-exact; normalization happens before grouping,
    so one distinct count spans all spellings of a platform.  The distinct
    count is planned with a first shuffle on (keys, tx_hash), which spreads
    a hot wallet over many tasks."""
    f = raw.where(
        (F.col("block_timestamp") >= F.to_timestamp(F.lit(p.competitor_start)))
        & (F.col("block_timestamp") < F.to_timestamp(F.lit(p.competitor_end)))
        & (F.col("direction") == "outbound")
        & (F.col("token_is_verified") == F.lit(True))
        & F.col("platform").isin(list(p.competitor_platforms))
        & F.col("source_chain").isin(list(p.chains))
        & F.col("destination_chain").isin(list(p.chains)))
    return (f.groupBy(F.col("source_address").alias("wallet_"),
                      normalize_platform("platform").alias("platform_"),
                      "source_chain", "destination_chain")
            .agg(money_sum("amount_usd").alias("amount_usd"),
                 F.countDistinct("tx_hash").alias("tx_count"))
            .select(*COMPETITOR_USAGE_COLUMNS))


def check_columns(df: DataFrame, expected: list[str]) -> dict:
    """Schema check (metadata only): missing and unexpected columns."""
    have = df.columns
    return {"missing": [c for c in expected if c not in have],
            "extra": [c for c in have if c not in expected],
            "ok": all(c in have for c in expected)}


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows and NULLs per column, long form, from one aggregate pass."""
    cols = cols or df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"__null_{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', `__null_{i}`" for i, c in enumerate(cols))
    return agg.selectExpr("__n AS n_rows", f"stack({len(cols)}, {pairs}) AS (column_name, n_nulls)") \
        .select("column_name", "n_rows", "n_nulls")


def platform_records(usage: DataFrame) -> DataFrame:
    return usage.groupBy("platform_").agg(F.count(F.lit(1)).alias("records"))


# ---------------------------------------------------------------------------
# Home + competitor union (Q21-Q30)
# ---------------------------------------------------------------------------


def home_route_usage(tx: DataFrame, exclusions, p: Params = DEFAULT) -> DataFrame:
    """Home activity in the window per wallet x route, platform as a literal."""
    base = exclude_wallets(in_window(tx, p.window_start, p.window_end), exclusions, keep_null=False).select(
        F.col("wallet").alias("wallet_"), F.col("origin_chain_name").alias("source_chain"),
        F.col("destination_chain_name").alias("destination_chain"), "user_send_currency_usd")

    def routes(rows: DataFrame) -> DataFrame:
        return (rows.groupBy("wallet_", "source_chain", "destination_chain")
                .agg(money_sum("user_send_currency_usd").alias("amount_usd"), F.count(F.lit(1)).alias("tx_count"))
                .withColumn("platform_", F.lit(p.home_platform))
                .select(*COMPETITOR_USAGE_COLUMNS))

    # raw rows are narrower than partial sums, of which a wallet's routes give nearly as many
    cold, hot = dealt(base, "wallet_", p.slice_rows)
    return routes(cold) if hot is None else routes(cold).unionByName(routes(hot))


def competitor_overlap(usage: DataFrame, home: DataFrame, exclusions) -> DataFrame:
    """Competitor rows of non-excluded wallets that also use the home platform.
    The home wallets are de-duplicated (partial aggregation) before the
    semi join, whose shuffle then reuses that partitioning."""
    homes = home.select("wallet_").distinct()
    kept = exclude_wallets(usage, exclusions, wallet_col="wallet_", keep_null=False)
    return kept.join(homes, "wallet_", "left_semi").select(*COMPETITOR_USAGE_COLUMNS)


def loyalty_aggregate(home: DataFrame, overlap: DataFrame) -> DataFrame:
    """Bag union (UNION ALL) by column name."""
    return home.unionByName(overlap)


def loyalty_summary(agg: DataFrame) -> DataFrame:
    return agg.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("wallet_").alias("unique_wallets"),
        F.countDistinct("platform_").alias("unique_platforms"),
        F.countDistinct("source_chain").alias("unique_source_chains"),
        F.countDistinct("destination_chain").alias("unique_dest_chains"),
        money_sum("amount_usd").alias("total_volume_usd"),
        F.sum("tx_count").cast("bigint").alias("total_transactions"))


def platform_chain(agg: DataFrame, chain_col: str) -> DataFrame:
    """Per platform x chain: distinct wallets, USD, transactions; by volume."""
    return (agg.groupBy("platform_", chain_col)
            .agg(F.countDistinct("wallet_").alias("unique_wallets"),
                 money_sum("amount_usd").alias("total_volume"),
                 F.sum("tx_count").cast("bigint").alias("total_transactions"))
            .orderBy("platform_", F.desc("total_volume"), chain_col))


def chain_coverage(agg: DataFrame, chain_col: str) -> DataFrame:
    return (agg.groupBy(chain_col).agg(F.countDistinct("platform_").alias("platforms_count"))
            .orderBy(chain_col))


def chain_names(agg: DataFrame) -> DataFrame:
    """Sorted set UNION of source and destination names, with their total."""
    names = (agg.select(F.col("source_chain").alias("chain_name"))
             .union(agg.select(F.col("destination_chain").alias("chain_name"))).distinct())
    total = names.select(F.count(F.lit(1))).scalar()
    return names.withColumn("n_chain_names", total).orderBy("chain_name")


def loyalty_preview(agg: DataFrame, n: int = 10) -> DataFrame:
    return agg.orderBy(F.asc_nulls_first("wallet_"), F.asc_nulls_first("platform_"),
                       F.desc_nulls_last("amount_usd"), F.asc_nulls_first("source_chain"),
                       F.asc_nulls_first("destination_chain")).limit(n)


# ---------------------------------------------------------------------------
# Loyalty classes (Q31, Q32)
# ---------------------------------------------------------------------------


def loyalty_class(agg: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One platform -> '<home>-only', otherwise multi-platform (T24: the USD
    total spans all platforms)."""
    g = distinct_counts(agg, "wallet_", {"n_platforms": F.col("platform_"), "n_source_chains": F.col("source_chain"), "n_dest_chains": F.col("destination_chain")},
                        {"total_tx_count": F.col("tx_count")}, {"total_amount_usd": F.col("amount_usd")}, p.slice_rows)
    lt = F.when(F.col("n_platforms") == 1, p.home_only_label).otherwise(LOYALTY_MULTI)
    return g.select("wallet_", lt.alias("loyalty_type"), "n_platforms", "n_source_chains",
                    "n_dest_chains", "total_amount_usd", "total_tx_count")


def class_distribution(df: DataFrame, col: str, count_name: str = "n_wallets") -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
    return share_of_total(counts, count_name, "percentage", 2)


def load_competitor_usage(spark, path: str, fmt: str = "csv") -> DataFrame:
    """Read an exported competitor usage table (header CSV or Parquet) by
    column name, in any order; a file without one of the columns raises."""
    from chainlens.config import COMPETITOR_USAGE_SCHEMA
    from chainlens.sources.tables import CSV_TEXT
    if fmt == "csv":
        found = spark.read.options(**CSV_TEXT).option("multiLine", True).csv(path)  # all text, names from the header
    else:
        found = spark.read.parquet(path)
    check = check_columns(found, COMPETITOR_USAGE_COLUMNS)
    if not check["ok"]:
        raise ValueError(f"competitor usage lacks columns {check['missing']}")
    return found.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in COMPETITOR_USAGE_SCHEMA.fields])
