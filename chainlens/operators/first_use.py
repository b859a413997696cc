"""First use: each wallet's first transaction(s) in the window and the
onboarding tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.config import DEFAULT, Params
from chainlens.functions.exprs import avg_money, share_of_total
from chainlens.operators.wallets import exclude_wallets, in_window

FIRST_USE_COLUMNS = [
    "wallet", "first_tx_time", "first_source_chain", "first_dest_chain", "first_currency",
    "first_amount_usd", "first_is_call", "first_tx_same_chain", "first_tx_type",
]


def first_usage(tx: DataFrame, exclusions, p: Params = DEFAULT, ties: str = "all") -> DataFrame:
    """Rows at each wallet's earliest time in the window.

    ``ties="all"`` keeps every row at the minimum time (what a min-time
    self join returns); ``ties="one"`` keeps one row per wallet.  The filter
    ``rank() == 1`` is planned as a WindowGroupLimit that already runs
    before the shuffle: every map task forwards only its own earliest rows
    per wallet, so a wallet with a third of the data costs one small sort
    per task instead of one giant partition."""
    base = exclude_wallets(in_window(tx, p.window_start, p.window_end), exclusions, keep_null=False)
    if ties == "all":
        w = Window.partitionBy("wallet").orderBy(F.col("created_at"))
        rk = F.rank().over(w)
    else:
        w = Window.partitionBy("wallet").orderBy(
            "created_at", "origin_chain_name", "destination_chain_name", "user_send_currency",
            "user_send_currency_usd", "is_call")
        rk = F.row_number().over(w)
    first = (base.select("wallet", "created_at", "origin_chain_name", "destination_chain_name",
                         "user_send_currency", "user_send_currency_usd", "is_call")
             .withColumn("__rk", rk).where(F.col("__rk") == 1))
    return first.select(
        "wallet",
        F.col("created_at").alias("first_tx_time"),
        F.col("origin_chain_name").alias("first_source_chain"),
        F.col("destination_chain_name").alias("first_dest_chain"),
        F.col("user_send_currency").alias("first_currency"),
        F.col("user_send_currency_usd").alias("first_amount_usd"),
        F.col("is_call").alias("first_is_call"),
        F.when(F.col("origin_chain_name") == F.col("destination_chain_name"), 1).otherwise(0)
         .alias("first_tx_same_chain"),
        F.when(F.col("is_call"), "Call").otherwise("Not Call").alias("first_tx_type"),
    )


def first_usage_summary(fu: DataFrame) -> DataFrame:
    return fu.agg(
        F.count(F.lit(1)).alias("total_wallets"),
        F.countDistinct("first_source_chain").alias("unique_source_chains"),
        F.countDistinct("first_dest_chain").alias("unique_dest_chains"),
        avg_money("first_amount_usd").alias("avg_first_amount"),
        F.sum("first_tx_same_chain").cast("bigint").alias("same_chain_first_txs"),
        F.count_if(F.col("first_is_call")).alias("call_first_txs"))


def first_top(fu: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Top n groups of first rows: count, percent of all first rows, mean USD.
    The percent's denominator is the sum over the grouped (small) table."""
    g = fu.groupBy(*keys).agg(F.count(F.lit(1)).alias("wallet_count"),
                              avg_money("first_amount_usd").alias("avg_amount"))
    g = share_of_total(g, "wallet_count", "percentage", 2)
    return g.orderBy(F.desc("wallet_count"), *[F.asc_nulls_first(k) for k in keys]).limit(n)


def first_tx_types(fu: DataFrame) -> DataFrame:
    g = fu.groupBy("first_tx_type").agg(
        F.count(F.lit(1)).alias("count"),
        avg_money("first_amount_usd").alias("avg_amount"),
        F.min("first_amount_usd").alias("min_amount"),
        F.max("first_amount_usd").alias("max_amount"))
    return share_of_total(g, "count", "percentage", 2)


def first_usage_preview(fu: DataFrame, n: int = 10) -> DataFrame:
    return fu.orderBy(F.asc_nulls_first("first_tx_time"),
                      *[F.asc_nulls_first(c) for c in FIRST_USE_COLUMNS[2:]],
                      F.asc_nulls_first("wallet")).limit(n)
