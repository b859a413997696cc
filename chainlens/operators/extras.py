"""Jobs the analysis describes in prose.

Overlap questions ("on both platforms", "elsewhere but never at home")
are answered with one aggregation per (wallet, route) carrying
``bool_or`` flags instead of semi / anti joins: one shuffle, no join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.config import DEFAULT, Params
from chainlens.functions.exprs import money_sum, ratio_or_zero
from chainlens.functions.quantiles import exact_quantiles_wide
from chainlens.operators.wallets import exclude_wallets, in_window


def usd_spread(features_a: DataFrame) -> DataFrame:
    """Send vs receive USD over wallet totals: means, medians, and the
    volume-weighted spread in percent."""
    s, r = F.col("total_send_usd"), F.col("total_receive_usd")
    med = exact_quantiles_wide(features_a, [], ["total_send_usd", "total_receive_usd"], [0.5])
    return features_a.agg(
        F.round(F.avg(s), 2).alias("mean_send_usd"),
        F.round(F.avg(r), 2).alias("mean_receive_usd"),
        F.round(med.select("total_send_usd_q0").scalar(), 2).alias("median_send_usd"),
        F.round(med.select("total_receive_usd_q0").scalar(), 2).alias("median_receive_usd"),
        F.round(F.try_divide((money_sum(s) - money_sum(r)) * 100.0, money_sum(s)), 4).alias("weighted_spread_pct"))


def vwa_size(table: DataFrame, key: str = "persona") -> DataFrame:
    """Volume-weighted average transfer size: total volume / (bridges +
    swaps) within the group, 0 when there are none."""
    g = table.groupBy(key).agg(money_sum("total_send_usd").alias("volume_usd"),
                               F.sum(F.col("bridges") + F.col("cross_chain_swaps")).alias("transfers"))
    return g.withColumn("vwa_size_usd", F.round(ratio_or_zero(F.col("volume_usd"), F.col("transfers")), 2))


def _flags(agg: DataFrame, keys: list[str], home: str) -> DataFrame:
    is_home = F.col("platform_") == home
    return agg.groupBy(*keys).agg(
        F.bool_or(is_home).alias("on_home"), F.bool_or(~is_home).alias("on_other"),
        money_sum(F.when(is_home, F.col("amount_usd"))).alias("home_usd"),
        money_sum(F.when(~is_home, F.col("amount_usd"))).alias("other_usd"),
        F.sum(F.when(~is_home, F.col("tx_count"))).alias("other_tx"))


def dest_overlap(agg: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per destination chain: wallets that reach it both on the home
    platform and on a competitor, and wallets that reach it only elsewhere."""
    f = _flags(agg, ["wallet_", "destination_chain"], p.home_platform)
    return f.groupBy("destination_chain").agg(
        F.count_if(F.col("on_home") & F.col("on_other")).alias("wallets_both"),
        F.count_if(~F.col("on_home") & F.col("on_other")).alias("wallets_elsewhere_only"))


def normalize_chains(df: DataFrame, mapping: Mapping[str, str],
                     cols=("source_chain", "destination_chain")) -> DataFrame:
    """Replace chain aliases by canonical names via a literal map
    (evaluated in the scan stage; unmapped names pass through)."""
    if not mapping:
        return df
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.select(*[F.coalesce(F.element_at(m, F.col(c)), F.col(c)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def unserved_routes(agg: DataFrame, p: Params = DEFAULT,
                    aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Routes wallets used on competitors but never on the home platform:
    per route, wallets, USD and transactions elsewhere."""
    a = normalize_chains(agg, aliases or {})
    f = _flags(a, ["wallet_", "source_chain", "destination_chain"], p.home_platform)
    f = f.where(F.col("on_other") & ~F.col("on_home"))
    return f.groupBy("source_chain", "destination_chain").agg(
        F.count(F.lit(1)).alias("wallets"),
        F.round(money_sum("other_usd"), 2).alias("amount_usd"),
        F.sum("other_tx").cast("bigint").alias("tx_count"))


def route_share(agg: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Home share of each wallet's USD per route (0..1)."""
    f = _flags(agg, ["wallet_", "source_chain", "destination_chain"], p.home_platform)
    home = F.coalesce(F.col("home_usd"), F.lit(0.0))
    total = home + F.coalesce(F.col("other_usd"), F.lit(0.0))
    return f.select("wallet_", "source_chain", "destination_chain",
                    F.round(home, 2).alias("home_amount_usd"), F.round(total, 2).alias("total_amount_usd"),
                    F.round(ratio_or_zero(home, total), 4).alias("home_share"))


def return_routes(tx: DataFrame, exclusions, p: Params = DEFAULT) -> DataFrame:
    """Wallets that went A -> B and later came back B -> A (A != B).

    Reduced first to (wallet, route) grain with the first and last time of
    each route; the reverse route is then an equi-join on (wallet, A, B)
    with one inequality on those two times, so there is at most one
    partner row per route: no pair explosion within a wallet."""
    base = exclude_wallets(in_window(tx, p.window_start, p.window_end), exclusions, keep_null=False)
    r = (base.where(F.col("origin_chain_name") != F.col("destination_chain_name"))
         .groupBy("wallet", "origin_chain_name", "destination_chain_name")
         .agg(F.min("created_at").alias("first_t"), F.max("created_at").alias("last_t")))
    out = r.alias("o")
    back = r.select(F.col("wallet").alias("b_wallet"), F.col("origin_chain_name").alias("b_origin"),
                    F.col("destination_chain_name").alias("b_dest"), F.col("last_t").alias("b_last"))
    cond: Column = ((F.col("wallet") == F.col("b_wallet"))
                    & (F.col("origin_chain_name") == F.col("b_dest"))
                    & (F.col("destination_chain_name") == F.col("b_origin"))
                    & (F.col("first_t") < F.col("b_last")))
    return out.join(back, cond).select(
        "wallet", F.col("origin_chain_name").alias("chain_a"),
        F.col("destination_chain_name").alias("chain_b"),
        F.col("first_t").alias("first_out"), F.col("b_last").alias("last_back"))
