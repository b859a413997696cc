"""Transaction-grain and wallet-grain jobs: load checks, heavy wallets,
rule segments, exclusions and the wallet feature table.

All jobs key by ``wallet``.  Aggregations are declared so Spark can combine
map-side (partial aggregation) before the shuffle, which is what keeps a
wallet holding a third of all rows from landing whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.config import (DEFAULT, KIND_BRIDGE, KIND_CROSS_CHAIN_SWAP, RULE_BEGINNER,
                              RULE_NEW, RULE_PROGRAMMATIC, RULE_REGULAR, Params)
from chainlens.functions.distincts import distinct_counts
from chainlens.functions.exprs import avg_money, log10_guarded, money_sum, share_of_total, unsummable

# ---------------------------------------------------------------------------
# Exclusions (Q8)
# ---------------------------------------------------------------------------


def exclusion_table(spark, exclusions) -> DataFrame:
    """(wallet, reasoning) of a list of wallets or (wallet, reason) pairs, or
    of a DataFrame with a ``wallet`` and perhaps a ``reasoning`` column."""
    if isinstance(exclusions, DataFrame):
        reason = F.col("reasoning") if "reasoning" in exclusions.columns else F.lit(None).cast("string")
        return exclusions.select("wallet", reason.alias("reasoning"))
    rows = [tuple(e) if isinstance(e, (tuple, list)) else (e, None) for e in exclusions]
    # an Arrow table becomes a relation of known size, which the planner needs to choose its join
    cols = {name: pa.array([r[i] for r in rows], pa.string()) for i, name in enumerate(("wallet", "reasoning"))}
    return spark.createDataFrame(pa.table(cols))


def exclude_wallets(df: DataFrame, exclusions, wallet_col: str = "wallet",
                    keep_null: bool = True) -> DataFrame:
    """Drop listed wallets.

    ``keep_null=True`` is the NOT EXISTS form (a NULL wallet survives);
    ``keep_null=False`` is the NOT IN form (NULL wallets are dropped too,
    valid because NULLs in the list are ignored).  ``exclusions`` is a list
    of wallets / (wallet, reason) pairs or a DataFrame with a ``wallet``
    column; any size is the same anti join, whose list side Spark
    broadcasts where its known size allows and shuffles beyond."""
    ex = exclusion_table(df.sparkSession, exclusions).select(F.col("wallet").alias("__excluded"))
    out = df.join(ex, F.col(wallet_col) == F.col("__excluded"), "left_anti")
    return out if keep_null else out.where(F.col(wallet_col).isNotNull())


def exclusion_impact(tx: DataFrame, exclusions) -> DataFrame:
    """Per exclusion reason: wallets listed, wallets present, rows removed."""
    listed = exclusion_table(tx.sparkSession, exclusions)
    found = (tx.join(listed.select("wallet"), "wallet", "left_semi")
             .groupBy("wallet").agg(F.count(F.lit(1)).alias("n_rows")))
    return (listed.join(found, "wallet", "left")
            .groupBy("reasoning")
            .agg(F.count(F.lit(1)).alias("wallets_listed"),
                 F.count("n_rows").alias("wallets_found"),
                 F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("rows_removed")))


# ---------------------------------------------------------------------------
# Window filter
# ---------------------------------------------------------------------------


def in_window(df: DataFrame, start: str | None, end: str | None = None,
              ts_col: str = "created_at") -> DataFrame:
    """``start <= ts < end``; NULL times are dropped (the comparison is NULL).
    Pushed to the Parquet scan as a range predicate; on a stored table with
    a ``month`` partition column only the months of the range are listed."""
    months = ts_col == "created_at" and "month" in df.columns
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts_col) >= F.to_timestamp(F.lit(start)))
        cond = cond & (F.col("month") >= start[:7]) if months else cond
    if end is not None:
        cond = cond & (F.col(ts_col) < F.to_timestamp(F.lit(end)))
        cond = cond & (F.col("month") <= end[:7]) if months else cond
    return df.where(cond)


# ---------------------------------------------------------------------------
# Load checks
# ---------------------------------------------------------------------------


def retain_from(tx: DataFrame, ts: str) -> DataFrame:
    """Delete rows before ``ts``; rows with a NULL time are kept (T5)."""
    c = F.col("created_at") < F.to_timestamp(F.lit(ts))
    kept = tx.where(~F.coalesce(c, F.lit(False)))
    return kept.where(F.col("month").isNull() | (F.col("month") >= ts[:7])) if "month" in tx.columns else kept


def retention_counts(tx: DataFrame, ts: str) -> DataFrame:
    """Rows before / deleted / after the retention cut, in one pass."""
    deleted = F.count_if(F.coalesce(F.col("created_at") < F.to_timestamp(F.lit(ts)), F.lit(False)))
    return tx.agg(F.count(F.lit(1)).alias("rows_before"), deleted.alias("rows_deleted")) \
        .withColumn("rows_after", F.col("rows_before") - F.col("rows_deleted"))


def money_rejects(tx: DataFrame, cols: Sequence[str] = ("user_send_currency_usd", "user_receive_currency_usd")) -> DataFrame:
    """Per money column: amounts present, and those beyond the range that sums take."""
    agg = tx.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.count_if(unsummable(c)).alias(f"r{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', n{i}, r{i}" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, n_amounts, n_rejected)")


def load_summary(tx: DataFrame) -> DataFrame:
    return tx.agg(F.count(F.lit(1)).alias("total_transactions"),
                  F.countDistinct("wallet").alias("unique_wallets"),
                  F.min("created_at").alias("first_tx"),
                  F.max("created_at").alias("last_tx"))


def top_origin_chains(tx: DataFrame, n: int = 5) -> DataFrame:
    return (tx.groupBy("origin_chain_name").agg(F.count(F.lit(1)).alias("tx_count"))
            .orderBy(F.desc("tx_count"), F.asc_nulls_first("origin_chain_name")).limit(n))


def earliest_transactions(tx: DataFrame, n: int = 5) -> DataFrame:
    """First n transactions by time (TakeOrderedAndProject, no full sort)."""
    cols = ["wallet", "origin_chain_name", "destination_chain_name",
            "user_send_currency", "user_receive_currency"]
    return (tx.select(*cols, "created_at", F.to_date("created_at").alias("date"))
            .orderBy(F.asc_nulls_first("created_at"), *[F.asc_nulls_first(c) for c in cols])
            .limit(n).drop("created_at"))


def monthly_transactions(tx: DataFrame) -> DataFrame:
    return (tx.groupBy(F.date_format("created_at", "yyyy-MM").alias("month_"))
            .agg(F.count(F.lit(1)).alias("n_tx"))
            .orderBy(F.desc_nulls_last("month_")))


# ---------------------------------------------------------------------------
# Heavy wallets (Q1-Q7, Q13)
# ---------------------------------------------------------------------------


def top_wallets(tx: DataFrame, k: int) -> DataFrame:
    """COUNT(deposit_tx_hash) per wallet, top k (ties broken by wallet)."""
    return (tx.groupBy("wallet").agg(F.count("deposit_tx_hash").alias("n_tx"))
            .orderBy(F.desc("n_tx"), F.asc_nulls_first("wallet")).limit(k))


def top_wallet_stats(top: DataFrame, new_max: int, advanced_min: int,
                     programmatic_min: int) -> DataFrame:
    """Distribution of n_tx inside the top-k set (one row)."""
    n = F.count(F.lit(1))

    def share(cond: Column) -> Column:
        return F.round(F.try_divide(F.count_if(cond) * 100.0, n), 2)

    x = F.col("n_tx")
    return top.agg(
        n.alias("n_wallets"), F.max(x).alias("max_tx"), F.min(x).alias("min_tx"),
        F.round(F.avg(x), 2).alias("mean_tx"),
        F.percentile(x, 0.5).alias("median_tx"),
        F.count_if(x <= new_max).alias("new_wallets"), share(x <= new_max).alias("new_pct"),
        F.count_if(x > advanced_min).alias("advanced_wallets"),
        share(x > advanced_min).alias("advanced_pct"),
        F.count_if(x > programmatic_min).alias("programmatic_wallets"),
        share(x > programmatic_min).alias("programmatic_pct"))


def wallet_profile(tx: DataFrame, wallet: str | None = None, mode: str = "exact") -> DataFrame:
    """Rows, distinct chains / currencies, first / last time and USD per wallet.
    With ``wallet`` set the filter is pushed to the scan (one-wallet form)."""
    if wallet is not None:
        tx = tx.where(F.col("wallet") == wallet)
    return tx.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        _distinct("origin_chain_name", mode).alias("origin_chains_used"),
        _distinct("destination_chain_name", mode).alias("dest_chains_used"),
        _distinct("user_send_currency", mode).alias("send_currencies_used"),
        _distinct("user_receive_currency", mode).alias("receive_currencies_used"),
        F.min("created_at").alias("first_transaction"),
        F.max("created_at").alias("last_transaction"),
        money_sum("user_send_currency_usd").alias("total_volume_usd"))


def recent_transactions(tx: DataFrame, n: int = 5, wallet: str | None = None) -> DataFrame:
    """Latest n rows per wallet.  ``row_number <= n`` is planned as a
    WindowGroupLimit that also runs before the shuffle, so a hot wallet
    contributes at most n rows per map task."""
    cols = ["origin_chain_name", "destination_chain_name", "user_send_currency",
            "user_receive_currency", "user_send_currency_usd"]
    if wallet is not None:
        tx = tx.where(F.col("wallet") == wallet)
    w = Window.partitionBy("wallet").orderBy(
        F.desc_nulls_last("created_at"), *[F.asc_nulls_first(c) for c in cols])
    return (tx.select("wallet", "created_at", *cols)
            .withColumn("recent_rank", F.row_number().over(w))
            .where(F.col("recent_rank") <= n))


def rule_segments(tx: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per-wallet counts and an ordered CASE over the aggregates."""
    agg = tx.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("tx_count"),
        _distinct("origin_chain_name", p.distinct_mode).alias("chains_used"),
        _distinct("user_send_currency", p.distinct_mode).alias("currencies_used"),
        F.min("created_at").alias("first_tx"),
        F.max("created_at").alias("last_tx"),
        avg_money("user_send_currency_usd").alias("avg_tx_size"))
    seg = (F.when(F.col("tx_count") <= p.rule_new_max, RULE_NEW)
           .when(F.col("tx_count") > p.rule_programmatic_min, RULE_PROGRAMMATIC)
           .when(F.col("chains_used") <= p.rule_beginner_max_chains, RULE_BEGINNER)
           .otherwise(RULE_REGULAR))
    return agg.withColumn("user_segment", seg)


def segment_distribution(segments: DataFrame, col: str = "user_segment") -> DataFrame:
    counts = segments.groupBy(col).agg(F.count(F.lit(1)).alias("n_wallets"))
    return share_of_total(counts, "n_wallets", "percentage", 2)


def heavy_wallet_chains(tx: DataFrame, min_tx: int, k: int = 3) -> DataFrame:
    """Wallets with more than ``min_tx`` rows; their top-k origin and
    destination chains side by side, one row per wallet x rank (NULL when a
    wallet has fewer than k chains, and throughout for a NULL wallet).

    One aggregate over the raw rows, on (wallet, origin, destination).
    Everything after it works on those counts inside one wallet
    partitioning: the wallet total drops the light wallets first, then both
    sides are counted per chain, ranked, and gathered by (wallet, rank)."""
    routes = (tx.groupBy("wallet", "origin_chain_name", "destination_chain_name").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("total_tx", F.sum("n").over(Window.partitionBy("wallet")))
              .where(F.col("total_tx") > min_tx))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("chain"))
                      for i, c in enumerate(["origin_chain_name", "destination_chain_name"])])
    counts = (routes.select("wallet", "total_tx", "n", F.explode(sides).alias("s"))
              .groupBy("wallet", "total_tx", "s.side", "s.chain").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("wallet", "side").orderBy(F.desc("n"), F.asc_nulls_first("chain"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # the best chain of a wallet also stands for the ranks it may lack
    ranks = F.when(F.col("rank") == 1, F.sequence(F.lit(1), F.lit(k))).otherwise(F.array("rank"))
    grid = ranked.select("wallet", "total_tx", "side", "chain", "n", F.col("rank").alias("own"), F.explode(ranks).alias("rank"))

    def pick(side: int, c: str) -> Column:
        return F.max(F.when((F.col("side") == side) & (F.col("own") == F.col("rank")) & F.col("wallet").isNotNull(), F.col(c)))

    out = grid.groupBy("wallet", "total_tx", "rank").agg(
        pick(0, "chain").alias("source"), pick(0, "n").alias("source_count"),
        pick(1, "chain").alias("dest"), pick(1, "n").alias("dest_count"))
    return out.select("wallet", "total_tx", F.col("rank").alias("source_rank"), "source", "source_count",
                      F.col("rank").alias("dest_rank"), "dest", "dest_count")


def route_lookup(tx: DataFrame, wallet: str, origin: str, dest: str, n: int = 2) -> DataFrame:
    """fill_tx_hash of one wallet on one route, first n by hash."""
    return (tx.where((F.col("wallet") == wallet) & (F.col("origin_chain_name") == origin)
                     & (F.col("destination_chain_name") == dest))
            .select("fill_tx_hash").orderBy(F.asc_nulls_first("fill_tx_hash")).limit(n))


# ---------------------------------------------------------------------------
# Wallet features (Q9, Q10, M2)
# ---------------------------------------------------------------------------


def _distinct(c: Column | str, mode: str) -> Column:
    """COUNT(DISTINCT c).  The default counts distinct (wallet, value) pairs
    over two shuffles, with bounded memory for any wallet.  ``set`` =
    size(collect_set) takes one shuffle but holds a wallet's whole set in
    one row; it is for columns known to have few values."""
    c = F.col(c) if isinstance(c, str) else c
    if mode == "set":
        return F.size(F.collect_set(c)).cast("bigint")
    return F.countDistinct(c)


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def wallet_features(tx: DataFrame, exclusions, variant: str = "A", p: Params = DEFAULT, store: bool = False) -> DataFrame:
    """Wallet behaviour features.

    Variant A: all rows, NOT EXISTS exclusion, 11 features.  Variant B:
    window ``[window_start, window_end)``, NOT IN exclusion, the 9 business
    features plus four base-10 log columns.  The exclusion comes before the
    grouping; with its list broadcast, listed wallets (the hottest keys)
    never reach the shuffle.  Other rows are dealt by wallet once
    (``functions.distincts``), with ``store`` from a narrow copy that is
    written first: for transactions that are not stored."""
    m = p.distinct_mode
    if variant == "A":
        base = exclude_wallets(tx, exclusions, keep_null=True)
    else:
        base = exclude_wallets(in_window(tx, p.window_start, p.window_end), exclusions,
                               keep_null=False)
    distinct = {"origin_chains": F.col("origin_chain_name"), "dest_chains": F.col("destination_chain_name"),
                "currency_sends": F.col("user_send_currency"), "distinct_routes": F.col("route_source"),
                "unique_days": F.to_date("created_at")}
    sums = {"call_count": _flag(F.col("is_call")), "cross_chain_swaps": _flag(F.col("execution_kind") == KIND_CROSS_CHAIN_SWAP),
            "bridges": _flag(F.col("execution_kind") == KIND_BRIDGE)}
    usd = {"total_send_usd": F.col("user_send_currency_usd")}
    columns = ["origin_chains", "dest_chains", "currency_sends", "call_count", "distinct_routes", "cross_chain_swaps",
               "bridges", "unique_days"]
    if variant == "A":
        sums["deposit_tx_count"] = _flag(F.col("deposit_tx_hash").isNotNull())
        usd["total_receive_usd"] = F.col("user_receive_currency_usd")
        columns.append("deposit_tx_count")
    if m == "set":
        feats = base.groupBy("wallet").agg(*[_distinct(c, m).alias(n) for n, c in distinct.items()],
                                           *[F.sum(c).cast("bigint").alias(n) for n, c in sums.items()],
                                           *[money_sum(c).alias(n) for n, c in usd.items()])
    else:
        feats = distinct_counts(base, "wallet", distinct, sums, usd, p.slice_rows, store)
    feats = feats.select("wallet", *columns, *usd)
    if variant == "A":
        return feats
    return feats.select("*", *[log10_guarded(c).alias(f"{c}_log")
                               for c in ("call_count", "cross_chain_swaps", "bridges", "total_send_usd")])
