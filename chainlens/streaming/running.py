"""Tables kept up to date by streams: first usage, loyalty class, daily volume.

First usage and loyalty are running aggregates without a time limit: a row
changes its wallet's result whenever it comes, however late.  Every
micro-batch writes the wallets that it changed under ``batch=<id>``; writing
a batch again replaces its files, and ``current`` takes a wallet's newest
row, so a restarted stream counts nothing twice.  Any split of the input
into batches ends in the table that one batch job gives.

Daily volume closes a day ``delay`` after the greatest time seen so far and
then forgets its state.  A row of a closed day is late: it changes nothing
and is counted by ``late_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainlens.config import DEFAULT, LOYALTY_MULTI, Params
from chainlens.functions.exprs import money
from chainlens.operators.wallets import in_window

#: Columns that order a wallet's rows of one time, as ``first_usage(ties="one")`` does.
FIRST_ORDER = ["created_at", "origin_chain_name", "destination_chain_name", "user_send_currency", "user_send_currency_usd", "is_call"]


def first_rows(tx: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each wallet's first row in the window, as a mergeable aggregate (batch or stream)."""
    base = in_window(tx, p.window_start, p.window_end).where(F.col("wallet").isNotNull())
    g = base.groupBy("wallet").agg(F.min(F.struct(*FIRST_ORDER)).alias("f"))
    call = F.col("f.is_call")
    return g.select(
        "wallet", F.col("f.created_at").alias("first_tx_time"), F.col("f.origin_chain_name").alias("first_source_chain"),
        F.col("f.destination_chain_name").alias("first_dest_chain"), F.col("f.user_send_currency").alias("first_currency"),
        F.col("f.user_send_currency_usd").alias("first_amount_usd"), call.alias("first_is_call"),
        F.when(F.col("f.origin_chain_name") == F.col("f.destination_chain_name"), 1).otherwise(0).alias("first_tx_same_chain"),
        F.when(call, "Call").otherwise("Not Call").alias("first_tx_type"))


def loyalty_rows(usage: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each wallet's loyalty class over usage rows of all platforms; the sets hold platforms and chains, of which there are few."""
    g = usage.groupBy("wallet_").agg(
        *[F.size(F.collect_set(c)).cast("bigint").alias(n) for c, n in
          (("platform_", "n_platforms"), ("source_chain", "n_source_chains"), ("destination_chain", "n_dest_chains"))],
        F.sum(money("amount_usd")).cast("double").alias("total_amount_usd"), F.sum("tx_count").cast("bigint").alias("total_tx_count"))
    kind = F.when(F.col("n_platforms") == 1, p.home_only_label).otherwise(LOYALTY_MULTI)
    return g.select("wallet_", kind.alias("loyalty_type"), "n_platforms", "n_source_chains", "n_dest_chains", "total_amount_usd", "total_tx_count")


def start_running(aggregate: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; the changed rows of each batch go to ``path``."""
    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return (aggregate.writeStream.outputMode("update").foreachBatch(put)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of every key."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (key, "batch")]
    newest = F.max_by(F.struct(*others), "batch").alias("r")  # one row per key and task goes to the shuffle
    return rows.groupBy(key).agg(newest).select(key, "r.*")


def daily_totals(tx: DataFrame, delay: str = "7 days") -> DataFrame:
    """(day, n_tx, usd) of closed days; ``delay`` says when a day closes."""
    return (tx.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day").alias("w"))
            .agg(F.count("*").alias("n_tx"), F.sum(money("user_send_currency_usd")).alias("usd"))
            .select(F.to_date("w.start").alias("day"), "n_tx", F.col("usd").cast("double").alias("volume_usd")))


def start_daily(tx: DataFrame, path: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Append every day once, when it closes."""
    return (daily_totals(tx, delay).writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def late_rows(query: StreamingQuery) -> int:
    """Partial sums of closed days that this run left out (rows of one day and task count once)."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for b in query.recentProgress for op in b["stateOperators"])
