"""Rolling volumes: time frames over daily sums.

Raw rows are first added up per wallet and day, partly in the map tasks, so
a wallet has at most one row per calendar day when the window walks it,
however many transactions it made.  Sums are exact decimals: a frame's sum
does not depend on the order of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.exprs import money

SPANS = (7, 30)


def daily_volume(tx: DataFrame) -> DataFrame:
    """(wallet, day, n_tx, usd); rows without wallet or time count nowhere."""
    return (tx.where(F.col("wallet").isNotNull() & F.col("created_at").isNotNull())
            .groupBy("wallet", F.to_date("created_at").alias("day"))
            .agg(F.count("*").alias("n_tx"), F.sum(money("user_send_currency_usd")).alias("usd")))


def rolling_volume(tx: DataFrame, spans: Sequence[int] = SPANS) -> DataFrame:
    """Per wallet and active day: transactions, USD and active days of the
    ``spans`` days that end with it (the day itself included)."""
    order = Window.partitionBy("wallet").orderBy(F.unix_date("day"))
    out = ["wallet", "day", "n_tx", F.col("usd").cast("double").alias("volume_usd")]
    for n in spans:
        frame = order.rangeBetween(-(n - 1), Window.currentRow)
        out += [F.sum("n_tx").over(frame).alias(f"n_tx_{n}d"), F.sum("usd").over(frame).cast("double").alias(f"volume_{n}d_usd"),
                F.count("*").over(frame).alias(f"active_days_{n}d")]
    return daily_volume(tx).select(*out)


def rolling_peaks(rolled: DataFrame, span: int = SPANS[-1]) -> DataFrame:
    """Per wallet: its largest volume within ``span`` days and the first day that reached it."""
    best = F.min(F.struct((-F.col(f"volume_{span}d_usd")).alias("minus"), F.col("day"))).alias("best")
    days = rolled.where(F.col(f"volume_{span}d_usd").isNotNull()).groupBy("wallet").agg(best, F.max(f"n_tx_{span}d").alias("most_tx"))
    return days.select("wallet", F.col("best.day").alias("peak_day"), (-F.col("best.minus")).alias("peak_usd"), "most_tx")
