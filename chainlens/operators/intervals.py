"""Interval joins: points in intervals, and intervals that overlap.

Time is divided into bins.  An interval lies in every bin it meets, a point
in one; both sides join on their keys and the bin, an equi-join, and the
exact condition filters within a bin.  Two intervals may share many bins;
the pair is kept in the bin where the later of the two begins.  Intervals
are [start, end); empty ones, and NULL ends or times, match nothing.

A bin that holds a large part of all points is dealt over ``SALTS`` parts:
points take one by their content, intervals are in all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.exprs import micros, money, money_sum

#: Parts of a bin.
SALTS = 8
DAY = 86_400


def _bin(ts: Column, width: int) -> Column:
    return F.floor(micros(ts) / (width * 1_000_000))


def _bins(start: Column, end: Column, width: int) -> Column:
    """Every bin that [start, end) meets."""
    last = F.floor((micros(end) - 1) / (width * 1_000_000))
    return F.when(start < end, F.sequence(_bin(start, width), last))


def points_in_intervals(points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, keys: Sequence[str] = (),
                        bin_seconds: int = DAY) -> DataFrame:
    """All columns of both sides for every point and every interval that holds it.

    ``keys`` are columns of both sides (the points' are kept); other columns
    need different names."""
    p = points.where(F.col(ts).isNotNull()).select(
        "*", _bin(F.col(ts), bin_seconds).alias("_bin"), F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).alias("_salt"))
    spread = intervals.select("*", F.explode(_bins(F.col(start), F.col(end), bin_seconds)).alias("_bin"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    met = p.join(spread, [*keys, "_bin", "_salt"]).where((F.col(start) <= F.col(ts)) & (F.col(ts) < F.col(end)))
    return met.drop("_bin", "_salt")


def overlapping_intervals(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str],
                          keys: Sequence[str] = (), bin_seconds: int = DAY) -> DataFrame:
    """All columns of both sides for every pair of intervals that overlap, once."""
    (ls, le), (rs, re_) = ([F.col(c) for c in span] for span in (left_span, right_span))
    a = left.select("*", F.explode(_bins(ls, le, bin_seconds)).alias("_bin"))
    b = right.select("*", F.explode(_bins(rs, re_, bin_seconds)).alias("_bin"))
    met = a.join(b, [*keys, "_bin"]).where((ls < re_) & (rs < le) & (F.col("_bin") == F.greatest(_bin(ls, bin_seconds), _bin(rs, bin_seconds))))
    return met.drop("_bin")


def campaigns(tx: DataFrame, per_chain: int = 3, days: int = 14) -> DataFrame:
    """(chain, campaign, starts, ends): ``days`` days from each origin chain's days of most volume."""
    day = F.to_date("created_at")
    daily = (tx.where(F.col("created_at").isNotNull() & F.col("origin_chain_name").isNotNull())
             .groupBy(F.col("origin_chain_name").alias("chain"), day.alias("day")).agg(F.sum(money("user_send_currency_usd")).alias("usd")))
    best = Window.partitionBy("chain").orderBy(F.desc_nulls_last("usd"), "day")
    top = daily.withColumn("campaign", F.row_number().over(best)).where(F.col("campaign") <= per_chain)
    starts = F.col("day").cast("timestamp")
    return top.select("chain", "campaign", starts.alias("starts"), F.date_add("day", days).cast("timestamp").alias("ends"))


def campaign_volume(tx: DataFrame, running: DataFrame) -> DataFrame:
    """Transactions, wallets and volume from a campaign's chain while it runs."""
    points = tx.select("wallet", "created_at", F.col("origin_chain_name").alias("chain"), "user_send_currency_usd")
    met = points_in_intervals(points, running, "created_at", "starts", "ends", ["chain"])
    return met.groupBy("chain", "campaign", "starts", "ends").agg(
        F.count("*").alias("n_tx"), F.countDistinct("wallet").alias("wallets"), money_sum("user_send_currency_usd").alias("volume_usd"))


def campaign_sessions(found: DataFrame, running: DataFrame) -> DataFrame:
    """Sessions that overlap each campaign, whatever their chains: how busy the platform was."""
    # a session of one moment lasts until just after it
    s = found.select("wallet", "session_start", F.timestamp_micros(micros("session_end") + 1).alias("session_over"), "n_tx")
    met = overlapping_intervals(s, running, ("session_start", "session_over"), ("starts", "ends"), bin_seconds=7 * DAY)
    return met.groupBy("chain", "campaign").agg(F.count("*").alias("n_sessions"), F.countDistinct("wallet").alias("wallets"), F.sum("n_tx").alias("n_tx"))
