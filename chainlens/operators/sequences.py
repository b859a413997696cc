"""Event sequences per wallet: as-of joins, matched return trips, sessions.

All three walk a wallet's events in order of time.  Hot wallets are walked
slice by slice (``functions.slices``); what a slice hands to the next one is
computed from one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.config import KIND_BRIDGE, KIND_CROSS_CHAIN_SWAP
from chainlens.functions.exprs import micros, money, money_sum
from chainlens.functions.slices import HOT, SLICE, SLICE_ROWS, hot_slices, ranked, with_slice

DAY_US = 86_400_000_000


def _pair(x: str | tuple[str, str]) -> tuple[str, str]:
    return (x, x) if isinstance(x, str) else x


def as_of(left: DataFrame, right: DataFrame, by: str | tuple[str, str], ts: str | tuple[str, str], take: Sequence[str],
          prefix: str = "prev_", strict: bool = True, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every row of ``left`` with the columns ``take`` of the latest row of
    ``right`` that has its key and an earlier time (or the same one, with
    ``strict`` off); NULLs where there is none.

    Both streams are united and walked in order once: one shuffle of each
    side, no inequality join.  Of right rows at one time the greatest by
    ``take`` counts; rows with a NULL key or time find nothing and are not
    found."""
    (lb, rb), (lt, rt) = _pair(by), _pair(ts)
    ours = left.select(F.col(lb).alias("_by"), F.col(lt).alias("_ts"), F.lit(0 if strict else 1).alias("_side"),
                       F.struct(*left.columns).alias("_left"))
    theirs = right.where(F.col(rb).isNotNull() & F.col(rt).isNotNull()).select(
        F.col(rb).alias("_by"), F.col(rt).alias("_ts"), F.lit(1 if strict else 0).alias("_side"), F.struct(*take).alias("_right"))
    events = ours.unionByName(theirs, allowMissingColumns=True)
    hot = hot_slices(events, ["_by"], "_ts", slice_rows)
    events = with_slice(events, hot, ["_by"], "_ts")
    so_far = (Window.partitionBy("_by", SLICE).orderBy(F.asc_nulls_first("_ts"), "_side", F.asc_nulls_first("_right"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = events.withColumn("_found", F.last("_right", ignorenulls=True).over(so_far)).where(F.col("_left").isNotNull())
    if hot is not None:
        last = F.max(F.when(F.col("_right").isNotNull(), F.struct("_ts", "_right"))).alias("_end")
        ends = events.where(HOT).groupBy("_by", SLICE).agg(last)
        before = Window.partitionBy("_by").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("_by", SLICE, F.last("_end._right", ignorenulls=True).over(before).alias("_carried"))
        # ``found`` lies by key and slice already, so this join moves the small side alone
        found = found.join(carried, ["_by", SLICE], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select("_left.*", *[F.col(f"_found.{c}").alias(prefix + c) for c in take])


def home_before_competitor(competitor: DataFrame, home: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each competitor transfer with the wallet's latest home transaction before it."""
    moves = competitor.select(F.col("source_address").alias("wallet"), "block_timestamp", "platform", "source_chain",
                              "destination_chain", "amount_usd", "tx_hash")
    take = ["created_at", "origin_chain_name", "destination_chain_name", "user_send_currency_usd"]
    out = as_of(moves, home, "wallet", ("block_timestamp", "created_at"), take, "home_", slice_rows=slice_rows)
    return out.withColumn("days_since_home", F.datediff("block_timestamp", "home_created_at").cast("bigint"))


def bridge_after_swap(tx: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each bridge transaction with the wallet's latest cross-chain swap before it."""
    bridges = tx.where(F.col("execution_kind") == KIND_BRIDGE).select(
        "wallet", "created_at", "deposit_tx_hash", "origin_chain_name", "user_send_currency_usd")
    swaps = tx.where(F.col("execution_kind") == KIND_CROSS_CHAIN_SWAP)
    take = ["created_at", "destination_chain_name", "user_receive_currency", "deposit_tx_hash"]
    out = as_of(bridges, swaps, "wallet", "created_at", take, "swap_", slice_rows=slice_rows)
    return out.withColumn("from_swap_chain", F.col("swap_destination_chain_name") == F.col("origin_chain_name"))


def return_trips(tx: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per trip: a transaction A -> B and the wallet's next unused B -> A.

    Transactions of a route are used first in, first out, so trips are open
    in one direction at a time, and the n-th A -> B always meets the n-th
    B -> A: the earlier of the two is the way out.  Numbering each direction
    is thus all that matching takes; the two meet by (wallet, pair of
    chains, n), a key that no wallet repeats.  At one time, the way out is
    the one from the chain that comes first by name."""
    rows = tx.where(F.col("wallet").isNotNull() & F.col("created_at").isNotNull()
                    & (F.col("origin_chain_name") != F.col("destination_chain_name"))).select(
        "wallet", "created_at", "origin_chain_name", "destination_chain_name", "deposit_tx_hash", "user_send_currency_usd")
    ends = ["origin_chain_name", "destination_chain_name"]
    rows = rows.select("wallet", "created_at", "deposit_tx_hash", "user_send_currency_usd", F.least(*ends).alias("a"), F.greatest(*ends).alias("b"),
                       (F.col(ends[0]) < F.col(ends[1])).alias("forward"))
    # both directions are dealt together, so they meet where they were numbered
    n = ranked(rows, ["wallet", "a", "b", "forward"], "created_at", ["deposit_tx_hash", "user_send_currency_usd"], "n", slice_rows, ["wallet", "a", "b"])
    leg = F.struct(F.col("created_at").alias("time"), F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")).alias("chain"),
                   F.col("deposit_tx_hash").alias("tx"), F.col("user_send_currency_usd").alias("usd"))
    legs = n.select("wallet", "a", "b", "n", leg.alias("leg"))
    met = legs.groupBy("wallet", "a", "b", "n").agg(F.min("leg").alias("out"), F.max("leg").alias("back"), F.count("*").alias("legs"))
    return met.where(F.col("legs") == 2).select(
        "wallet", F.col("out.chain").alias("chain_a"), F.col("back.chain").alias("chain_b"),
        F.col("out.time").alias("out_time"), F.col("back.time").alias("back_time"),
        ((micros("back.time") - micros("out.time")) / DAY_US).alias("days_away"),
        F.col("out.usd").alias("out_usd"), F.col("back.usd").alias("back_usd"),
        F.col("out.tx").alias("out_tx"), F.col("back.tx").alias("back_tx"))


def trip_routes(trips: DataFrame) -> DataFrame:
    """Per route out: trips, wallets, days away and USD both ways."""
    return trips.groupBy("chain_a", "chain_b").agg(
        F.count("*").alias("trips"), F.countDistinct("wallet").alias("wallets"),
        F.round(F.avg("days_away"), 4).alias("mean_days_away"), F.min("days_away").alias("least_days_away"),
        F.max("days_away").alias("most_days_away"), money_sum("out_usd").alias("out_usd"), money_sum("back_usd").alias("back_usd"))


def sessions(tx: DataFrame, gap_days: float, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sessions of each wallet: runs of transactions with at most
    ``gap_days`` between one and the next.

    Sessions are closed within a slice; only the first and last of each
    slice of a hot wallet can go on in a neighbour, and these few are joined
    by the same rule.  Rows without wallet or time belong to no session."""
    gap = int(gap_days * DAY_US)
    rows = tx.where(F.col("wallet").isNotNull() & F.col("created_at").isNotNull()).select(
        "wallet", "created_at", money("user_send_currency_usd").alias("usd"))
    hot = hot_slices(rows, ["wallet"], "created_at", slice_rows)
    order = Window.partitionBy("wallet", SLICE).orderBy("created_at")

    def begins(start: str, end: str, w) -> F.Column:
        return F.coalesce((micros(start) - micros(F.lag(end).over(w)) > gap).cast("int"), F.lit(1))

    numbered = (with_slice(rows, hot, ["wallet"], "created_at").withColumn("_new", begins("created_at", "created_at", order))
                .withColumn("_no", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))))
    closed = numbered.groupBy("wallet", SLICE, HOT, "_no").agg(
        F.min("created_at").alias("session_start"), F.max("created_at").alias("session_end"), F.count("*").alias("n_tx"), F.sum("usd").alias("usd"))
    columns = ["wallet", "session_start", "session_end", "n_tx", "usd"]
    out = closed.where(~F.col(HOT)).select(*columns)
    if hot is not None:
        mine = closed.where(HOT).withColumn("_last", F.max("_no").over(Window.partitionBy("wallet", SLICE)))
        at_border = (F.col("_no") == 1) | (F.col("_no") == F.col("_last"))
        border = mine.where(at_border).select(*columns)  # two rows a slice
        w = Window.partitionBy("wallet").orderBy("session_start")
        joined = (border.withColumn("_new", begins("session_start", "session_end", w))
                  .withColumn("_no", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
                  .groupBy("wallet", "_no").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
                                                F.sum("n_tx").alias("n_tx"), F.sum("usd").alias("usd")).select(*columns))
        out = out.unionByName(mine.where(~at_border).select(*columns)).unionByName(joined)
    return out.select("wallet", "session_start", "session_end", "n_tx", F.col("usd").cast("double").alias("volume_usd"),
                      ((micros("session_end") - micros("session_start")) / DAY_US).alias("days"))


def session_summary(found: DataFrame) -> DataFrame:
    """Per wallet: sessions, transactions, the longest session and mean transactions a session."""
    return found.groupBy("wallet").agg(
        F.count("*").alias("n_sessions"), F.sum("n_tx").alias("n_tx"), F.max("days").alias("longest_days"),
        F.max("n_tx").alias("most_tx"), F.round(F.sum("n_tx") / F.count("*"), 4).alias("mean_tx"),
        F.min("session_start").alias("first_session"), F.max("session_end").alias("last_seen"))
