"""Mergeable distinct counts: HyperLogLog sketches with rollups.

One pass over raw rows stores a sketch of the wallets per chain, kind and
month.  Any coarser question (a chain over all months, a month over all
chains, everything) unites stored sketches and reads no raw row; sketches of
later months are appended and united the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers: a standard error of 0.41 % in at most 64 KiB; small sets are kept exactly.
LG_K = 16
GRAIN = ("origin_chain_name", "execution_kind", "month")


def wallet_sketches(tx: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(chain, kind, month, n_tx, sketch)."""
    return tx.withColumn("month", F.date_format("created_at", "yyyy-MM")).groupBy(*GRAIN).agg(
        F.count("*").alias("n_tx"), F.hll_sketch_agg("wallet", lg_k).alias("sketch"))


def reach(sketches: DataFrame, *levels: str) -> DataFrame:
    """Transactions and estimated wallets of every combination of ``levels``
    and of its totals (cube), from stored sketches alone; ``level`` is the
    grouping id that tells a total from a NULL key."""
    return sketches.cube(*levels).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n_tx").alias("n_tx"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("wallets_estimate"))


def reach_check(tx: DataFrame, sketches: DataFrame, *levels: str, bound: float = 0.02) -> DataFrame:
    """Exact wallets beside whether the sketches' estimate is within ``bound`` of them."""
    exact = tx.withColumn("month", F.date_format("created_at", "yyyy-MM")).cube(*levels).agg(
        F.grouping_id().cast("int").alias("level"), F.countDistinct("wallet").alias("wallets"))
    e = exact.withColumnsRenamed({c: f"_{c}" for c in (*levels, "level")})
    cond = F.col("level") == F.col("_level")
    for c in levels:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    off = F.abs(F.col("wallets_estimate") - F.col("wallets")) <= F.lit(bound) * F.col("wallets")
    return reach(sketches, *levels).join(e, cond).select(*levels, "level", "n_tx", "wallets", off.alias("within_bound"))
