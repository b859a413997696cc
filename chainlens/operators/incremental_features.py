"""Wallet features that grow with appended loads.

What variant A's features need from raw rows is kept as two small tables of
mergeable parts: sums per wallet, and distinct (wallet, feature, value)
triples.  Each load adds its own parts under ``load=<name>``; writing a load
again replaces its parts, so a repeated run counts nothing twice.  Features
are read from the parts alone: an append costs the new rows, never a scan
of the old ones, and gives what a full rebuild gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.config import KIND_BRIDGE, KIND_CROSS_CHAIN_SWAP
from chainlens.functions.exprs import flag_sum, money
from chainlens.operators.wallets import exclude_wallets

#: Distinct-count features and the column whose values they count.
DISTINCT = {"origin_chains": "origin_chain_name", "dest_chains": "destination_chain_name", "currency_sends": "user_send_currency",
            "distinct_routes": "route_source", "unique_days": "created_at"}
COUNTS = ["call_count", "cross_chain_swaps", "bridges", "deposit_tx_count"]
MONEY = ["total_send_usd", "total_receive_usd"]


def sums(tx: DataFrame) -> DataFrame:
    return tx.groupBy("wallet").agg(
        flag_sum(F.col("is_call")).alias("call_count"),
        flag_sum(F.col("execution_kind") == KIND_CROSS_CHAIN_SWAP).alias("cross_chain_swaps"),
        flag_sum(F.col("execution_kind") == KIND_BRIDGE).alias("bridges"),
        F.count("deposit_tx_hash").alias("deposit_tx_count"),
        F.sum(money("user_send_currency_usd")).alias("total_send_usd"),
        F.sum(money("user_receive_currency_usd")).alias("total_receive_usd"))


def values(tx: DataFrame) -> DataFrame:
    """Distinct (wallet, feature, value) of non-null values."""
    def text(column: str):
        return (F.to_date(column) if column == "created_at" else F.col(column)).cast("string")

    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), text(c).alias("value")) for k, c in DISTINCT.items()])
    return tx.select("wallet", F.explode(pairs).alias("p")).select("wallet", "p.*").where(F.col("value").isNotNull()).distinct()


def append(tx: DataFrame, exclusions, path: str, load: str) -> None:
    """Add the parts of one load's rows, or replace them."""
    kept = exclude_wallets(tx, exclusions, keep_null=True)
    sums(kept).write.mode("overwrite").parquet(f"{path}/sums/load={load}")
    values(kept).write.mode("overwrite").parquet(f"{path}/values/load={load}")


def features(spark: SparkSession, path: str) -> DataFrame:
    """Variant A features of all loads, from the parts."""
    stored = spark.read.option("basePath", f"{path}/sums").parquet(f"{path}/sums")
    seen = spark.read.option("basePath", f"{path}/values").parquet(f"{path}/values").select("wallet", "feature", "value").distinct()
    counts = seen.groupBy("wallet").agg(*[F.count_if(F.col("feature") == k).alias(k) for k in DISTINCT])
    # united and summed rather than joined: a NULL wallet is a wallet here
    zero = [F.lit(0).cast("long").alias(k) for k in DISTINCT]
    both = stored.select("wallet", *zero, *COUNTS, *MONEY).unionByName(counts, allowMissingColumns=True)
    return both.groupBy("wallet").agg(*[F.sum(c).alias(c) for c in [*DISTINCT, *COUNTS]],
                                      *[F.sum(c).cast("double").alias(c) for c in MONEY])


def compact(spark: SparkSession, path: str, out: str) -> None:
    """All loads as one under another folder: features there are the same, with fewer parts to read."""
    stored = spark.read.parquet(f"{path}/sums")
    merged = stored.groupBy("wallet").agg(*[F.sum(c).cast(stored.schema[c].dataType).alias(c) for c in [*COUNTS, *MONEY]])
    merged.write.mode("overwrite").parquet(f"{out}/sums/load=all")
    spark.read.parquet(f"{path}/values").select("wallet", "feature", "value").distinct().write.mode("overwrite").parquet(f"{out}/values/load=all")
