"""Map the driver's generic tables onto the bridge data model.

One lineitem is one bridge transaction; events become raw competitor
activity.  The mapping is deterministic and mirrored expression for
expression by the SQL oracle.  In production the same jobs read the
ingested transaction table instead (``sources.csv_ingest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.config import (COMPETITOR_RAW_SCHEMA, KIND_BRIDGE,
                              KIND_CROSS_CHAIN_SWAP, TRANSACTION_COLUMNS)

# Exclusion list used with the driver tables.
DRIVER_EXCLUSIONS = [
    ("w0", "aggregator"),
    ("w13", "aggregator"),
    ("w26", "operator"),
    ("w39", "operator"),
    ("w52", "burn"),
]

# Chain aliases used with the driver tables (alias -> name).
DRIVER_ALIASES = {"NATION_1": "NATION_2", "NATION_7": "NATION_8"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bridge_transactions from lineitem x orders x part x supplier.

    Three equi-joins on the TPC keys.  No broadcast is forced: every side
    grows with the scale factor, so AQE picks broadcast only when the
    runtime size of a side is under the threshold and sort-merge otherwise.
    Only the columns used below are read (pruned at the Parquet scan)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey)
         .join(s, li.l_suppkey == s.s_suppkey))
    origin = F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))
    return j.select(
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("wallet"),
        F.when(F.col("l_returnflag") == "A", KIND_BRIDGE)
         .when(F.col("l_returnflag") == "R", KIND_CROSS_CHAIN_SWAP)
         .otherwise("Same chain swap").alias("execution_kind"),
        (F.col("l_linestatus") == "O").alias("is_call"),
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("route_source"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("deposit_tx_hash"),
        origin.alias("origin_chain_name"),
        F.col("p_brand").alias("user_send_currency"),
        F.col("l_quantity").alias("user_send_currency_amount"),
        F.col("l_extendedprice").alias("user_send_currency_usd"),
        F.when(F.col("o_orderpriority") == "5-LOW", origin)
         .otherwise(F.concat(F.lit("NATION_"), (F.col("p_size") % 25).cast("string")))
         .alias("destination_chain_name"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit("-"),
                 F.col("l_partkey").cast("string")).alias("fill_tx_hash"),
        (F.col("l_quantity") * (1 - F.col("l_tax"))).alias("user_receive_currency_amount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("user_receive_currency_usd"),
        F.col("p_type").alias("user_receive_currency"),
    ).select(*TRANSACTION_COLUMNS)


def competitor_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw competitor bridge activity from events (one event = one transfer)."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ev.select(
        F.concat(F.lit("w"), (F.col("user_id") * 13).cast("string")).alias("source_address"),
        F.concat(F.lit("NATION_"), (k % 25).cast("string")).alias("source_chain"),
        F.when(F.col("event_type") == "purchase", "across-v3")
         .when(F.col("event_type") == "click", "dln_debridge")
         .when(F.col("event_type") == "view", "deBridge")
         .otherwise("other").alias("platform"),
        F.concat(F.lit("NATION_"), (F.col("event_id") % 25).cast("string")).alias("destination_chain"),
        F.col("value").alias("amount_usd"),
        F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")).alias("tx_hash"),
        F.col("ts").alias("block_timestamp"),
        F.when(F.col("event_id") % 7 == 0, "inbound").otherwise("outbound").alias("direction"),
        (k % 10 != 0).alias("token_is_verified"),
    ).select(*[f.name for f in COMPETITOR_RAW_SCHEMA.fields])
