"""Streams that keep tables up to date: any split of the input gives the batch table; late rows."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from core_helpers import tx_rows

from chainlens.config import DEFAULT, TRANSACTION_SCHEMA
from chainlens.operators import first_use as FU
from chainlens.operators import loyalty as L
from chainlens.streaming import running as RN

P = DEFAULT.with_(window_start="2025-01-01")
USAGE = "wallet_ string, source_chain string, platform_ string, destination_chain string, amount_usd double, tx_count long"


def some_rows(n=120):
    r = random.Random(0)
    return [{"wallet": "hot" if i % 3 == 0 else f"w{r.randint(0, 9)}", "created_at": dt.datetime(2025, 1, 1) + dt.timedelta(hours=r.randint(-20, 300)),
             "origin_chain_name": r.choice("ab"), "destination_chain_name": r.choice("ab"), "user_send_currency": r.choice(["USDC", "ETH"]),
             "user_send_currency_usd": float(r.randint(1, 50)), "is_call": r.choice([True, False])} for i in range(n)]


@pytest.mark.parametrize("cuts", [[120], [40, 80], [5, 10, 60, 61]])
def test_first_usage_for_any_split(spark, tmp_dir, cuts):
    rows = some_rows()
    want = {tuple(r) for r in FU.first_usage(tx_rows(spark, rows), [], P, ties="one").collect()}
    at = 0
    for cut in [*cuts, len(rows)]:
        if cut > at:
            tx_rows(spark, rows[at:cut]).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
            stream = spark.readStream.schema(TRANSACTION_SCHEMA).parquet(f"{tmp_dir}/in")
            RN.start_running(RN.first_rows(stream, P), f"{tmp_dir}/out", f"{tmp_dir}/ckpt").awaitTermination()
        at = cut
    got = RN.current(spark, f"{tmp_dir}/out", "wallet")
    assert {tuple(r) for r in got.collect()} == want and len(want) == 11
    assert {tuple(r) for r in RN.first_rows(tx_rows(spark, rows), P).collect()} == want  # the same aggregate in one batch


def test_loyalty_for_two_splits(spark, tmp_dir):
    r = random.Random(1)
    rows = [(f"w{r.randint(0, 9)}", r.choice("ab"), r.choice(["home", "home", "across-v3"]), r.choice("ab"), r.randint(1, 99) / 4, r.randint(1, 3)) for _ in range(60)]
    want = {tuple(x) for x in L.loyalty_class(spark.createDataFrame(rows, USAGE), P).collect()}
    for name, cuts in (("one", [60]), ("three", [7, 8, 60])):
        at = 0
        for cut in cuts:
            spark.createDataFrame(rows[at:cut], USAGE).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/{name}/in")
            stream = spark.readStream.schema(USAGE).parquet(f"{tmp_dir}/{name}/in")
            RN.start_running(RN.loyalty_rows(stream, P), f"{tmp_dir}/{name}/out", f"{tmp_dir}/{name}/ckpt").awaitTermination()
            at = cut
        assert {tuple(x) for x in RN.current(spark, f"{tmp_dir}/{name}/out", "wallet_").collect()} == want


def test_late_rows_of_daily_volume(spark, tmp_dir):
    def load(days):
        rows = [{"wallet": "w", "created_at": dt.datetime(2025, 1, d, 12), "user_send_currency_usd": 1.0} for d in days]
        tx_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
        stream = spark.readStream.schema(TRANSACTION_SCHEMA).parquet(f"{tmp_dir}/in")
        q = RN.start_daily(stream, f"{tmp_dir}/out", f"{tmp_dir}/ckpt", "2 days")
        q.awaitTermination()
        return RN.late_rows(q)

    assert load([1, 2, 20]) == 0         # days 1 and 2 close
    assert load([19, 20]) == 0           # late, but their days are still open
    assert load([2, 30]) == 1            # a row of a closed day changes nothing and is counted
    got = {r.day.day: (r.n_tx, r.volume_usd) for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 19: (1, 1.0), 20: (2, 2.0)}
