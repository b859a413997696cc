"""Distinct counts per key by one shuffle, hot keys apart."""
import re

import pytest
from pyspark.sql import functions as F

from core_helpers import tx_rows

from chainlens.config import DEFAULT
from chainlens.functions import distincts as DC
from chainlens.operators import loyalty as L
from chainlens.operators import wallets as W


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_rows(n=600):
    out = []
    for i in range(n):
        w = None if i % 17 == 0 else "hot" if i % 3 == 0 else f"w{i % 40}"
        out.append(dict(created_at=None if i % 19 == 0 else f"2000-01-{1 + i % 28:02d}", wallet=w, execution_kind=["Bridge", "Cross chain swap", None][i % 3],
                        is_call=[True, False, None][i % 3], origin_chain_name=None if i % 23 == 0 else f"c{i % 7}", destination_chain_name=f"c{i % 5}",
                        user_send_currency=f"t{i % 11}", route_source=None if i % 2 else f"r{i % 4}", deposit_tx_hash=None if i % 13 == 0 else str(i),
                        user_send_currency_usd=None if i % 29 == 0 else i / 8, user_receive_currency_usd=1.0))
    return out + out[:50]


@pytest.mark.parametrize("bound", [10, 2_000_000])
@pytest.mark.parametrize("variant", ["A", "B"])
@pytest.mark.parametrize("few", [0, 1_000_000])
def test_features_hot_and_cold(spark, monkeypatch, bound, variant, few):
    monkeypatch.setattr(DC, "FEW_ROWS", few)
    tx = tx_rows(spark, some_rows()).repartition(5)
    got = W.wallet_features(tx, [("w1", "x")], variant, DEFAULT.with_(slice_rows=bound))
    want = W.wallet_features(tx, [("w1", "x")], variant, DEFAULT.with_(distinct_mode="set"))
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_features_deal_rows_once(spark):
    """No Expand, and no exchange but the one by wallet and those of broadcasts."""
    plan = plan_of(W.wallet_features(tx_rows(spark, some_rows()), [("w1", "x")], "A", DEFAULT))
    assert "Expand" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1


@pytest.mark.parametrize("bound", [10, 2_000_000])
def test_loyalty_hot_and_cold(spark, bound):
    p = DEFAULT.with_(slice_rows=bound)
    tx = tx_rows(spark, some_rows()).repartition(5)
    home = L.home_route_usage(tx, [("w1", "x")], p)
    base = tx.where("wallet <> 'w1' AND created_at >= '1996-01-01'")
    want = base.groupBy("wallet", "origin_chain_name", "destination_chain_name").agg(F.sum("user_send_currency_usd"), F.count("*"))
    assert sorted(map(repr, map(tuple, home.drop("platform_").collect()))) == sorted(map(repr, map(tuple, want.collect())))
    other = home.limit(20).withColumn("platform_", F.lit("across-v3"))
    agg = home.unionByName(other).cache()
    got = L.loyalty_class(agg, p)
    want = agg.groupBy("wallet_").agg(F.countDistinct("platform_"), F.countDistinct("source_chain"), F.countDistinct("destination_chain"),
                                      F.sum("amount_usd"), F.sum("tx_count"))
    assert sorted(map(repr, map(tuple, got.drop("loyalty_type").collect()))) == sorted(map(repr, map(tuple, want.collect())))
    if bound > 10:
        assert len(re.findall("Exchange hashpartitioning", plan_of(got).split("InMemoryRelation")[0])) == 1
