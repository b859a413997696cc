"""Plan-shape checks: the properties the scale design relies on."""
import pytest

from core_helpers import SF001, tx_rows

from chainlens.config import DEFAULT
from chainlens.operators import wallets as W
from chainlens.plans import catalog

Q = catalog.queries()
FITS = {"pca_variance_a", "pca_loadings_a", "pca_variance", "pca_loadings", "pca_scores", "kmeans_sweep", "kmeans_assign"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q) - FITS))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = plan_of(Q[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["first_usage", "recent_transactions", "cluster_sample"])
def test_group_limits_run_map_side(spark, name):
    if name == "first_usage":  # stored; the plan is that of its writing
        from chainlens.operators.first_use import first_usage
        i = catalog.Inputs(spark, SF001)
        plan = plan_of(first_usage(i.kept, i.exclusions))
    else:
        plan = plan_of(Q[name](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_exclusion_comes_before_the_shuffle(spark):
    tx = tx_rows(spark, [dict(wallet=f"w{i}", is_call=True) for i in range(50)])
    plan = plan_of(W.wallet_features(tx, [("w1", "x")], "A", DEFAULT))
    assert plan.index("hashpartitioning(wallet") < plan.index("LeftAnti")  # printed from the top down


def test_exclusion_lists_of_any_size(spark):
    tx = tx_rows(spark, [dict(wallet=f"w{i % 40}") for i in range(400)] + [dict(wallet=None)])
    long = [f"w{i}" for i in range(10)] + [f"z{i}" for i in range(200_000)]
    for keep_null, n in ((True, 301), (False, 300)):
        sizes = {W.exclude_wallets(tx, x, keep_null=keep_null).count()
                 for x in (long[:10], long, spark.createDataFrame([(w,) for w in long[:10]], "wallet string"))}
        assert sizes == {n}
    assert W.exclude_wallets(tx, []).count() == 401
    got = W.exclusion_impact(tx, spark.createDataFrame([("w1", "a"), ("zz", "a"), ("w2", None)], "wallet string, reasoning string"))
    assert {r.reasoning: (r.wallets_listed, r.wallets_found, r.rows_removed) for r in got.collect()} == {"a": (2, 1, 10), None: (1, 1, 10)}


def test_money_is_exact_and_never_fails(spark):
    rows = [dict(wallet="small", user_send_currency_usd=0.004)] * 1000 + [dict(wallet="large", user_send_currency_usd=2e16)]
    rows += [dict(wallet="beyond", user_send_currency_usd=1e25), dict(wallet="beyond", user_send_currency_usd=1.5)]
    tx = tx_rows(spark, rows)
    got = {r.wallet: r.total_send_usd for r in W.wallet_features(tx, [], "A", DEFAULT).collect()}
    assert got == {"small": 4.0, "large": 2e16, "beyond": 1.5}
    rejects = {r.column_name: (r.n_amounts, r.n_rejected) for r in W.money_rejects(tx).collect()}
    assert rejects["user_send_currency_usd"] == (1003, 1)


def test_quantiles_keep_rows_in_place(spark):
    """No exchange but those of aggregates: the exploded rows are never dealt by group."""
    import re

    from chainlens.functions.quantiles import exact_quantiles_wide
    df = spark.range(1000).selectExpr("id % 3 AS g", "cast(id AS double) AS a", "cast(id * id AS double) AS b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        q = exact_quantiles_wide(df, ["g"], ["a", "b"], [0.5])
        plan = plan_of(q)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning", line) and "__x" not in line:
            assert "Generate" not in lines[i + 1], lines[i:i + 2]
    assert [(r.g, r.a_q0) for r in q.orderBy("g").collect()] == [(0, 499.5), (1, 499.0), (2, 500.0)]


def test_hot_wallet_third_of_rows(spark):
    """One wallet with a third of all rows: features equal a brute-force count."""
    rows = []
    for i in range(900):
        w = "hot" if i % 3 == 0 else f"w{i % 50}"
        rows.append(dict(created_at=f"2025-01-{1 + i % 28:02d}", wallet=w, execution_kind="Bridge",
                         is_call=i % 2 == 0, origin_chain_name=f"c{i % 7}", destination_chain_name=f"d{i % 5}",
                         user_send_currency=f"t{i % 11}", route_source=f"r{i % 4}", deposit_tx_hash=str(i),
                         user_send_currency_usd=1.25, user_receive_currency_usd=1.0))
    tx = tx_rows(spark, rows).repartition(7)
    for mode in ("set", "exact"):
        f = {r.wallet: r for r in W.wallet_features(tx, [], "A", DEFAULT.with_(distinct_mode=mode)).collect()}
        hot = [r for r in rows if r["wallet"] == "hot"]
        assert f["hot"].deposit_tx_count == 300 == len(hot)
        assert f["hot"].origin_chains == len({r["origin_chain_name"] for r in hot})
        assert f["hot"].currency_sends == len({r["user_send_currency"] for r in hot})
        assert f["hot"].unique_days == len({r["created_at"] for r in hot})
        assert f["hot"].call_count == sum(r["is_call"] for r in hot)
        assert f["hot"].total_send_usd == 375.0
    fu = W.recent_transactions(tx, 3)
    assert fu.where("wallet = 'hot'").count() == 3


def test_persona_join_uses_buckets(spark):
    """features x assignments read co-located buckets: no exchange above
    either bucketed scan."""
    from chainlens.plans import catalog as C
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        i = C.Inputs(spark, SF001)
        plan = plan_of(C.features_b_table(i).join(C.assigned(i), "wallet"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
