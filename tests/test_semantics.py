"""One test per semantic trap (NULLs, ties, logs, signs, rule order)."""
import math

from pyspark.sql import functions as F

from core_helpers import tx_rows

from chainlens.config import DEFAULT, PERSONA_OTHER, PERSONA_POSITIVE, PERSONA_TOP
from chainlens.operators import features as FE
from chainlens.operators import first_use as FU
from chainlens.operators import loyalty as L
from chainlens.operators import personas as P
from chainlens.operators import reports as R
from chainlens.operators import wallets as W

P0 = DEFAULT.with_(window_start="2025-01-01")
EXCL = [("bad", "burn")]


def base_rows():
    return [
        dict(created_at="2025-01-02 10:00:00", wallet="a", execution_kind="Bridge", is_call=True,
             deposit_tx_hash="h1", origin_chain_name="base", destination_chain_name="zora",
             user_send_currency="USDC", user_send_currency_usd=10.0, user_receive_currency_usd=9.9),
        dict(created_at="2025-01-02 10:00:00", wallet="a", execution_kind="Cross chain swap", is_call=None,
             deposit_tx_hash=None, origin_chain_name="bsc", destination_chain_name="base",
             user_send_currency="ETH", user_send_currency_usd=20.0, user_receive_currency_usd=19.0),
        dict(created_at="2025-01-05 10:00:00", wallet="a", execution_kind="Bridge", is_call=False,
             deposit_tx_hash="h3", origin_chain_name="base", destination_chain_name="base",
             user_send_currency="USDC", user_send_currency_usd=5.0, user_receive_currency_usd=5.0),
        dict(created_at=None, wallet="b", execution_kind="Bridge", is_call=False,
             deposit_tx_hash="h4", origin_chain_name="base", destination_chain_name="base",
             user_send_currency="USDC", user_send_currency_usd=1.0),
        dict(created_at="2024-12-31 23:59:59", wallet="b", execution_kind="Bridge", is_call=True,
             deposit_tx_hash="h5", origin_chain_name="eth", destination_chain_name="base",
             user_send_currency="USDC", user_send_currency_usd=2.0),
        dict(created_at="2025-02-01 00:00:00", wallet=None, execution_kind="Bridge", is_call=True,
             deposit_tx_hash="h6", origin_chain_name="eth", destination_chain_name="base",
             user_send_currency="USDC", user_send_currency_usd=3.0),
        dict(created_at="2025-02-01 00:00:00", wallet="bad", execution_kind="Bridge", is_call=True,
             deposit_tx_hash="h7", origin_chain_name="eth", destination_chain_name="base",
             user_send_currency="USDC", user_send_currency_usd=3.0),
    ]


def test_null_time_kept_by_retention_dropped_by_window(spark):
    tx = tx_rows(spark, base_rows())
    kept = W.retain_from(tx, "2025-01-01")
    assert kept.where(F.col("created_at").isNull()).count() == 1
    assert kept.where(F.col("wallet") == "b").count() == 1
    rc = W.retention_counts(tx, "2025-01-01").first()
    assert (rc.rows_before, rc.rows_deleted, rc.rows_after) == (7, 1, 6)
    fb = {r.wallet: r for r in W.wallet_features(tx, EXCL, "B", P0).collect()}
    assert "b" not in fb  # only a NULL-time row and a 2024 row


def test_not_exists_keeps_null_wallet_not_in_drops_it(spark):
    tx = tx_rows(spark, base_rows())
    fa = {r.wallet for r in W.wallet_features(tx, EXCL, "A", P0).collect()}
    fb = {r.wallet for r in W.wallet_features(tx, EXCL, "B", P0).collect()}
    assert None in fa and "bad" not in fa
    assert None not in fb and "bad" not in fb


def test_features_count_semantics(spark):
    tx = tx_rows(spark, base_rows())
    a = [r for r in W.wallet_features(tx, EXCL, "A", P0).collect() if r.wallet == "a"][0]
    assert a.call_count == 1          # NULL is_call counts as not a call
    assert a.deposit_tx_count == 2    # COUNT(col) skips the NULL hash
    assert a.unique_days == 2 and a.origin_chains == 2 and a.dest_chains == 2
    assert a.bridges == 2 and a.cross_chain_swaps == 1
    assert a.total_send_usd == 35.0
    exact = [r for r in W.wallet_features(tx, EXCL, "A", P0.with_(distinct_mode="exact")).collect()
             if r.wallet == "a"][0]
    assert exact == a


def test_first_use_keeps_ties(spark):
    tx = tx_rows(spark, base_rows())
    fu = FU.first_usage(tx, EXCL, P0)
    assert fu.where(F.col("wallet") == "a").count() == 2
    one = FU.first_usage(tx, EXCL, P0, ties="one")
    assert one.where(F.col("wallet") == "a").count() == 1
    types = {r.first_tx_type for r in fu.where(F.col("wallet") == "a").collect()}
    assert types == {"Call", "Not Call"}  # NULL is_call -> Not Call


def test_log_transforms(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (None,), (100.0,)], "x double")
    out = [r[0] for r in df.select(F.round(W.log10_guarded("x"), 6)).collect()]
    assert out[:2] == [0.0, 0.0] and out[2] < 0 and out[3] == 0.0 and out[4] == 2.0
    from chainlens.functions.exprs import log1p_filled
    assert [r[0] for r in df.select(log1p_filled("x")).collect()][3] == 0.0


def test_pca_sign_rule():
    comps = [[-0.7, 0.1, 0.2], [0.3, -0.3, 0.1]]
    fixed = P.sign_fixed(comps)
    assert fixed[0] == [0.7, -0.1, -0.2]
    assert fixed[1] == [0.3, -0.3, 0.1]  # tie on magnitude: first feature decides


def test_scaler_constant_column_is_zero(spark):
    df = spark.createDataFrame([("w1", 5.0, 1.0), ("w2", 5.0, 3.0)], "wallet string, c double, v double")
    out = {r.wallet: r for r in FE.standardize(df, ["c", "v"]).collect()}
    assert out["w1"].c == 0.0 and out["w2"].c == 0.0
    assert math.isclose(out["w1"].v, -1.0) and math.isclose(out["w2"].v, 1.0)  # population std


def test_persona_rule_by_pc1(spark):
    a = spark.createDataFrame([(0, -1.0, 0.0, 0.0), (1, -0.5, 0.0, 0.0), (2, -3.0, 0.0, 0.0)],
                              "cluster_id int, PC1 double, PC2 double, PC3 double")
    lab = {r.cluster_id: r.persona for r in P.persona_labels(a).collect()}
    assert lab == {1: PERSONA_TOP, 0: PERSONA_OTHER, 2: PERSONA_OTHER}
    b = a.withColumn("PC1", -F.col("PC1"))
    lab = {r.cluster_id: r.persona for r in P.persona_labels(b).collect()}
    assert lab == {2: PERSONA_TOP, 0: PERSONA_POSITIVE, 1: PERSONA_POSITIVE}


def test_nearest_centroid_ties_lowest_id(spark):
    s = spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 0.0, 0.0)], "PC1 double, PC2 double, PC3 double")
    out = [r.cluster_id for r in P.nearest_centroid(s, [(1.0, 0, 0), (-1.0, 0, 0), (2.0, 0, 0)]).collect()]
    assert out == [0, 2]


def test_rule_segment_order(spark):
    rows = []
    for i in range(3):   # 3 tx, 1 chain -> new beats beginner
        rows.append(dict(created_at="2025-01-01", wallet="new", origin_chain_name="c0", user_send_currency_usd=1.0))
    for i in range(10):  # 10 tx on 10 chains -> programmatic beats beginner
        rows.append(dict(created_at="2025-01-01", wallet="prog", origin_chain_name=f"c{i}", user_send_currency_usd=1.0))
    for i in range(6):
        rows.append(dict(created_at="2025-01-01", wallet="beg", origin_chain_name="c0", user_send_currency_usd=1.0))
    for i in range(6):
        rows.append(dict(created_at="2025-01-01", wallet="reg", origin_chain_name=f"c{i}", user_send_currency_usd=1.0))
    p = DEFAULT.with_(rule_new_max=5, rule_programmatic_min=8, rule_beginner_max_chains=2)
    seg = {r.wallet: r.user_segment for r in W.rule_segments(tx_rows(spark, rows), p).collect()}
    assert seg == {"new": "New User", "prog": "Advanced Programmatic", "beg": "Beginner Explorer",
                   "reg": "Regular User"}


def test_heavy_wallet_chains_gaps_are_null(spark):
    rows = [dict(wallet="w", origin_chain_name="x", destination_chain_name=f"d{i % 2}") for i in range(5)]
    out = W.heavy_wallet_chains(tx_rows(spark, rows), 3, 3).orderBy("source_rank").collect()
    assert [r.source for r in out] == ["x", None, None]
    assert [r.dest for r in out] == ["d0", "d1", None]
    assert out[0].source_count == 5 and out[0].dest_count == 3


def test_platform_normalization_before_distinct(spark):
    raw = spark.createDataFrame(
        [("w", "c1", "dln_debridge", "c2", 1.0, "t1"), ("w", "c1", "deBridge", "c2", 2.0, "t1"),
         ("w", "c1", "across-v3", "c2", 3.0, "t2"), ("w", "c1", "DEBRIDGE", "c2", 3.0, "t3")],
        "source_address string, source_chain string, platform string, destination_chain string, "
        "amount_usd double, tx_hash string").withColumn(
        "block_timestamp", F.to_timestamp(F.lit("2024-01-05"))).withColumn(
        "direction", F.lit("outbound")).withColumn("token_is_verified", F.lit(True))
    p = DEFAULT.with_(chains=("c1", "c2"))
    out = {r.platform_: r for r in L.competitor_usage(raw, p).collect()}
    assert set(out) == {"deBridge", "across-v3"}   # 'DEBRIDGE' fails the case-exact IN list
    assert out["deBridge"].tx_count == 1 and out["deBridge"].amount_usd == 3.0


def test_marginal_effects_absent_pair(spark):
    t = spark.createDataFrame(
        [("A", "Multi-Chain Users", "home-only", 10.0, 2), ("B", "Multi-Chain Users", "multi-platform", 30.0, 4),
         ("C", "Basic Bridge Users", "home-only", 5.0, 1)],
        "wallet_ string, persona string, loyalty_type string, total_send_usd double, origin_chains bigint")
    out = {r.persona: r for r in R.marginal_effects(t).collect()}
    assert out["Multi-Chain Users"].pair_present and out["Multi-Chain Users"].volume_ratio == 3.0
    assert out["Multi-Chain Users"].origin_ratio == 2.0
    assert not out["Basic Bridge Users"].pair_present and out["Basic Bridge Users"].volume_ratio is None
    assert not out["High Value Users"].pair_present


def test_crosstab_margins(spark):
    t = spark.createDataFrame([("p1", "x"), ("p1", "y"), ("p2", "x")], "persona string, lt string")
    ct = {r.persona: r for r in R.crosstab(t, "persona", "lt", ["x", "y"]).collect()}
    assert (ct["p1"].x, ct["p1"].y, ct["p1"].All) == (1, 1, 2)
    assert (ct["p2"].y, ct["All"].x, ct["All"].All) == (0, 2, 3)


def test_empty_input_does_not_fail(spark):
    """ANSI mode raises on division by zero; empty inputs must still work."""
    from chainlens.operators import extras as X
    tx = tx_rows(spark, [])
    fa = W.wallet_features(tx, EXCL, "A", P0)
    assert fa.count() == 0
    assert W.top_wallet_stats(W.top_wallets(tx, 10), 5, 10, 20).first().n_wallets == 0
    assert X.usd_spread(fa).first().weighted_spread_pct is None
    assert FE.feature_summary(fa, ["origin_chains", "total_send_usd"]).count() == 2
    fb = W.wallet_features(tx, EXCL, "B", P0)
    assert P.assign_fixed(fb, P0).count() == 0
    assert W.heavy_wallet_chains(tx, 1, 3).count() == 0
    assert FU.first_top(FU.first_usage(tx, EXCL, P0), ["first_source_chain"]).count() == 0


def test_exclusions_as_dataframe_match_list(spark):
    tx = tx_rows(spark, base_rows())
    ex_df = spark.createDataFrame([("bad", "burn")], "wallet string, reasoning string")
    for keep in (True, False):
        a = sorted(map(str, W.exclude_wallets(tx, EXCL, keep_null=keep).collect()))
        b = sorted(map(str, W.exclude_wallets(tx, ex_df, keep_null=keep).collect()))
        assert a == b
    plan = W.exclude_wallets(tx, ex_df)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


def test_reference_parameters():
    from chainlens.config import REFERENCE_CHAINS, REFERENCE_EXCLUSIONS, Params
    r = Params.reference()
    assert (r.rule_new_max, r.rule_programmatic_min, r.rule_beginner_max_chains) == (5, 1000, 2)
    assert r.heavy_min_tx == 10000 and r.top_k_wallets == 1000 and r.model == "fitted"
    assert r.window_start == "2025-01-01" and r.window_end is None
    assert (r.competitor_start, r.competitor_end) == ("2025-01-01", "2025-07-01")
    assert list(r.chains) == REFERENCE_CHAINS and len(REFERENCE_EXCLUSIONS) == 13
