"""Invariants on the driver tables, metamorphic checks, extension fixtures."""
import math

from pyspark.sql import functions as F

from core_helpers import SF001, tx_rows

import __spark_entry__ as E
from chainlens.config import DEFAULT
from chainlens.operators import extras as X
from chainlens.operators import personas as P

Q = E.queries()


def test_persona_and_loyalty_partitions(spark):
    final = Q["loyalty_persona"](spark, SF001)
    n = final.count()
    dist = Q["persona_distribution"](spark, SF001).collect()
    assert sum(r.wallets for r in dist) == n
    assert math.isclose(sum(r.percentage for r in dist), 100.0, abs_tol=0.05)
    assert sum(r.is_most_common for r in dist) == 1
    loy = Q["loyalty_distribution"](spark, SF001).collect()
    assert sum(r.n_wallets for r in loy) == Q["loyalty_class"](spark, SF001).count()
    ct = {r.persona: r for r in Q["persona_loyalty_crosstab"](spark, SF001).collect()}
    assert ct["All"].All == n
    assert sum(r.All for k, r in ct.items() if k != "All") == n


def test_fitted_model_invariants(spark):
    var = [r.explained_variance_ratio for r in Q["pca_variance"](spark, SF001).orderBy("component").collect()]
    assert all(a >= b - 1e-12 for a, b in zip(var, var[1:])) and sum(var) <= 1 + 1e-9
    load = Q["pca_loadings"](spark, SF001).collect()
    by = {}
    for r in load:
        by.setdefault(r.component, []).append(r)
    for rows in by.values():   # sign rule: largest |loading| is positive
        top = min(rows, key=lambda r: r.abs_rank)
        assert top.loading >= 0
    a = Q["kmeans_assign"](spark, SF001)
    assert a.count() == Q["wallet_features_window"](spark, SF001).count()
    sweep = [r.inertia for r in Q["kmeans_sweep"](spark, SF001).orderBy("k").collect()]
    assert sweep[0] >= sweep[-1]


def test_results_independent_of_shuffle_partitions(spark):
    before = sorted(Q["loyalty_class"](spark, SF001).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        after = sorted(Q["loyalty_class"](spark, SF001).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert before == after


def test_cluster_sample_bounded(spark):
    s = Q["cluster_sample"](spark, SF001)
    per = {r.cluster_id: r["count"] for r in s.groupBy("cluster_id").count().collect()}
    assert all(v <= DEFAULT.sample_per_cluster for v in per.values())
    assert s.where((F.abs("PC1") >= 10) | (F.abs("PC2") >= 10)).count() == 0


def test_return_routes_and_aliases(spark):
    rows = [dict(created_at="2025-01-01", wallet="w", origin_chain_name="A", destination_chain_name="B"),
            dict(created_at="2025-01-03", wallet="w", origin_chain_name="B", destination_chain_name="A"),
            dict(created_at="2025-01-02", wallet="v", origin_chain_name="B", destination_chain_name="A"),
            dict(created_at="2025-01-05", wallet="v", origin_chain_name="A", destination_chain_name="B")]
    p = DEFAULT.with_(window_start="2025-01-01")
    out = {(r.wallet, r.chain_a, r.chain_b) for r in X.return_routes(tx_rows(spark, rows), [], p).collect()}
    assert out == {("w", "A", "B"), ("v", "B", "A")}
    agg = spark.createDataFrame(
        [("w", "arb", "home", "base", 1.0, 1), ("w", "arbitrum", "deBridge", "base", 2.0, 1),
         ("w", "eth", "deBridge", "base", 3.0, 2)],
        "wallet_ string, source_chain string, platform_ string, destination_chain string, "
        "amount_usd double, tx_count long")
    un = {(r.source_chain, r.wallets) for r in X.unserved_routes(agg, p, {"arb": "arbitrum"}).collect()}
    assert un == {("eth", 1)}   # arbitrum is served once aliases are merged
    sh = {r.source_chain: r.home_share for r in X.route_share(agg, p).collect()}
    assert sh["arb"] == 1.0 and sh["eth"] == 0.0


def test_variant_a_model(spark):
    """Orthonormal components, falling variance, one stored fit behind every output, and a cost no better restart beats."""
    import numpy as np

    from chainlens.config import DEFAULT
    from chainlens.operators import personas as P
    from chainlens.plans import catalog as C
    i = C.Inputs(spark, SF001)
    comps, ratios = C.pca_a(i)
    m = np.array(comps)
    assert np.allclose(m @ m.T, np.eye(len(m)), atol=1e-8) and ratios == sorted(ratios, reverse=True) and sum(ratios) <= 1 + 1e-9
    a = C.assigned_a(i)
    n = C.features_a_table(i).count()
    assert a.count() == n and {r.cluster_id for r in a.select("cluster_id").distinct().collect()} == set(range(DEFAULT.k))
    table = C.queries()["segment_cluster_crosstab_a"](spark, SF001).collect()
    total = [r for r in table if r.business_segment == "All"] or table
    assert sum(r[f"cluster_{k}"] for r in total for k in range(DEFAULT.k)) == n
    pts = np.array([[r[c] for c in C.PCS_A] for r in a.collect()])
    ids = np.array([r.cluster_id for r in a.collect()])
    cost = sum(((pts[ids == k] - pts[ids == k].mean(0)) ** 2).sum() for k in range(DEFAULT.k))
    for seed in (1, 2):
        assert cost <= P.fit_kmeans(a, C.PCS_A, DEFAULT.k, seed, 1)[1] * (1 + 1e-6)
    profiles = C.queries()["cluster_profiles_a"](spark, SF001)
    assert profiles.count() == DEFAULT.k


def test_sweep_falls(spark):
    from chainlens.plans import catalog as C
    rows = C.queries()["kmeans_sweep"](spark, SF001).orderBy("k").collect()
    costs = [r.inertia for r in rows]
    assert costs == sorted(costs, reverse=True)


def test_crosstab_has_every_cluster(spark):
    from chainlens.config import DEFAULT
    from chainlens.plans import catalog as C
    p = DEFAULT.with_(k=4, model="fitted")
    r = C.queries(p)["segment_cluster_crosstab"](spark, SF001)
    assert [c for c in r.columns if c.startswith("cluster_")] == [f"cluster_{k}" for k in range(4)]
    for row in r.collect():
        assert sum(row[f"cluster_{k}"] for k in range(4)) == row["All"]
