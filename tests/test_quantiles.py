"""Bounded-memory exact quantiles equal Spark's exact percentile."""
import random

from pyspark.sql import functions as F

from chainlens.functions.quantiles import exact_quantiles, exact_quantiles_wide

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def test_matches_percentile_small_and_duplicated(spark):
    rnd = random.Random(7)
    for n in (1, 2, 5, 17, 300):
        for acc in (100_000, 40):
            rows = [(i % 3, rnd.choice([rnd.random() * 100, 5.0, 7.0])) for i in range(n)]
            df = spark.createDataFrame(rows, "g int, x double")
            got = sorted(exact_quantiles(df, ["g"], "x", PROBS, accuracy=acc).collect())
            want = sorted(df.groupBy("g").agg(F.percentile("x", PROBS)).collect())
            for a, b in zip(got, want):
                assert all(abs(a[j + 1] - b[1][j]) < 1e-9 for j in range(len(PROBS))), (n, acc, a, b)


def test_global_and_wide(spark):
    df = spark.range(0, 1000).select((F.col("id") % 97).cast("double").alias("a"),
                                     (F.col("id") * 1.5).alias("b"), F.lit(None).cast("double").alias("c"))
    g = exact_quantiles(df, [], "a", [0.5, 0.9], accuracy=30).first()
    want = df.select(F.percentile("a", [0.5, 0.9])).first()[0]
    assert [g[0], g[1]] == want
    w = exact_quantiles_wide(df.withColumn("k", F.lit(1)), ["k"], ["a", "b", "c"], [0.5], accuracy=30).first()
    assert w.a_q0 == want[0] and w.b_q0 == 749.25 and w.c_q0 is None


def test_feature_summary_approx_path(spark):
    from chainlens.operators.features import feature_summary
    df = spark.range(0, 500).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    exact = {r.column: r for r in feature_summary(df, ["a", "b"]).collect()}
    approx = {r.column: r for r in feature_summary(df, ["a", "b"], exact=False).collect()}
    assert exact["a"].median == 249.5 and abs(approx["a"].median - 249.5) <= 1
    assert exact["b"].max == approx["b"].max == 6.0
