"""k-means runs that share their passes over the points."""
import pytest
from pyspark.sql import functions as F

from chainlens.operators import personas as P


def test_kmeans_runs_share_passes(spark, monkeypatch):
    """Centers and costs of Spark ML's own runs, in as many passes as the slowest one needs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    pts = spark.range(0, 900, 1, 3).select("id", (F.col("id") % 3 * 5 + F.randn(1)).alias("x"), (F.col("id") % 2 * 4 + F.randn(2)).alias("y")).cache()
    vec = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(pts.select("x", "y")).select("features").cache()
    runs, passes, step = [(2, 1), (3, 1), (3, 2), (5, 3)], [], P._lloyd_step
    monkeypatch.setattr(P, "_lloyd_step", lambda blocks, centers: passes.append(len(centers)) or step(blocks, centers))
    models = [KMeans(k=k, seed=seed, maxIter=300, tol=1e-6).fit(vec) for k, seed in runs]
    for (centers, cost), m in zip(P.fit_kmeans_runs(pts, ["x", "y"], runs), models):
        assert cost == pytest.approx(m.summary.trainingCost, rel=1e-9)
        assert [v for c in centers for v in c] == pytest.approx([v for c in m.clusterCenters() for v in c], rel=1e-9)
    assert len(passes) == max(m.summary.numIter for m in models) and passes[0] == len(runs)
