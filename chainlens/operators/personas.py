"""PCA scores, k-means clusters and persona labels.

Two ways to get clusters, sharing all downstream plumbing:

* fixed model: scores = standardized features x given loadings, cluster =
  nearest of given centroids.  Pure column arithmetic (no shuffle, no
  Python), deterministic, so every table built on it is SQL-checkable.
* fitted model: Spark ML ``PCA`` (distributed covariance, 9x9 eigen
  problem on the driver) and ``KMeans`` with restarts; the fitted
  loadings / centroids are then applied with the same column arithmetic.

Per-wallet work is always column expressions over the wallet table; only
model parameters (a 9x5 matrix, k centroids) live on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.config import (BUSINESS_FEATURES, CLUSTER_FEATURES, DEFAULT, PERSONA_OTHER,
                              PERSONA_POSITIVE, PERSONA_TOP, Params)
from chainlens.functions.exprs import avg_money, share_of_total
from chainlens.functions.quantiles import exact_quantiles_wide
from chainlens.operators.features import log10_features, standardize
from chainlens.sources.tables import materialize

PC_COLS = [f"PC{i + 1}" for i in range(5)]


def mean2(c: str):
    """Mean rounded to 2 dp; exact (decimal) for the USD column."""
    return avg_money(c) if c == "total_send_usd" else F.round(F.avg(c), 2)


# ---------------------------------------------------------------------------
# Scores
# ---------------------------------------------------------------------------


def project(df: DataFrame, cols: Sequence[str], loadings: Sequence[Sequence[float]],
            keep: Sequence[str] = ("wallet",)) -> DataFrame:
    """PC_k = sum_j x_j * loadings[k][j]: one codegen'd expression per component."""
    pcs = []
    for k, row in enumerate(loadings):
        e: Column = F.lit(0.0)
        for c, w in zip(cols, row):
            e = e + F.col(c) * F.lit(float(w))
        pcs.append(e.alias(f"PC{k + 1}"))
    return df.select(*keep, *pcs)


def scaled_inputs(features_b: DataFrame) -> DataFrame:
    """Variant B clustering inputs, standardized (population std)."""
    return standardize(log10_features(features_b), CLUSTER_FEATURES)


def fixed_scores(features_b: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return project(scaled_inputs(features_b), CLUSTER_FEATURES, p.loadings)


# ---------------------------------------------------------------------------
# Cluster assignment
# ---------------------------------------------------------------------------


def nearest_centroid(scores: DataFrame, centroids: Sequence[Sequence[float]],
                     dims: Sequence[str] = ("PC1", "PC2", "PC3"),
                     out: str = "cluster_id") -> DataFrame:
    """Index of the nearest centroid (squared Euclidean; ties -> lowest id).
    The k centroids are literals in the expression: no join at all."""
    d2 = [sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(dims, cen)), F.lit(0.0))
          for cen in centroids]
    arr = F.array(*d2)
    return scores.withColumn(out, (F.array_position(arr, F.array_min(arr)) - 1).cast("int"))


def assign_fixed(features_b: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return nearest_centroid(fixed_scores(features_b, p), p.centroids)


# ---------------------------------------------------------------------------
# Fitted model (Spark ML)
# ---------------------------------------------------------------------------


def sign_fixed(components: list[list[float]]) -> list[list[float]]:
    """Flip each component so that its largest-magnitude weight is positive
    (first such weight by feature order on ties)."""
    out = []
    for row in components:
        j = max(range(len(row)), key=lambda i: (abs(row[i]), -i))
        out.append([-w for w in row] if row[j] < 0 else list(row))
    return out


def fit_pca(scaled: DataFrame, cols: Sequence[str], k: int = 5):
    """Fit PCA on standardized columns; returns (components k x n, variance ratios).
    ``k`` is capped at the number of features."""
    from pyspark.ml.feature import PCA, VectorAssembler
    k = min(k, len(cols))
    vec = VectorAssembler(inputCols=list(cols), outputCol="__x").transform(scaled.select(*cols))
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(vec)
    pc = model.pc.toArray()  # n x k
    comps = [[float(pc[j][i]) for j in range(len(cols))] for i in range(k)]
    return sign_fixed(comps), [float(v) for v in model.explainedVariance.toArray()]


def pca_variance(ratios: Sequence[float], spark) -> DataFrame:
    rows = []
    cum = 0.0
    for i, r in enumerate(ratios):
        cum += r
        rows.append((f"PC{i + 1}", float(r), float(cum)))
    return spark.createDataFrame(rows, "component string, explained_variance_ratio double, cumulative double")


def loadings_report(comps: Sequence[Sequence[float]], cols: Sequence[str], spark) -> DataFrame:
    """feature x component weights (3 dp), rank by |weight| within the
    component, and the top-2 positive / negative features as text."""
    rows = [(f"PC{i + 1}", c, float(w)) for i, comp in enumerate(comps) for c, w in zip(cols, comp)]
    df = spark.createDataFrame(rows, "component string, feature string, loading double")
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    df = df.withColumn("abs_rank", F.row_number().over(w))
    pos = Window.partitionBy("component", F.col("loading") > 0).orderBy("abs_rank")
    df = df.withColumn("sign_rank", F.row_number().over(pos))
    top = (df.groupBy("component").agg(
        F.concat_ws(", ", F.sort_array(F.collect_list(F.when((F.col("loading") > 0) & (F.col("sign_rank") <= 2),
                                                               F.struct("abs_rank", "feature")))).getField("feature")).alias("top_positive"),
        F.concat_ws(", ", F.sort_array(F.collect_list(F.when((F.col("loading") < 0) & (F.col("sign_rank") <= 2),
                                                               F.struct("abs_rank", "feature")))).getField("feature")).alias("top_negative")))
    return df.drop("sign_rank").withColumn("loading", F.round("loading", 3)).join(top, "component")


#: Fits that look for their first centers at the same time.
FITS_AT_ONCE = 4
#: Points of one block of distances, which stays in the processor's cache.
BLOCK = 1024


def _blocks(vec: DataFrame, dim: int):
    """The points as d x n arrays of doubles, a block per Arrow batch."""
    def packed(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], names=["block"])

    return vec.mapInArrow(packed, "block binary").rdd.map(lambda r: np.frombuffer(r.block).reshape(dim, -1))


def _lloyd_step(blocks, centers: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pass over the points for all ``centers`` (one k x d array per run):
    per run the sizes and means of its clusters, and the cost before them."""
    dim = centers[0].shape[1]
    ends = np.cumsum([len(c) for c in centers])
    spans = list(zip(ends - [len(c) for c in centers], ends))
    flat = np.concatenate(centers)
    weights = np.hstack([-2.0 * flat, (flat * flat).sum(1)[:, None]])  # distance less the point's own square

    def partial(part):
        out = np.zeros((2 + dim, len(weights)))  # points, cost and sums of each center
        for block in part:
            for at in range(0, block.shape[1], BLOCK):
                x = block[:, at:at + BLOCK]
                square, rows = (x * x).sum(0), np.arange(x.shape[1])
                d2 = weights[:, :dim] @ x + weights[:, dim:]
                for lo, hi in spans:
                    best = d2[lo:hi].argmin(0)
                    for j, w in enumerate((None, np.maximum(d2[lo + best, rows] + square, 0.0), *x)):
                        out[j, lo:hi] += np.bincount(best, w, hi - lo)
        yield out

    # one array of centers per task, in a tree
    total = blocks.mapPartitions(partial).treeReduce(np.add, 1 if blocks.getNumPartitions() <= 64 else 2)
    n = total[0]
    means = np.where(n > 0, total[2:] / np.maximum(n, 1), flat.T).T  # a center without points stays
    return [(n[lo:hi], means[lo:hi], float(total[1, lo:hi].sum())) for lo, hi in spans]


def fit_kmeans_runs(points: DataFrame, dims: Sequence[str], runs: Sequence[tuple[int, int]], max_iter: int = 300,
                    tol: float = 1e-6) -> list[tuple[list[list[float]], float]]:
    """(centroids, cost) of a k-means|| run for each (k, seed) of ``runs``.

    First centers are Spark ML's.  Lloyd's iterations of all runs share their
    passes over the points, so there are as many passes as the slowest run
    needs, not the sum; a run stops as Spark ML's does, once no center moves
    by more than ``tol``, and has the cost of its last pass."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    vec = (VectorAssembler(inputCols=list(dims), outputCol="features")
           .transform(points.select(*dims)).select("features")
           .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        vec.count()

        def first(run: tuple[int, int]) -> np.ndarray:
            return np.array(KMeans(k=run[0], seed=run[1], maxIter=0, tol=tol, featuresCol="features").fit(vec).clusterCenters())

        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            centers = list(pool.map(first, runs))
        costs, live = [0.0] * len(runs), list(range(len(runs)))
        blocks = _blocks(vec.select(vector_to_array("features").alias("x")), len(dims)).persist(StorageLevel.MEMORY_AND_DISK)
        for _ in range(max_iter):
            if not live:
                break
            moved = []
            for r, (n, means, cost) in zip(live, _lloyd_step(blocks, [centers[r] for r in live])):
                if (((means - centers[r]) ** 2).sum(1)[n > 0] > tol * tol).any():
                    moved.append(r)
                centers[r], costs[r] = means, cost
            live = moved
        blocks.unpersist()
        return [(c.tolist(), cost) for c, cost in zip(centers, costs)]
    finally:
        vec.unpersist()


def fit_kmeans(points: DataFrame, dims: Sequence[str], k: int, seed: int, restarts: int,
               max_iter: int = 300):
    """Best of ``restarts`` k-means|| runs (lowest training cost).
    Returns (centroids, cost).  The small vector table is persisted
    (memory + disk, recomputable from lineage if an executor is lost)."""
    return min(fit_kmeans_runs(points, dims, [(k, seed + r) for r in range(restarts)], max_iter), key=lambda x: x[1])


def kmeans_sweep(points: DataFrame, dims: Sequence[str], k_values: Sequence[int], seed: int,
                 restarts: int = 10, max_iter: int = 300):
    """Inertia (training cost) for each k: list of (k, cost)."""
    runs = [(k, seed + r) for k in k_values for r in range(restarts)]
    fits = fit_kmeans_runs(points, dims, runs, max_iter)
    return [(k, min(cost for (of, _), (_, cost) in zip(runs, fits) if of == k)) for k in k_values]


def order_centroids(centroids: Sequence[Sequence[float]]) -> list[list[float]]:
    """Relabel clusters by descending first coordinate (ids are arbitrary)."""
    return [list(c) for c in sorted(centroids, key=lambda c: -c[0])]


# ---------------------------------------------------------------------------
# Cluster tables and personas
# ---------------------------------------------------------------------------


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    g = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"))
    return share_of_total(g, "count", "percentage", 2)


def cluster_centroids(assigned: DataFrame, by: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Mean and sample std of PC1-3, count, percent, marker size per cluster."""
    g = assigned.where(F.col("PC1").isNotNull()).groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in PC_COLS[:3]],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in PC_COLS[:3]],
        F.count(F.lit(1)).alias("count"))
    g = share_of_total(g, "count", "percentage", 2)
    return g.withColumn("sphere_size", F.ceil(F.lit(0.05) * F.sqrt("count")).cast("bigint"))


def persona_labels(assigned: DataFrame) -> DataFrame:
    """Clusters ordered by mean PC1: highest -> top persona, other positive ->
    second, the rest -> basic.  Fewer than three personas may appear."""
    cen = assigned.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in PC_COLS[:3]])
    # the cluster with the highest mean PC1 (ties -> lowest id), as a scalar subquery
    top = cen.orderBy(F.desc("PC1"), "cluster_id").limit(1).select("cluster_id").scalar()
    return cen.withColumn(
        "persona",
        F.when(F.col("cluster_id") == top, PERSONA_TOP)
         .when(F.col("PC1") > 0, PERSONA_POSITIVE)
         .otherwise(PERSONA_OTHER))


def with_personas(assigned: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Attach the persona of each wallet's cluster.  The label table has one
    row per cluster (k rows), a proven bound, so it is broadcast."""
    labels = labels if labels is not None else persona_labels(assigned)
    return assigned.join(F.broadcast(labels.select("cluster_id", "persona")), "cluster_id")


def persona_table(features_b: DataFrame, assigned: DataFrame) -> DataFrame:
    """Business features + scores + cluster + persona, inner-joined on wallet.
    Both sides are wallet-grain and already hash-partitioned by wallet."""
    scored = with_personas(assigned)
    return features_b.select("wallet", *BUSINESS_FEATURES).join(scored, "wallet")


def cluster_profiles(table: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Mean and median of the business features per cluster, 2 dp (exact
    medians with bounded memory per cluster)."""
    means = table.groupBy(key).agg(*[mean2(c).alias(f"{c}_mean") for c in BUSINESS_FEATURES])
    med = exact_quantiles_wide(table, [key], BUSINESS_FEATURES, [0.5])
    out = means.join(med, key)
    cols = []
    for c in BUSINESS_FEATURES:
        cols += [F.col(f"{c}_mean"), F.round(F.col(f"{c}_q0"), 2).alias(f"{c}_median")]
    return out.select(key, *cols)


FINAL_COLUMNS = (["wallet_", "persona", "cluster_id", "loyalty_type", "n_platforms",
                  "n_source_chains", "n_dest_chains", "total_amount_usd", "total_tx_count"]
                 + BUSINESS_FEATURES + PC_COLS)


def loyalty_persona(personas: DataFrame, loyalty: DataFrame) -> DataFrame:
    """Inner join persona table (wallet) with loyalty classes (wallet_),
    keeping the final column set (only those present)."""
    j = personas.join(loyalty, personas.wallet == loyalty.wallet_)
    return j.select(*[c for c in FINAL_COLUMNS if c in j.columns])


def cluster_sample(table: DataFrame, n: int, seed: int = 42, bound: float = 10.0) -> DataFrame:
    """Up to n rows per cluster with |PC1..3| < bound, chosen by a seeded
    hash of the wallet (deterministic stand-in for ORDER BY RANDOM()).
    ``row_number <= n`` is a WindowGroupLimit: each task forwards at most n
    rows per cluster, so the few huge cluster groups never meet whole."""
    f = table.where(F.col("PC1").isNotNull()
                    & (F.abs("PC1") < bound) & (F.abs("PC2") < bound) & (F.abs("PC3") < bound))
    w = Window.partitionBy("cluster_id").orderBy(F.xxhash64(F.col("wallet_"), F.lit(seed)), "wallet_")
    return (f.select("cluster_id", "persona", "wallet_", "PC1", "PC2", "PC3")
            .withColumn("sample_rank", F.row_number().over(w))
            .where(F.col("sample_rank") <= n))


# ---------------------------------------------------------------------------
# Fitted pipeline
# ---------------------------------------------------------------------------


def fitted_model(features_b: DataFrame, p: Params = DEFAULT, pca_k: int | None = None,
                 cluster_dims: int = 3):
    """Fit PCA on the standardized variant-B inputs, then k-means (best of
    ``kmeans_restarts``) on the first ``cluster_dims`` scores.

    Returns (scores, components, variance ratios, centroids) where
    ``scores`` is the lazy wallet x PC table; centroids are relabelled by
    descending PC1 so cluster ids are stable across runs."""
    scaled = scaled_inputs(features_b)
    comps, ratios = fit_pca(scaled, CLUSTER_FEATURES, pca_k or p.n_components)
    scores = project(scaled, CLUSTER_FEATURES, comps)
    dims = [f"PC{i + 1}" for i in range(cluster_dims)]
    centroids, _ = fit_kmeans(scores, dims, p.k, p.kmeans_seed, p.kmeans_restarts, p.kmeans_max_iter)
    return scores, comps, ratios, order_centroids(centroids)


def assign_fitted(features_b: DataFrame, p: Params = DEFAULT) -> DataFrame:
    scores, _, _, centroids = fitted_model(features_b, p)
    return nearest_centroid(scores, centroids)
