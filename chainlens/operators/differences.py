"""Bag difference of two tables, duplicates and NULLs counted.

Rows are hashed into buckets and each bucket of either side is summed up to
a digest in the map tasks.  Buckets whose digests agree hold the same rows
as often (up to a collision of 126 bits) and leave before any row is
shuffled; the rows of the others are counted with signs.  Two loads that
differ in little thus cost two scans and little more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.sources.tables import materialize

BUCKETS = 4096


def _hash(cols: list[str], seed: int) -> Column:
    # Spark's hash skips NULLs, so their places are hashed as well
    return F.xxhash64(F.lit(seed), *[x for c in cols for x in (F.col(c), F.col(c).isNull())])


def differing_buckets(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(_bucket) where the two sides' digests differ: at most ``buckets`` rows."""
    cols = left.columns
    parts = []
    for side, sign in ((left, 1), (right, -1)):
        parts.append(side.select(F.pmod(_hash(cols, 0), F.lit(buckets)).alias("_bucket"), F.lit(sign).alias("_sign"),
                                 *[F.shiftright(_hash(cols, k), 1).cast("decimal(20,0)").alias(f"_h{k}") for k in (1, 2)]))
    both = parts[0].unionByName(parts[1])
    off = both.groupBy("_bucket").agg(F.sum("_sign").alias("_n"), *[F.sum(F.col(f"_h{k}") * F.col("_sign")).alias(f"_h{k}") for k in (1, 2)])
    return off.where((F.col("_n") != 0) | (F.col("_h1") != 0) | (F.col("_h2") != 0)).select("_bucket")


def bag_difference(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows that one side has more often: their columns, ``side`` and how
    many ``copies`` more.  Both sides need the same columns; their order
    does not matter."""
    cols = left.columns
    right = right.select(*cols)
    off = materialize(differing_buckets(left, right, buckets), "buckets")  # at most ``buckets`` small rows
    counted = []
    for side, sign in ((left, 1), (right, -1)):
        own = side.withColumn("_bucket", F.pmod(_hash(cols, 0), F.lit(buckets))).join(F.broadcast(off), "_bucket", "left_semi")
        counted.append(own.select(*cols, F.lit(sign).alias("_sign")))
    n = counted[0].unionByName(counted[1]).groupBy(*cols).agg(F.sum("_sign").alias("_n")).where(F.col("_n") != 0)
    return n.select(*cols, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").cast("long").alias("copies"))
