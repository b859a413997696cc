"""Exact ranks over all rows, without a window in one partition.

Rows are ranged over the partitions by (value, id) and numbered inside
each by a window over that partition alone.  One row per partition (its
size, first and last value, and the rank of the last) comes to the driver,
which adds up the sizes and, where a run of equal values crosses borders,
gives its rows in later partitions the rank of its first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlens.sources.tables import materialize


def exact_ranks(rows: DataFrame, value: str, row_id: str, tiles: int = 10, partitions: int | None = None) -> DataFrame:
    """``rows`` (value not NULL) with ``rank`` and ``pct_rank`` as RANK and
    PERCENT_RANK give them, and ``tile`` as NTILE over (value, id)."""
    cols = rows.columns
    kept = rows.where(F.col(value).isNotNull())
    ranged = kept.repartitionByRange(*([partitions] if partitions else []), value, F.asc_nulls_first(row_id))
    # the partition's number is written with the rows: a lost executor cannot change it later
    cut = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("_slice").orderBy(value, F.asc_nulls_first(row_id))
    inside = materialize(cut.select("*", F.row_number().over(w).cast("long").alias("_no"),
                                    F.rank().over(Window.partitionBy("_slice").orderBy(value)).cast("long").alias("_rank")), "ranked")
    per_slice = inside.groupBy("_slice").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
                                             F.max("_rank").alias("high_rank")).orderBy("_slice").collect()  # a row per partition
    offsets, before, run_value, run_rank = [], 0, None, None
    for s in per_slice:
        goes_on = before > 0 and s.low == run_value
        offsets.append((s["_slice"], before, s.low if goes_on else None, run_rank if goes_on else None))
        if not (goes_on and s.high == s.low):
            run_value, run_rank = s.high, before + s.high_rank
        before += s.n
    total = before
    low_type = inside.schema[value].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(offsets, f"_slice int, _before long, _run {low_type}, _run_rank long")
    rank = F.when(F.col(value) == F.col("_run"), F.col("_run_rank")).otherwise(F.col("_before") + F.col("_rank"))
    no = F.col("_before") + F.col("_no")
    size, more = divmod(total, tiles)
    in_larger = more * (size + 1)
    tile = F.when(no <= in_larger, F.floor((no - 1) / (size + 1)) + 1)
    if size:
        tile = tile.otherwise(more + F.floor((no - in_larger - 1) / size) + 1)
    pct = (F.col("rank") - 1) / float(total - 1) if total > 1 else F.lit(0.0)
    return (inside.join(F.broadcast(table), "_slice")  # a row per partition
            .select(*cols, rank.alias("rank"), tile.cast("int").alias("tile")).withColumn("pct_rank", pct))
