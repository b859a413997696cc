"""Distinct counts and sums per key with one shuffle of narrow rows.

Several ``countDistinct`` in one aggregate are planned as an Expand: every
row is copied once per column, and all copies are grouped, spilled and
shuffled.  Here rows are dealt by the key alone, once; the copies are made
after that, inside the task, and grouped there.  The number of tasks follows
the number of rows (``TASK_ROWS``), so what one task holds does not grow
with the input.

A key with more than ``slice_rows`` rows would land whole in one task.  Rows
are therefore counted by ``BUCKETS`` buckets of the key's hash first; the keys
of buckets above the bound (at most total rows / ``slice_rows`` buckets) keep
the plan with partial counts, which deals a key's values over many tasks.

Rows are read twice, to be counted and to be dealt.  With ``store`` they are
written first, these columns alone: for rows that come out of joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.functions.exprs import money, money_sum
from chainlens.functions.slices import BUCKETS
from chainlens.sources.tables import ROWS_PER_FILE, materialize

#: Rows dealt to one task, six or so copies of each are grouped there.
TASK_ROWS = 150_000
#: Up to so many rows, Spark chooses the number of tasks.
FEW_ROWS = 1_000_000


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def dealt(rows: DataFrame, key: str, slice_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows dealt by ``key``, and the rows of hot keys as they lie (None without any)."""
    counts = rows.groupBy(_bucket(key).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.agg(F.sum("_n").alias("n"), F.collect_list(F.when(F.col("_n") > slice_rows, F.col("_b"))).alias("hot")).first()
    total, hot, cold = found.n or 0, None, rows
    if found.hot:
        is_hot = _bucket(key).isin(found.hot)
        hot, cold = rows.where(is_hot), rows.where(~is_hot)
    if total <= FEW_ROWS:
        return cold.repartition(key), hot
    # a multiple of the shuffle partitions: a task then holds rows of one bucket of a table bucketed by the key
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cold.repartition(n * -(-total // (n * TASK_ROWS)), key), hot


def distinct_counts(df: DataFrame, key: str, distinct: Mapping[str, Column], sums: Mapping[str, Column],
                    usd: Mapping[str, Column], slice_rows: int, store: bool = False) -> DataFrame:
    """Per key: distinct non-null values of each column of ``distinct``, then
    sums (bigint) and exact money sums (double), each under its name."""
    values, adds, paid = (list(x) for x in (distinct, sums, usd))
    rows = df.select(key, *[c.alias(n) for part in (distinct, sums, usd) for n, c in part.items()])
    if store:
        rows = materialize(rows, "dealt-rows", ROWS_PER_FILE)
    cold, hot = dealt(rows, key, slice_rows)
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(values)],
                                F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("v"))))
    long = cold.select(key, *adds, *paid, entries.alias("_e")).select(key, "_e.i", "_e.v", *adds, *paid)
    own = F.col("i") == -1
    once = long.groupBy(key, "i", "v").agg(*[F.sum(F.when(own, F.col(c))).alias(c) for c in adds],
                                           *[F.sum(F.when(own, money(c))).alias(c) for c in paid])
    out = once.groupBy(key).agg(*[F.count_if((F.col("i") == i) & F.col("v").isNotNull()).alias(c) for i, c in enumerate(values)],
                                *[F.sum(c).cast("bigint").alias(c) for c in adds], *[F.sum(c).cast("double").alias(c) for c in paid])
    if hot is None:
        return out
    return out.unionByName(hot.groupBy(key).agg(
        *[F.countDistinct(c).alias(c) for c in values], *[F.sum(c).cast("bigint").alias(c) for c in adds],
        *[money_sum(c).alias(c) for c in paid]))
