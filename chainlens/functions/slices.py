"""Time slices of hot keys.

A window over one key sorts all of the key's rows in one task.  Keys with
more than ``slice_rows`` rows are therefore cut into slices of time: their
span is divided into ``CELLS`` equal cells, cells are counted, and a new
slice begins wherever the running count passes a multiple of
``slice_rows``.  A slice holds at most ``slice_rows`` rows and one cell's
more.  Keys below the bound, nearly all, are one slice and cost one
aggregate with map-side counts.

What a window would carry from one slice into the next (a last value, a
count, an open session) is then computed from one row per slice.

The tables here hold hot keys alone: at most total rows / ``slice_rows`` of
them, with ``CELLS`` small numbers each.  They are written to the shared
folder, so their size is known when the join with the rows is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.exprs import micros
from chainlens.sources.tables import materialize

SLICE_ROWS = 2_000_000
CELLS = 1024
BUCKETS = 65_536
SLICE, HOT = "_slice", "_hot"


def same_keys(keys: Sequence[str], prefix: str = "_k") -> Column:
    """Null-safe equality of ``keys`` with their renamed copies."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(prefix + k))
    return cond


def renamed(df: DataFrame, keys: Sequence[str], prefix: str = "_k") -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def _cell(ts: str) -> Column:
    return F.floor((micros(ts) - F.col("_lo")) / F.col("_width")).cast("int")


def hot_slices(rows: DataFrame, keys: Sequence[str], ts: str, slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """One row per hot key: its renamed keys, ``_lo``, ``_width`` and the slice of every cell; None without hot keys."""
    # a key has at most the rows of its bucket, so the keys of other buckets need no count of their own
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    full = (rows.groupBy(bucket.alias("_b")).agg(F.count(ts).alias("_n")).where(F.col("_n") > slice_rows)
            .agg(F.collect_list("_b").alias("b")).first().b)  # at most all rows / slice_rows of BUCKETS numbers
    if not full:
        return None
    us = micros(ts)
    width = F.ceil((F.max(us) - F.min(us) + 1) / F.lit(CELLS)).alias("_width")
    counts = rows.where(bucket.isin(full)).groupBy(*keys).agg(F.count(ts).alias("_n"), F.min(us).alias("_lo"), width)
    hot = materialize(renamed(counts.where(F.col("_n") > slice_rows).drop("_n"), keys), "hot-keys")
    if hot.isEmpty():
        return None
    kept = [f"_k{k}" for k in keys]
    found = (rows.select(*keys, ts).join(hot, same_keys(keys)).where(F.col(ts).isNotNull())
             .groupBy(*kept, _cell(ts).alias("_cell")).agg(F.count("*").alias("_n")))
    grid = hot.select(*kept, F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("_cell"), F.lit(0).cast("long").alias("_n"))
    cells = found.unionByName(grid).groupBy(*kept, "_cell").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*kept).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cells.withColumn(SLICE, F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / slice_rows).cast("int"))
    per_key = numbered.groupBy(*kept).agg(F.sort_array(F.collect_list(F.struct("_cell", SLICE))).alias("_cells"))  # CELLS entries
    per_key = renamed(per_key, kept, "_j")
    both = hot.join(per_key, same_keys(kept, "_j")).select(*kept, "_lo", "_width", F.transform("_cells", lambda c: c[SLICE]).alias("_slices"))
    return materialize(both, "hot-slices")


def with_slice(rows: DataFrame, hot: DataFrame | None, keys: Sequence[str], ts: str) -> DataFrame:
    """``rows`` with ``_slice`` (0 for keys that are not hot, and for a null time) and ``_hot``."""
    if hot is None:
        return rows.withColumn(SLICE, F.lit(0)).withColumn(HOT, F.lit(False))
    cut = F.coalesce(F.get("_slices", _cell(ts)), F.lit(0))
    return rows.join(hot, same_keys(keys), "left").select(*rows.columns, cut.alias(SLICE), F.col("_slices").isNotNull().alias(HOT))


def ranked(rows: DataFrame, keys: Sequence[str], ts: str, order: Sequence[Column | str], name: str = "n",
           slice_rows: int = SLICE_ROWS, deal: Sequence[str] = ()) -> DataFrame:
    """``rows`` numbered from 1 per key, by time and then ``order``, nulls first.

    Within a slice by a window; the rows of the slices before are counted
    and added.  Without hot keys, rows are dealt by ``deal``, some of the
    keys that a later step groups by, and stay there."""
    hot = hot_slices(rows, keys, ts, slice_rows)
    if hot is None and deal:
        rows = rows.repartition(*deal)
    cut = with_slice(rows, hot, keys, ts)
    w = Window.partitionBy(*keys, SLICE).orderBy(F.asc_nulls_first(ts), *[F.asc_nulls_first(c) if isinstance(c, str) else c for c in order])
    out = cut.withColumn(name, F.row_number().over(w).cast("long"))
    if hot is not None:
        sizes = cut.where(HOT).groupBy(*keys, SLICE).agg(F.count("*").alias("_rows"))
        before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        offsets = renamed(sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"), [*keys, SLICE])
        out = out.join(offsets, same_keys([*keys, SLICE]), "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    return out.select(*rows.columns, name)
