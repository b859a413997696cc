"""Reusable column expressions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c) -> Column:
    """Microseconds since 1970 of a time with or without a zone (UTC sessions)."""
    return F.unix_micros(col_or(c).cast("timestamp"))


def flag_sum(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END); NULL conditions count as 0."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


#: Amounts are summed with 8 decimals and 20 digits before the point.
MONEY = "decimal(28,8)"


def money(c) -> Column:
    """An amount as an exact number; NULL beyond the range (see ``unsummable``)."""
    return col_or(c).try_cast(MONEY)


def unsummable(c) -> Column:
    """Whether an amount is present but beyond the range of ``money``."""
    return col_or(c).isNotNull() & money(c).isNull()


def money_sum(c) -> Column:
    """Exact sum of a money column: decimal accumulation, double result.

    Double sums depend on the order partitions are merged in; a decimal
    sum does not, so results are identical across runs and engines."""
    return F.sum(money(c)).cast("double")


def avg_money(c, scale: int = 2) -> Column:
    """Mean of a money column from an exact decimal sum, rounded half-up to
    cents.  A double mean rounds differently depending on summation order
    when it lands on half a cent."""
    return F.round(F.avg(money(c)), scale).cast("double")


def log10_guarded(c) -> Column:
    """LOG10(CASE WHEN x > 0 THEN x ELSE 1 END): 0, NULL and negatives map to 0."""
    x = col_or(c)
    return F.log10(F.when(x > 0, x).otherwise(F.lit(1)))


def log1p_filled(c) -> Column:
    """Natural log1p with NaN/NULL replaced by 0 after the log."""
    v = F.log1p(col_or(c))
    return F.when(F.isnan(v) | v.isNull(), F.lit(0.0)).otherwise(v)


def share_of_total(df: DataFrame, count_col: str, out: str = "percentage",
                   scale: int = 2, total: Column | None = None) -> DataFrame:
    """Add ``count * 100 / total`` rounded; total defaults to the column sum.

    The total is a scalar subquery, run once and inlined: no cross join,
    no global window, no driver round trip."""
    if total is None:
        total = df.select(F.sum(count_col)).scalar()
    return df.withColumn(out, F.round(F.col(count_col) * F.lit(100.0) / total, scale))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 or NULL."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def format_usd(c, decimals: int = 0) -> Column:
    """'$1,234' text of a number (half-up rounding)."""
    return F.concat(F.lit("$"), F.format_number(col_or(c), decimals))


def parse_usd(c) -> Column:
    """Inverse of format_usd: strip '$' and ',' and cast; bad text -> NULL."""
    return F.regexp_replace(col_or(c), r"[$,]", "").try_cast("double")
