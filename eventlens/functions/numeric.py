"""Numeric column helpers shared by every operator.

All of them are plain Spark expressions (JVM-side, whole-stage codegen); no UDF.

Rounding policy: an operator that publishes a rounded ratio computes it from
exact integers (`ratio`), so the answer does not depend on the order in which
partitions were summed, and it rounds half away from zero like the SQL the
library mirrors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a, b) -> Column:
    """Integral division truncating toward zero (Spark's `div`), exact for bigint."""
    return F.call_function("div", col(a).cast("long"), col(b).cast("long"))


def int_avg(c) -> Column:
    """Average of an integer column that truncates toward zero.

    Integer ``AVG`` in the source dialect returns an integer; downstream
    thresholds (e.g. "2 x the average") depend on that truncation.
    Partial-aggregatable (sum and count), so it is safe on skewed groups.
    """
    c = col(c)
    n = F.count(c)
    return F.when(n > 0, idiv(F.sum(c), n))


def safe_div(a, b) -> Column:
    """a / b as double, NULL when b is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def scaled(c, scale: int) -> Column:
    """A decimal-valued double as an exact integer count of 10^-scale units.

    Sums of the result are exact and order-independent, unlike sums of doubles.
    The type is DECIMAL(38,0), so a sum over a trillion rows cannot overflow
    (a bigint sum of cents or micro-units could).
    """
    return F.round(col(c) * F.lit(float(10 ** scale)), 0).cast("decimal(38,0)")


def ratio(num, den, scale: int) -> Column:
    """num / den rounded half away from zero to ``scale`` decimals, as double.

    ``num`` and ``den`` must be integral. The rounding is done in exact
    integer (DECIMAL(38,0)) arithmetic: q = (2 * 10^s * |num| + |den|) div
    (2 * |den|), so the result is the same on every engine and every
    partitioning. NULL when ``den`` is 0 or NULL.
    """
    # DECIMAL(38,0) keeps 2 * 10^s * num exact for numerators far beyond the
    # bigint range (sums over very large tables); the quotient is a bigint.
    n = col(num).cast("decimal(38,0)")
    d = col(den).cast("decimal(38,0)")
    p = 10 ** scale
    q = F.call_function("div", F.abs(n) * F.lit(2 * p) + F.abs(d), F.abs(d) * F.lit(2))
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return F.when(d != 0, signed / F.lit(float(p)))


def percent(num, den, scale: int) -> Column:
    """num * 100 / den rounded like `ratio`; the x100 happens in exact decimal
    arithmetic, so a bigint sum near its limit cannot overflow."""
    return ratio(col(num).cast("decimal(38,0)") * F.lit(100), den, scale)


def decimal_ratio(num, den, precision: int, scale: int) -> Column:
    """`ratio` as DECIMAL(precision, scale) (e.g. a percentage column); NULL when it does not fit."""
    return ratio(num, den, scale).try_cast(f"decimal({precision},{scale})")


def pct_ratio(num, den, precision: int = 5, scale: int = 1) -> Column:
    """num * 100 / den as DECIMAL(precision, scale), exact half-away rounding."""
    return decimal_ratio(col(num).cast("decimal(38,0)") * F.lit(100), den, precision, scale)
