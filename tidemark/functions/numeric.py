"""Column expressions on numbers and epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Readings below this magnitude are summed as exact decimals, the rest as doubles.
EXACT_LIMIT = 1e20
EXACT_TYPE = "decimal(26,6)"


def usable(value: Column) -> Column:
    """True for a reading that is neither NULL nor NaN nor infinite; never NULL."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def exact_part(value: Column) -> Column:
    """The reading as a decimal of six places, NULL when it is unusable or too large for one.

    Decimal sums do not depend on the order of the tasks and cancel without remainder.
    """
    v = value.cast("double")
    return F.when(usable(v) & (F.abs(v) < EXACT_LIMIT), v.cast(EXACT_TYPE))


def huge_part(value: Column) -> Column:
    """The usable readings that :func:`exact_part` leaves out."""
    v = value.cast("double")
    return F.when(usable(v) & (F.abs(v) >= EXACT_LIMIT), v)


def tdiv(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero (also under ANSI mode)."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def floor_day(ts_ms: Column) -> Column:
    """Number of the UTC calendar day, also before 1970."""
    t = ts_ms.cast("bigint")
    return tdiv(t - F.pmod(t, F.lit(DAY_MS).cast("bigint")), DAY_MS).cast("int")


def to_long(value: Column) -> Column:
    """Float to integer: truncates, saturates at the 64-bit bounds, maps NaN to 0 and keeps NULL."""
    v = value.cast("double")
    return (
        F.when(F.isnan(v), F.lit(0).cast("bigint"))
        .when(v >= F.lit(2.0**63), F.lit(2**63 - 1).cast("bigint"))
        .when(v <= F.lit(-(2.0**63)), F.lit(-(2**63)).cast("bigint"))
        .otherwise(v.cast("bigint"))
    )
