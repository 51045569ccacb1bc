"""Aggregations across series and functions over the samples of a series, on long-form rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import NoSuchField, Unsupported

#: Milliseconds of a stretch of a series that one task puts in order; a series of any length is many of them.
STRETCH_MS = 86_400_000

_SIMPLE = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "stddev": F.stddev_pop,
    "stdvar": F.var_pop,
}


def group_labels(labels: Sequence[str], mode: str, named: Sequence[str]) -> list[str]:
    """The labels that a grouping keeps, in the table's order for ``without``."""
    for n in named:
        if n not in labels:
            raise NoSuchField(f"no label {n}")
    if mode == "by":
        return list(dict.fromkeys(named))
    return [x for x in labels if x not in named] if mode == "without" else []


def aggregate(df: DataFrame, function: str, keys: Sequence[str], value: str = "value", param: float | str | None = None) -> DataFrame:
    """``keys`` and the aggregated ``value``; NULL values are left out, NaN goes through sums.

    ``topk`` and ``bottomk`` keep the rows themselves, the first by value, ties by the other columns.
    ``count_values`` adds the value as a label.
    """
    seen = df.where(F.col(value).isNotNull())
    if function in _SIMPLE:
        return seen.groupBy(*keys).agg(_SIMPLE[function](value).alias(value))
    if function == "group":
        return seen.groupBy(*keys).agg(F.lit(1.0).alias(value))
    if function == "quantile":
        q = float(param)
        if not 0 <= q <= 1:
            return seen.groupBy(*keys).agg(F.lit(float("-inf") if q < 0 else float("inf")).alias(value))
        return seen.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias(value))
    if function == "count_values":
        return seen.groupBy(*keys, F.col(value).cast("string").alias(str(param))).agg(F.count("*").cast("double").alias(value))
    if function in ("topk", "bottomk"):
        rest = [F.col(c) for c in df.columns if c != value and c not in keys]
        by = F.col(value).desc() if function == "topk" else F.col(value).asc()
        w = Window.partitionBy(*keys).orderBy(F.isnan(F.col(value).cast("double")), by, *rest)
        return seen.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= int(param)).drop("_n")
    raise Unsupported(f"the aggregation {function}")


def over_time(df: DataFrame, function: str, labels: Sequence[str], range_ms: int | None, params: Sequence[float] = (), value: str = "value") -> DataFrame:
    """One row per series over all its samples in ``df``: labels and ``value``.

    ``increase`` adds up what a counter gained, a fall counting as a restart from 0; ``rate`` is that per
    second of the range, or of the time from first to last sample without a range.  ``delta`` is last
    less first.  Nothing is extrapolated.  Series without a value give no row.
    """
    seen = df.where(F.col(value).isNotNull())
    simple = function.removesuffix("_over_time")
    if function.endswith("_over_time"):
        if simple in _SIMPLE:
            return seen.groupBy(*labels).agg(_SIMPLE[simple](value).cast("double").alias(value))
        if simple == "last":
            return seen.groupBy(*labels).agg(F.max_by(value, "ts_ms").alias(value))
        if simple == "present":
            return seen.groupBy(*labels).agg(F.lit(1.0).alias(value))
        if simple == "quantile":
            return aggregate(seen, "quantile", labels, value, params[0])
    if function == "delta":
        return seen.groupBy(*labels).agg((F.max_by(value, "ts_ms") - F.min_by(value, "ts_ms")).alias(value))
    if function in ("irate", "idelta"):
        ends = _last_two(seen, labels, value)
        gained = F.when(F.col("_b") < F.col("_a"), F.col("_b")).otherwise(F.col("_b") - F.col("_a"))
        return ends.select(*labels, (gained / ((F.col("_tb") - F.col("_ta")) / 1000) if function == "irate" else F.col("_b") - F.col("_a")).alias(value))
    if function in ("increase", "rate", "changes", "resets"):
        total = _gains(seen, function, labels, value)
        if function == "rate":
            seconds = F.lit(range_ms / 1000) if range_ms else F.nullif(F.col("_span") / 1000, F.lit(0.0))
            return total.select(*labels, (F.col(value) / seconds).alias(value))
        return total.select(*labels, value)
    raise Unsupported(f"the function {function}")


def _gain(function: str, before: Column, after: Column) -> Column:
    """What a step from one value to the next adds; 0 where there is none before."""
    if function == "changes":
        return F.when(before.isNotNull() & (after != before), 1.0).otherwise(0.0)
    if function == "resets":
        return F.when(after < before, 1.0).otherwise(0.0)
    if function == "delta":
        return F.when(before.isNull(), 0.0).otherwise(after - before)
    return F.when(before.isNull(), 0.0).when(after < before, after).otherwise(after - before)


def _gains(seen: DataFrame, function: str, labels: Sequence[str], value: str) -> DataFrame:
    """Labels, the sum of a series' gains as ``value``, and its ``_span``.

    Steps are taken within stretches of time, each by one task, and each stretch leaves a row: its gain, ends and first and
    last value.  The steps between stretches are taken over these.
    """
    stretch = F.floor(F.col("ts_ms") / STRETCH_MS).alias("_stretch")
    rows = seen.select(*labels, "ts_ms", F.col(value).alias("_v"), stretch)
    before = F.lag("_v").over(Window.partitionBy(*labels, "_stretch").orderBy("ts_ms"))
    parts = (
        rows.withColumn("_before", before)
        .groupBy(*labels, "_stretch")
        .agg(
            F.sum(_gain(function, F.col("_before"), F.col("_v"))).alias("_inside"),
            F.min_by("_v", "ts_ms").alias("_first"),
            F.max_by("_v", "ts_ms").alias("_last"),
            F.min("ts_ms").alias("_from"),
            F.max("ts_ms").alias("_to"),
        )
    )
    between = _gain(function, F.lag("_last").over(Window.partitionBy(*labels).orderBy("_stretch")), F.col("_first"))
    return parts.withColumn("_between", between).groupBy(*labels).agg(
        (F.sum("_inside") + F.sum("_between")).alias(value), (F.max("_to") - F.min("_from")).alias("_span")
    )


def _last_two(df: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*labels).orderBy(F.desc("ts_ms"))
    two = df.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    out = two.groupBy(*labels).agg(pick(1, value).alias("_b"), pick(1, "ts_ms").alias("_tb"), pick(2, value).alias("_a"), pick(2, "ts_ms").alias("_ta"))
    return out.where(F.col("_ta").isNotNull())


def over_time_grid(df: DataFrame, function: str, labels: Sequence[str], range_ms: int, value: str = "value") -> DataFrame:
    """A range function at every sample: over the ``range_ms`` that end with it, its own slot included.

    ``*_over_time``, and ``increase``, ``rate``, ``delta``, ``changes`` and ``resets`` by the steps between the samples of the range.

    A series is cut into stretches of time, ``range_ms`` at least.  A sample also goes to the stretch after its own as
    context, so each stretch is worked on by itself, however long the series.
    """
    name = function.removesuffix("_over_time")
    steps = function in ("increase", "rate", "delta", "changes", "resets")
    if not steps and name not in _SIMPLE and name != "last":
        raise Unsupported(f"{function} on the grid")
    width = max(STRETCH_MS, range_ms)
    own = F.floor(F.col("ts_ms") / width)
    # Only samples near the end of a stretch can be in the range of one in the next.
    near = F.floor((F.col("ts_ms") + range_ms) / width)
    rows = df.where(F.col(value).isNotNull()).select(*labels, "ts_ms", F.col(value).alias("_v"), own.alias("_own"), F.explode(F.array_distinct(F.array(own, near))).alias("_stretch"))
    series = Window.partitionBy(*labels, "_stretch").orderBy("ts_ms")
    w = series.rangeBetween(-range_ms + 1, 0)
    if steps:
        rows = rows.withColumn("_gain", _gain(function, F.lag("_v").over(series), F.col("_v")))
        # The step to the first sample of the range began before it.
        out = F.sum("_gain").over(w) - F.first("_gain").over(w)
        if function == "rate":
            out = out / (range_ms / 1000)
    else:
        out = F.col("_v") if name == "last" else _SIMPLE[name]("_v").over(w)
    return rows.select(*labels, "ts_ms", "_own", "_stretch", out.alias(value)).where("_own = _stretch").drop("_own", "_stretch")
