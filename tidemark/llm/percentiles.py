"""Percentiles per group from mergeable compactor hierarchies.

A sketch keeps levels of values.  A full level is sorted, a coin picks the odd or the even
places, and those values move up with twice the weight; sketches merge level by level.  These
are the KLL sketches that Spark builds inside the JVM, with map-side partial sketches, so a hot
group sends one sketch per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import floor_day, usable

#: Size of the top compactor.
K = 800
QUANTILES = (0.5, 0.9, 0.95, 0.99)


def rank_error(k: int) -> float:
    """Bound of the normalised rank error of one percentile, met with a probability of 99 %.

    The one that the library of the sketches states for single ranks; the two constants are its.
    """
    return 2.296 / k**0.9723


def daily_sketches(df: DataFrame, groupings: Sequence[Sequence[str]], ts: str, value: str, k: int = K) -> DataFrame:
    """One sketch per grouping, key and UTC day: ``grouping``, ``keys`` (array), ``day``, ``n``, ``sketch``.

    ``grouping`` names the columns, joined with ``+``; ``keys`` has their values as strings, NULL
    staying NULL.  NULL, NaN and infinite values and rows without a time are left out.  Repeated
    rows each count.  Empty tables give no rows; other columns aren't read.
    """
    needed = list(dict.fromkeys(c for g in groupings for c in g))
    rows = df.select(
        *[df[c].cast("string").alias(f"g_{c}") for c in needed], floor_day(df[ts]).alias("day"), df[value].cast("double").alias("_value")
    ).where(usable(F.col("_value")) & F.col("day").isNotNull())
    each = F.array(*[F.struct(F.lit("+".join(g)).alias("grouping"), F.array(*[F.col(f"g_{c}") for c in g]).alias("keys")) for g in groupings])
    return (
        rows.select("day", "_value", F.inline(each))
        .groupBy("grouping", "keys", "day")
        .agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_value", F.lit(k)).alias("sketch"))
    )


def combine(sketches: DataFrame, by: Sequence[str] = ("grouping", "keys"), k: int = K) -> DataFrame:
    """Sketches of several days, or of separate tables of them, merged."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def percentiles(sketches: DataFrame, quantiles: Sequence[float] = QUANTILES, k: int = K) -> DataFrame:
    """The sketches' percentiles as ``p50``, ``p90`` ... and the stated ``rank_error``.

    Up to ``k`` values a sketch keeps them all and the percentiles are exact.
    """
    named = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *named, F.when(F.col("n") > k, F.lit(rank_error(k))).otherwise(0.0).alias("rank_error"))
