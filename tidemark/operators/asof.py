"""As-of joins: to each row the last row of another table with the same keys at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of a stretch of time that one task puts in order.
STRETCH_MS = 86_400_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    tolerance_ms: int | None = None,
    stretch_ms: int | None = None,
) -> DataFrame:
    """All rows and columns of ``left`` with ``matched_ts`` and ``values`` of the last ``right`` row of its keys that is not later.

    Times are epoch milliseconds.  A row without such a row, or with none within ``tolerance_ms``, gets NULLs.  NULL is a
    key of its own.  Rows of ``right`` with equal keys and times count as one, the largest by ``values``; those without a
    time are left out.  A left row without a time gets NULLs.  ``values`` must not be columns of ``left``.

    Both sides are put in order by key and stretch of time, so a key of any size is spread over many tasks; what a
    stretch leaves to later ones is one row, carried on over the stretches of a key.
    """
    width = stretch_ms or STRETCH_MS
    keys = [f"_k{i}" for i in range(len(by))]
    stretch = lambda t: F.floor(t / F.lit(width))
    r = right.where(right[right_ts].isNotNull()).select(
        *[right[b].alias(k) for b, k in zip(by, keys, strict=True)], right[right_ts].cast("bigint").alias("_t"), F.struct(*[right[v] for v in values]).alias("_v")
    )
    r = r.groupBy(*keys, "_t").agg(F.max(F.struct("_t", "_v")).alias("_last")).withColumn("_stretch", stretch(F.col("_t")))
    rows = left.select(*[left[b].alias(k) for b, k in zip(by, keys, strict=True)], left[left_ts].cast("bigint").alias("_t"), F.struct(*[left[c] for c in left.columns]).alias("_row"))
    rows = rows.withColumn("_stretch", stretch(F.col("_t")))
    both = rows.select(*keys, "_stretch", "_t", F.lit(1).alias("_side"), "_row", F.lit(None).cast(r.schema["_last"].dataType).alias("_last")).unionByName(
        r.select(*keys, "_stretch", "_t", F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_last")
    )
    within = Window.partitionBy(*keys, "_stretch").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_last", ignorenulls=True).over(within)).where("_side = 1").select(*keys, "_stretch", "_t", "_row", "_seen")
    # What earlier stretches leave: for each stretch of a key, the last right row of the stretches before it.
    ends = both.groupBy(*keys, "_stretch").agg(F.max("_last").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    left_over = ends.select(*[F.col(k).alias(f"_e{k}") for k in keys], F.col("_stretch").alias("_e_stretch"), F.max("_end").over(before).alias("_before"))
    same = F.col("_stretch") == F.col("_e_stretch")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e{k}"))
    found = F.coalesce("_seen", "_before")
    if tolerance_ms is not None:
        found = F.when(F.col("_t") - found["_t"] <= tolerance_ms, found)
    found = F.when(F.col("_t").isNotNull(), found)
    return seen.join(left_over, same, "left").select("_row.*", found["_t"].alias("matched_ts"), *[found["_v"][v].alias(v) for v in values])
