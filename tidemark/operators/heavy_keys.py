"""Per-key totals when a few keys hold most rows.

Rows are range partitioned on the key and a secondary order, with bounds from Spark's
sampled quantiles, so a heavy key is cut into as many slices as its share of the rows
calls for.  Each slice yields one partial state per key it touches; the states of a key
that crosses slice bounds are then stitched.  Only the states, at most one per key and
slice, move in that last step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import exact_part, huge_part, usable


def slice_count(df: DataFrame, slices: int | None) -> int:
    return slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keyed_totals(
    df: DataFrame,
    key: str,
    ts: str,
    value: str,
    tiebreak: str | None = None,
    row_mark: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """One row for each value of ``key``, however unevenly the rows are spread.

    Columns: ``key``, ``n_rows``, ``n_readings`` (usable values), ``total`` (exact decimal of
    the usable values below 1e20), ``total_huge`` (the others, as double), ``first_ms``,
    ``last_ms`` (over all rows with a time) and ``n_slices`` (slices the key was cut into).

    ``tiebreak`` is a further column of the secondary order: it lets rows of one key and one
    time be cut too.  ``row_mark`` names a boolean column that says which rows count in
    ``n_rows``; without it all do.

    NULL is a key of its own and differs from ``""``.  NULL, NaN and infinite values count as
    rows but not as readings; a key without readings has ``total`` 0.  Repeated rows each
    count.  An empty table gives no rows.  Other columns are not read, whatever their names.
    """
    rows = df.select(
        df[key].alias("key"),
        df[ts].cast("bigint").alias("_ts"),
        df[value].cast("double").alias("_value"),
        (df[tiebreak] if tiebreak else F.lit(0)).alias("_tie"),
        (df[row_mark] if row_mark else F.lit(True)).alias("_row"),
    )
    order = ["key", "_ts", "_value"] + (["_tie"] if tiebreak else [])
    cut = rows.repartitionByRange(slice_count(df, slices), *order)
    partial = (
        cut.withColumn("_slice", F.spark_partition_id())
        .groupBy("key", "_slice")
        .agg(
            F.count_if("_row").alias("n_rows"),
            F.count_if(usable(F.col("_value"))).alias("n_readings"),
            F.sum(exact_part(F.col("_value"))).alias("total"),
            F.sum(huge_part(F.col("_value"))).alias("total_huge"),
            F.min("_ts").alias("first_ms"),
            F.max("_ts").alias("last_ms"),
        )
    )
    return partial.groupBy("key").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_readings").alias("n_readings"),
        F.coalesce(F.sum("total").cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)")).alias("total"),
        F.coalesce(F.sum("total_huge"), F.lit(0.0)).alias("total_huge"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.count("*").cast("int").alias("n_slices"),
    )


def heavy_keys(totals: DataFrame, n_all: DataFrame, share: float) -> DataFrame:
    """The rows of :func:`keyed_totals` with more than ``share`` of all rows.

    ``n_all`` has one row with one number, the count of all rows; it enters as a scalar
    subquery.  The NULL key isn't a key that can be heavy.
    """
    return totals.where(F.col("key").isNotNull() & (F.col("n_rows") > F.lit(share) * n_all.scalar()))
