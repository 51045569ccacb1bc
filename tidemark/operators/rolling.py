"""Trailing totals per series and day from event contributions.

A day's amount enters the running sum on its day and leaves it when the window has passed.
Between two such events nothing changes, so the running sums are taken over the events
alone, and each is repeated for the days up to the next event.  No day is joined with the
days before it, and no window frame is rescanned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import exact_part, floor_day, huge_part, usable


def daily_amounts(df: DataFrame, key: str, ts: str, value: str, seq: str) -> DataFrame:
    """Exact sum and count of the usable readings of each key and day.

    Of rows with the same key and time only the last by ``seq`` counts.  Copies are brought together
    before rows are spread by key and time, and a day's amounts before they are spread by key and
    day, so neither a heavy key nor a heavily copied reading burdens one task.
    """
    rows = df.select(
        df[key].alias("key"), df[ts].cast("bigint").alias("_ts"), df[value].cast("double").alias("_value"), df[seq].alias("_seq")
    ).where(usable(F.col("_value")) & F.col("_ts").isNotNull())
    kept = rows.groupBy("key", "_ts").agg(F.max_by("_value", "_seq").alias("_value")).withColumn("day", floor_day(F.col("_ts")))
    return kept.groupBy("key", "day").agg(
        F.coalesce(F.sum(exact_part(F.col("_value"))), F.lit(0)).cast("decimal(36,6)").alias("amount"),
        F.coalesce(F.sum(huge_part(F.col("_value"))), F.lit(0.0)).alias("huge"),
        F.count_if(F.abs("_value") >= 1e20).alias("n_huge"),
        F.count("*").alias("n"),
    )


def rolling_totals(
    df: DataFrame, key: str, ts: str, value: str, seq: str, windows: Sequence[int] = (7, 30)
) -> DataFrame:
    """One row per key and day from the key's first to its last day with usable readings.

    Columns: ``key``, ``day`` (number of the UTC day) and for each window w ``n_{w}d``
    (readings in the w days that end with this day), ``total_{w}d`` (exact decimal, of values
    below 1e20; NULL when the window holds no reading), ``huge_{w}d`` (the others, as double,
    0 when there are none) and ``avg_{w}d`` (per reading; NULL when there is none).

    Days without readings have rows too.  NULL is a key of its own.  NULL and non-finite
    values and rows without a time are left out; a key that has nothing else gives no row.
    Re-delivered rows count once; of corrections the one with the highest ``seq`` counts, which
    no two usable rows of a key and time share.  An empty table gives no rows.
    """
    daily = daily_amounts(df, key, ts, value, seq)
    fields = ["amount", "huge", "n_huge", "n"]
    zero = {"amount": F.lit(0).cast("decimal(36,6)"), "huge": F.lit(0.0), "n_huge": F.lit(0).cast("bigint"), "n": F.lit(0).cast("bigint")}

    def event(shift: int, leaving: int | None):
        """Deltas of a daily amount, ``shift`` days on: all windows gain it or one loses it."""
        parts = [(F.col("day") + shift).cast("int").alias("day"), (F.lit(shift == 0)).alias("active")]
        for w in windows:
            for f in fields:
                delta = F.col(f) if leaving is None else (-F.col(f) if leaving == w else zero[f])
                parts.append(delta.cast(dict(amount="decimal(36,6)", huge="double").get(f, "bigint")).alias(f"{f}_{w}"))
        return F.struct(*parts)

    events = daily.select("key", F.inline(F.array(event(0, None), *[event(w, w) for w in windows])))
    deltas = [f"{f}_{w}" for w in windows for f in fields]
    per_day = (
        events.repartition("key")
        .groupBy("key", "day")
        .agg(F.max("active").alias("active"), *[F.sum(c).alias(c) for c in deltas])
    )
    run = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = per_day.select(
        "key",
        "day",
        F.lead("day").over(Window.partitionBy("key").orderBy("day")).alias("_next"),
        F.max(F.when(F.col("active"), F.col("day"))).over(Window.partitionBy("key")).alias("_last"),
        *[F.sum(c).over(run).alias(c) for c in deltas],
    ).where(F.col("day") <= F.col("_last"))
    spread = running.withColumn(
        "day", F.explode(F.sequence("day", F.least(F.coalesce(F.col("_next") - 1, F.col("day")), F.col("_last"))))
    )
    out = [F.col("key"), F.col("day")]
    for w in windows:
        full = F.col(f"n_{w}") > 0
        huge = F.when(F.col(f"n_huge_{w}") > 0, F.col(f"huge_{w}")).otherwise(F.lit(0.0))
        out += [
            F.col(f"n_{w}").alias(f"n_{w}d"),
            F.when(full, F.col(f"amount_{w}").cast("decimal(38,6)")).alias(f"total_{w}d"),
            huge.alias(f"huge_{w}d"),
            F.when(full, (F.col(f"amount_{w}").cast("double") + huge) / F.col(f"n_{w}")).alias(f"avg_{w}d"),
        ]
    return spread.select(*out)


def day_text(day: Column) -> Column:
    """``YYYY-MM-DD`` of a day number."""
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")
