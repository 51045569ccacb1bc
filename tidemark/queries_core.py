"""Queries of the general data-quality operators over the tables of a data folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.heavy_keys import heavy_keys, keyed_totals
from tidemark.operators.regular_grid import regular_grid
from tidemark.operators.rolling import day_text, rolling_totals
from tidemark.operators.spikes import faulty_readings
from tidemark.sources.remote_write import exploded_readings


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- faulty readings


def p1_faults(spark: SparkSession, folder: str) -> DataFrame:
    return faulty_readings(table(spark, folder, "samples"), table(spark, folder, "metric_meta"), "series_id", "metric", "ts_ms", "value", "seq")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_faults(spark, folder).select("seq")


def p1_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return p1_faults(spark, folder).where("fault = 'bounds'").select("seq")


P1_BOUNDS_SQL = """
select seq from samples join metric_meta using (metric)
where value is not null and (not isfinite(value) or value < lo or (value > hi and not isnan(hi)))
"""


# --- heavy keys


def samples_by_instance(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_totals(table(spark, folder, "samples"), "instance", "ts_ms", "value", tiebreak="seq")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    n_all = table(spark, folder, "samples").agg(F.count(F.lit(1)).alias("n"))
    return heavy_keys(samples_by_instance(spark, folder), n_all, 0.02).select(F.col("key").alias("instance"))


P3_FOUND_SQL = """
select instance from samples where instance is not null
group by instance having count(*) > 0.02 * (select count(*) from samples)
"""


def p3_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals per instance of samples, and per tenant and per series length of remote_writes."""
    readings = exploded_readings(table(spark, folder, "remote_writes"), ["tenant"])
    named = [
        ("samples.instance", samples_by_instance(spark, folder)),
        ("remote_writes.tenant", keyed_totals(readings, "tenant", "ts_ms", "value", tiebreak="request_id", row_mark="is_first")),
        ("remote_writes.length", keyed_totals(readings.withColumn("length", F.col("length").cast("string")), "length", "ts_ms", "value", tiebreak="request_id", row_mark="is_first")),
    ]
    parts = [
        d.select(F.lit(name).alias("keyed_by"), "key", "n_rows", "n_readings", "total", "first_ms", "last_ms") for name, d in named
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TOTALS = """
  cast(count_if({mark}) as bigint) n_rows, cast(coalesce(count_if(isfinite(value)), 0) as bigint) n_readings,
  cast(coalesce(sum(case when isfinite(value) and abs(value) < 1e20 then cast(value as decimal(26,6)) end), 0) as decimal(38,6)) total,
  min(ts_ms) first_ms, max(ts_ms) last_ms
"""
P3_TOTALS_SQL = f"""
with series as (select unnest(timeseries) t from remote_writes),
labelled as (select [l.value for l in t.labels if l.name = 'tenant'][1] tenant, len(t.samples) length, t.samples s from series),
readings as (
  select tenant, length, unnest(s).value as value, unnest(s)."timestamp" ts_ms, generate_subscripts(s, 1) = 1 is_first from labelled where length > 0
  union all select tenant, length, null, null, true from labelled where coalesce(length, 0) = 0)
select 'samples.instance' keyed_by, instance "key", {_TOTALS.format(mark="true")} from samples group by instance
union all select 'remote_writes.tenant', tenant, {_TOTALS.format(mark="is_first")} from readings group by tenant
union all select 'remote_writes.length', cast(length as varchar), {_TOTALS.format(mark="is_first")} from readings group by length
"""


# --- regular grid


def samples_grid(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid(table(spark, folder, "samples"), table(spark, folder, "metric_meta"), "series_id", "metric", "ts_ms", "value", "seq")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return samples_grid(spark, folder).where("filled").select(F.col("key").alias("series_id"), "slot_ms")


_P4_BASE = """
with usable as (select series_id, interval_ms, ts_ms // interval_ms * interval_ms slot_ms, value, seq
  from samples join metric_meta using (metric) where isfinite(value)),
spans as (select series_id, any_value(interval_ms) step, min(slot_ms) f, max(slot_ms) l from usable group by series_id),
grid as (select series_id, unnest(generate_series(f, l, step)) slot_ms from spans)
"""
P4_FOUND_SQL = _P4_BASE + "select series_id, slot_ms from grid anti join usable using (series_id, slot_ms)"


def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every period of every series, observed or filled."""
    return samples_grid(spark, folder).withColumnRenamed("key", "series_id")


def p4_observed(spark: SparkSession, folder: str) -> DataFrame:
    """The periods with their last readings, and whether they are filled; no predicted values."""
    return samples_grid(spark, folder).select(
        F.col("key").alias("series_id"), "slot_ms", "n_readings", "filled", F.when(~F.col("filled"), F.col("value")).alias("value")
    )


P4_OBSERVED_SQL = (
    _P4_BASE
    + """, seen as (select series_id, slot_ms, count(*) n_readings, arg_max(value, seq) value from usable group by all)
select series_id, slot_ms, coalesce(n_readings, 0) n_readings, n_readings is null filled, value
from grid left join seen using (series_id, slot_ms)"""
)


def p4_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth period is held out of the grid and predicted: for each metric how many that are, and whether the
    median error is at most 1.5 times the median distance of the readings from their series' mean.

    A bridge between two readings of a series that is nothing but noise misses by 1.22 times that distance; a millionth of
    the values' size is allowed besides.  Of fewer than 50 readings the medians tell nothing.
    """
    samples, meta = table(spark, folder, "samples"), table(spark, folder, "metric_meta")
    period = F.call_function("div", F.col("ts_ms"), F.col("interval_ms"))
    rows = samples.join(meta.select("metric", "interval_ms", "lo", "hi"), "metric").withColumn("slot_ms", period * F.col("interval_ms")).withColumn("held", period % 20 == 7)
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    grid = regular_grid(rows.where("not held"), meta, "series_id", "metric", "ts_ms", "value", "seq").where("filled").select(F.col("key").alias("k"), F.col("slot_ms").alias("s"), F.col("value").alias("predicted"))
    sound = (F.col("value") >= F.nanvl(F.coalesce("lo", F.lit(float("-inf"))), F.lit(float("-inf")))) & (F.col("value") <= F.nanvl(F.coalesce("hi", F.lit(float("inf"))), F.lit(float("inf"))))
    known = rows.where(F.col("value").isNotNull() & finite)
    held = known.where("held").groupBy("metric", "series_id", "slot_ms").agg(F.max_by(F.struct("value", "lo", "hi"), "seq").alias("v")).select("metric", "series_id", "slot_ms", "v.*").where(sound)
    mean = known.where(~F.col("held") & sound).groupBy(F.col("series_id").alias("m")).agg(F.avg("value").alias("mean"))
    both = held.join(grid, (F.col("series_id") == F.col("k")) & (F.col("slot_ms") == F.col("s"))).join(mean, F.col("series_id") == F.col("m"), "left")
    middle = lambda c: F.percentile(F.abs(c), F.lit(0.5))
    well = middle(F.col("value") - F.col("predicted")) <= 1.5 * middle(F.col("value") - F.col("mean")) + 1e-6 * middle(F.col("value"))
    return both.groupBy("metric").agg(F.count("*").alias("n_held"), (well | (F.count("*") < 50)).alias("predicted_well"))


P4_MASKED_SQL = """
with usable as (select metric, series_id, ts_ms // interval_ms * interval_ms slot_ms, ts_ms // interval_ms % 20 = 7 held, value, seq, lo, hi
  from samples join metric_meta using (metric) where isfinite(value)),
spans as (select series_id, min(slot_ms) f, max(slot_ms) l from usable where not held group by series_id),
last as (select metric, series_id, slot_ms, arg_max(value, seq) v, any_value(lo) lo, any_value(hi) hi from usable where held group by all)
select metric, count(*) n_held, true predicted_well from last join spans using (series_id)
where slot_ms > f and slot_ms < l and v >= coalesce(lo, '-inf'::double) and v <= coalesce(hi, 'inf'::double) group by metric
"""


# --- rolling totals


def samples_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return rolling_totals(table(spark, folder, "samples"), "series_id", "ts_ms", "value", "seq")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return samples_rolling(spark, folder).where("n_7d = 0").select(F.col("key").alias("series_id"), day_text(F.col("day")).alias("day"))


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    r = samples_rolling(spark, folder)
    # An average is cut to three places in the same steps as in the SQL, as rounding differs between engines.
    cut = lambda c: (F.floor(F.col(c) * 1000) / 1000).alias(c)
    return r.select(
        F.col("key").alias("series_id"), day_text(F.col("day")).alias("day"), "n_7d", "total_7d", cut("avg_7d"), "n_30d", "total_30d", cut("avg_30d")
    )


_P6_BASE = """
with kept as (select series_id, ts_ms, arg_max(value, seq) v from samples where isfinite(value) group by all),
daily as (select series_id, cast(epoch_ms(ts_ms) as date) d, count(*) n, sum(cast(v as decimal(26,6))) a from kept group by all),
days as (select series_id, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) d from daily group by series_id),
per as (select series_id, d, coalesce(n, 0) n, coalesce(a, 0) a from days left join daily using (series_id, d)),
roll as (select series_id, d,
  cast(sum(n) over w7 as bigint) n_7d, cast(sum(a) over w7 as decimal(38,6)) t7,
  cast(sum(n) over w30 as bigint) n_30d, cast(sum(a) over w30 as decimal(38,6)) t30
  from per window w7 as (partition by series_id order by d rows 6 preceding), w30 as (partition by series_id order by d rows 29 preceding))
"""
P6_FOUND_SQL = _P6_BASE + "select series_id, strftime(d, '%Y-%m-%d') as day from roll where n_7d = 0"
P6_TOTALS_SQL = (
    _P6_BASE
    + """select series_id, strftime(d, '%Y-%m-%d') as day, n_7d, case when n_7d > 0 then t7 end total_7d,
  case when n_7d > 0 then floor(t7::double / n_7d * 1000) / 1000 end avg_7d,
  n_30d, case when n_30d > 0 then t30 end total_30d, case when n_30d > 0 then floor(t30::double / n_30d * 1000) / 1000 end avg_30d
from roll"""
)


QUERIES = {
    "p1_found": p1_found,
    "p1_faults": p1_faults,
    "p1_bounds": p1_bounds,
    "p3_found": p3_found,
    "p3_totals": p3_totals,
    "p4_found": p4_found,
    "p4_grid": p4_grid,
    "p4_masked": p4_masked,
    "p4_observed": p4_observed,
    "p6_found": p6_found,
    "p6_totals": p6_totals,
}
SQL = {
    "p1_bounds": P1_BOUNDS_SQL,
    "p3_found": P3_FOUND_SQL,
    "p3_totals": P3_TOTALS_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_masked": P4_MASKED_SQL,
    "p4_observed": P4_OBSERVED_SQL,
    "p6_found": P6_FOUND_SQL,
    "p6_totals": P6_TOTALS_SQL,
}
