"""Queries of the engine's own operators over the tables of a data folder, with their SQL."""

from __future__ import annotations

import io
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.shared import shared_folder
from tidemark.model import Matcher, TableMeta
from tidemark.operators import aggregate as agg
from tidemark.operators import grid
from tidemark.operators.asof import asof_join
from tidemark.sources.remote_write import exploded_readings
from tidemark.streaming.ingest import ingest_exactly, latest

QUARTER = TableMeta(series_len=120, interval_ms=900_000)
DAY = TableMeta(series_len=120, interval_ms=86_400_000)
#: A metric of remote_writes.
REMOTE_METRIC = "scan_bytes"
#: 2024-01-10, 2024-01-20 and 2024-01-31 UTC, off the grid by some minutes.
START, END, NOW = 1_704_845_100_000, 1_705_709_400_000, 1_706_659_200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def engine(spark: SparkSession, folder: str, *names: str, retention: bool = False) -> Engine:
    """An engine with the named tables."""
    e = Engine(spark)
    for name in names:
        if name in ("events", "coded"):
            events = table(spark, folder, "events").withColumn("user_id", F.col("user_id").cast("string"))
            events = events.withColumn("error_code", F.when(F.col("event_type") == "error", F.col("user_id")))
            e.register(name, events, ["event_type", "user_id" if name == "events" else "error_code"], ["value"], "ts", "event_id", QUARTER, retention)
        elif name == "orders":
            e.register(name, table(spark, folder, name), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], "o_orderdate", "o_orderkey", DAY, retention)
        elif name == "lineitem":
            e.register(name, table(spark, folder, name), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_shipdate", None, DAY)
        else:
            e.register(name, table(spark, folder, name), ["metric", "job", "instance", "zone", "sensor"], ["value"], "ts_ms", "seq", TableMeta(120, 60_000))
    return e


def _event_rows(labels: str = "event_type, user_id", where: str = "true") -> str:
    return f"""
with base as (select event_type, cast(user_id as varchar) user_id, case when event_type = 'error' then cast(user_id as varchar) end error_code,
  epoch_ms(ts) // 900000 * 900000 ts_ms, value, event_id from events),
kept as (select *, ts_ms // 108000000 * 108000000 chunk_start, cast((ts_ms % 108000000) // 900000 as integer) slot from base where {where}
  qualify row_number() over (partition by {labels}, ts_ms order by event_id desc) = 1)
"""


def _long(labels: str = "event_type, user_id", where: str = "true") -> str:
    return _event_rows(labels, where) + f"select {labels}, chunk_start, slot, ts_ms, value from kept"


_SAMPLE_LABELS = "metric, job, instance, zone, sensor"


def _samples(where: str) -> str:
    return f"""
select {_SAMPLE_LABELS}, count(*) n, sum(case when isfinite(value) and abs(value) < 1e15 then cast(value as decimal(26,6)) end)::decimal(38,6) total from (
  select {_SAMPLE_LABELS}, value, seq, ts_ms // 60000 slot from samples where {where}
  qualify row_number() over (partition by {_SAMPLE_LABELS}, ts_ms // 60000 order by seq desc) = 1) group by all
"""


def _sample_series(*matchers: Matcher) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = engine(spark, folder, "samples").scan("samples", None, matchers)
        finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < 1e15)
        return rows.groupBy(*_SAMPLE_LABELS.split(", ")).agg(
            F.count("*").alias("n"), F.sum(F.when(finite, F.col("value").cast("decimal(26,6)"))).cast("decimal(38,6)").alias("total")
        )

    return run


def _scan(name: str, *matchers: Matcher, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: engine(spark, folder, name).scan(name, None, matchers, **options)


def _promql(text: str, places: int | None = 6, **fixed) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = engine(spark, folder, "events").query(text, now_ms=NOW)
        return out if places is None else out.withColumn("value", F.round(F.col("value").cast("double"), places))

    return run


def _aggregated(function: str, by: str, where: str = "true", group: str = "ts_ms") -> str:
    keys = ", ".join(x for x in (by, group) if x)
    return _event_rows(where=where) + f"select {keys + ', ' if keys else ''}round(cast({function} as double), 6) as value from kept where value is not null" + (f" group by {keys}" if keys else "")


def chunk_assign(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder, "events").scan("events").groupBy("chunk_start").agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def _wide_stats(name: str, scalar: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = engine(spark, folder, name)
        w = e.scan(name, wide=True, **options)
        labels = list(e.table(name).schema.labels)
        filled = F.filter(F.transform(scalar, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
        return w.select("start_at", *labels, "first_slot", F.size(scalar).alias("n_slots"), F.size(filled).alias("n_values"), F.coalesce(F.array_min(filled), F.lit(-1)).alias("first_value_at"))

    return run


def _wide_sql(keep_empty: bool) -> str:
    s, e = START // 900_000 * 900_000, END // 900_000 * 900_000
    return (
        _event_rows()
        + f""", per as (select chunk_start start_at, event_type, user_id,
  cast(least(greatest(({s} - chunk_start) // 900000, 0), 120) as integer) lo, cast(least(greatest(({e} - chunk_start) // 900000, 0), 120) as integer) hi, slot, value
  from kept where chunk_start > {s} - 108000000 and chunk_start < {e}),
stats as (select start_at, event_type, user_id, lo first_slot, hi - lo n_slots,
  cast(count_if(value is not null and slot >= lo and slot < hi) as integer) n_values, coalesce(min(case when slot >= lo and slot < hi then slot - lo end), -1) first_value_at
  from per group by all)
select * from stats {"" if keep_empty else "where n_values > 0"}"""
    )


def wide_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder, "events")
    return grid.from_wide(e.scan("events", wide=True), ["event_type", "user_id"], ["value"], QUARTER)


def projection_multi(spark: SparkSession, folder: str) -> DataFrame:
    rows = engine(spark, folder, "lineitem").scan("lineitem", ["l_quantity", "l_tax"])
    return rows.groupBy("l_returnflag", "l_linestatus", "ts_ms").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(38,2)").alias("quantity"), F.sum(F.col("l_tax").cast("decimal(18,2)")).cast("decimal(38,2)").alias("tax")
    )


def int_coercion(spark: SparkSession, folder: str) -> DataFrame:
    e = Engine(spark)
    e.register("whole", table(spark, folder, "samples"), ["metric"], {"value": "int"}, "ts_ms", None, TableMeta(120, 60_000))
    return e.scan("whole").groupBy("metric").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"))


def limit_sorted(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder, "events").scan("events", limit=25, wide=True).select("start_at", "event_type", "user_id")


def limit_long(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder, "coded").scan("coded", limit=25)


def remote_write_nested(spark: SparkSession, folder: str) -> DataFrame:
    rows = exploded_readings(table(spark, folder, "remote_writes"), ["__name__", "tenant", "zone"])
    return rows.groupBy("__name__", "tenant", "zone").agg(F.count("ts_ms").alias("n"), F.count_if("is_first").alias("n_series"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def remote_write_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric of the requests as a table of its own: slots and their values after last write wins."""
    e = Engine(spark, schema_mode="evolve")
    e.ingest(table(spark, folder, "remote_writes"), meta=TableMeta(60, 60_000), path=shared_folder(spark))
    v = F.col("value")
    kept = F.when(v.isNotNull() & ~F.isnan(v), v.cast("decimal(26,6)"))
    return e.scan_ingested().groupBy("metric").agg(F.count("*").alias("n_slots"), F.sum(kept).cast("decimal(38,6)").alias("total"), F.max("ts_ms").alias("last_ms"))


def remote_write_table(spark: SparkSession, folder: str) -> DataFrame:
    """One of the tables that requests ingested in two goes make, by its labels."""
    e, path = Engine(spark, schema_mode="evolve"), shared_folder(spark)
    requests = table(spark, folder, "remote_writes")
    for half in (0, 1):
        e.ingest(requests.where(F.pmod("request_id", F.lit(2)) == half), meta=TableMeta(60, 60_000), path=path)
    return e.scan(REMOTE_METRIC).groupBy("tenant", "zone").agg(F.count("*").alias("n_slots"), F.max("ts_ms").alias("last_ms"))


def archive_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    e, path = engine(spark, folder, "events"), shared_folder(spark)
    e.archive("events", path)
    e.open_archive("old", path, ["event_type", "user_id"], {"value": "float"}, QUARTER)
    return e.scan("old", None, [Matcher("event_type", "=", "click")])


def arrow_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A result written as an Arrow file and read back."""
    e, f = engine(spark, folder, "events"), io.BytesIO()
    e.write_ipc(e.query("sum by (event_type) (events)", now_ms=NOW), f)
    t = pa.ipc.open_file(pa.BufferReader(f.getvalue())).read_all()
    return spark.createDataFrame(t).withColumn("value", F.round("value", 6))


def write_api(spark: SparkSession, folder: str) -> DataFrame:
    """Single writes: the daily order totals of each status, as series of their own."""
    rows = table(spark, folder, "orders").groupBy("o_orderstatus", F.unix_date(F.col("o_orderdate").cast("date")).alias("d")).agg(F.count("*").alias("n"))
    e = Engine(spark, DAY)
    for status in ("F", "O", "P"):
        one = [(r["d"] * 86_400_000, {"n": r["n"]}) for r in rows.where(F.col("o_orderstatus") == status).orderBy("d").collect()]
        if one:
            e.write("per_day", {"status": status}, one)
    e.with_retention("per_day", False)
    return e.scan("per_day").select("status", "ts_ms", "n")


def stream_final_state(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a stream of ten batches, in an order that isn't that of their dates; the final live rows."""
    path = shared_folder(spark)
    table(spark, folder, "orders").repartitionByRange(10, F.xxhash64("o_orderkey")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(table(spark, folder, "orders").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = ingest_exactly(stream, f"{path}/live", f"{path}/checkpoint", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], "o_orderdate", "o_orderkey", DAY)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return latest(spark, f"{path}/live").drop("_seq")


def asof_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each error with the last click of its user at or before it."""
    events = table(spark, folder, "events")
    events = events.withColumn("t", grid.epoch_ms(events, "ts"))
    errors, clicks = events.where("event_type = 'error'").select("event_id", "user_id", "t"), events.where("event_type = 'click'")
    return asof_join(errors, clicks, ["user_id"], "t", "t", ["value"]).select("event_id", "matched_ts", "value")


_ORDERS = """
with base as (select o_orderstatus, o_orderpriority, o_totalprice, o_orderkey, epoch_ms(cast(o_orderdate as timestamp)) // 86400000 * 86400000 ts_ms from orders),
grid as (select *, ts_ms // 10368000000 * 10368000000 chunk_start, cast((ts_ms % 10368000000) // 86400000 as integer) slot from base),
bound as (select greatest(max(chunk_start) - 4 * 10368000000, arg_min(chunk_start, o_orderkey)) b from grid)
select o_orderstatus, o_orderpriority, chunk_start, slot, ts_ms, o_totalprice from grid, bound where {where}
qualify row_number() over (partition by o_orderstatus, o_orderpriority, ts_ms order by o_orderkey desc) = 1
"""
_RETENTION = """, bound as (select greatest(max(ts_ms // 108000000 * 108000000) - 4 * 108000000, arg_min(ts_ms // 108000000 * 108000000, event_id)) b from base)
select event_type, user_id, chunk_start, slot, ts_ms, value from kept, bound where chunk_start >= b"""


def retention(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: engine(spark, folder, name, retention=True).scan(name)


def moving_average(spark: SparkSession, folder: str) -> DataFrame:
    rows = engine(spark, folder, "events").scan("events")
    return agg.over_time_grid(rows, "avg_over_time", ["event_type", "user_id"], 86_400_000).withColumn("value", F.round("value", 6))


def grid_increase(spark: SparkSession, folder: str) -> DataFrame:
    """What each series gained in the day before each of its samples."""
    rows = engine(spark, folder, "events").scan("events")
    return agg.over_time_grid(rows, "increase", ["event_type", "user_id"], 86_400_000).withColumn("value", F.round("value", 6))


_S, _E = START // 900_000 * 900_000, END // 900_000 * 900_000
_RANGE = f"ts_ms >= {NOW - 5 * 86_400_000}"
_STEPS = _event_rows(where=_RANGE) + ", steps as (select *, lag(value) over (partition by event_type, user_id order by ts_ms) p from kept) "
_GAIN = "sum(case when p is null then 0 when value < p then value else value - p end)"
_CLICK = "event_type = 'click'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_long": _scan("events"),
    "filter_eq": _scan("events", Matcher("event_type", "=", "click")),
    "filter_and": _scan("events", Matcher("event_type", "=", "click"), Matcher("user_id", "=", "8")),
    "filter_null": _scan("coded", Matcher("error_code", "=", None)),
    "filter_not_null": _scan("coded", Matcher("error_code", "!=", None)),
    "filter_ne": _scan("coded", Matcher("error_code", "!=", "8")),
    "filter_re": _scan("coded", Matcher("error_code", "=~", "1[0-9]|8")),
    "filter_nre": _scan("coded", Matcher("error_code", "!~", "1[0-9]|8")),
    "labels_empty": _sample_series(Matcher("sensor", "=", "")),
    "labels_missing": _sample_series(Matcher("sensor", "=", None)),
    "labels_not": _sample_series(Matcher("zone", "!=", "hill"), Matcher("sensor", "!~", "s.*")),
    "range_closed_open": _scan("events", start_ms=START, end_ms=END),
    "range_start_only": _scan("events", start_ms=START),
    "range_end_only": _scan("events", end_ms=END),
    "range_empty": _scan("events", start_ms=END, end_ms=START),
    "chunk_assign": chunk_assign,
    "dedup_last_write": _scan("orders"),
    "wide_stats": _wide_stats("events", "value", start_ms=START, end_ms=END),
    "wide_keep_empty": _wide_stats("events", "value", start_ms=START, end_ms=END, keep_empty=True),
    "wide_roundtrip": wide_roundtrip,
    "retention_events": retention("events"),
    "retention_orders_late": retention("orders"),
    "limit_sorted": limit_sorted,
    "limit_long": limit_long,
    "projection_multi": projection_multi,
    "int_coercion": int_coercion,
    "sum_by": _promql("sum by (event_type) (events)"),
    "sum_without": _promql("sum without (user_id) (events)"),
    "sum_all": _promql("sum(events)"),
    "avg_by": _promql("avg by (event_type) (events)"),
    "min_by": _promql("min by (event_type) (events)"),
    "max_by": _promql("max by (event_type) (events)"),
    "count_by": _promql("count by (user_id) (events)"),
    "stddev_by": _promql("stddev(events) by (event_type)"),
    "stdvar_by": _promql("stdvar by (event_type) (events)"),
    "group_by": _promql("group by (user_id) (events)"),
    "topk_by": _promql("topk by (event_type) (2, events)"),
    "bottomk_all": _promql("bottomk(1, events)"),
    "quantile_by": _promql("quantile by (event_type) (0.9, events)"),
    "count_values": _promql('count_values("v", events)'),
    "promql_selector": _promql('events{event_type="click",user_id=~"1.*"}'),
    "promql_range": _promql('events{event_type!="click"}[5d]'),
    "promql_name_label": _promql('{__name__="events",user_id="8"}'),
    "promql_sum_by": _promql('sum by (event_type) (events{user_id!~"1.*"}[5d])'),
    "promql_offset": _promql("sum(events[2d] offset 3d)"),
    "range_rate": _promql("rate(events[5d])", 9),
    "range_increase": _promql("increase(events[5d])"),
    "range_delta": _promql("delta(events[5d])"),
    "range_idelta": _promql("idelta(events[5d])"),
    "range_changes": _promql("changes(events[5d])"),
    "range_resets": _promql("resets(events[5d])"),
    "avg_over_time": _promql("avg_over_time(events[5d])"),
    "max_over_time": _promql("max_over_time(events[5d])"),
    "count_over_time": _promql("count_over_time(events[5d])"),
    "last_over_time": _promql("last_over_time(events[5d])"),
    "quantile_over_time": _promql("quantile_over_time(0.5, events[5d])"),
    "nested_sum_rate": _promql("sum by (event_type) (rate(events[5d]))", 9),
    "moving_average": moving_average,
    "sum_over_time": _promql("sum_over_time(events[5d])"),
    "min_over_time": _promql("min_over_time(events[5d])"),
    "stddev_over_time": _promql("stddev_over_time(events[5d])"),
    "stdvar_over_time": _promql("stdvar_over_time(events[5d])"),
    "present_over_time": _promql("present_over_time(events[5d])"),
    "range_irate": _promql("irate(events[5d])", 9),
    "grid_increase": grid_increase,
    "asof_events": asof_events,
    "binary_arithmetic": _promql("sum by (event_type) (events) / on (event_type) count by (event_type) (events) * 2"),
    "binary_compare": _promql("events > 450"),
    "binary_ignoring": _promql("sum by (event_type) (events) - ignoring (user_id) count by (event_type) (events) % 2"),
    "binary_power": _promql("(sum(events) + 1) ^ 0.5"),
    "binary_group_left": _promql("events / on (event_type) group_left sum by (event_type) (events)", 9),
    "binary_group_right": _promql("sum by (user_id) (events) - on (user_id) group_right events"),
    "functions_of_values": _promql("clamp(abs(ceil(events / -7)), 2, 50) + floor(sqrt(events)) - clamp_max(round(events, 5), 100)"),
    "label_functions": _promql('sum by (u) (label_replace(events, "u", "$1-$2", "user_id", "(.)(.*)"))'),
    "binary_bool": _promql("sum(events) >= bool 400"),
    "set_and": _promql('sum by (user_id) (events{event_type="click"}) and sum by (user_id) (events{event_type="view"})'),
    "set_unless": _promql('sum by (user_id) (events{event_type="click"}) unless sum by (user_id) (events{event_type="view"})'),
    "set_or": _promql('sum by (user_id) (events{event_type="click"}) or sum by (user_id) (events{event_type="view"})'),
    "remote_write_nested": remote_write_nested,
    "remote_write_tables": remote_write_tables,
    "remote_write_table": remote_write_table,
    "write_api": write_api,
    "archive_roundtrip": archive_roundtrip,
    "arrow_roundtrip": arrow_roundtrip,
    "stream_final_state": stream_final_state,
}

_BY_USER = "select user_id, ts_ms, round(sum(value), 6) as value from kept where event_type = '{}' group by all"
_TWO = _event_rows() + f", c as ({_BY_USER.format('click')}), v as ({_BY_USER.format('view')}) "

SQL = {
    "scan_long": _long(),
    "filter_eq": _long(where=_CLICK),
    "filter_and": _long(where=_CLICK + " and user_id = '8'"),
    "filter_null": _long("event_type, error_code", "error_code is null"),
    "filter_not_null": _long("event_type, error_code", "error_code is not null"),
    "filter_ne": _long("event_type, error_code", "error_code is distinct from '8'"),
    "filter_re": _long("event_type, error_code", "coalesce(regexp_full_match(error_code, '1[0-9]|8'), false)"),
    "filter_nre": _long("event_type, error_code", "not coalesce(regexp_full_match(error_code, '1[0-9]|8'), false)"),
    "labels_empty": _samples("sensor = ''"),
    "labels_missing": _samples("sensor is null"),
    "labels_not": _samples("zone is distinct from 'hill' and not coalesce(regexp_full_match(sensor, 's.*'), false)"),
    "range_closed_open": _long(where=f"ts_ms >= {_S} and ts_ms < {_E}"),
    "range_start_only": _long(where=f"ts_ms >= {_S}"),
    "range_end_only": _long(where=f"ts_ms < {_E}"),
    "range_empty": _long(where="false"),
    "chunk_assign": _event_rows() + "select chunk_start, count(*) n, min(slot) first_slot, max(slot) last_slot from kept group by chunk_start",
    "dedup_last_write": _ORDERS.format(where="true"),
    "wide_stats": _wide_sql(False),
    "wide_keep_empty": _wide_sql(True),
    "wide_roundtrip": _event_rows() + "select event_type, user_id, chunk_start, slot, ts_ms, value from kept where value is not null",
    "retention_events": _event_rows() + _RETENTION,
    "retention_orders_late": _ORDERS.format(where="chunk_start >= b"),
    "limit_sorted": _event_rows() + "select distinct chunk_start start_at, event_type, user_id from kept where value is not null order by all limit 25",
    "limit_long": _event_rows("event_type, error_code")
    + ", first as (select distinct chunk_start, event_type, error_code from kept order by chunk_start, event_type nulls first, error_code nulls first limit 25) "
    + "select event_type, error_code, chunk_start, slot, ts_ms, value from kept k where exists (select 1 from first f where f.chunk_start = k.chunk_start and f.event_type is not distinct from k.event_type and f.error_code is not distinct from k.error_code)",
    "projection_multi": """select l_returnflag, l_linestatus, epoch_ms(cast(l_shipdate as timestamp)) // 86400000 * 86400000 ts_ms, count(*) n,
  cast(sum(cast(l_quantity as decimal(18,2))) as decimal(38,2)) quantity, cast(sum(cast(l_tax as decimal(18,2))) as decimal(38,2)) tax from lineitem group by all""",
    "int_coercion": """select metric, count(*) n, cast(sum(cast(case when isnan(value) then 0 when value >= 9223372036854775807 then 9223372036854775807
  when value <= -9223372036854775808 then -9223372036854775808 else cast(trunc(value) as hugeint) end as decimal(38,0))) as decimal(38,0)) total from samples group by metric""",
    "sum_by": _aggregated("sum(value)", "event_type"),
    "sum_without": _aggregated("sum(value)", "event_type"),
    "sum_all": _aggregated("sum(value)", ""),
    "avg_by": _aggregated("avg(value)", "event_type"),
    "min_by": _aggregated("min(value)", "event_type"),
    "max_by": _aggregated("max(value)", "event_type"),
    "count_by": _aggregated("count(value)", "user_id"),
    "stddev_by": _aggregated("stddev_pop(value)", "event_type"),
    "stdvar_by": _aggregated("var_pop(value)", "event_type"),
    "group_by": _aggregated("1", "user_id"),
    "topk_by": _event_rows() + "select event_type, user_id, ts_ms, round(value, 6) as value from kept qualify row_number() over (partition by ts_ms, event_type order by value desc, user_id) <= 2",
    "bottomk_all": _event_rows() + "select event_type, user_id, ts_ms, round(value, 6) as value from kept qualify row_number() over (partition by ts_ms order by value, event_type, user_id) <= 1",
    "quantile_by": _aggregated("quantile_cont(value, 0.9)", "event_type"),
    "count_values": _event_rows() + "select ts_ms, cast(value as varchar) v, round(cast(count(*) as double), 6) as value from kept where value is not null group by all",
    "promql_selector": _event_rows(where=_CLICK + " and user_id like '1%'") + "select event_type, user_id, ts_ms, round(value, 6) as value from kept",
    "promql_range": _event_rows(where=_RANGE + " and event_type <> 'click'") + "select event_type, user_id, ts_ms, round(value, 6) as value from kept",
    "promql_name_label": _event_rows(where="user_id = '8'") + "select event_type, user_id, ts_ms, round(value, 6) as value from kept",
    "promql_sum_by": _aggregated("sum(value)", "event_type", _RANGE + " and user_id not like '1%'"),
    "promql_offset": _event_rows(where=f"ts_ms >= {NOW - 5 * 86_400_000} and ts_ms < {NOW - 3 * 86_400_000}") + f"select ts_ms + {3 * 86_400_000} ts_ms, round(sum(value), 6) as value from kept where value is not null group by all",
    "range_rate": _STEPS + f"select event_type, user_id, round({_GAIN} / 432000, 9) as value from steps group by all",
    "range_increase": _STEPS + f"select event_type, user_id, round(cast({_GAIN} as double), 6) as value from steps group by all",
    "range_delta": _event_rows(where=_RANGE) + "select event_type, user_id, round(arg_max(value, ts_ms) - arg_min(value, ts_ms), 6) as value from kept group by all",
    "range_idelta": _STEPS + "select event_type, user_id, round(value - p, 6) as value from steps where p is not null qualify row_number() over (partition by event_type, user_id order by ts_ms desc) = 1",
    "range_changes": _STEPS + "select event_type, user_id, cast(count_if(p is not null and p <> value) as double) as value from steps group by all",
    "range_resets": _STEPS + "select event_type, user_id, cast(count_if(p is not null and value < p) as double) as value from steps group by all",
    "avg_over_time": _aggregated("avg(value)", "event_type, user_id", _RANGE, ""),
    "max_over_time": _aggregated("max(value)", "event_type, user_id", _RANGE, ""),
    "count_over_time": _aggregated("count(value)", "event_type, user_id", _RANGE, ""),
    "last_over_time": _aggregated("arg_max(value, ts_ms)", "event_type, user_id", _RANGE, ""),
    "quantile_over_time": _aggregated("quantile_cont(value, 0.5)", "event_type, user_id", _RANGE, ""),
    "nested_sum_rate": _STEPS + f"select event_type, round(sum(r), 9) as value from (select event_type, user_id, {_GAIN} / 432000 r from steps group by all) group by event_type",
    "moving_average": _event_rows() + "select event_type, user_id, ts_ms, round(avg(value) over (partition by event_type, user_id order by ts_ms range between 86399999 preceding and current row), 6) as value from kept",
    "sum_over_time": _aggregated("sum(value)", "event_type, user_id", _RANGE, ""),
    "min_over_time": _aggregated("min(value)", "event_type, user_id", _RANGE, ""),
    "stddev_over_time": _aggregated("stddev_pop(value)", "event_type, user_id", _RANGE, ""),
    "stdvar_over_time": _aggregated("var_pop(value)", "event_type, user_id", _RANGE, ""),
    "present_over_time": _aggregated("1", "event_type, user_id", _RANGE, ""),
    "range_irate": _event_rows(where=_RANGE)
    + """, steps as (select *, lag(value) over w p, lag(ts_ms) over w pt from kept window w as (partition by event_type, user_id order by ts_ms))
select event_type, user_id, round((case when value < p then value else value - p end) / ((ts_ms - pt) / 1000.0), 9) as value from steps where p is not null
qualify row_number() over (partition by event_type, user_id order by ts_ms desc) = 1""",
    "grid_increase": _event_rows()
    + """, steps as (select *, coalesce(case when value < p then value else value - p end, 0) gain from (select *, lag(value) over (partition by event_type, user_id order by ts_ms) p from kept))
select event_type, user_id, ts_ms, round(sum(gain) over w - first_value(gain) over w, 6) as value from steps
window w as (partition by event_type, user_id order by ts_ms range between 86399999 preceding and current row)""",
    "binary_ignoring": _event_rows() + "select event_type, ts_ms, round(sum(value) - count(value) % 2, 6) as value from kept group by all",
    "binary_power": _event_rows() + "select ts_ms, round(pow(sum(value) + 1, 0.5), 6) as value from kept group by all",
    "binary_group_left": _event_rows() + "select event_type, user_id, ts_ms, round(value / sum(value) over (partition by event_type, ts_ms), 9) as value from kept",
    "binary_group_right": _event_rows() + "select event_type, user_id, ts_ms, round(sum(value) over (partition by user_id, ts_ms) - value, 6) as value from kept",
    "functions_of_values": _event_rows()
    + "select event_type, user_id, ts_ms, round(greatest(2, least(50, abs(ceil(value / -7)))) + floor(sqrt(value)) - least(floor(value / 5 + 0.5) * 5, 100), 6) as value from kept",
    "label_functions": _event_rows()
    + "select case when length(user_id) > 0 then user_id[1] || '-' || user_id[2:] end u, ts_ms, round(sum(value), 6) as value from kept group by all",
    "asof_events": """
with r as (select user_id, epoch_us(ts) // 1000 t, max(value) v from events where event_type = 'click' group by all)
select event_id, r.t matched_ts, r.v as value from (select event_id, user_id, epoch_us(ts) // 1000 t from events where event_type = 'error') l
asof left join r on l.user_id = r.user_id and l.t >= r.t""",
    "binary_arithmetic": _event_rows() + "select event_type, ts_ms, round(sum(value) / (count(value) * 1.0) * 2, 6) as value from kept group by all",
    "binary_compare": _event_rows() + "select event_type, user_id, ts_ms, round(value, 6) as value from kept where value > 450",
    "binary_bool": _event_rows() + "select ts_ms, case when sum(value) >= 400 then 1.0::double else 0.0::double end as value from kept group by all",
    "set_and": _TWO + "select c.* from c semi join v using (user_id, ts_ms)",
    "set_unless": _TWO + "select c.* from c anti join v using (user_id, ts_ms)",
    "set_or": _TWO + "select * from c union all select v.* from v anti join c using (user_id, ts_ms)",
    "remote_write_nested": """
with series as (select unnest(timeseries) t from remote_writes),
flat as (select [l.value for l in t.labels if l.name = '__name__'][1] __name__, [l.value for l in t.labels if l.name = 'tenant'][1] tenant, [l.value for l in t.labels if l.name = 'zone'][1] zone, t.samples s from series)
select __name__, tenant, zone, cast(sum(coalesce(len(s), 0)) as bigint) n, count(*) n_series, min(list_min([x."timestamp" for x in s])) first_ms, max(list_max([x."timestamp" for x in s])) last_ms from flat group by all""",
    "remote_write_tables": """
with series as (select request_id, unnest(timeseries) t, generate_subscripts(timeseries, 1) place from remote_writes),
flat as (select request_id, place, [l.value for l in t.labels if l.name = '__name__'][1] metric, [l.value for l in t.labels if l.name = 'tenant'][1] tenant, [l.value for l in t.labels if l.name = 'route'][1] route,
  [l.value for l in t.labels if l.name = 'client'][1] client, [l.value for l in t.labels if l.name = 'zone'][1] zone, [l.value for l in t.labels if l.name = 'trace'][1] trace, unnest(t.samples) s, generate_subscripts(t.samples, 1) i from series),
kept as (select *, s."timestamp" // 60000 * 60000 ts_ms from flat where coalesce(metric, '') <> ''
  qualify row_number() over (partition by metric, tenant, route, client, zone, trace, s."timestamp" // 60000 order by request_id desc, place desc, i desc) = 1)
select metric, count(*) n_slots, cast(sum(try_cast(s.value as decimal(26,6))) as decimal(38,6)) total, max(ts_ms) last_ms from kept group by metric""",
    "remote_write_table": f"""
with series as (select request_id, unnest(timeseries) t, generate_subscripts(timeseries, 1) place from remote_writes),
flat as (select [l.value for l in t.labels if l.name = '__name__'][1] metric, [l.value for l in t.labels if l.name = 'tenant'][1] tenant, [l.value for l in t.labels if l.name = 'route'][1] route,
  [l.value for l in t.labels if l.name = 'client'][1] client, [l.value for l in t.labels if l.name = 'zone'][1] zone, [l.value for l in t.labels if l.name = 'trace'][1] trace, unnest(t.samples)."timestamp" ts from series),
slots as (select distinct tenant, route, client, zone, trace, ts // 60000 * 60000 ts_ms from flat where metric = '{REMOTE_METRIC}' and ts is not null)
select tenant, zone, count(*) n_slots, max(ts_ms) last_ms from slots group by all""",
    "write_api": "select o_orderstatus status, epoch_ms(cast(o_orderdate as timestamp)) // 86400000 * 86400000 ts_ms, count(*) n from orders group by all",
    "archive_roundtrip": _long(where=_CLICK),
    "arrow_roundtrip": _aggregated("sum(value)", "event_type"),
    "stream_final_state": _ORDERS.format(where="chunk_start >= b"),
}
