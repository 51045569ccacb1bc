"""The time grid: chunks, slots, last write wins, retention, and the wide form.

The canonical form is long: labels, ``chunk_start``, ``slot``, ``ts_ms`` (start of the slot) and the
scalars.  Filters, aggregates and joins then are plain relational operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import tdiv
from tidemark.model import TableMeta

GRID = ["chunk_start", "slot", "ts_ms"]


def epoch_ms(df: DataFrame, ts: str) -> Column:
    """A time column as epoch milliseconds; times without a zone are UTC."""
    kind = df.schema[ts].dataType.simpleString()
    if kind == "timestamp":
        return F.unix_millis(df[ts])
    if kind == "timestamp_ntz":
        return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), df[ts]).cast("timestamp"))
    if kind == "date":
        return F.unix_date(df[ts]).cast("bigint") * 86_400_000
    return df[ts].cast("bigint")


def time_bounds(df: DataFrame, ts: str, start_ms: int | None, end_ms: int | None) -> Column:
    """``start_ms <= ts < end_ms`` on the raw column, so that it reaches the file scan."""
    kind = df.schema[ts].dataType.simpleString()

    def literal(ms: int) -> Column:
        if kind == "timestamp":
            return F.timestamp_millis(F.lit(ms).cast("bigint"))
        if kind == "timestamp_ntz":
            return F.expr(f"timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {ms // 1000}.{ms % 1000:03d})")
        if kind == "date":
            return F.date_from_unix_date(F.lit(-(-ms // 86_400_000)))
        return F.lit(ms).cast("bigint")

    out = F.lit(True)
    if start_ms is not None:
        out = out & (df[ts] >= literal(start_ms))
    if end_ms is not None:
        out = out & (df[ts] < literal(end_ms))
    return out


def slot_bounds(start_ms: int | None, end_ms: int | None, meta: TableMeta) -> tuple[int | None, int | None]:
    """A range in whole slots: a partial first slot is in, a partial last one isn't."""
    down = lambda t: None if t is None else int(t / meta.interval_ms) * meta.interval_ms if t < 0 else t // meta.interval_ms * meta.interval_ms
    return down(start_ms), down(end_ms)


def placed(df: DataFrame, ms: Column, meta: TableMeta) -> DataFrame:
    """Adds ``chunk_start``, ``slot`` and ``ts_ms``; division truncates."""
    return (
        df.withColumn("_ms", ms)
        .withColumn("chunk_start", tdiv(F.col("_ms"), meta.chunk_ms) * meta.chunk_ms)
        .withColumn("slot", tdiv(F.col("_ms") - F.col("chunk_start"), meta.interval_ms).cast("int"))
        .withColumn("ts_ms", F.col("chunk_start") + F.col("slot").cast("bigint") * meta.interval_ms)
        .drop("_ms")
    )


def last_write(df: DataFrame, labels: Sequence[str], scalars: Sequence[str], seq: str, meta: TableMeta, unique: bool = True) -> DataFrame:
    """One row per series and slot, the last by ``seq``.

    Series are told apart by all labels, NULL being equal to NULL and different from ``""``.  The
    last write holds even where its value is NULL.  Copies are brought together before the shuffle.
    With ``unique`` no two rows of a slot share a ``seq``, and plain columns are compared, in hash
    tables; without, whole rows are, and equal ``seq`` goes to the larger scalars.
    """
    keys = [*labels, "chunk_start", "slot"]
    if unique:
        kept = df.groupBy(*keys).agg(*[F.max_by(s, seq).alias(s) for s in scalars])
    else:
        whole = F.struct(*[F.col(s) for s in scalars])
        last = df.groupBy(*keys).agg(F.max_by(whole, F.struct(F.col(seq), whole)).alias("_last"))
        kept = last.select(*keys, *[F.col("_last")[s].alias(s) for s in scalars])
    ts = (F.col("chunk_start") + F.col("slot").cast("bigint") * meta.interval_ms).alias("ts_ms")
    return kept.select(*keys, ts, *scalars)


def live_from(df: DataFrame, seq: str, meta: TableMeta, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each ``by``: the start of the oldest live chunk, given all rows in order of arrival.

    The newest ``live_chunks`` chunks live, but nothing before the chunk of the first arrival.
    """
    index = tdiv(F.col("chunk_start"), meta.chunk_ms)
    return df.groupBy(*by).agg((F.greatest(F.max(index) - (meta.live_chunks - 1), F.min_by(index, F.col(seq))) * meta.chunk_ms).alias("live_from"))


def retained(df: DataFrame, seq: str, meta: TableMeta) -> DataFrame:
    """The rows in live chunks; late ones are dropped one by one."""
    return df.where(F.col("chunk_start") >= live_from(df, seq, meta).scalar())


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda v: v[name])


def _any_value(v: Column, scalars: Sequence[str]) -> Column:
    some = F.lit(False)
    for s in scalars:
        some = some | v[s].isNotNull()
    return some


def to_wide(
    df: DataFrame,
    labels: Sequence[str],
    scalars: Sequence[str],
    meta: TableMeta,
    start_ms: int | None = None,
    end_ms: int | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per series and chunk: ``start_at``, labels, ``first_slot`` and an array per scalar.

    ``df`` holds one row per series and slot.  An array has the slots of the range, NULL where
    there is no value; ``first_slot`` is the slot of its first element.  A chunk's series have at
    most ``series_len`` slots, which bounds what a row gathers.
    """
    lo, hi = slot_bounds(start_ms, end_ms, meta)
    slot_of = lambda t: F.least(F.greatest(tdiv(F.lit(t).cast("bigint") - F.col("chunk_start"), meta.interval_ms), F.lit(0)), F.lit(meta.series_len)).cast("int")
    first = F.lit(0) if lo is None else slot_of(lo)
    stop = F.lit(meta.series_len) if hi is None else slot_of(hi)
    near = F.lit(True)
    if lo is not None:
        near = near & (F.col("chunk_start") > lo - meta.chunk_ms)
    if hi is not None:
        near = near & (F.col("chunk_start") < hi)
    rows = df.where(near).groupBy("chunk_start", *labels).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("slot"), F.struct(*[F.col(s) for s in scalars])))).alias("_slots")
    )
    rows = rows.withColumn("first_slot", first).withColumn("_stop", stop)
    array = F.when(F.col("first_slot") < F.col("_stop"), F.transform(F.sequence("first_slot", F.col("_stop") - 1), lambda i: F.try_element_at(F.col("_slots"), i))).otherwise(
        F.array().cast(df.select(F.array(F.struct(*[F.col(s) for s in scalars])).alias("a")).schema["a"].dataType)
    )
    rows = rows.withColumn("_values", array)
    if not keep_empty:
        rows = rows.where(F.exists("_values", lambda v: _any_value(v, scalars)))
    start = F.coalesce(F.col("chunk_start"), F.lit(0).cast("bigint")).alias("start_at", metadata={"time_interval": str(meta.interval_ms)})
    return rows.select(start, *labels, "first_slot", *[_field("_values", s).alias(s) for s in scalars])


def from_wide(df: DataFrame, labels: Sequence[str], scalars: Sequence[str], meta: TableMeta) -> DataFrame:
    """The long form of :func:`to_wide`'s rows; slots without any value give no row."""
    zipped = F.arrays_zip(*[F.col(s) for s in scalars])
    long = df.select(F.col("start_at").alias("chunk_start"), *labels, "first_slot", F.posexplode(zipped).alias("_i", "_v"))
    long = long.withColumn("slot", F.col("first_slot") + F.col("_i"))
    out = long.select(
        *labels, "chunk_start", "slot", (F.col("chunk_start") + F.col("slot").cast("bigint") * meta.interval_ms).alias("ts_ms"), *[F.col("_v")[s].alias(s) for s in scalars]
    )
    some = F.lit(False)
    for s in scalars:
        some = some | F.col(s).isNotNull()
    return out.where(some)
