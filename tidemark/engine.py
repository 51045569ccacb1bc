"""The facade: tables of metrics, writes, scans and queries."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shared import written
from tidemark.model import (
    Matcher,
    NoSuchTable,
    SchemaMismatch,
    TableMeta,
    TableSchema,
    TimestampArchived,
    Unsupported,
    WriteError,
)
from tidemark.operators import grid
from tidemark.operators.scan import Table, limited, scan
from tidemark.plans.evaluate import Vector, evaluate
from tidemark.plans.promql import parse
from tidemark.sources.remote_write import checked_series, first_labels


def arrival(request: Column, series: Column, sample: Column) -> Column:
    """Order of arrival as one number, of the request, the series in it and the sample in that."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (wide(request) * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)") + wide(series) * F.lit(10**9).cast("decimal(19,0)") + wide(sample)


#: Rows of an Arrow file at most.
IPC_ROWS = 10_000_000
#: Samples of single writes that are held before they go to the shared folder.
HELD = 100_000


def as_long(v: float | int) -> int:
    """A number as :func:`tidemark.functions.numeric.to_long` makes it."""
    if isinstance(v, float):
        v = 0 if math.isnan(v) else -(2**63) if v <= -(2.0**63) else 2**63 - 1 if v >= 2.0**63 else int(v)
    return v


class Engine:
    """A catalog of tables, one per metric.

    Single writes are held by the engine, and the series of ingested requests are one store with labels as maps; the
    DataFrame of a table is made when it is asked for, whatever the number of writes and of metrics.

    ``schema_mode`` says what a write with labels or scalars unknown to its table does: ``strict``
    raises, ``evolve`` adds them, NULL in the rows before.
    """

    def __init__(self, spark: SparkSession, meta: TableMeta | None = None, schema_mode: str = "strict"):
        if schema_mode not in ("strict", "evolve"):
            raise Unsupported(f"the schema mode {schema_mode}")
        self.spark, self.meta, self.schema_mode = spark, meta or TableMeta(), schema_mode
        self._tables: dict[str, Table] = {}
        self._held: dict[str, list[tuple[int, int, dict, dict]]] = {}
        self._ingested: dict[str, tuple[list[str], TableMeta, bool]] = {}
        self._series: dict[str, DataFrame] = {}
        self._arrivals = 0

    # --- catalog

    def register(
        self,
        name: str,
        df: DataFrame,
        labels: Sequence[str],
        scalars: Mapping[str, str] | Sequence[str],
        ts: str,
        seq: str | None = None,
        meta: TableMeta | None = None,
        retention: bool = False,
        deduplicated: bool | None = None,
        unique: bool = True,
    ) -> Table:
        """A DataFrame as a table.

        Without ``seq``, a column of arrival order, its rows count as deduplicated.  ``unique`` False is for
        an order with ties, which then go to the larger value.
        """
        kinds = dict(scalars) if isinstance(scalars, Mapping) else {s: "float" for s in scalars}
        schema = TableSchema(name, tuple(labels), tuple(kinds.items()), meta or self.meta)
        for c in [*labels, *kinds, ts, *([seq] if seq else [])]:
            if c not in df.columns:
                raise SchemaMismatch(f"{name}: the rows have no column {c}")
        if retention and not seq:
            raise WriteError("retention needs an arrival order")
        self._held.pop(name, None)
        self._ingested.pop(name, None)
        self._tables[name] = Table(schema, df, ts, seq, retention, seq is None if deduplicated is None else deduplicated, unique)
        return self._tables[name]

    @property
    def tables(self) -> list[str]:
        """The names of all tables."""
        return sorted({*self._tables, *self._ingested})

    def table(self, name: str) -> Table:
        if name in self._ingested:
            return self._ingested_table(name)
        if name not in self._tables:
            raise NoSuchTable(name)
        t = self._tables[name]
        return replace(t, rows=self._with_held(t)) if self._held.get(name) else t

    def _with_held(self, t: Table) -> DataFrame:
        s = t.schema
        kinds = {"float": T.DoubleType(), "int": T.LongType()}
        schema = T.StructType([T.StructField("_ts", T.LongType()), T.StructField("_seq", T.LongType()), *[T.StructField(x, T.StringType()) for x in s.labels], *[T.StructField(n, kinds[k]) for n, k in s.scalars]])
        rows = [(ms, seq, *[labels.get(x) for x in s.labels], *[values.get(n) for n in s.scalar_names]) for ms, seq, labels, values in self._held[s.name]]
        held = self.spark.createDataFrame(rows, schema)
        return held if t.rows is None else t.rows.unionByName(held, allowMissingColumns=True)

    def create_view(self, name: str, view: str | None = None) -> None:
        """The table's long form as a temporary view, for SQL."""
        self.scan(name).createOrReplaceTempView(view or name)

    # --- writes

    def write(self, name: str, labels: Mapping[str, str | None], samples: Sequence[tuple[int, Mapping[str, float | int | None]]]) -> None:
        """Samples (epoch ms, scalars) of one series.  The first write of a table fixes its schema.

        Scalars are those of the first sample; an int makes an integer column, to which later floats are
        truncated and held at its bounds.  Late samples are dropped one by one.
        """
        if not samples:
            raise WriteError("a write needs a sample")
        if name in self._ingested:
            raise WriteError(f"{name} is written in another way")
        old = self._tables.get(name)
        if old is not None and (old.ts, old.seq) != ("_ts", "_seq"):
            raise WriteError(f"{name} is written in another way")
        first = samples[0][1]
        kinds = dict(old.schema.scalars) if old else {n: "int" if isinstance(v, int) and not isinstance(v, bool) else "float" for n, v in first.items()}
        names = list(old.schema.labels) if old else list(labels)
        new_labels = [x for x in labels if x not in names]
        new_scalars = {n: "int" if isinstance(v, int) else "float" for _, s in samples for n, v in s.items() if n not in kinds}
        if (new_labels or new_scalars) and (old is None and new_scalars or self.schema_mode == "strict" and old is not None):
            raise SchemaMismatch(f"{name} has no {', '.join([*new_labels, *new_scalars])}")
        schema = TableSchema(name, (*names, *new_labels), tuple((kinds | new_scalars).items()), old.schema.meta if old else self.meta)
        made = {n: (float if k == "float" else as_long) for n, k in schema.scalars}
        held = self._held.setdefault(name, [])
        for ms, scalars in samples:
            self._arrivals += 1
            held.append((ms, self._arrivals, dict(labels), {n: None if v is None else made[n](v) for n, v in scalars.items()}))
        self._tables[name] = replace(old, schema=schema) if old else Table(schema, None, "_ts", "_seq", True)
        if len(held) >= HELD:
            t = self._tables[name]
            self._tables[name] = replace(t, rows=written(self._with_held(t)))
            held.clear()

    def write_one(self, name: str, labels: Mapping[str, str | None], ms: int, scalars: Mapping[str, float | int | None]) -> None:
        """One sample; raises :class:`TimestampArchived` when it is older than the live chunks."""
        t = self.table(name) if name in self.tables else None
        if t is not None and t.retention:
            placed = grid.placed(t.rows.select(t.rows[t.seq].alias("_seq"), grid.epoch_ms(t.rows, t.ts).alias("_t")), F.col("_t"), t.schema.meta)
            oldest = grid.live_from(placed, "_seq", t.schema.meta).first()[0]
            if oldest is not None and int(ms / t.schema.meta.chunk_ms) * t.schema.meta.chunk_ms < oldest:
                raise TimestampArchived(f"{name}: {ms} is before {oldest}")
        self.write(name, labels, [(ms, scalars)])

    def ingest(self, requests: DataFrame, seq: str = "request_id", meta: TableMeta | None = None, retention: bool = False, path: str | None = None) -> dict[str, int]:
        """Nested write requests, each series to the table its ``__name__`` says, the sample as ``value``.

        All series are one store.  With ``path``, a folder that all executors share, they are appended to what is stored
        there, sorted by metric within files, so that a table reads little else; without, every scan of a table reads the
        requests again.  Returns the counts of series ``written`` and ``rejected``: those without a name or with a label
        given twice.  The labels of a table are those of its first series, by ``seq`` and place in the
        request.  What reaches the driver is a row per metric.
        """
        series = checked_series(requests, seq)
        counts = series.groupBy(F.col("problem").isNull().alias("good")).count().collect()
        good = series.where("problem is null").drop("problem")
        known: dict[str, tuple[list[str], TableMeta, bool]] = {}
        for row in first_labels(good):
            name, first, every = row["metric"], list(row["first"]), sorted(row["every"])
            if name in self._tables:
                raise WriteError(f"{name} is written in another way")
            old = self._ingested.get(name)
            names = list(old[0]) if old else first
            extra = [x for x in every if x not in names]
            if extra and self.schema_mode == "strict":
                raise SchemaMismatch(f"{name} has no label {', '.join(extra)}")
            TableSchema(name, (*names, *extra), (("value", "float"),))
            known[name] = (names + extra, meta or (old[1] if old else self.meta), retention)
        if path:
            good.sortWithinPartitions("metric").write.mode("append").parquet(path)
            good = self.spark.read.schema(good.schema).parquet(path)  # lists the files of all ingests so far
        self._series[path or f" {len(self._series)}"] = good
        self._ingested |= known
        n = {r["good"]: r["count"] for r in counts}
        return {"written": n.get(True, 0), "rejected": n.get(False, 0)}

    def _samples(self, *columns: Column, where: Column | None = None) -> DataFrame:
        """``columns`` of the store, with order of arrival, time and value of each sample."""
        parts = [df if where is None else df.where(where) for df in self._series.values()]
        series = parts[0]
        for p in parts[1:]:
            series = series.unionByName(p)
        rows = series.select("metric", "labels", "seq", "place", F.posexplode("samples").alias("_i", "_s"))
        return rows.select(*columns, arrival(F.col("seq"), F.col("place"), F.col("_i")).alias("_seq"), F.col("_s.timestamp").alias("_ts"), F.col("_s.value").alias("value"))

    def _ingested_table(self, name: str) -> Table:
        labels, meta, retention = self._ingested[name]
        df = self._samples(*[F.col("labels")[x].alias(x) for x in labels], where=F.col("metric") == name)
        return Table(TableSchema(name, tuple(labels), (("value", "float"),), meta), df, "_ts", "_seq", retention)

    # --- reads

    def scan_ingested(self) -> DataFrame:
        """Every ingested metric in one plan: ``metric``, ``labels`` (a map without NULLs), the grid columns and ``value``.

        The tables must share their grid and retention.
        """
        kinds = {(meta, retention) for _, meta, retention in self._ingested.values()}
        if not kinds:
            raise NoSuchTable("nothing is ingested")
        if len(kinds) > 1:
            raise Unsupported("metrics of different grids in one scan")
        ((meta, retention),) = kinds
        entries = F.array_sort(F.map_entries(F.map_filter("labels", lambda _, v: v.isNotNull())))
        rows = self._samples(F.col("metric"), entries.alias("_entries")).where("_ts is not null")
        placed = grid.placed(rows, F.col("_ts"), meta)
        if retention:
            live = grid.live_from(placed, "_seq", meta, ["metric"]).select(F.col("metric").alias("_m"), "live_from")
            placed = placed.join(live, F.col("metric") == F.col("_m")).where("chunk_start >= live_from")
        kept = grid.last_write(placed, ["metric", "_entries"], ["value"], "_seq", meta)
        return kept.select("metric", F.map_from_entries("_entries").alias("labels"), *grid.GRID, "value")

    def scan(
        self,
        name: str,
        projections: Sequence[str] | None = None,
        matchers: Sequence[Matcher] = (),
        start_ms: int | None = None,
        end_ms: int | None = None,
        limit: int | None = None,
        wide: bool = False,
        keep_empty: bool = False,
    ) -> DataFrame:
        """Samples of a table, long or as one row per series and chunk.  ``limit`` counts series-chunks."""
        t = self.table(name)
        labels, scalars = list(t.schema.labels), list(t.schema.scalar_names if projections is None else projections)
        rows = scan(t, projections, matchers, start_ms, end_ms, whole_chunks=wide and keep_empty)
        if not wide:
            return limited(rows, labels, limit) if limit is not None else rows
        out = grid.to_wide(rows, labels, scalars, t.schema.meta, start_ms, end_ms, keep_empty)
        return out.orderBy("start_at", *labels).limit(limit) if limit is not None else out

    def query(self, text: str, language: str = "promql", now_ms: int | None = None) -> DataFrame:
        """A query's result: labels, ``ts_ms`` where rows are per slot, and ``value``."""
        if language != "promql":
            raise Unsupported(f"the language {language}")
        expr = parse(text)
        out = evaluate(expr, self.table, int(time.time() * 1000) if now_ms is None else now_ms)
        if isinstance(out, Vector):
            return out.df.select(*out.labels, *(["ts_ms"] if out.timed else []), "value")
        return self.spark.range(1).select(F.lit(float(out)).alias("value"))

    # --- sinks

    def write_ipc(self, df: DataFrame, sink: str | BinaryIO) -> None:
        """A result as a closed Arrow file.

        It passes through the driver, so more than ``IPC_ROWS`` rows are an error; for tables see :meth:`archive`.
        """
        t = df.limit(IPC_ROWS + 1).toArrow()
        if t.num_rows > IPC_ROWS:
            raise WriteError(f"more than {IPC_ROWS} rows for one Arrow file")
        with pa.ipc.new_file(sink, t.schema) as w:
            w.write_table(t)

    def archive(self, name: str, path: str) -> None:
        """The table's long form as Parquet, partitioned by chunk and sorted by labels within files."""
        t = self.table(name)
        self.scan(name).sortWithinPartitions("chunk_start", *t.schema.labels, "slot").write.mode("overwrite").partitionBy("chunk_start").parquet(path)

    def open_archive(self, name: str, path: str, labels: Sequence[str], scalars: Mapping[str, str], meta: TableMeta | None = None) -> Table:
        """An archived table; a time range prunes its chunks."""
        t = self.register(name, self.spark.read.parquet(path), labels, scalars, "ts_ms", None, meta)
        return t

    def with_retention(self, name: str, on: bool = True) -> None:
        if name in self._ingested:
            self._ingested[name] = (*self._ingested[name][:2], on)
        else:
            self.table(name)
            self._tables[name] = replace(self._tables[name], retention=on)


