"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.numeric import tdiv
from tidemark.model import InternalError, TableMeta
from tidemark.operators import grid


def live_slots(stream: DataFrame, labels: Sequence[str], scalars: Sequence[str], ts: str, seq: str, meta: TableMeta) -> DataFrame:
    """Last write per series and slot as a stateful aggregation, for the update or append mode.

    The watermark is on the chunk's start: a chunk is given up, and later samples for it dropped, when
    one ``live_chunks`` newer has come.  It lags one micro-batch behind, and knows no first arrival;
    where that matters use :func:`ingest_exactly`.
    """
    placed = grid.placed(stream.withColumn("_t", grid.epoch_ms(stream, ts)), F.col("_t"), meta).drop("_t")
    timed = placed.withColumn("chunk", F.timestamp_millis("chunk_start")).withWatermark("chunk", f"{(meta.live_chunks - 1) * meta.chunk_ms} milliseconds")
    whole = F.struct(*[F.col(s) for s in scalars])
    kept = timed.groupBy(F.window("chunk", f"{meta.chunk_ms} milliseconds"), *labels, *grid.GRID).agg(F.max_by(whole, F.struct(F.col(seq), whole)).alias("_last"))
    return kept.select(*labels, *grid.GRID, *[F.col("_last")[s].alias(s) for s in scalars])


#: Batches after which the live rows are written whole again.
COMPACT = 8


def ingest_exactly(
    stream: DataFrame, path: str, checkpoint: str, labels: Sequence[str], scalars: Sequence[str], ts: str, seq: str, meta: TableMeta, archive: str | None = None, after: Callable[[SparkSession, int], None] | None = None
) -> StreamingQuery:
    """Keeps the live rows under ``path`` exactly as the batch rules say, whatever the batches.

    Each micro-batch adds its own live rows, one per series and slot, and a note of the bounds so far; every ``COMPACT``
    batches the live rows are written whole, and what no repeated batch can need any more is deleted.  So a
    batch costs what it holds, and what is stored stays a few times the live rows.  Chunks that drop out go to ``archive`` if it
    is given.  A batch that is repeated after a failure writes the same again; if what an earlier batch wrote is
    gone, that is an :class:`InternalError`.  ``after`` is called when a batch is stored (see :func:`continuous_query`).  ``path``, ``checkpoint`` and ``archive`` must be on storage that all executors share.
    """
    index = tdiv(F.col("chunk_start"), meta.chunk_ms)
    keys = [*labels, *grid.GRID]

    def step(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        placed = grid.placed(df.select(*labels, *scalars, F.col(seq).alias("_seq"), grid.epoch_ms(df, ts).alias("_t")), F.col("_t"), meta).drop("_t")
        rows = _last(placed.select(*keys, "_seq", *scalars), keys, scalars)
        number = F.col("_seq").cast("decimal(38,0)")
        own = placed.agg(F.max(index).alias("newest"), F.min_by(index, F.when(index.isNotNull(), number)).alias("first"), F.min(F.when(F.col("chunk_start").isNotNull(), number)).alias("first_seq")).first()
        before = note(spark, path, batch - 1) if batch else None
        seen = [x for x in (before, own) if x is not None and x["newest"] is not None]
        newest = max((x["newest"] for x in seen), default=None)
        # The chunk of the first arrival bounds what lives, too; a later batch may have an earlier arrival, so
        # rows before it are kept while they are new enough.
        earliest = min(seen, key=lambda x: x["first_seq"], default=None)
        first, first_seq = (earliest["first"], earliest["first_seq"]) if earliest is not None else (None, None)
        live = None if newest is None else newest - (meta.live_chunks - 1)
        was = before["live"] if before is not None and before["live"] is not None else first
        state = rows if before is None else _last(_stored(spark, path, before).unionByName(rows), keys, scalars)
        if archive:
            gone = F.lit(False) if live is None else (index >= max(was, first)) & (index < live)
            state.where(gone).write.mode("overwrite").parquet(f"{archive}/batch={batch}")
        whole = batch % COMPACT == 0
        kept = state if whole else rows
        (kept if live is None else kept.where(index >= live)).sortWithinPartitions("chunk_start").write.mode("overwrite").parquet(f"{path}/batch={batch}/rows")
        base = batch if whole else before["base"]
        spark.createDataFrame([(newest, first, first_seq, live, None if live is None else max(live, first) * meta.chunk_ms, base, batch)], NOTE).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}/note")
        if whole and before is not None:
            _delete_before(spark, path, before["base"])
        if after:
            after(spark, batch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The newest chunk and that of the first arrival so far, the first new enough to live, the start of live rows, and the batch that has the live rows whole.
NOTE = "newest long, first long, first_seq decimal(38,0), live long, live_ms long, base long, batch long"


def note(spark: SparkSession, path: str, batch: int) -> Row:
    """What a batch left besides its rows."""
    at = f"{path}/batch={batch}/note"
    fs, p = _file_system(spark, at)
    found = spark.read.schema(NOTE).parquet(at).first() if fs.exists(p) else None
    if found is None:
        raise InternalError(f"batch {batch} is missing under {path}")
    return found


def _last(df: DataFrame, keys: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """One row per series and slot, the last by ``_seq``."""
    whole = F.struct("_seq", *scalars)
    return df.groupBy(*keys).agg(F.max_by(whole, F.struct("_seq", whole)).alias("_l")).select(*keys, "_l.*")


def _stored(spark: SparkSession, path: str, at: Row) -> DataFrame:
    """The rows that batches have left since the live rows were written whole."""
    folders = [f"{path}/batch={b}/rows" for b in range(at["base"], at["batch"] + 1)]
    for f in folders:
        fs, p = _file_system(spark, f)
        if not fs.exists(p):
            raise InternalError(f"{f} is missing")
    return spark.read.parquet(*folders)


def latest(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The live rows after a batch, by default after the last."""
    if batch is None:
        done = _batches(spark, path)
        if not done:
            raise InternalError(f"no batch under {path}")
        batch = max(done)
    at = note(spark, path, batch)
    rows = _stored(spark, path, at)
    at_seq = rows.columns.index("_seq")  # labels and grid columns stand before it, scalars after it
    kept = _last(rows, rows.columns[:at_seq], rows.columns[at_seq + 1 :])
    return kept if at["live_ms"] is None else kept.where(F.col("chunk_start") >= at["live_ms"])


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _batches(spark: SparkSession, path: str) -> list[int]:
    fs, p = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(_file_system(spark, f"{path}/{n}/note/_SUCCESS")[1])]


def _delete_before(spark: SparkSession, path: str, batch: int) -> None:
    for b in _batches(spark, path):
        if b < batch:
            fs, p = _file_system(spark, f"{path}/batch={b}")
            fs.delete(p, True)


def continuous_query(path: str, name: str, text: str, labels: Sequence[str], scalars: Sequence[str], meta: TableMeta, results: str) -> Callable[[SparkSession, int], None]:
    """For ``after``: evaluates a query of the live rows under ``path`` when a batch is stored, as of the newest chunk's end.

    ``name`` is what the query calls the table.  The result of each batch is written to ``results/batch=n``, again if the batch is
    repeated; :func:`alerts` tells what came up and what went away between two batches.
    """

    def evaluate(spark: SparkSession, batch: int) -> None:
        from tidemark.engine import Engine

        at = note(spark, path, batch)
        engine = Engine(spark)
        rows = latest(spark, path, batch)
        engine.register(name, rows, labels, scalars, "ts_ms", "_seq", meta)
        now = 0 if at["newest"] is None else (at["newest"] + 1) * meta.chunk_ms
        engine.query(text, now_ms=now).write.mode("overwrite").parquet(f"{results}/batch={batch}")

    return evaluate


def alerts(spark: SparkSession, results: str, batch: int) -> DataFrame:
    """Series of a continuous query's result after a batch with ``state``: ``firing`` if they are new there, ``resolved`` if they
    were in the result before and no longer are.  Series are told by their labels."""
    now = spark.read.parquet(f"{results}/batch={batch}")
    labels = [c for c in now.columns if c not in ("ts_ms", "value")]
    now = now.select(*labels).distinct()
    if batch == 0:
        return now.withColumn("state", F.lit("firing"))
    was = spark.read.schema(now.schema).parquet(f"{results}/batch={batch - 1}").select(*labels).distinct()
    return now.exceptAll(was).withColumn("state", F.lit("firing")).unionByName(was.exceptAll(now).withColumn("state", F.lit("resolved")))
