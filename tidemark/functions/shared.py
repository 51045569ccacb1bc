"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.model import Unsupported

#: Rows that a task brings together before it combines them.
GATHERED = 200_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process gets a folder of this machine; on a cluster the
    executors would each see another one, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise Unsupported("a cluster without spark.checkpoint.dir, the folder that all executors share")
        base = f"file:///tmp/tidemark-{os.getuid()}"
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the shared folder and read from there: a lost executor loses none.

    The folder is left to whoever cleans the shared place.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 100_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of about ``least`` rows or more that tear no group of equal ``keys`` apart."""
    held: list[pa.RecordBatch] = []
    n_held = 0
    for b in batches:
        held.append(b)
        n_held += b.num_rows
        if n_held < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        start = 0
        for k in keys:  # sorted: the last group may go on
            x = t.column(k).to_numpy()
            start = max(start, start + int(np.searchsorted(x[start:], x[-1])))
        if start:
            yield t.slice(0, start).combine_chunks()
        held, n_held = t.slice(start).combine_chunks().to_batches(), t.num_rows - start
    if n_held:
        yield pa.Table.from_batches(held).combine_chunks()


def combined_in_task(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """``keys``, the least ``seq`` and ``n``, for each ``GATHERED`` rows of a task; no shuffle.

    However often a row is copied, a task sends it on a few times only.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).group_by(list(keys), use_threads=False).aggregate([(seq, "min"), (seq, "count")])
            yield from t.rename_columns([*keys, seq, "n"]).to_batches()

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= GATHERED:
                yield from done()
                held, n = [], 0
        if n:
            yield from done()

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(combine, ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{seq} {kinds[seq]}", "n bigint"]))
