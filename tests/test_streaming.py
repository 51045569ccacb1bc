"""Streams in several batches against the batch rules."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.model import InternalError, TableMeta
from tidemark.streaming.ingest import COMPACT, alerts, continuous_query, ingest_exactly, latest, live_slots

META = TableMeta(10, 1000, 3)
SCHEMA = "t long, value double, a string, n long"


def write_batches(spark, folder, rows, size):
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def state(df):
    return sorted((r["a"] or "", r["ts_ms"], r["value"]) for r in df.collect())


def test_any_batches_give_the_batch_result(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(20_000, 90_000), float(k), rng.choice(["x", "y", None]), k) for k in range(120)]
    whole = spark.createDataFrame(rows, SCHEMA)
    e = Engine(spark)
    e.register("m", whole, ["a"], ["value"], "t", "n", META, retention=True)
    want = state(e.scan("m"))
    source, live = str(tmp_path / "in"), str(tmp_path / "live")
    for k in range(0, 120, 40):
        spark.createDataFrame(rows[k : k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = ingest_exactly(stream, live, str(tmp_path / "c"), ["a"], ["value"], "t", "n", META, archive=str(tmp_path / "old"))
        q.awaitTermination()
        assert q.exception() is None
    assert state(latest(spark, live, 2)) == want


def run(spark, source, folder, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = ingest_exactly(stream, f"{folder}/live", f"{folder}/c", ["a"], ["value"], "t", "n", META, **options)
    q.awaitTermination()
    return q


def test_many_batches_in_any_order(spark, tmp_path):
    """Twenty batches, not in order of arrival: the same rows, and old batches are deleted."""
    rng = random.Random(2)
    rows = [(None if k % 17 == 0 else rng.randrange(20_000, 90_000), float(k), rng.choice(["x", "y", None]), k) for k in range(200)]
    e = Engine(spark)
    e.register("m", spark.createDataFrame(rows, SCHEMA), ["a"], ["value"], "t", "n", META, retention=True)
    rng.shuffle(rows)
    source = str(tmp_path / "in")
    write_batches(spark, source, rows, 10)
    assert run(spark, source, tmp_path).exception() is None
    assert state(latest(spark, str(tmp_path / "live"))) == state(e.scan("m"))
    left = sorted(int(p.name.removeprefix("batch=")) for p in (tmp_path / "live").glob("batch=*"))
    assert left == list(range(COMPACT, 20))


def test_a_continuous_query_and_its_alerts(spark, tmp_path):
    source, live, results = (str(tmp_path / x) for x in ("in", "live", "results"))
    batches = [[(30_000, 5.0, "x", 0), (30_000, 1.0, "y", 1)], [(31_000, 7.0, "x", 2), (30_000, 9.0, "y", 3)], [(30_000, 2.0, "x", 4), (31_000, 2.0, "x", 5)]]
    query = continuous_query(live, "m", "max_over_time(m[1h]) > 4", ["a"], ["value"], META, results)
    seen = []
    for rows in batches:
        write_batches(spark, source, rows, 10)
        run(spark, source, tmp_path, after=query)
        seen.append({(r["a"], r["state"]) for r in alerts(spark, results, len(seen)).collect()})
    assert seen == [{("x", "firing")}, {("y", "firing")}, {("x", "resolved")}]
    assert [(r["a"], r["value"]) for r in spark.read.parquet(f"{results}/batch=2").collect()] == [("y", 9.0)]


def test_a_missing_batch_is_an_error(spark, tmp_path):
    source = str(tmp_path / "in")
    write_batches(spark, source, [(30_000 + k, 1.0, "x", k) for k in range(3)], 1)
    run(spark, source, tmp_path)
    shutil.rmtree(tmp_path / "live" / "batch=1")
    with pytest.raises(InternalError):
        latest(spark, str(tmp_path / "live"))
    shutil.rmtree(tmp_path / "live" / "batch=2")
    write_batches(spark, source, [(30_009, 1.0, "x", 9)], 1)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    q = ingest_exactly(stream, str(tmp_path / "live"), str(tmp_path / "c"), ["a"], ["value"], "t", "n", META)
    with pytest.raises(Exception, match="batch 2 is missing"):
        q.awaitTermination()


def test_stateful_aggregation(spark, tmp_path):
    source = str(tmp_path / "in")
    write_batches(spark, source, [(1000 * k % 25_000, float(k), "x", k) for k in range(60)], 60)
    stream = live_slots(spark.readStream.schema(SCHEMA).parquet(source), ["a"], ["value"], "t", "n", META)
    q = stream.writeStream.outputMode("update").format("memory").queryName("slots").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    e = Engine(spark)
    e.register("m", spark.read.schema(SCHEMA).parquet(source), ["a"], ["value"], "t", "n", META)
    assert state(spark.table("slots").where(F.col("a") == "x")) == state(e.scan("m"))
