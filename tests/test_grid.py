"""Boundaries of the grid, retention and matchers, with the default grid: 120 slots of 1 s, 5 chunks."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.numeric import to_long
from tidemark.model import (
    DuplicateLabel,
    Matcher,
    NoName,
    NoSuchField,
    NoSuchLabel,
    NoSuchScalar,
    NoSuchTable,
    SchemaMismatch,
    TableMeta,
    TimestampArchived,
    Unsupported,
    WriteError,
)
from tidemark.operators import grid


def engine(spark, rows, retention=True, labels=("a", "b"), **options):
    """rows: (seconds, value, a, b) in order of arrival."""
    df = spark.createDataFrame([(int(s * 1000), v, *ls, k) for k, (s, v, *ls) in enumerate(rows)], f"t long, value double, {', '.join(f'{x} string' for x in labels)}, n long")
    e = Engine(spark, **options)
    e.register("m", df, labels, ["value"], "t", "n", retention=retention)
    return e


def samples(df):
    return sorted((r["ts_ms"] / 1000, r["value"]) for r in df.collect())


def times(spark, seconds):
    return [t for t, _ in samples(engine(spark, [(s, 1.0, "x", "y") for s in seconds]).scan("m"))]


def test_series_are_whole_label_tuples(spark):
    e = engine(spark, [(0, 1.0, "x", "1"), (0, 2.0, "y", "1"), (0, 3.0, "", "1"), (0, 4.0, None, "1")])
    assert [v for _, v in samples(e.scan("m"))] == [1.0, 2.0, 3.0, 4.0]


def test_chunks_of_gaps_and_late_samples(spark):
    assert times(spark, [0, 250, 130]) == [0, 130, 250]
    assert times(spark, [0, 360]) == [0, 360]
    rows = engine(spark, [(s, 1.0, "x", "y") for s in (0, 250, 130, 360)]).scan("m").collect()
    assert sorted((r["chunk_start"] // 1000, r["slot"]) for r in rows) == [(0, 0), (120, 10), (240, 10), (360, 0)]


def test_retention(spark):
    assert times(spark, [600, 500]) == [600]
    assert times(spark, [0, 119, 120, 240, 360, 480, 600, 100]) == [120, 240, 360, 480, 600]


def model(seconds, n=5, width=120):
    """Chunk by chunk, as samples come."""
    live, out = None, {}
    for k, s in enumerate(seconds):
        c = s // width
        if live is None:
            live = [c, c]
        if c < live[0]:
            continue
        if c > live[1]:
            live = [max(live[0], c - n + 1), c]
            out = {t: v for t, v in out.items() if t // width >= live[0]}
        out[s] = float(k)
    return sorted(out.items())


def test_retention_is_that_of_samples_one_by_one(spark):
    rng = random.Random(7)
    for _ in range(6):
        seconds = [rng.randrange(2500) for _ in range(rng.randrange(1, 60))]
        e = engine(spark, [(s, float(k), "x", "y") for k, s in enumerate(seconds)])
        assert samples(e.scan("m")) == model(seconds)


def test_last_write_wins_even_with_null(spark):
    assert samples(engine(spark, [(1.2, 1.0, "x", "y"), (1.9, 2.0, "x", "y")]).scan("m")) == [(1, 2.0)]
    assert samples(engine(spark, [(1, 1.0, "x", "y"), (1, None, "x", "y")]).scan("m")) == [(1, None)]


def test_ranges(spark):
    e = engine(spark, [(s, float(s), "x", "y") for s in (0, 5, 10, 119.7, 120)], retention=False)
    at = lambda lo, hi: [t for t, _ in samples(e.scan("m", start_ms=lo, end_ms=hi))]
    assert at(5500, 10_900) == [5]  # a partial slot at the start is in, at the end out
    assert at(119_500, None) == [119, 120]
    assert at(None, 120_000) == [0, 5, 10, 119]
    assert at(10_000, 5_000) == []
    assert at(5_000, 5_900) == []


def test_wide(spark):
    e = engine(spark, [(s, float(s), "x", "y") for s in (0, 5, 10, 130)], retention=False)
    first, second = e.scan("m", start_ms=5000, end_ms=121_000, wide=True, keep_empty=True).orderBy("start_at").collect()
    assert (first["start_at"], first["first_slot"], first["value"][0], first["value"][5], len(first["value"])) == (0, 5, 5.0, 10.0, 115)
    assert (second["start_at"], second["value"]) == (120_000, [None])
    assert e.scan("m", start_ms=5000, end_ms=121_000, wide=True).count() == 1
    assert e.scan("m", wide=True).schema["start_at"].metadata == {"time_interval": "1000"}
    assert not e.scan("m", wide=True).schema["start_at"].nullable
    back = grid.from_wide(e.scan("m", wide=True), ["a", "b"], ["value"], TableMeta())
    assert samples(back) == samples(e.scan("m"))


def test_limit_counts_series_chunks(spark):
    e = engine(spark, [(0, 1.0, "x", None), (1, 2.0, "x", None), (0, 3.0, "y", "1"), (500, 4.0, None, None)], retention=False)
    assert samples(e.scan("m", limit=1)) == [(0, 1.0), (1, 2.0)]
    assert e.scan("m", limit=1, wide=True).count() == 1
    assert e.scan("m", limit=0).count() == 0
    assert e.scan("m", limit=99).count() == 4


def test_matchers_and_missing_labels(spark):
    e = engine(spark, [(0, 1.0, "x", "1"), (0, 2.0, "y", "1"), (0, 3.0, None, "1"), (0, 4.0, "", "1"), (0, 5.0, "xy\n", "1")], retention=False)
    found = lambda op, v: [v for _, v in samples(e.scan("m", matchers=[Matcher("a", op, v)]))]
    assert found("=", "x") == [1.0]
    assert found("=", "") == [4.0]
    assert found("=", None) == [3.0]
    assert found("!=", None) == [1.0, 2.0, 4.0, 5.0]
    assert found("!=", "x") == [2.0, 3.0, 4.0, 5.0]
    assert found("=~", "x|y") == [1.0, 2.0]
    assert found("=~", ".*") == [1.0, 2.0, 4.0]
    assert found("!~", "x|y") == [3.0, 4.0, 5.0]
    assert found("=", "no") == []
    both = [Matcher("a", "=", "x"), Matcher("b", "=", "1")]
    assert [v for _, v in samples(e.scan("m", matchers=both))] == [1.0]


def test_coercion(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,), (float("nan"),), (1e30,), (-1e30,), (None,)], "v double")
    assert [r[0] for r in df.select(to_long(F.col("v"))).collect()] == [1, -1, 0, 2**63 - 1, -(2**63), None]


def test_errors_leave_the_engine_usable(spark):
    e = engine(spark, [(0, 1.0, "x", "1")])
    for error, call in [
        (NoSuchScalar, lambda: e.scan("m", ["no"])),
        (NoSuchLabel, lambda: e.scan("m", matchers=[Matcher("no", "=", "1")])),
        (NoSuchLabel, lambda: e.query('m{no="1"}')),
        (NoSuchTable, lambda: e.scan("no")),
        (NoSuchTable, lambda: e.query("no")),
        (NoSuchField, lambda: e.query("sum by (no) (m)")),
        (NoSuchField, lambda: e.query("sum by (value) (m)")),
        (NoName, lambda: e.query('{a="x"}')),
        (Unsupported, lambda: e.query("sum(time())")),
        (Unsupported, lambda: e.query("m", language="sql")),
        (DuplicateLabel, lambda: e.register("d", e.table("m").rows, ["a", "a"], ["value"], "t")),
        (SchemaMismatch, lambda: e.register("d", e.table("m").rows, ["z"], ["value"], "t")),
        (SchemaMismatch, lambda: e.write("w", {"a": "1"}, [(0, {"v": 1.0})]) or e.write("w", {"a": "1", "c": "2"}, [(0, {"v": 1.0})])),
        (WriteError, lambda: e.write("w", {"a": "1"}, [])),
    ]:
        with pytest.raises(error):
            call()
        assert e.scan("m").count() == 1


def test_write(spark):
    e = Engine(spark)
    e.write("w", {"a": "x", "b": None}, [(0, {"v": 1}), (1000, {"v": 2.9})])
    e.write("w", {"a": "y"}, [(0, {"v": float("nan")})])
    e.write("w", {}, [(0, {"v": None})])
    rows = {(r["a"], r["b"], r["ts_ms"]): r["v"] for r in e.scan("w").collect()}
    assert rows == {("x", None, 0): 1, ("x", None, 1000): 2, ("y", None, 0): 0, (None, None, 0): None}
    e.write("none", {}, [(5000, {"v": 1.0})])
    assert e.scan("none", wide=True).collect()[0]["v"][5] == 1.0
    e.write("late", {"a": "x"}, [(600_000, {"v": 1.0}), (500_000, {"v": 2.0})])
    assert e.scan("late").count() == 1
    with pytest.raises(TimestampArchived):
        e.write_one("late", {"a": "x"}, 500_000, {"v": 1.0})
    evolving = Engine(spark, schema_mode="evolve")
    evolving.write("w", {"a": "x"}, [(0, {"v": 1.0})])
    evolving.write("w", {"a": "x", "c": "z"}, [(1000, {"v": 1.0, "u": 2.0})])
    assert {(r["c"], r["u"]) for r in evolving.scan("w").collect()} == {(None, None), ("z", 2.0)}


def test_many_writes_and_metrics_leave_plans_small(spark, tmp_path, monkeypatch):
    e = Engine(spark)
    for k in range(300):
        e.write("w", {"a": str(k % 3)}, [(1000 * k, {"v": k})])
    plan = e.table("w").rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("Union") == 0 and e.table("w").rows.count() == 300
    monkeypatch.setattr("tidemark.engine.HELD", 100)
    for k in range(150):
        e.write("x", {"a": "b"}, [(1000 * k, {"v": k})])
    assert e.table("x").rows.count() == 150 and len(e._held["x"]) == 50
    many = spark.range(400).selectExpr("id request_id", "array(struct(array(struct('__name__' name, concat('m', id % 200) value)) labels, array(struct(1.0D value, id timestamp)) samples)) timeseries")
    for _ in range(2):
        e.ingest(many, path=str(tmp_path / "store"))
    assert len(e.tables) == 202 and e.scan("m7").count() == 1
    assert e.scan_ingested().groupBy("metric").count().count() == 200
    assert "Union" not in e.scan_ingested()._jdf.queryExecution().optimizedPlan().toString()


REQUESTS = "request_id long, timeseries array<struct<labels:array<struct<name:string,value:string>>,samples:array<struct<value:double,timestamp:bigint>>>>"


def request(k, *series):
    return (k, [([("__name__", n)] * (n is not None) + list(ls.items()), s) for n, ls, s in series])


def test_ingest_of_requests(spark):
    df = spark.createDataFrame(
        [
            request(1, ("m", {"a": "x"}, [(1.0, 0), (2.0, 500)]), (None, {"a": "x"}, [(9.0, 0)]), ("k", {}, [(3.0, 0)])),
            request(2, ("m", {}, [(4.0, 0)]), ("m", {"a": "y"}, []), ("m", {"a": "z"}, None)),
            (3, None),
            (4, []),
            (5, [([("__name__", "m"), ("a", "1"), ("a", "2")], [(1.0, 0)])]),
            (6, [(None, [(1.0, 0)])]),
        ],
        REQUESTS,
    )
    e = Engine(spark)
    assert e.ingest(df) == {"written": 5, "rejected": 3}
    assert sorted((r["a"] or "", r["value"]) for r in e.scan("m").collect()) == [("", 4.0), ("x", 2.0)]
    assert e.query("k").collect()[0]["value"] == 3.0
    more = spark.createDataFrame([request(7, ("m", {"a": "x", "c": "1"}, [(1.0, 0)]))], REQUESTS)
    with pytest.raises(SchemaMismatch):
        e.ingest(more)
    assert e.scan("m").count() == 2 and e.tables == ["k", "m"]
    e.ingest(spark.createDataFrame([request(8, ("m", {"a": None}, [(6.0, 0)]), ("k", {}, [(7.0, 1000)]))], REQUESTS))
    everything = {(r["metric"], tuple(r["labels"].items()), r["ts_ms"], r["value"]) for r in e.scan_ingested().collect()}
    assert everything == {("m", (), 0, 6.0), ("m", (("a", "x"),), 0, 2.0), ("k", (), 0, 3.0), ("k", (), 1000, 7.0)}
    e.with_retention("k")
    with pytest.raises(Unsupported):
        e.scan_ingested()
    with pytest.raises(WriteError):
        e.write("m", {"a": "x"}, [(0, {"value": 1.0})])
    assert Engine(spark).ingest(df.limit(0)) == {"written": 0, "rejected": 0}


def test_queries_of_slots(spark):
    e = engine(spark, [(0, 1.0, "p", "1"), (0, 2.0, "p", "2"), (0, 4.0, "q", "1"), (1, 8.0, "p", "1"), (1, None, "q", "1")], retention=False)
    get = lambda q: sorted(tuple(r) for r in e.query(q, now_ms=10_000).collect())
    assert get("sum by (a) (m)") == get("sum without (b) (m)") == [("p", 0, 3.0), ("p", 1000, 8.0), ("q", 0, 4.0)]
    assert get("sum(m)") == [(0, 7.0), (1000, 8.0)]
    assert get("topk(1, m)") == [("p", "1", 1000, 8.0), ("q", "1", 0, 4.0)]
    assert get("increase(m)") == [("p", "1", 7.0), ("p", "2", 0.0), ("q", "1", 0.0)]
    assert get("rate(m[10s])")[0] == ("p", "1", 0.7)
    assert get("irate(m)") == [("p", "1", 7.0)]
    assert get("m * 2 > 7") == [("p", "1", 1000, 16.0), ("q", "1", 0, 8.0)]
    assert get("m / 0")[0][-1] == float("inf")
    assert get("1 + 2 * 3") == [(7.0,)]
    assert get('m{b="1"} unless m{a="q"}') == [("p", "1", 0, 1.0), ("p", "1", 1000, 8.0)]


def test_arrow_file(spark, tmp_path):
    e = engine(spark, [(0, 1.0, "x", None)])
    e.write_ipc(e.scan("m"), str(tmp_path / "r.arrow"))
    t = pa.ipc.open_file(str(tmp_path / "r.arrow")).read_all()
    assert t.column("a").to_pylist() == ["x"] and t.column("value").to_pylist() == [1.0]


def test_archive_prunes_chunks(spark, tmp_path):
    e = engine(spark, [(s, 1.0, "x", "y") for s in (0, 130, 250)], retention=False)
    e.archive("m", str(tmp_path / "old"))
    e.open_archive("old", str(tmp_path / "old"), ["a", "b"], {"value": "float"})
    assert samples(e.scan("old", start_ms=120_000)) == [(130, 1.0), (250, 1.0)]


def test_time_columns(spark):
    at = datetime.datetime(2024, 1, 1, 0, 0, 1)
    df = spark.createDataFrame([(at, at, at.date())], "z timestamp, n timestamp_ntz, d date")
    for name, ms in (("z", 1_704_067_201_000), ("n", 1_704_067_201_000), ("d", 1_704_067_200_000)):
        assert df.select(grid.epoch_ms(df, name)).first()[0] == ms
        assert df.where(grid.time_bounds(df, name, ms, ms + 1)).count() == 1
        assert df.where(grid.time_bounds(df, name, ms + 1, None)).count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    engine(spark, [(0, 1.0, "x", "y")]).table("m").rows.write.parquet(str(tmp_path / "p"))
    e = Engine(spark)
    e.register("m", spark.read.parquet(str(tmp_path / "p")), ["a", "b"], ["value"], "t", "n")
    plan = e.scan("m", matchers=[Matcher("a", "=", "x")], start_ms=0, end_ms=5000)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,x)" in plan and "GreaterThanOrEqual(t,0)" in plan and "LessThan(t,5000)" in plan
