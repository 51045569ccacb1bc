"""Matching of vectors, functions of values and labels, and range functions over long series."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.model import ManyToMany, NoSuchField, TableMeta
from tidemark.operators import aggregate as agg

META = TableMeta(10, 1000)


@pytest.fixture(scope="module")
def e(spark):
    out = Engine(spark)
    rows = [("x", "1", 0, 10.0), ("x", "2", 0, 20.0), ("y", "1", 0, 30.0), ("y", None, 0, 5.0), ("x", "1", 1000, 7.0)]
    out.register("many", spark.createDataFrame(rows, "a string, b string, t long, value double"), ["a", "b"], ["value"], "t", meta=META)
    one = [("x", "north", 0, 2.0), ("y", "south", 0, 4.0), ("z", "west", 0, 8.0)]
    out.register("one", spark.createDataFrame(one, "a string, side string, t long, value double"), ["a", "side"], ["value"], "t", meta=META)
    buckets = [("h", le, 0, n) for le, n in (("0.1", 2.0), ("0.5", 6.0), ("1", 8.0), ("+Inf", 10.0))] + [("g", le, 0, n) for le, n in (("1", 5.0), ("2", 5.0))]
    out.register("hist", spark.createDataFrame(buckets, "a string, le string, t long, value double"), ["a", "le"], ["value"], "t", meta=META)
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_many_to_one(e):
    got = e.query("many / on (a) group_left (side) one")
    assert got.columns == ["a", "b", "side", "ts_ms", "value"]
    assert sorted((r["a"], r["b"] or "", r["side"], r["value"]) for r in got.collect()) == [("x", "1", "north", 5.0), ("x", "2", "north", 10.0), ("y", "", "south", 1.25), ("y", "1", "south", 7.5)]
    right = e.query("one - on (a) group_right many").collect()
    assert sorted(r["value"] for r in right) == [-26.0, -18.0, -8.0, -1.0]
    assert sorted(r["value"] for r in e.query("many > on (a) group_left one").collect()) == [5.0, 10.0, 20.0, 30.0]


@pytest.mark.parametrize("text", ["many / on (a) one", "one / on (a) many", "one * on (a) group_left many", "many - on () group_left many"])
def test_many_to_many_is_an_error(e, text):
    with pytest.raises(ManyToMany):
        e.query(text)
    assert e.query("one").count() == 3


def test_unknown_labels_are_errors(e):
    with pytest.raises(NoSuchField):
        e.query("many / on (a) group_left (b) one")
    with pytest.raises(NoSuchField):
        e.query("histogram_quantile(0.5, many)")


def test_functions_of_values_and_labels(e):
    of = lambda text: [r["value"] for r in e.query(text).orderBy("a", "value").collect()]
    assert of("abs(one - 5)") == [3.0, 1.0, 3.0]
    assert of("round(one / 3, 0.5)") == [0.5, 1.5, 2.5]
    assert of("log2(one)") == [1.0, 2.0, 3.0] and of("clamp(one, 3, 5)") == [3.0, 4.0, 5.0] and of("clamp(one, 5, 3)") == []
    assert of("ln(one - 2)")[0] == float("-inf")
    assert e.query("time() + 1", now_ms=5000).first()["value"] == 6.0
    got = e.query('label_replace(one, "side", "$1", "a", "([xy])")').collect()
    assert sorted(r["side"] for r in got) == ["west", "x", "y"]
    assert {r["j"] for r in e.query('label_join(one, "j", "/", "a", "side", "none")').collect()} == {"x/north/", "y/south/", "z/west/"}


def test_histogram_quantile(e):
    got = {r["a"]: r["value"] for r in e.query("histogram_quantile(0.5, hist)").collect()}
    assert got["h"] == pytest.approx(0.1 + 0.4 * 3 / 4) and got["g"] != got["g"]
    assert {r["a"]: r["value"] for r in e.query("histogram_quantile(0.95, hist)").collect()}["h"] == 1.0


@pytest.mark.parametrize("function", ["increase", "changes", "resets", "rate", "delta"])
def test_range_functions_over_many_stretches(spark, function, monkeypatch):
    monkeypatch.setattr(agg, "STRETCH_MS", 50_000)
    rng = random.Random(3)
    data = [(g, 1000 * t, None if rng.random() < 0.05 else float(rng.randrange(20))) for g in ("a", None) for t in range(0, 900, rng.choice([1, 3]))]
    df = spark.createDataFrame(data, "g string, ts_ms long, value double")

    def plain(points):
        steps = list(zip(points, points[1:], strict=False))
        if function == "delta":
            return points[-1] - points[0]
        if function in ("changes", "resets"):
            return float(sum(a != b if function == "changes" else b < a for a, b in steps))
        return sum(b if b < a else b - a for a, b in steps) / (60 if function == "rate" else 1)

    series = {g: [(t, v) for h, t, v in data if h == g and v is not None] for g in ("a", None)}
    got = {r["g"]: r["value"] for r in agg.over_time(df, function, ["g"], 60_000).collect()}
    assert got == pytest.approx({g: plain([v for _, v in x]) for g, x in series.items()})
    on_grid = {(r["g"], r["ts_ms"]): r["value"] for r in agg.over_time_grid(df, function, ["g"], 60_000).collect()}
    assert on_grid == pytest.approx({(g, t): plain([w for u, w in x if t - 60_000 < u <= t]) for g, x in series.items() for t, _ in x})


def test_no_task_holds_a_long_series(spark):
    """A series of all rows is put in order by stretches; its exchange is not by labels alone."""
    df = spark.range(100).select((F.col("id") % 1).cast("string").alias("g"), (F.col("id") * 3_600_000).alias("ts_ms"), F.col("id").cast("double").alias("value"))
    plan = agg.over_time(df, "increase", ["g"], None)._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.splitlines() if "Window" in line][-1]
    assert "_stretch" in first.split("windowspecdefinition(")[1]
    # Of the rows for a top k each task sends k at most.
    top = agg.aggregate(df, "topk", ["g"], param=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top
    assert [r["value"] for r in agg.aggregate(df, "topk", [], param=2).orderBy("value").collect()] == [98.0, 99.0]
