"""Operators on dirty series against plain Python, and their edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.heavy_keys import heavy_keys, keyed_totals
from tidemark.operators.regular_grid import regular_grid, solve_normal_equations
from tidemark.operators.rolling import rolling_totals
from tidemark.operators import spikes
from tidemark.operators.spikes import BLOCK, MARGIN, Limits, faulty_readings, judge, moves

DAY = 86_400_000
#: Columns that operators use for themselves inside.
CLASH = ["'k' key", "1 day", "2 n", "3 _value", "4 _ts", "'t' total", "cast(NULL as bigint) slot_ms", "0 _step", "'f' fault"]
META = "metric string, interval_ms bigint, lo double, hi double"


def table(spark, rows, clash=True):
    """rows: (series, metric, ts_ms, value); seq is their order."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq long, series_id string, metric string, ts_ms long, value double")
    return df.selectExpr("*", *CLASH) if clash else df


def dirty(rng, n=300, days=60):
    """A third of the rows is one series; times and rows repeat, and every column may be NULL."""
    rows = []
    for _ in range(n):
        key = rng.choice(["hot", "hot", "a", "b", "", None])
        ts = rng.choice([None, rng.randrange(-3 * DAY, days * DAY), rng.randrange(days) * DAY])
        value = rng.choice([None, math.nan, math.inf, round(rng.uniform(-9, 9), 2), round(rng.uniform(-9, 9), 2), 1e300 if rng.random() < 0.02 else 5.0])
        rows.append((key, "m", ts, value))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    return rows


def good(v):
    return v is not None and math.isfinite(v)


# --- heavy keys


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_keyed_totals(spark, slices):
    rows = dirty(random.Random(slices))
    got = {r["key"]: r for r in keyed_totals(table(spark, rows), "series_id", "ts_ms", "value", "seq", slices=slices).collect()}
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(r)
    assert set(got) == set(want)
    for k, rs in want.items():
        vs, ts = [v for *_, v in rs if good(v)], [t for _, _, t, _ in rs if t is not None]
        g = got[k]
        assert (g["n_rows"], g["n_readings"], g["first_ms"], g["last_ms"]) == (len(rs), len(vs), min(ts), max(ts))
        assert float(g["total"]) == pytest.approx(sum(v for v in vs if abs(v) < 1e20))
        assert g["total_huge"] == pytest.approx(sum(v for v in vs if abs(v) >= 1e20))


def test_a_hot_key_is_cut(spark):
    rows = [("hot", "m", 5, 1.0)] * 3000 + [(f"k{i}", "m", i, 1.0) for i in range(300)]
    got = {r["key"]: r for r in keyed_totals(table(spark, rows), "series_id", "ts_ms", "value", "seq", slices=8).collect()}
    assert got["hot"]["n_slices"] >= 6 and got["hot"]["n_rows"] == 3000
    assert sum(r["n_rows"] for r in got.values()) == 3300


def test_heavy_keys(spark):
    df = table(spark, [("a", "m", 1, 1.0)] * 6 + [("b", "m", 1, 1.0)] * 2 + [(None, "m", 1, 1.0)] * 2)
    totals = keyed_totals(df, "series_id", "ts_ms", "value")
    assert [r["key"] for r in heavy_keys(totals, df.agg(F.count(F.lit(1))), 0.2).collect()] == ["a"]
    assert keyed_totals(df.limit(0), "series_id", "ts_ms", "value").count() == 0


# --- rolling totals


def test_rolling_totals(spark):
    rows = dirty(random.Random(5))
    got = {(r["key"], r["day"]): r for r in rolling_totals(table(spark, rows), "series_id", "ts_ms", "value", "seq").collect()}
    last = {}
    for k, _, t, v in rows:
        if t is not None and good(v):
            last[k, t] = v
    daily = defaultdict(list)
    for (k, t), v in last.items():
        daily[k, t // DAY].append(v)
    want = {}
    for k in {k for k, _ in daily}:
        days = [d for q, d in daily if q == k]
        for d in range(min(days), max(days) + 1):
            want[k, d] = [[v for x in range(d - w + 1, d + 1) for v in daily.get((k, x), [])] for w in (7, 30)]
    assert set(got) == set(want)
    for at, (week, month) in want.items():
        for w, vs in ((7, week), (30, month)):
            g = got[at]
            assert g[f"n_{w}d"] == len(vs)
            if not vs:
                assert g[f"total_{w}d"] is None and g[f"avg_{w}d"] is None and g[f"huge_{w}d"] == 0
            else:
                assert float(g[f"total_{w}d"]) == pytest.approx(sum(v for v in vs if abs(v) < 1e20), abs=1e-9)
                assert g[f"avg_{w}d"] == pytest.approx(sum(vs) / len(vs))


def test_rolling_totals_of_nothing(spark):
    assert rolling_totals(table(spark, [("a", "m", None, 1.0), ("a", "m", 1, None)]), "series_id", "ts_ms", "value", "seq").count() == 0
    assert rolling_totals(table(spark, [("a", "m", 1, 1.0)]).limit(0), "series_id", "ts_ms", "value", "seq").count() == 0


# --- regular grid


def grid_of(spark, rows, meta=(("m", 1000, None, None),)):
    df = regular_grid(table(spark, rows), spark.createDataFrame(list(meta), META), "series_id", "metric", "ts_ms", "value", "seq")
    out = defaultdict(dict)
    for r in df.collect():
        assert r["slot_ms"] not in out[r["key"]]
        out[r["key"]][r["slot_ms"]] = r
    return out


def test_regular_grid_covers_every_period(spark):
    rng = random.Random(3)
    rows = []
    for key, n, reach in (("hot", 150, 9_000_000), ("a", 40, 60_000), (None, 5, 20_000), ("one", 1, 1)):
        for _ in range(n):
            rows.append((key, "m", rng.randrange(reach), rng.choice([None, math.nan, 1.0, 2.5])))
    rows += [("one", "m", 7, 3.0), ("x", "unknown", 1, 1.0), ("t", "m", None, 1.0), *rows[:20]]
    got = grid_of(spark, rows)
    want = defaultdict(dict)
    for k, (key, m, t, v) in enumerate(rows):
        if m == "m" and t is not None and good(v):
            old = want[key].get(t // 1000 * 1000, (-1, 0, 0))
            want[key][t // 1000 * 1000] = (k, v, old[2] + 1)
    assert set(got) == set(want)
    for key, slots in want.items():
        assert sorted(got[key]) == list(range(min(slots), max(slots) + 1000, 1000))
        for s, r in got[key].items():
            if s in slots:
                assert (r["value"], r["n_readings"], r["filled"]) == (slots[s][1], slots[s][2], False)
            else:
                assert r["filled"] and r["n_readings"] == 0 and math.isfinite(r["value"])


def test_gaps_are_filled_by_season_and_trend(spark):
    hour = 3_600_000
    wave = lambda t: 20 + t / DAY + 5 * math.sin(2 * math.pi * t / DAY)
    gone = set(range(100, 112)) | {150}
    rows = [("a", "m", t * hour + 17, 99_999.0 if t == 60 else wave(t * hour)) for t in range(240) if t not in gone]
    got = grid_of(spark, rows, [("m", hour, -100.0, 100.0)])["a"]
    for t in gone:
        assert got[t * hour]["value"] == pytest.approx(wave(t * hour), abs=0.05)
    assert got[60 * hour]["value"] == 99_999.0


def test_a_short_series_is_bridged_by_a_line(spark):
    got = grid_of(spark, [("a", "m", 0, 0.0), ("a", "m", 4000, 8.0)])["a"]
    assert [got[s]["value"] for s in range(0, 5000, 1000)] == pytest.approx([0, 2, 4, 6, 8])


def test_short_series_have_season_and_trend_too(spark):
    hour, start = 3_600_000, 19_800 * DAY
    wave = lambda t: 20 + t / 24 + 5 * math.sin(2 * math.pi * t / 24)
    rows = [("day", "m", start + t * hour, wave(t)) for t in range(37) if not 14 <= t < 20]
    # The last reading is out of bounds, so the gap before it has one end to start from.
    rows += [("half", "m", start + t * hour, 99_999.0 if t == 11 else 2.0 * t) for t in range(12) if not 7 <= t < 11]
    got = grid_of(spark, rows, [("m", hour, -100.0, 100.0)])
    for t in range(14, 20):
        assert got["day"][start + t * hour]["value"] == pytest.approx(wave(t), abs=0.05)
    for t in range(7, 11):
        assert got["half"][start + t * hour]["value"] == pytest.approx(2.0 * t, abs=0.05)


def test_normal_equations_match_least_squares():
    rng = np.random.default_rng(1)
    day = np.sort(rng.uniform(19_800, 19_860, 400))
    x = np.stack([np.ones(400), day, np.cos(2 * np.pi * day), np.sin(2 * np.pi * day)], axis=1)
    y = 3 + 0.2 * (day - 19_800) + 2 * x[:, 2] + rng.normal(0, 0.1, 400)
    got = solve_normal_equations((x.T @ x)[None], (x.T @ y)[None], np.array([60.0]))[0]
    want = np.linalg.lstsq(x - [0, day.mean(), 0, 0], y, rcond=None)[0]
    assert x @ got == pytest.approx((x - [0, day.mean(), 0, 0]) @ want, abs=1e-3)


# --- faulty readings


def wandering(rng, n, step=1.0):
    v, out = 100.0, []
    for _ in range(n):
        v += rng.gauss(0, 0.3 * step) - 0.02 * (v - 100)
        out.append(v + rng.gauss(0, step))
    return out


def faults(spark, rows, meta=(("m", 1000, -1e6, 1e6),)):
    df = faulty_readings(table(spark, rows), spark.createDataFrame(list(meta), META), "series_id", "metric", "ts_ms", "value", "seq")
    got = [(r["seq"], r["fault"]) for r in df.collect()]
    assert len({k for k, _ in got}) == len(got)
    return dict(got)


def test_faults_of_each_kind(spark):
    rng = random.Random(11)
    v = wandering(rng, 900)
    want = {}
    for at, length in ((100, 1), (200, 3), (300, 5), (302, 0), (640, 2)):
        for k in range(at, at + length):
            v[k] += 60 + rng.random()
            want[k] = "spike"
    for k in range(400, 425):
        v[k] = v[400]
        want[k] = "stuck"
    for k, x in ((500, math.nan), (510, math.inf), (520, 2e6), (530, -2e6)):
        v[k], want[k] = x, "bounds"
    v[540] = None
    for k in range(700, 900):
        v[k] += 80  # a lasting change of level is no fault
    rows = [("a", "m", k * 1000 + rng.randrange(300), x) for k, x in enumerate(v)]
    order = list(range(900))
    rng.shuffle(order)  # arrival has nothing to do with time
    place = {k: at for at, k in enumerate(order)}
    arrived = [rows[k] for k in order]
    again = [100, 410, 500, 50]
    arrived += [rows[k] for k in again]
    got = faults(spark, arrived)
    expected = {place[k]: f for k, f in want.items()} | {900 + j: want[k] for j, k in enumerate(again) if k in want}
    assert got == expected


def test_spikes_hidden_by_taller_ones_are_all_found(spark):
    rng = random.Random(12)
    v = wandering(rng, 600)
    at = range(300, 324, 3)
    for j, k in enumerate(at):
        v[k] += 60 * (len(at) - j)
    assert faults(spark, [("a", "m", k * 1000, x) for k, x in enumerate(v)]) == dict.fromkeys(at, "spike")


def test_no_faults(spark):
    rng = random.Random(2)
    steady = [("constant", "m", k * 1000, 7.0) for k in range(200)]
    repeats = [("repeats", "m", k * 1000, float(rng.choice([0, 0, 0, 1]))) for k in range(200)]
    total, counter = 0.0, []
    for k in range(300):
        total = 0.0 if k in (90, 200) else total + rng.uniform(4, 6)
        counter.append(("counter", "m", k * 1000, total))
    tank = [("tank", "m", k * 1000, 500 - 5 * (k % 60) + rng.gauss(0, 1)) for k in range(300)]
    daily = [("daily", "m", k * 1000, 50 * math.sin(k / 20) + rng.gauss(0, 1)) for k in range(300)]
    gap = [("gap", "m", (k + 500 * (k >= 100) + 900 * (k >= 103)) * 1000, 40.0 * (100 <= k < 103) + rng.gauss(0, 1)) for k in range(200)]
    few = [("few", "m", k * 1000, 10.0 ** (k % 2 * 5)) for k in range(5)]
    null = [(None, "m", k * 1000, None) for k in range(30)]
    assert faults(spark, steady + repeats + counter + tank + daily + gap + few + null) == {}


def test_bounds_alone(spark):
    rows = [("a", "free", 1, 1e18), ("a", "low", 1, -1.0), ("a", "low", 1, 0.0), ("a", "unknown", 1, math.nan), ("a", "low", None, -5.0), (None, None, None, math.inf)]
    meta = [("free", 1000, None, math.nan), ("low", 1000, 0.0, None)]
    assert set(faults(spark, rows, meta)) == {1, 3, 4, 5}
    assert faults(spark, rows[:0], meta) == {}


def whole(v):
    """The faults of one series of a reading a second, judged in one piece."""
    n = len(v)
    spike, stuck, counts = judge(np.zeros(n, np.int64), np.arange(n) * 1000, np.array(v), np.full(n, 1000), Limits())
    return {k: "spike" if spike[k] else "stuck" for k in np.flatnonzero(spike | (stuck & moves(*counts[0], Limits()))).tolist()}


@pytest.mark.parametrize("block", [2 * MARGIN, 4096, BLOCK])
def test_long_frozen_runs_are_found_whole(spark, monkeypatch, block):
    monkeypatch.setattr(spikes, "BLOCK", block)
    rng = random.Random(20)
    rows, want = [], {}
    for name, run in (("a", 4000), ("b", 9000), ("c", 15_000)):
        v = wandering(rng, run + 12_000)
        for at in (100, 3000, run + 8000):
            v[at] += 80
        for k in range(5000, 5000 + run):
            v[k] = v[5000]
        found = whole(v)
        assert {k for k, f in found.items() if f == "stuck"} == set(range(5000, 5000 + run))
        want |= {len(rows) + k: f for k, f in found.items()}
        rows += [(name, "m", k * 1000, x) for k, x in enumerate(v)]
    assert faults(spark, rows) == want


def test_the_ellipsoid_decides(monkeypatch):
    v = wandering(random.Random(21), 800)
    for k in (200, 400, 401, 600):
        v[k] += 40
    assert whole(v) == dict.fromkeys((200, 400, 401, 600), "spike")
    monkeypatch.setattr(spikes, "outside_ellipsoid", lambda v, *_: np.ones(len(v), bool))
    assert len(whole(v)) > 100  # the shape of an excursion alone is nothing rare
    monkeypatch.setattr(spikes, "outside_ellipsoid", lambda v, *_: np.zeros(len(v), bool))
    assert whole(v) == {}


def test_blocks_of_a_long_series_agree_with_the_whole(spark):
    rng = random.Random(4)
    n = 2 * BLOCK + 500
    v = wandering(rng, n)
    for at in (BLOCK - 2, BLOCK + 700, 2 * BLOCK):
        for k in range(at, at + 3):
            v[k] += 70
    for k in range(2 * BLOCK - 8, 2 * BLOCK - 8 + 7):
        v[k] += 0
    for k in range(BLOCK - 30, BLOCK - 14):
        v[k] = v[BLOCK - 30]
    got = set(faults(spark, [("a", "m", k * 1000, x) for k, x in enumerate(v)]))
    assert got == set(whole(v))
    assert {BLOCK - 2, BLOCK, BLOCK + 702, 2 * BLOCK + 2, BLOCK - 20} <= got


def test_a_correction_is_judged_by_its_own_value(spark):
    rng = random.Random(8)
    rows = [("a", "m", k * 1000, x) for k, x in enumerate(wandering(rng, 200))]
    wrong = ("a", "m", 100_000, rows[100][3] + 90)
    right = ("a", "m", 100_000, rows[100][3] + 0.1)
    assert faults(spark, [*rows, wrong]) == {200: "spike"}
    assert faults(spark, [*rows[:100], wrong, *rows[101:], right]) == {100: "spike"}
