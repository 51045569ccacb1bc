"""As-of joins against plain Python."""

import random

import pytest

from tidemark.operators.asof import asof_join


@pytest.mark.parametrize("tolerance", [None, 40])
@pytest.mark.parametrize("stretch", [7, 100, 10_000])
def test_asof_join(spark, tolerance, stretch):
    rng = random.Random(stretch)
    key = lambda: rng.choice(["hot", "hot", "a", "", None])
    left = [(k, key(), rng.choice([None, rng.randrange(-300, 1000)]), f"x{k}") for k in range(200)]
    left += left[:5]
    right = [(key(), rng.choice([None, rng.randrange(-300, 900)]), rng.choice([None, 1.0, 2.0]), k) for k in range(80)]
    right += [("a", 500, 1.0, 900), ("a", 500, 1.0, 901)]
    l = spark.createDataFrame(left, "n int, g string, t long, _last string")
    r = spark.createDataFrame(right, "g string, t long, value double, k int")
    got = sorted(tuple(x) for x in asof_join(l, r, ["g"], "t", "t", ["value", "k"], tolerance, stretch).select("n", "matched_ts", "k").collect())
    want = []
    for n, g, t, _ in left:
        best = [(u, v is not None, v or 0, k) for h, u, v, k in right if h == g and u is not None and t is not None and u <= t and (tolerance is None or t - u <= tolerance)]
        u, *_, k = max(best) if best else (None, None)
        want.append((n, u, k))
    none = lambda x: tuple((y is not None, y or 0) for y in x)
    assert sorted(map(none, got)) == sorted(map(none, want))


def test_nothing_to_join(spark):
    l = spark.createDataFrame([("a", 5)], "g string, t long")
    r = spark.createDataFrame([("a", 1, 2.0)], "g string, t long, value double")
    assert [tuple(x) for x in asof_join(l, r.limit(0), ["g"], "t", "t", ["value"]).collect()] == [("a", 5, None, None)]
    assert asof_join(l.limit(0), r, ["g"], "t", "t", ["value"]).count() == 0
