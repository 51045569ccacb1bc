"""Distinct counts and percentiles against exact ones."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import membership, percentiles

GROUPS = ["day", "tenant", "zone"]


def rows_of(rng, n):
    """One identifier has a third of the rows."""
    out = []
    for _ in range(n):
        who = rng.choice(["hot"] * 20 + [f"id{i}" for i in range(38)] + [None, ""])
        out.append((rng.choice(["client", "trace"]), who, rng.choice([1, 2, 3, None]), rng.choice(["t", "", None]), rng.choice(["z", "y"]), "x"))
    return out + out[: n // 5]


SCHEMA = "kind string, who string, day int, tenant string, zone string, id1 string"


def test_counts_of_all_combinations(spark):
    rows = rows_of(random.Random(1), 500)
    df = spark.createDataFrame(rows, SCHEMA)
    want = defaultdict(set)
    for kind, who, *values, _ in rows:
        if who is not None:
            for r in range(4):
                for c in itertools.combinations(range(3), r):
                    want[kind, "+".join(GROUPS[i] for i in c), *[values[i] if i in c else None for i in range(3)]].add(who)
    got = {(r["kind"], r["by"], r["day"], r["tenant"], r["zone"]): r["n_ids"] for r in membership.distinct_counts(df, "kind", "who", GROUPS).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_parts_merge_and_any_union_or_intersection_is_exact(spark):
    rows = rows_of(random.Random(2), 300)
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [membership.memberships(df.where(c), "kind", "who", GROUPS) for c in ("day = 1", "day is distinct from 1", "zone = 'z'")]
    totals = membership.pattern_totals(membership.merge(parts), GROUPS)

    def ids(test):
        out = defaultdict(set)
        for kind, who, *v, _ in rows:
            if who is not None and test(*v):
                out[kind].add(who)
        return out

    one, two = ids(lambda d, t, z: d == 1), ids(lambda d, t, z: t == "" and z == "y")
    get = lambda df: {r["kind"]: r["n_ids"] for r in df.collect()}
    a, b = F.col("day") == 1, (F.col("tenant") == "") & (F.col("zone") == "y")
    assert get(membership.count_any(totals, a | b)) == {k: len(one[k] | two[k]) for k in one}
    assert get(membership.count_all(totals, [a, b])) == {k: len(one[k] & two[k]) for k in one if one[k] & two[k]}


def test_a_hot_pattern_is_counted_in_the_tasks(spark):
    """Nine of ten identifiers have the same pattern: their rows don't go to one task."""
    ids = spark.range(200_000).select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("who"), F.when(F.col("id") % 10 < 9, F.lit(1)).otherwise(F.col("id").cast("int")).alias("day"), F.lit("t").alias("tenant"), F.lit("z").alias("zone"), F.lit("x").alias("id1"))
    members = membership.memberships(ids, "kind", "who", GROUPS)
    totals = membership.pattern_totals(members, GROUPS)
    assert totals.where("day = 1").select(F.sum("n")).first()[0] >= 180_000
    named = members.withColumn("x", F.lit(1)).select("kind", *GROUPS)
    sent = membership.counted_in_task(named.where("day = 1"), "n")
    assert sent.count() <= named.rdd.getNumPartitions() * 2


def test_null_and_empty_differ_in_patterns(spark):
    df = spark.createDataFrame([("k", "a", 1, None, "z", ""), ("k", "b", 1, "", "z", ""), ("k", "c", None, "1", "z", ""), ("k", "d", 1, None, "1", "")], SCHEMA)
    totals = membership.pattern_totals(membership.memberships(df, "kind", "who", GROUPS), GROUPS)
    assert totals.select("name1", "name2").distinct().count() == 4


def test_nothing_to_count(spark):
    df = spark.createDataFrame([("k", None, 1, "t", "z", "")], SCHEMA)
    assert membership.distinct_counts(df, "kind", "who", GROUPS).count() == 0
    assert membership.distinct_counts(df.limit(0), "kind", "who", GROUPS).count() == 0


def test_percentiles_keep_their_bound_over_days(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 3 + ["a", None, ""]), rng.randrange(30 * 86_400_000), rng.choice([rng.gauss(0, 1), rng.expovariate(0.01), 5.0])) for _ in range(20_000)]
    rows += [("few", 5, float(v)) for v in range(11)] + [("none", 5, None), ("none", 5, math.nan), ("hot", None, 1e9), ("hot", 7, math.inf)]
    df = spark.createDataFrame(rows, "g string, ts long, value double").withColumn("n", F.lit("x")).withColumn("keys", F.lit(1)).withColumn("sketch", F.lit(1))
    daily = percentiles.daily_sketches(df, [["g"], ["g", "n"]], "ts", "value", k=400)
    assert daily.where("grouping = 'g'").select("day").distinct().count() == 30
    halves = percentiles.combine(daily.where("day < 11"), k=400).unionByName(percentiles.combine(daily.where("day >= 11"), k=400))
    got = {(r["grouping"], r["keys"][0]): r for r in percentiles.percentiles(percentiles.combine(halves, k=400), k=400).collect()}
    exact = defaultdict(list)
    for g, ts, v in rows:
        if ts is not None and v is not None and math.isfinite(v):
            exact[g].append(v)
    assert {k for grouping, k in got if grouping == "g"} == set(exact) == {k for grouping, k in got if grouping == "g+n"}
    for g, vs in exact.items():
        r = got["g", g]
        assert r["n"] == len(vs)
        slack = r["rank_error"] * len(vs) + 1
        for q in percentiles.QUANTILES:
            x = r[f"p{q * 100:g}"]
            assert sum(v < x for v in vs) <= q * len(vs) + slack and sum(v <= x for v in vs) >= q * len(vs) - slack
    assert got["g", "few"]["p50"] == 5.0 and got["g", "few"]["rank_error"] == 0
    assert percentiles.percentiles(percentiles.daily_sketches(df.limit(0), [["g"]], "ts", "value")).count() == 0


def test_rank_error():
    assert percentiles.rank_error(800) == pytest.approx(0.00345, abs=1e-5)
