"""Nested write requests: ``timeseries: array<struct<labels, samples>>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_value(labels: Column, name: str) -> Column:
    """Value of the first label called ``name``; NULL when there is none.  ``""`` stays ``""``."""
    return F.get(F.filter(labels, lambda x: x["name"] == F.lit(name)), F.lit(0))["value"]


def exploded_series(requests: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per series of a request: ``request_id``, the named labels and ``samples``.

    Requests whose ``timeseries`` is NULL or empty give no rows.
    """
    series = requests.select("request_id", F.explode("timeseries").alias("_t"))
    return series.select(
        "request_id", *[label_value(F.col("_t.labels"), n).alias(n) for n in names], F.col("_t.samples").alias("samples")
    )


def exploded_readings(requests: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per sample, and one without time and value for a series that has no samples.

    ``length`` is the number of samples of the series; ``is_first`` marks one row of each series.
    """
    series = exploded_series(requests, names)
    return series.select(
        "request_id", *names, F.coalesce(F.size("samples"), F.lit(0)).alias("length"), F.posexplode_outer("samples").alias("_pos", "_s")
    ).select(
        "request_id",
        *names,
        F.greatest("length", F.lit(0)).alias("length"),
        (F.coalesce(F.col("_pos"), F.lit(0)) == 0).alias("is_first"),
        F.col("_s.timestamp").alias("ts_ms"),
        F.col("_s.value").alias("value"),
    )


def checked_series(requests: DataFrame, seq: str) -> DataFrame:
    """One row per series: ``seq``, ``place`` in the request, ``metric``, ``labels`` (a map without
    ``__name__``), ``samples`` and ``problem``: ``no name``, ``label twice`` or NULL.

    A NULL or empty ``__name__`` is no name.
    """
    series = requests.select(F.col(seq).alias("seq"), F.posexplode("timeseries").alias("place", "_t"))
    labels = F.filter(F.col("_t.labels"), lambda x: x["name"].isNotNull())
    names = F.transform(labels, lambda x: x["name"])
    twice = F.size(F.array_distinct(names)) < F.size(names)
    metric = label_value(F.col("_t.labels"), "__name__")
    return series.select(
        "seq",
        "place",
        metric.alias("metric"),
        F.when(twice, F.create_map().cast("map<string,string>"))
        .otherwise(F.map_from_entries(F.filter(labels, lambda x: x["name"] != "__name__")))
        .alias("labels"),
        F.col("_t.samples").alias("samples"),
        F.when(F.coalesce(metric, F.lit("")) == "", "no name").when(twice, "label twice").alias("problem"),
    )


def first_labels(series: DataFrame) -> list:
    """For each metric the label names of its first series, in their order, and all that occur."""
    names = F.map_keys("labels")
    return (
        series.groupBy("metric")
        .agg(F.min_by(names, F.struct("seq", "place")).alias("first"), F.array_distinct(F.flatten(F.collect_set(names))).alias("every"))
        .orderBy("metric")
        .collect()
    )


def from_json(df: DataFrame, text: str, seq: str) -> DataFrame:
    """Requests that come as JSON text, in the same nesting."""
    return df.select(F.col(seq), F.from_json(F.col(text), REQUEST)["timeseries"].alias("timeseries"))


REQUEST = "timeseries array<struct<labels:array<struct<name:string,value:string>>,samples:array<struct<value:double,timestamp:bigint>>>>"
