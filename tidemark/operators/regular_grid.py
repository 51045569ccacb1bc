"""Irregular readings onto a regular grid, gaps filled from a seasonal fit.

For each series a trend and daily harmonics are fitted by least squares.  The normal
equations are plain sums, so Spark adds them up with map-side partial sums and only one
small matrix per series is solved.  A gap is filled with the fit plus the residual,
interpolated between the two observed periods around the gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import DAY_MS, tdiv, usable

#: Periods of one series that are ordered together; longer series are cut into such blocks.
BLOCK = 1024
#: Gaps are expanded in pieces of so many periods.
PIECE = 4096


def _features(slot: Column, harmonics: int) -> list[Column]:
    day = slot.cast("double") / F.lit(float(DAY_MS))
    out = [F.lit(1.0), day]
    for k in range(1, harmonics + 1):
        angle = F.lit(2 * np.pi * k) * (day - F.floor(day))
        out += [F.cos(angle), F.sin(angle)]
    return out


def solve_normal_equations(a: np.ndarray, b: np.ndarray, spans: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """Coefficients of each fit: ``a`` (n, p, p) and ``b`` (n, p) with rows 1, day, harmonics.

    The day is centred first, for the sake of conditioning.  A series that spans less than a day
    gets mean and trend without harmonics; the trend is left out too where the readings lie within so
    few minutes that the centred sums have no digits left for it.
    """
    n, p = b.shape
    out = np.zeros((n, p))
    count = np.maximum(a[:, 0, 0], 1)
    mean_day = a[:, 0, 1] / count
    shift = np.tile(np.eye(p), (n, 1, 1))
    shift[:, 1, 0] = -mean_day
    ac = shift @ a @ shift.transpose(0, 2, 1)
    bc = (shift @ b[:, :, None])[:, :, 0]
    terms = np.where(spans >= 1.0, p, 2)
    terms[(spans < 2.0) & (ac[:, 1, 1] <= 1e-13 * a[:, 1, 1])] = 1
    for q in {2, p}:
        part = terms == q
        if part.any():
            m = ac[part, :q, :q]
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", m), 1e-12))
            m = m / scale[:, :, None] / scale[:, None, :] + ridge * np.eye(q)
            out[part, :q] = np.linalg.solve(m, (bc[part, :q] / scale)[:, :, None])[:, :, 0] / scale
    mean = terms == 1
    out[mean, 0] = bc[mean, 0] / count[mean]
    out[:, 0] -= out[:, 1] * mean_day
    return out


def seasonal_fit(slots: DataFrame, harmonics: int) -> DataFrame:
    """``key`` and ``coef`` (array of the coefficients) for each key of ``key, slot_ms, fit_value``."""
    p = 2 + 2 * harmonics
    x = [f"x{i}" for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    named = slots.select("key", "slot_ms", "fit_value", *[c.alias(n) for c, n in zip(_features(F.col("slot_ms"), harmonics), x, strict=True)])
    sums = named.groupBy("key").agg(
        *[F.sum(F.when(F.col("fit_value").isNotNull(), F.col(x[i]) * F.col(x[j]))).alias(f"a{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(x[i]) * F.col("fit_value")).alias(f"b{i}") for i in range(p)],
        ((F.max("slot_ms") - F.min("slot_ms")) / F.lit(float(DAY_MS))).alias("span"),
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            of = lambda c: np.nan_to_num(t.column(c).to_numpy(zero_copy_only=False).astype(float))  # noqa: B023, E731
            a, b = np.zeros((t.num_rows, p, p)), np.zeros((t.num_rows, p))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = of(f"a{i}_{j}")
            for i in range(p):
                b[:, i] = of(f"b{i}")
            coef = solve_normal_equations(a, b, of("span"))
            yield pa.RecordBatch.from_arrays([t.column("key"), pa.array(list(coef), pa.list_(pa.float64()))], ["key", "coef"])

    return sums.mapInArrow(solve, f"key {slots.schema['key'].dataType.simpleString()}, coef array<double>")


def regular_grid(
    df: DataFrame,
    meta: DataFrame,
    key: str,
    metric: str,
    ts: str,
    value: str,
    seq: str,
    harmonics: int = 2,
) -> DataFrame:
    """One row per key and period, from the key's first to its last usable reading.

    ``meta`` gives each metric its ``interval_ms``, ``lo`` and ``hi``; a key has one metric.  A
    period starts at ``ts div interval_ms * interval_ms``.

    Columns: ``key``, ``slot_ms``, ``value``, ``n_readings`` and ``filled``.  An observed period
    has its last reading by ``seq``, which no two usable rows of a key and period share, and the
    number of its rows; a missing one has ``filled``, the predicted value and no readings.  Values outside
    ``lo`` .. ``hi`` are kept where observed but have no part in the fit, nor do they anchor it.

    NULL is a key of its own.  NULL and non-finite values, rows without a time and rows of a
    metric without a positive interval are left out.  An empty table gives no rows.
    """
    grid = meta.select(
        meta[metric].alias("_metric"), meta["interval_ms"].cast("bigint").alias("_step"), meta["lo"].alias("_lo"), meta["hi"].alias("_hi")
    ).where(F.col("_step") > 0)
    rows = df.select(
        df[key].alias("key"), df[metric].alias("_metric"), df[ts].cast("bigint").alias("_ts"), df[value].cast("double").alias("_value"), df[seq].alias("_seq")
    ).where(usable(F.col("_value")) & F.col("_ts").isNotNull())
    sound = (F.col("_lo").isNull() | F.isnan("_lo") | (F.col("_value") >= F.col("_lo"))) & (F.col("_hi").isNull() | F.isnan("_hi") | (F.col("_value") <= F.col("_hi")))
    placed = rows.join(grid, "_metric").select(
        "key",
        "_step",
        (tdiv(F.col("_ts"), F.col("_step")) * F.col("_step")).alias("slot_ms"),
        "_value",
        "_seq",
        sound.alias("_sound"),
    )
    # Copies and the readings of a slot come together before they are spread by key and slot; what
    # is then spread by key and block has at most one row per slot.
    slots = (
        placed.groupBy("key", "_step", "slot_ms")
        .agg(F.max_by("_value", "_seq").alias("value"), F.max_by("_sound", "_seq").alias("_sound"), F.count("*").alias("n_readings"))
        .select("key", "_step", tdiv(tdiv(F.col("slot_ms"), F.col("_step")), BLOCK).alias("_block"), "slot_ms", "n_readings", "value", F.when(F.col("_sound"), F.col("value")).alias("fit_value"))
        .repartition("key", "_block")
    )
    fit = seasonal_fit(slots.select("key", "slot_ms", "fit_value"), harmonics)

    # Gaps inside a block come from its own order, gaps between blocks from the blocks' ends.
    anchor = ["slot_ms", "fit_value"]
    inner = Window.partitionBy("key", "_step", "_block").orderBy("slot_ms")
    inside = slots.select(
        "key", "_step", F.struct(*anchor).alias("a"), F.lead(F.struct(*anchor)).over(inner).alias("b")
    ).where(F.col("b").isNotNull())
    ends = slots.groupBy("key", "_step", "_block").agg(
        F.max_by(F.struct(*anchor), "slot_ms").alias("a"), F.min_by(F.struct(*anchor), "slot_ms").alias("b")
    )
    between = ends.select(
        "key", "_step", "a", F.lead("b").over(Window.partitionBy("key", "_step").orderBy("_block")).alias("b")
    ).where(F.col("b").isNotNull())
    gaps = inside.unionByName(between).where(F.col("b.slot_ms") > F.col("a.slot_ms") + F.col("_step"))

    def predicted(slot: Column) -> Column:
        total = F.lit(0.0)
        for i, x in enumerate(_features(slot, harmonics)):
            total = total + F.get(F.col("coef"), F.lit(i)) * x
        return total

    same_key = gaps["key"].eqNullSafe(fit["key"])
    fitted = gaps.join(fit, same_key).select(
        gaps["key"],
        "_step",
        "coef",
        F.col("a.slot_ms").alias("_from"),
        F.col("b.slot_ms").alias("_to"),
        (F.col("a.fit_value") - predicted(F.col("a.slot_ms"))).alias("_ra"),
        (F.col("b.fit_value") - predicted(F.col("b.slot_ms"))).alias("_rb"),
    )
    pieces = fitted.withColumn(
        "_start", F.explode(F.sequence(F.col("_from") + F.col("_step"), F.col("_to") - F.col("_step"), F.col("_step") * PIECE))
    )
    missing = pieces.withColumn(
        "slot_ms",
        F.explode(
            F.sequence("_start", F.least(F.col("_start") + F.col("_step") * (PIECE - 1), F.col("_to") - F.col("_step")), F.col("_step"))
        ),
    )
    part = (F.col("slot_ms") - F.col("_from")) / (F.col("_to") - F.col("_from"))
    ra, rb = F.coalesce("_ra", "_rb", F.lit(0.0)), F.coalesce("_rb", "_ra", F.lit(0.0))
    filled = missing.select(
        "key", "slot_ms", (predicted(F.col("slot_ms")) + ra * (1 - part) + rb * part).alias("value"), F.lit(0).cast("bigint").alias("n_readings"), F.lit(True).alias("filled")
    )
    observed = slots.select("key", "slot_ms", "value", "n_readings", F.lit(False).alias("filled"))
    return observed.unionByName(filled)
