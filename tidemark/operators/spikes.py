"""Faulty readings, judged against what the same series shows.

Spikes are found by phase-space thresholding.  In the space of a reading's value (less the running
median), its first and its second difference, the readings of a series fill an ellipsoid whose axes come
from medians over the whole series, and from the steps around a reading where it is livelier there.
Readings far outside it, by the universal threshold sqrt(2 ln n) of the series' n readings, begin and end
excursions.  An excursion of at most ``MAX_LENGTH`` readings whose ends stand beyond all that is shown just
before and just after is a spike.  Spikes are taken out and the search is repeated until it finds none, as
a large spike hides smaller ones.

Stuck sensors are runs of differences near zero in a series that otherwise moves.  Values that
are no numbers or outside the metric's physical limits need no context.

Readings are cut into blocks of time with a margin on either side, so a series of any length is
worked on by many tasks, and no task holds more than one block of it at a time.  A first pass takes the
medians of each block; those of a series are merged, weighted by readings, and the second pass judges
every block by its series.  Whether a series moves is decided over all its blocks, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import tdiv, usable
from tidemark.functions.shared import combined_in_task, whole_groups, written

#: Readings of a spike at most, and readings of a stuck run at least.
MAX_LENGTH, MIN_RUN = 5, 10
#: Nominal intervals of a block, and of the margin that is added before and after it.
BLOCK, MARGIN = 16_384, 512
#: Nominal intervals whose median step counts as that of the surroundings; divides ``BLOCK``.
NEAR = 32


@dataclass(frozen=True)
class Limits:
    """Parameters of the detection; steps are the usual absolute difference of two readings."""

    far: float = 3.2  #: times the universal threshold at which a reading is far outside the ellipsoid
    returns: float = 0.1  #: share of an excursion's height by which its readings stand beyond the surroundings
    around: int = 4  #: readings before and after a spike that it is held against
    least_around: int = 2  #: fewest of them on either side
    still: float = 0.1  #: share of a step that counts as standing still
    still_share: float = 0.25  #: most differences, outside runs, that may be still in a series that moves
    moving_share: float = 0.2  #: fewest differences of the whole that must move
    gap: float = 6.0  #: intervals without readings that may explain a jump


#: What is known of a block, or of a series: readings; medians of the absolute differences, of those that
#: aren't zero, and of those outside runs without movement; how many aren't zero; the median of the absolute
#: values; and the medians that make the ellipsoid.
SCALES = ["readings", "step", "moved", "outside", "share", "level", "axis0", "axis1", "axis2"]


def _by_group(x: np.ndarray, gid: np.ndarray, n: int) -> np.ndarray:
    """Median of ``x`` (NaN left out) for each group 0 .. n-1; NaN where there is none."""
    return pd.Series(x).groupby(gid).median().reindex(range(n)).to_numpy()


def _shifted(x: np.ndarray, k: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The values ``k`` places on, held at the ends of each group."""
    return x[np.clip(np.arange(len(x)) + k, first, last)]


def _layout(gid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the first and last row of its group; and whether it has one before it."""
    n = len(gid)
    start = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
    sizes = np.diff(np.concatenate((start, [n])))
    first = np.repeat(start, sizes)
    return first, first + np.repeat(sizes, sizes) - 1, np.arange(n) > first


def _heads(gid: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its time."""
    return np.concatenate(([True], (gid[1:] != gid[:-1]) | (t[1:] != t[:-1]))) if len(gid) else np.zeros(0, bool)


def _differences(v: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return np.where(inner, np.abs(np.diff(v, prepend=v[:1])), np.nan)


def phase_space(v: np.ndarray, gid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value less the running median of thirteen readings, first and second difference."""
    first, last, _ = _layout(gid)
    before, after = _shifted(v, -1, first, last), _shifted(v, 1, first, last)
    running = np.median(np.stack([_shifted(v, k, first, last) for k in range(-6, 7)]), axis=0)
    return v - running, (after - before) / 2, after - 2 * v + before


def scales(v: np.ndarray, gid: np.ndarray, n_groups: int, mine: np.ndarray | None = None) -> np.ndarray:
    """``SCALES`` of each group, from the readings that are ``mine``; NaN where nothing tells."""
    mine = np.ones(len(v), bool) if mine is None else mine
    _, _, inner = _layout(gid)
    d = _differences(v, inner)
    still = inner & (d == 0)
    run = np.cumsum(~still) - 1
    long = still & (np.bincount(run)[run] >= MIN_RUN)
    own = lambda x: _by_group(np.where(mine, x, np.nan), gid, n_groups)
    share = pd.Series(np.where(mine & inner, d > 0, np.nan)).groupby(gid).mean().reindex(range(n_groups)).to_numpy(float)
    out = [
        np.bincount(gid, weights=mine, minlength=n_groups),
        own(d),
        own(np.where(d > 0, d, np.nan)),
        own(np.where(long, np.nan, d)),
        share,
        own(np.abs(v)),
        *[own(np.abs(x)) for x in phase_space(v, gid)],
    ]
    return np.stack(out, axis=1).astype(np.float32)


def usual_step(v: np.ndarray, t: np.ndarray, interval: np.ndarray, gid: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each row the usual absolute difference between readings there, never 0.

    The median of the whole series at least by half, else that of the surroundings.  Where most
    readings repeat the last one, the median of the others counts if they are a tenth of all.
    """
    _, _, inner = _layout(gid)
    d = _differences(v, inner)
    _, step, moved, _, share, level = (of[:, k].astype(float) for k in range(6))
    base = np.where(step > 0, np.fmax(step, 0.5 * moved), np.where(share >= 0.1, 2 * moved, 0))
    size = np.nan_to_num(base, nan=0, posinf=0)
    size = np.where(size > 0, size, np.maximum(1e-3 * np.nan_to_num(level), 1e-9))
    # Surroundings: the middle one of the medians of the stretch of time, the one before and the one after.
    part = t // (interval * NEAR)
    start = np.concatenate(([True], (part[1:] != part[:-1]) | (gid[1:] != gid[:-1])))
    part = np.cumsum(start) - 1
    own = np.nan_to_num(pd.Series(d).groupby(part).median().to_numpy())
    owner = gid[start]
    near = lambda k: np.where(np.roll(owner, k) == owner, np.roll(own, k), own)
    local = np.median(np.stack((near(1), own, near(-1))), axis=0)
    return np.fmax(0.5 * size[gid], local[part])


def outside_ellipsoid(v: np.ndarray, gid: np.ndarray, of: np.ndarray, step: np.ndarray, far: float) -> np.ndarray:
    """Whether a reading lies far outside its series' robust ellipsoid in phase space.

    The axes are those of the series, a step there at least, times ``far`` times the universal threshold.
    Next to a spike the differences are large though the value is an ordinary one, so they
    count no more than the value's own departure explains.
    """
    u, d1, d2 = phase_space(v, gid)
    most = np.abs(u)
    bound = far * np.sqrt(2 * np.log(np.maximum(of[:, 0].astype(float), 3)))[gid]
    total = np.zeros(len(v))
    for k, x in enumerate((most, np.minimum(np.abs(d1), most), np.minimum(np.abs(d2), 2 * most))):
        axis = np.maximum(1.4826 * np.nan_to_num(of[:, 6 + k].astype(float))[gid], step)
        total += (x / axis) ** 2
    return total > bound**2


def find_spikes(
    v: np.ndarray, t: np.ndarray, interval: np.ndarray, gid: np.ndarray, of: np.ndarray, limits: Limits
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flags of the readings that are spikes, the step at each, and the bounds shown around flagged ones."""
    n_groups = len(of)
    flagged = np.zeros(len(v), bool)
    step_at, low_at, high_at = np.zeros(len(v)), np.full(len(v), np.nan), np.full(len(v), np.nan)
    todo = np.ones(n_groups, bool)
    # Each round takes readings out, so there is a last one.
    for turn in count():
        keep = np.flatnonzero(todo[gid] & ~flagged)
        if not len(keep):
            break
        x, when, g, gap = v[keep], t[keep], gid[keep], interval[keep] * limits.gap
        step = usual_step(x, when, interval[keep], g, of)
        if turn == 0:
            step_at[keep] = step
        first, last, _ = _layout(g)
        out = outside_ellipsoid(x, g, of, step, limits.far)
        heads = np.flatnonzero(out)
        best = np.zeros(len(x))
        lo_best, hi_best = np.full(len(x), np.nan), np.full(len(x), np.nan)
        for length in range(1, MAX_LENGTH + 1):
            s = heads[heads + length - 1 <= last[heads]]
            s = s[out[s + length - 1]]
            n_left, n_right = s - first[s], last[s] - (s + length - 1)
            s = s[(n_left >= limits.least_around) & (n_right >= limits.least_around)]
            if not len(s):
                continue
            e = s + length - 1
            k = np.arange(1, limits.around + 1)
            left, right = x[np.maximum(s[:, None] - k, first[s][:, None])], x[np.minimum(e[:, None] + k, last[s][:, None])]
            both = np.concatenate((left, right), axis=1)
            low, high = both.min(axis=1), both.max(axis=1)
            inside = x[s[:, None] + np.arange(length)]
            each = np.maximum(low[:, None] - inside, inside - high[:, None])
            beyond = np.minimum(each[:, 0], each[:, -1])
            height = np.abs(inside - np.median(both, axis=1)[:, None]).max(axis=1)
            change = np.abs(np.median(left, axis=1) - np.median(right, axis=1))
            gap_before = when[s] - when[s - 1] > gap[s]
            gap_after = when[e + 1] - when[e] > gap[s]
            good = (beyond >= change) & (beyond > limits.returns * height) & (each.min(axis=1) > limits.returns * beyond) & ~(gap_before & gap_after)
            for j in np.flatnonzero(good):
                i = np.arange(s[j], e[j] + 1)
                better = i[beyond[j] > best[i]]
                best[better], lo_best[better], hi_best[better] = beyond[j], low[j], high[j]
        hit = np.flatnonzero(best > 0)
        if not len(hit):
            break
        at = keep[hit]
        flagged[at], step_at[at], low_at[at], high_at[at] = True, step[hit], lo_best[hit], hi_best[hit]
        todo = np.zeros(n_groups, bool)
        todo[g[hit]] = True
    return flagged, step_at, low_at, high_at


#: Differences of a block: all, those that move, those outside long still runs, and the still ones of these.
COUNTS = ["n_all", "n_moving", "n_other", "n_still"]


def find_stuck(v: np.ndarray, gid: np.ndarray, of: np.ndarray, limits: Limits, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the readings in long runs in which the series stands still, and ``COUNTS`` of each group."""
    n_groups = len(of)
    _, _, inner = _layout(gid)
    d = _differences(v, inner)
    step = np.nan_to_num(of[:, 3].astype(float))[gid]
    still = inner & ((d < limits.still * step) | (d == 0))
    run = np.cumsum(~still) - 1
    size = np.bincount(run)[run]
    long = size >= MIN_RUN
    other = inner & ~(long & still)
    number = lambda x: np.bincount(gid, weights=x & mine, minlength=n_groups)
    counts = np.stack((number(inner), number(inner & ~still), number(other), number(other & still)), axis=1)
    hit = long & (step > 0)
    # A run of equal values doesn't take in a neighbour that comes close by chance.
    exact = pd.Series((d == 0) & still).groupby(run).sum().to_numpy()[run]
    frozen = hit & (exact >= 0.8 * (size - 1))
    nxt = np.concatenate((still[1:] & (d[1:] == 0), [False]))
    touches = (still & (d == 0)) | nxt
    inner_part = pd.Series(touches).groupby(run).cummax().to_numpy() & pd.Series(touches[::-1]).groupby(run[::-1]).cummax().to_numpy()[::-1]
    return hit & (~frozen | inner_part), counts


def judge(
    gid: np.ndarray, t: np.ndarray, v: np.ndarray, interval: np.ndarray, limits: Limits, of: np.ndarray | None = None, mine: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spike and stuck flags of rows sorted by group, time and arrival, and ``COUNTS`` of each group.

    ``of`` has the ``SCALES`` of each group's series; by default each group is a series.  The first row of a
    time stands for it.  A later row of the same time gets the verdict on its own value: equal to the
    first, beyond the same bounds, or as still as the run it is in.  Stuck runs count if the series moves: see
    :func:`moves`.
    """
    n_groups = int(gid[-1]) + 1 if len(gid) else 0
    head = _heads(gid, t)
    at = np.flatnonzero(head)
    x, g = v[at], gid[at]
    own = np.ones(len(at), bool) if mine is None else mine[at]
    of = scales(x, g, n_groups, own) if of is None else of
    spike, step, low, high = find_spikes(x, t[at], interval[at], g, of, limits)
    stuck, counts = np.zeros(len(at), bool), np.zeros((n_groups, 4))
    calm = np.flatnonzero(~spike)
    if len(calm):
        stuck[calm], counts = find_stuck(x[calm], g[calm], of, limits, own[calm])
    owner = np.cumsum(head) - 1
    first, last, _ = _layout(g) if len(g) else (np.zeros(0, int),) * 3
    spike_row, stuck_row = spike[owner], stuck[owner]
    late = np.flatnonzero(~head & (v != x[owner]))
    bound = limits.far * np.sqrt(2 * np.log(np.maximum(of[:, 0].astype(float), 3)))
    for r in late:
        o = owner[r]
        if spike[o]:
            lo, hi = low[o], high[o]
        else:
            near = np.concatenate((x[max(first[o], o - limits.around) : o], x[o + 1 : min(last[o], o + limits.around) + 1]))
            lo, hi = (near.min(), near.max()) if len(near) >= 2 * limits.least_around else (-np.inf, np.inf)
        # The ellipsoid's extent along the value alone.
        axis = max(1.4826 * float(np.nan_to_num(of[g[o], 6])), step[o])
        spike_row[r] = max(lo - v[r], v[r] - hi) > 0.8 * bound[g[o]] * axis
        stuck_row[r] = stuck[o] and abs(v[r] - x[o]) < limits.still * step[o]
    return spike_row, stuck_row, counts


def moves(n_all, n_moving, n_other, n_still, limits: Limits):
    """Whether a series of these counts moves, so that it is noteworthy if it stands still (columns or arrays)."""
    return (n_still <= limits.still_share * n_other) & (n_moving >= limits.moving_share * n_all) & (n_moving >= MIN_RUN)


def faulty_readings(
    df: DataFrame,
    meta: DataFrame,
    key: str,
    metric: str,
    ts: str,
    value: str,
    seq: str,
    limits: Limits | None = None,
) -> DataFrame:
    """``seq`` and ``fault`` (``bounds``, ``spike`` or ``stuck``) of each faulty row.

    ``meta`` gives each metric its ``interval_ms``, ``lo`` and ``hi`` (NULL or NaN: no limit).  A row is
    reported once, as a spike rather than as stuck.  Non-finite values are ``bounds``; values
    outside the limits too, and they have no part in the judgement of others.

    Rows with a NULL value are never faulty.  A row without a time or of an unknown metric is
    only held against the bounds.  NULL is a key of its own.  Repeated rows are each reported.  A
    series of fewer than six readings is only held against the bounds.  An empty table gives
    no rows.  Other columns are not read.  Keys are told apart by a 64-bit hash.
    ``seq`` tells rows apart.

    The readings found are written to the shared folder when this is called, so that they are found once.  Copies
    of a reading are combined before the shuffle, so a heavily copied one burdens no task.
    """
    limits = limits or Limits()
    known = meta.select(
        meta[metric].alias("_metric"), meta["interval_ms"].cast("bigint").alias("_step"), meta["lo"].alias("_lo"), meta["hi"].alias("_hi")
    )
    rows = df.select(
        df[seq].alias("seq"),
        F.xxhash64(df[key].isNull(), df[key]).alias("_key"),
        df[metric].alias("_metric"),
        df[ts].cast("bigint").alias("_ts"),
        df[value].cast("double").alias("_value"),
    ).where(F.col("_value").isNotNull())
    joined = rows.join(known, "_metric", "left")
    out_of = F.coalesce(F.col("_value") < F.nanvl("_lo", F.lit(float("-inf"))), F.lit(False)) | F.coalesce(
        F.col("_value") > F.nanvl("_hi", F.lit(float("inf"))), F.lit(False)
    )
    bad = ~usable(F.col("_value")) | out_of
    bounds = joined.where(bad).select("seq", F.lit("bounds").alias("fault"))

    width = F.col("_step") * BLOCK
    own = tdiv(F.col("_ts"), width)
    offset = F.col("_ts") - own * width
    # A row goes to its block and, near a border, to the block beyond it as context.
    near = F.when(offset < F.col("_step") * MARGIN, own - 1).when(offset >= F.col("_step") * (BLOCK - MARGIN), own + 1)
    judged = joined.where(~bad & F.col("_ts").isNotNull() & (F.col("_step") > 0))
    placed = judged.select("seq", "_key", "_ts", "_value", "_step", F.explode(F.array_compact(F.array(own, near))).alias("_block"), own.alias("_own"))
    place, mine = ["_key", "_block"], ["_key", "_block", "_ts", "_value"]
    sent = combined_in_task(placed.select(*mine, "_step", "seq", (F.col("_block") == F.col("_own")).alias("_mine")), [*mine, "_step", "_mine"], "seq")
    # The join below asks for places that aren't NULL; asked for here, both passes share one shuffle.
    in_blocks = sent.where("_key is not null and _block is not null").repartition(*place)

    def columns(t: pa.Table, *names: str) -> list[np.ndarray]:
        key, block = t.column("_key").to_numpy(), t.column("_block").to_numpy()
        gid = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))).astype(np.int64)
        return [gid, *[t.column(c).to_numpy() for c in names]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, place):
            gid, key, block, ts_, v, own_ = columns(t, "_key", "_block", "_ts", "_value", "_mine")
            at = np.flatnonzero(_heads(gid, ts_))
            start = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
            found = scales(v[at], gid[at], len(start), own_[at])
            keep = np.flatnonzero(found[:, 0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(key[start][keep]), pa.array(block[start][keep]), *[pa.array(x[keep].astype(float), from_pandas=True) for x in found.T]], [*place, *SCALES])

    order = [*place, "_ts", "seq"]
    blocks = in_blocks.sortWithinPartitions(*order).mapInArrow(measure, f"_key bigint, _block bigint, {', '.join(f'{c} double' for c in SCALES)}")
    # A series has one row a block here, so a window holds few.
    series = Window.partitionBy("_key")
    weight = F.col("readings").cast("bigint")
    merged = {"readings": F.sum("readings").over(series), "share": (F.sum(F.col("share") * weight).over(series) / F.sum(F.when(F.col("share").isNotNull(), weight)).over(series))}
    known_scales = blocks.select(
        F.col("_key").alias("_k"),
        F.col("_block").alias("_b"),
        *[merged.get(c, F.percentile(c, F.lit(0.5), weight).over(series)).cast("float").alias(c) for c in SCALES],
    )
    scaled = in_blocks.join(known_scales.hint("shuffle_hash"), (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b"))).drop("_k", "_b")

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, place):
            gid, ts_, v, step, own_ = columns(t, "_ts", "_value", "_step", "_mine")
            start = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
            of = np.stack([t.column(c).take(pa.array(start)).to_pandas().to_numpy(np.float32) for c in SCALES], axis=1)
            spike, stuck, counts = judge(gid, ts_, v, step, limits, of, own_)
            pick = np.flatnonzero((spike | stuck) & own_)
            out = t.select([*mine, "seq", "n"]).take(pa.array(pick, pa.int64()))
            fault = pa.array(np.where(spike[pick], "spike", "stuck").tolist(), pa.string())
            rows_ = pa.table({**{c: out.column(c) for c in out.column_names}, "fault": fault, **{c: pa.nulls(len(pick), pa.float64()) for c in COUNTS}})
            # One row without a fault has the counts of each block.
            each = t.select(place).take(pa.array(start))
            none = len(start)
            told = pa.table({"_key": each.column("_key"), "_block": each.column("_block"), "_ts": pa.nulls(none, pa.int64()), "_value": pa.nulls(none, pa.float64()), "seq": pa.nulls(none, t.schema.field("seq").type), "n": pa.nulls(none, pa.int64()), "fault": pa.nulls(none, pa.string()), **{c: pa.array(counts[:, k]) for k, c in enumerate(COUNTS)}})
            yield from rows_.to_batches()
            yield from told.to_batches()

    kind = rows.schema["seq"].dataType.simpleString()
    told = written(
        scaled.sortWithinPartitions(*order).mapInArrow(detect, f"_key bigint, _block bigint, _ts bigint, _value double, seq {kind}, n bigint, fault string, {', '.join(f'{c} double' for c in COUNTS)}")
    )
    at_rest = told.where("fault is null").groupBy("_key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    unmoved = at_rest.where(~moves(*[F.col(c) for c in COUNTS], limits)).select(F.col("_key").alias("_k"))
    stuck = told.where("fault = 'stuck'")
    found = told.where("fault = 'spike'").unionByName(stuck.join(unmoved, F.col("_key") == F.col("_k"), "left_anti"))
    # Of a reading that came once the row is known; of one that was copied, all rows are looked up.
    several = found.groupBy(*mine, "fault").agg(F.sum("n").alias("n"), F.min("seq").alias("seq"))
    single = several.where("n = 1").select("seq", "fault")
    copied = several.where("n > 1").select(*[F.col(c).alias(f"_c{c}") for c in mine], F.col("fault").alias("_fault"))
    again = judged.select("seq", "_key", own.alias("_block"), "_ts", "_value")
    same = F.lit(True)
    for c in mine:
        same = same & (again[c] == copied[f"_c{c}"])
    copies = again.join(copied, same).select("seq", F.col("_fault").alias("fault"))
    return bounds.unionByName(single).unionByName(copies)
