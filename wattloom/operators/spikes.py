"""Implausible readings of sensors (problem 7).

Each recording is cut into blocks of time; a block also sees the readings a margin before and
after it, so a recording of any length is many bounded groups. Each field is taken apart with an
undecimated Haar wavelet of LEVELS levels. A first pass over the blocks gives the robust scale of
every level's details, and one aggregation the scale of the recording. In a second pass details that
stand out against the recording's scales mark where something jumps; a few readings between opposite
jumps that leave a robust approximation are a spike, a run of zero details at the finest level is a
stuck sensor, and fixed bounds catch what no rider or device can read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import cut_lineage


@dataclass(frozen=True)
class Limits:
    """What one field may do. ``floor``: least size of a jump; ``sure``: size from which no rider
    makes it between two readings; ``down``: whether falls count (power and cadence may fall to 0 at
    any time)."""

    lowest: float
    highest: float
    floor: float
    sure: float
    down: bool


LIMITS = {
    "power": Limits(0, 2000, 150, 250, False),
    "heart_rate": Limits(25, 240, 30, 30, True),
    "cadence": Limits(0, 250, 45, 45, False),
}

#: Levels of the decomposition; scaled details beyond so many deviations are jumps.
LEVELS, SIGMAS = 4, 8.0
#: A spike has at most so many readings, two that touch twice as many; the coarse approximation
#: spans REACH readings on either side.
SPIKE_READINGS, REACH = 3, 7
#: An effort builds up in about three steps. Both jumps of a spike make at least these shares of its
#: height: STEEP where they are smaller than what no rider makes, SHARE for touching spikes.
STEEP, SHARE = 0.7, 0.45
#: A stretch is stuck from so many readings and seconds on.
STUCK_READINGS, STUCK_S = 10, 75.0
BLOCK_S, MARGIN_S = 6 * 3600, 1800


def details(v: np.ndarray) -> np.ndarray:
    """Undecimated Haar details of LEVELS levels, one row each: at level j half the difference of the
    means of the last 2**(j-1) readings and of as many before. The first value stands for what came
    before it, so the details and the last approximation add up to the values."""
    out, a = np.empty((LEVELS, len(v))), v.astype(float)
    for j in range(LEVELS):
        step = 1 << j
        before = np.concatenate((np.full(min(step, len(a)), a[0] if len(a) else 0.0), a[:-step] if step < len(a) else a[:0]))
        out[j] = (a - before) / 2
        a = (a + before) / 2
    return out


def scales(v: np.ndarray) -> tuple[int, np.ndarray]:
    """(readings, robust deviation of each level's details) where both readings of a step are above 0."""
    if len(v) < 2:
        return 0, np.zeros(LEVELS)
    moving = np.r_[False, (v[1:] > 0) & (v[:-1] > 0)]
    n = int(moving.sum())
    return n, 1.4826 * np.median(np.abs(details(v)[:, moving]), axis=1) if n else np.zeros(LEVELS)


def _approximation(v: np.ndarray, level: float) -> np.ndarray:
    """Robust coarse approximation: the median of the values above 0 in reach; ``level`` stands in
    where fewer than half of them are."""
    padded = np.pad(v, REACH, constant_values=0.0)
    near = np.sort(sliding_window_view(padded, 2 * REACH + 1), axis=1)
    zeros = (near <= 0).sum(axis=1)
    n = 2 * REACH + 1 - zeros
    lo, hi = zeros + (n - 1) // 2, zeros + n // 2
    rows = np.arange(len(v))
    top = 2 * REACH
    mid = (near[rows, np.minimum(lo, top)] + near[rows, np.minimum(hi, top)]) / 2
    return np.where(n > REACH, mid, level)


def _spikes(v: np.ndarray, limits: Limits, scale: np.ndarray) -> np.ndarray:
    """Marks of the readings of spikes; ``v`` holds possible values in order of time, ``scale`` the
    deviation of each level's details in the whole recording."""
    marks = np.zeros(len(v), bool)
    if len(v) < 4:
        return marks
    least = np.array([limits.floor / 2 ** (j + 1) for j in range(LEVELS)])
    apart = np.abs(details(v)) > np.maximum(least, SIGMAS * scale)[:, None]
    if not apart[0].any():  # what no finest detail bounds is no spike
        return marks
    jumps_at = apart.any(axis=0)
    detail = np.diff(v)  # finest details, doubled
    limit = max(limits.floor, SIGMAS * 2 * scale[0])
    above = v[v > 0]
    rest = v - _approximation(v, float(np.median(above)) if len(above) else 0.0)
    side = np.where(rest > limit, 1, 0)
    if limits.down:
        side = np.where(rest < -limit, -1, side)
    edges = np.flatnonzero(np.diff(side)) + 1
    starts, ends = np.r_[0, edges], np.r_[edges, len(v)]
    for a, b in zip(starts, ends, strict=True):
        s = side[a]
        if not s or b - a > 2 * SPIKE_READINGS or not jumps_at[a : b + 1].any():
            continue
        jumps = ([s * detail[a - 1]] if a > 0 else []) + ([-s * detail[b - 1]] if b < len(v) else [])
        least = min(jumps, default=0.0)
        share = least / np.abs(rest[a:b]).max()
        if b - a > SPIKE_READINGS:
            spike = len(jumps) == 2 and share >= SHARE and least > max(limit, limits.sure)
        else:
            spike = least > limit and (least > limits.sure or (len(jumps) == 2 and share >= STEEP))
        if spike:
            marks[a:b] = True
    return marks


def _stuck(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Marks of stretches of zero detail: one value above 0 over enough readings and seconds."""
    marks = np.zeros(len(v), bool)
    if len(v) < STUCK_READINGS:
        return marks
    edges = np.flatnonzero(np.diff(v)) + 1
    starts, ends = np.r_[0, edges], np.r_[edges, len(v)]
    for i in np.flatnonzero((ends - starts >= STUCK_READINGS) & (v[starts] > 0)):
        a, b = starts[i], ends[i]
        if t[b - 1] - t[a] >= STUCK_S:
            marks[a:b] = True
    return marks


def _distinct(t: np.ndarray, v: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Marks of the readings that do not repeat time and value of the one before."""
    return np.r_[True, (np.diff(v[there]) != 0) | (np.diff(t[there]) != 0)]


def scales_of(t: np.ndarray, v: np.ndarray, limits: Limits) -> tuple[int, np.ndarray]:
    """``scales`` of a field's possible readings, in order of time, repeated rows once."""
    there = np.flatnonzero((v >= limits.lowest) & (v <= limits.highest))
    return scales(v[there[_distinct(t, v, there)]]) if len(there) else (0, np.zeros(LEVELS))


def bad_readings(t: np.ndarray, v: np.ndarray, limits: Limits, scale: np.ndarray | None = None) -> np.ndarray:
    """0 (good), 1 (impossible), 2 (spike) or 3 (stuck) of every reading, in order of time.

    ``scale`` is that of the whole recording, by default of these readings. NaN is no reading and is never bad. Rows that repeat time and value count once in judging and
    share the verdict. A stretch may be interrupted by impossible values and spikes.
    """
    out = np.zeros(len(v), np.int8)
    there = np.flatnonzero(~np.isnan(v))
    if not len(there):
        return out
    x = v[there]
    wrong = (x < limits.lowest) | (x > limits.highest)
    out[there[wrong]] = 1
    there = there[~wrong]
    if not len(there):
        return out
    new = _distinct(t, v, there)
    of = np.cumsum(new) - 1
    at = there[new]
    spikes = _spikes(v[at], limits, scales(v[at])[1] if scale is None else scale)
    kept = at[~spikes]
    stuck = np.zeros(len(at), bool)
    stuck[~spikes] = _stuck(t[kept], v[kept])
    verdict = np.where(spikes, 2, np.where(stuck, 3, 0)).astype(np.int8)
    out[there] = verdict[of]
    return out


SCHEMA = "record_id long, field_name string, value double, reason string"
REASONS = np.array(["", "impossible", "spike", "stuck"], object)


def implausible_readings(records: DataFrame, limits: dict[str, Limits] | None = None) -> DataFrame:
    """(record_id, field_name, value, reason) of every bad reading of the given fields.

    A recording is a device's rows of one activity_id. Null fields are no readings; rows without a
    time or a recording can be judged by bounds alone and are; repeated rows each come out; rows of
    equal time are taken in order of record_id; an empty table gives no rows.
    """
    limits = limits or LIMITS
    fields = list(limits)
    seconds = F.unix_micros("timestamp") / 1e6
    block = lambda s: F.floor(s / BLOCK_S).cast("long")
    rows = records.select(
        "record_id", F.coalesce("activity_id", F.lit("")).alias("source"), F.coalesce("serial_number", F.lit("")).alias("device"),
        seconds.alias("t"), *[F.col(f).cast("double") for f in fields],
    )
    timeless = F.col("t").isNull() | (F.col("source") == "")
    bare = rows.where(timeless)
    bounds = [
        F.when((F.col(f) < x.lowest) | (F.col(f) > x.highest), F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")))
        for f, x in limits.items()
    ]
    bare = bare.select("record_id", F.explode(F.array_compact(F.array(*bounds))).alias("x")).select(
        "record_id", "x.field_name", "x.value", F.lit("impossible").alias("reason")
    )
    seen = F.array_distinct(F.array(block(F.col("t")), block(F.col("t") - MARGIN_S), block(F.col("t") + MARGIN_S)))
    held = rows.where(~timeless & F.coalesce(*[F.col(f) for f in fields]).isNotNull())
    none = F.lit(None)
    keys = ["source", "device", "block"]
    measured = (
        held.select("source", "device", block(F.col("t")).alias("block"), "t", "record_id", *fields)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "t", "record_id")
        .mapInPandas(_measure(fields, limits), "source string, device string, block long, " + ", ".join(f"n_{f} long, s_{f} array<double>" for f in fields))
    )
    measured = cut_lineage(measured, "details")  # one row per block: read for the recordings and for the blocks
    # a recording of one block has its own deviation, a longer one the median of its blocks', by readings
    middle = lambda f, j: F.percentile(F.get(f"s_{f}", F.lit(j)), 0.5, F.greatest(F.col(f"n_{f}"), F.lit(1)))
    whole = measured.groupBy("source", "device").agg(*[F.array(*[middle(f, j) for j in range(LEVELS)]).alias(f"w_{f}") for f in fields])
    spread = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")  # margins reach into neighbours
    heads = measured.select("source", "device", spread).distinct().join(whole, ["source", "device"])
    heads = heads.select(*keys, F.lit(0).cast("long").alias("record_id"), none.cast("double").alias("t"), *[none.cast("double").alias(f) for f in fields], *[f"w_{f}" for f in fields])
    cut = held.select("source", "device", F.explode(seen).alias("block"), "record_id", "t", *fields, *[none.cast("array<double>").alias(f"w_{f}") for f in fields])

    def judge(group: pd.DataFrame) -> Iterator[tuple]:
        head, group = group.iloc[0], group.iloc[1:]  # the recording's scales come before its readings
        t, ids = group["t"].to_numpy(), group["record_id"].to_numpy()
        own = np.floor(t / BLOCK_S) == head["block"]
        if not own.any():
            return
        for f in fields:
            v = group[f].to_numpy()
            verdict = np.where(own, bad_readings(t, v, limits[f], np.asarray(head[f"w_{f}"])), 0)
            at = np.flatnonzero(verdict)
            if len(at):
                yield ids[at], np.full(len(at), f, object), v[at], REASONS[verdict[at]]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, groups in _whole_groups(batches):
            found = [x for a, b in groups for x in judge(pdf.iloc[a:b])]
            if found:
                yield pd.DataFrame(dict(zip(("record_id", "field_name", "value", "reason"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    walked = (
        cut.unionByName(heads)
        .repartition(*keys)
        .sortWithinPartitions(*keys, F.asc_nulls_first("t"), "record_id")
        .mapInPandas(walk, SCHEMA)
    )
    return walked.unionByName(bare)


def _measure(fields: list[str], limits: dict[str, Limits]):
    """One row per block: readings and deviations of each field's details."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, groups in _whole_groups(batches):
            rows = []
            for a, b in groups:
                t = pdf["t"].to_numpy()[a:b]
                own = [scales_of(t, pdf[f].to_numpy()[a:b], limits[f]) for f in fields]
                rows.append((*[pdf[c].iloc[a] for c in ("source", "device", "block")], *[x for n, s in own for x in (n, s.tolist())]))
            if rows:
                yield pd.DataFrame(rows, columns=["source", "device", "block", *[c for f in fields for c in (f"n_{f}", f"s_{f}")]])

    return walk


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Sorted batches, cut where groups end."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        groups = _groups(pdf)
        if len(groups) > 1:
            yield pdf, groups[:-1]
        held = pdf.iloc[groups[-1][0] :] if groups else pdf
    if held is not None and len(held):
        yield held, _groups(held)


def _groups(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """Ranges of rows of one source, device and block."""
    if not len(pdf):
        return []
    change = np.zeros(len(pdf) - 1, bool)
    for c in ("source", "device", "block"):
        x = pdf[c].to_numpy()
        change |= x[1:] != x[:-1]
    at = np.flatnonzero(change) + 1
    return list(zip(np.r_[0, at].tolist(), np.r_[at, len(pdf)].tolist(), strict=True))
