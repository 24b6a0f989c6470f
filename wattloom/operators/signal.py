"""Signal features of recordings that built-in expressions cannot give: spectra, coherence, entropy,
fluctuation. Each is the feature of the whole series: recordings are cut into chunks of bounded length
that give sums (lag products, cross spectra, box moments, counts of runs), and the sums of a recording
are merged. Only the spectrum is taken from segments where a recording exceeds ``SEGMENT`` readings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators.records import KEY, ordered

#: Readings of one spectrum: a longer recording has the mean over its segments, a short tail joined to
#: the segment before it.
SEGMENT = 1 << 20
#: Readings of a chunk, a multiple of half a window of coherence and longer than a window.
CHUNK = 1 << 16
LAGS, WINDOW = 60, 256


def dominant_frequency(x: np.ndarray) -> tuple[float, float]:
    """(frequency of the largest power, spectral entropy) of a series of one reading a second, from the
    one-sided periodogram."""
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    power[1 : (len(x) + 1) // 2] *= 2
    if len(power) < 2 or power.sum() <= 0:
        return 0.0, 0.0
    p = power / power.sum()
    return float(np.fft.rfftfreq(len(x))[int(np.argmax(power))]), float(-(p * np.log(p + 1e-10)).sum())


def _lag_sums(n: int, start: int, own: int, x: np.ndarray, lags: int = LAGS) -> np.ndarray:
    """For each lag, sums over pairs whose first reading is one of the ``own``: products, firsts, seconds."""
    out = np.zeros((lags, 3))
    for k in range(min(lags, n - 1)):
        m = max(0, min(own, len(x) - k))
        out[k] = x[:m] @ x[k : k + m], x[:m].sum(), x[k : k + m].sum()
    return out.ravel()


def _lag_merge(n: int, parts: list[np.ndarray]) -> tuple[float]:
    s, a, b = np.sum(parts, axis=0).reshape(-1, 3)[: n - 1].T
    mu = a[0] / n
    r = s - mu * (a + b) + (n - np.arange(len(s))) * mu * mu
    if len(r) < 2 or r[0] <= 1e-12 * s[0]:
        return (0.0,)
    return (float(np.argmin(r[1:]) + 1),)


def autocorrelation_period(x: np.ndarray, lags: int = LAGS) -> float:
    """The lag from 1 below ``lags`` at which the normalised autocorrelation is least."""
    return _lag_merge(len(x), [_lag_sums(len(x), 0, len(x), x, lags)])[0]


def _cross_sums(n: int, start: int, own: int, x: np.ndarray, y: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sums of cross and own spectra over the windows that begin in the ``own`` readings."""
    window = min(window, n)
    step, taper = max(1, window - window // 2), np.hanning(window + 1)[:-1]

    def spectra(v: np.ndarray) -> np.ndarray:
        if len(v) < window:
            return np.zeros((0, window // 2 + 1), complex)
        cut = np.lib.stride_tricks.sliding_window_view(v, window)[: own : step]
        return np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * taper, axis=1)

    fx, fy = spectra(x), spectra(y)
    cross = (fx * fy.conj()).sum(0)
    return np.concatenate([cross.real, cross.imag, (abs(fx) ** 2).sum(0), (abs(fy) ** 2).sum(0)])


def _cross_merge(n: int, parts: list[np.ndarray]) -> tuple[float]:
    re, im, px, py = np.sum(parts, axis=0).reshape(4, -1)
    good = px * py > 0
    return (float(((re[good] ** 2 + im[good] ** 2) / (px[good] * py[good])).mean()) if good.any() else 0.0,)


def mean_coherence(x: np.ndarray, y: np.ndarray, window: int = WINDOW) -> float:
    """Mean squared coherence of two series from half-overlapping Hann windows; 1 where there is room
    for one window only."""
    n = min(len(x), len(y))
    return _cross_merge(n, [_cross_sums(n, 0, n, x[:n], y[:n], window)])[0]


def _close_pairs(runs: np.ndarray, counts: np.ndarray, r: float) -> float:
    """Ordered pairs of runs, each with itself too, whose readings differ by at most ``r`` throughout.
    ``runs`` are distinct and come ``counts`` times."""
    values = np.unique(runs)
    k = len(values)
    if len(runs) ** 2 <= k**3:
        at = np.argsort(runs[:, 0], kind="stable")
        runs, counts, hits = runs[at], counts[at], 0.0
        for i in range(0, len(runs), 256):
            block = runs[i : i + 256]
            lo, hi = np.searchsorted(runs[:, 0], (block[0, 0] - r - 1e-6, block[-1, 0] + r + 1e-6))
            near = np.ones((len(block), hi - lo), bool)
            for j in range(runs.shape[1]):
                near &= np.abs(block[:, j, None] - runs[None, lo:hi, j]) <= r
            hits += float(counts[i : i + 256] @ (near @ counts[lo:hi]))
        return hits
    # a table of the last two readings over the runs whose first is near, moved along the first
    if (values == np.round(values)).all():
        r = np.floor(r)
    lo, hi = np.searchsorted(values, values - r, "left"), np.searchsorted(values, values + r, "right")
    ranks = np.searchsorted(values, runs)
    a, b = ranks[:, 0], ranks[:, 1]
    c = ranks[:, 2] if runs.shape[1] > 2 else np.zeros(len(runs), int)
    clo, chi, wide = (lo, hi, k) if runs.shape[1] > 2 else (np.zeros(k, int), np.ones(k, int), 1)
    at = np.argsort(a, kind="stable")
    a, b, c, counts = a[at], b[at], c[at], counts[at]
    edge = np.searchsorted(a, np.arange(k + 1))
    table, hits, left, right = np.zeros((k, wide)), 0.0, 0, 0
    for v in range(k):
        i, j = edge[v], edge[v + 1]
        if i == j:
            continue
        new, old = slice(edge[right], edge[hi[v]]), slice(edge[left], edge[lo[v]])
        np.add.at(table, (b[new], c[new]), counts[new])
        np.subtract.at(table, (b[old], c[old]), counts[old])
        left, right = lo[v], hi[v]
        sums = np.zeros((k + 1, wide + 1))
        sums[1:, 1:] = table.cumsum(0).cumsum(1)
        b0, b1, c0, c1 = lo[b[i:j]], hi[b[i:j]], clo[c[i:j]], chi[c[i:j]]
        hits += float(counts[i:j] @ (sums[b1, c1] - sums[b0, c1] - sums[b1, c0] + sums[b0, c0]))
    return hits


def _entropy_of_runs(runs: np.ndarray, counts: np.ndarray, share: float = 0.2) -> float:
    """Sample entropy (m = 2) from the counts of runs of three readings, each reading with the two before
    it; these are nan for the first and the second reading."""
    n = counts.sum()
    x = runs[:, 2]
    r = share * np.sqrt(counts @ (x - counts @ x / n) ** 2 / n)

    def matches(m: int) -> float:
        whole = ~np.isnan(runs[:, 3 - m])
        total = counts[whole].sum()
        if total < 2:
            return 0.0
        kinds, at = np.unique(runs[whole, 3 - m :], axis=0, return_inverse=True)
        each = np.bincount(at.ravel(), counts[whole])
        return (_close_pairs(kinds, each, r) - total) / total / (total - 1)

    a, b = matches(2), matches(3)
    return float(-np.log(b / a)) if a > 0 and b > 0 else 0.0


def sample_entropy(x: np.ndarray, share: float = 0.2) -> float:
    """-ln of the ratio of matching runs of three and two readings within ``share`` deviations; 0 where
    either has none."""
    x = np.asarray(x, float)
    runs = np.column_stack([np.r_[[np.nan] * k, x[: len(x) - k]] for k in (2, 1, 0)])
    return _entropy_of_runs(runs, np.ones(len(x)), share)


def box_sizes(n: int, scales: int = 10) -> np.ndarray:
    """Sizes of boxes of a series of n readings, some of them more than once."""
    sizes = np.logspace(0.5, np.log10(n / 4), scales).astype(int)
    return sizes[sizes >= 4]


def _moments(t: np.ndarray, y: np.ndarray) -> list[float]:
    if not len(t):
        return [0.0] * 6
    dt, dy = t - t.mean(), y - y.mean()
    return [float(len(t)), t.mean(), y.mean(), dt @ dt, dt @ dy, dy @ dy]


def _box_sums(n: int, start: int, own: int, x: np.ndarray) -> np.ndarray:
    """Of a chunk: sum, sum of squares and, for each size, the squares about the lines of the boxes that
    lie whole in the chunk, and the moments of the boxes cut by its ends."""
    walk = np.cumsum(x[:own])
    out = [walk[-1], float(x[:own] @ x[:own])]
    at = np.arange(start, start + own, dtype=float)
    for s in box_sizes(n):
        head = min(own, -start % s)
        boxes = (own - head) // s
        end = head + boxes * s
        y = walk[head:end].reshape(boxes, s)
        t = np.arange(s) - (s - 1) / 2
        y = y - y.mean(axis=1, keepdims=True)
        rest = y - ((y @ t) / (t @ t))[:, None] * t
        out.append(float((rest**2).sum()))
        for i, j in ((0, head), (end, own)):
            out += [float((start + i) // s), *_moments(at[i:j], walk[i:j])]
    return np.array(out)


def _box_merge(n: int, parts: list[np.ndarray]) -> tuple[float]:
    sizes = box_sizes(n) if n >= 16 else np.zeros(0, int)
    total, squares = sum(p[0] for p in parts), sum(p[1] for p in parts)
    if len(sizes) < 2 or squares - total * total / n <= 1e-12 * squares:
        return (0.0,)
    points = []
    for k, s in enumerate(sizes):
        rest, cut, before = 0.0, {}, 0.0
        for p in parts:
            v = p[2 + 15 * k : 17 + 15 * k]
            rest += v[0]
            for box, m, t, y, tt, ty, yy in v[1:].reshape(2, 7):
                if m and box < n // s:
                    y += before
                    if box in cut:
                        m0, t0, y0, tt0, ty0, yy0 = cut[box]
                        w, dt, dy = m0 * m / (m0 + m), t - t0, y - y0
                        cut[box] = m0 + m, t0 + dt * m / (m0 + m), y0 + dy * m / (m0 + m), tt0 + tt + w * dt * dt, ty0 + ty + w * dt * dy, yy0 + yy + w * dy * dy
                    else:
                        cut[box] = m, t, y, tt, ty, yy
            before += p[0]
        rest += sum(max(0.0, yy - ty * ty / tt) for _, _, _, tt, ty, yy in cut.values())
        if rest > 0:
            points.append((np.log(s), np.log(rest / (n // s * s)) / 2))
    a = np.array(points)
    return (float(np.polyfit(a[:, 0], a[:, 1], 1)[0]) if len(points) > 1 and np.ptp(a[:, 0]) > 0 else 0.0,)


def fluctuation_slope(x: np.ndarray) -> float:
    """Detrended fluctuation analysis: slope of log fluctuation on log box size; 0 below 16 readings."""
    x = np.asarray(x, float)
    return _box_merge(len(x), [_box_sums(len(x), 0, len(x), x)])[0]


def _known(records: DataFrame, fields: list[str], least: int) -> DataFrame:
    """Readings that have all the fields, of recordings with more than ``least`` of them."""
    return ordered(records, fields, " and ".join(f"{f} is not null" for f in fields)).where(F.col("n") > least)


def _merged(records: DataFrame, fields: list[str], name: str, least: int, spill: int, part: Callable, merge: Callable) -> DataFrame:
    """(activity_id, ``name``): ``part`` of each chunk, which sees ``spill`` readings beyond its own,
    and ``merge`` of a recording's parts in order."""
    size = CHUNK
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - 1 - spill) / size))
    cut = _known(records, fields, least).select(KEY, "pos", "n", *fields, F.explode(F.sequence(first, F.floor((F.col("pos") - 1) / size))).alias("chunk"))
    # a chunk begins with a reading of its own
    cut = cut.where(F.col("chunk") * size < F.col("n"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n, start = int(pdf["n"].iloc[0]), int(key[1]) * size
        sums = part(n, start, min(size, n - start), *[pdf[f].to_numpy(float) for f in fields])
        return pd.DataFrame({KEY: [key[0]], "chunk": [key[1]], "n": [n], "sums": [sums]})

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        value = merge(int(pdf["n"].iloc[0]), [np.asarray(v, float) for v in pdf["sums"]])[0]
        return pd.DataFrame({KEY: [key[0]], name: [value]})

    parts = cut.groupBy(KEY, "chunk").applyInPandas(one, f"{KEY} string, chunk long, n long, sums array<double>")
    return parts.groupBy(KEY).applyInPandas(whole, f"{KEY} string, {name} double")


def spectral(records: DataFrame) -> DataFrame:
    names = ["dominant_frequency", "spectral_entropy"]
    last = F.greatest(F.lit(0), F.floor(F.col("n") / SEGMENT) - 1)
    cut = _known(records, ["power"], 10).withColumn("segment", F.least(F.floor((F.col("pos") - 1) / SEGMENT), last))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")["power"].to_numpy(float)
        return pd.DataFrame([(key[0], float(len(x)), *dominant_frequency(x))], columns=[KEY, "weight", *names])

    parts = cut.select(KEY, "segment", "pos", "power").groupBy(KEY, "segment").applyInPandas(one, f"{KEY} string, weight double, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy(KEY).agg(*[(F.sum(F.col(n) * F.col("weight")) / F.sum("weight")).alias(n) for n in names])


def autocorr(records: DataFrame) -> DataFrame:
    return _merged(records, ["power"], "period_s", 60, LAGS - 1, _lag_sums, _lag_merge)


def coherence(records: DataFrame) -> DataFrame:
    return _merged(records, ["power", "heart_rate"], "coherence", 100, WINDOW // 2, _cross_sums, _cross_merge)


def _entropy(records: DataFrame, field: str, name: str) -> DataFrame:
    """Counts of runs of three readings, then the pairs among the distinct ones."""
    at = F.floor((F.col("pos") - 1) / CHUNK)
    cut = _known(records, [field], 10).select(KEY, "pos", F.col(field).alias("c"), at.alias("own"), F.explode(F.sequence(at, F.floor((F.col("pos") + 1) / CHUNK))).alias("chunk"))
    w = Window.partitionBy(KEY, "chunk").orderBy("pos")
    runs = cut.withColumns({"a": F.lag("c", 2).over(w), "b": F.lag("c", 1).over(w)}).where("own = chunk")
    counts = runs.groupBy(KEY, "a", "b", "c").agg(F.count("*").cast("double").alias("times"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        value = _entropy_of_runs(pdf[["a", "b", "c"]].to_numpy(float), pdf["times"].to_numpy(float))
        return pd.DataFrame({KEY: [key[0]], name: [value]})

    return counts.groupBy(KEY).applyInPandas(one, f"{KEY} string, {name} double")


def entropy(records: DataFrame) -> DataFrame:
    """Of heart rate, and of power beside it."""
    return _entropy(records, "heart_rate", "sample_entropy").join(_entropy(records, "power", "power_sample_entropy"), KEY, "full")


def dfa(records: DataFrame) -> DataFrame:
    """Of heart rate, and of power beside it."""
    heart = _merged(records, ["heart_rate"], "alpha", 10, 0, _box_sums, _box_merge)
    return heart.join(_merged(records, ["power"], "power_alpha", 10, 0, _box_sums, _box_merge), KEY, "full")
