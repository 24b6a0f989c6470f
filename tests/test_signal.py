"""Features of whole recordings: the same over chunks as over the series, by heart rate where it belongs."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from wattloom.operators import signal

REC = "activity_id string, record_id long, timestamp timestamp, power int, heart_rate int"
T0 = datetime(2024, 1, 1)


def recording(spark, power, heart, key="a"):
    rows = [(key, i, T0 + timedelta(seconds=i), p, h) for i, (p, h) in enumerate(zip(power, heart, strict=True))]
    return spark.createDataFrame(rows, REC)


def series(n, seed=3):
    rng = np.random.default_rng(seed)
    power = (200 + 40 * np.sin(np.arange(n) / 7) + rng.normal(0, 30, n)).astype(int)
    heart = (130 + np.cumsum(rng.integers(-1, 2, n)) // 2 + power // 40).astype(int)
    return power.tolist(), heart.tolist()


def brute_entropy(x, m=2):
    x = np.asarray(x, float)
    r = 0.2 * x.std()

    def phi(m):
        v = np.lib.stride_tricks.sliding_window_view(x, m)
        n = len(v)
        return ((np.abs(v[:, None] - v[None]).max(axis=2) <= r).sum() - n) / n / (n - 1)

    return -math.log(phi(m + 1) / phi(m))


def brute_dfa(x):
    y = np.cumsum(np.asarray(x, float) - np.mean(x))
    sizes = [s for s in np.logspace(0.5, np.log10(len(y) / 4), 10).astype(int) if s >= 4]
    f = []
    for s in sizes:
        t = np.arange(s)
        f.append(np.sqrt(np.mean([np.mean((b - np.polyval(np.polyfit(t, b, 1), t)) ** 2) for b in y[: len(y) // s * s].reshape(-1, s)])))
    return np.polyfit(np.log(sizes), np.log(f), 1)[0]


def brute_coherence(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.hanning(257)[:-1]
    at = range(0, len(x) - 255, 128)
    fx, fy = ([np.fft.rfft((v[i : i + 256] - v[i : i + 256].mean()) * w) for i in at] for v in (x, y))
    fx, fy = np.array(list(fx)), np.array(list(fy))
    return (abs((fx * fy.conj()).mean(0)) ** 2 / (abs(fx) ** 2).mean(0) / (abs(fy) ** 2).mean(0)).mean()


def brute_period(x):
    y = np.asarray(x, float) - np.mean(x)
    return float(np.argmin([y[k:] @ y[: len(y) - k] for k in range(60)]))


# the last: chunks of 512 readings, the last of them shorter than what the chunk before it sees of it
@pytest.mark.parametrize("n", [400, 1100, 2100, 2060])
def test_chunks_give_the_feature_of_the_whole_series(spark, monkeypatch, n):
    monkeypatch.setattr(signal, "CHUNK", 512)
    power, heart = series(n)
    df = recording(spark, power, heart)
    e, d = signal.entropy(df).first(), signal.dfa(df).first()
    assert e.sample_entropy == pytest.approx(brute_entropy(heart)) and e.power_sample_entropy == pytest.approx(brute_entropy(power))
    assert d.alpha == pytest.approx(brute_dfa(heart), rel=1e-6) and d.power_alpha == pytest.approx(brute_dfa(power), rel=1e-6)
    assert signal.coherence(df).first().coherence == pytest.approx(brute_coherence(power, heart))
    assert signal.autocorr(df).first().period_s == brute_period(power)


def test_heart_rate_without_power_has_complexity(spark):
    _, heart = series(300)
    df = recording(spark, [None] * 300, heart)
    assert signal.entropy(df).first().sample_entropy == pytest.approx(brute_entropy(heart)) and signal.entropy(df).first().power_sample_entropy is None
    assert signal.dfa(df).first().alpha == pytest.approx(brute_dfa(heart), rel=1e-6)
    assert signal.dfa(recording(spark, [None] * 12, heart[:12])).first().alpha == 0.0 and signal.dfa(recording(spark, [None] * 10, heart[:10])).count() == 0


def test_pairs_by_table_equal_pairs_one_by_one():
    rng = np.random.default_rng(5)
    for x in (rng.integers(100, 112, 900), np.round(rng.normal(0, 1, 900), 1), rng.normal(0, 1, 200), np.arange(900) % 9):
        assert signal.sample_entropy(x) == pytest.approx(brute_entropy(x))


def test_a_short_tail_joins_the_segment_before(spark, monkeypatch):
    power, heart = series(2053)
    whole = signal.spectral(recording(spark, power, heart)).first()
    f, h = signal.dominant_frequency(np.asarray(power, float))
    assert (whole.dominant_frequency, whole.spectral_entropy) == (pytest.approx(f), pytest.approx(h))
    monkeypatch.setattr(signal, "SEGMENT", 2048)
    assert signal.spectral(recording(spark, power, heart)).first().spectral_entropy == pytest.approx(h)


def test_one_window_of_coherence_says_nothing():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 383))
    assert signal.mean_coherence(x, y) == pytest.approx(1.0) and signal.mean_coherence(np.tile(x, 9), np.tile(y, 9)) < 0.6
