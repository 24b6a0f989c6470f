from datetime import datetime, timedelta

import numpy as np

from wattloom.operators import spikes
from wattloom.operators.spikes import LIMITS, bad_readings, implausible_readings

T0 = datetime(2024, 1, 1, 5, 50)
SCHEMA = "record_id long, activity_id string, serial_number string, timestamp timestamp, power int, heart_rate int, cadence int, t double, block long"


def judge(values, field="power", step=1.0, times=None):
    t = np.arange(len(values)) * step if times is None else np.array(times, float)
    return bad_readings(t, np.array([np.nan if v is None else v for v in values], float), LIMITS[field]).tolist()


def noisy(n, level=180, seed=1):
    return (level + np.random.default_rng(seed).integers(-12, 13, n)).tolist()


def test_impossible_and_spikes():
    v = noisy(60)
    v[10], v[20], v[21], v[40] = -1, 900, 1100, 65535
    got = judge(v)
    assert got[10] == 1 and got[20] == got[21] == 2 and got[40] == 1 and sum(x > 0 for x in got) == 4


def test_efforts_and_coasting_are_real():
    v = noisy(80)
    v[20:31] = [330, 480, 630, 640, 635, 650, 640, 630, 480, 330, 250]
    v[50:56] = [0] * 6
    assert not any(judge(v))
    assert not any(judge([0] * 30 + [170, 180, 175, 160] + [0] * 30))


def test_spike_within_coasting_and_touching_spikes():
    v = noisy(40) + [0] * 20 + noisy(40, seed=2)
    v[50] = 800
    v[10:14] = [700, 900, 650, 1000]
    got = judge(v)
    assert [i for i, x in enumerate(got) if x] == [10, 11, 12, 13, 50]


def test_spikes_at_the_ends():
    v = noisy(40)
    v[0], v[1], v[39] = 1100, 1000, 900
    assert [i for i, x in enumerate(judge(v)) if x] == [0, 1, 39]


def test_heart_rate_both_ways():
    v = noisy(50, 150)
    v = [150 + (x % 3) for x in v]
    v[9], v[30], v[31], v[45] = 88, 215, 230, 0
    assert [i for i, x in enumerate(judge(v, "heart_rate")) if x] == [9, 30, 31, 45]


def test_stuck_needs_readings_and_seconds():
    base = [150 + i % 4 for i in range(30)]
    assert judge([*base, *[160] * 90, *base], "heart_rate")[30:120] == [3] * 90
    assert not any(judge([*base, *[160] * 60, *base], "heart_rate"))
    few = judge([*base, *[160] * 9, *base], "heart_rate", step=10)
    assert not any(few)
    assert not any(judge([0] * 300, "cadence"))
    mixed = [*base, *[160] * 50, None, 254, *[160] * 50, *base]
    got = judge(mixed, "heart_rate")
    assert got[30:80] == [3] * 50 and got[80] == 0 and got[81] == 1 and got[82:132] == [3] * 50


def test_repeated_rows_share_the_verdict():
    v = noisy(40)
    t = list(range(40))
    v[20] = 950
    v.insert(20, 950), t.insert(20, 20)
    got = judge(v, times=t)
    assert got[20] == got[21] == 2 and sum(x > 0 for x in got) == 2


def test_short_and_empty_series():
    assert judge([]) == [] and judge([None, None]) == [0, 0] and judge([5]) == [0] and judge([100, 110, 105]) == [0, 0, 0]


def frame(spark, rows):
    return spark.createDataFrame([(i, a, s, None if t is None else T0 + timedelta(seconds=t), p, h, c, 1.0, 2) for i, (a, s, t, p, h, c) in enumerate(rows)], SCHEMA)


def test_over_blocks_like_in_one_piece(spark):
    n = 3000  # over the edge of a block
    p = noisy(n)
    for i in (5, 595, 600, 601, 1500, 2998):
        p[i] = 1000 + i % 7
    h = [150 + i % 5 for i in range(n)]
    h[500:700] = [140] * 200
    rows = [("a", "d", i, p[i], h[i], None) for i in range(n)]
    got = {(r.record_id, r.field_name) for r in implausible_readings(frame(spark, rows)).collect()}
    t = np.arange(n, dtype=float)
    whole = {(int(i), f) for f, v in (("power", p), ("heart_rate", h)) for i in np.flatnonzero(bad_readings(t, np.array(v, float), LIMITS[f]))}
    assert got == whole and (600, "heart_rate") in got


def test_nulls_and_empty(spark):
    rows = [(None, None, 5, -1, 100, 90), ("a", None, None, 3000, None, 300), ("a", "d", 1, None, None, None)]
    got = {(r.record_id, r.field_name, r.reason) for r in implausible_readings(frame(spark, rows)).collect()}
    assert got == {(0, "power", "impossible"), (1, "power", "impossible"), (1, "cadence", "impossible")}
    assert implausible_readings(frame(spark, [])).count() == 0


def test_details_and_the_last_approximation_add_up():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 400, 100).astype(float)
    d = spikes.details(v)
    assert d.shape == (spikes.LEVELS, 100)
    means = [np.r_[np.full(16, v[0]), v][i + 1 : i + 17].mean() for i in range(100)]
    assert np.allclose(v - d.sum(axis=0), means)
    assert np.allclose(d[0][1:], np.diff(v) / 2) and not spikes.details(np.full(50, 7.0)).any()
    assert spikes.details(v[:3]).shape == (spikes.LEVELS, 3) and spikes.details(v[:0]).shape == (spikes.LEVELS, 0)


def test_scales_are_those_of_the_whole_recording(spark):
    """A restless recording of three blocks: what stands out in its calm block does not in the whole."""
    block = spikes.BLOCK_S
    rows = [("a", "d", b * block + i * 5, int(300 + (60 * (-1) ** i if b else 0) + i % 3), None, None) for b in range(3) for i in range(400)]
    rows[200] = (*rows[200][:3], 300 + 270, None, None)
    calm = [(("b", *r[1:])) for r in rows[:400]]
    got = {(r.record_id, r.reason) for r in implausible_readings(frame(spark, rows + calm)).where("field_name = 'power'").collect()}
    assert (1200 + 200, "spike") in got and (200, "spike") not in got
