from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wattloom.operators import grid

T0 = datetime(2024, 3, 30, 23, 59, 51)
SCHEMA = "activity_id string, timestamp timestamp, power int, heart_rate int, source_id string, block long, value double"


def frame(spark, rows):
    return spark.createDataFrame([(a, None if t is None else T0 + timedelta(seconds=t), p, h, "x", 1, 2.0) for a, t, p, h in rows], SCHEMA)


def series(spark, rows, **kw):
    return grid.regular_grid(frame(spark, rows), source="activity_id", ts="timestamp", fields=["power", "heart_rate"], **kw)


def brute(rows):
    base = int(T0.timestamp())
    out = set()
    for a in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == a and r[1] is not None]
        if not mine:
            continue
        period = lambda t: (base + t) // 10 * 10
        for i, f in ((2, "power"), (3, "heart_rate")):
            have = {period(r[1]) for r in mine if r[i] is not None}
            if have:
                lo, hi = min(period(r[1]) for r in mine), max(period(r[1]) for r in mine)
                out |= {(a, f, p) for p in range(lo, hi + 1, 10) if p not in have}
    return out


rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 30_000)), st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.just(140))),
    max_size=25,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_strategy)
def test_missing_periods_match_brute_force(spark, rows):
    got = {tuple(r) for r in grid.missing_periods(series(spark, rows)).collect()}
    assert got == brute(rows)


def test_values_and_marks(spark):
    rows = [("a", 0, 100, None), ("a", 0, 200, None), ("a", 40, 350, None), ("a", 400, 10, 90), ("a", 420, None, None)]
    got = {r.period_start % 100_000: (r.value, r.mark) for r in series(spark, rows).where("field_name = 'power'").collect()}
    values = list(dict(sorted(got.items())).values())
    assert values[0] == (150.0, "measured") and values[2][1] == "interpolated" and values[2][0] == 250.0
    assert values[5] == (None, "missing") and values[-1] == (None, "missing")
    hr = series(spark, rows).where("field_name = 'heart_rate' and mark = 'missing'").count()
    assert hr == len([p for _, f, p in brute(rows) if f == "heart_rate"])


def test_empty_and_all_null(spark):
    assert series(spark, []).count() == 0
    assert series(spark, [("a", 5, None, None), (None, 5, 1, 1), ("a", None, 1, 1)]).count() == 0


def test_gap_over_many_blocks(spark):
    rows = [("a", 0, 1, None), ("a", 40_000, 1, None), ("a", 90_000, None, None)]
    assert {tuple(r) for r in grid.missing_periods(series(spark, rows)).collect()} == brute(rows)
