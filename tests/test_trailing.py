import random
from datetime import date, timedelta

from wattloom.operators import trailing

SCHEMA = "athlete_id string, day date, load long, seconds long, n int, rides int"


def test_queue_of_two_stacks():
    rng = random.Random(5)
    for combine, unit in ((lambda a, b: a + b, ""), (max, -1)):
        q, plain = trailing.MonoidQueue(combine, unit), []
        for _ in range(400):
            if plain and rng.random() < 0.45:
                q.pop(), plain.pop(0)
            else:
                x = rng.choice("abc") if unit == "" else rng.randrange(50)
                q.push(x), plain.append(x)
            assert len(q) == len(plain) and q.total() == ("".join(plain) if unit == "" else max(plain, default=-1))


def test_against_brute_force(spark):
    rng = random.Random(3)
    d0 = date(2024, 2, 20)
    rows = [(a, d0 + timedelta(days=rng.randrange(120)), rng.choice([None, 0, 5, 80]), rng.choice([None, 0, 3600]), 1, 1) for a in ("a", "b") for _ in range(25)]
    rows += [("c", d0, None, None, 1, 1), (None, d0, 5, 5, 1, 1), ("a", None, 9, 9, 1, 1), rows[0]]
    daily = trailing.trailing_totals(spark.createDataFrame(rows, SCHEMA))
    got = {(r.athlete_id, r.day): r for r in daily.collect()}
    expected = set()
    for a in ("a", "b", "c"):
        mine = [r for r in rows if r[0] == a and r[1] is not None]
        lo, hi = min(r[1] for r in mine), max(r[1] for r in mine)
        days = [lo + timedelta(days=i) for i in range((hi - lo).days + 1)]
        tops = {}
        for w in (7, 30):
            for d in days:
                window = [r for r in mine if d - timedelta(days=w) < r[1] <= d]
                r = got[a, d]
                assert r[f"load_{w}"] == sum(x[2] or 0 for x in window) and r[f"seconds_{w}"] == sum(x[3] or 0 for x in window)
                assert r[f"rides_{w}"] == len(window) and r[f"longest_{w}"] == max((x[3] or 0 for x in window), default=0)
                assert abs(r[f"mean_load_{w}"] - r[f"load_{w}"] / min(w, (d - lo).days + 1)) < 1e-9
                tops[w, d] = r[f"load_{w}"]
            top = max(v for (k, _), v in tops.items() if k == w)
            expected |= {(a, d, f"peak_load_{w}") for d in days if tops[w, d] == top and top}
            expected |= {(a, d, f"idle_{w}") for d in days if got[a, d][f"seconds_{w}"] == 0}
    assert {tuple(r) for r in trailing.peaks_and_rests(daily).collect()} == expected
    assert len(got) == sum(1 for _ in got)


def test_empty(spark):
    daily = trailing.trailing_totals(spark.createDataFrame([], SCHEMA))
    assert daily.count() == 0 and trailing.peaks_and_rests(daily).count() == 0
