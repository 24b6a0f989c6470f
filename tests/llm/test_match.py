import random

from wattloom.llm import match

SCHEMA = "key long, start_s long, distance double, moving_time double, elapsed double, heart_rate long, power long, climb double, name string, extra string, b_start long"


def ride(k, s, d, t, e, h, p, c, n):
    return (k, s, d, t, e, h, p, c, n, "x", 1)


def pair_of_sources(seed=4, n=120):
    rng = random.Random(seed)
    left, right, truth = [], [], set()
    for k in range(n):
        s, d, t = 1_700_000_000 + rng.randrange(3_000_000), rng.uniform(5e3, 1e5), rng.uniform(900, 15000)
        h, p, c, name = rng.randrange(120, 180), rng.randrange(90, 260), rng.uniform(10, 1500), f"Ride {rng.choice('abcdefgh')}{k}"
        left.append(ride(k, s, d, t, t + 60, h, p, c, name))
        if rng.random() < 0.8:
            lose = lambda x, share=0.1: None if rng.random() < share else x
            off = rng.choice([0, 0, 0, 0, 3600, -3600])
            right.append(ride(1000 + k, s + off + rng.randrange(-60, 60), lose(d * rng.uniform(0.998, 1.002)), lose(t * rng.uniform(0.998, 1.002)), t + 60.5, lose(h + rng.choice([-1, 0, 1])), lose(p), lose(c * rng.uniform(0.95, 1.05)), lose(name.lower())))
            truth.add((k, 1000 + k))
        if rng.random() < 0.2:  # another rider of the group
            right.append(ride(2000 + k, s + rng.randrange(-30, 30), d * 1.035, t * 0.965, t * 1.04, h - 14, p + 40, c, "Group"))
    return left, right, truth


def test_matches(spark):
    left, right, truth = pair_of_sources()
    rows = match.match_rides(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    got = {(r.l_key, r.r_key) for r in rows}
    assert got == truth and all(0.5 <= r.confidence <= 1 for r in rows)


def code(start, size, step):
    """The whole code of a ride as one number, by the definition."""
    import math

    q, p, out = math.floor(start / match.START_STEP), math.floor(size / step), 0
    for j in range(match.SUBSTRINGS):
        x, y = (q + j) // match.SUBSTRINGS, (p + j) // match.SUBSTRINGS
        out = out << 64 | (x ^ x >> 1) << 24 | (y ^ y >> 1)
    return out


def test_close_pairs_are_those_within_the_radius(spark):
    """Exactly the pairs within the Hamming radius, and so every pair within the tolerance."""
    import math

    rng = random.Random(8)
    left, right = [], []
    for k in range(500):
        s, d, t = rng.randrange(10**9), rng.uniform(1e3, 1e5), rng.uniform(1e3, 1e4)
        wide = rng.choice([1, 1, 1, 3])
        left.append(ride(k, s, d if k % 3 else None, t if k % 2 == 0 else None, None, None, None, None, None))
        right.append(ride(k, s + wide * rng.randrange(-300, 301), d * math.exp(wide * rng.uniform(-0.006, 0.006)), t * math.exp(rng.uniform(-0.012, 0.012)), None, None, None, None, None))
    a = match.encode(spark.createDataFrame(left, SCHEMA))
    b = match.encode(spark.createDataFrame(right, SCHEMA)).selectExpr("*", "0 as clock")
    found = {(r.l_key, r.r_key) for r in match.close_pairs(a, b).collect()}
    sizes = ((2, "log_distance"), (3, "log_time"))
    expected = {
        (x[0], y[0]) for x in left for y in right
        if abs(x[1] - y[1]) < 5000 and any(
            x[c] and y[c] and (code(x[1], math.log(x[c]), match.SIZE_STEPS[f]) ^ code(y[1], math.log(y[c]), match.SIZE_STEPS[f])).bit_count() <= match.RADIUS
            for c, f in sizes
        )
    }
    assert found == expected
    near = {x[0] for x, y in zip(left, right) if abs(x[1] - y[1]) <= 300 and x[2] and abs(math.log(x[2] / y[2])) <= 0.006}
    assert {(k, k) for k in near} <= found and len(near) > 200


def test_nulls_ties_and_empty(spark):
    none = ride(1, None, None, None, None, None, None, None, None)
    bare = ride(2, 5000, float("nan"), 0.0, -1.0, None, None, None, " ")
    same = [ride(k, 90_000, 1e4, 2e3, 2e3, 150, 200, 100.0, "Same") for k in (3, 4)]
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = match.match_rides(df([none, bare, *same]), df([none, bare, *same]), least=0.0).collect()
    assert {(r.l_key, r.r_key) for r in rows} == {(3, 3)} or {(r.l_key, r.r_key) for r in rows} >= {(3, 3)}
    assert len({r.l_key for r in rows}) == len(rows) == len({r.r_key for r in rows})
    assert match.match_rides(df([]), df(same)).count() == 0 and match.match_rides(df([]), df([])).count() == 0


def test_a_group_of_copies_forms_no_pairs(spark):
    many = [ride(k, 90_000, 1e4, 2e3, 2e3, 150, 200, 100.0, "Same") for k in range(2000)]
    other = [ride(5000, 500_000, 2e4, 4e3, 4e3, 140, 180, 50.0, "Other")]
    df = spark.createDataFrame([*many, *other], SCHEMA)
    assert match.one_of_copies(match.encode(df)).count() == 2
    assert {(r.l_key, r.r_key) for r in match.match_rides(df, df).collect()} == {(0, 0), (5000, 5000)}


def test_confidence_tells_how_many_are_right(spark):
    """Rides known to one source only, beside riders who start nearby by chance."""
    rng = random.Random(21)
    left, right = [], []
    start = lambda: 1_700_000_000 + 86400 * rng.randrange(20) + rng.randrange(3000)
    for k in range(4000):
        s, d, t = start(), rng.uniform(2e4, 3e4), rng.uniform(3000, 4500)
        h, p = rng.randrange(120, 180), rng.randrange(90, 260)
        left.append(ride(k, s, d, t, t, h, p, None, None))
        if k % 2 == 0:
            right.append(ride(k, s + rng.randrange(-200, 200), d * rng.uniform(0.997, 1.003), t * rng.uniform(0.994, 1.006), None, h + rng.randrange(-2, 3), None, None, None))
        else:
            right.append(ride(k, start(), rng.uniform(2e4, 3e4), rng.uniform(3000, 4500), None, rng.randrange(120, 180), None, None, None))
    rows = match.match_rides(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), least=0.0).collect()
    for low, high in ((0.0, 0.5), (0.5, 0.9), (0.9, 1.01)):
        part = [r for r in rows if low <= r.confidence < high]
        if len(part) > 100:
            share, said = sum(r.l_key == r.r_key for r in part) / len(part), sum(r.confidence for r in part) / len(part)
            print(low, len(part), round(share, 3), round(said, 3))
            assert abs(share - said) < 0.2


def test_calibration_rises():
    a, b = match.calibrate([(45, 100, 1), (20, 2, 80), (30, 10, 10)])
    p = lambda x: 1 / (1 + 2.718281828 ** -(a + b * x))
    assert b > 0 and p(0.9) > 0.9 and p(0.4) < 0.1 and match.calibrate([])[1] > 0
