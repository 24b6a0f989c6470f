import itertools
import math
import random

import pytest

from wattloom.llm import history

HIST = "id long, file_path string, file_hash string, status string, digest string, n long"
VEC = "row_id long, rider string, start_s long, distance double, moving_time double, cell long"


def found(df):
    return {tuple(r) for r in df.select("key_a", "key_b").collect()}


def files():
    h = "ab" * 32
    return [(1, "x", h, "error", "", 1), (2, "x", h.upper(), "success", "", 1), (3, "x", f" sha256:{h} ", "warning", "", 1), (4, "x", h, "error", "", 1), (5, "x", h, "Success", "", 1),
            (6, "x", None, "success", "", 1), (7, "x", None, "success", "", 1), (8, "x", "", "success", "", 1), (9, "x", "cd" * 32, None, "", 1)]


@pytest.mark.parametrize("batches", [1, 4])
def test_files(spark, batches):
    assert found(history.same_file(spark.createDataFrame(files(), HIST), batches)) == {(2, 3), (2, 5)}
    assert history.same_file(spark.createDataFrame([], HIST)).count() == 0


def test_files_are_held_against_reopened_hashes(spark):
    rows = history.file_digests(spark.createDataFrame(files(), HIST))
    index = history.FileHashes(spark)
    assert found(index.take_in(rows.where("id < 4"), "a")) == {(2, 3)}
    for _ in range(2):  # the second time is a retry
        assert found(history.FileHashes(spark, index.path).take_in(rows.where("id >= 4"), "b")) == {(2, 5)}
    assert index.accepted().count() == 1


def brute(rows):
    """Rows in order of landing, each against the accepted rides before it."""
    known = lambda x: x is not None and x > 0
    heads, out = [], set()
    for b in sorted(rows):
        near = []
        for a in heads:
            if a[1] != b[1]:
                continue
            pairs = ((a[3], b[3], history.LOG_DISTANCE), (a[4], b[4], history.LOG_TIME))
            far = max(abs(a[2] - b[2]) / history.START_S, *[abs(math.log(x / y)) / s if known(x) and known(y) else 0 for x, y, s in pairs])
            if far <= 1:
                near.append((far, a[0]))
        if near:
            out.add((min(near)[1], b[0]))
        else:
            heads.append(b)
    return out


def crowded(seed, n=160):
    """Rides that touch in chains, over the edges of blocks, with unknown numbers and copies."""
    rng = random.Random(seed)
    rows, start = [], history.BLOCK_S * 78_700 - 4000
    for _ in range(n):
        start += rng.choice([0, 60, 150, 250, 290, 299, 301, 2000])
        size = rng.choice([None, 10_000.0, 10_050.0, 10_100.0, 10_150.0, 20_000.0])
        rows.append([0, rng.choice("aab"), start, size, rng.choice([None, 1800.0, 1810.0]), 0])
    rows += [list(r) for r in rng.sample(rows, n // 5)]
    rng.shuffle(rows)
    return [(i + 1, *r[1:]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_into_batches_gives_the_rows_of_brute_force(spark, seed):
    rows = crowded(seed)
    df = spark.createDataFrame(rows, VEC)
    expected = brute([r[:5] for r in rows])
    assert len(expected) > 50
    for batches in (1, 2, 5):
        assert found(history.same_rides(df, batches)) == expected


def test_chains_refer_to_accepted_rides_only(spark):
    rows = [(1, "a", 1000, 10.0, 5.0, 0), (2, "a", 1200, 10.0, 5.0, 0), (3, "a", 1400, 10.0, 5.0, 0)]
    for batches in (1, 3):  # the third is 400 s from the first, and the second is no head
        index = history.RideCells(spark)
        assert found(history.same_rides(spark.createDataFrame(rows, VEC), batches, index)) == {(1, 2)}
        assert {r.row_id for r in index.accepted().collect()} == {1, 3}


def test_a_chain_longer_than_the_margin(spark):
    n = 3 * history.BLOCK_S // 200
    rows = [(k + 1, "a", 200 * k, 10.0, None, 0) for k in range(n)]
    got = found(history.same_rides(spark.createDataFrame(rows, VEC), 1))
    assert got == {(k - 1, k) for k in range(2, n + 1, 2)}


def test_reopened_cells_show_their_history(spark):
    index = history.RideCells(spark)
    first = spark.createDataFrame([(1, "a", 1000, 10.0, 5.0, 0), (2, "a", 90_000_000, 10.0, 5.0, 0)], VEC)
    assert index.take_in(first, "one").count() == 0
    again = history.RideCells(spark, index.path)
    assert again.accepted().count() == 2
    rows = [(3, "a", 1100, 10.01, 5.0, 0), (4, "b", 1000, 10.0, 5.0, 0), (5, "a", 1200, 11.0, 5.0, 0)]
    assert found(again.take_in(spark.createDataFrame(rows, VEC), "two")) == {(1, 3)}
    kept = history.RideCells(spark, index.path).accepted()
    assert kept.count() == 4 and {r.month for r in kept.select("month").distinct().collect()} == {0, 34}


def test_a_batch_taken_in_twice_changes_nothing(spark):
    rows = spark.createDataFrame([r for r in crowded(5) if r[0] < 60], VEC)
    index = history.RideCells(spark)
    got = found(index.take_in(rows, "one"))
    n = index.accepted().count()
    for name in ("one", "another name"):
        assert found(history.RideCells(spark, index.path).take_in(rows, name)) == got
        assert index.accepted().count() == n


def test_a_batch_reads_its_months_only(spark, capsys):
    index = history.RideCells(spark)
    rows = [(k, "a", k * history.MONTH_S + 700_000, 10.0, 5.0, 0) for k in range(12)]
    index.take_in(spark.createDataFrame(rows, VEC), "all")
    assert index.accepted().count() == 12
    index.accepted([3, 4]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "month" in plan[plan.index("PartitionFilters") :]
    files = {f.split("month=")[1].split("/")[0] for f in index.accepted([3, 4]).inputFiles()}
    scanned = {r.f.split("month=")[1].split("/")[0] for r in index.accepted([3, 4]).selectExpr("input_file_name() as f").collect()}
    assert scanned == {"3", "4"} and files >= scanned


def test_hot_exact_copies_and_empty(spark):
    rows = spark.range(1, 3001).selectExpr("id as row_id", "'a' as rider", "1000L as start_s", "10D as distance", "cast(null as double) as moving_time")
    got = history.same_rides(rows)
    assert got.count() == 2999 and got.where("key_a = 1").count() == 2999
    assert history.same_rides(rows.limit(0)).count() == 0
    assert history.RideCells(spark).take_in(rows.limit(0), "none").count() == 0


def test_unknown_numbers(spark):
    acts = spark.createDataFrame([(1, float("nan"), 5), (2, 0.0, None), (3, None, -1), (4, 7.0, 5)], "row_id long, distance double, moving_time long")
    starts = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, None, 5), (4, "a", None)], "row_id long, athlete_id string, utc_s long")
    rows = history.ride_vectors(starts, acts).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 5, None, 5.0), (2, "a", 6, None, None)]


def test_probing_stops_at_the_bound():
    cells = history._Cells()
    for row, (start, d) in enumerate(itertools.product(range(0, 1200, 100), (1.0, 1.005, 1.01, None))):
        cells.add((row, start, d, None, history.HEAD))
    who, unsettled = cells.nearest(500, 1.005, None)
    assert (who, unsettled) == (21, False)  # of two at distance 0 the lesser
    assert cells.nearest(9000, 1.0, None) == (None, False)
