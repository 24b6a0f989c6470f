"""Features that depend on the rider and on the recording's own cadence."""

import math

import pytest

from wattloom.operators import features


def test_force_and_weight_are_the_rides_own(spark):
    sessions = spark.createDataFrame([(1, "a", 200.0, 210.0, 55.0), (2, "b", 200.0, 210.0, 0.0), (3, None, 200.0, None, 90.0)], "session_id long, activity_id string, avg_power double, normalized_power double, avg_cadence double")
    activities = spark.createDataFrame([("a", 7), ("a", 7), ("b", 8), (None, 7)], "id string, athlete_id long")
    athletes = spark.createDataFrame([(7, 55.0), (8, None)], "athlete_id long, weight_kg double")
    a, b, c = features.session_power(sessions, activities, athletes).orderBy("session_id").collect()
    assert a.force_n == pytest.approx(200 * 60 / (55 * 2 * math.pi * 0.1725)) and a.watts_per_kg == pytest.approx(200 / 55) and a.np_per_kg == pytest.approx(210 / 55)
    assert (b.force_n, b.watts_per_kg) == (None, None) and c.force_n is not None and c.watts_per_kg is None
