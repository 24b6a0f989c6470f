"""Ride features for models: a feature is null where an input is null or 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.operators.activity import ZONES, r6, r9, unified_ftp
from wattloom.operators.normalize import balance
from wattloom.operators.records import hr_zone_pct


def some(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c.cast("double"), F.lit(0.0))


def ratio(a: str | Column, b: str | Column) -> Column:
    return some(a) / some(b)


def basic(df: DataFrame) -> DataFrame:
    return df.select(
        "id", r9(ratio("icu_normalized_watts", "icu_average_watts")).alias("power_vi"), r9(ratio("icu_average_watts", "max_power")).alias("power_max_ratio"),
        r9(ratio("average_heartrate", "max_heartrate")).alias("hr_reserve_used"), r9(some("total_elevation_gain") / (some("distance") / 1000)).alias("altitude_per_km"),
    )


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _spread(p: str, k: int) -> tuple[Column, Column, Column]:
    """Deviation, skew and entropy of k zone shares that add up to 1; the skew of equal shares is 0."""
    apart = lambda power: _total(F.transform(p, lambda x: F.pow(x - 1.0 / k, F.lit(power)))) / k
    skew = F.when(apart(2) > 1e-18, apart(3) / F.pow(apart(2), F.lit(1.5))).otherwise(0.0)
    entropy = -_total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))
    return F.sqrt(apart(2)), skew, entropy


def zones(df: DataFrame) -> DataFrame:
    """Spread, skew, entropy and balances of the power zones' shares."""
    z = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ZONES])
    shares = df.select("id", z.alias("z")).withColumn("t", _total(F.col("z"))).where("t > 0").withColumn("p", F.transform("z", lambda x: x / F.col("t")))
    p = [F.get("p", F.lit(k)) for k in range(7)]
    std, skew, entropy = _spread("p", 7)
    return shares.select(
        "id", r9(std).alias("zone_std"), r6(skew).alias("zone_skew"), r9(entropy).alias("zone_entropy"), r9((p[0] + p[4]) / (p[1] + p[2] + p[3] + 0.01)).alias("polarization"),
        r9((p[0] + p[1] + p[2]) / (p[3] + p[4] + p[5] + p[6] + 0.01)).alias("aerobic_ratio"), r9(p[2] + p[3]).alias("sweet_spot"), r9(p[4] + p[5] + p[6]).alias("high"),
    )


def heart_zones(records: DataFrame) -> DataFrame:
    """Spread, skew, entropy and polarization of the recordings' five heart rate zones, in percent."""
    pct = F.array(*[F.col(f"zone_{k}_pct") for k in range(1, 6)])
    shares = hr_zone_pct(records).select("activity_id", pct.alias("z")).withColumn("p", F.transform("z", lambda x: x / _total(F.col("z"))))
    z = [F.get("z", F.lit(k)) for k in range(5)]
    std, skew, entropy = _spread("p", 5)
    return shares.select(
        "activity_id", r6(std * 100).alias("hr_zone_std"), r6(skew).alias("hr_zone_skew"), r6(entropy).alias("hr_zone_entropy"),
        r6((z[0] + z[4]) / (z[1] + z[2] + z[3] + 0.01)).alias("hr_polarization"),
    )


#: Watts that time above is counted for. Fixed values.
ABOVE_W = (100, 150, 200, 250, 300, 350, 400, 450, 500)


def recording(records: DataFrame) -> DataFrame:
    """Features of a recording's own readings, from one aggregation: spreads and their shares of the
    mean, time above levels of power, altitude, temperature range and number of readings. Cadence counts
    where pedalled. Rows without a recording are left out."""
    pedalled = F.when(F.col("cadence") > 0, F.col("cadence"))
    cv = lambda c: F.stddev_pop(c) / F.nullif(F.avg(c), F.lit(0.0))
    above = [r6(F.count_if(F.col("power") > w) * 100.0 / F.nullif(F.count("power"), F.lit(0))).alias(f"above_{w}w_pct") for w in ABOVE_W]
    rows = records.where("activity_id is not null").groupBy("activity_id").agg(
        r6(1 / (1 + F.stddev_pop(pedalled))).alias("cadence_consistency"), r6(F.stddev_pop("power")).alias("power_variability"),
        r6(cv("power")).alias("power_cv"), r6(cv("heart_rate")).alias("hr_cv"), r6(cv(pedalled)).alias("cadence_cv"), *above,
        r6(F.avg("altitude")).alias("avg_altitude"), (F.max("temperature") - F.min("temperature")).cast("double").alias("temp_variation"),
        F.count("*").alias("data_points"),
    )
    high = F.col("avg_altitude")
    return rows.withColumn("altitude_zone", F.when(high < 500, 1).when(high < 1500, 2).when(high < 2500, 3).when(high.isNotNull(), 4))


def power(df: DataFrame, mass_kg: float = 70.0, crank_m: float = 0.1725, cadence: float = 85.0) -> DataFrame:
    i = ratio("icu_normalized_watts", unified_ftp(df))
    level = F.lit(1)
    for k, low in enumerate((0.55, 0.75, 0.85, 0.95, 1.05)):
        level = F.when(i >= low, k + 2).otherwise(level)
    return df.select(
        "id", r9(i).alias("intensity"), F.when(i.isNotNull(), level).alias("training_level"), r9(some("icu_average_watts") / mass_kg).alias("watts_per_kg"),
        r9(some("icu_normalized_watts") / mass_kg).alias("np_per_kg"), r9(some("icu_average_watts") * 60 / (cadence * 2 * math.pi * crank_m)).alias("force_n"),
    )


def session_power(sessions: DataFrame, activities: DataFrame, athletes: DataFrame, crank_m: float = 0.1725) -> DataFrame:
    """Force from a recording's own cadence and power for its rider's weight; null where not known."""
    riders = activities.where("id is not null").groupBy("id").agg(F.min("athlete_id").alias("athlete_id"))
    weights = athletes.groupBy("athlete_id").agg(F.max("weight_kg").alias("weight_kg"))
    s = sessions.join(riders, sessions.activity_id == riders.id, "left").join(weights, "athlete_id", "left")
    return s.select(
        "session_id", r9(some("avg_power") * 60 / (some("avg_cadence") * 2 * math.pi * crank_m)).alias("force_n"),
        r9(ratio("avg_power", "weight_kg")).alias("watts_per_kg"), r9(ratio("normalized_power", "weight_kg")).alias("np_per_kg"),
    )


def heart(df: DataFrame) -> DataFrame:
    return df.select(
        "id", r9(ratio("icu_average_watts", "average_heartrate")).alias("power_per_beat"), r9(ratio("icu_normalized_watts", "average_heartrate")).alias("np_per_beat"),
        r9(some("average_heartrate") * some("moving_time") / 3600).alias("hr_load"),
    )


def efficiency(df: DataFrame) -> DataFrame:
    return df.select(
        "id", r9(some("distance") / some("moving_time") / some("icu_average_watts")).alias("speed_per_watt"),
        r9(some("total_elevation_gain") / (some("moving_time") / 3600)).alias("vam"), r9(ratio("moving_time", "elapsed_time")).alias("moving_ratio"),
        r9(ratio("icu_average_watts", "average_heartrate")).alias("power_hr_ratio"), r9(ratio("icu_normalized_watts", "average_heartrate")).alias("np_hr_ratio"),
    )


def gross_efficiency(sessions: DataFrame) -> DataFrame:
    work = some("avg_power") * some("total_timer_time")
    return sessions.select("session_id", r9(work / (some("total_calories") * 4184) * 100).alias("gross_efficiency"), r9(ratio("normalized_power", "avg_power")).alias("vi"))


def variability(df: DataFrame) -> DataFrame:
    return df.select("id", r9(ratio("icu_normalized_watts", "icu_average_watts")).alias("vi"), r9(1 / (1 + F.abs(ratio("max_power", "icu_average_watts") - 1))).alias("smooth_index"))


def pedaling(sessions: DataFrame) -> DataFrame:
    """Balance, asymmetry, watts per turn, and means of torque effectiveness and pedal smoothness over the
    sides that are there; a side whose column is missing is unknown."""
    b = balance(F.col("left_right_balance"))

    def mean(name: str) -> Column:
        sides = [some(c) for c in (f"avg_left_{name}", f"avg_right_{name}") if c in sessions.columns]
        known = F.array_compact(F.array(*sides, F.lit(None).cast("double")))
        return _total(known) / F.nullif(F.size(known), F.lit(0))

    return sessions.select(
        "session_id", r9(b).alias("left_share"), r9(F.abs(50 - b)).alias("asymmetry"), r9(ratio("avg_power", "avg_cadence")).alias("watts_per_rpm"),
        r9(mean("torque_effectiveness")).alias("torque_effectiveness"), r9(mean("pedal_smoothness")).alias("pedal_smoothness"),
    )


def environment(sessions: DataFrame) -> DataFrame:
    t = F.col("avg_temperature")
    zone = F.when(t < 0, 1).when(t < 10, 2).when(t < 20, 3).when(t < 30, 4).when(t.isNotNull(), 5)
    return sessions.select("session_id", zone.alias("temp_zone"), r9(F.abs(t - 12.5)).alias("temp_stress"))


def device(sessions: DataFrame) -> DataFrame:
    """A stable number of the device and which sensors it had."""
    return sessions.select(
        "session_id", (F.conv(F.substring(F.md5(F.col("serial_number").cast("binary")), 1, 8), 16, 10).cast("long") % 100).cast("int").alias("device_hash"),
        F.col("avg_power").isNotNull().alias("has_power"), F.col("avg_heart_rate").isNotNull().alias("has_heart_rate"), F.col("avg_cadence").isNotNull().alias("has_cadence"),
    )


def sensors(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """Which sensors each session had and how many readings its recording holds."""
    n = records.where("activity_id is not null").groupBy("activity_id").agg(F.count("*").alias("data_points"))
    flag = lambda c: F.coalesce(F.col(c) != 0, F.lit(False)).cast("int")
    return sessions.join(n, "activity_id", "left").select(
        "session_id", "data_points", flag("avg_power").alias("has_power"), flag("avg_heart_rate").alias("has_hr"), flag("avg_cadence").alias("has_cadence"),
        flag("avg_temperature").alias("has_temperature"),
    )
