"""Operators over the readings of recordings (telemetry), one result row per recording.

Order within a recording is by time, then record_id. A recording may be of any length, even a third
of the table: positions and previous values are worked out within blocks of time and carried over
block edges, and moving windows run over chunks of positions that overlap by the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators.activity import r6

KEY, TS, ROW = "activity_id", "timestamp", "record_id"
BLOCK_S, CHUNK = 6 * 3600, 4096
#: Shares of FTP in percent that bound the zones of readings, the first exclusive. Fixed values.
RECORD_ZONES = (55, 75, 90, 105, 120, 150)
THRESHOLDS = (100, 150, 200, 250, 300, 350, 400)


def ordered(records: DataFrame, fields: Sequence[str], where: str | None = None) -> DataFrame:
    """(activity_id, record_id, t, fields, pos, n, prev): each reading's position from 1, the number of
    readings, and the previous reading's struct of (t, fields); null for the first.

    Rows without a recording or a time are left out; ``where`` keeps only certain readings before
    counting."""
    t = (F.unix_micros(TS) / 1e6).alias("t")
    rows = records.where(F.col(KEY).isNotNull() & F.col(TS).isNotNull())
    rows = (rows.where(where) if where else rows).select(KEY, ROW, t, *[F.col(f).cast("double").alias(f) for f in fields])
    rows = rows.withColumn("b", F.floor(F.col("t") / BLOCK_S)).withColumn("x", F.struct("t", *fields))
    w = Window.partitionBy(KEY, "b").orderBy("t", ROW)
    rows = rows.withColumn("rn", F.row_number().over(w)).withColumn("p", F.lag("x").over(w))
    along, whole = Window.partitionBy(KEY).orderBy("b"), Window.partitionBy(KEY)
    edges = (
        rows.groupBy(KEY, "b")
        .agg(F.count("*").alias("m"), F.max_by("x", F.struct("t", ROW)).alias("tail"))
        .select(
            KEY, "b", F.coalesce(F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.sum("m").over(whole).alias("n"), F.lag("tail").over(along).alias("tail"),
        )
    )
    return rows.join(edges, [KEY, "b"]).select(
        KEY, ROW, "t", *fields, (F.col("before") + F.col("rn")).alias("pos"), "n", F.coalesce("p", "tail").alias("prev")
    )


def moving_mean(series: DataFrame, field: str, k: int) -> DataFrame:
    """(activity_id, pos, n, mean): mean of the last k readings, from the k-th reading on."""
    at = F.floor((F.col("pos") - 1) / CHUNK)
    spill = F.floor((F.col("pos") - 1 + (k - 1)) / CHUNK)
    cut = series.select(KEY, "pos", "n", field, at.alias("own"), F.explode(F.sequence(at, spill)).alias("chunk"))
    w = Window.partitionBy(KEY, "chunk").orderBy("pos").rowsBetween(1 - k, 0)
    return cut.withColumn("mean", F.avg(field).over(w)).where((F.col("own") == F.col("chunk")) & (F.col("pos") >= k)).select(KEY, "pos", "n", "mean")


def elapsed_time(records: DataFrame) -> DataFrame:
    """Seconds since each recording's first reading, and, where they are recorded in m/s and m, speed in
    km/h and distance in km."""
    rows = records.where(F.col(KEY).isNotNull() & F.col(TS).isNotNull())
    first = rows.groupBy(KEY).agg(F.min(TS).alias("t0"))
    seconds = lambda c: F.unix_micros(c) / 1e6
    out = [ROW, KEY, r6(seconds(F.col(TS)) - seconds(F.col("t0"))).alias("elapsed_s")]
    units = [c.alias(n) for n, of, c in (("speed_kmh", "speed", F.col("speed") * 3.6), ("distance_km", "distance", F.col("distance") / 1000)) if of in records.columns]
    return rows.join(first, KEY).select(*out, *units)


def record_interval(records: DataFrame) -> DataFrame:
    gap = F.col("t") - F.col("prev.t")
    return ordered(records, []).groupBy(KEY).agg(
        r6(F.max("t") - F.min("t")).alias("elapsed_s"), r6(F.percentile(gap, F.lit(0.5))).alias("median_gap_s"), F.count("*").alias("readings")
    )


def field_stats(records: DataFrame, field: str, std: bool = False) -> DataFrame:
    c = F.col(field).cast("double")
    extra = [r6(F.stddev_samp(c)).alias(f"std_{field}")] if std else []
    known = records.where(F.col(field).isNotNull() & F.col(KEY).isNotNull())
    return known.groupBy(KEY).agg(r6(F.avg(c)).alias(f"avg_{field}"), F.max(c).alias(f"max_{field}"), F.min(c).alias(f"min_{field}"), *extra)


def record_stats(records: DataFrame, fields: Sequence[str] = ("cadence", "speed", "altitude", "temperature")) -> DataFrame:
    aggs = [a for f in fields for a in (r6(F.avg(f)).alias(f"avg_{f}"), F.max(F.col(f).cast("double")).alias(f"max_{f}"), F.min(F.col(f).cast("double")).alias(f"min_{f}"))]
    return records.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(*aggs)


def _shares(df: DataFrame, zones: list[Column]) -> DataFrame:
    return df.groupBy(KEY).agg(*[r6(F.count_if(z) * 100.0 / F.count("*")).alias(f"zone_{k}_pct") for k, z in enumerate(zones, 1)])


def hr_zone_pct(records: DataFrame) -> DataFrame:
    """Shares of readings by percent of the recording's own largest heart rate: below 60, 70, 80, 90, else."""
    known = records.where(F.col("heart_rate").isNotNull() & F.col(KEY).isNotNull()).select(KEY, "heart_rate")
    top = known.groupBy(KEY).agg(F.max("heart_rate").alias("top"))
    p = F.col("heart_rate") * 100.0 / F.col("top")
    marks = [p < 60, (p >= 60) & (p < 70), (p >= 70) & (p < 80), (p >= 80) & (p < 90), p >= 90]
    return _shares(known.join(top.where("top > 0"), KEY), marks)


def power_zone_pct(records: DataFrame, ftp: float = 250.0) -> DataFrame:
    p = F.col("power") * 100.0 / ftp
    z = RECORD_ZONES
    marks = [p < z[0], (p >= z[0]) & (p <= z[1]), *[(p > a) & (p <= b) for a, b in zip(z[1:], z[2:], strict=False)], p > z[-1]]
    return _shares(records.where(F.col("power").isNotNull() & F.col(KEY).isNotNull()), marks)


def normalized_power(records: DataFrame) -> DataFrame:
    """Fourth-power mean of the 30-reading moving mean; the plain mean below 30 readings."""
    series = ordered(records, ["power"], "power is not null")
    smooth = moving_mean(series, "power", 30).groupBy(KEY).agg(F.pow(F.avg(F.pow("mean", F.lit(4))), F.lit(0.25)).alias("np"))
    plain = records.where(F.col("power").isNotNull() & F.col(KEY).isNotNull()).groupBy(KEY).agg(F.avg("power").alias("avg_power"), F.max("power").alias("max_power"))
    return plain.join(smooth, KEY, "left").select(KEY, r6(F.coalesce("np", "avg_power")).alias("normalized_power"), "avg_power", "max_power")


def power_stats(records: DataFrame) -> DataFrame:
    np_ = normalized_power(records)
    return np_.select(
        KEY, r6(F.col("avg_power")).alias("avg_power"), "max_power", "normalized_power",
        F.round(F.try_divide("normalized_power", "avg_power"), 5).alias("variability_index"),
    )


def efficiency_factor(records: DataFrame, ftp: float = 250.0) -> DataFrame:
    hr = records.where(F.col("heart_rate").isNotNull()).groupBy(KEY).agg(F.avg("heart_rate").alias("hr"))
    return normalized_power(records).join(hr, KEY, "left").select(
        KEY, F.round(F.col("normalized_power") / ftp, 5).alias("intensity_factor"), F.round(F.try_divide("normalized_power", "hr"), 5).alias("efficiency_factor")
    )


def elevation_gain(records: DataFrame, least: float = 1.0) -> DataFrame:
    d = F.col("altitude") - F.col("prev.altitude")
    return ordered(records, ["altitude"], "altitude is not null").groupBy(KEY).agg(r6(F.coalesce(F.sum(F.when(d > least, d)), F.lit(0.0))).alias("gain_m"))


def power_dist(records: DataFrame) -> DataFrame:
    p = F.col("power").cast("double")
    q = lambda x: F.percentile(p, F.lit(x))
    return records.where(F.col("power").isNotNull() & F.col(KEY).isNotNull()).groupBy(KEY).agg(
        r6(F.stddev_pop(p)).alias("std"), r6(F.try_divide(F.stddev_pop(p), F.avg(p))).alias("cv"), r6(q(0.25)).alias("q25"), r6(q(0.5)).alias("q50"),
        r6(q(0.75)).alias("q75"), r6(q(0.75) - q(0.25)).alias("iqr"),
    )


def power_skew(records: DataFrame) -> DataFrame:
    """Adjusted skewness with the population deviation; at least 3 readings that differ."""
    p = F.col("power").cast("double")
    a = records.where(F.col("power").isNotNull() & F.col(KEY).isNotNull()).groupBy(KEY).agg(F.skewness(p).alias("s"), F.count(p).cast("double").alias("n"), F.stddev_pop(p).alias("sd"))
    n = F.col("n")
    return a.where("n >= 3 and sd > 0").select(KEY, F.round(F.col("s") * n * n / ((n - 1) * (n - 2)), 4).alias("skewness"))


def power_kurt(records: DataFrame) -> DataFrame:
    """Adjusted kurtosis with the population deviation; at least 4 readings that differ."""
    p = F.col("power").cast("double")
    a = records.where(F.col("power").isNotNull() & F.col(KEY).isNotNull()).groupBy(KEY).agg(F.kurtosis(p).alias("k"), F.count(p).cast("double").alias("n"), F.stddev_pop(p).alias("sd"))
    n = F.col("n")
    value = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * n * (F.col("k") + 3) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return a.where("n >= 4 and sd > 0").select(KEY, F.round(value, 4).alias("kurtosis"))


def _change(records: DataFrame, field: str, name: str) -> DataFrame:
    d = F.col(field) - F.col(f"prev.{field}")
    return ordered(records, [field], f"{field} is not null").groupBy(KEY).agg(F.stddev_pop(d).alias(name))


def power_smoothness(records: DataFrame) -> DataFrame:
    return _change(records, "power", "s").select(KEY, r6(F.col("s")).alias("smoothness"))


def time_above(records: DataFrame) -> DataFrame:
    known = records.where(F.col("power").isNotNull() & F.col(KEY).isNotNull())
    return known.groupBy(KEY).agg(*[r6(F.count_if(F.col("power") > w) * 100.0 / F.count("*")).alias(f"above_{w}_pct") for w in THRESHOLDS])


def _drift(records: DataFrame, field: str) -> DataFrame:
    """(activity_id, n, drift): second half against first half of the known readings, in percent; 0 below
    two readings or where the first half's mean is 0."""
    half = F.floor(F.col("n") / 2)
    x = F.col(field)
    a = ordered(records, [field], f"{field} is not null").groupBy(KEY).agg(
        F.max("n").alias("n"), F.avg(F.when(F.col("pos") <= half, x)).alias("first"), F.avg(F.when(F.col("pos") > half, x)).alias("second")
    )
    return a.select(KEY, "n", F.when((F.col("n") < 2) | (F.col("first") == 0), 0.0).otherwise((F.col("second") - F.col("first")) / F.col("first") * 100).alias("drift"))


def hr_drift(records: DataFrame) -> DataFrame:
    spread = records.where(F.col("heart_rate").isNotNull()).groupBy(KEY).agg(F.stddev_pop("heart_rate").alias("s"), F.avg("heart_rate").alias("m"))
    return _drift(records, "heart_rate").join(spread, KEY).select(
        KEY, r6(F.col("s")).alias("std_hr"), r6(F.try_divide("s", "m")).alias("cv_hr"), r6(F.col("drift")).alias("hr_drift_pct")
    )


def decoupling(records: DataFrame) -> DataFrame:
    """Heart-rate drift less power drift; 0 where the two have different numbers of readings."""
    h = _drift(records, "heart_rate").select(KEY, F.col("n").alias("hn"), F.col("drift").alias("h"))
    p = _drift(records, "power").select(KEY, F.col("n").alias("pn"), F.col("drift").alias("p"))
    return h.join(p, KEY).select(KEY, r6(F.when(F.col("hn") == F.col("pn"), F.col("h") - F.col("p")).otherwise(0.0)).alias("decoupling_pct"))


def pedal_stats(records: DataFrame) -> DataFrame:
    c = F.col("cadence").cast("double")
    return records.where((F.col("cadence") > 0) & F.col(KEY).isNotNull()).groupBy(KEY).agg(
        r6(F.stddev_pop(c)).alias("std_cadence"), r6(F.try_divide(F.stddev_pop(c), F.avg(c))).alias("cv_cadence"), F.count("*").alias("pedalled")
    )


def terrain_stats(records: DataFrame) -> DataFrame:
    t = F.col("temperature").cast("double")
    temp = records.where(F.col(KEY).isNotNull()).groupBy(KEY).agg((F.max(t) - F.min(t)).alias("temp_range"), r6(F.stddev_pop(t)).alias("temp_std"))
    return temp.join(_change(records, "altitude", "s"), KEY, "left").select(KEY, r6(F.col("s")).alias("altitude_change_std"), "temp_range", "temp_std")


def power_hr_corr(records: DataFrame) -> DataFrame:
    both = records.where(F.col("power").isNotNull() & F.col("heart_rate").isNotNull() & F.col(KEY).isNotNull())
    a = both.groupBy(KEY).agg(F.corr(F.col("power").cast("double"), F.col("heart_rate").cast("double")).alias("c"), F.count("*").alias("n"))
    return a.where("n > 10").select(KEY, F.round("c", 5).alias("power_hr_corr"))


def _quarters(records: DataFrame, field: str) -> DataFrame:
    q = F.floor(F.col("n") / 4)
    x = F.col(field)
    return ordered(records, [field], f"{field} is not null").where("n > 100").groupBy(KEY).agg(
        F.avg(F.when(F.col("pos") <= q, x)).alias("a"), F.avg(F.when(F.col("pos") > F.col("n") - q, x)).alias("z")
    )


def power_fade(records: DataFrame) -> DataFrame:
    """Loss of power and rise of heart rate, first against last quarter in percent; over 100 readings."""
    p = _quarters(records, "power").where("a > 0").select(KEY, r6((F.col("a") - F.col("z")) / F.col("a") * 100).alias("power_fade_pct"))
    h = _quarters(records, "heart_rate").where("a > 0").select(KEY, r6((F.col("z") - F.col("a")) / F.col("a") * 100).alias("hr_rise_pct"))
    return p.join(h, KEY, "full")


def cadence_stability(records: DataFrame) -> DataFrame:
    cv = pedal_stats(records).select(KEY, r6(1 / (1 + F.col("cv_cadence"))).alias("stability"))
    return cv.join(_change(records.where("cadence > 0"), "cadence", "s"), KEY).select(KEY, "stability", r6(1 / (1 + F.col("s"))).alias("smoothness"))
