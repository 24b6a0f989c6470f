"""Operators over rides: aggregates, trailing windows, zones, seasons and report tables.

Every function is ``(rides, ...) -> DataFrame`` and lazy. Dates that anchor a window come from the
data through a scalar subquery, so each is one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "start_date_local"
ZONES = [f"z{k}_secs" for k in range(1, 8)]
#: Lower bounds of the power zones as shares of FTP, half-open. Fixed values.
POWER_ZONES = (0.0, 0.55, 0.75, 0.90, 1.05, 1.20, 1.50)
#: Durations of the power curve in seconds. Fixed values.
DURATIONS = (5, 10, 30, 60, 120, 300, 600, 1200, 3600)
EFFORTS = ("distance", "moving_time", "icu_average_watts", "icu_normalized_watts", "icu_training_load")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def r9(c: Column) -> Column:
    """For quotients: finite decimals of seven digits would be ties at six."""
    return F.round(c, 9)


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def latest(df: DataFrame) -> Column:
    return df.agg(F.max(START)).scalar()


def since(df: DataFrame, days: int, as_of: str | None = None) -> DataFrame:
    """Rows from ``days`` days before the last start on, or, with ``as_of`` (a date or time), of the days
    up to it."""
    if as_of is None:
        return df.where(F.col(START) >= latest(df) - F.make_dt_interval(F.lit(days)))
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.where((F.col(START) >= end - F.make_dt_interval(F.lit(days))) & (F.col(START) <= end))


def unified_ftp(df: DataFrame) -> Column:
    """FTP by precedence: functional, threshold, then the platform's."""
    return F.coalesce(*[F.col(c) for c in present(df, ("functional_threshold_power", "threshold_power", "icu_ftp"))])


def ftp_progression(df: DataFrame) -> DataFrame:
    return df.withColumn("ftp", unified_ftp(df)).where("ftp is not null").select("id", day_text(F.col(START)).alias("day"), "ftp")


def training_load(df: DataFrame, days: int = 42) -> DataFrame:
    ctl, atl = F.avg("icu_fitness"), F.avg("icu_fatigue")
    return since(df, days).agg(
        r6(ctl).alias("ctl"), r6(atl).alias("atl"), r6(F.coalesce(F.sum("icu_training_load"), F.lit(0.0))).alias("load"),
        F.count("*").alias("rides"), r6(F.sum("moving_time") / 3600).alias("hours"),
        r6(F.when((ctl != 0) & (atl != 0), ctl - atl)).alias("tsb"),
    )


def training_load_periods(df: DataFrame, periods: Sequence[int] = (7, 14, 28, 42, 90)) -> DataFrame:
    """All periods in one pass: a row counts for every period that reaches back to it."""
    age = (F.unix_date(latest(df).cast("date")) - F.unix_date(F.col(START).cast("date"))).cast("int")
    at = F.explode(F.array(*[F.when(age <= d, F.lit(d)) for d in periods])).alias("period_days")
    each = df.select("icu_fitness", "icu_fatigue", "icu_training_load", "moving_time", at).where("period_days is not null")
    return each.groupBy("period_days").agg(
        r6(F.avg("icu_fitness")).alias("ctl"), r6(F.avg("icu_fatigue")).alias("atl"), r6(F.sum("icu_training_load")).alias("load"),
        F.count("*").alias("rides"), r6(F.sum("moving_time") / 3600).alias("hours"),
    )


def zone_of(power: Column, ftp: Column, bounds: Sequence[float] = POWER_ZONES) -> Column:
    """Zone 1 to 7 of a power, half-open; null below 0 or without power or FTP."""
    out = F.lit(None).cast("int")
    for k, low in enumerate(bounds):
        out = F.when(power >= ftp * low, F.lit(k + 1)).otherwise(out)
    return out


def power_zones(df: DataFrame, ftp: float | None = None) -> DataFrame:
    """Hours by zone of average power; FTP defaults to the last known. Zones without time are left out."""
    base = F.lit(ftp) if ftp else df.agg(F.max_by(unified_ftp(df), F.when(unified_ftp(df).isNotNull(), F.struct(START, "id")))).scalar()
    zoned = df.withColumn("zone", zone_of(F.col("icu_average_watts"), base)).where("zone is not null")
    return zoned.groupBy("zone").agg(r6(F.sum("moving_time") / 3600).alias("hours")).where("hours > 0")


def efficiency(df: DataFrame) -> DataFrame:
    both = df.where("icu_average_watts is not null and average_heartrate is not null")
    return both.agg(
        r6(F.avg("icu_intensity")).alias("avg_intensity"),
        r6(F.avg(F.try_divide("icu_normalized_watts", "icu_average_watts"))).alias("avg_variability"),
        r6(F.avg(F.try_divide("icu_average_watts", "average_heartrate"))).alias("avg_watts_per_beat"),
    )


#: Metrics of best efforts in order of preference. Fixed values.
POWER_METRICS = ("icu_normalized_watts", "normalized_power", "icu_average_watts")


def metric_with_data(df: DataFrame, metrics: Sequence[str] = POWER_METRICS) -> str | None:
    """The first of the columns that is there and has any value."""
    there = present(df, metrics)
    known = df.agg(*[F.count(c).alias(c) for c in there]).first() if there else {}
    return next((c for c in there if known[c]), None)


def best_efforts(df: DataFrame, metric: str | None = "icu_normalized_watts", n: int = 10) -> DataFrame:
    """The n best rides by a metric (None: the first one with data); ties go to the lesser id."""
    metric = metric or metric_with_data(df) or present(df, POWER_METRICS)[0]
    top = df.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), "id").limit(n)
    return top.select("id", "name", day_text(F.col(START)).alias("day"), r6(F.col(metric)).alias(metric))


def best_efforts_multi(df: DataFrame, metrics: Sequence[str] = EFFORTS, n: int = 10) -> DataFrame:
    """The n best rides by each metric. The rank is limited within partitions before it is global."""
    long = df.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x"))
    long = long.select("id", "x.metric", "x.value").where("value is not null")
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "id"))
    return long.withColumn("place", rank).where(F.col("place") <= n).select("metric", "place", "id", r6(F.col("value")).alias("value"))


def weekly_summary(df: DataFrame, weeks: int = 12, window_weeks: int | None = None) -> DataFrame:
    """By ISO week over the last weeks * 7 weeks (``window_weeks`` overrides)."""
    span = 7 * (window_weeks if window_weeks is not None else weeks * 7)
    week = day_text(F.date_trunc("week", F.col(START)))
    return since(df, span).groupBy(week.alias("week")).agg(
        F.count("*").alias("rides"), r6(F.sum("moving_time") / 3600).alias("hours"), r6(F.sum("distance") / 1000).alias("km"),
        r6(F.sum("icu_training_load")).alias("load"), r6(F.avg("icu_average_watts")).alias("avg_watts"),
        r6(F.avg("average_heartrate")).alias("avg_hr"), r6(F.sum("total_elevation_gain")).alias("climb"),
    )


def power_curve(df: DataFrame, durations: Sequence[int] = DURATIONS, share: float = 0.95) -> DataFrame:
    """Percentile of normalised power over rides at least as long, all durations in one pass."""
    d = F.explode(F.array(*[F.when(F.col("moving_time") >= s, F.lit(s)) for s in durations])).alias("duration_s")
    each = df.where("icu_normalized_watts is not null").select("icu_normalized_watts", d).where("duration_s is not null")
    at = lambda n: (n - 1) * share
    ranked = values_at(each, "duration_s", "icu_normalized_watts", lambda n: F.floor(at(n)), lambda n: F.ceil(at(n)))
    lower, upper = F.col("at_0"), F.col("at_1")
    watts = lower + (upper - lower) * (at(F.col("n")) - F.floor(at(F.col("n"))))
    return ranked.select("duration_s", r6(watts).alias("watts"), F.col("n").alias("rides"))


def power_sheet(df: DataFrame) -> DataFrame:
    """FTP progression, hours by zone and the power curve as one table (section, label, value)."""
    rows = lambda section, part, label, value: part.select(F.lit(section).alias("section"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
    return (
        rows("ftp", ftp_progression(df), "day", "ftp").unionByName(rows("zone_hours", power_zones(df), "zone", "hours"))
        .unionByName(rows("curve_watts", power_curve(df), "duration_s", "watts"))
    )


def predictions_sheet(df: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Season outlook, readiness and, if given, an FTP forecast (day, predicted) as one table (section,
    label, value)."""
    season = season_forecast(df).select(F.lit("season").alias("section"), F.concat_ws(" +", "metric", "ahead").alias("label"), F.col("predicted").cast("double").alias("value"))
    ready = readiness(df)
    parts = [F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in ("form", "consistency", "intensity", "recovery", "overall")]
    out = season.unionByName(ready.select(F.lit("readiness").alias("section"), F.explode(F.array(*parts)).alias("x")).select("section", "x.label", "x.value"))
    if forecast is not None:
        out = out.unionByName(forecast.select(F.lit("ftp").alias("section"), F.col("day").cast("string").alias("label"), F.col("predicted").cast("double").alias("value")))
    return out


def values_at(df: DataFrame, key: str, value: str, *ranks: Callable[[Column], Column]) -> DataFrame:
    """(key, n, at_0, ...): of each key's values, known ones only, those at the given ranks from 0, each a
    function of their number n. Exact, without sorting a key as a whole: equal values are counted, whole
    units of the value are summed, and only the units that hold a rank are sorted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    counts = counts.select(key, F.col(value).alias("v"), F.floor(value).alias("unit"), "c")
    along = Window.partitionBy(key).orderBy("unit")
    units = counts.groupBy(key, "unit").agg(F.sum("c").alias("m"))
    units = units.withColumn("n", F.sum("m").over(Window.partitionBy(key))).withColumn("low", F.sum("m").over(along) - F.col("m"))
    holds = [(F.col("low") <= r(F.col("n"))) & (r(F.col("n")) < F.col("low") + F.col("m")) for r in ranks]
    wanted = units.where(reduce(lambda a, b: a | b, holds)).select(key, "unit", "n", "low")
    inside = Window.partitionBy(key, "unit").orderBy("v")
    placed = counts.join(wanted, [key, "unit"]).withColumn("end", F.col("low") + F.sum("c").over(inside))
    here = lambda r: (F.col("end") - F.col("c") <= r(F.col("n"))) & (r(F.col("n")) < F.col("end"))
    return placed.groupBy(key).agg(F.first("n").alias("n"), *[F.max(F.when(here(r), F.col("v"))).alias(f"at_{i}") for i, r in enumerate(ranks)])


def seasonal(df: DataFrame, part: str) -> DataFrame:
    """Patterns by ``month``, ``quarter`` (with year), ``dow`` (ISO, Monday 1) or ``hour``."""
    c = F.col(START)
    keys = {
        "month": [F.month(c).alias("month")], "quarter": [F.year(c).alias("year"), F.quarter(c).alias("quarter")],
        "dow": [(F.weekday(c) + 1).alias("dow")], "hour": [F.hour(c).alias("hour")],
    }[part]
    return df.groupBy(*keys).agg(
        F.count("*").alias("rides"), r6(F.avg("distance")).alias("avg_distance"), r6(F.avg("moving_time")).alias("avg_time"),
        r6(F.avg("icu_average_watts")).alias("avg_watts"), r6(F.sum("icu_training_load")).alias("load"),
    )


def daily_loads(df: DataFrame) -> DataFrame:
    """Load of every calendar day from the first to the last, days without rides at 0."""
    days = df.groupBy(F.col(START).cast("date").alias("day")).agg(F.coalesce(F.sum("icu_training_load"), F.lit(0.0)).alias("load"))
    spine = days.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return spine.join(days, "day", "left").select("day", F.coalesce("load", F.lit(0.0)).alias("load"))


def variability_index(df: DataFrame, window_days: int = 7) -> DataFrame:
    """Trailing mean, deviation and their ratio over full windows of days. The days of all riders
    together are few (the calendar bounds them), so one window holds them."""
    w = Window.orderBy("day").rowsBetween(1 - window_days, 0)
    full = F.count("load").over(w) >= window_days
    mean, std = F.avg("load").over(w), F.stddev_samp("load").over(w)
    return daily_loads(df).select(
        day_text(F.col("day")).alias("day"), r6(F.col("load")).alias("load"), r6(F.when(full, mean)).alias("mean_load"),
        r6(F.when(full, std)).alias("std_load"), r6(F.when(full, F.try_divide(std, mean))).alias("variability"),
    )


def training_phases(df: DataFrame) -> DataFrame:
    """Weeks with rides, their load against the mean of the last four such weeks, and the phase."""
    weeks = df.groupBy(F.date_trunc("week", F.col(START)).cast("date").alias("week")).agg(
        F.coalesce(F.sum("icu_training_load"), F.lit(0.0)).alias("load"), F.coalesce(F.avg("icu_intensity"), F.lit(0.0)).alias("intensity"),
        F.count("*").alias("rides"),
    )
    w = Window.orderBy("week").rowsBetween(-3, 0)
    trend = F.coalesce(F.when(F.count("load").over(w) >= 4, F.avg("load").over(w)), F.col("load"))
    load = F.col("load")
    phase = (
        F.when(load < 0.7 * F.col("trend"), "Recovery")
        .when((F.col("intensity") > 0.85) & (load > 0.9 * F.col("trend")), "Peak/Race")
        .when(load > 1.1 * F.col("trend"), "Build")
        .otherwise("Base/Maintenance")
    )
    return weeks.withColumn("trend", trend).select(
        day_text(F.col("week")).alias("week"), r6(load).alias("load"), r6(F.col("intensity")).alias("intensity"), "rides",
        r6(F.col("trend")).alias("trend"), phase.alias("phase"),
    )


def zone_balance(df: DataFrame, days: int = 90) -> DataFrame:
    """Hours and shares of the zones, easy, moderate and hard, and the polarisation."""
    h = [F.coalesce(F.sum(z), F.lit(0.0)) / 3600 for z in ZONES]
    sums = since(df, days).agg(*[x.alias(f"h{k}") for k, x in enumerate(h, 1)])
    c = [F.col(f"h{k}") for k in range(1, 8)]
    total = sum(c[1:], c[0])
    easy, moderate, hard = c[0] + c[1], c[2] + c[3], c[4] + c[5] + c[6]
    return sums.select(
        *[r6(x).alias(f"hours_{k}") for k, x in enumerate(c, 1)], *[r6(F.try_divide(x * 100, total)).alias(f"pct_{k}") for k, x in enumerate(c, 1)],
        r6(easy).alias("easy"), r6(moderate).alias("moderate"), r6(hard).alias("hard"), r6(F.try_divide(easy + hard, moderate)).alias("polarization"),
    )


def vo2max_monthly(df: DataFrame, mass_kg: float = 70.0) -> DataFrame:
    """By month: largest and nearest-rank p95 normalised power, mean power and the estimate.

    The nearest rank is selected exactly without sorting a month as a whole."""
    month = day_text(F.date_trunc("month", F.col(START)))
    known = df.where("icu_normalized_watts is not null").select(month.alias("month"), "id", "icu_normalized_watts", "icu_average_watts")
    sizes = known.groupBy("month").agg(
        F.count("*").alias("n"), F.max("icu_normalized_watts").alias("top"), F.avg("icu_average_watts").alias("avg_watts")
    )
    ranked = values_at(known, "month", "icu_normalized_watts", lambda n: F.round((n - 1) * 0.95)).drop("n").join(sizes, "month")
    p95 = F.col("at_0")
    return ranked.select(
        "month", r6(F.col("top")).alias("max_np"), r6(p95).alias("p95_np"), r6(F.col("avg_watts")).alias("avg_watts"),
        r6(10.8 * (p95 / mass_kg) + 7).alias("vo2max"),
    )


def daily_metrics(df: DataFrame) -> DataFrame:
    return df.groupBy(day_text(F.col(START)).alias("day")).agg(
        r6(F.avg("icu_fitness")).alias("fitness"), r6(F.avg("icu_fatigue")).alias("fatigue"),
        r6(F.coalesce(F.sum("icu_training_load"), F.lit(0.0))).alias("load"), r6(F.coalesce(F.sum("moving_time"), F.lit(0.0))).alias("seconds"),
        r6(F.sum("distance")).alias("distance"),
    )


def tsb_daily(df: DataFrame) -> DataFrame:
    return daily_metrics(df).select("day", r6(F.col("fitness") - F.col("fatigue")).alias("tsb"))


def calendar_heatmap(df: DataFrame) -> DataFrame:
    """Rides and load (minutes where no load is known) by ISO week and weekday."""
    load = F.coalesce("icu_training_load", F.col("moving_time") / 60, F.lit(0.0))
    return df.groupBy(F.weekofyear(START).alias("week"), (F.weekday(START) + 1).alias("weekday")).agg(
        F.count("*").alias("rides"), r6(F.sum(load)).alias("load")
    )


def overview_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("rides"), F.round(F.sum("distance"), 2).alias("distance"), F.round(F.sum("moving_time"), 2).alias("seconds"),
        F.round(F.sum("total_elevation_gain"), 2).alias("climb"), F.round(F.avg("distance"), 4).alias("avg_distance"),
    )


def season_monthly(df: DataFrame) -> DataFrame:
    return df.groupBy(day_text(F.date_trunc("month", F.col(START))).alias("month")).agg(
        F.count("*").alias("rides"), F.sum("icu_training_load").alias("load"), F.max(unified_ftp(df)).alias("max_ftp"),
        F.avg("icu_average_watts").alias("avg_watts"),
    )


def recent_insight(df: DataFrame, days: int = 30) -> DataFrame:
    return since(df, days).agg(
        F.count("*").alias("rides"), r6(F.sum("distance")).alias("distance"), r6(F.sum("moving_time")).alias("seconds"),
        r6(F.avg("icu_training_load")).alias("avg_load"),
    )


def ftp_gain(df: DataFrame) -> DataFrame:
    known = df.withColumn("ftp", unified_ftp(df)).where("ftp is not null")
    first, last = F.min_by("ftp", F.struct(START, "id")), F.max_by("ftp", F.struct(START, "id"))
    return known.agg(first.alias("first_ftp"), last.alias("last_ftp"), (last - first).alias("gain"), F.count("*").alias("points"))


def ftp_distinct(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct(unified_ftp(df)).alias("distinct_ftp"))


def latest_activity(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc(START), F.desc("id")).limit(1).select("id", day_text(F.col(START)).alias("day"), "name")


def report_activities(df: DataFrame) -> DataFrame:
    return df.select(
        "id", day_text(F.col(START)).alias("day"), "name", "type", r6(F.col("moving_time") / 3600).alias("duration_hours"),
        r6(F.col("distance") / 1000).alias("distance_km"), r6(F.col("icu_average_watts")).alias("avg_watts"),
        r6(F.col("average_heartrate")).alias("avg_hr"), r6(F.col("icu_training_load")).alias("load"),
    )


def summary_report(df: DataFrame) -> DataFrame:
    ftp = unified_ftp(df)
    at = F.when(ftp.isNotNull(), F.struct(START, "id"))
    return df.agg(
        F.count("*").alias("rides"), day_text(F.min(START)).alias("first_day"), day_text(F.max(START)).alias("last_day"),
        r6(F.sum("distance") / 1000).alias("km"), r6(F.sum("moving_time") / 3600).alias("hours"), r6(F.sum("icu_training_load")).alias("load"),
        F.min_by(ftp, at).alias("first_ftp"), F.max_by(ftp, at).alias("last_ftp"),
    )


def summary_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(
        F.count("*").alias("rides"), day_text(F.min(START)).alias("first_day"), day_text(F.max(START)).alias("last_day"),
        F.round(F.sum("distance"), 2).alias("distance"), F.round(F.sum("moving_time"), 2).alias("seconds"), F.count_distinct("file_source").alias("files"),
    )


def derived_units(df: DataFrame) -> DataFrame:
    return df.select(
        "id", r6(F.col("moving_time") / 3600).alias("hours"), r6(F.col("distance") / 1000).alias("km"),
        r9(F.try_divide("icu_average_watts", "average_heartrate")).alias("watts_per_beat"),
        F.round(F.try_divide(F.col("distance") * 3.6, F.col("moving_time")), 10).alias("kmh"),
    )


def date_preset(df: DataFrame, preset: str | tuple[str, str] = "90d") -> DataFrame:
    """Last 30, 90, 180 or 365 days (``"90d"``), ``"all"``, or (first day, last day), both whole."""
    if preset == "all":
        kept = df
    elif isinstance(preset, str):
        kept = since(df, int(preset.rstrip("d")))
    else:
        kept = df.where(F.col(START).cast("date").between(F.lit(preset[0]).cast("date"), F.lit(preset[1]).cast("date")))
    return kept.select("id", day_text(F.col(START)).alias("day"), "type")


# --- windows over rides -----------------------------------------------------------------------------


def _rows(a: int, b: int):
    return Window.partitionBy("athlete_id").orderBy(START, "id").rowsBetween(a, b)


def ftp_features(df: DataFrame, *also: Column | str) -> DataFrame:
    """Features of FTP models by rider: days since the first FTP ride and trailing means by rows; beside them the columns ``also``."""
    known = df.withColumn("ftp", unified_ftp(df)).where("ftp is not null")
    first = F.min(F.col(START).cast("date")).over(Window.partitionBy("athlete_id"))
    return known.select(
        "id", "athlete_id", "ftp", F.datediff(F.col(START).cast("date"), first).alias("days_training"),
        *[r9(F.avg(c).over(_rows(1 - k, 0))).alias(f"{n}_{k}") for c, n in (("icu_training_load", "load"), ("icu_intensity", "intensity")) for k in (7, 28)],
        *[r6(F.sum("moving_time").over(_rows(1 - k, 0))).alias(f"seconds_{k}") for k in (7, 28)], "icu_fitness", "icu_fatigue", *also,
    )


def ftp_estimate(df: DataFrame) -> DataFrame:
    """FTP from normalised power by ride length, filled forward, the largest of the last 20 rides."""
    minutes = F.col("moving_time") / 60
    np_ = F.when(F.col("icu_normalized_watts") != 0, F.col("icu_normalized_watts"))
    guess = np_ * F.when(minutes.between(20, 60), 0.95).when(minutes > 60, 1.0).otherwise(0.90)
    filled = df.withColumn("guess", guess).withColumn("filled", F.last("guess", ignorenulls=True).over(_rows(Window.unboundedPreceding, 0)))
    return filled.select("id", "athlete_id", r6(F.max("filled").over(_rows(-19, 0))).alias("estimated_ftp"))


def history_features(df: DataFrame) -> DataFrame:
    """Mean normalised power of the k rides before each, and 50 times their number."""
    rides = df.where("icu_normalized_watts is not null")
    return rides.select(
        "id", "athlete_id", *[r6(F.avg("icu_normalized_watts").over(_rows(-k, -1))).alias(f"np_{k}") for k in (7, 14, 28)],
        *[(F.count("*").over(_rows(-k, -1)) * 50).alias(f"load_{k}") for k in (7, 14, 28)],
    )


def power_features(df: DataFrame) -> DataFrame:
    """Ride features of power models: stress (at most 500), efficiency, variability, and history."""
    ftp = unified_ftp(df)
    np_, t = F.col("icu_normalized_watts"), F.col("moving_time")
    tss = F.coalesce(F.least(F.lit(500.0), F.try_divide(t * np_ * F.try_divide(np_, ftp), ftp * 3600) * 100), F.lit(0.0))
    own = df.select(
        "id", r9(tss).alias("tss"), r9(F.try_divide(np_, "average_heartrate")).alias("ef"), r9(F.try_divide(np_, "icu_average_watts")).alias("vi"),
        r9(t / 3600).alias("hours"), r9(F.try_divide("distance", "moving_time")).alias("speed"),
    )
    return own.join(history_features(df).drop("athlete_id"), "id")


# --- rules and forecasts -----------------------------------------------------------------------------


def readiness(df: DataFrame, days: int = 14, as_of: str | None = None) -> DataFrame:
    """Form, consistency, intensity and, where a resting heart rate is known, recovery over the last
    days (before ``as_of``, if given), their mean, and its label."""
    resting = F.avg("icu_resting_hr") if "icu_resting_hr" in df.columns else F.lit(None).cast("double")
    a = since(df, days, as_of).agg(resting.alias("resting"), F.avg("icu_fitness").alias("ctl"), F.avg("icu_fatigue").alias("atl"), F.avg("icu_intensity").alias("i"), F.count("*").alias("n"))
    tsb = F.col("ctl") - F.col("atl")
    form = (
        F.when(F.col("ctl").isNull() | F.col("atl").isNull(), 50.0)
        .when(tsb.between(-10, 5), F.least(F.lit(100.0), 90 + tsb))
        .when(tsb > 5, F.greatest(F.lit(60.0), 90 - 2 * (tsb - 5)))
        .otherwise(F.greatest(F.lit(30.0), 70 + 2 * tsb))
    )
    steady = F.least(F.lit(100.0), F.col("n") / (14.0 / 3) * 100)
    i = F.col("i")
    hard = F.when(i.isNull(), 50.0).when(i.between(0.75, 0.85), 100.0).otherwise(F.greatest(F.lit(50.0), 100 - 200 * F.least(F.abs(i - 0.75), F.abs(i - 0.85))))
    calm = F.when(F.col("resting") < 50, 100.0).when(F.col("resting") < 60, 85.0).when(F.col("resting") < 70, 70.0).when(F.col("resting").isNotNull(), 50.0)
    out = a.select(form.alias("form"), steady.alias("consistency"), hard.alias("intensity"), calm.alias("recovery"))
    overall = (F.col("form") + F.col("consistency") + F.col("intensity") + F.coalesce("recovery", F.lit(0.0))) / F.when(F.col("recovery").isNull(), 3).otherwise(4)
    advice = F.array_compact(F.array(
        F.when(F.col("form") < 50, "reduce load").when(F.col("form") <= 60, "maintain load").when(F.col("form") > 90, "excellent form"),
        F.when(F.col("consistency") < 70, "ride more often"), F.when(F.col("intensity") < 70, "adjust intensity"),
    ))
    return out.select(
        *[r6(F.col(c)).alias(c) for c in out.columns], r6(overall).alias("overall"),
        F.when(overall >= 80, "ready").when(overall >= 60, "moderate").otherwise("rest").alias("level"), F.array_join(advice, "; ").alias("advice"),
    )


def race_prediction(df: DataFrame, hours: float = 2.0) -> DataFrame:
    """Power for a race of so many hours from the latest FTP, and confidence from similar rides."""
    factor = 0.95 if hours <= 1 else 0.90 if hours <= 2 else 0.85 if hours <= 3 else 0.80 if hours <= 4 else 0.75
    ftp = F.coalesce("icu_ftp", "threshold_power")
    a = df.agg(
        F.max_by(ftp, F.when(ftp.isNotNull(), F.struct(START, "id"))).alias("ftp"),
        F.count_if(F.col("moving_time").between(0.7 * hours * 3600, 1.3 * hours * 3600)).alias("similar"),
    )
    avg = F.col("ftp") * factor
    np_ = avg * 1.07
    return a.select(
        "ftp", r6(avg).alias("avg_watts"), r6(np_).alias("np_watts"), r6(hours * 3600 * np_ * (np_ / F.col("ftp")) / (F.col("ftp") * 3600) * 100).alias("tss"),
        "similar", F.when(F.col("similar") >= 3, "High").when(F.col("similar") >= 1, "Medium").otherwise("Low").alias("confidence"),
    )


def season_forecast(df: DataFrame, months: int = 3) -> DataFrame:
    """Straight lines through the present months (gaps are not filled), carried on; at least three
    months are needed."""
    monthly = season_monthly(df).withColumn("x", (F.row_number().over(Window.orderBy("month")) - 1).cast("double"))
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in ("rides", "load", "max_ftp", "avg_watts")]))
    long = monthly.select("x", metrics.alias("m")).select("x", "m.metric", "m.y")
    fit = long.groupBy("metric").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"), F.regr_r2("y", "x").alias("r2"),
        F.count("y").alias("n"), (F.max("x") + 1).alias("next_x"),
    ).where("n >= 3")
    ahead = F.explode(F.sequence(F.lit(1), F.lit(months))).alias("ahead")
    value = F.col("base") + F.col("slope") * (F.col("next_x") + F.col("ahead") - 1)
    trend = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable")
    return fit.select("*", ahead).select(
        "metric", "ahead", F.round("slope", 4).alias("slope"), F.round("r2", 4).alias("r2"), F.round(value, 4).alias("predicted"), trend.alias("trend")
    )


def zscores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standard scores with the population deviation; a constant column gives null."""
    sums = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns])
    s = sums.select(F.struct(*columns).alias("s")).scalar()
    return df.select("id", *[r6(F.try_divide(F.col(c) - s[c]["m"], s[c]["s"])).alias(f"z_{c}") for c in columns])


# --- charts ------------------------------------------------------------------------------------------


def power_comparison(df: DataFrame) -> DataFrame:
    """Means of average, normalised and largest power and of the variability index, one row."""
    vi = F.try_divide("icu_normalized_watts", "icu_average_watts")
    return df.agg(
        r6(F.avg("icu_average_watts")).alias("avg_watts"), r6(F.avg("icu_normalized_watts")).alias("np_watts"), r6(F.avg("max_power")).alias("max_watts"),
        r6(F.avg(vi)).alias("variability"),
    )


def monthly_trends(df: DataFrame) -> DataFrame:
    """By month: mean normalised power, watts a beat and heart rate."""
    return df.groupBy(day_text(F.date_trunc("month", F.col(START))).alias("month")).agg(
        r6(F.avg("icu_normalized_watts")).alias("np_watts"), r6(F.avg(F.try_divide("icu_average_watts", "average_heartrate"))).alias("watts_per_beat"),
        r6(F.avg("average_heartrate")).alias("heart_rate"),
    )


def heart_histogram(df: DataFrame, width: int = 5) -> DataFrame:
    """Rides by mean heart rate in bins of ``width`` beats; unknown ones are left out."""
    return df.where("average_heartrate is not null").groupBy((F.floor(F.col("average_heartrate") / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("rides"))
