"""Projection, conversion and repair of ride and device fields as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions import timetext
from wattloom.operators.activity import r6
from wattloom.operators.units import balance_unit

#: Field and what it falls back to. Fixed values.
FALLBACKS = {
    "moving_time": "moving_duration", "elapsed_time": "elapsed_duration", "total_elevation_gain": "elevation_gain",
    "average_heartrate": "average_hr", "max_heartrate": "max_hr", "icu_average_watts": "average_power",
    "icu_normalized_watts": "normalized_power", "icu_training_load": "training_stress_score",
}

#: Least and greatest values of a reading's fields, null where there is no bound. Fixed values.
CONSTRAINTS = {
    "position_lat": (-90, 90), "position_long": (-180, 180), "distance": (0, None), "enhanced_speed": (0, None), "speed": (0, None),
    "heart_rate": (0, 255), "cadence": (0, 255), "fractional_cadence": (0, 255), "power": (0, 2000),
    "left_torque_effectiveness": (0, 100), "right_torque_effectiveness": (0, 100), "left_pedal_smoothness": (0, 100),
    "right_pedal_smoothness": (0, 100), "combined_pedal_smoothness": (0, 100), "temperature": (-100, 100), "grade": (-100, 100),
    "calories": (0, None), "gps_accuracy": (0, None), "vertical_oscillation": (0, None), "stance_time_percent": (0, 100),
    "stance_time": (0, None), "vertical_ratio": (0, None), "stance_time_balance": (0, 100), "step_length": (0, None),
    "battery_soc": (0, 100), "motor_power": (0, None),
}
#: Session fields that replace an activity's where they are there. Fixed values.
SESSION_OVERWRITES = (
    "threshold_power", "functional_threshold_power", "avg_cadence", "max_cadence", "avg_fractional_cadence", "max_fractional_cadence",
    "avg_temperature", "max_temperature", "left_right_balance", "avg_left_torque_effectiveness", "avg_right_torque_effectiveness",
    "avg_left_pedal_smoothness", "avg_right_pedal_smoothness", "avg_left_power_phase", "avg_right_power_phase", "avg_left_power_phase_peak",
    "avg_right_power_phase_peak", "total_anaerobic_training_effect", "total_training_effect", "intensity_factor", "training_stress_score",
    "avg_vam", "total_work",
)
#: Of these only values that are not 0 or empty count. Fixed values.
SESSION_TRUTHY = ("threshold_power", "functional_threshold_power", "avg_left_power_phase", "avg_right_power_phase", "avg_left_power_phase_peak", "avg_right_power_phase_peak")
#: Activity field and the session's that fills it where it is empty or 0. Fixed values.
SESSION_FILLS = {
    "average_power": "avg_power", "max_power": "max_power", "normalized_power": "normalized_power", "average_heartrate": "avg_heart_rate",
    "max_heartrate": "max_heart_rate",
}
#: Device fields by the names that an activity bears them under. Fixed values.
DEVICE_FIELDS = {
    "device_manufacturer": ("manufacturer", "device_manufacturer"), "device_product": ("product", "product_name", "device_product", "device_product_name"),
    "device_serial_number": ("serial_number", "device_serial_number"), "device_software_version": ("software_version", "device_software_version"),
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def falsy_fallback(a: Column, b: Column) -> Column:
    """``a`` unless it is null or 0 and ``b`` is something else."""
    return F.when(a.isNull() | (a == 0), F.when(b != 0, b).otherwise(a)).otherwise(a)


def consolidate(df: DataFrame, fallbacks: dict[str, str] | None = None) -> DataFrame:
    pairs = {a: b for a, b in (fallbacks or FALLBACKS).items() if a in df.columns and b in df.columns}
    return df.withColumns({a: falsy_fallback(F.col(a), F.col(b)) for a, b in pairs.items()})


def flags(df: DataFrame) -> DataFrame:
    some = lambda *cs: F.greatest(*[F.coalesce(F.col(c) != 0, F.lit(False)).cast("int") for c in cs], F.lit(0)) == 1
    return df.select("row_id", some("average_heartrate").alias("has_heartrate"), some("icu_average_watts", "icu_normalized_watts").alias("device_watts"))


def parsed_starts(df: DataFrame) -> DataFrame:
    """ISO starts (blank and other shapes give null) as a wall-clock text."""
    iso = F.trim("start_date_local").rlike(timetext.ISO)
    wall = timetext.read_time(F.col("start_date_local"), F.lit(False))["wall"]
    return df.select("row_id", F.when(iso, F.date_format(wall, "yyyy-MM-dd HH:mm:ss")).alias("start_text"))


def validated(df: DataFrame) -> DataFrame:
    """Each row with the reasons for which the strict model would drop it (null when it would not)."""
    reasons = F.array_compact(F.array(
        F.when(blank_to_null(F.col("id")).isNull(), "id"), F.when(blank_to_null(F.col("start_date_local")).isNull(), "start_date_local"),
        F.when(blank_to_null(F.col("name")).isNull(), "name"), F.when(blank_to_null(F.col("type")).isNull(), "type"),
    ))
    return df.select("row_id", F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).alias("missing"))


def require_valid(df: DataFrame) -> DataFrame:
    """The valid rows of ``df``; raises when there are none."""
    good = df.join(validated(df).where("missing is null").select("row_id"), "row_id", "left_semi")
    if good.isEmpty():
        raise ValueError("No valid activities")
    return good


def degrees(c: Column) -> Column:
    return F.when(F.abs(c) > 180, c * (180.0 / 2**31)).otherwise(c)


def balance(c: Column) -> Column:
    """Left share in percent, by the scale that ``units.balance_unit`` finds; NaN gives null."""
    unit = balance_unit(c)
    return (
        F.when(unit == "offset128", c - 128).when(unit == "percent_x100", c / 100).when(unit == "percent_x1000", c / 1000).when(unit == "percent", c)
    )


def fit_unit_repair(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", r6(balance(F.col("left_right_balance"))).alias("left_share"))


def fit_constraints(records: DataFrame) -> DataFrame:
    """Rows of each field that is there outside its constraints; positions are read in degrees."""
    there = [c for c in CONSTRAINTS if c in records.columns]
    sums = records.agg(*[F.count_if(_outside(c)).alias(c) for c in there])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("rejected")) for c in there])).alias("x")).select("x.*")


def _outside(c: str) -> Column:
    lo, hi = CONSTRAINTS[c]
    x = degrees(F.col(c)) if c.startswith("position_") else F.col(c)
    return F.coalesce(x < lo if hi is None else (x < lo) | (x > hi), F.lit(False))


def quarantined(records: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, violations): rows with a field outside its constraints, and the names of those fields."""
    there = [c for c in CONSTRAINTS if c in records.columns]
    broken = F.concat_ws(",", *[F.when(_outside(c), F.lit(c)) for c in there])
    return records.select(key, F.nullif(broken, F.lit("")).alias("violations")).where("violations is not null")


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), nothing) for c in columns})


def json_text(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*columns)).alias("json"))


def json_zones(df: DataFrame, column: str = "zones", prefix: str = "z") -> DataFrame:
    """Seconds of zones 1 to 7 from a JSON list of {zoneNumber, secsInZone}; malformed text and other
    numbers give null."""
    return df.select("*", *_zone_columns(column, lambda k: f"{prefix}{k}_secs"))


def _zone_columns(column: str, name) -> list[Column]:
    zones = F.from_json(F.col(column), "array<struct<zoneNumber:int,secsInZone:double>>")
    at = lambda k: F.get(F.filter(zones, lambda z: z["zoneNumber"] == k), F.lit(0))["secsInZone"]
    return [at(k).alias(name(k)) for k in range(1, 8)]


def all_zones(df: DataFrame, power: str = "power_zones", heart: str = "hr_zones") -> DataFrame:
    """The fourteen columns of zone times, z1_secs to z7_secs of power and hr_z1_secs to hr_z7_secs of
    heart rate, in place of the two lists."""
    return df.select("*", *_zone_columns(power, lambda k: f"z{k}_secs"), *_zone_columns(heart, lambda k: f"hr_z{k}_secs")).drop(power, heart)


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """One session per activity: the last parsed."""
    return sessions.where("activity_id is not null").groupBy("activity_id").agg(F.max_by(F.struct(*[c for c in sessions.columns if c != "activity_id"]), "session_id").alias("s")).select("activity_id", "s.*")


def _json_if_nested(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.to_json(F.col(c)) if kind.startswith(("array", "map", "struct")) else F.col(c)


def device_columns(sessions: DataFrame) -> dict[str, Column]:
    """What a session brings to an activity, by the activity's column, of the fields that are there: null
    where it brings nothing. Nested values become JSON, the serial number text."""
    has = set(sessions.columns)
    out = {}
    for c in SESSION_OVERWRITES:
        if c in has:
            kind = dict(sessions.dtypes)[c]
            value = _json_if_nested(sessions, c)
            out[c] = F.when(F.col(c) != 0, value) if c in SESSION_TRUTHY and not kind.startswith(("array", "map", "struct", "string")) else value
    for c, names in DEVICE_FIELDS.items():
        there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in has]
        if there:
            out[c] = F.coalesce(*there)
    for c, n in (("lap_data", "lap_data"), ("zones_config", "zones")):
        if n in has:
            out[c] = _json_if_nested(sessions, n)
    return out


def fit_merge(activities: DataFrame, sessions: DataFrame) -> DataFrame:
    """Activities with their session, found by garmin_activity_id, where there is one, else by id: a
    session's fields replace an activity's if present, power and heart rate only fill what is empty or
    0. Nested values are kept as JSON text, the serial number as text. fit_parse_error is passed on. All rows and
    columns of the activities are kept; repeated sessions count once, the last parsed."""
    s = latest_sessions(sessions)
    brought = device_columns(s)
    fills = {c: F.nullif(F.col(n), F.lit(0)) for c, n in SESSION_FILLS.items() if n in s.columns}
    error = [F.col("fit_parse_error").alias("s_fit_parse_error")] if "fit_parse_error" in s.columns else []
    s = s.select(F.col("activity_id").cast("string").alias("s_key"), *[x.alias(f"s_{c}") for c, x in (brought | fills).items()], *error)
    ids = [F.col(c).cast("string") for c in ("garmin_activity_id", "id") if c in activities.columns]
    a = activities.withColumn("s_own", F.coalesce(*ids)).join(s, F.col("s_own") == F.col("s_key"), "left")
    kinds = dict(activities.dtypes)
    out = {}
    for c in brought:
        out[c] = F.coalesce(f"s_{c}", F.col(c).cast(dict(a.dtypes)[f"s_{c}"])) if c in kinds else F.col(f"s_{c}")
    for c in fills:
        out[c] = F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(f"s_{c}").cast(kinds[c])) if c in kinds else F.col(f"s_{c}")
    if error:
        out["fit_parse_error"] = F.col("s_fit_parse_error")
    kept = [c for c in activities.columns if c not in out]
    return a.select(*kept, *[x.alias(c) for c, x in out.items()], F.col("s_key").isNotNull().alias("has_fit_data"))


def fit_update_or_join(activities: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each session the first activity whose garmin_activity_id or id it names; two equi-joins
    instead of one with OR."""
    s = sessions.where("activity_id is not null").select("session_id", F.col("activity_id").cast("string").alias("key"))
    found = [
        s.join(activities.select("row_id", F.col(c).cast("string").alias("key")), "key").select("session_id", "row_id")
        for c in ("garmin_activity_id", "id") if c in activities.columns
    ]
    return union_diagonal(*found).groupBy("session_id").agg(F.min("row_id").alias("row_id"))


def fit_flatten(sessions: DataFrame) -> DataFrame:
    """One flat row per session: every column with the prefix fit_, structs and maps a column per part
    (fit_{map}_{part}; parts of maps are all that occur, which is bounded by the zones of a device),
    arrays as their number of entries (fit_{name}_count), and has_fit_analysis."""
    out = []
    for f in sessions.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if f.name == "session_id":
            continue
        if kind == "struct":
            out += [c[p.name].alias(f"fit_{f.name}_{p.name}") for p in f.dataType.fields]
        elif kind == "map":
            parts = sorted(r[0] for r in sessions.select(F.explode(F.map_keys(c))).distinct().collect())
            out += [F.try_element_at(c, F.lit(p)).alias(f"fit_{f.name}_{p}") for p in parts]
        elif kind == "array":
            out.append(F.coalesce(F.size(c), F.lit(0)).alias(f"fit_{f.name.removesuffix('s')}_count"))
        else:
            out.append(c.alias(f"fit_{f.name}"))
    return sessions.select("session_id", *out, F.lit(True).alias("has_fit_analysis"))


def semi_existing(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select("id"), "id", "left_semi")


def anti_new_ids(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select("id"), "id", "left_anti")


def union_diagonal(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
