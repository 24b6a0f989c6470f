"""Schemas, conforming of input to them, and column types from column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, D, S, B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()

ACTIVITY_SCHEMA = T.StructType(
    [T.StructField(n, S) for n in (
        "id", "athlete_id", "garmin_activity_id", "start_date_local", "name", "type", "file_source", "file_hash", "all_file_sources",
        "device_manufacturer", "device_product", "device_serial_number", "device_software_version", "lap_data", "zones_config", "fit_parse_error",
    )]
    + [T.StructField(n, L) for n in ("moving_time", "elapsed_time", "average_heartrate", "max_heartrate", "icu_average_watts", "icu_normalized_watts", "icu_training_load")]
    + [T.StructField(n, D) for n in ("distance", "total_elevation_gain", "average_speed", "icu_intensity", "icu_ftp", "icu_fitness", "icu_fatigue")]
    + [T.StructField(n, D) for n in (
        "average_power", "max_power", "normalized_power", "threshold_power", "functional_threshold_power", "avg_cadence", "max_cadence", "avg_temperature",
        "max_temperature", "left_right_balance", "avg_left_torque_effectiveness", "avg_right_torque_effectiveness", "avg_left_pedal_smoothness",
        "avg_right_pedal_smoothness", "total_training_effect", "total_anaerobic_training_effect", "intensity_factor", "training_stress_score", "avg_vam", "total_work",
    )]
    + [T.StructField(f"{p}z{k}_secs", D) for p in ("", "hr_") for k in range(1, 8)]
    + [T.StructField("has_fit_data", B), T.StructField("import_timestamp", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)

# Words in column names that decide the stored type, in order of precedence.
REAL_WORDS = (
    "moving_time", "distance", "elapsed_time", "elevation_gain", "elevation_loss", "speed", "pace", "watts", "power", "joules", "intensity", "load",
    "fitness", "fatigue", "variability", "efficiency", "cadence", "weight", "compliance", "temperature", "oscillation", "stride", "contact_time",
    "contact_balance", "vertical_ratio", "duration", "normalized", "factor", "score", "vo2", "threshold",
)
INTEGER_WORDS = ("heartrate", "hr", "ftp", "lthr", "bpm", "calories", "count", "secs", "seconds", "lap_count", "event_count", "data_points")
BOOLEAN_STARTS = ("has_", "is_", "trainer", "commute", "race", "ignore", "device_watts")
TIMESTAMP_WORDS = ("date", "timestamp", "created_at", "updated_at", "import_timestamp")
DEVICE_REAL_WORDS = ("avg", "max", "min", "std", "normalized", "vi", "gain")
DEVICE_INTEGER_WORDS = ("count", "points")


def type_of_name(name: str) -> T.DataType:
    """The type of a new column by its name; what no word decides is text."""
    n = name.lower()
    rules = [(REAL_WORDS, D), (INTEGER_WORDS, L), (BOOLEAN_STARTS, B), (TIMESTAMP_WORDS, T.TimestampType())]
    for words, kind in rules:
        if n.startswith(words) if kind == B else any(w in n for w in words):
            return kind
    if n.startswith("fit_"):
        for words, kind in ((DEVICE_REAL_WORDS, D), (DEVICE_INTEGER_WORDS, L)):
            if any(w in n for w in words):
                return kind
    return L if n.startswith("hr_z") else S


def present_columns(df: DataFrame, schema: T.StructType = ACTIVITY_SCHEMA) -> list[str]:
    return [f.name for f in schema if f.name in df.columns]


def conform(df: DataFrame, schema: T.StructType = ACTIVITY_SCHEMA) -> DataFrame:
    """The schema's columns with its types; missing ones and values that do not convert are null,
    other columns are dropped."""
    kinds = dict(df.dtypes)

    def one(f: T.StructField):
        if f.name not in kinds:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{f.name}`")
        if f.dataType in (L, D):
            number = c.try_cast("double")
            number = F.when(~F.isnan(number), number)
            return (number if f.dataType == D else F.when(F.abs(number) < 9e18, F.round(number)).cast(L)).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in schema])
