"""Sources: exports as CSV and JSON, hashes and listings of files, and device files by a decoder."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.functions import timetext

NULL_WORDS = ("", "NA", "null", "None")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """(path, file_name, size, modified), sorted by path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file_name, file_hash): SHA-256 of each file's bytes."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_hash"))


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One export, or several with the same header: all columns as text, words for nothing as null, with
    file_source, file_hash and import_timestamp. Fails on rows of other lengths than the header's."""
    paths = [path] if isinstance(path, str) else path
    lines = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = lines.csv(paths[0]).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    df = lines.schema(schema).option("mode", "FAILFAST").option("enforceSchema", False).csv(paths) if names else lines.csv(paths)
    value = lambda n: F.when(~F.trim(F.col(f"`{n}`")).isin(*NULL_WORDS), F.col(f"`{n}`")).alias(n)
    cleaned = df.select(*[value(n) for n in names], F.col("_metadata.file_name").alias("file_source"), F.col("_metadata.file_path").alias("__p"))
    digest = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("__f"), F.sha2("content", 256).alias("file_hash"))
    return cleaned.join(digest, F.col("__p") == F.col("__f"), "left").drop("__f", "__p").withColumn("import_timestamp", F.current_timestamp())


def extract_csv(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(frame, {status, rows, error}); never raises: an unreadable file gives an empty frame and the error."""
    try:
        df = read_csv(spark, path)
        return df, {"status": "success", "rows": df.count(), "error": None}
    except Exception as e:  # noqa: BLE001
        return spark.createDataFrame([], "id string"), {"status": "error", "rows": 0, "error": str(e).split("\n")[0]}


def extract_all(spark: SparkSession, folders: list[str], pattern: str = "*.csv") -> DataFrame:
    """Every export of the folders, united by column name; headers may differ from file to file. Headers
    are read by the tasks, and files that share one are one scan."""
    return read_all(spark, spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folders))


def read_all(spark: SparkSession, binary: DataFrame) -> DataFrame:
    """The exports among these files (path, content), united by column name."""
    head = F.rtrim(F.substring_index(F.col("content").cast("string"), "\n", 1))
    alike = binary.select(F.col("path"), head.alias("head")).groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    groups = [r["paths"] for r in alike.orderBy("head").collect() if r["head"]]  # names of files only
    frames = [read_csv(spark, paths) for paths in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else spark.createDataFrame([], "id string")


def activities_from_json(df: DataFrame) -> DataFrame:
    """Rows of an API's list without those of blocked syncs, with id, start and name, newest first."""
    for c in ("id", "start_date_local", "name", "icu_sync_error"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    kept = df.where(~F.col("icu_sync_error").eqNullSafe("Strava activity"))
    wall = timetext.read_time(F.col("start_date_local"), F.lit(False))["wall"]
    return kept.withColumn("start", wall).orderBy(F.col("start").desc_nulls_last(), "id")


def vendor_time(c: Column) -> Column:
    """An instant from milliseconds since 1970 or an ISO text, else null."""
    return F.coalesce(F.timestamp_millis(c.try_cast("bigint")), F.try_to_timestamp(c))


#: Columns of vendor rows and where each comes from. Fixed values.
VENDOR_FIELDS = {
    "name": "activityName", "type": "activityType.typeKey", "sport_type": "sportTypeDTO.sportTypeKey", "timezone": "timeZoneDTO.displayName",
    "distance": "distance", "duration": "duration", "elapsed_duration": "elapsedDuration", "moving_duration": "movingDuration",
    "average_speed": "averageSpeed", "max_speed": "maxSpeed", "elevation_gain": "elevationGain", "elevation_loss": "elevationLoss",
    "average_hr": "averageHR", "max_hr": "maxHR", "calories": "calories", "bmr_calories": "bmrCalories",
    "average_cadence": "averageRunningCadenceInStepsPerMinute", "max_cadence": "maxRunningCadenceInStepsPerMinute", "average_power": "avgPower",
    "max_power": "maxPower", "normalized_power": "normPower", "training_stress_score": "trainingStressScore", "intensity_factor": "intensityFactor",
    "avg_stride_length": "avgStrideLength", "vo2_max": "vO2MaxValue", "lactate_threshold_hr": "lactateThresholdBpm",
    "device_name": "deviceDTO.displayName", "max_temperature": "maxTemp", "min_temperature": "minTemp", "start_latitude": "startLatitude",
    "start_longitude": "startLongitude", "end_latitude": "endLatitude", "end_longitude": "endLongitude", "has_polyline": "hasPolyline",
    "has_splits": "hasSplits", "pr_count": "pr",
    "avg_ground_contact_time": "summaryDTO.avgGroundContactTime", "avg_vertical_oscillation": "summaryDTO.avgVerticalOscillation",
    "avg_ground_contact_balance": "summaryDTO.avgGroundContactBalance", "avg_vertical_ratio": "summaryDTO.avgVerticalRatio",
    "training_effect": "summaryDTO.trainingEffect", "anaerobic_training_effect": "summaryDTO.anaerobicTrainingEffect",
    "avg_left_balance": "powerDTO.avgLeftBalance", "avg_right_balance": "powerDTO.avgRightBalance",
    "functional_threshold_power": "powerDTO.functionalThresholdPower", "weather_temp": "weatherDTO.temp", "weather_humidity": "weatherDTO.relativeHumidity",
    "weather_wind_speed": "weatherDTO.windSpeed", "weather_wind_direction": "weatherDTO.windDirection",
}
#: What stands for an absent value; others are null. Fixed values.
VENDOR_DEFAULTS = {c: "" for c in ("name", "type", "sport_type", "timezone")} | {
    c: 0 for c in ("distance", "duration", "elapsed_duration", "moving_duration", "average_speed", "max_speed", "elevation_gain", "elevation_loss", "pr_count")
} | {"has_polyline": False, "has_splits": False}


def vendor_activities(df: DataFrame) -> DataFrame:
    """Vendor rows with nested summaries flattened to the common names; an absent part has its default,
    else null."""
    def at(path: str) -> Column:
        kind = df.schema
        for part in path.split("."):
            kind = kind[part].dataType if isinstance(kind, T.StructType) and part in kind.names else None
        return F.lit(None) if kind is None else F.col(path)

    def column(name: str, path: str) -> Column:
        c = at(path)
        return (F.coalesce(c, F.lit(VENDOR_DEFAULTS[name])) if name in VENDOR_DEFAULTS else c).alias(name)

    number = at("activityId").cast("string")
    return df.select(
        F.concat(F.lit("garmin_"), number).alias("id"), number.alias("garmin_activity_id"), vendor_time(at("startTimeLocal").cast("string")).alias("start_date_local"),
        vendor_time(at("startTimeGMT").cast("string")).alias("start_date_gmt"), F.lit("garmin_connect").alias("source"), *[column(n, p) for n, p in VENDOR_FIELDS.items()],
    )


def read_device_files(spark: SparkSession, folder: str, decode: Callable[[bytes], list[dict]], schema: str, pattern: str = "*.fit") -> DataFrame:
    """Rows of device files by a decoder; ``schema`` names its fields. A file that cannot be decoded
    gives one row with its error. Adds file_name and the id before the first underscore."""
    names = [p.split()[0] for p in schema.split(",")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["file_name"], pdf["content"], strict=True):
                try:
                    out += [[name, name.split("_")[0].split(".")[0], None, *[r.get(n) for n in names]] for r in decode(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    out.append([name, name.split("_")[0].split(".")[0], str(e), *[None] * len(names)])
            yield pd.DataFrame(out, columns=["file_name", "activity_id", "error", *names])

    binary = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = binary.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    return named.mapInPandas(rows, f"file_name string, activity_id string, error string, {schema}")


def second_before(text: str) -> str:
    """The time one second before a written one."""
    return (datetime.fromisoformat(text) - timedelta(seconds=1)).isoformat()


def fetch_pages(fetch: Callable[[str | None], list[dict]], key: str = "start_date_local", batch: int = 100, seen: set | None = None, before: Callable = second_before) -> Iterator[dict]:
    """Rows of an API walked backwards: ``fetch(newest)`` gives a page of rows that are no newer, newest
    first. A page ends where the one before did, so rows of the same start are not lost; one that brings
    nothing new steps to ``before`` its last row. Ends with a short page. Ids already seen are skipped."""
    newest, seen = None, seen if seen is not None else set()
    while True:
        page = fetch(newest)
        fresh = [row for row in page if row.get("id") not in seen]
        for row in fresh:
            if row.get("id") not in seen:
                seen.add(row.get("id"))
                yield row
        if len(page) < batch:
            return
        last = page[-1][key]
        newest = last if fresh and last != newest else before(last)


def patient(fetch: Callable, per_minute: int = 90, tries: int = 3, wait_s: float = 1.0, clock=time.monotonic, sleep=time.sleep) -> Callable:
    """``fetch`` with at most so many calls a minute and retries with doubled waits; an error with
    ``retry_after`` (seconds) waits that long."""
    calls: list[float] = []

    def call(*args):
        for attempt in range(tries):
            now = clock()
            calls[:] = [t for t in calls if now - t < 60]
            if len(calls) >= per_minute:
                sleep(60 - (now - calls[0]))
            calls.append(clock())
            try:
                return fetch(*args)
            except Exception as e:  # noqa: BLE001
                if attempt == tries - 1:
                    raise
                sleep(getattr(e, "retry_after", wait_s * 2**attempt))

    return call
