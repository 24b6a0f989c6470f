"""Queries of the record-processing problems 1, 4, 5, 6 and 7, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators import grid, instants, spikes, trailing, units
from wattloom.session import table

DAY = "yyyy-MM-dd"


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "fit_records")
    return grid.regular_grid(records, source="activity_id", ts="timestamp", fields=["power", "heart_rate"]).withColumnRenamed(
        "source_id", "activity_id"
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "fit_records")
    series = grid.regular_grid(records, source="activity_id", ts="timestamp", fields=["power", "heart_rate"])
    return grid.missing_periods(series).withColumnRenamed("source_id", "activity_id")


def _pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.ride_pace(table(spark, sf_dir, "fit_sessions"), table(spark, sf_dir, "activities"))


def p4_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the four quantities in its common unit."""
    pace = _pace(spark, sf_dir)
    records = table(spark, sf_dir, "fit_records")
    fields = ["speed", "distance", "position_lat"]
    wide = units.recording_units(records, pace).groupBy("activity_id").pivot("field_name", fields).agg(F.first("unit_name"))
    wide = wide.select("activity_id", *[F.col(f).alias(f"unit_{f}") for f in fields])
    joined = records.select("record_id", "activity_id", *fields).join(wide, "activity_id")
    pairs = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), F.col(f"unit_{f}").alias("unit_name")) for f in fields]
    rows = joined.select(F.lit("fit_records").alias("source_table"), F.col("record_id").alias("row_key"), F.explode(F.array(*pairs)).alias("x"))
    rows = rows.select("source_table", "row_key", "x.*")
    texts = units.text_units(table(spark, sf_dir, "raw_records"), pace).select(
        F.lit("raw_records").alias("source_table"), F.col("raw_id").alias("row_key"), "field_name", F.col("number").alias("value"), "unit_name"
    )
    share = F.col("left_right_balance")
    sessions = table(spark, sf_dir, "fit_sessions").select(
        F.lit("fit_sessions").alias("source_table"), F.col("session_id").alias("row_key"), F.lit("left_right_balance").alias("field_name"),
        share.alias("value"), units.balance_unit(share).alias("unit_name"),
    )
    every = rows.unionByName(texts).unionByName(sessions).where("value is not null and not isnan(value)")
    return units.to_canonical(every, quantity="field_name", unit="unit_name", value="value", out="common_value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pace = _pace(spark, sf_dir)
    recordings = units.recording_units(table(spark, sf_dir, "fit_records"), pace).select(
        F.lit("fit_records").alias("source_table"), F.col("activity_id").alias("row_key"), "field_name", "unit_name"
    )
    sessions = table(spark, sf_dir, "fit_sessions").select(
        F.lit("fit_sessions").alias("source_table"), F.col("session_id").cast("string").alias("row_key"),
        F.lit("left_right_balance").alias("field_name"), units.balance_unit(F.col("left_right_balance")).alias("unit_name"),
    )
    texts = units.text_units(table(spark, sf_dir, "raw_records"), pace).select(
        F.lit("raw_records").alias("source_table"), F.col("raw_id").cast("string").alias("row_key"), "field_name", "unit_name"
    )
    known = F.broadcast(units.conversion_table(spark).where("source_unit != target_unit").select(F.col("quantity").alias("field_name"), F.col("source_unit").alias("unit_name")))
    return recordings.unionByName(sessions).unionByName(texts).join(known, ["field_name", "unit_name"], "left_semi").select(
        "source_table", "row_key", "field_name", "unit_name"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = instants.activity_instants(table(spark, sf_dir, "activities"), table(spark, sf_dir, "athletes"))
    readings = instants.reading_instants(table(spark, sf_dir, "raw_records"), starts)
    a = starts.select(F.lit("activities").alias("source_table"), F.col("row_id").alias("row_key"), "utc_s")
    b = readings.select(F.lit("raw_records").alias("source_table"), F.col("raw_id").alias("row_key"), "utc_s")
    return a.unionByName(b).where("utc_s is not null")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities = table(spark, sf_dir, "activities")
    starts = instants.activity_instants(activities, table(spark, sf_dir, "athletes"))
    loads = activities.select("row_id", F.col("icu_training_load").alias("load"), F.col("moving_time").alias("seconds"))
    joined = starts.join(loads, "row_id")
    ride = F.coalesce(F.col("id"), F.concat(F.lit("row "), F.col("row_id")))
    first = joined.groupBy(ride.alias("ride")).agg(
        F.min(F.struct("row_id", "athlete_id", F.col("wall").cast("date").alias("day"), "load", "seconds")).alias("x")
    )
    return trailing.trailing_totals(first.select("x.athlete_id", "x.day", "x.load", "x.seconds"))


def p6_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).withColumn("day", F.date_format("day", DAY)).withColumnRenamed("day", "ride_day")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = trailing.peaks_and_rests(_daily(spark, sf_dir))
    return marked.select("athlete_id", F.date_format("day", DAY).alias("ride_day"), "measure")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, sf_dir, "fit_records")).select("record_id", "field_name")


def p7_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad readings by device, field and reason against all readings of the device."""
    records = table(spark, sf_dir, "fit_records")
    bad = spikes.implausible_readings(records).join(records.select("record_id", "serial_number"), "record_id")
    fields = list(spikes.LIMITS)
    totals = records.groupBy("serial_number").agg(*[F.count(f).alias(f) for f in fields])
    totals = totals.select("serial_number", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("readings")) for f in fields])).alias("x"))
    totals = totals.select("serial_number", "x.*")
    counts = bad.groupBy("serial_number", "field_name").agg(
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("impossible", "spike", "stuck")]
    )
    return totals.join(counts, ["serial_number", "field_name"], "left").fillna(0, ["impossible", "spike", "stuck"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_grid, p4_found, p4_converted, p5_found, p6_found, p6_trailing, p7_found, p7_by_device)}
