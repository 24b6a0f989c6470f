"""Queries of problems 2, 3, 8, 9 and 10, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import timetext
from wattloom.llm import cuts, history, leaks, match, packing, sql
from wattloom.operators import instants
from wattloom.session import table


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.activity_instants(table(spark, sf_dir, "activities"), table(spark, sf_dir, "athletes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = history.same_file(table(spark, sf_dir, "ingestion_history"))
    rides = history.same_rides(history.ride_vectors(_starts(spark, sf_dir), table(spark, sf_dir, "activities")))
    return files.select(F.lit("file").alias("dup_level"), "key_a", "key_b").unionByName(
        rides.select(F.lit("activity").alias("dup_level"), "key_a", "key_b")
    )


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities = table(spark, sf_dir, "activities").where("id is not null")
    wanted = {
        "distance": "distance", "moving_time": "moving_time", "elapsed_time": "elapsed", "average_heartrate": "heart_rate",
        "icu_average_watts": "power", "total_elevation_gain": "climb", "name": "name",
    }
    sizes = activities.select("row_id", *[F.col(c).alias(a) for c, a in wanted.items()])
    wall = timetext.wall_seconds(F.col("wall")).alias("start_s")
    rides = _starts(spark, sf_dir).where("id is not null").select("row_id", F.col("id").alias("key"), wall).join(sizes, "row_id")
    left = rides.groupBy("key").agg(F.min(F.struct("row_id", "start_s", *wanted.values())).alias("x")).select("key", "x.*").drop("row_id")
    device = table(spark, sf_dir, "garmin_activities").where("garmin_activity_id is not null")
    renamed = device.select(
        F.col("garmin_activity_id").alias("key"), timetext.wall_seconds(F.col("start_date_local")).alias("start_s"), "distance",
        F.col("moving_time"), F.col("elapsed_duration").alias("elapsed"), F.col("average_hr").alias("heart_rate"),
        F.col("average_power").alias("power"), F.col("elevation_gain").alias("climb"), F.col("activity_name").alias("name"),
    )
    rest = [c for c in renamed.columns if c != "key"]
    right = renamed.groupBy("key").agg(F.min(F.struct(*rest)).alias("x")).select("key", "x.*")
    return match.match_rides(left, right)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select(F.col("l_key").alias("id"), F.col("r_key").alias("garmin_activity_id"))


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select(F.col("l_key").alias("id"), F.col("r_key").alias("garmin_activity_id"), "score", "confidence")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = packing.token_sizes(table(spark, sf_dir, "documents"))
    return packing.fill_containers(sizes, table(spark, sf_dir, "pack_targets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, sf_dir))


def p9_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p9_regions(spark, sf_dir).where(F.col("run_words") >= leaks.LEAST_WORDS)
    return found.select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.cut_scores(table(spark, sf_dir, "documents")).where("log_odds > 0").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.rates(cuts.cut_scores(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p3_found, p3_confidence, p8_packed, p8_fill, p9_found, p9_regions, p10_found, p10_rates)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
