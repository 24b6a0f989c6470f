"""Ride-level view over the order tables: one row per order, with metrics from its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.session import table

ZONES = [f"z{k}_secs" for k in range(1, 8)]


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; orders without lines have null metrics."""
    q = F.col("l_quantity").cast("double")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(q).alias("qty"), F.avg(q).alias("avg_q"), F.sqrt(F.avg(q * q)).alias("rms_q"), F.max(q).alias("max_q"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("disc_amt"), F.avg("l_linenumber").alias("avg_ln"),
        F.max("l_linenumber").alias("max_ln"), F.avg("l_discount").alias("avg_d"),
        *[F.sum(F.when(F.col("l_linenumber") == k, q * 60)).alias(f"z{k}_secs") for k in range(1, 8)],
    )
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.join(lines, key == F.col("l_orderkey"), "left").select(
        key.cast("string").alias("id"), F.col("o_custkey").alias("athlete_id"), F.col("o_orderdate").alias("start_date_local"),
        F.concat(F.lit("Ride "), key.cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "Ride").when(F.col("o_orderstatus") == "O", "VirtualRide").otherwise("Run").alias("type"),
        (F.col("qty") * 60).alias("moving_time"), (F.col("qty") * 66).alias("elapsed_time"), F.col("o_totalprice").cast("double").alias("distance"),
        F.col("disc_amt").cast("double").alias("total_elevation_gain"), (F.col("avg_q") * 8).alias("icu_average_watts"),
        (F.col("rms_q") * 8).alias("icu_normalized_watts"), (F.col("max_q") * 12).alias("max_power"),
        (100 + F.col("avg_ln") * 10).alias("average_heartrate"), (110 + F.col("max_ln") * 10).alias("max_heartrate"),
        F.col("qty").alias("icu_training_load"), (0.5 + F.col("avg_d") * 5).alias("icu_intensity"),
        (40 + F.col("o_custkey") % 30).cast("double").alias("icu_fitness"), (30 + key % 40).cast("double").alias("icu_fatigue"),
        F.when(key % 3 == 0, (200 + key % 100).cast("double")).alias("icu_ftp"),
        F.when(key % 5 == 0, (205 + key % 90).cast("double")).alias("threshold_power"),
        F.when(key % 7 == 0, (210 + key % 80).cast("double")).alias("functional_threshold_power"),
        *ZONES, F.concat(F.lit("file"), (key % 4).cast("string"), F.lit(".csv")).alias("file_source"), F.col("o_orderdate").alias("import_timestamp"),
    )


#: The same view for DuckDB.
RIDES_SQL = """
SELECT CAST(o.o_orderkey AS VARCHAR) AS id, o.o_custkey AS athlete_id, o.o_orderdate AS start_date_local,
 'Ride ' || CAST(o.o_orderkey AS VARCHAR) AS name,
 CASE o.o_orderstatus WHEN 'F' THEN 'Ride' WHEN 'O' THEN 'VirtualRide' ELSE 'Run' END AS type,
 l.qty * 60 AS moving_time, l.qty * 66 AS elapsed_time, CAST(o.o_totalprice AS DOUBLE) AS distance, l.disc_amt AS total_elevation_gain,
 l.avg_q * 8 AS icu_average_watts, l.rms_q * 8 AS icu_normalized_watts, l.max_q * 12 AS max_power,
 100 + l.avg_ln * 10 AS average_heartrate, 110 + l.max_ln * 10 AS max_heartrate, l.qty AS icu_training_load,
 0.5 + l.avg_d * 5 AS icu_intensity, CAST(40 + o.o_custkey % 30 AS DOUBLE) AS icu_fitness, CAST(30 + o.o_orderkey % 40 AS DOUBLE) AS icu_fatigue,
 CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(200 + o.o_orderkey % 100 AS DOUBLE) END AS icu_ftp,
 CASE WHEN o.o_orderkey % 5 = 0 THEN CAST(205 + o.o_orderkey % 90 AS DOUBLE) END AS threshold_power,
 CASE WHEN o.o_orderkey % 7 = 0 THEN CAST(210 + o.o_orderkey % 80 AS DOUBLE) END AS functional_threshold_power,
 l.z1_secs, l.z2_secs, l.z3_secs, l.z4_secs, l.z5_secs, l.z6_secs, l.z7_secs,
 'file' || CAST(o.o_orderkey % 4 AS VARCHAR) || '.csv' AS file_source, o.o_orderdate AS import_timestamp
FROM orders o LEFT JOIN (
 SELECT l_orderkey, sum(CAST(l_quantity AS DOUBLE)) AS qty, avg(CAST(l_quantity AS DOUBLE)) AS avg_q,
  sqrt(avg(CAST(l_quantity AS DOUBLE) * l_quantity)) AS rms_q, CAST(max(l_quantity) AS DOUBLE) AS max_q,
  sum(CAST(l_extendedprice AS DOUBLE) * l_discount) AS disc_amt, avg(l_linenumber) AS avg_ln, max(l_linenumber) AS max_ln, avg(l_discount) AS avg_d,
  sum(CASE WHEN l_linenumber = 1 THEN l_quantity * 60.0 END)::DOUBLE AS z1_secs, sum(CASE WHEN l_linenumber = 2 THEN l_quantity * 60.0 END)::DOUBLE AS z2_secs,
  sum(CASE WHEN l_linenumber = 3 THEN l_quantity * 60.0 END)::DOUBLE AS z3_secs, sum(CASE WHEN l_linenumber = 4 THEN l_quantity * 60.0 END)::DOUBLE AS z4_secs,
  sum(CASE WHEN l_linenumber = 5 THEN l_quantity * 60.0 END)::DOUBLE AS z5_secs, sum(CASE WHEN l_linenumber = 6 THEN l_quantity * 60.0 END)::DOUBLE AS z6_secs,
  sum(CASE WHEN l_linenumber = 7 THEN l_quantity * 60.0 END)::DOUBLE AS z7_secs
 FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
"""
