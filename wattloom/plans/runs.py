"""Queries that run models, streams and the store; where SQL says the same, it stands beside."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.adapter import RIDES_SQL, rides
from wattloom.operators import forecast
from wattloom.session import shared_path, table
from wattloom.sources import files
from wattloom.store import RideStore, read_time_series, write_time_series
from wattloom.streaming import ingest


def m(f, *args):
    return lambda spark, sf_dir: f(rides(spark, sf_dir), *args)


def _landed(spark, sf_dir) -> str:
    """A folder of the shared one with the activities as files, in order of landing, for the streams to read."""
    path = shared_path(spark, "landed")
    rows = table(spark, sf_dir, "activities")
    rows.repartitionByRange(4, "row_id").sortWithinPartitions("row_id").write.parquet(f"{path}/rows")
    return path


def stream_ingest_dedup(spark, sf_dir):
    """Each id with its first landed row, by a bounded stream that keeps no state: each micro-batch is
    held against the rows written before."""
    path = _landed(spark, sf_dir)
    schema = table(spark, sf_dir, "activities").schema
    stream = ingest.file_stream(spark, f"{path}/rows", schema, "parquet").select("id", "row_id", "import_timestamp")
    ingest.append_unseen(stream, f"{path}/once", f"{path}/checkpoint", order="row_id")
    return spark.read.parquet(f"{path}/once").select("id", "row_id")


def stream_foreach_upsert(spark, sf_dir):
    """The store after the landed rows came in by a stream twice: a batch that comes again changes nothing."""
    path = _landed(spark, sf_dir)
    schema = table(spark, sf_dir, "activities").schema
    store = RideStore(spark, f"{path}/store")
    for turn in ("first", "again"):
        stream = ingest.file_stream(spark, f"{path}/rows", schema, "parquet")
        ingest.upsert_new(stream, store, f"{path}/checkpoint-{turn}")
    return store.read().groupBy("id").agg(F.count("*").alias("rides"), F.max("moving_time").alias("moving_time"))


def stream_hourly(spark, sf_dir):
    """Windowed loads of the events, worked out by a bounded stream in complete mode."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    path = shared_path(spark, "events")
    events.repartition(4).write.parquet(f"{path}/rows")
    stream = ingest.file_stream(spark, f"{path}/rows", events.schema, "parquet")
    save = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/hourly")
    windowed = stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"))
    windowed.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/hourly").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def csv_extract(spark, sf_dir):
    """Activities written as exports with two different headers and read back: every column as text."""
    path = shared_path(spark, "exports")
    rows = table(spark, sf_dir, "activities").where("id is not null")
    for odd, columns in ((0, ["row_id", "id", "name", "moving_time"]), (1, ["row_id", "id", "distance"])):
        rows.where(F.col("row_id") % 2 == odd).select(*columns).repartition(2, "row_id").write.option("header", True).csv(f"{path}/{odd}")
    every = files.extract_all(spark, [f"{path}/0", f"{path}/1"])
    return every.select(F.col("row_id").cast("long").alias("row_id"), "id", "name", F.col("moving_time").cast("long").alias("moving_time"), F.col("distance").cast("double").alias("distance"), (F.length("file_hash") == 64).alias("hashed"))


def json_extract(spark, sf_dir):
    """A service's list as JSON without the rows of blocked syncs."""
    path = shared_path(spark, "lists")
    rows = table(spark, sf_dir, "activities").where("id is not null")
    blocked = F.when(F.col("row_id") % 5 == 0, "Strava activity").when(F.col("row_id") % 5 == 1, "other")
    rows.select("row_id", "id", "start_date_local", "name", blocked.alias("icu_sync_error")).write.json(f"{path}/rows")
    return files.activities_from_json(spark.read.json(f"{path}/rows")).select("row_id", "id", "name")


def time_series(spark, sf_dir):
    """Readings written by bucket of their recording, and one recording read back."""
    path = shared_path(spark, "series")
    records = table(spark, sf_dir, "fit_records")
    write_time_series(records, f"{path}/rows")
    first = records.agg(F.min("activity_id")).first()[0]
    return read_time_series(spark, f"{path}/rows", first).select("record_id", "activity_id", "power")


def store_activities(spark, sf_dir):
    """Rides of the store by a range of days and a type, saved in two batches that overlap."""
    store = RideStore(spark, f"{shared_path(spark, 'store')}/rides")
    r = rides(spark, sf_dir).withColumn("athlete_id", F.col("athlete_id").cast("string"))
    store.save(r.where(F.col("id").cast("long") % 3 != 0))
    store.save(r.where(F.col("id").cast("long") % 3 != 1))
    return store.activities("1996-03-01", "1996-05-31", kind="Ride").select("id", "type", F.round("distance", 6).alias("distance"))


def file_queue(spark, sf_dir):
    """Files that no taken-in attempt has, by content; the last attempt of a hash counts."""
    store = RideStore(spark, f"{shared_path(spark, 'store')}/history")
    history = table(spark, sf_dir, "ingestion_history")
    half = history.select("id", "file_hash", "status", (F.unix_micros("ingestion_timestamp") + F.col("id")).alias("t")).withColumn("ingestion_timestamp", F.timestamp_micros("t")).drop("t")
    store.record_ingestion(half.where(F.col("id") % 2 == 0))
    store.record_ingestion(half.where(F.col("id") % 2 == 1))
    listed = F.when(F.col("id") % 4 == 0, F.concat(F.lit("new"), F.col("file_hash"))).otherwise(F.col("file_hash"))
    return store.unprocessed(history.where("file_hash is not null").select("id", listed.alias("file_hash"))).select("id", "file_hash")


def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    s = ingest.sessions(e)
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "events")


def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    w = ingest.windowed_loads(e)
    return w.select(F.unix_micros("window.start").alias("start_us"), "event_type", "events", F.round("total", 4).alias("total"))


QUERIES = {
    "csv_extract": (csv_extract, """SELECT row_id, id, CASE WHEN row_id % 2 = 0 AND trim(name) NOT IN ('', 'NA', 'null', 'None') THEN trim(name) END AS name, CASE WHEN row_id % 2 = 0 THEN moving_time END AS moving_time,
        CASE WHEN row_id % 2 = 1 THEN distance END AS distance, true AS hashed FROM activities WHERE id IS NOT NULL"""),
    "json_extract": (json_extract, "SELECT row_id, id, name FROM activities WHERE id IS NOT NULL AND row_id % 5 <> 0"),
    "time_series": (time_series, "SELECT record_id, activity_id, power FROM fit_records WHERE activity_id = (SELECT min(activity_id) FROM fit_records)"),
    "store_activities": (store_activities, f"SELECT id, type, round(distance,6) AS distance FROM ({RIDES_SQL}) WHERE type = 'Ride' AND start_date_local >= DATE '1996-03-01' AND start_date_local < DATE '1996-06-01'"),
    "file_queue": (file_queue, """WITH l AS (SELECT * FROM ingestion_history WHERE file_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY epoch_us(ingestion_timestamp) + id DESC NULLS LAST) = 1)
        SELECT * FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'new' || file_hash ELSE file_hash END AS file_hash FROM ingestion_history) WHERE file_hash IS NOT NULL AND file_hash NOT IN (SELECT file_hash FROM l WHERE lower(status) IN ('success', 'warning'))"""),
    "ftp_forecast": (m(forecast.ftp_forecast), None),
    "ftp_milestones": (m(forecast.weekly_milestones), None),
    "power_models": (m(forecast.power_models), None),
    "stream_ingest_dedup": (stream_ingest_dedup, "SELECT id, min(row_id) AS row_id FROM activities WHERE id IS NOT NULL GROUP BY id"),
    "stream_foreach_upsert": (stream_foreach_upsert, """SELECT id, 1 AS rides, moving_time FROM activities WHERE id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY import_timestamp DESC NULLS LAST, file_source DESC NULLS LAST) = 1"""),
    "stream_windows": (stream_hourly, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2"),
    "event_sessions": (event_sessions, """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM n GROUP BY user_id, k"""),
    "event_windows": (event_windows, "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS events, round(sum(value),4) AS total FROM events GROUP BY 1, 2"),
}
