"""Incremental ingestion with Structured Streaming: bounded runs over new files, exactly once each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.store import RideStore


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "csv", per_trigger: int = 16, **options: str) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder)


def first_arrivals(stream: DataFrame, key: str = "id", ts: str = "import_timestamp", late: str = "1 day") -> DataFrame:
    """Each key once, the first arrival winning; state is bounded by the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what is new and ends."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_unseen(stream: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "import_timestamp") -> None:
    """Writes each key once, with the first of ``order`` among the rows that arrive together; ends when
    nothing is new. No state is kept in the stream: a micro-batch meets the keys written before, however
    late it comes. Each has a folder of its own, so one that is run again changes nothing. Null keys are
    skipped."""

    def save(df: DataFrame, batch: int) -> None:
        new = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("x")).select("x.*")
        try:
            new = new.join(df.sparkSession.read.parquet(path).where(F.col("batch") != batch).select(key), key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        new.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    kept = stream.where(F.col(key).isNotNull())
    kept.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_new(stream: DataFrame, store: RideStore, checkpoint: str) -> list[dict]:
    """Saves each micro-batch into the store; a batch that is run again changes nothing."""
    done: list[dict] = []
    stream.writeStream.foreachBatch(lambda df, _: done.append(store.save(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done


def windowed_loads(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by window and type; works on a stream and on a table."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str = "ts", gap: str = "2 hours") -> DataFrame:
    """Sessions of each user by a gap."""
    w = F.session_window(ts, gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events")).select("user_id", "w.start", "w.end", "events")
