"""Commands over a store of rides: ingest, sync, garmin, reprocess, report, dashboard, quality, predict, train.

    python -m wattloom.cli ingest --store DIR --incoming DIR [--archive DIR] [--file NAME] [--dry-run]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wattloom.operators import activity, dedup, forecast, normalize, quality
from wattloom.schema import conform
from wattloom.sources import files, fit
from wattloom.store import RideStore, archive_file, export_csv, summary_text


def typed(df):
    """Stored rides with the start as a wall clock and nulls for what no export held."""
    return df.withColumn("start_date_local", F.try_to_timestamp("start_date_local").cast("timestamp_ntz")).withColumns(
        {c: F.lit(None).cast("double") for c in ("threshold_power", "functional_threshold_power", "max_power") if c not in df.columns}
    )


def ingest(spark: SparkSession, args) -> dict:
    """New files only (by hash), united, deduplicated, checked, saved and archived; every file's steps
    are kept, and files of a batch that fails stand as failed."""
    store = RideStore(spark, args.store)
    listed = files.list_files(spark, args.incoming, args.file or "*.csv").join(files.file_hashes(spark, args.incoming, args.file or "*.csv"), "file_name")
    todo = [(r.file_name, r.file_hash) for r in store.unprocessed(listed).select("file_name", "file_hash").orderBy("file_name").collect()]
    names = [n for n, _ in todo]
    done: dict = {"files": names}
    if args.dry_run or not todo:
        return done
    again = [r["file_name"] for r in store.steps().where(F.col("file_name").isin(names)).groupBy("file_name").agg(F.max_by("status", "step").alias("s")).where("s = 'ARCHIVED'").collect()]
    tracked = [n for n in names if n not in again]  # a name that comes again with new content keeps its way
    store.set_status(tracked, "PROCESSING")
    cols = "file_hash string, file_name string, status string, error_message string"
    record = lambda status, error: store.record_ingestion(
        spark.createDataFrame([(h, n, status, error) for n, h in todo], cols).withColumn("ingestion_timestamp", F.current_timestamp())
    )
    try:
        paths = [f"{args.incoming}/{n}" for n in names]
        every = conform(files.read_all(spark, spark.read.format("binaryFile").load(paths)))
        every = every.withColumn("row_id", F.xxhash64("id", "file_source", "start_date_local"))
        kept = every.join(dedup.resolve(every), ["row_id", "id"], "left_semi")
        done |= store.save(kept, least_quality=args.least_quality)
    except Exception as e:
        store.set_status(tracked, "ERROR", error=str(e).split("\n")[0])
        record("error", str(e).split("\n")[0])
        raise
    record("success", None)
    store.set_status(tracked, "SUCCESS", new_activities=done["saved"])
    if args.archive:
        for n in names:
            archive_file(f"{args.incoming}/{n}", args.archive, args.strategy)
        store.set_status(tracked, "ARCHIVED")
    return done


def sync(spark: SparkSession, args) -> dict:
    """Rides of a service's list, fetched into JSON files beforehand."""
    rides = files.activities_from_json(spark.read.option("multiLine", args.multiline).json(args.json))
    return RideStore(spark, args.store).save(rides.withColumn("file_source", F.lit("api")).withColumn("import_timestamp", F.current_timestamp()))


def garmin(spark: SparkSession, args) -> dict:
    """Rides of the vendor's list under the common names, with empty fields filled from their other names."""
    rows = files.vendor_activities(spark.read.option("multiLine", args.multiline).json(args.json))
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in normalize.FALLBACKS if c not in rows.columns})
    rows = normalize.consolidate(rows, {c: f for c, f in normalize.FALLBACKS.items() if f in rows.columns})
    rows = rows.withColumn("start_date_local", F.date_format("start_date_local", "yyyy-MM-dd'T'HH:mm:ss"))
    return RideStore(spark, args.store).save(rows.withColumn("file_source", F.col("source")).withColumn("import_timestamp", F.current_timestamp()))


def reprocess(spark: SparkSession, args) -> dict:
    """Device files read again and merged into the stored rides."""
    store = RideStore(spark, args.store)
    merged = normalize.fit_merge(store.read().drop("bucket", "has_fit_data"), fit.sessions(fit.read_fit(spark, args.files)).withColumn("session_id", F.col("data_points")))
    return store.save(merged.where("has_fit_data").drop("updated_at"), refresh_metrics=True)


def dashboard(spark: SparkSession, args) -> list[str]:
    """The tables behind the dashboard as CSV folders."""
    rides = typed(RideStore(spark, args.store).read())
    tables = {"kpis": activity.overview_kpis(rides), "calendar": activity.calendar_heatmap(rides), "daily": activity.daily_metrics(rides), "summary": activity.summary_stats(rides)}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{args.out}/{name}")
    return [f"{args.out}/{n}" for n in tables]


def report(spark: SparkSession, args) -> str:
    rides = typed(RideStore(spark, args.store).read())
    if args.out:
        export_csv(rides, args.out)
    return summary_text(rides)


def check(spark: SparkSession, args) -> dict:
    rides = RideStore(spark, args.store).read()
    return quality.quality_score(rides).first().asDict() | quality.validation_report(rides).first().asDict()


def predict(spark: SparkSession, args) -> list[dict]:
    rides = typed(RideStore(spark, args.store).read()).withColumn("athlete_id", F.coalesce("athlete_id", F.lit("me")))
    return [r.asDict() for r in forecast.ftp_forecast(rides, args.days).where("day % 7 = 0").collect()] + [activity.readiness(rides).first().asDict()]


def train(spark: SparkSession, args) -> list[dict]:
    """Models of FTP where any is known, else of normalised power."""
    rides = typed(RideStore(spark, args.store).read()).withColumn("athlete_id", F.coalesce("athlete_id", F.lit("me")))
    if args.model:
        return forecast.train_and_save(rides, args.model)
    if rides.where("icu_ftp is not null").isEmpty():
        return [r.asDict() for r in forecast.power_models(rides).collect()]
    return [{"model": k, "r2": v} for k, v in forecast.cross_validated(forecast.training_rows(rides), forecast.FEATURES).items()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wattloom", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    commands = {
        "ingest": ingest, "sync": sync, "garmin": garmin, "reprocess": reprocess, "report": report, "dashboard": dashboard, "quality": check, "predict": predict,
        "train": train,
    }
    for name, f in commands.items():
        s = sub.add_parser(name)
        s.set_defaults(run=f)
        s.add_argument("--store", required=True)
        if name == "ingest":
            s.add_argument("--incoming", required=True)
            s.add_argument("--archive")
            s.add_argument("--strategy", default="MOVE")
            s.add_argument("--file")
            s.add_argument("--dry-run", action="store_true")
            s.add_argument("--least-quality", type=float)
        if name in ("sync", "garmin"):
            s.add_argument("--json", required=True)
            s.add_argument("--multiline", action="store_true")
        if name == "reprocess":
            s.add_argument("--files", required=True)
        if name in ("report", "dashboard"):
            s.add_argument("--out", required=name == "dashboard")
        if name == "train":
            s.add_argument("--model", help="save the best model here")
        if name == "predict":
            s.add_argument("--days", type=int, default=30)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"wattloom {args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = args.run(spark, args)
    print(out if isinstance(out, str) else json.dumps(out, default=str))


if __name__ == "__main__":
    main()
