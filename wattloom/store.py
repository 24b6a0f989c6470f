"""The store of rides: idempotent upserts, ingestion history, schema evolution, time series, exports."""

from __future__ import annotations

import json
import shutil
import time
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.operators import activity, quality
from wattloom.schema import ACTIVITY_SCHEMA, conform
from wattloom.session import Files

ARCHIVE_STRATEGIES = ("MOVE", "COPY", "LEAVE", "DELETE")
#: What may follow each step of a file's way; a failed file may be tried again.
STEPS = {
    None: ("PENDING", "PROCESSING"), "PENDING": ("PROCESSING", "ERROR"), "PROCESSING": ("SUCCESS", "WARNING", "ERROR"),
    "SUCCESS": ("ARCHIVED",), "WARNING": ("ARCHIVED",), "ERROR": ("PENDING", "PROCESSING", "ARCHIVED"), "ARCHIVED": (),
}


#: Folders by hash of the key in which a table is rewritten, and versions that readers may still be scanning.
BUCKETS, KEPT_VERSIONS = 16, 3


class RideStore:
    """Tables under a folder of any file system. A table is held in buckets by hash of its key; a write
    makes new folders of the buckets it touches and then a numbered list of all current folders, so a
    reader never sees half a write, a lost job leaves the old version in place, and of two writers at once
    the second fails. The folders of the last versions stay for readers that began with them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, str(root))
        self.files.make()

    def _versions(self, name: str) -> list[str]:
        return [x for x in self.files.names() if x.startswith(f"{name}.v") and x.endswith(".json")]

    def _folders(self, name: str) -> dict[str, str]:
        """The current folder of each bucket that is not empty."""
        versions = self._versions(name)
        return json.loads(self.files.read(versions[-1])) if versions else {}

    def read(self, name: str = "rides", schema=ACTIVITY_SCHEMA, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.files.root}/{p}" for b, p in self._folders(name).items() if wanted is None or b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    @staticmethod
    def _bucket(key: str):
        return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def _touched(self, df: DataFrame, key: str) -> list[int]:
        return [r[0] for r in df.select(self._bucket(key)).distinct().collect()]  # at most BUCKETS

    def _write(self, df: DataFrame, name: str, key: str, buckets: Sequence[int]) -> None:
        """``df`` is all that the given buckets hold from now on."""
        fresh = f"{name}-{uuid.uuid4().hex}"
        df.withColumn("bucket", self._bucket(key)).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.files.root}/{fresh}")
        versions, folders = self._versions(name), self._folders(name)
        for b in buckets:
            folders.pop(str(b), None)
            if self.files.exists(f"{fresh}/bucket={b}"):
                folders[str(b)] = f"{fresh}/bucket={b}"
        number = 1 + int(versions[-1].split(".v")[1].removesuffix(".json")) if versions else 1
        self.files.write(f"{name}.v{number:012d}.json", json.dumps(folders))
        kept = [f"{name}.v{number:012d}.json", *reversed(versions)][:KEPT_VERSIONS]
        used = {p.split("/")[0] for v in kept for p in json.loads(self.files.read(v)).values()}
        for old in self.files.names():
            stale = old.startswith(f"{name}.v") and old not in kept
            if stale or (old.startswith(f"{name}-") and old not in used and old != fresh and not self._being_written(old)):
                self.files.remove(old)

    def _being_written(self, folder: str) -> bool:
        return not self.files.exists(f"{folder}/_SUCCESS")

    def save(self, rides: DataFrame, refresh_metrics: bool = False, least_quality: float | None = None) -> dict[str, int]:
        """Adds new ids and marks known ones: of a known id only updated_at, file_source and
        all_file_sources change unless ``refresh_metrics``. Repeated ids in one batch count once, the
        last imported. Rows without an id are skipped. Only the buckets of the batch's ids are read and
        rewritten. {saved, updated, skipped}."""
        if least_quality is not None:
            quality.require_quality(rides, least_quality)
        total = rides.count()
        batch = conform(rides).where("id is not null")
        newest = Window.partitionBy("id").orderBy(F.col("import_timestamp").desc_nulls_last(), F.col("file_source").desc_nulls_last())
        batch = batch.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
        buckets = self._touched(batch, "id")
        old = conform(self.read(buckets=buckets))
        names = [f.name for f in ACTIVITY_SCHEMA]
        n, o = batch.alias("n"), old.alias("o")
        both = n.join(o, F.col("n.id") == F.col("o.id"), "full")
        known, coming = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
        sources = F.concat_ws("; ", F.array_sort(F.array_distinct(F.array_compact(F.concat(
            F.split(F.coalesce("o.all_file_sources", "o.file_source", F.lit("")), "; "), F.array("n.file_source"))))))

        def column(c: str):
            fresh, kept = F.col(f"n.{c}"), F.col(f"o.{c}")
            if c == "updated_at":
                return F.when(coming, F.current_timestamp()).otherwise(kept)
            if c == "all_file_sources":
                return F.when(coming, F.regexp_replace(sources, "^; ", "")).otherwise(kept)
            if c == "file_source":
                return F.coalesce(fresh, kept)
            if c == "id":
                return F.coalesce(kept, fresh)
            return F.when(known, F.coalesce(fresh, kept) if refresh_metrics else kept).otherwise(fresh)

        if not buckets:
            return {"saved": 0, "updated": 0, "skipped": total}
        counts = Observation()
        marked = both.observe(counts, F.count_if(coming & ~known).alias("saved"), F.count_if(coming & known).alias("updated"))
        self._write(marked.select(*[column(c).alias(c) for c in names]), "rides", "id", buckets)
        saved, updated = int(counts.get["saved"]), int(counts.get["updated"])
        return {"saved": saved, "updated": updated, "skipped": total - saved - updated}

    def activities(self, start: str | None = None, end: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
        """Rides by start (an end at midnight is the whole day) and type, newest first."""
        df = self.read()
        at = F.try_to_timestamp("start_date_local")
        if start:
            df = df.where(at >= F.lit(start).cast("timestamp"))
        if end:
            whole = len(end) <= 10 or end.endswith("00:00:00")
            df = df.where(at < F.date_add(F.lit(end[:10]).cast("date"), 1)) if whole else df.where(at <= F.lit(end).cast("timestamp"))
        if kind:
            df = df.where(F.col("type") == kind)
        df = df.orderBy(at.desc_nulls_last(), "id")
        return df.limit(limit) if limit else df

    def record_ingestion(self, rows: DataFrame) -> None:
        """Attempts by file_hash; the last of a hash replaces those before. Attempts without a hash are all kept."""
        buckets = self._touched(rows, "file_hash")
        every = self.read("ingestion", rows.schema, buckets).unionByName(rows, allowMissingColumns=True).drop("bucket")
        # each attempt without a hash stands for itself
        own = F.when(F.col("file_hash").isNull(), F.monotonically_increasing_id())
        last = Window.partitionBy("file_hash", "__own").orderBy(F.col("ingestion_timestamp").desc_nulls_last())
        latest = every.withColumn("__own", own).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__own")
        if buckets:
            self._write(latest, "ingestion", "file_hash", buckets)

    def set_status(self, file_names: str | Sequence[str], status: str, error: str | None = None, **counts: int) -> None:
        """One step of one or more files' way: PENDING, PROCESSING, then SUCCESS, WARNING or ERROR, then
        ARCHIVED. A step that does not follow from the last one of every file is refused."""
        names = [file_names] if isinstance(file_names, str) else list(file_names)
        if not names:
            return
        done = self.steps().where(F.col("file_name").isin(names)).groupBy("file_name").agg(F.max_by("status", "step").alias("s"), F.max("step").alias("n"))
        before = {r["file_name"]: (r["s"], r["n"]) for r in done.collect()}
        for name in names:
            if status not in STEPS[before.get(name, (None, 0))[0]]:
                raise ValueError(f"{name}: {status} does not follow {before.get(name, (None, 0))[0]}")
        cols = "file_name string, status string, error_message string, record_count long, new_activities long, at timestamp, step int"
        now = datetime.now(timezone.utc)
        rows = [(n, status, error, counts.get("record_count"), counts.get("new_activities"), now, before[n][1] + 1 if n in before else 0) for n in names]
        fresh = self.spark.createDataFrame(rows, cols)
        buckets = self._touched(fresh, "file_name")
        steps = self.read("steps", cols, buckets).drop("bucket")
        self._write(steps.unionByName(fresh), "steps", "file_name", buckets)

    def status(self, file_name: str) -> str | None:
        """The last step of a file, null before the first."""
        steps = self.steps().where(F.col("file_name") == file_name)
        row = steps.select(F.max_by("status", "step").alias("status")).first()
        return row["status"]

    def steps(self) -> DataFrame:
        """Every step of every file."""
        return self.read("steps", "file_name string, status string, error_message string, record_count long, new_activities long, at timestamp, step int")

    def unprocessed(self, files: DataFrame) -> DataFrame:
        """Files (with file_hash) that no taken-in attempt has."""
        history = self.read("ingestion", "file_hash string, status string, ingestion_timestamp timestamp")
        return files.join(history.where(F.lower("status").isin("success", "warning")).select("file_hash"), "file_hash", "left_anti")

    def add_columns(self, df: DataFrame) -> DataFrame:
        """Stored rides with further columns by id, united by name."""
        extra = [c for c in df.columns if c not in self.read().columns]
        return self.read().join(df.select("id", *extra), "id", "left") if extra else self.read()

    def schema_version(self) -> int:
        return json.loads(self.files.read("schema.json"))["version"] if self.files.exists("schema.json") else 0

    def set_schema_version(self, version: int) -> None:
        self.files.write("schema.json", json.dumps({"version": version}), overwrite=True)


def write_time_series(records: DataFrame, path: str, buckets: int = 64) -> None:
    """Readings as one dataset by bucket of activity, so a recording is found without a file of its own."""
    bucket = F.pmod(F.xxhash64("activity_id"), F.lit(buckets))
    records.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_time_series(spark: SparkSession, path: str, activity_id: str, buckets: int = 64) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(activity_id)), F.lit(buckets))) & (F.col("activity_id") == activity_id))


def archive_file(path: str, folder: str, strategy: str = "MOVE") -> str | None:
    """Where the file is now; a name that is taken gets the time as suffix."""
    if strategy not in ARCHIVE_STRATEGIES:
        raise ValueError(strategy)
    source = Path(path)
    if strategy == "LEAVE":
        return str(source)
    if strategy == "DELETE":
        source.unlink()
        return None
    Path(folder).mkdir(parents=True, exist_ok=True)
    target = Path(folder) / source.name
    if target.exists():
        target = target.with_name(f"{source.stem}_{time.strftime('%Y%m%d_%H%M%S')}{source.suffix}")
    (shutil.move if strategy == "MOVE" else shutil.copy2)(str(source), str(target))
    return str(target)


def export_sheets(rides: DataFrame) -> dict[str, DataFrame]:
    """The report's sheets as frames."""
    return {
        "activities": activity.report_activities(rides), "weekly": activity.weekly_summary(rides, 52), "training_load": activity.training_load_periods(rides),
        "best_efforts": activity.best_efforts(rides, None, 50), "efforts_by_metric": activity.best_efforts_multi(rides), "power": activity.power_sheet(rides),
        "predictions": activity.predictions_sheet(rides),
    }


def export_csv(rides: DataFrame, folder: str, sheets: Sequence[str] = ("activities", "weekly", "best_efforts")) -> list[str]:
    """One folder of CSV files with header per sheet."""
    frames = export_sheets(rides)
    for name in sheets:
        frames[name].write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    return [f"{folder}/{n}" for n in sheets]


#: Rows that the workbook format has room for in one sheet, without the header.
SHEET_ROWS = 1_048_575


def export_excel(rides: DataFrame, path: str, rows: int = SHEET_ROWS) -> str:
    """The sheets in one workbook, or, without its library, as CSV folders beside it. What exceeds a
    sheet's room goes on in further sheets of the same name with a number."""
    try:
        import openpyxl
    except ImportError:
        export_csv(rides, str(Path(path).with_suffix("")), list(export_sheets(rides)))
        return str(Path(path).with_suffix(""))
    book = openpyxl.Workbook(write_only=True)
    for name, df in export_sheets(rides).items():
        sheet = None
        for i, row in enumerate(df.toLocalIterator()):
            if i % rows == 0:
                sheet = book.create_sheet(name if not i else f"{name}_{i // rows + 1}")
                sheet.append(df.columns)
            sheet.append(list(row))
        if sheet is None:
            book.create_sheet(name).append(df.columns)
    book.save(path)
    return path


def summary_text(rides: DataFrame) -> str:
    """The summary report as text."""
    r = activity.summary_report(rides).first()
    ready = activity.readiness(rides).first()
    gain = None if r["first_ftp"] is None else r["last_ftp"] - r["first_ftp"]
    return "\n".join([
        f"Rides: {r['rides']} from {r['first_day']} to {r['last_day']}", f"Distance: {r['km'] or 0:.1f} km, time: {r['hours'] or 0:.1f} h",
        f"Load: {r['load'] or 0:.0f}", f"FTP: {r['first_ftp']} to {r['last_ftp']} (gain {gain})",
        "Readiness: no rides" if ready is None or ready["overall"] is None else f"Readiness: {ready['overall']:.0f} ({ready['level']}){': ' + ready['advice'] if ready['advice'] else ''}",
    ])
