"""Duplicate rides by id and by fingerprint, resolution, and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact(df: DataFrame) -> DataFrame:
    """Every row with its id's count and first and last import. Null ids meet nothing: their count is
    null and they are no duplicates."""
    counts = df.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.count("*").alias("copies"), F.min("import_timestamp").alias("first_import"), F.max("import_timestamp").alias("last_import")
    )
    return df.select("row_id", "id").join(counts, "id", "left").select(
        "row_id", "id", "copies", F.unix_micros("first_import").alias("first_import_us"), F.unix_micros("last_import").alias("last_import_us"),
        F.coalesce(F.col("copies") > 1, F.lit(False)).alias("is_duplicate"),
    )


def fingerprint():
    """Start, type, and rounded distance and time; null where any of them is."""
    return F.concat(
        F.col("start_date_local"), F.lit("|"), F.col("type"), F.lit("|"), F.round("distance").cast("long").cast("string"), F.lit("|"),
        F.col("moving_time").cast("string"),
    )


def potential(df: DataFrame) -> DataFrame:
    """Rows that share a fingerprint without sharing an id."""
    rows = df.select("row_id", "id", fingerprint().alias("print"))
    prints = rows.where("print is not null").groupBy("print").agg(F.count("*").alias("n"))
    ids = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("copies"))
    marked = rows.join(prints, "print", "left").join(ids, "id", "left")
    flag = F.coalesce((F.col("n") > 1) & ~(F.coalesce(F.col("copies"), F.lit(1)) > 1), F.lit(False))
    return marked.select("row_id", "id", F.col("n").alias("same_print"), flag.alias("is_potential"))


def resolve(df: DataFrame, strategy: str = "keep_latest", preserve_all: bool = False) -> DataFrame:
    """One row per id by ``keep_latest`` or ``keep_first`` (or all); with ``preserve_all`` every row and
    a flag. Ids that are null are one group. Reduced by aggregation, not by sorting whole groups."""
    if strategy == "keep_all":
        return df.select("row_id", "id")
    if preserve_all:  # by the unique row_id, so that a crowd of null ids is no group of its own
        kept = resolve(df, strategy).select("row_id", F.lit(True).alias("would_keep"))
        return df.select("row_id", "id").join(kept, "row_id", "left").withColumn("would_keep", F.coalesce("would_keep", F.lit(False)))
    key = F.struct(*[F.coalesce(F.unix_micros("import_timestamp"), F.lit(2**62)).alias("t"), F.col("row_id")])
    pick = F.max_by("row_id", key) if strategy == "keep_latest" else F.min_by("row_id", key)
    return df.groupBy("id").agg(pick.alias("row_id")).select("row_id", "id")


def report(df: DataFrame) -> DataFrame:
    prints = potential(df).agg(F.count_if("is_potential").alias("potential"))
    base = df.agg(F.count("*").alias("total"), (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("unique_ids"))
    return base.select("total", "unique_ids", (F.col("total") - F.col("unique_ids")).alias("exact"), F.lit("keep_latest").alias("strategy"), prints.select("potential").scalar().alias("potential"))


def file_sources(df: DataFrame, separator: str = "; ") -> DataFrame:
    """Sorted distinct sources of each id, worked out before any row is dropped."""
    pairs = df.where("id is not null and file_source is not null").select("id", "file_source").distinct()
    return pairs.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("file_source")), separator).alias("sources"), F.count("*").alias("n_sources"))


def track_sources(df: DataFrame) -> DataFrame:
    return file_sources(df, ", ").select("id", "sources")


def summary(df: DataFrame) -> DataFrame:
    """By file: rows, and rows whose id stands more than once."""
    ids = df.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1 and id is not null").select("id", F.lit(1).alias("dup"))
    return df.select("id", "file_source").join(ids, "id", "left").groupBy("file_source").agg(F.count("*").alias("total"), F.count_if(F.col("dup") == 1).alias("duplicates"))


def ingest_order(df: DataFrame) -> DataFrame:
    """The first landed row of each id."""
    return df.groupBy("id").agg(F.min("row_id").alias("row_id")).select("row_id", "id")
