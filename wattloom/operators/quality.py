"""Quality scores, range and consistency checks and profiles, as long tables from single passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.operators.activity import r6

CORE = ("id", "name", "type", "start_date_local", "moving_time", "distance")
EXPECTED = ("total_elevation_gain", "average_heartrate")
#: Columns that tell of a power meter. Fixed values.
POWER = (
    "icu_average_watts", "icu_training_load", "threshold_power", "avg_cadence", "avg_temperature", "left_right_balance", "normalized_power",
)
#: Least and greatest plausible values. Fixed values.
RANGES = {
    "distance": (0, 1000000), "moving_time": (0, 86400), "elapsed_time": (0, 86400), "total_elevation_gain": (0, 10000),
    "average_heartrate": (50, 220), "max_heartrate": (80, 250), "average_speed": (0, 30), "max_speed": (0, 50),
    "average_cadence": (30, 180), "max_cadence": (50, 220), "average_watts": (0, 2000), "max_watts": (0, 3000),
    "normalized_power": (0, 2000), "weighted_average_power": (0, 2000), "training_stress_score": (0, 1000),
    "intensity_factor": (0, 2.0), "calories": (0, 10000),
}
#: Words that stand for a truth value. Fixed values.
TRUTHS = ("true", "false", "1", "0", "yes", "no", "t", "f")
#: Shapes of dates. Fixed values.
DATETIMES = (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}")
#: Columns of which the first may not exceed the second. Fixed values.
ORDERED = (("moving_time", "elapsed_time", "ERROR"), ("average_watts", "max_watts", "WARNING"), ("average_heartrate", "max_heartrate", "WARNING"))


def _long(sums: DataFrame, columns: Sequence[str], *parts: str) -> DataFrame:
    """One row per column from a one-row frame of structs named by column."""
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(c)[p].alias(p) for p in parts]) for c in columns])).alias("x")).select("x.*")


def _known(c: str) -> Column:
    return F.count(F.col(c)) * 100.0 / F.count("*")


def quality_score(df: DataFrame, core: Sequence[str] = CORE) -> DataFrame:
    """Mean share of known values over the core columns; an absent column scores 0."""
    scores = [_known(c) if c in df.columns else F.lit(0.0) for c in core]
    return df.agg(r6(sum(scores[1:], scores[0]) / len(core)).alias("score"), F.count("*").alias("total"))


def quality_expected(df: DataFrame, columns: Sequence[str] = EXPECTED) -> DataFrame:
    sums = df.agg(*[F.struct(r6(100 - _known(c)).alias("null_pct")).alias(c) for c in columns])
    return _long(sums, columns, "null_pct")


def equipment_coverage(df: DataFrame, columns: Sequence[str] = POWER) -> DataFrame:
    """Mean share of known values over those of the columns that are there and known anywhere."""
    shares = F.filter(F.array(*[_known(c) for c in columns if c in df.columns]), lambda x: x > 0)
    mean = F.coalesce(F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(shares), F.lit(0)), F.lit(0.0))
    return df.agg(F.round(mean, 1).alias("coverage"), F.when(mean > 80, "has_power_meter").when(mean > 0, "partial").otherwise("none").alias("power"))


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    sums = df.agg(*[F.struct(F.min(d(c)).alias("least"), F.max(d(c)).alias("greatest"), r6(F.avg(d(c))).alias("mean")).alias(c) for c in columns])
    return _long(sums, columns, "least", "greatest", "mean")


def quality_gate(df: DataFrame, least: float = 95.0) -> DataFrame:
    return quality_score(df).select("score", (F.col("score") >= least).alias("accepted"))


def require_quality(df: DataFrame, least: float = 95.0) -> DataFrame:
    """``df`` itself; raises when its score is below ``least`` or a critical column has nulls."""
    row = quality_score(df).first()
    lost = df.agg(F.count_if(F.col("id").isNull() | F.col("start_date_local").isNull())).first()[0]
    if row["score"] is None or row["score"] < least or lost:
        raise ValueError(f"quality {row['score']} below {least}, {lost} rows without critical fields")
    return df


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    sums = df.agg(*[F.struct(F.count(F.col(c)).alias("known"), r6(_known(c)).alias("pct")).alias(c) for c in columns])
    return _long(sums, columns, "known", "pct")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and unique shares, and least and greatest value (length, for text) of each column."""
    kinds = dict(df.dtypes)
    size = lambda c: F.length(c).cast("double") if kinds[c] == "string" else F.col(c).cast("double")
    sums = df.agg(*[
        F.struct(
            r6(100 - _known(c)).alias("null_pct"), r6(F.count_distinct(c) * 100.0 / F.count("*")).alias("unique_pct"),
            F.min(size(c)).alias("least"), F.max(size(c)).alias("greatest"),
        ).alias(c)
        for c in columns
    ])
    return _long(sums, columns, "null_pct", "unique_pct", "least", "greatest")


def heuristics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    p = column_profile(df, columns)
    total = df.agg(F.count("*")).scalar()
    many = F.when(F.col("null_pct") > 50, "WARNING").when((F.col("unique_pct") < 10) & (total > 100), "INFO")
    return p.select("column_name", many.alias("severity")).where("severity is not null")


def check_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = lambda c: F.col(c).isNotNull() & F.trim(c).try_cast("double").isNull()
    sums = df.agg(*[F.struct(F.count_if(bad(c)).alias("not_numeric")).alias(c) for c in columns])
    return _long(sums, columns, "not_numeric")


def check_boolean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = lambda c: F.col(c).isNotNull() & ~F.lower(F.col(c).cast("string")).isin(*TRUTHS)
    sums = df.agg(*[F.struct(F.count_if(bad(c)).alias("not_boolean")).alias(c) for c in columns])
    return _long(sums, columns, "not_boolean")


def check_datetime(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    def bad(c: str) -> Column:
        ok = F.lit(False)
        for pattern in DATETIMES:
            ok = ok | F.col(c).rlike(pattern)
        return F.col(c).isNotNull() & ~ok

    sums = df.agg(*[F.struct(F.count_if(bad(c)).alias("not_datetime")).alias(c) for c in columns])
    return _long(sums, columns, "not_datetime")


def check_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows below and above the bounds of each column that is there."""
    rules = {c: r for c, r in (ranges or RANGES).items() if c in df.columns}
    sums = df.agg(*[F.struct(F.count_if(F.col(c) < lo).alias("below"), F.count_if(F.col(c) > hi).alias("above")).alias(c) for c, (lo, hi) in rules.items()])
    return _long(sums, list(rules), "below", "above")


def check_consistency(df: DataFrame) -> DataFrame:
    """Rows that break each rule whose two columns are there."""
    rules = [r for r in ORDERED if r[0] in df.columns and r[1] in df.columns]
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, severity string, broken long")
    sums = df.agg(*[F.count_if(F.col(a) > F.col(b)).alias(f"{a}_{b}") for a, b, _ in rules])
    rows = [F.struct(F.lit(f"{a}<={b}").alias("rule"), F.lit(s).alias("severity"), F.col(f"{a}_{b}").alias("broken")) for a, b, s in rules]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def validation_report(df: DataFrame) -> DataFrame:
    """Issues by severity over the critical columns and the range and consistency checks, the status,
    and a score of 0 to 100. Null ids and starts are critical."""
    lost = coverage(df, [c for c in ("id", "start_date_local") if c in df.columns])
    critical = lost.select(F.lit("CRITICAL").alias("severity"), (df.agg(F.count("*")).scalar() - F.col("known")).alias("rows"))
    ranges = check_ranges(df).select(F.lit("WARNING").alias("severity"), (F.col("below") + F.col("above")).alias("rows"))
    rules = check_consistency(df).select("severity", F.col("broken").alias("rows"))
    every = critical.unionByName(ranges).unionByName(rules).where("rows > 0")
    of = lambda s: F.count_if(F.col("severity") == s)
    a = every.agg(of("CRITICAL").alias("criticals"), of("ERROR").alias("errors"), of("WARNING").alias("warnings"), F.coalesce(F.sum("rows"), F.lit(0)).alias("issues"))
    cells = df.agg(F.count("*")).scalar() * len(df.columns)
    score = 100 - F.col("issues") / cells * 100 - 10 * F.col("criticals") - 5 * F.col("errors") - F.col("warnings")
    status = F.when(F.col("criticals") > 0, "critical").when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning").otherwise("success")
    return a.select("criticals", "errors", "warnings", "issues", status.alias("status"), r6(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).alias("score"))


def feature_gaps(df: DataFrame, columns: Sequence[str], least: int = 10) -> DataFrame:
    return coverage(df, columns).select("column_name", "known", (F.col("known") < least).alias("missing"))
