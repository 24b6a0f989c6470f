"""Queries over landed tables (exports, sessions, ingestion) with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.adapter import RIDES_SQL, rides
from wattloom.operators import dedup as U
from wattloom.operators import features as X
from wattloom.operators import normalize as N
from wattloom.operators import quality as Q
from wattloom.operators.activity import r6
from wattloom.session import table


def q(f, *args, of: str = "activities", **kw):
    return lambda spark, sf_dir: f(table(spark, sf_dir, of), *args, **kw)


def two(f, a: str, b: str):
    return lambda spark, sf_dir: f(table(spark, sf_dir, a), table(spark, sf_dir, b))


def long_sql(parts: list[tuple[str, str]], of: str = "activities") -> str:
    """One row per column: [(column, its select list)]."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {sql} FROM {of}" for c, sql in parts)


def _zones_json(spark, sf_dir):
    """Lists of zone times as a service writes them: power's in order, heart rate's from the top down."""
    zone = lambda k, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("zoneNumber"), F.col(c).alias("secsInZone")))
    text = lambda order: F.to_json(F.array_compact(F.array(*[zone(k, f"z{c}_secs") for k, c in order])))
    r = rides(spark, sf_dir).select("id", text((k, k) for k in range(1, 8)).alias("power_zones"), text((8 - k, k) for k in range(1, 8)).alias("hr_zones"))
    return N.all_zones(r)


def _checked(spark, sf_dir):
    """Activities with further metrics under the names of the range and consistency rules."""
    names = {"icu_average_watts": "average_watts", "icu_normalized_watts": "normalized_power", "icu_training_load": "training_stress_score", "icu_intensity": "intensity_factor"}
    return table(spark, sf_dir, "activities").select("*", *[F.col(c).alias(n) for c, n in names.items()])


def _checked_rides(spark, sf_dir):
    return rides(spark, sf_dir).withColumnsRenamed({"icu_average_watts": "average_watts", "max_power": "max_watts"})


def _with_power(spark, sf_dir):
    return table(spark, sf_dir, "fit_sessions").withColumnRenamed("avg_power", "icu_average_watts")


def _flags(spark, sf_dir):
    """Attempts with a flag in words: whether they brought rides, or the status where that is not known."""
    n = F.col("new_activities")
    flag = F.when(n > 0, "Yes").when(n == 0, "0").otherwise(F.col("status"))
    return Q.check_boolean(table(spark, sf_dir, "ingestion_history").select("status", flag.alias("flag")), ["status", "flag"])


def _merged(spark, sf_dir):
    m = N.fit_merge(table(spark, sf_dir, "activities"), table(spark, sf_dir, "fit_sessions"))
    return m.select(
        "row_id", "id", "avg_cadence", "avg_temperature", "left_right_balance", "intensity_factor", "training_stress_score", "average_power", "normalized_power",
        "average_heartrate", "device_serial_number", "has_fit_data",
    )


def _by_either_id(spark, sf_dir):
    """Sessions that name an activity by the vendor's number or by its own id."""
    a = table(spark, sf_dir, "activities").withColumn("garmin_activity_id", F.concat(F.lit("g"), F.col("id")))
    key = F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("g"), F.col("activity_id"))).otherwise(F.col("activity_id"))
    return N.fit_update_or_join(a, table(spark, sf_dir, "fit_sessions").withColumn("activity_id", key))


def _flattened(spark, sf_dir):
    s = table(spark, sf_dir, "fit_sessions").select(
        "session_id", "total_calories", "avg_power", F.create_map(F.lit("zone1"), F.col("avg_heart_rate"), F.lit("zone2"), F.col("avg_cadence")).alias("zones"),
        F.struct("serial_number").alias("device"), F.array_compact(F.array("avg_power", "normalized_power")).alias("laps"),
    )
    return N.fit_flatten(s)


def _union(spark, sf_dir):
    a = table(spark, sf_dir, "activities").select("id", "name", "distance")
    b = table(spark, sf_dir, "garmin_activities").select(F.col("garmin_activity_id").cast("string").alias("id"), F.col("activity_name").alias("name"), "average_hr")
    return N.union_diagonal(a, b)


def _sessions(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "fit_sessions"))


def _history(spark, sf_dir):
    h = table(spark, sf_dir, "ingestion_history")
    return h.orderBy(F.desc("ingestion_timestamp"), F.desc("id")).limit(50).select("id", "file_name", "status")


def _ingest_report(d):
    return d.groupBy("status").agg(F.count("*").alias("attempts"), F.sum("record_count").alias("records"), F.sum("new_activities").alias("new_rides"), r6(F.sum("new_activities") * 100.0 / F.nullif(F.sum("record_count"), F.lit(0))).alias("new_pct"))


def _fit_overview(d):
    return d.agg(F.count("*").alias("sessions"), r6(F.avg("normalized_power")).alias("np"), r6(F.avg("avg_heart_rate")).alias("hr"), r6(F.avg("avg_cadence")).alias("cadence"))


def _cadence(d):
    c = F.col("avg_cadence")
    return d.agg(r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("spread"), F.count(c).alias("sessions"))


def _environment(d):
    t = F.col("avg_temperature")
    return d.agg(F.min(t).alias("coldest"), r6(F.avg(t)).alias("mean"), F.max(t).alias("warmest"))


def _pedal_balance(d):
    b = F.coalesce(N.balance(F.col("left_right_balance")), F.lit(50.0))
    return d.groupBy(F.floor(b).alias("bin")).agg(F.count("*").alias("sessions"), r6(F.avg(F.abs(50 - b))).alias("imbalance"))


def _new(spark, sf_dir, f):
    a = table(spark, sf_dir, "activities")
    s = table(spark, sf_dir, "fit_sessions").select(F.col("activity_id").alias("id"))
    return f(a.select("row_id", "id"), s)


def _nan(d):
    return N.nan_to_null(d, ["total_elevation_gain", "icu_intensity"]).select("row_id", "total_elevation_gain", "icu_intensity")


def _consolidated(d):
    d = d.select("row_id", F.col("icu_average_watts").alias("a"), F.col("icu_normalized_watts").alias("b"))
    return N.consolidate(d, {"a": "b"}).select("row_id", F.col("a").alias("watts"))


BAL = "CASE WHEN isnan(left_right_balance) THEN NULL WHEN left_right_balance <= 100 THEN left_right_balance WHEN left_right_balance BETWEEN 128 AND 228 THEN left_right_balance - 128 WHEN left_right_balance <= 10000 THEN left_right_balance / 100 ELSE left_right_balance / 1000 END"
PRINT = "(start_date_local || '|' || type || '|' || CAST(CAST(round(distance) AS BIGINT) AS VARCHAR) || '|' || CAST(moving_time AS VARCHAR))"
LAST = "(SELECT * FROM fit_sessions WHERE activity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY session_id DESC) = 1)"
US = "coalesce(epoch_us(import_timestamp), 4611686018427387904)"
CHECKED = "(SELECT *, icu_average_watts AS average_watts, icu_normalized_watts AS normalized_power, icu_training_load AS training_stress_score, icu_intensity AS intensity_factor FROM activities)"


def _range_sql(rules: str, of: str) -> str:
    """One row per rule, written as ``column least greatest``, separated by semicolons."""
    parts = [r.split() for r in rules.split(";")]
    return long_sql([(c, f"count(*) FILTER (WHERE {c} < {lo}) AS below, count(*) FILTER (WHERE {c} > {hi}) AS above") for c, lo, hi in parts], of)


RANGES = _range_sql("distance 0 1000000;moving_time 0 86400;elapsed_time 0 86400;total_elevation_gain 0 10000;average_heartrate 50 220;average_speed 0 30;average_watts 0 2000;normalized_power 0 2000;training_stress_score 0 1000;intensity_factor 0 2.0", CHECKED)
RIDE_RANGES = _range_sql("distance 0 1000000;moving_time 0 86400;elapsed_time 0 86400;total_elevation_gain 0 10000;average_heartrate 50 220;max_heartrate 80 250;average_watts 0 2000;max_watts 0 3000", "rides")
CHECKED_RIDES = f"WITH rides AS (SELECT *, icu_average_watts AS average_watts, max_power AS max_watts FROM ({RIDES_SQL}))"
NUM = ["moving_time", "elapsed_time", "distance", "total_elevation_gain", "average_speed", "average_heartrate"]
PROFILE = ["id", "name", "type", "moving_time", "distance", "icu_ftp", "icu_average_watts"]
P_SQL = long_sql([(c, f"round(100 - count({c})*100.0/count(*),6) AS null_pct, round(count(DISTINCT {c})*100.0/count(*),6) AS unique_pct, CAST(min({s}) AS DOUBLE) AS least, CAST(max({s}) AS DOUBLE) AS greatest") for c in PROFILE for s in [f"length({c})" if c in ("id", "name", "type") else c]])
BROKEN = "SELECT 'moving_time<=elapsed_time' AS rule, 'ERROR' AS severity, count(*) FILTER (WHERE moving_time > elapsed_time) AS broken FROM activities"
RIDES_BROKEN = f"""{CHECKED_RIDES} SELECT 'moving_time<=elapsed_time' AS rule, 'ERROR' AS severity, count(*) FILTER (WHERE moving_time > elapsed_time) AS broken FROM rides
 UNION ALL SELECT 'average_watts<=max_watts', 'WARNING', count(*) FILTER (WHERE average_watts > max_watts) FROM rides UNION ALL SELECT 'average_heartrate<=max_heartrate', 'WARNING', count(*) FILTER (WHERE average_heartrate > max_heartrate) FROM rides"""
SCORE = "(" + " + ".join(f"count({c})*100.0/count(*)" for c in Q.CORE) + f")/{len(Q.CORE)}"
COVER = "SELECT coalesce(avg(p), 0) AS c FROM (SELECT unnest([" + ", ".join(f"count({c})*100.0/count(*)" for c in ("icu_average_watts", "avg_cadence", "avg_temperature", "left_right_balance", "normalized_power")) + "]) AS p FROM (SELECT *, avg_power AS icu_average_watts FROM fit_sessions)) WHERE p > 0"
ISO_SQL = r"regexp_full_match(trim(start_date_local), '\d{4}-\d{1,2}-\d{1,2}[Tt ]\s*\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?')"
DT_BAD = r"start_date_local IS NOT NULL AND NOT regexp_matches(start_date_local, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}') AND NOT regexp_matches(start_date_local, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}') AND NOT regexp_matches(start_date_local, '^\d{4}-\d{2}-\d{2}$') AND NOT regexp_matches(start_date_local, '^\d{2}/\d{2}/\d{4}')"

LAT, LONG = ("CASE WHEN abs({c}) > 180 THEN {c}*(180.0/2147483648) ELSE {c} END".format(c=c) for c in ("position_lat", "position_long"))
FIELD_BOUNDS = [
    ("position_lat", f"abs({LAT}) > 90"), ("position_long", f"abs({LONG}) > 180"), ("distance", "distance < 0"), ("speed", "speed < 0"), ("heart_rate", "heart_rate < 0 OR heart_rate > 255"),
    ("cadence", "cadence < 0 OR cadence > 255"), ("power", "power < 0 OR power > 2000"), ("temperature", "temperature < -100 OR temperature > 100"),
]

QUERIES = {
    "dedup_exact": (q(U.exact), "WITH c AS (SELECT id, count(*) AS copies, min(import_timestamp) AS f, max(import_timestamp) AS l FROM activities WHERE id IS NOT NULL GROUP BY id) SELECT row_id, a.id, copies, epoch_us(f) AS first_import_us, epoch_us(l) AS last_import_us, coalesce(copies > 1, false) AS is_duplicate FROM activities a LEFT JOIN c ON a.id = c.id"),
    "dedup_potential": (q(U.potential), f"WITH r AS (SELECT row_id, id, {PRINT} AS p FROM activities), p AS (SELECT p, count(*) AS n FROM r WHERE p IS NOT NULL GROUP BY p), i AS (SELECT id, count(*) AS c FROM r WHERE id IS NOT NULL GROUP BY id) SELECT row_id, r.id, n AS same_print, coalesce(n > 1 AND NOT coalesce(c,1) > 1, false) AS is_potential FROM r LEFT JOIN p ON r.p = p.p LEFT JOIN i ON r.id = i.id"),
    "dedup_latest": (q(U.resolve), f"SELECT row_id, id FROM activities QUALIFY row_number() OVER (PARTITION BY id ORDER BY {US} DESC, row_id DESC) = 1"),
    "dedup_first": (q(U.resolve, "keep_first"), f"SELECT row_id, id FROM activities QUALIFY row_number() OVER (PARTITION BY id ORDER BY {US}, row_id) = 1"),
    "dedup_flag": (q(U.resolve, "keep_latest", True), "SELECT row_id, id, row_number() OVER (PARTITION BY id ORDER BY import_timestamp DESC NULLS FIRST, row_id DESC NULLS FIRST) = 1 AS would_keep FROM activities"),
    "dedup_report": (q(U.report), f"WITH r AS (SELECT row_id, id, {PRINT} AS p FROM activities), p AS (SELECT p, count(*) AS n FROM r WHERE p IS NOT NULL GROUP BY p), i AS (SELECT id, count(*) AS c FROM r WHERE id IS NOT NULL GROUP BY id), b AS (SELECT count(*) AS total, count(DISTINCT id) + max(CAST(id IS NULL AS INT)) AS u FROM activities) SELECT total, u AS unique_ids, total - u AS exact, 'keep_latest' AS strategy, (SELECT count(*) FROM r JOIN p ON r.p = p.p LEFT JOIN i ON r.id = i.id WHERE n > 1 AND NOT coalesce(c,1) > 1) AS potential FROM b"),
    "dedup_ingest_order": (q(U.ingest_order), "SELECT min(row_id) AS row_id, id FROM activities GROUP BY id"),
    "file_sources": (q(U.file_sources), "SELECT id, string_agg(DISTINCT file_source, '; ' ORDER BY file_source) AS sources, count(DISTINCT file_source) AS n_sources FROM activities WHERE id IS NOT NULL AND file_source IS NOT NULL GROUP BY id"),
    "track_sources": (q(U.track_sources), "SELECT id, string_agg(DISTINCT file_source, ', ' ORDER BY file_source) AS sources FROM activities WHERE id IS NOT NULL AND file_source IS NOT NULL GROUP BY id"),
    "dup_summary": (q(U.summary), "WITH i AS (SELECT id FROM activities WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) SELECT file_source, count(*) AS total, count(i.id) AS duplicates FROM activities a LEFT JOIN i ON a.id = i.id GROUP BY file_source"),
    "norm_blank": (q(lambda d: d.select("row_id", N.blank_to_null(F.col("name")).alias("name"))), "SELECT row_id, nullif(trim(name), '') AS name FROM activities"),
    "norm_datetime": (q(N.parsed_starts), f"SELECT row_id, CASE WHEN {ISO_SQL} THEN replace(substr(trim(start_date_local), 1, 19), 'T', ' ') END AS start_text FROM activities"),
    "norm_consolidate": (q(_consolidated), "SELECT row_id, CASE WHEN icu_average_watts IS NULL OR icu_average_watts = 0 THEN CASE WHEN icu_normalized_watts <> 0 THEN icu_normalized_watts ELSE icu_average_watts END ELSE icu_average_watts END AS watts FROM activities"),
    "norm_flags": (q(N.flags), "SELECT row_id, coalesce(average_heartrate <> 0, false) AS has_heartrate, coalesce(icu_average_watts <> 0, false) OR coalesce(icu_normalized_watts <> 0, false) AS device_watts FROM activities"),
    "validate_rows": (q(N.validated), "SELECT row_id, nullif(concat_ws(',', " + ", ".join(f"CASE WHEN nullif(trim({c}),'') IS NULL THEN '{c}' END" for c in ("id", "start_date_local", "name", "type")) + "), '') AS missing FROM activities"),
    "json_text": (q(N.json_text, ["id", "type", "moving_time"], "row_id"), "SELECT row_id, '{\"id\":\"' || id || '\",' || CASE WHEN type IS NOT NULL THEN '\"type\":\"' || type || '\",' ELSE '' END || '\"moving_time\":' || CAST(moving_time AS VARCHAR) || '}' AS json FROM activities"),
    "json_zones": (_zones_json, f"SELECT id, {', '.join(f'z{k}_secs' for k in range(1, 8))}, {', '.join(f'z{8 - k}_secs AS hr_z{k}_secs' for k in range(1, 8))} FROM ({RIDES_SQL})"),
    "nan_to_null": (q(_nan), "SELECT row_id, CASE WHEN NOT isnan(total_elevation_gain) THEN total_elevation_gain END AS total_elevation_gain, CASE WHEN NOT isnan(icu_intensity) THEN icu_intensity END AS icu_intensity FROM activities"),
    "fit_unit_repair": (_sessions(N.fit_unit_repair), f"SELECT session_id, round({BAL},6) AS left_share FROM fit_sessions"),
    "fit_constraints": (q(N.fit_constraints, of="fit_records"), " UNION ALL ".join(f"SELECT '{c}' AS field_name, count(*) FILTER (WHERE {bad}) AS rejected FROM fit_records" for c, bad in FIELD_BOUNDS)),
    "fit_quarantine": (q(N.quarantined, of="fit_records"), "SELECT * FROM (SELECT record_id, nullif(concat_ws(',', " + ", ".join(f"CASE WHEN {bad} THEN '{c}' END" for c, bad in FIELD_BOUNDS) + "), '') AS violations FROM fit_records) WHERE violations IS NOT NULL"),
    "fit_merge": (_merged, f"SELECT row_id, a.id, s.avg_cadence, s.avg_temperature, s.left_right_balance, s.intensity_factor, s.training_stress_score, nullif(s.avg_power, 0) AS average_power, nullif(s.normalized_power, 0) AS normalized_power, coalesce(nullif(a.average_heartrate, 0), nullif(s.avg_heart_rate, 0)) AS average_heartrate, nullif(s.serial_number, '') AS device_serial_number, s.activity_id IS NOT NULL AS has_fit_data FROM activities a LEFT JOIN {LAST} s ON a.id = s.activity_id"),
    "fit_update_or_join": (_by_either_id, "SELECT session_id, min(row_id) AS row_id FROM (SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'g' || activity_id ELSE activity_id END AS k FROM fit_sessions) s JOIN (SELECT row_id, id, 'g' || id AS gid FROM activities) a ON a.gid = s.k OR a.id = s.k GROUP BY session_id"),
    "fit_flatten": (_flattened, "SELECT session_id, total_calories AS fit_total_calories, avg_power AS fit_avg_power, avg_heart_rate AS fit_zones_zone1, avg_cadence AS fit_zones_zone2, serial_number AS fit_device_serial_number, CAST(avg_power IS NOT NULL AS INT) + CAST(normalized_power IS NOT NULL AS INT) AS fit_lap_count, true AS has_fit_analysis FROM fit_sessions"),
    "semi_existing": (lambda s, d: _new(s, d, N.semi_existing), "SELECT row_id, id FROM activities WHERE id IN (SELECT activity_id FROM fit_sessions WHERE activity_id IS NOT NULL)"),
    "anti_new_ids": (lambda s, d: _new(s, d, N.anti_new_ids), "SELECT row_id, id FROM activities a WHERE NOT EXISTS (SELECT 1 FROM fit_sessions s WHERE s.activity_id = a.id)"),
    "union_diagonal": (_union, "SELECT id, name, distance, CAST(NULL AS BIGINT) AS average_hr FROM activities UNION ALL SELECT CAST(garmin_activity_id AS VARCHAR), activity_name, NULL, average_hr FROM garmin_activities"),
    "quality_score": (q(Q.quality_score), f"SELECT round({SCORE},6) AS score, count(*) AS total FROM activities"),
    "quality_expected": (q(Q.quality_expected), long_sql([(c, f"round(100 - count({c})*100.0/count(*),6) AS null_pct") for c in Q.EXPECTED])),
    "equipment_coverage": (lambda s, d: Q.equipment_coverage(_with_power(s, d)), f"SELECT round(c,1) AS coverage, CASE WHEN c > 80 THEN 'has_power_meter' WHEN c > 0 THEN 'partial' ELSE 'none' END AS power FROM ({COVER})"),
    "value_ranges": (q(Q.value_ranges, NUM), long_sql([(c, f"CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest, round(avg({c}),6) AS mean") for c in NUM])),
    "quality_gate": (q(Q.quality_gate), f"SELECT round({SCORE},6) AS score, round({SCORE},6) >= 95 AS accepted FROM activities"),
    "fit_coverage": (q(Q.coverage, ["avg_power", "normalized_power", "avg_heart_rate", "avg_cadence", "avg_temperature"], of="fit_sessions"), long_sql([(c, f"count({c}) AS known, round(count({c})*100.0/count(*),6) AS pct") for c in ("avg_power", "normalized_power", "avg_heart_rate", "avg_cadence", "avg_temperature")], "fit_sessions")),
    "column_profile": (q(Q.column_profile, PROFILE), P_SQL),
    "check_heuristics": (q(Q.heuristics, PROFILE), f"SELECT column_name, CASE WHEN null_pct > 50 THEN 'WARNING' ELSE 'INFO' END AS severity FROM ({P_SQL}) WHERE null_pct > 50 OR (unique_pct < 10 AND (SELECT count(*) FROM activities) > 100)"),
    "check_numeric": (q(Q.check_numeric, ["speed", "distance", "position_lat"], of="raw_records"), long_sql([(c, f"count(*) FILTER (WHERE {c} IS NOT NULL AND try_cast(trim({c}) AS DOUBLE) IS NULL) AS not_numeric") for c in ("speed", "distance", "position_lat")], "raw_records")),
    "check_boolean": (_flags, "SELECT 'status' AS column_name, count(*) FILTER (WHERE lower(status) NOT IN ('true', 'false', '1', '0', 'yes', 'no', 't', 'f')) AS not_boolean FROM ingestion_history UNION ALL SELECT 'flag', count(*) FILTER (WHERE new_activities IS NULL OR new_activities < 0) - count(*) FILTER (WHERE (new_activities IS NULL OR new_activities < 0) AND status IS NULL) FROM ingestion_history"),
    "check_datetime": (q(Q.check_datetime, ["start_date_local"]), long_sql([("start_date_local", f"count(*) FILTER (WHERE {DT_BAD}) AS not_datetime")])),
    "check_ranges": (lambda s, d: Q.check_ranges(_checked(s, d)), RANGES),
    "check_ranges_rides": (lambda s, d: Q.check_ranges(_checked_rides(s, d)), f"{CHECKED_RIDES} {RIDE_RANGES}"),
    "check_consistency": (lambda s, d: Q.check_consistency(_checked_rides(s, d)), RIDES_BROKEN),
    "validation_report": (lambda s, d: Q.validation_report(_checked(s, d)), f"WITH e AS (SELECT 'CRITICAL' AS severity, count(*) - count(id) AS n FROM activities UNION ALL SELECT 'CRITICAL', count(*) - count(start_date_local) FROM activities UNION ALL SELECT 'WARNING', below + above FROM ({RANGES}) UNION ALL SELECT severity, broken FROM ({BROKEN})), k AS (SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS criticals, count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, CAST(coalesce(sum(n),0) AS BIGINT) AS issues FROM e WHERE n > 0) SELECT criticals, errors, warnings, issues, CASE WHEN criticals > 0 THEN 'critical' WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'success' END AS status, round(greatest(0.0, least(100.0, 100 - issues/((SELECT count(*) FROM activities)*26)*100 - 10*criticals - 5*errors - warnings)),6) AS score FROM k"),
    "feature_gaps": (q(Q.feature_gaps, ["icu_ftp", "icu_intensity", "icu_training_load"]), long_sql([(c, f"count({c}) AS known, count({c}) < 10 AS missing") for c in ("icu_ftp", "icu_intensity", "icu_training_load")])),
    "feat_gross": (_sessions(X.gross_efficiency), "SELECT session_id, round(nullif(avg_power,0)*nullif(total_timer_time,0)/(nullif(total_calories,0)*4184)*100,9) AS gross_efficiency, round(nullif(normalized_power,0)/nullif(avg_power,0),9) AS vi FROM fit_sessions"),
    "feat_pedaling": (_sessions(X.pedaling), f"SELECT session_id, round({BAL},9) AS left_share, round(abs(50-({BAL})),9) AS asymmetry, round(nullif(avg_power,0)/nullif(avg_cadence,0),9) AS watts_per_rpm, CAST(NULL AS DOUBLE) AS torque_effectiveness, CAST(NULL AS DOUBLE) AS pedal_smoothness FROM fit_sessions"),
    "feat_sensors": (two(X.sensors, "fit_sessions", "fit_records"), "SELECT session_id, r.n AS data_points, CAST(coalesce(avg_power <> 0, false) AS INT) AS has_power, CAST(coalesce(avg_heart_rate <> 0, false) AS INT) AS has_hr, CAST(coalesce(avg_cadence <> 0, false) AS INT) AS has_cadence, CAST(coalesce(avg_temperature <> 0, false) AS INT) AS has_temperature FROM fit_sessions s LEFT JOIN (SELECT activity_id, count(*) AS n FROM fit_records GROUP BY 1) r ON s.activity_id = r.activity_id"),
    "feat_environment": (_sessions(X.environment), "SELECT session_id, CASE WHEN avg_temperature < 0 THEN 1 WHEN avg_temperature < 10 THEN 2 WHEN avg_temperature < 20 THEN 3 WHEN avg_temperature < 30 THEN 4 WHEN avg_temperature IS NOT NULL THEN 5 END AS temp_zone, round(abs(CAST(avg_temperature AS DOUBLE)-12.5),9) AS temp_stress FROM fit_sessions"),
    "feat_session_power": (lambda s, d: X.session_power(*[table(s, d, t) for t in ("fit_sessions", "activities", "athletes")]), "SELECT session_id, round(nullif(avg_power,0)*60/(nullif(avg_cadence,0)*2*pi()*0.1725),9) AS force_n, round(nullif(avg_power,0)/nullif(weight_kg,0),9) AS watts_per_kg, round(nullif(normalized_power,0)/nullif(weight_kg,0),9) AS np_per_kg FROM fit_sessions s LEFT JOIN (SELECT id, min(athlete_id) AS athlete_id FROM activities GROUP BY id) a ON s.activity_id = a.id LEFT JOIN (SELECT athlete_id, max(weight_kg) AS weight_kg FROM athletes GROUP BY athlete_id) t ON a.athlete_id = t.athlete_id"),
    "feat_device": (_sessions(X.device), "SELECT session_id, CAST(CAST('0x' || substr(md5(serial_number), 1, 8) AS BIGINT) % 100 AS INT) AS device_hash, avg_power IS NOT NULL AS has_power, avg_heart_rate IS NOT NULL AS has_heart_rate, avg_cadence IS NOT NULL AS has_cadence FROM fit_sessions"),
    "fit_overview": (_sessions(_fit_overview), "SELECT count(*) AS sessions, round(avg(normalized_power),6) AS np, round(avg(avg_heart_rate),6) AS hr, round(avg(avg_cadence),6) AS cadence FROM fit_sessions"),
    "cadence_kpis": (_sessions(_cadence), "SELECT round(avg(avg_cadence),6) AS mean, round(stddev_samp(avg_cadence),6) AS spread, count(avg_cadence) AS sessions FROM fit_sessions"),
    "environment_kpis": (_sessions(_environment), "SELECT min(avg_temperature) AS coldest, round(avg(avg_temperature),6) AS mean, max(avg_temperature) AS warmest FROM fit_sessions"),
    "pedal_balance": (_sessions(_pedal_balance), f"SELECT CAST(floor(coalesce({BAL},50.0)) AS BIGINT) AS bin, count(*) AS sessions, round(avg(abs(50-coalesce({BAL},50.0))),6) AS imbalance FROM fit_sessions GROUP BY 1"),
    "ingestion_latest": (_history, "SELECT id, file_name, status FROM ingestion_history ORDER BY ingestion_timestamp DESC NULLS LAST, id DESC LIMIT 50"),
    "ingestion_report": (q(_ingest_report, of="ingestion_history"), "SELECT status, count(*) AS attempts, CAST(sum(record_count) AS BIGINT) AS records, CAST(sum(new_activities) AS BIGINT) AS new_rides, round(sum(new_activities)*100.0/nullif(sum(record_count),0),6) AS new_pct FROM ingestion_history GROUP BY status"),
}
