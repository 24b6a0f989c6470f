"""Queries over rides with the SQL each is checked against: {name: (query, SQL)}."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.adapter import RIDES_SQL, rides
from wattloom.operators import activity as A
from wattloom.operators import features as X
from wattloom.operators import forecast as M


def R(sql: str) -> str:
    """SQL with the view ``rides`` in front; ``sql`` may begin with further views after a comma."""
    return f"WITH rides AS ({RIDES_SQL}) {sql}"


def q(f, *args, **kw):
    return lambda spark, sf_dir: f(rides(spark, sf_dir), *args, **kw)


DAY = "strftime(start_date_local, '%Y-%m-%d')"
FTP = "coalesce(functional_threshold_power, threshold_power, icu_ftp)"
MAX = "(SELECT max(start_date_local) FROM rides)"


def _since(days: int) -> str:
    return f"start_date_local >= {MAX} - INTERVAL {days} DAY"


def _seasonal(keys: str, group: str) -> str:
    return R(f"SELECT {keys}, count(*) AS rides, round(avg(distance),6) AS avg_distance, round(avg(moving_time),6) AS avg_time, round(avg(icu_average_watts),6) AS avg_watts, round(sum(icu_training_load),6) AS load FROM rides GROUP BY {group}")


W = "OVER (PARTITION BY athlete_id ORDER BY start_date_local, id ROWS BETWEEN {} AND {})"
ZONE = "CASE WHEN icu_average_watts >= f*1.50 THEN 7 WHEN icu_average_watts >= f*1.20 THEN 6 WHEN icu_average_watts >= f*1.05 THEN 5 WHEN icu_average_watts >= f*0.90 THEN 4 WHEN icu_average_watts >= f*0.75 THEN 3 WHEN icu_average_watts >= f*0.55 THEN 2 WHEN icu_average_watts >= 0 THEN 1 END"
HISTORY = f"""SELECT id, athlete_id, {", ".join(f"round(avg(icu_normalized_watts) {W.format(f'{k} PRECEDING', '1 PRECEDING')},6) AS np_{k}" for k in (7, 14, 28))},
 {", ".join(f"count(*) {W.format(f'{k} PRECEDING', '1 PRECEDING')}*50 AS load_{k}" for k in (7, 14, 28))} FROM rides WHERE icu_normalized_watts IS NOT NULL"""
SEASON = f"""SELECT strftime(date_trunc('month', start_date_local), '%Y-%m-%d') AS month, count(*) AS rides, sum(icu_training_load) AS load,
 max({FTP}) AS max_ftp, avg(icu_average_watts) AS avg_watts FROM rides GROUP BY 1"""
def _power_training(df):
    rows = M.power_rows(df)
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("label", *M.POWER_FEATURES)])


def _readiness(when: str, resting: str) -> str:
    return f""", a AS (SELECT avg(icu_fitness) AS c, avg(icu_fatigue) AS t, avg(icu_intensity) AS i, count(*) AS n, {resting} AS h FROM rides WHERE {when}),
        b AS (SELECT CASE WHEN c IS NULL OR t IS NULL THEN 50.0 WHEN c-t BETWEEN -10 AND 5 THEN least(100.0, 90+c-t) WHEN c-t > 5 THEN greatest(60.0, 90-2*(c-t-5)) ELSE greatest(30.0, 70+2*(c-t)) END AS form, least(100.0, n/(14.0/3)*100) AS consistency,
         CASE WHEN i IS NULL THEN 50.0 WHEN i BETWEEN 0.75 AND 0.85 THEN 100.0 ELSE greatest(50.0, 100-200*least(abs(i-0.75),abs(i-0.85))) END AS intensity,
         CASE WHEN h < 50 THEN 100.0 WHEN h < 60 THEN 85.0 WHEN h < 70 THEN 70.0 WHEN h IS NOT NULL THEN 50.0 END AS recovery FROM a), o AS (SELECT *, CASE WHEN recovery IS NULL THEN (form+consistency+intensity)/3 ELSE (form+consistency+intensity+recovery)/4 END AS overall FROM b)
        SELECT round(form,6) AS form, round(consistency,6) AS consistency, round(intensity,6) AS intensity, round(recovery,6) AS recovery, round(overall,6) AS overall, CASE WHEN overall >= 80 THEN 'ready' WHEN overall >= 60 THEN 'moderate' ELSE 'rest' END AS level,
         concat_ws('; ', CASE WHEN form < 50 THEN 'reduce load' WHEN form <= 60 THEN 'maintain load' WHEN form > 90 THEN 'excellent form' END, CASE WHEN consistency < 70 THEN 'ride more often' END, CASE WHEN intensity < 70 THEN 'adjust intensity' END) AS advice FROM o"""


some = lambda c: f"nullif({c},0)"
#: The label and the features of power models; the ride view has no pedalling, cadence, temperature, effect or work.
POWER_VIEWS = f""", f AS (SELECT *, CASE WHEN (SELECT count(threshold_power) FROM rides) > 0 THEN threshold_power WHEN (SELECT count(functional_threshold_power) FROM rides) > 0 THEN functional_threshold_power ELSE icu_ftp END AS target FROM rides WHERE coalesce(icu_normalized_watts, icu_average_watts) IS NOT NULL),
 h AS (SELECT *, {", ".join(f"count(*) {W.format(f'{k} PRECEDING', '1 PRECEDING')} AS n{k}, avg(icu_normalized_watts) {W.format(f'{k} PRECEDING', '1 PRECEDING')} AS a{k}" for k in (7, 14, 28))} FROM f)"""
POWER_TRAINING = f"""SELECT id, coalesce(nullif(target,0), nullif(icu_normalized_watts,0)) AS label, coalesce(icu_average_watts,0) AS avg_power, coalesce(icu_normalized_watts,0) AS normalized_power, coalesce(max_power,0) AS max_power, 50.0::DOUBLE AS left_right_balance,
  {", ".join(f"0.0::DOUBLE AS {c}" for c in ("left_torque_effectiveness", "right_torque_effectiveness", "left_pedal_smoothness", "right_pedal_smoothness", "avg_cadence", "max_cadence", "training_effect", "anaerobic_effect", "total_work_kj"))}, 20.0::DOUBLE AS avg_temperature, 25.0::DOUBLE AS max_temperature,
  coalesce(average_heartrate,0) AS avg_hr, coalesce(CAST(max_heartrate AS DOUBLE),0) AS max_hr, coalesce(nullif(icu_average_watts,0)/nullif(average_heartrate,0),0) AS efficiency_factor, coalesce(nullif(icu_normalized_watts,0)/nullif(icu_average_watts,0),1) AS variability_index, coalesce(icu_intensity,0) AS intensity_factor,
  coalesce(moving_time,0)/3600 AS duration_hours, coalesce(distance,0)/1000 AS distance_km, CASE WHEN moving_time*icu_normalized_watts <> 0 AND target <> 0 THEN least(500.0, moving_time*icu_normalized_watts*(icu_normalized_watts/target)/(target*3600)*100) ELSE 0.0 END AS calculated_tss,
  {", ".join(f"CASE WHEN n{k} > 0 THEN coalesce(a{k},0) ELSE coalesce(icu_normalized_watts,0) END AS avg_np_{k}d, CAST(n{k}*50 AS DOUBLE) AS total_tss_{k}d" for k in (7, 14, 28))} FROM h WHERE coalesce(nullif(target,0), nullif(icu_normalized_watts,0)) IS NOT NULL"""
NZ = " + ".join(f"coalesce(z{k}_secs,0)" for k in range(1, 8))


M2 = "((" + " + ".join(f"(p{k}-1.0/7)*(p{k}-1.0/7)" for k in range(1, 8)) + ")/7)"


def _p(k: int) -> str:
    return f"(coalesce(z{k}_secs,0)/t)"


def _season_rounded(df):
    s = A.season_monthly(df)
    return s.select("month", "rides", A.r6(s["load"]).alias("load"), "max_ftp", A.r6(s["avg_watts"]).alias("avg_watts"))


QUERIES = {
    "ftp_progression": (q(A.ftp_progression), R(f"SELECT id, {DAY} AS day, {FTP} AS ftp FROM rides WHERE {FTP} IS NOT NULL")),
    "ftp_unified": (q(lambda d: d.select("id", A.unified_ftp(d).alias("ftp"))), R(f"SELECT id, {FTP} AS ftp FROM rides")),
    "training_load": (q(A.training_load), R(f"""SELECT round(avg(icu_fitness),6) AS ctl, round(avg(icu_fatigue),6) AS atl, round(coalesce(sum(icu_training_load),0),6) AS load, count(*) AS rides,
        round(sum(moving_time)/3600,6) AS hours, round(CASE WHEN avg(icu_fitness)<>0 AND avg(icu_fatigue)<>0 THEN avg(icu_fitness)-avg(icu_fatigue) END,6) AS tsb FROM rides WHERE {_since(42)}""")),
    "training_load_periods": (q(A.training_load_periods), R(f"""SELECT p.d AS period_days, round(avg(icu_fitness),6) AS ctl, round(avg(icu_fatigue),6) AS atl, round(sum(icu_training_load),6) AS load, count(*) AS rides, round(sum(moving_time)/3600,6) AS hours
        FROM rides JOIN (VALUES (7),(14),(28),(42),(90)) p(d) ON date_diff('day', CAST(start_date_local AS DATE), CAST({MAX} AS DATE)) <= p.d GROUP BY p.d""")),
    "power_zones": (q(A.power_zones), R(f"""SELECT zone, round(sum(moving_time)/3600,6) AS hours FROM (SELECT *, {ZONE} AS zone FROM rides, (SELECT {FTP} AS f FROM rides WHERE {FTP} IS NOT NULL ORDER BY start_date_local DESC, id DESC LIMIT 1))
        WHERE zone IS NOT NULL GROUP BY zone HAVING sum(moving_time) > 0""")),
    "efficiency": (q(A.efficiency), R("""SELECT round(avg(icu_intensity),6) AS avg_intensity, round(avg(icu_normalized_watts/nullif(icu_average_watts,0)),6) AS avg_variability,
        round(avg(icu_average_watts/nullif(average_heartrate,0)),6) AS avg_watts_per_beat FROM rides WHERE icu_average_watts IS NOT NULL AND average_heartrate IS NOT NULL""")),
    "best_efforts": (q(A.best_efforts), R(f"SELECT id, name, {DAY} AS day, round(icu_normalized_watts,6) AS icu_normalized_watts FROM rides WHERE icu_normalized_watts IS NOT NULL ORDER BY rides.icu_normalized_watts DESC, id LIMIT 10")),
    "best_efforts_choice": (lambda s, d: A.best_efforts(rides(s, d).withColumn("icu_normalized_watts", F.lit(None).cast("double")), None, 50),
        R(f"SELECT id, name, {DAY} AS day, round(icu_average_watts,6) AS icu_average_watts FROM rides WHERE icu_average_watts IS NOT NULL ORDER BY rides.icu_average_watts DESC, id LIMIT 50")),
    "best_efforts_multi": (q(A.best_efforts_multi), R(", l AS (" + " UNION ALL ".join(f"SELECT id, '{m}' AS metric, {m} AS value FROM rides" for m in A.EFFORTS) + """)
        SELECT metric, place, id, round(value,6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, id) AS place FROM l WHERE value IS NOT NULL) WHERE place <= 10""")),
    "weekly_summary": (q(A.weekly_summary), R(f"""SELECT strftime(date_trunc('week', start_date_local), '%Y-%m-%d') AS week, count(*) AS rides, round(sum(moving_time)/3600,6) AS hours, round(sum(distance)/1000,6) AS km,
        round(sum(icu_training_load),6) AS load, round(avg(icu_average_watts),6) AS avg_watts, round(avg(average_heartrate),6) AS avg_hr, round(sum(total_elevation_gain),6) AS climb FROM rides WHERE {_since(588)} GROUP BY 1""")),
    "power_curve": (q(A.power_curve), R("""SELECT d AS duration_s, round(quantile_cont(icu_normalized_watts,0.95),6) AS watts, count(*) AS rides FROM rides JOIN (VALUES (5),(10),(30),(60),(120),(300),(600),(1200),(3600)) p(d) ON moving_time >= d
        WHERE icu_normalized_watts IS NOT NULL GROUP BY d""")),
    "seasonal_month": (q(A.seasonal, "month"), _seasonal("month(start_date_local) AS month", "1")),
    "seasonal_quarter": (q(A.seasonal, "quarter"), _seasonal("year(start_date_local) AS year, quarter(start_date_local) AS quarter", "1, 2")),
    "seasonal_dow": (q(A.seasonal, "dow"), _seasonal("isodow(start_date_local) AS dow", "1")),
    "seasonal_hour": (q(A.seasonal, "hour"), _seasonal("hour(start_date_local) AS hour", "1")),
    "variability_index": (q(A.variability_index), R(""", s AS (SELECT CAST(unnest(generate_series(min(CAST(start_date_local AS DATE)), max(CAST(start_date_local AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM rides),
        d AS (SELECT CAST(start_date_local AS DATE) AS day, coalesce(sum(icu_training_load),0) AS load FROM rides GROUP BY 1), x AS (SELECT s.day, coalesce(load,0) AS load FROM s LEFT JOIN d ON s.day = d.day),
        w AS (SELECT *, count(*) OVER v AS n, avg(load) OVER v AS m, stddev_samp(load) OVER v AS sd FROM x WINDOW v AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
        SELECT strftime(day, '%Y-%m-%d') AS day, round(load,6) AS load, round(CASE WHEN n>=7 THEN m END,6) AS mean_load, round(CASE WHEN n>=7 THEN sd END,6) AS std_load, round(CASE WHEN n>=7 THEN sd/nullif(m,0) END,6) AS variability FROM w""")),
    "training_phases": (q(A.training_phases), R(""", w AS (SELECT CAST(date_trunc('week', start_date_local) AS DATE) AS week, coalesce(sum(icu_training_load),0) AS load, coalesce(avg(icu_intensity),0) AS intensity, count(*) AS rides FROM rides GROUP BY 1),
        t AS (SELECT *, CASE WHEN count(*) OVER v >= 4 THEN avg(load) OVER v ELSE load END AS trend FROM w WINDOW v AS (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
        SELECT strftime(week, '%Y-%m-%d') AS week, round(load,6) AS load, round(intensity,6) AS intensity, rides, round(trend,6) AS trend,
         CASE WHEN load < 0.7*trend THEN 'Recovery' WHEN intensity > 0.85 AND load > 0.9*trend THEN 'Peak/Race' WHEN load > 1.1*trend THEN 'Build' ELSE 'Base/Maintenance' END AS phase FROM t""")),
    "zone_balance": (q(A.zone_balance), R(", h AS (SELECT " + ", ".join(f"coalesce(sum(z{k}_secs),0)/3600 AS h{k}" for k in range(1, 8)) + f" FROM rides WHERE {_since(90)}), t AS (SELECT *, h1+h2+h3+h4+h5+h6+h7 AS t FROM h) SELECT "
        + ", ".join(f"round(h{k},6) AS hours_{k}, round(h{k}*100/nullif(t,0),6) AS pct_{k}" for k in range(1, 8))
        + ", round(h1+h2,6) AS easy, round(h3+h4,6) AS moderate, round(h5+h6+h7,6) AS hard, round((h1+h2+h5+h6+h7)/nullif(h3+h4,0),6) AS polarization FROM t")),
    "vo2max_monthly": (q(A.vo2max_monthly), R(""", m AS (SELECT strftime(date_trunc('month', start_date_local), '%Y-%m-%d') AS month, *, row_number() OVER (PARTITION BY date_trunc('month', start_date_local) ORDER BY icu_normalized_watts, id)-1 AS k,
         count(*) OVER p AS n, max(icu_normalized_watts) OVER p AS top, avg(icu_average_watts) OVER p AS aw FROM rides WHERE icu_normalized_watts IS NOT NULL WINDOW p AS (PARTITION BY date_trunc('month', start_date_local)))
        SELECT month, round(top,6) AS max_np, round(icu_normalized_watts,6) AS p95_np, round(aw,6) AS avg_watts, round(10.8*(icu_normalized_watts/70)+7,6) AS vo2max FROM m WHERE k = round((n-1)*0.95)""")),
    "daily_metrics": (q(A.daily_metrics), R(f"""SELECT {DAY} AS day, round(avg(icu_fitness),6) AS fitness, round(avg(icu_fatigue),6) AS fatigue, round(coalesce(sum(icu_training_load),0),6) AS load, round(coalesce(sum(moving_time),0),6) AS seconds, round(sum(distance),6) AS distance FROM rides GROUP BY 1""")),
    "tsb_daily": (q(A.tsb_daily), R(f"SELECT {DAY} AS day, round(round(avg(icu_fitness),6)-round(avg(icu_fatigue),6),6) AS tsb FROM rides GROUP BY 1")),
    "calendar_heatmap": (q(A.calendar_heatmap), R("SELECT week(start_date_local) AS week, isodow(start_date_local) AS weekday, count(*) AS rides, round(sum(coalesce(icu_training_load, moving_time/60, 0)),6) AS load FROM rides GROUP BY 1, 2")),
    "overview_kpis": (q(A.overview_kpis), R("SELECT count(*) AS rides, round(sum(distance),2) AS distance, round(sum(moving_time),2) AS seconds, round(sum(total_elevation_gain),2) AS climb, round(avg(distance),4) AS avg_distance FROM rides")),
    "season_monthly": (q(_season_rounded), R(f", s AS ({SEASON}) SELECT month, rides, round(load,6) AS load, max_ftp, round(avg_watts,6) AS avg_watts FROM s")),
    "recent_insight": (q(A.recent_insight), R(f"SELECT count(*) AS rides, round(sum(distance),6) AS distance, round(sum(moving_time),6) AS seconds, round(avg(icu_training_load),6) AS avg_load FROM rides WHERE {_since(30)}")),
    "ftp_gain": (q(A.ftp_gain), R(f""", f AS (SELECT {FTP} AS ftp, start_date_local, id FROM rides WHERE {FTP} IS NOT NULL), a AS (SELECT ftp FROM f ORDER BY start_date_local, id LIMIT 1), z AS (SELECT ftp FROM f ORDER BY start_date_local DESC, id DESC LIMIT 1)
        SELECT a.ftp AS first_ftp, z.ftp AS last_ftp, z.ftp-a.ftp AS gain, (SELECT count(*) FROM f) AS points FROM a, z""")),
    "ftp_distinct": (q(A.ftp_distinct), R(f"SELECT count(DISTINCT {FTP}) AS distinct_ftp FROM rides")),
    "latest_activity": (q(A.latest_activity), R(f"SELECT id, {DAY} AS day, name FROM rides ORDER BY start_date_local DESC, id DESC LIMIT 1")),
    "sort_desc_limit": (q(lambda d: d.orderBy(A.F.desc("distance"), "id").limit(25).select("id", "distance")), R("SELECT id, distance FROM rides ORDER BY distance DESC, id LIMIT 25")),
    "rpt_activities": (q(A.report_activities), R(f"""SELECT id, {DAY} AS day, name, type, round(moving_time/3600,6) AS duration_hours, round(distance/1000,6) AS distance_km, round(icu_average_watts,6) AS avg_watts, round(average_heartrate,6) AS avg_hr, round(icu_training_load,6) AS load FROM rides""")),
    "summary_report": (q(A.summary_report), R(f"""SELECT count(*) AS rides, min({DAY}) AS first_day, max({DAY}) AS last_day, round(sum(distance)/1000,6) AS km, round(sum(moving_time)/3600,6) AS hours, round(sum(icu_training_load),6) AS load,
        (SELECT {FTP} FROM rides WHERE {FTP} IS NOT NULL ORDER BY start_date_local, id LIMIT 1) AS first_ftp, (SELECT {FTP} FROM rides WHERE {FTP} IS NOT NULL ORDER BY start_date_local DESC, id DESC LIMIT 1) AS last_ftp FROM rides""")),
    "summary_stats": (q(A.summary_stats), R(f"SELECT type, count(*) AS rides, min({DAY}) AS first_day, max({DAY}) AS last_day, round(sum(distance),2) AS distance, round(sum(moving_time),2) AS seconds, count(DISTINCT file_source) AS files FROM rides GROUP BY type")),
    "derived_units": (q(A.derived_units), R("SELECT id, round(moving_time/3600,6) AS hours, round(distance/1000,6) AS km, round(icu_average_watts/nullif(average_heartrate,0),9) AS watts_per_beat, round(distance*3.6/nullif(moving_time,0),10) AS kmh FROM rides")),
    "select_present": (q(lambda d: d.select(*A.present(d, ["id", "name", "no_such_column", "type"]))), R("SELECT id, name, type FROM rides")),
    "filter_range": (q(lambda d: d.where("moving_time >= 3600 and moving_time < 7200").select("id", "moving_time")), R("SELECT id, moving_time FROM rides WHERE moving_time >= 3600 AND moving_time < 7200")),
    "recent_window": (q(lambda d: A.since(d, 60).select("id", A.day_text(d["start_date_local"]).alias("day"))), R(f"SELECT id, {DAY} AS day FROM rides WHERE {_since(60)}")),
    "filter_isin": (q(lambda d: d.where(d["type"].isin("Ride", "Run")).select("id", "type")), R("SELECT id, type FROM rides WHERE type IN ('Ride', 'Run')")),
    "date_preset": (q(A.date_preset, "365d"), R(f"SELECT id, {DAY} AS day, type FROM rides WHERE {_since(365)}")),
    "distinct_types": (q(lambda d: d.select("type").distinct()), R("SELECT DISTINCT type FROM rides")),
    "ftp_features": (q(A.ftp_features), R(f"""SELECT id, athlete_id, ftp, date_diff('day', min(CAST(start_date_local AS DATE)) OVER (PARTITION BY athlete_id), CAST(start_date_local AS DATE)) AS days_training,
        {", ".join(f"round(avg({c}) {W.format(f'{k - 1} PRECEDING', 'CURRENT ROW')},9) AS {n}_{k}" for c, n in (("icu_training_load", "load"), ("icu_intensity", "intensity")) for k in (7, 28))},
        {", ".join(f"round(sum(moving_time) {W.format(f'{k - 1} PRECEDING', 'CURRENT ROW')},6) AS seconds_{k}" for k in (7, 28))}, icu_fitness, icu_fatigue FROM (SELECT *, {FTP} AS ftp FROM rides) WHERE ftp IS NOT NULL""")),
    "ftp_estimate": (q(A.ftp_estimate), R(f""", g AS (SELECT id, athlete_id, start_date_local, nullif(icu_normalized_watts,0) * CASE WHEN moving_time/60 BETWEEN 20 AND 60 THEN 0.95 WHEN moving_time/60 > 60 THEN 1.0 ELSE 0.90 END AS guess FROM rides),
        f AS (SELECT *, last_value(guess IGNORE NULLS) {W.format("UNBOUNDED PRECEDING", "CURRENT ROW")} AS filled FROM g) SELECT id, athlete_id, round(max(filled) {W.format("19 PRECEDING", "CURRENT ROW")},6) AS estimated_ftp FROM f""")),
    "history_features": (q(A.history_features), R(HISTORY)),
    "power_features": (q(A.power_features), R(f""", h AS ({HISTORY}) SELECT r.id, round(coalesce(least(500.0, moving_time*icu_normalized_watts*(icu_normalized_watts/nullif({FTP},0))/nullif({FTP}*3600,0)*100),0),9) AS tss, round(icu_normalized_watts/nullif(average_heartrate,0),9) AS ef,
        round(icu_normalized_watts/nullif(icu_average_watts,0),9) AS vi, round(moving_time/3600,9) AS hours, round(distance/nullif(moving_time,0),9) AS speed, np_7, np_14, np_28, load_7, load_14, load_28 FROM rides r JOIN h ON r.id = h.id""")),
    "readiness": (q(A.readiness), R(_readiness(_since(14), "CAST(NULL AS DOUBLE)"))),
    "readiness_as_of": (lambda s, d: A.readiness(rides(s, d).withColumn("icu_resting_hr", F.when(F.col("athlete_id") % 4 != 0, 40 + F.col("athlete_id") % 40)), 14, "1997-06-30"),
        R(_readiness("start_date_local BETWEEN TIMESTAMP '1997-06-30' - INTERVAL 14 DAY AND TIMESTAMP '1997-06-30'", "avg(CASE WHEN athlete_id % 4 <> 0 THEN 40 + athlete_id % 40 END)"))),
    "power_training": (lambda s, d: _power_training(rides(s, d)), R(f"{POWER_VIEWS} SELECT id, {', '.join(f'round({c},6) AS {c}' for c in ('label', *M.POWER_FEATURES))} FROM ({POWER_TRAINING})")),
    "race_prediction": (q(A.race_prediction), R(""", f AS (SELECT coalesce(icu_ftp, threshold_power) AS ftp FROM rides WHERE coalesce(icu_ftp, threshold_power) IS NOT NULL ORDER BY start_date_local DESC, id DESC LIMIT 1),
        s AS (SELECT count(*) AS similar_n FROM rides WHERE moving_time BETWEEN 0.7*2*3600 AND 1.3*2*3600)
        SELECT ftp, round(ftp*0.9,6) AS avg_watts, round(ftp*0.9*1.07,6) AS np_watts, round(7200*(ftp*0.9*1.07)*((ftp*0.9*1.07)/ftp)/(ftp*3600)*100,6) AS tss, similar_n AS "similar", CASE WHEN similar_n >= 3 THEN 'High' WHEN similar_n >= 1 THEN 'Medium' ELSE 'Low' END AS confidence FROM f, s""")),
    "season_forecast": (q(A.season_forecast), R(f""", s AS ({SEASON}), n AS (SELECT *, CAST(row_number() OVER (ORDER BY month) - 1 AS DOUBLE) AS x FROM s),
        l AS (SELECT 'rides' AS metric, x, CAST(rides AS DOUBLE) AS y FROM n UNION ALL SELECT 'load', x, load FROM n UNION ALL SELECT 'max_ftp', x, max_ftp FROM n UNION ALL SELECT 'avg_watts', x, avg_watts FROM n),
        f AS (SELECT metric, regr_slope(y,x) AS s, regr_intercept(y,x) AS b, regr_r2(y,x) AS r, max(x)+1 AS nx FROM l GROUP BY metric HAVING count(y) >= 3)
        SELECT metric, ahead, round(s,4) AS slope, round(r,4) AS r2, round(b+s*(nx+ahead-1),4) AS predicted, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'stable' END AS trend FROM f, (VALUES (1),(2),(3)) a(ahead)""")),
    "zscore": (q(A.zscores, ["moving_time", "distance"]), R("SELECT id, round((moving_time-(SELECT avg(moving_time) FROM rides))/nullif((SELECT stddev_pop(moving_time) FROM rides),0),6) AS z_moving_time, round((distance-(SELECT avg(distance) FROM rides))/nullif((SELECT stddev_pop(distance) FROM rides),0),6) AS z_distance FROM rides")),
    "feat_basic": (q(X.basic), R(f"SELECT id, round({some('icu_normalized_watts')}/{some('icu_average_watts')},9) AS power_vi, round({some('icu_average_watts')}/{some('max_power')},9) AS power_max_ratio, round({some('average_heartrate')}/{some('max_heartrate')},9) AS hr_reserve_used, round({some('total_elevation_gain')}/({some('distance')}/1000),9) AS altitude_per_km FROM rides")),
    "feat_zones": (q(X.zones), R(f""", z AS (SELECT *, {NZ} AS t FROM rides), p AS (SELECT *, {", ".join(f"{_p(k)} AS p{k}" for k in range(1, 8))} FROM z WHERE t > 0)
        SELECT id, round(sqrt(({" + ".join(f"(p{k}-1.0/7)*(p{k}-1.0/7)" for k in range(1, 8))})/7),9) AS zone_std, round(CASE WHEN {M2}>1e-18 THEN ({" + ".join(f"pow(p{k}-1.0/7,3)" for k in range(1, 8))})/7/pow({M2},1.5) ELSE 0 END,6) AS zone_skew, round(-({" + ".join(f"CASE WHEN p{k}>0 THEN p{k}*ln(p{k}) ELSE 0 END" for k in range(1, 8))}),9) AS zone_entropy,
         round((p1+p5)/(p2+p3+p4+0.01),9) AS polarization, round((p1+p2+p3)/(p4+p5+p6+p7+0.01),9) AS aerobic_ratio, round(p3+p4,9) AS sweet_spot, round(p5+p6+p7,9) AS high FROM p""")),
    "feat_power": (q(X.power), R(f""", i AS (SELECT *, {some('icu_normalized_watts')}/nullif({FTP},0) AS i FROM rides) SELECT id, round(i,9) AS intensity, CASE WHEN i IS NULL THEN NULL WHEN i>=1.05 THEN 6 WHEN i>=0.95 THEN 5 WHEN i>=0.85 THEN 4 WHEN i>=0.75 THEN 3 WHEN i>=0.55 THEN 2 ELSE 1 END AS training_level,
        round({some('icu_average_watts')}/70,9) AS watts_per_kg, round({some('icu_normalized_watts')}/70,9) AS np_per_kg, round({some('icu_average_watts')}*60/(85.0*2*pi()*0.1725),9) AS force_n FROM i""")),
    "feat_hr": (q(X.heart), R(f"SELECT id, round({some('icu_average_watts')}/{some('average_heartrate')},9) AS power_per_beat, round({some('icu_normalized_watts')}/{some('average_heartrate')},9) AS np_per_beat, round({some('average_heartrate')}*{some('moving_time')}/3600,9) AS hr_load FROM rides")),
    "feat_efficiency": (q(X.efficiency), R(f"SELECT id, round({some('distance')}/{some('moving_time')}/{some('icu_average_watts')},9) AS speed_per_watt, round({some('total_elevation_gain')}/({some('moving_time')}/3600),9) AS vam, round({some('moving_time')}/{some('elapsed_time')},9) AS moving_ratio, round({some('icu_average_watts')}/{some('average_heartrate')},9) AS power_hr_ratio, round({some('icu_normalized_watts')}/{some('average_heartrate')},9) AS np_hr_ratio FROM rides")),
    "feat_variability": (q(X.variability), R(f"SELECT id, round({some('icu_normalized_watts')}/{some('icu_average_watts')},9) AS vi, round(1/(1+abs({some('max_power')}/{some('icu_average_watts')}-1)),9) AS smooth_index FROM rides")),
    "power_per_beat": (q(lambda d: d.where("average_heartrate > 0 and icu_average_watts is not null").select("id", A.day_text(d["start_date_local"]).alias("day"), A.r6(d["icu_average_watts"] / d["average_heartrate"]).alias("watts_per_beat"))), R(f"SELECT id, {DAY} AS day, round(icu_average_watts/average_heartrate,6) AS watts_per_beat FROM rides WHERE average_heartrate > 0 AND icu_average_watts IS NOT NULL")),
    "vi_histogram": (q(lambda d: d.withColumn("vi", A.F.try_divide("icu_normalized_watts", "icu_average_watts")).where("vi is not null").groupBy(A.F.least(A.F.greatest(A.F.floor((A.F.col("vi") - 1) * 20), A.F.lit(0)), A.F.lit(19)).alias("bin")).agg(A.F.count("*").alias("rides"))), R("SELECT least(greatest(CAST(floor((icu_normalized_watts/icu_average_watts-1)*20) AS BIGINT),0),19) AS bin, count(*) AS rides FROM rides WHERE icu_normalized_watts/nullif(icu_average_watts,0) IS NOT NULL GROUP BY 1")),
    "zone_means": (q(lambda d: d.agg(*[A.r6(A.F.avg(z)).alias(z) for z in A.ZONES])), R("SELECT " + ", ".join(f"round(avg(z{k}_secs),6) AS z{k}_secs" for k in range(1, 8)) + " FROM rides")),
}

SHEET = "SELECT '{section}' AS section, CAST({label} AS VARCHAR) AS label, CAST({value} AS DOUBLE) AS value FROM ({sql})"
_part = lambda section, label, value, of: SHEET.format(section=section, label=label, value=value, sql=QUERIES[of][1])
QUERIES |= {
    "power_sheet": (q(A.power_sheet), " UNION ALL ".join([_part("ftp", "day", "ftp", "ftp_progression"), _part("zone_hours", "zone", "hours", "power_zones"), _part("curve_watts", "duration_s", "watts", "power_curve")])),
    "predictions_sheet": (q(A.predictions_sheet), " UNION ALL ".join([_part("season", "metric || ' +' || ahead", "predicted", "season_forecast"), *[_part("readiness", f"'{c}'", c, "readiness") for c in ("form", "consistency", "intensity", "recovery", "overall")]])),
}
QUERIES |= {
    "power_comparison": (q(A.power_comparison), R("SELECT round(avg(icu_average_watts),6) AS avg_watts, round(avg(icu_normalized_watts),6) AS np_watts, round(avg(max_power),6) AS max_watts, round(avg(icu_normalized_watts/nullif(icu_average_watts,0)),6) AS variability FROM rides")),
    "monthly_trends": (q(A.monthly_trends), R("SELECT strftime(date_trunc('month', start_date_local), '%Y-%m-%d') AS month, round(avg(icu_normalized_watts),6) AS np_watts, round(avg(icu_average_watts/nullif(average_heartrate,0)),6) AS watts_per_beat, round(avg(average_heartrate),6) AS heart_rate FROM rides GROUP BY 1")),
    "heart_histogram": (q(A.heart_histogram), R("SELECT CAST(floor(average_heartrate/5)*5 AS BIGINT) AS bin, count(*) AS rides FROM rides WHERE average_heartrate IS NOT NULL GROUP BY 1")),
}
