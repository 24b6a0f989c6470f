"""Queries over the readings of recordings with the SQL each is checked against."""

from __future__ import annotations

from wattloom.operators import features as X
from wattloom.operators import records as T
from wattloom.operators import signal as S
from wattloom.operators.activity import r6
from wattloom.session import table


def q(f, *args, **kw):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "fit_records"), *args, **kw)


def D(sql: str, fields: str = "", where: str = "true") -> str:
    """SQL over ``o``: readings with t, fields, pos, n and the previous values p_*."""
    names = [f.strip() for f in fields.split(",") if f.strip()]
    cols = "".join(f", CAST({f} AS DOUBLE) AS {f}" for f in names)
    prev = "".join(f", lag({f}) OVER w AS p_{f}" for f in ["t", *names])
    return f"""WITH r AS (SELECT activity_id, record_id, epoch_us(timestamp)/1e6 AS t{cols} FROM fit_records WHERE activity_id IS NOT NULL AND timestamp IS NOT NULL AND {where}),
 o AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY activity_id) AS n{prev} FROM r WINDOW w AS (PARTITION BY activity_id ORDER BY t, record_id)) {sql}"""


NP = """, m AS (SELECT activity_id, pos, avg(power) OVER (PARTITION BY activity_id ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m FROM o),
 np AS (SELECT a.activity_id, round(coalesce(s.np, a.ap),6) AS np, a.ap, a.mp FROM (SELECT activity_id, avg(power) AS ap, max(CAST(power AS INTEGER)) AS mp FROM o GROUP BY 1) a LEFT JOIN (SELECT activity_id, pow(avg(pow(m,4)),0.25) AS np FROM m WHERE pos >= 30 GROUP BY 1) s ON a.activity_id = s.activity_id) """
DRIFT = "CASE WHEN max(n) < 2 OR avg(CASE WHEN pos <= floor(n/2) THEN {f} END) = 0 THEN 0.0 ELSE (avg(CASE WHEN pos > floor(n/2) THEN {f} END) - avg(CASE WHEN pos <= floor(n/2) THEN {f} END))/avg(CASE WHEN pos <= floor(n/2) THEN {f} END)*100 END"
QUARTER = "avg(CASE WHEN pos <= floor(n/4) THEN {f} END) AS a, avg(CASE WHEN pos > n - floor(n/4) THEN {f} END) AS z"
SKEW = "m3/pow(m2,1.5)"
MOMENTS = ", mu AS (SELECT activity_id, avg(power) AS mu, count(*) AS n FROM o GROUP BY 1), mm AS (SELECT o.activity_id, max(mu.n)::DOUBLE AS n, avg(pow(power-mu,2)) AS m2, avg(pow(power-mu,3)) AS m3, avg(pow(power-mu,4)) AS m4 FROM o JOIN mu ON o.activity_id = mu.activity_id GROUP BY 1) "


def _pct(cond: str, k: int) -> str:
    return f"round(count(*) FILTER (WHERE {cond})*100.0/count(*),6) AS zone_{k}_pct"


HR = ["p < 60", "p >= 60 AND p < 70", "p >= 70 AND p < 80", "p >= 80 AND p < 90", "p >= 90"]
PW = ["p < 55", "p >= 55 AND p <= 75", "p > 75 AND p <= 90", "p > 90 AND p <= 105", "p > 105 AND p <= 120", "p > 120 AND p <= 150", "p > 150"]
STATS = [f"round(avg({f}),6) AS avg_{f}, max(CAST({f} AS DOUBLE)) AS max_{f}, min(CAST({f} AS DOUBLE)) AS min_{f}" for f in ("cadence", "speed", "altitude", "temperature")]

HR_ZONES = D(", z AS (SELECT activity_id, heart_rate*100.0/max(heart_rate) OVER (PARTITION BY activity_id) AS p FROM o), s AS (SELECT activity_id, " + ", ".join(f"round(count(*) FILTER (WHERE {c})*100.0/count(*),6) AS z{k}" for k, c in enumerate(HR, 1)) + " FROM z GROUP BY 1), m AS (SELECT *, " + "+".join(f"z{k}" for k in range(1, 6)) + """ AS t FROM s),
 y AS (SELECT activity_id, z1, z2, z3, z4, z5, [z1/t-0.2, z2/t-0.2, z3/t-0.2, z4/t-0.2, z5/t-0.2] AS d, list_filter([z1/t, z2/t, z3/t, z4/t, z5/t], lambda x: x > 0) AS q FROM m)
 SELECT activity_id, round(sqrt(list_avg(list_transform(d, lambda x: x*x)))*100,6) AS hr_zone_std, round(list_avg(list_transform(d, lambda x: x*x*x))/pow(list_avg(list_transform(d, lambda x: x*x)),1.5),6) AS hr_zone_skew,
  round(-list_sum(list_transform(q, lambda x: x*ln(x))),6) AS hr_zone_entropy, round((z1+z5)/(z2+z3+z4+0.01),6) AS hr_polarization FROM y""", "heart_rate", "heart_rate IS NOT NULL")
RECORDING = "SELECT activity_id, round(1/(1+stddev_pop(cadence) FILTER (WHERE cadence > 0)),6) AS cadence_consistency, round(stddev_pop(power),6) AS power_variability, round(stddev_pop(power)/nullif(avg(power),0),6) AS power_cv, round(stddev_pop(heart_rate)/nullif(avg(heart_rate),0),6) AS hr_cv, round(stddev_pop(cadence) FILTER (WHERE cadence > 0)/nullif(avg(cadence) FILTER (WHERE cadence > 0),0),6) AS cadence_cv, " + ", ".join(f"round(count(*) FILTER (WHERE power > {w})*100.0/nullif(count(power),0),6) AS above_{w}w_pct" for w in (100, 150, 200, 250, 300, 350, 400, 450, 500)) + ", round(avg(altitude),6) AS avg_altitude, CAST(max(temperature)-min(temperature) AS DOUBLE) AS temp_variation, count(*) AS data_points, CASE WHEN avg(altitude) < 500 THEN 1 WHEN avg(altitude) < 1500 THEN 2 WHEN avg(altitude) < 2500 THEN 3 WHEN avg(altitude) IS NOT NULL THEN 4 END AS altitude_zone FROM fit_records WHERE activity_id IS NOT NULL GROUP BY 1"


def _rounded(df):
    return df.select("activity_id", *[r6(c).alias(c) for c in df.columns[1:]])


def _entropy(field: str) -> str:
    """Matching pairs of runs of two and of three readings, within a fifth of the deviation."""
    return D(f""", d AS (SELECT activity_id, 0.2 * stddev_pop({field}) AS r, any_value(n) AS n FROM o GROUP BY 1 HAVING any_value(n) > 10),
 u AS (SELECT o.activity_id, pos, n, {field} AS c, lag({field}) OVER w AS b, lag({field}, 2) OVER w AS a FROM o WINDOW w AS (PARTITION BY o.activity_id ORDER BY pos)),
 j AS (SELECT d.activity_id, any_value(d.n) AS n, count(*) AS two, count(*) FILTER (WHERE abs(x.a - y.a) <= r) AS three FROM u x JOIN d ON x.activity_id = d.activity_id JOIN u y ON x.activity_id = y.activity_id AND x.pos < y.pos AND abs(x.c - y.c) <= r AND abs(x.b - y.b) <= r GROUP BY 1)
 SELECT d.activity_id, round(CASE WHEN coalesce(two, 0) = 0 OR three = 0 THEN 0.0 ELSE -ln((three * 2.0 / ((d.n - 2) * (d.n - 3.0))) / (two * 2.0 / ((d.n - 1) * (d.n - 2.0)))) END, 6) AS e FROM d LEFT JOIN j ON d.activity_id = j.activity_id""", field, f"{field} IS NOT NULL")


#: The one-sided periodogram by its definition.
SPECTRAL = D(""", m AS (SELECT activity_id, avg(power) AS mu, any_value(n) AS n FROM o GROUP BY 1 HAVING any_value(n) > 10),
 f AS (SELECT activity_id, mu, n, unnest(generate_series(1, n // 2)) AS k FROM m),
 p AS (SELECT f.activity_id, f.k, any_value(f.n) AS n, (pow(sum((power - mu) * cos(2 * pi() * f.k * (pos - 1) / f.n)), 2) + pow(sum((power - mu) * sin(2 * pi() * f.k * (pos - 1) / f.n)), 2)) * CASE WHEN f.k < (any_value(f.n) + 1) // 2 THEN 2 ELSE 1 END AS w FROM f JOIN o ON f.activity_id = o.activity_id GROUP BY 1, 2),
 t AS (SELECT activity_id, sum(w) AS total FROM p GROUP BY 1)
 SELECT p.activity_id, round(CASE WHEN max(total) > 1e-9 THEN arg_max(k, w) * 1.0 / any_value(n) ELSE 0.0 END, 6) AS dominant_frequency, round(CASE WHEN max(total) > 1e-9 THEN -sum(w / total * ln(w / total + 1e-10)) ELSE 0.0 END, 6) AS spectral_entropy FROM p JOIN t ON p.activity_id = t.activity_id GROUP BY 1""", "power", "power IS NOT NULL")

QUERIES = {
    "feat_hr_zones": (q(X.heart_zones), HR_ZONES),
    "feat_recording": (q(X.recording), RECORDING),
    "elapsed_time": (q(T.elapsed_time), D("SELECT record_id, activity_id, round(t - min(t) OVER (PARTITION BY activity_id),6) AS elapsed_s, speed*3.6 AS speed_kmh, distance/1000 AS distance_km FROM o", "speed, distance")),
    "record_interval": (q(T.record_interval), D("SELECT activity_id, round(max(t)-min(t),6) AS elapsed_s, round(quantile_cont(t-p_t,0.5),6) AS median_gap_s, count(*) AS readings FROM o GROUP BY 1")),
    "hr_stats": (q(T.field_stats, "heart_rate", True), D("SELECT activity_id, round(avg(heart_rate),6) AS avg_heart_rate, max(heart_rate) AS max_heart_rate, min(heart_rate) AS min_heart_rate, round(stddev_samp(heart_rate),6) AS std_heart_rate FROM o GROUP BY 1", "heart_rate", "heart_rate IS NOT NULL")),
    "hr_zone_pct": (q(T.hr_zone_pct), D(", z AS (SELECT activity_id, heart_rate*100.0/max(heart_rate) OVER (PARTITION BY activity_id) AS p FROM o) SELECT activity_id, " + ", ".join(_pct(c, k) for k, c in enumerate(HR, 1)) + " FROM z GROUP BY 1", "heart_rate", "heart_rate IS NOT NULL")),
    "power_stats": (q(T.power_stats), D(NP + "SELECT activity_id, round(ap,6) AS avg_power, mp AS max_power, np AS normalized_power, round(np/nullif(ap,0),5) AS variability_index FROM np", "power", "power IS NOT NULL")),
    "normalized_power": (q(lambda d: T.normalized_power(d).select("activity_id", "normalized_power")), D(NP + "SELECT activity_id, np AS normalized_power FROM np", "power", "power IS NOT NULL")),
    "power_zone_pct": (q(T.power_zone_pct), D(", z AS (SELECT activity_id, power*100.0/250 AS p FROM o) SELECT activity_id, " + ", ".join(_pct(c, k) for k, c in enumerate(PW, 1)) + " FROM z GROUP BY 1", "power", "power IS NOT NULL")),
    "record_stats": (q(T.record_stats), "SELECT activity_id, " + ", ".join(STATS) + " FROM fit_records WHERE activity_id IS NOT NULL GROUP BY 1"),
    "elevation_gain": (q(T.elevation_gain), D("SELECT activity_id, round(coalesce(sum(CASE WHEN altitude-p_altitude > 1.0 THEN altitude-p_altitude END),0),6) AS gain_m FROM o GROUP BY 1", "altitude", "altitude IS NOT NULL")),
    "efficiency_factor": (q(T.efficiency_factor), D(NP + ", h AS (SELECT activity_id, avg(heart_rate) AS hr FROM fit_records WHERE heart_rate IS NOT NULL GROUP BY 1) SELECT np.activity_id, round(np/250,5) AS intensity_factor, round(np/nullif(hr,0),5) AS efficiency_factor FROM np LEFT JOIN h ON np.activity_id = h.activity_id", "power", "power IS NOT NULL")),
    "power_dist": (q(T.power_dist), D("SELECT activity_id, round(stddev_pop(power),6) AS std, round(stddev_pop(power)/nullif(avg(power),0),6) AS cv, round(quantile_cont(power,0.25),6) AS q25, round(quantile_cont(power,0.5),6) AS q50, round(quantile_cont(power,0.75),6) AS q75, round(quantile_cont(power,0.75)-quantile_cont(power,0.25),6) AS iqr FROM o GROUP BY 1", "power", "power IS NOT NULL")),
    "power_skew": (q(T.power_skew), D(MOMENTS + f"SELECT activity_id, round({SKEW}*n*n/((n-1)*(n-2)),4) AS skewness FROM mm WHERE n >= 3 AND m2 > 0", "power", "power IS NOT NULL")),
    "power_kurt": (q(T.power_kurt), D(MOMENTS + "SELECT activity_id, round(n*(n+1)/((n-1)*(n-2)*(n-3))*n*(m4/(m2*m2)) - 3*(n-1)*(n-1)/((n-2)*(n-3)),4) AS kurtosis FROM mm WHERE n >= 4 AND m2 > 0", "power", "power IS NOT NULL")),
    "power_smoothness": (q(T.power_smoothness), D("SELECT activity_id, round(stddev_pop(power-p_power),6) AS smoothness FROM o GROUP BY 1", "power", "power IS NOT NULL")),
    "time_above": (q(T.time_above), D("SELECT activity_id, " + ", ".join(f"round(count(*) FILTER (WHERE power > {w})*100.0/count(*),6) AS above_{w}_pct" for w in T.THRESHOLDS) + " FROM o GROUP BY 1", "power", "power IS NOT NULL")),
    "hr_drift": (q(T.hr_drift), D(f"SELECT activity_id, round(stddev_pop(heart_rate),6) AS std_hr, round(stddev_pop(heart_rate)/nullif(avg(heart_rate),0),6) AS cv_hr, round({DRIFT.format(f='heart_rate')},6) AS hr_drift_pct FROM o GROUP BY 1", "heart_rate", "heart_rate IS NOT NULL")),
    "decoupling": (q(T.decoupling), "WITH hd AS (" + D(f"SELECT activity_id, max(n) AS n, {DRIFT.format(f='heart_rate')} AS d FROM o GROUP BY 1", "heart_rate", "heart_rate IS NOT NULL") + "), pd AS (" + D(f"SELECT activity_id, max(n) AS n, {DRIFT.format(f='power')} AS d FROM o GROUP BY 1", "power", "power IS NOT NULL") + ") SELECT hd.activity_id, round(CASE WHEN hd.n = pd.n THEN hd.d - pd.d ELSE 0.0 END,6) AS decoupling_pct FROM hd JOIN pd ON hd.activity_id = pd.activity_id"),
    "pedal_stats": (q(T.pedal_stats), D("SELECT activity_id, round(stddev_pop(cadence),6) AS std_cadence, round(stddev_pop(cadence)/nullif(avg(cadence),0),6) AS cv_cadence, count(*) AS pedalled FROM o GROUP BY 1", "cadence", "cadence > 0")),
    "terrain_stats": (q(T.terrain_stats), "WITH a AS (" + D("SELECT activity_id, round(stddev_pop(altitude-p_altitude),6) AS s FROM o GROUP BY 1", "altitude", "altitude IS NOT NULL") + "), b AS (SELECT activity_id, CAST(max(temperature)-min(temperature) AS DOUBLE) AS temp_range, round(stddev_pop(temperature),6) AS temp_std FROM fit_records WHERE activity_id IS NOT NULL GROUP BY 1) SELECT b.activity_id, s AS altitude_change_std, temp_range, temp_std FROM b LEFT JOIN a ON a.activity_id = b.activity_id"),
    "power_hr_corr": (q(T.power_hr_corr), "SELECT activity_id, round(corr(power, heart_rate),5) AS power_hr_corr FROM fit_records WHERE power IS NOT NULL AND heart_rate IS NOT NULL AND activity_id IS NOT NULL GROUP BY 1 HAVING count(*) > 10"),
    "power_fade": (q(T.power_fade), "WITH p AS (" + D(f"SELECT activity_id, {QUARTER.format(f='power')} FROM o WHERE n > 100 GROUP BY 1", "power", "power IS NOT NULL") + "), h AS (" + D(f"SELECT activity_id, {QUARTER.format(f='heart_rate')} FROM o WHERE n > 100 GROUP BY 1", "heart_rate", "heart_rate IS NOT NULL") + ") SELECT coalesce(x.activity_id, y.activity_id) AS activity_id, x.f AS power_fade_pct, y.f AS hr_rise_pct FROM (SELECT activity_id, round((a-z)/a*100,6) AS f FROM p WHERE a > 0) x FULL JOIN (SELECT activity_id, round((z-a)/a*100,6) AS f FROM h WHERE a > 0) y ON x.activity_id = y.activity_id"),
    "cadence_stability": (q(T.cadence_stability), D("SELECT activity_id, round(1/(1+round(stddev_pop(cadence)/nullif(avg(cadence),0),6)),6) AS stability, round(1/(1+stddev_pop(cadence-p_cadence)),6) AS smoothness FROM o GROUP BY 1", "cadence", "cadence > 0")),
    "spectral": (lambda s, d: _rounded(S.spectral(table(s, d, "fit_records"))), SPECTRAL),
    "autocorr": (q(S.autocorr), D(""", m AS (SELECT activity_id, avg(power) AS mu, any_value(n) AS n FROM o GROUP BY 1 HAVING any_value(n) > 60),
 k AS (SELECT a.activity_id, b.pos - a.pos AS lag, sum((a.power - mu) * (b.power - mu)) AS r FROM o a JOIN m ON a.activity_id = m.activity_id JOIN o b ON a.activity_id = b.activity_id AND b.pos BETWEEN a.pos AND a.pos + 59 GROUP BY 1, 2)
 SELECT activity_id, coalesce(CASE WHEN max(r) FILTER (WHERE lag = 0) > 0 THEN CAST(arg_min(lag, round(r, 6)) FILTER (WHERE lag > 0) AS DOUBLE) END, 0.0) AS period_s FROM k GROUP BY 1""", "power", "power IS NOT NULL")),
    "coherence": (q(S.coherence), None),
    "sample_entropy": (lambda s, d: _rounded(S.entropy(table(s, d, "fit_records"))), f"SELECT coalesce(h.activity_id, p.activity_id) AS activity_id, h.e AS sample_entropy, p.e AS power_sample_entropy FROM ({_entropy('heart_rate')}) h FULL JOIN ({_entropy('power')}) p ON h.activity_id = p.activity_id"),
    "dfa": (q(S.dfa), None),
}
