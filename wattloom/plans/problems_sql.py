"""SQL that the problems' queries are checked against, over whole tables."""

from __future__ import annotations

PERIODS = """r AS (SELECT activity_id, CAST(floor(epoch_us(timestamp)/1e7) AS BIGINT)*10 AS p, power, heart_rate FROM fit_records WHERE activity_id IS NOT NULL AND timestamp IS NOT NULL),
 f AS (SELECT activity_id, 'power' AS field_name, p, CAST(power AS DOUBLE) AS v FROM r UNION ALL SELECT activity_id, 'heart_rate', p, CAST(heart_rate AS DOUBLE) FROM r),
 b AS (SELECT activity_id, field_name, min(p) AS lo, max(p) AS hi FROM f GROUP BY 1, 2 HAVING count(v) > 0),
 g AS (SELECT activity_id, field_name, unnest(generate_series(lo, hi, 10)) AS p FROM b),
 m AS (SELECT activity_id, field_name, p, avg(v) AS v FROM f WHERE v IS NOT NULL GROUP BY 1, 2, 3)"""

P1_FOUND = f"WITH {PERIODS} SELECT g.activity_id, g.field_name, g.p AS period_start FROM g LEFT JOIN m ON g.activity_id = m.activity_id AND g.field_name = m.field_name AND g.p = m.p WHERE m.v IS NULL"

P1_GRID = f"""WITH {PERIODS}, j AS (SELECT g.activity_id, g.field_name, g.p, m.v, max(CASE WHEN m.v IS NOT NULL THEN g.p END) OVER (PARTITION BY g.activity_id, g.field_name ORDER BY g.p) AS a,
  min(CASE WHEN m.v IS NOT NULL THEN g.p END) OVER (PARTITION BY g.activity_id, g.field_name ORDER BY g.p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z
  FROM g LEFT JOIN m ON g.activity_id = m.activity_id AND g.field_name = m.field_name AND g.p = m.p)
 SELECT j.activity_id, j.field_name, j.p AS period_start, CASE WHEN j.v IS NOT NULL THEN j.v WHEN z - a <= 70 THEN x.v + (j.p - a) * 1.0 / (z - a) * (y.v - x.v) END AS value,
  CASE WHEN j.v IS NOT NULL THEN 'measured' WHEN z - a <= 70 THEN 'interpolated' ELSE 'missing' END AS mark
 FROM j LEFT JOIN m x ON j.activity_id = x.activity_id AND j.field_name = x.field_name AND j.a = x.p LEFT JOIN m y ON j.activity_id = y.activity_id AND j.field_name = y.field_name AND j.z = y.p"""


#: Units of recordings by the least squared deviation from the ride's pace, units in text by their spelling, or the recording's.
SAID = r"""CASE WHEN field_name = 'position_lat' THEN CASE WHEN v LIKE '%°%''%' THEN 'dms' WHEN regexp_matches(v, '[°NS]') THEN 'degrees' END
  WHEN field_name = 'speed' THEN CASE WHEN regexp_matches(lower(v), '(mph|mi/h)$') THEN 'mph' WHEN regexp_matches(lower(v), '(kph|km/h|kmh)$') THEN 'km/h' WHEN regexp_matches(lower(v), '(mps|m/s)$') THEN 'm/s' END
  ELSE CASE WHEN regexp_matches(lower(v), '(mi|miles|mile\(s\))$') THEN 'mi' WHEN regexp_matches(lower(v), '(km|kilometers)$') THEN 'km' WHEN regexp_matches(lower(v), '(m|metres|meters)$') THEN 'm' END END"""
P4_FOUND = f"""WITH q AS (SELECT activity_id, total_distance / nullif(total_timer_time, 0) AS p, 0 AS k FROM fit_sessions UNION ALL SELECT id, distance / nullif(moving_time, 0), 1 FROM activities),
 pace AS (SELECT activity_id, coalesce(avg(p) FILTER (WHERE k = 0), avg(p) FILTER (WHERE k = 1)) AS pace FROM q WHERE activity_id IS NOT NULL AND p > 0.3 AND p < 40 GROUP BY 1),
 r AS (SELECT activity_id, avg(speed) AS v, max(abs(position_lat)) AS lat, count(distance) AS nd, count(speed) AS nv, arg_max(distance, timestamp) FILTER (WHERE distance IS NOT NULL) - arg_min(distance, timestamp) FILTER (WHERE distance IS NOT NULL) AS d,
  (max(epoch_us(timestamp)) FILTER (WHERE distance IS NOT NULL) - min(epoch_us(timestamp)) FILTER (WHERE distance IS NOT NULL)) / 1e6 AS t FROM fit_records WHERE activity_id IS NOT NULL GROUP BY 1),
 l AS (SELECT r.*, CASE WHEN v > 0 THEN ln(v) END AS lv, CASE WHEN d > 0 AND t > 0 THEN ln(d / t) END AS ld, ln(coalesce(pace, 7.0)) AS lp, CASE WHEN pace > 0 THEN 0.15 ELSE 0.4 END AS w FROM r LEFT JOIN pace ON r.activity_id = pace.activity_id),
 u AS (SELECT l.*, su, du, coalesce(pow((lv + ln(sf) - lp) / w, 2), 0) + coalesce(pow((ld + ln(df) - lp) / w, 2), 0) + coalesce(pow((lv + ln(sf) - ld - ln(df)) / 0.04, 2), 0) AS cost
  FROM l, (VALUES ('m/s', 1.0), ('km/h', 1 / 3.6), ('mph', 0.44704)) a(su, sf), (VALUES ('m', 1.0), ('km', 1000.0), ('mi', 1609.344)) b(du, df)),
 b AS (SELECT activity_id, any_value(nv) AS nv, any_value(nd) AS nd, any_value(lat) AS lat, arg_min(su, cost) AS su, arg_min(du, cost) AS du FROM u GROUP BY 1),
 x AS (SELECT raw_id, activity_id, field_name, trim(v) AS v FROM (SELECT raw_id, activity_id, speed, distance, position_lat FROM raw_records) UNPIVOT (v FOR field_name IN (speed, distance, position_lat))),
 y AS (SELECT *, {SAID} AS said FROM x), n AS (SELECT activity_id, field_name, mode(said) AS won, max(abs(try_cast(replace(v, ',', '.') AS DOUBLE))) AS top FROM y GROUP BY 1, 2),
 z AS (SELECT raw_id, y.field_name, CASE WHEN said IS NOT NULL THEN said WHEN y.field_name = 'position_lat' AND abs(try_cast(replace(v, ',', '.') AS DOUBLE)) > 90 THEN 'semicircles' ELSE coalesce(won, CASE WHEN y.field_name = 'position_lat' AND top > 90 THEN 'semicircles' END) END AS unit_name
  FROM y JOIN n ON y.activity_id IS NOT DISTINCT FROM n.activity_id AND y.field_name = n.field_name)
 SELECT 'fit_records' AS source_table, activity_id AS row_key, 'speed' AS field_name, su AS unit_name FROM b WHERE nv > 0 AND su <> 'm/s' UNION ALL SELECT 'fit_records', activity_id, 'distance', du FROM b WHERE nd > 0 AND du <> 'm'
 UNION ALL SELECT 'fit_records', activity_id, 'position_lat', 'semicircles' FROM b WHERE lat > 90
 UNION ALL SELECT 'fit_sessions', CAST(session_id AS VARCHAR), 'left_right_balance', CASE WHEN left_right_balance BETWEEN 128 AND 228 THEN 'offset128' WHEN left_right_balance <= 10000 THEN 'percent_x100' ELSE 'percent_x1000' END FROM fit_sessions WHERE left_right_balance > 100
 UNION ALL SELECT 'raw_records', CAST(raw_id AS VARCHAR), field_name, unit_name FROM z WHERE unit_name NOT IN ('m/s', 'm', 'degrees')"""

#: Starts as UTC instants: start_date if present, else start_date_local with its own offset or the row's zone. Of a
#: wall-clock time that occurs twice the earlier instant.
INSTANT = r"""CASE WHEN regexp_full_match(u, '\d{13}') THEN epoch_ms(CAST(u AS BIGINT)) WHEN regexp_full_match(u, '\d{10}') THEN epoch_ms(CAST(u AS BIGINT)*1000)
  WHEN regexp_matches(u, '^[A-Z][a-z]{2}, ') THEN try_strptime(substr(u, 6, 20), '%d %b %Y %H:%M:%S') - CASE WHEN regexp_matches(u, '[+-]\d{4}$') THEN to_seconds(CAST(substr(u, -5, 1) || '1' AS INT) * (CAST(substr(u, -4, 2) AS INT)*3600 + CAST(substr(u, -2) AS INT)*60)) ELSE INTERVAL 0 SECOND END
  ELSE timezone('UTC', CAST(u || CASE WHEN regexp_matches(u, '(Z|[+-]\d{2}:?\d{2})$') THEN '' ELSE '+00' END AS TIMESTAMPTZ)) END"""
WALL = r"""CASE WHEN regexp_matches(s, '^\d{4}-') THEN try_cast(replace(regexp_extract(s, '^[0-9-]{10}[ T][0-9:.]+'), 'T', ' ') AS TIMESTAMP)
  WHEN regexp_matches(s, '^\d{1,2}\.') THEN coalesce(try_strptime(s, '%d.%m.%Y, %H:%M:%S'), try_strptime(s, '%d.%m.%Y %H:%M:%S'), try_strptime(s, '%d.%m.%Y, %H:%M'), try_strptime(s, '%d.%m.%Y %H:%M'))
  WHEN regexp_matches(s, '^\d{1,2}/') AND regexp_matches(s, '[AP]M$') THEN coalesce(try_strptime(s, '%m/%d/%Y %I:%M:%S %p'), try_strptime(s, '%m/%d/%Y %I:%M %p'))
  WHEN regexp_matches(s, '^\d{1,2}/') THEN coalesce(try_strptime(s, '%d/%m/%Y %H:%M:%S'), try_strptime(s, '%d/%m/%Y %H:%M'))
  WHEN regexp_matches(s, '^[A-Z][a-z]{2} ') THEN coalesce(try_strptime(s, '%b %d, %Y %I:%M:%S %p'), try_strptime(s, '%b %d, %Y, %I:%M:%S %p'), try_strptime(s, '%b %d, %Y %H:%M:%S')) END"""
OWN = r"""CASE WHEN regexp_matches(s, '^\d{4}-.*[+-]\d{2}:?\d{2}$') THEN CAST(regexp_extract(s, '([+-])\d{2}:?\d{2}$', 1) || '1' AS INT) * (CAST(regexp_extract(s, '(\d{2}):?\d{2}$', 1) AS INT)*3600 + CAST(right(s, 2) AS INT)*60) END"""


def early(wall: str, tz: str) -> str:
    """The instant of a wall clock in a zone, the earlier of two."""
    late = f"timezone('UTC', timezone({tz}, {wall}))"
    return f"CASE WHEN timezone({tz}, timezone('UTC', {late} - INTERVAL 1 HOUR)) = {wall} THEN {late} - INTERVAL 1 HOUR ELSE {late} END"


STARTS = f"""t AS (SELECT row_id, id, activities.athlete_id, trim(start_date_local) AS s, trim(start_date) AS u, nullif(regexp_extract(activities.timezone, '[A-Za-z]+/[A-Za-z_/]+'), '') AS stated, coalesce(stated, athletes.timezone) AS tz,
  CASE WHEN NOT isnan(distance) AND distance > 0 THEN ln(distance) END AS d, CASE WHEN moving_time > 0 THEN ln(moving_time) END AS m FROM activities LEFT JOIN athletes ON activities.athlete_id = athletes.athlete_id),
 l AS (SELECT *, {WALL} AS wall, {OWN} AS own FROM t),
 r AS (SELECT row_id, id, athlete_id, d, m, stated, tz, CAST(floor(epoch_us(coalesce({INSTANT}, wall - to_seconds(own), {early('wall', 'tz')})) / 1e6) AS BIGINT) AS start_s FROM l)"""
RAW_WALL = r"""CASE WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}') THEN CAST(s AS TIMESTAMP) WHEN regexp_matches(s, '[AP]M$') THEN try_strptime(s, '%b %d %Y %I:%M:%S %p') END"""
RAW_NUMBER = r"""CASE WHEN regexp_full_match(s, '\d{13}') THEN CAST(s AS BIGINT) // 1000 WHEN regexp_full_match(s, '\d{10}(\.\d+)?') THEN CAST(floor(CAST(s AS DOUBLE)) AS BIGINT) END"""
P5_FOUND = f"""WITH {STARTS},
 z AS (SELECT id, coalesce(arg_min(stated, row_id) FILTER (WHERE stated IS NOT NULL), arg_min(tz, row_id)) AS tz, min(start_s) AS near FROM r WHERE id IS NOT NULL GROUP BY id),
 w AS (SELECT raw_id, activity_id, record_no, trim(timestamp) AS s, coalesce(tz, 'UTC') AS tz, near FROM raw_records LEFT JOIN z ON activity_id = id),
 x AS (SELECT *, {RAW_WALL} AS wall, {RAW_NUMBER} AS num FROM w),
 y AS (SELECT *, {early('wall', 'tz')} AS e, CASE WHEN num IS NOT NULL THEN CASE WHEN abs(num + 631065600 - near) < abs(num - near) AND length(s) < 13 THEN num + 631065600 ELSE num END WHEN wall IS NULL THEN CAST(floor(epoch_us(CAST(s AS TIMESTAMPTZ)) / 1e6) AS BIGINT) END AS fixed FROM x),
 g AS (SELECT *, wall IS NOT NULL AND timezone(tz, timezone('UTC', e + INTERVAL 1 HOUR)) = wall AS twice FROM y),
 b AS (SELECT raw_id, activity_id, record_no, e, coalesce(e < lag(e) OVER o, false) AS back FROM g WHERE twice WINDOW o AS (PARTITION BY activity_id, CAST(e AS DATE) ORDER BY record_no, raw_id)),
 k AS (SELECT raw_id, max(back) OVER (PARTITION BY activity_id, CAST(e AS DATE) ORDER BY record_no, raw_id ROWS UNBOUNDED PRECEDING) AS late FROM b)
 SELECT 'activities' AS source_table, row_id AS row_key, start_s AS utc_s FROM r
 UNION ALL SELECT 'raw_records', g.raw_id, coalesce(fixed, epoch_us(e + CASE WHEN late THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) // 1000000) FROM g LEFT JOIN k ON g.raw_id = k.raw_id"""

#: The rider's local day of each ride: date parts by the shape that its exporting system writes.
LOCAL_DAY = r"""CASE
  WHEN regexp_matches(s, '^\d{4}-') THEN try_cast(substr(s, 1, 10) AS DATE)
  WHEN regexp_matches(s, '^\d{1,2}\.') THEN try_strptime(regexp_extract(s, '^\d{1,2}\.\d{1,2}\.\d{4}'), '%d.%m.%Y')::DATE
  WHEN regexp_matches(s, '^\d{1,2}/') AND regexp_matches(s, '[AP]M$') THEN try_strptime(regexp_extract(s, '^\d{1,2}/\d{1,2}/\d{4}'), '%m/%d/%Y')::DATE
  WHEN regexp_matches(s, '^\d{1,2}/') THEN try_strptime(regexp_extract(s, '^\d{1,2}/\d{1,2}/\d{4}'), '%d/%m/%Y')::DATE
  WHEN regexp_matches(s, '^[A-Z][a-z]{2} ') THEN try_strptime(regexp_extract(s, '^[A-Z][a-z]{2} \d{1,2}, \d{4}'), '%b %d, %Y')::DATE END"""
UTC = r"""CASE WHEN regexp_full_match(u, '\d{13}') THEN epoch_ms(CAST(u AS BIGINT)) WHEN regexp_full_match(u, '\d{10}') THEN epoch_ms(CAST(u AS BIGINT)*1000)
  WHEN regexp_matches(u, '^[A-Z][a-z]{2}, ') THEN try_strptime(substr(u, 6, 20), '%d %b %Y %H:%M:%S') ELSE timezone('UTC', CAST(u || CASE WHEN regexp_matches(u, '(Z|[+-]\d{2}:\d{2})$') THEN '' ELSE '+00' END AS TIMESTAMPTZ)) END"""
DAILY = f"""f AS (SELECT * FROM activities QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1),
 t AS (SELECT f.athlete_id, trim(start_date_local) AS s, start_date AS u, coalesce(nullif(regexp_extract(f.timezone, '[A-Za-z]+/[A-Za-z_]+'), ''), a.timezone) AS tz, icu_training_load AS l, moving_time AS m FROM f LEFT JOIN athletes a ON f.athlete_id = a.athlete_id),
 d AS (SELECT athlete_id, coalesce({LOCAL_DAY}, CASE WHEN s IS NULL THEN timezone(tz, timezone('UTC', {UTC}))::DATE END) AS day, l, m FROM t),
 s AS (SELECT athlete_id, day, sum(coalesce(l, 0)) AS load, sum(coalesce(m, 0)) AS secs, count(*) AS rides, max(coalesce(m, 0)) AS longest FROM d WHERE day IS NOT NULL AND athlete_id IS NOT NULL GROUP BY 1, 2),
 c AS (SELECT athlete_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s GROUP BY 1),
 x AS (SELECT c.athlete_id, c.day, coalesce(load, 0) AS load, coalesce(secs, 0) AS secs, coalesce(rides, 0) AS rides, coalesce(longest, 0) AS longest FROM c LEFT JOIN s ON c.athlete_id = s.athlete_id AND c.day = s.day),
 w AS (SELECT athlete_id, day, {", ".join(f"sum(load) OVER w{k} AS load_{k}, sum(secs) OVER w{k} AS seconds_{k}, count(*) OVER w{k} AS n_{k}, sum(rides) OVER w{k} AS rides_{k}, max(longest) OVER w{k} AS longest_{k}" for k in (7, 30))} FROM x
  WINDOW w7 AS (PARTITION BY athlete_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY athlete_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
P6_TRAILING = f"WITH {DAILY} SELECT athlete_id, strftime(day, '%Y-%m-%d') AS ride_day, " + ", ".join(f"CAST(load_{k} AS BIGINT) AS load_{k}, load_{k}/n_{k} AS mean_load_{k}, CAST(seconds_{k} AS BIGINT) AS seconds_{k}, seconds_{k}/n_{k} AS mean_seconds_{k}, CAST(rides_{k} AS BIGINT) AS rides_{k}, CAST(longest_{k} AS BIGINT) AS longest_{k}" for k in (7, 30)) + " FROM w"
P6_FOUND = f"WITH {DAILY}, p AS (SELECT *, max(load_7) OVER (PARTITION BY athlete_id) AS t7, max(load_30) OVER (PARTITION BY athlete_id) AS t30 FROM w) " + " UNION ALL ".join(
    [f"SELECT athlete_id, strftime(day, '%Y-%m-%d') AS ride_day, 'peak_load_{k}' AS measure FROM p WHERE load_{k} = t{k} AND t{k} <> 0 UNION ALL SELECT athlete_id, strftime(day, '%Y-%m-%d'), 'idle_{k}' FROM p WHERE seconds_{k} = 0" for k in (7, 30)]
)


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_grid": P1_GRID, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p6_trailing": P6_TRAILING}
