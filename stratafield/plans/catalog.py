"""Registered queries of the survey operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window, functions as F

from stratafield.functions import angles, clock, geodesy, styling
from stratafield.operators import anomaly, asof, grid, kinematics, layers, radar, segments, spectral, survey, tables

from . import views
from .views import r6, rounded, sql

HELD: dict[str, tuple[Callable, str | None]] = {}
LINE = "PARTITION BY line_id ORDER BY seq"


def query(oracle: str | None = None):
    def hold(f):
        HELD[f.__name__] = (f, oracle)
        return f

    return hold


def queries() -> dict:
    from . import more  # noqa: F401  registers its queries

    return {k: f for k, (f, _) in HELD.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in HELD.items() if s}


# tracks


def _heads(s, d):
    return kinematics.heading_backward(views.track(s, d))


def _stable(s, d):
    return kinematics.stability(kinematics.heading_change(kinematics.speed_ms(_heads(s, d))), 5)


def _runs(s, d):
    return segments.islands(_stable(s, d), 75.0, 0.0, 4)


def _members(s, d):
    rows = segments.segment_rows(_stable(s, d), _runs(s, d))
    return rows.withColumn("direction", angles.cardinal(F.col("mean_heading")))


@query(sql("heads", f"SELECT line_id, seq, {r6('heading')} AS heading FROM heads"))
def track_heading(s, d):
    return rounded(_heads(s, d), "heading").select("line_id", "seq", "heading")


@query(sql("track", f"""SELECT line_id, seq, {r6(f"coalesce(h, lag(h) OVER ({LINE}), 0.0)")} AS heading FROM (SELECT *, CASE WHEN a < 0 THEN a + 360 ELSE a END AS h FROM
    (SELECT *, degrees(atan2(lead(easting) OVER w - easting, lead(northing) OVER w - northing)) AS a FROM track WINDOW w AS ({LINE})))"""))
def track_heading_fwd(s, d):
    return rounded(kinematics.heading_forward(views.track(s, d)), "heading").select("line_id", "seq", "heading")


@query(sql("speeds", f"SELECT line_id, seq, {r6('speed')} AS speed FROM speeds"))
def track_speed(s, d):
    return rounded(kinematics.speed_ms(views.track(s, d)), "speed").select("line_id", "seq", "speed")


@query(sql("track", f"""SELECT line_id, seq, {r6(f"coalesce(x, lag(x) OVER ({LINE}), 0.0)")} AS speed_kmh FROM (
    SELECT t.*, CASE WHEN t.n - 1 > 5 THEN m.x ELSE t.v END AS x FROM
      (SELECT *, count(*) OVER (PARTITION BY line_id) AS n, least(500.0, sqrt(pow(lead(easting) OVER w - easting, 2) + pow(lead(northing) OVER w - northing, 2)) / greatest(0.01, least(60.0, (lead(t_ms) OVER w - t_ms) / 1000.0::DOUBLE)) * 3.6) AS v FROM track WINDOW w AS ({LINE})) t
    LEFT JOIN (SELECT a.line_id, a.seq, avg(b.v) AS x FROM
        (SELECT line_id, seq, max(seq) OVER (PARTITION BY line_id) AS n FROM track) a JOIN (SELECT line_id, seq, least(500.0, sqrt(pow(lead(easting) OVER w - easting, 2) + pow(lead(northing) OVER w - northing, 2)) / greatest(0.01, least(60.0, (lead(t_ms) OVER w - t_ms) / 1000.0::DOUBLE)) * 3.6) AS v FROM track WINDOW w AS ({LINE})) b
        ON a.line_id = b.line_id AND a.seq < a.n AND b.v IS NOT NULL JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS o) o
        ON b.seq = CASE WHEN a.seq + o.o < 0 THEN -1 - (a.seq + o.o) WHEN a.seq + o.o >= a.n THEN 2 * a.n - 1 - (a.seq + o.o) ELSE a.seq + o.o END GROUP BY a.line_id, a.seq) m
    ON t.line_id = m.line_id AND t.seq = m.seq)"""))
def track_speed_kmh(s, d):
    return rounded(kinematics.speed_kmh(views.track(s, d)), "speed_kmh").select("line_id", "seq", "speed_kmh")


@query(sql("heads", f"""SELECT a.line_id, a.seq, {r6("(degrees(atan2(avg(sin(radians(b.heading))), avg(cos(radians(b.heading))))) + 360) % 360")} AS smooth_heading FROM
    (SELECT line_id, seq, count(*) OVER (PARTITION BY line_id) AS n FROM heads) a JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS o) o ON true
    JOIN heads b ON a.line_id = b.line_id AND b.seq = CASE WHEN a.seq + o.o < 0 THEN -1 - (a.seq + o.o) WHEN a.seq + o.o >= a.n THEN 2 * a.n - 1 - (a.seq + o.o) ELSE a.seq + o.o END GROUP BY a.line_id, a.seq"""))
def heading_smooth(s, d):
    return rounded(kinematics.smooth_heading(_heads(s, d), 5), "smooth_heading").select("line_id", "seq", "smooth_heading")


@query(sql("changes", f"SELECT line_id, seq, {r6('heading_change')} AS heading_change FROM changes"))
def heading_change(s, d):
    return rounded(kinematics.heading_change(_heads(s, d)), "heading_change").select("line_id", "seq", "heading_change")


@query(sql("stable", f"SELECT line_id, seq, {r6('stability')} AS stability FROM stable"))
def stability_metric(s, d):
    return rounded(_stable(s, d), "stability").select("line_id", "seq", "stability")


@query(sql("runs", f"SELECT line_id, start_seq, end_seq, n_rows, {r6('(m0 + 360) % 360')} AS mean_heading FROM runs"))
def stable_islands(s, d):
    return rounded(_runs(s, d), "mean_heading").select("line_id", "start_seq", "end_seq", "n_rows", "mean_heading")


_RUNS2 = sql("stable", "SELECT 1").replace("SELECT 1", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """,
    flags AS (SELECT *, stability < 75 AND speed > 0 AS ok FROM stable),
    marks AS (SELECT *, sum(CASE WHEN ok <> coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY seq) AS island FROM (SELECT *, lag(ok) OVER (PARTITION BY line_id ORDER BY seq) AS prev FROM flags)),
    runs AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY start_seq) AS i FROM (SELECT line_id, min(seq) AS start_seq, max(seq) AS end_seq, (degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) + 360) % 360 AS h
      FROM marks WHERE ok GROUP BY line_id, island HAVING count(*) >= 2)),
    pre AS (SELECT line_id, seq, sum(sin(radians(heading))) OVER w AS s, sum(cos(radians(heading))) OVER w AS c FROM stable WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    fold AS (SELECT line_id, i, start_seq, end_seq, h FROM runs WHERE i = 1 UNION ALL SELECT line_id, i, CASE WHEN m THEN fs ELSE ns END, ne, CASE WHEN m THEN (degrees(atan2(s1 - s0, c1 - c0)) + 360) % 360 ELSE nh END FROM (
      SELECT f.line_id, n.i, f.start_seq AS fs, n.start_seq AS ns, n.end_seq AS ne, n.h AS nh, e.s AS s1, e.c AS c1, coalesce(b.s, 0) AS s0, coalesce(b.c, 0) AS c0, least(abs(f.h - n.h), 360 - abs(f.h - n.h)) <= 15 AND n.start_seq - f.end_seq <= 3 AS m
      FROM fold f JOIN runs n ON n.line_id = f.line_id AND n.i = f.i + 1 JOIN pre e ON e.line_id = n.line_id AND e.seq = n.end_seq LEFT JOIN pre b ON b.line_id = f.line_id AND b.seq = f.start_seq - 1))"""


@query(_RUNS2 + f""" SELECT f.line_id, f.start_seq, f.end_seq, {r6("f.h")} AS mean_heading FROM fold f LEFT JOIN fold n ON n.line_id = f.line_id AND n.i = f.i + 1 WHERE (n.i IS NULL OR n.start_seq <> f.start_seq) AND f.end_seq - f.start_seq >= 3""")
def islands_merged(s, d):
    track = _stable(s, d)
    return rounded(segments.merge_islands(track, segments.islands(track, 75.0, 0.0, 2), 15.0, 3), "mean_heading")


@query()
def gamma_segments(s, d):
    track = kinematics.speed_kmh(kinematics.heading_forward(views.track(s, d)))
    return rounded(segments.scan_segments(track, 4, 40.0, 5, 6, 0.0, 500.0), "mean_heading")


@query(sql("members", f"""SELECT direction, count(DISTINCT line_id * 1000000 + start_seq) AS n_lines, count(*) AS n_points,
    {r6("(degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) + 360) % 360")} AS mean_heading, {r6("stddev_pop(heading)")} AS std_heading FROM members GROUP BY direction"""))
def segment_stats(s, d):
    return rounded(segments.segment_statistics(_members(s, d)), "mean_heading", "std_heading")


@query(sql("members", f"""SELECT direction, count(*) AS n_segments, CAST(sum(p) AS BIGINT) AS total_points, {r6("avg(p)")} AS avg_points, min(p) AS min_points, max(p) AS max_points
    FROM (SELECT direction, line_id, start_seq, count(*) AS p FROM members GROUP BY ALL) GROUP BY direction"""))
def gamma_segment_stats(s, d):
    return rounded(segments.size_statistics(_members(s, d)), "avg_points")


@query(sql("members", "SELECT direction, count(*) AS n_points FROM members GROUP BY direction ORDER BY n_points DESC, direction LIMIT 2"))
def top_directions(s, d):
    return segments.top_directions(segments.segment_statistics(_members(s, d))).select("direction", "n_points")


@query(sql("members", "SELECT line_id, seq, start_seq, end_seq, direction FROM members"))
def segment_rows(s, d):
    return _members(s, d).select("line_id", "seq", "start_seq", "end_seq", "direction")


@query(sql("members", "SELECT line_id, start_seq, direction, row_number() OVER (PARTITION BY direction ORDER BY line_id, start_seq) AS line_no FROM (SELECT DISTINCT line_id, start_seq, direction FROM members)"))
def line_ordinals(s, d):
    return segments.line_numbers(_members(s, d).select("line_id", "start_seq", "direction").distinct()).withColumn("line_no", F.col("line_no").cast("long"))


@query(sql("runs", f""", listed AS (SELECT line_id % 5 AS survey, row_number() OVER (PARTITION BY line_id % 5 ORDER BY line_id, start_seq) AS run_no, line_id, start_seq, (m0 + 360) % 360 AS h FROM runs),
    walked AS (SELECT survey, 0::BIGINT AS run_no, CAST([] AS DOUBLE[]) AS heads, 0::BIGINT AS heading_group FROM (SELECT DISTINCT survey FROM listed) UNION ALL
      SELECT survey, run_no, CASE WHEN hit IS NULL THEN list_append(heads, h) ELSE heads END, coalesce(hit, len(heads) + 1) - 1 FROM
      (SELECT w.survey, l.run_no, heads, l.h, list_position(list_transform(heads, lambda x: least(abs(x - l.h), 360 - abs(x - l.h)) <= 10.0), true) AS hit FROM walked w JOIN listed l ON l.survey = w.survey AND l.run_no = w.run_no + 1))
    SELECT survey, run_no, line_id, start_seq, {r6("h")} AS mean_heading, heading_group FROM walked JOIN listed USING (survey, run_no)""").replace(")\n, listed", "),\nlisted").replace("WITH track0", "WITH RECURSIVE track0", 1))
def heading_groups(s, d):
    runs = _runs(s, d).withColumns({"survey": F.col("line_id") % 5, "run_no": F.row_number().over(Window.partitionBy(F.col("line_id") % 5).orderBy("line_id", "start_seq"))})
    return rounded(segments.group_headings(runs.select("survey", "run_no", "line_id", "start_seq", "mean_heading")), "mean_heading")


@query(sql("heads", f"SELECT line_id, {r6('(degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) + 360) % 360')} AS mean_heading FROM heads GROUP BY line_id"))
def circular_mean(s, d):
    return rounded(_heads(s, d).groupBy("line_id").agg(angles.circular_mean(F.col("heading")).alias("mean_heading")), "mean_heading")


@query(sql("heads", "SELECT ['North', 'Northeast', 'East', 'Southeast', 'South', 'Southwest', 'West', 'Northwest'][CAST(floor(((heading + 22.5) % 360) / 45) AS INTEGER) + 1] AS sector, count(*) AS n FROM heads GROUP BY 1"))
def cardinal_bins(s, d):
    return _heads(s, d).groupBy(angles.cardinal(F.col("heading"), angles.LONG_CARDINALS).alias("sector")).agg(F.count("*").alias("n"))


@query(sql("track", f"SELECT line_id, count(*) AS n, {r6('min_by(easting, seq)')} AS first_x, {r6('max_by(northing, seq)')} AS last_y FROM track GROUP BY line_id HAVING count(*) >= 2"))
def linestrings(s, d):
    lines = segments.linestrings(views.track(s, d))
    return lines.select("line_id", F.size("points").cast("long").alias("n"), F.round(F.element_at("points", 1)[0], 6).alias("first_x"), F.round(F.element_at("points", -1)[1], 6).alias("last_y"))


@query(sql("track", f"SELECT line_id, seq, round((t_ms - first_value(t_ms) OVER ({LINE})) / 3600000.0::DOUBLE, 8) + 0.0 AS elapsed_h FROM track"))
def elapsed_hours(s, d):
    return kinematics.elapsed_hours(views.track(s, d)).select("line_id", "seq", F.round("elapsed_h", 8).alias("elapsed_h"))


_STEP = "coalesce(sqrt(pow(easting - lag(easting) OVER w, 2) + pow(northing - lag(northing) OVER w, 2)), 0.0)"
_DIST = f"dist AS (SELECT line_id, seq, field, sum(st) OVER ({LINE}) AS dist_m FROM (SELECT *, {_STEP} AS st FROM track WINDOW w AS ({LINE})))"


def _distances(s, d):
    track = views.track(s, d)
    step = F.hypot(F.col("easting") - F.lag("easting").over(kinematics.line()), F.col("northing") - F.lag("northing").over(kinematics.line()))
    return kinematics.cumulative_m(track, step)


@query(sql("track", "SELECT 1").replace("SELECT 1", "").rstrip() + f", {_DIST} SELECT line_id, seq, {r6('dist_m')} AS dist_m FROM dist")
def cumulative_distance(s, d):
    return rounded(_distances(s, d), "dist_m").select("line_id", "seq", "dist_m")


@query(sql("track", "SELECT 1").replace("SELECT 1", "").rstrip() + f""", {_DIST}, st AS (SELECT *, dist_m - lag(dist_m) OVER ({LINE}) AS d0 FROM dist)
    SELECT line_id, seq, coalesce(d0 * 1000 >= 50000, true) AS good, {r6(f"first_value(dist_m) OVER ({LINE}) + sum(CASE WHEN coalesce(d0 * 1000 >= 50000, true) THEN coalesce(d0, 0) ELSE 0 END) OVER ({LINE})")} AS clean_m FROM st""")
def distance_denoise(s, d):
    return rounded(kinematics.denoise_distance(_distances(s, d), 50000.0), "clean_m").select("line_id", "seq", "good", "clean_m")


@query(sql("track", "SELECT 1").replace("SELECT 1", "").rstrip() + f""", {_DIST}, pairs AS (SELECT *, lead(dist_m) OVER ({LINE}) AS d1, lead(field) OVER ({LINE}) AS f1, min(dist_m) OVER (PARTITION BY line_id) AS d0 FROM dist)
    SELECT line_id, CAST(k AS BIGINT) AS k, {r6("field + (d0 + k * 500.0 - dist_m) / (d1 - dist_m) * (f1 - field)")} AS field FROM
    (SELECT *, unnest(range(CAST(ceil((dist_m - d0) / 500.0) AS BIGINT), CAST(ceil((d1 - d0) / 500.0) AS BIGINT))) AS k FROM pairs WHERE d1 > dist_m)""")
def resample_track(s, d):
    out = kinematics.resample(_distances(s, d), ["field"], 500.0)
    return rounded(out, "field").select("line_id", F.col("k").cast("long").alias("k"), "field")


# base station and walk


_BASE = "base AS (SELECT t_ms, min(field) AS nT FROM track WHERE event_type = 'error' GROUP BY t_ms), obs AS (SELECT * FROM track WHERE event_type = 'click')"
_NEAR = f"""{_BASE}, lo AS (SELECT o.event_id, max_by(b.nT, b.t_ms) AS v, max(b.t_ms) AS t FROM obs o JOIN base b ON b.t_ms < o.t_ms GROUP BY o.event_id),
    hi AS (SELECT o.event_id, min_by(b.nT, b.t_ms) AS v, min(b.t_ms) AS t FROM obs o JOIN base b ON b.t_ms >= o.t_ms GROUP BY o.event_id),
    near AS (SELECT o.*, CASE WHEN lo.t IS NULL OR hi.t - o.t_ms < o.t_ms - lo.t THEN hi.t ELSE lo.t END AS base_t, CASE WHEN lo.t IS NULL OR hi.t - o.t_ms < o.t_ms - lo.t THEN hi.v ELSE lo.v END AS base_nT
      FROM obs o LEFT JOIN lo ON o.event_id = lo.event_id LEFT JOIN hi ON o.event_id = hi.event_id)"""
_TRACK = sql("track", "SELECT 1").replace("SELECT 1", "").rstrip()


def _observed(s, d):
    track = views.track(s, d)
    base = track.filter("event_type = 'error'").select("t_ms", F.col("field").alias("nT"))
    return track.filter("event_type = 'click'"), base


@query(_TRACK + f", {_NEAR} SELECT event_id, base_t, {r6('base_nT')} AS base_nT FROM near")
def nearest_base(s, d):
    return rounded(asof.nearest(*_observed(s, d), "nT"), "base_nT").select("event_id", "base_t", "base_nT")


@query(_TRACK + f", {_NEAR} SELECT event_id, {r6('field - base_nT')} AS r1, {r6('k - base_nT')} AS r2, {r6('(field - base_nT) - (k - base_nT)')} AS va FROM near")
def diurnal_residual(s, d):
    observed, base = _observed(s, d)
    return rounded(asof.diurnal(observed.withColumns({"btotal1": F.col("field"), "btotal2": F.col("k").cast("double")}), base), "r1", "r2", "va").select("event_id", "r1", "r2", "va")


@query(_TRACK + """, w AS (SELECT event_id, t_ms FROM track WHERE event_type = 'signup'), r AS (SELECT t_ms, event_id AS row_id FROM track WHERE event_type = 'error')
    SELECT w.event_id, min_by(r.row_id, (abs(r.t_ms - w.t_ms), r.t_ms, r.row_id)) AS row_id FROM w CROSS JOIN r GROUP BY w.event_id""")
def waypoint_lookup(s, d):
    track = views.track(s, d)
    points = track.filter("event_type = 'signup'").select("event_id", "t_ms")
    return asof.waypoint_rows(points, track.filter("event_type = 'error'").select("t_ms", F.col("event_id").alias("row_id"))).select("event_id", "row_id")


def r9(expression: str) -> str:
    return f"(round({expression}, 9) + 0.0)"


@query(sql("walk", f"""SELECT line_id, seq, {r9("CASE WHEN hi.seq > lo.seq THEN coalesce(lo.lat + (w.seq - lo.seq) / (hi.seq - lo.seq)::DOUBLE * (hi.lat - lo.lat), w.lat) ELSE w.lat END")} AS lat,
    {r9("CASE WHEN hi.seq > lo.seq THEN coalesce(lo.lon + (w.seq - lo.seq) / (hi.seq - lo.seq)::DOUBLE * (hi.lon - lo.lon), w.lon) ELSE w.lon END")} AS lon FROM
    (SELECT *, last_value(CASE WHEN fix THEN {{'seq': seq, 'lat': lat, 'lon': lon}} END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
      first_value(CASE WHEN fix THEN {{'seq': seq, 'lat': lat, 'lon': lon}} END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM walk) w"""))
def gap_fill(s, d):
    out = asof.gap_fill(views.walk(s, d), F.col("fix"), ["lat", "lon"])
    return out.select("line_id", "seq", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(sql("walk", "SELECT line_id, seq FROM (SELECT *, min(CASE WHEN fix THEN seq END) OVER (PARTITION BY line_id) AS a, max(CASE WHEN fix THEN seq END) OVER (PARTITION BY line_id) AS b FROM walk) WHERE a IS NULL OR seq BETWEEN a AND b"))
def gps_trim(s, d):
    return asof.gps_trim(views.walk(s, d), F.col("fix")).select("line_id", "seq")


@query(sql("walk", "SELECT line_id, seq FROM walk WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0"))
def gps_downsample(s, d):
    return tables.valid_coordinates(views.walk(s, d), "lat", "lon").select("line_id", "seq")


@query(sql("walk", f"""SELECT line_id, seq, {r6('sqrt(bx * bx + "by" * "by" + bz * bz)')} AS btotal FROM walk"""))
def total_field(s, d):
    total = F.sqrt(F.col("bx") ** 2 + F.col("by") ** 2 + F.col("bz") ** 2)
    return views.walk(s, d).select("line_id", "seq", F.round(total, 6).alias("btotal"))


@query(sql("walk", f"SELECT line_id, seq, {r6('easting + 0.0375')} AS e1, {r6('northing - 0.56')} AS n1, {r6('easting + 0.0375')} AS e2, {r6('northing + 0.56')} AS n2 FROM walk"))
def sensor_offsets(s, d):
    moved = {"e1": F.col("easting") + 0.0375, "n1": F.col("northing") - 0.56, "e2": F.col("easting") + 0.0375, "n2": F.col("northing") + 0.56}
    return rounded(views.walk(s, d).withColumns(moved), *moved).select("line_id", "seq", *moved)


def _utm_sql() -> str:
    a, e = geodesy.ALPHA, geodesy.E2**0.5
    xi = " + ".join(["xi0"] + [f"{x!r}::DOUBLE * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, x in enumerate(a, 1)])
    eta = " + ".join(["eta0"] + [f"{x!r}::DOUBLE * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, x in enumerate(a, 1)])
    return sql("walk", f"""SELECT line_id, seq, (round(500000 + {geodesy.K0 * geodesy.RECTIFYING!r}::DOUBLE * ({eta}), 3) + 0.0) AS easting, (round({geodesy.K0 * geodesy.RECTIFYING!r}::DOUBLE * ({xi}), 3) + 0.0) AS northing FROM
        (SELECT *, atan2(t, cos(lam)) AS xi0, atanh(sin(lam) / sqrt(1 + t * t)) AS eta0 FROM (SELECT *, radians(lon - 15) AS lam, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t FROM walk WHERE lat IS NOT NULL))""")


@query(_utm_sql())
def utm_project(s, d):
    east, north = geodesy.to_utm(F.col("lat"), F.col("lon"), 33)
    return views.walk(s, d).filter("lat IS NOT NULL").select("line_id", "seq", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


_F = f"{geodesy.FLATTENING!r}::DOUBLE"


@query(sql("walk", f"""SELECT line_id, (round(sum(CASE WHEN h = 0 THEN 0 ELSE {geodesy.A} * (s - {_F} / 2 * ((s - sin(s)) * pow(sin(p) * cos(q) / cos(s / 2), 2) + (s + sin(s)) * pow(cos(p) * sin(q) / sin(s / 2), 2))) END), 3) + 0.0) AS metres FROM
    (SELECT *, 2 * asin(least(1.0, sqrt(h))) AS s, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q FROM (SELECT *, pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(dl / 2), 2) AS h FROM
    (SELECT line_id, atan((1 - {_F}) * tan(radians(lag(lat) OVER w))) AS b1, atan((1 - {_F}) * tan(radians(lat))) AS b2, radians(lon - lag(lon) OVER w) AS dl FROM walk WHERE lat IS NOT NULL WINDOW w AS ({LINE})) WHERE b1 IS NOT NULL)) GROUP BY line_id"""))
def track_length(s, d):
    fixes = views.walk(s, d).filter("lat IS NOT NULL")
    step = geodesy.geodesic_m(F.lag("lat").over(kinematics.line()), F.lag("lon").over(kinematics.line()), F.col("lat"), F.col("lon"))
    return fixes.withColumn("m", step).filter("m IS NOT NULL").groupBy("line_id").agg(F.round(F.sum("m"), 3).alias("metres"))


@query(sql("track", "SELECT event_id, printf('%02d:%02d:%02d.%03d', (t_ms // 3600000) % 24, (t_ms // 60000) % 60, (t_ms // 1000) % 60, t_ms % 1000) AS clock FROM track"))
def time_text(s, d):
    return views.track(s, d).select("event_id", clock.clock_text(F.col("t_ms") / 1000.0).alias("clock"))


@query(sql("walk", f"""SELECT count(*) AS n, {r6("min(easting)")} AS min_e, {r6("max(easting)")} AS max_e, {r6("avg(bx)")} AS mean_bx, {r6("stddev_samp(bx)")} AS std_bx, {r6("min(bz)")} AS min_bz, {r6("max(bz)")} AS max_bz FROM walk"""))
def magbase_diagnostics(s, d):
    out = views.walk(s, d).agg(F.count("*").alias("n"), F.min("easting").alias("min_e"), F.max("easting").alias("max_e"), F.avg("bx").alias("mean_bx"), F.stddev_samp("bx").alias("std_bx"), F.min("bz").alias("min_bz"), F.max("bz").alias("max_bz"))
    return rounded(out, *out.columns[1:])


# tables


_STATS = "SELECT '{c}' AS column_name, {m} AS mean, {s} AS std, {a} AS min, {b} AS max, count({c}) AS n, count(*) - count({c}) AS missing FROM lineitem"


@query(" UNION ALL ".join(_STATS.format(c=c, m=f"round(avg({c}), 4)", s=f"round(stddev_samp({c}), 4)", a=r6(f"min({c})"), b=r6(f"max({c})")) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def column_stats(s, d):
    out = tables.column_statistics(views.table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(out, "min", "max").withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) GROUP BY 1")
def histogram(s, d):
    return tables.histogram(views.table(s, d, "customer"), "c_acctbal", 50)


@query("SELECT c_custkey AS row, 0 AS column_no FROM customer WHERE regexp_matches(lower(c_name), '\\b(customer#0*1[0-9])\\b') UNION ALL SELECT c_custkey, 1 FROM customer WHERE regexp_matches(lower(c_mktsegment), '\\b(customer#0*1[0-9])\\b')")
def cell_search(s, d):
    return tables.cell_search(views.table(s, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"], "(Customer#0*1[0-9])", is_regex=True, whole_word=True)


@query("SELECT event_id, user_id FROM events WHERE event_id BETWEEN 100 AND 199")
def row_range(s, d):
    return tables.row_range(views.table(s, d, "events"), "event_id", 100, 199).select("event_id", "user_id")


@query("SELECT event_id, event_type, value FROM events WHERE event_id BETWEEN 9 AND 49")
def export_slice(s, d):
    return tables.export_slice(views.table(s, d, "events"), "event_id", ["event_type", "value", "nothing"], (10, 50))


@query("SELECT event_id, value FROM events WHERE event_id % 10 = 0")
def systematic_sample(s, d):
    return tables.every_kth(views.table(s, d, "events"), "event_id", 10).select("event_id", "value")


@query(sql("track", f"SELECT line_id, {r6('min(easting)')} AS min_x, {r6('min(northing)')} AS min_y, {r6('max(easting)')} AS max_x, {r6('max(northing)')} AS max_y FROM track GROUP BY line_id"))
def bounds(s, d):
    return rounded(tables.bounds(views.track(s, d), "easting", "northing", ["line_id"]), "min_x", "min_y", "max_x", "max_y")


@query(sql("track", f"SELECT {r6('min(a)')} AS min_x, {r6('max(b)')} AS max_x FROM (SELECT min(easting) AS a, max(easting) AS b FROM track WHERE line_id IN (SELECT position FROM layers WHERE is_visible) GROUP BY line_id)", "layers"))
def visible_bounds(s, d):
    """Extent of the lines whose layer is visible."""
    shown = views.layers(s, d).filter("is_visible").select(F.col("position").alias("line_id"))
    each = tables.bounds(views.track(s, d), "easting", "northing", ["line_id"]).join(shown, "line_id", "left_semi")
    return each.agg(F.round(F.min("min_x"), 6).alias("min_x"), F.round(F.max("max_x"), 6).alias("max_x"))


@query(sql("track", f"SELECT {r6('avg(v) - 2 * stddev_pop(v)')} AS vmin, {r6('avg(v) + 2 * stddev_pop(v)')} AS vmax FROM (SELECT field AS v FROM track UNION ALL SELECT k FROM track)"))
def color_range(s, d):
    return rounded(tables.colour_range(views.track(s, d), ["field", "k"], pooled=True, sample=False), "vmin", "vmax")


@query("""SELECT CASE WHEN n < 0.167 THEN '#000080' WHEN n < 0.333 THEN '#0000FF' WHEN n < 0.5 THEN '#00FFFF' WHEN n < 0.667 THEN '#00FF00' WHEN n < 0.833 THEN '#FFFF00' WHEN n < 0.95 THEN '#FF8000' ELSE '#FF0000' END AS colour, count(*) AS n_rows
    FROM (SELECT greatest(0.0, least(1.0, (c_acctbal + 500.0) / 9000.0)) AS n FROM customer) GROUP BY 1""")
def color_bucket(s, d):
    colour = styling.colour_bucket(F.col("c_acctbal"), F.lit(-500.0), F.lit(8500.0))
    return views.table(s, d, "customer").groupBy(colour.alias("colour")).agg(F.count("*").alias("n_rows"))


@query("""SELECT s_suppkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (s_suppkey % 360) || ',' || (s_suppkey % 90) || ']},"properties":{"name":"' || s_name || '","_point_color":"#0066CC"}}' AS feature FROM supplier""")
def geojson_points(s, d):
    rows = views.table(s, d, "supplier")
    return rows.select("s_suppkey", styling.geojson_point(F.col("s_suppkey") % 360, F.col("s_suppkey") % 90, F.struct(F.col("s_name").alias("name")), F.lit("#0066CC")).alias("feature"))


@query("SELECT c_custkey, c_acctbal FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) WHERE c_acctbal BETWEEN a - 0.1 * (b - a) AND b + 0.1 * (b - a)")
def iqr_filter(s, d):
    return tables.iqr_filter(views.table(s, d, "customer"), "c_acctbal", 0.1).select("c_custkey", "c_acctbal")


@query(sql("track", "SELECT event_id FROM track WHERE 10.0 * k BETWEEN 50 AND 900 AND field * k / 100.0 > 1 AND k > 0"))
def gamma_qc(s, d):
    return tables.gamma_quality(views.gamma(s, d), "total", ["u238"], "height", 50, 900, 1).select("event_id")


@query("SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND regexp_extract(text, '(DEBUG|INFO|WARNING|ERROR|CRITICAL)', 1) IN ('WARNING', 'ERROR', 'CRITICAL')")
def log_filter(s, d):
    return tables.log_level(views.table(s, d, "conversations"), "text", "WARNING").select("conv_id", "turn")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS row_id FROM orders")
def row_identity(s, d):
    return tables.with_row_id(views.table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_id")


# statistics


@query(sql("track", f"SELECT line_id, seq, {r6('CASE WHEN count(field) OVER w = 5 THEN avg(field) OVER w ELSE field END')} AS smooth FROM track WINDOW w AS ({LINE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
def rolling_smooth(s, d):
    return rounded(anomaly.rolling_mean(views.track(s, d), "field", 5), "smooth").select("line_id", "seq", "smooth")


@query(sql("track", f"SELECT event_id, {r6('abs((field - m) / s)')} AS score FROM track, (SELECT avg(field) AS m, stddev_pop(field) AS s FROM track)"))
def zscore(s, d):
    return rounded(anomaly.zscore(views.track(s, d), "field"), "score").select("event_id", "score")


@query(sql("track", f"SELECT event_id, {r6('abs(field - m) / ((b - a) / 1.349)')} AS score FROM track, (SELECT quantile_cont(field, 0.25) AS a, quantile_cont(field, 0.5) AS m, quantile_cont(field, 0.75) AS b FROM track)"))
def iqr_score(s, d):
    return rounded(anomaly.iqr_score(views.track(s, d), "field"), "score").select("event_id", "score")


_MAD = "med AS (SELECT median(field) AS m FROM track), mad AS (SELECT median(abs(field - m)) AS d FROM track, med)"


@query(_TRACK + f", {_MAD} SELECT event_id, {r6('0.6745 * abs(field - m) / d')} AS score FROM track, med, mad")
def modified_zscore(s, d):
    return rounded(anomaly.modified_zscore(views.track(s, d), "field"), "score").select("event_id", "score")


@query(_TRACK + f", {_MAD} SELECT {r6('1.4826 * d')} AS noise FROM mad")
def mad_noise(s, d):
    return rounded(anomaly.mad_noise(views.track(s, d), "field"), "noise")


@query(sql("track", f"SELECT event_id, {r6('(field - m) / sqrt(m)')} AS z FROM track, (SELECT median(field) AS m FROM track)"))
def poisson_z(s, d):
    return rounded(anomaly.poisson_z(views.track(s, d), "field"), "z").select("event_id", "z")


_GRAD = f"""g AS (SELECT *, coalesce(CASE WHEN lag(field) OVER w IS NULL THEN lead(field) OVER w - field WHEN lead(field) OVER w IS NULL THEN field - lag(field) OVER w ELSE (lead(field) OVER w - lag(field) OVER w) / 2 END, 0.0) AS gradient FROM track WINDOW w AS ({LINE}))"""


@query(_TRACK + f", {_GRAD} SELECT event_id, {r6('gradient')} AS gradient, abs(gradient) > t AS flag FROM g, (SELECT quantile_cont(abs(gradient), 0.95) AS t FROM g)")
def gradient_flags(s, d):
    return rounded(anomaly.gradient_flags(views.track(s, d), "field"), "gradient").select("event_id", "gradient", "flag")


@query(_TRACK + f""", q AS (SELECT quantile_cont(field, 0.25) AS a, quantile_cont(field, 0.75) AS b FROM track), kept AS (SELECT * FROM track, q WHERE field BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
    sm AS (SELECT *, CASE WHEN count(field) OVER w = 5 THEN avg(field) OVER w ELSE field END AS smooth FROM kept WINDOW w AS ({LINE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    sc AS (SELECT *, abs((smooth - m) / sd) AS score, abs(coalesce(CASE WHEN lag(smooth) OVER w IS NULL THEN lead(smooth) OVER w - smooth WHEN lead(smooth) OVER w IS NULL THEN smooth - lag(smooth) OVER w ELSE (lead(smooth) OVER w - lag(smooth) OVER w) / 2 END, 0.0)) AS g
      FROM sm, (SELECT avg(smooth) AS m, stddev_pop(smooth) AS sd FROM sm) WINDOW w AS ({LINE}))
    SELECT event_id, {r6('score')} AS score, score > 2.5 OR g > t AS is_anomaly FROM sc, (SELECT quantile_cont(g, 0.95) AS t FROM sc)""")
def anomaly_chain(s, d):
    return rounded(anomaly.statistical_anomalies(views.track(s, d), "field"), "score").select("event_id", "score", "is_anomaly")


@query(_TRACK + f", {_MAD} SELECT event_id FROM (SELECT *, lag(field) OVER ({LINE}) AS b, lead(field) OVER ({LINE}) AS a FROM track), med, mad WHERE field > b AND field >= a AND field >= m + 0.5 * d")
def gamma_peaks(s, d):
    return anomaly.peaks(views.track(s, d), "field", 0.5).select("event_id")


# bands


@query(sql("bands", f"SELECT l_returnflag, {r6('avg(v)')} AS mean_ndvi, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN nir + red = 0 THEN 0.0 ELSE (nir - red) / (nir + red) END AS v FROM bands) GROUP BY l_returnflag"))
def ndvi(s, d):
    rows = views.bands(s, d).withColumn("v", spectral.ndvi(F.col("red"), F.col("nir")))
    return rounded(rows.groupBy("l_returnflag").agg(F.avg("v").alias("mean_ndvi"), F.count("*").alias("n")), "mean_ndvi")


@query(sql("bands", f"SELECT l_returnflag, {r6('avg(greatest(0.0, least(1.0, (nir - a) / (b - a))))')} AS nir_stretched FROM bands, (SELECT quantile_cont(nir, 0.02) AS a, quantile_cont(nir, 0.98) AS b FROM bands) GROUP BY l_returnflag"))
def contrast_stretch(s, d):
    return rounded(spectral.stretch(views.bands(s, d), ["nir"]).groupBy("l_returnflag").agg(F.avg("nir_stretched").alias("nir_stretched")), "nir_stretched")


_B = ("blue", "green", "red", "nir")


@query(sql("bands", " UNION ALL ".join(f"SELECT '{a}' AS band_a, '{b}' AS band_b, (round(covar_samp({a}, {b}), 4) + 0.0) AS cov FROM bands" for a in _B for b in _B)))
def band_covariance(s, d):
    return spectral.covariance(views.bands(s, d), list(_B)).withColumn("cov", F.round("cov", 4))


@query(sql("bands", """, m AS (SELECT avg(blue) AS mb, avg(red) AS mr, var_samp(blue) + 1e-6 AS vb, var_samp(red) + 1e-6 AS vr, covar_samp(blue, red) AS c FROM bands),
    x AS (SELECT l_returnflag, sqrt(greatest(0, (vr * pow(blue - mb, 2) - 2 * c * (blue - mb) * (red - mr) + vb * pow(red - mr, 2)) / (vb * vr - c * c))) AS rxd FROM bands, m)
    SELECT l_returnflag, (round(avg(rxd), 6) + 0.0) AS mean_rxd, count(*) FILTER (WHERE round(rxd, 9) > round(q, 9)) AS n_anomalies FROM x, (SELECT quantile_cont(rxd, 0.95) AS q FROM x) GROUP BY l_returnflag""").replace(")\n, m AS", "),\nm AS"))
def rxd(s, d):
    rows = spectral.rx_distance(views.bands(s, d), ["blue", "red"])
    cut = rows.agg(F.round(F.percentile("rxd", 0.95), 9).alias("q"))
    marked = rows.crossJoin(F.broadcast(cut)).withColumn("over", F.round("rxd", 9) > F.col("q"))  # one row
    return rounded(marked.groupBy("l_returnflag").agg(F.avg("rxd").alias("mean_rxd"), F.count_if("over").alias("n_anomalies")), "mean_rxd")


@query(sql("track", f"SELECT line_id, seq, {r6('var_pop(field) OVER w')} AS texture FROM track WINDOW w AS ({LINE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
def texture(s, d):
    return rounded(spectral.texture(views.track(s, d), "field"), "texture").select("line_id", "seq", "texture")


# radar


def _flat(traces, digits=6):
    return traces.select("segment", "trace_no", F.posexplode("samples").alias("k", "value")).select("segment", "trace_no", F.col("k").cast("long").alias("k"), F.round("value", digits).alias("value"))


@query(sql("cells", f"SELECT segment, trace_no, k, {r6('value - avg(value) OVER (PARTITION BY segment, k)')} AS value FROM cells"))
def trace_background(s, d):
    return _flat(radar.remove_background(views.traces(s, d)))


@query(sql("cells", f"SELECT c.segment, trace_no, c.k, {r6('value - m')} AS value FROM cells c JOIN (SELECT segment, k, median(value) AS m FROM cells GROUP BY segment, k) b ON c.segment = b.segment AND c.k = b.k"))
def trace_median_background(s, d):
    return _flat(radar.remove_background(views.traces(s, d), median=True))


@query(sql("cells", f"SELECT c.segment, c.trace_no, k, {r6('value - m')} AS value FROM cells c JOIN (SELECT segment, trace_no, avg(value) AS m FROM cells WHERE k BETWEEN 10 AND 29 GROUP BY ALL) b ON c.segment = b.segment AND c.trace_no = b.trace_no"))
def dc_shift(s, d):
    return _flat(radar.dc_shift(views.traces(s, d), 10, 29))


@query(sql("cells", f"SELECT segment, trace_no, k, {r6('value * CASE WHEN k * 1.0 <= 3 THEN 9.0 WHEN k * 1.0 <= 37 THEN pow(k * 1.0 - 3, 2) ELSE 1.0 END')} AS value FROM cells"))
def power_gain(s, d):
    return _flat(radar.apply_gain(views.traces(s, d), radar.gains(64, 1.0, "power", 2.0, 37.0, 3.0)))


@query(sql("traces", """SELECT segment, trace_no, CAST(j - 1 AS BIGINT) AS k, (round(CASE WHEN j - s BETWEEN 1 AND 64 THEN samples[j - s] ELSE 0.0 END, 6) + 0.0) AS value FROM
    (SELECT *, unnest(range(1, CAST(64 + most + 1 AS BIGINT))) AS j FROM (SELECT *, trace_no % 5 + 1 AS s, max(trace_no % 5 + 1) OVER (PARTITION BY segment) AS most FROM traces))"""))
def topo_shift(s, d):
    return _flat(radar.topography(views.traces(s, d).withColumn("twt", (F.col("trace_no") % 5) * 1.0), "twt", 1.0))


@query(sql("cells", f"""SELECT segment, trace_no, f, {r6("p / max(p) OVER (PARTITION BY segment, trace_no)")} AS power FROM (SELECT segment, trace_no, CAST(f AS BIGINT) AS f, pow(sum(value * cos(-2 * pi() * f * k / 64)), 2) + pow(sum(value * sin(-2 * pi() * f * k / 64)), 2) AS p
    FROM cells, (SELECT unnest(range(0, 33)) AS f) GROUP BY segment, trace_no, f)"""))
def power_spectrum(s, d):
    return rounded(radar.power_spectrum(views.traces(s, d), 1.0), "power").select("segment", "trace_no", F.col("f").cast("long").alias("f"), "power")


@query(sql("cells", f"SELECT segment, {r6('min(value)')} AS min, {r6('max(value)')} AS max, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, count(*) FILTER (WHERE value = 0) AS n_zero FROM cells GROUP BY segment"))
def trace_quality(s, d):
    return rounded(radar.trace_quality(views.traces(s, d)), "min", "max", "mean", "std")


@query(sql("cells", f"""SELECT a.segment, a.trace_no, a.k, {r6("median(coalesce(b.value, 0.0))")} AS value FROM cells a JOIN (SELECT unnest([-1, 0, 1]) AS p) ON true JOIN (SELECT unnest([-1, 0, 1]) AS q) ON true
    LEFT JOIN cells b ON b.segment = a.segment AND b.trace_no = a.trace_no + p AND b.k = a.k + q GROUP BY a.segment, a.trace_no, a.k"""))
def median3x3(s, d):
    return _flat(radar.median3x3(views.traces(s, d)))


@query(sql("cells", """SELECT segment, trace_no, min(k) AS t0 FROM (SELECT *, max(abs(value)) OVER (PARTITION BY segment, trace_no) AS m FROM cells) WHERE abs(value) > 0.5 * m GROUP BY segment, trace_no"""))
def first_break(s, d):
    return radar.first_break(views.traces(s, d), 0.5).select("segment", "trace_no", F.col("t0").cast("long").alias("t0"))


@query(sql("cells", f"SELECT segment, trace_no, k, {r6('value')} AS value FROM cells WHERE k < 40 AND trace_no BETWEEN 2 AND 9"))
def profile_cut(s, d):
    return _flat(radar.cut_samples(views.traces(s, d), 0.5, 20.0, 2, 10))


@query()
def band_pass(s, d):
    return _flat(radar.band_pass(views.traces(s, d), 1.0, 0.05, 0.2))


@query(sql("cells", f"""SELECT a.segment, a.trace_no, a.k, {r6("any_value(a.value) - sum(b.value * (1 / 11.0::DOUBLE + (a.k - c) * (b.k - c) / 110.0::DOUBLE + (pow(a.k - c, 2) - 10) * (pow(b.k - c, 2) - 10) / 858.0::DOUBLE))")} AS value
    FROM (SELECT *, least(greatest(k, 5), max(k) OVER (PARTITION BY segment, trace_no) - 5) AS c FROM cells) a JOIN cells b ON a.segment = b.segment AND a.trace_no = b.trace_no AND b.k BETWEEN c - 5 AND c + 5 GROUP BY a.segment, a.trace_no, a.k"""))
def dewow(s, d):
    return _flat(radar.dewow(views.traces(s, d)))


@query()
def deconvolution(s, d):
    return _flat(radar.deconvolve(views.traces(s, d), 1.0))


@query(sql("cells", f"""SELECT o.segment, o.trace_no, o.k, {r6("sum(i.value * CASE WHEN o.path > 0 THEN o.depth / o.path ELSE 1 END)")} AS value FROM
    (SELECT a.segment, a.trace_no, b.trace_no AS other, k, k * 0.05::DOUBLE AS depth, sqrt(pow(k * 0.05::DOUBLE, 2) + pow((b.trace_no - a.trace_no) * 0.05::DOUBLE, 2)) AS path FROM cells a JOIN traces b ON a.segment = b.segment) o
    LEFT JOIN cells i ON i.segment = o.segment AND i.trace_no = o.other AND i.k = CAST(round_even(2 * o.path / 0.1::DOUBLE, 0) AS BIGINT) GROUP BY o.segment, o.trace_no, o.k""".replace("AS value FROM", "AS value FROM", 1)))
def migration(s, d):
    return _flat(radar.migrate(views.traces(s, d), 0.05, 1.0, 0.1))


@query(sql("cells", f"SELECT segment, trace_no, k, {r6('value - list_avg(v[c + 1:len(v) - c])')} AS value FROM (SELECT *, CAST(floor(len(v) * 0.2) AS BIGINT) AS c FROM (SELECT *, list_sort(list(value) OVER (PARTITION BY segment, k ORDER BY trace_no ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS v FROM cells))"))
def local_background(s, d):
    return _flat(radar.remove_local_background(views.traces(s, d)))


_BESSEL = "list_sum(list_transform(range(0, 40), lambda n: pow({x} / 2, 2 * n) / pow(gamma(n + 1.0::DOUBLE), 2)))"


@query(sql("cells", f"""SELECT a.segment, a.trace_no, a.k, {r6("sum(coalesce(b.value * w, 0))")} AS value FROM (SELECT segment, trace_no, unnest(range(0, 2 * len(samples))) AS k FROM traces) a
    JOIN (SELECT t, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t / 2) / (pi() * t / 2) END * {_BESSEL.format(x="(5 * sqrt(1 - pow(t / 20.0::DOUBLE, 2)))")} / {_BESSEL.format(x="5.0::DOUBLE")} AS w FROM (SELECT unnest(range(-20, 21)) AS t)) taps ON true
    LEFT JOIN cells b ON b.segment = a.segment AND b.trace_no = a.trace_no AND 2 * b.k = a.k - t GROUP BY a.segment, a.trace_no, a.k"""))
def upsampled(s, d):
    return _flat(radar.upsample(views.traces(s, d), 2))


_GAIN = "CASE WHEN f <= 0.02 THEN 0 WHEN f < 0.05 THEN (f - 0.02) / 0.03 WHEN f <= 0.2 THEN 1 WHEN f < 0.3 THEN (0.3 - f) / 0.1 ELSE 0 END"


@query(sql("cells", f"""SELECT a.segment, a.trace_no, a.k, {r6("sum(b.value * h)")} AS value FROM cells a JOIN cells b ON a.segment = b.segment AND a.trace_no = b.trace_no JOIN
    (SELECT n, d, sum({_GAIN} * cos(2 * pi() * m * d / n)) / n AS h FROM (SELECT n, d, m, least(m, n - m) / n::DOUBLE AS f FROM (SELECT n, unnest(range(0, n)) AS d FROM (SELECT DISTINCT len(samples) AS n FROM traces)), (SELECT unnest(range(0, 4096)) AS m) WHERE m < n) GROUP BY n, d) filter
    ON d = (a.k - b.k + n) % n AND n = (SELECT max(len(samples)) FROM traces) GROUP BY a.segment, a.trace_no, a.k"""))
def fir_band_pass(s, d):
    return _flat(radar.fir_band_pass(views.traces(s, d), 1.0, (0.02, 0.05, 0.2, 0.3)))


@query(sql("cells", """, flips AS (SELECT segment, trace_no, k FROM (SELECT *, lead(value) OVER (PARTITION BY segment, trace_no ORDER BY k) AS nx FROM cells) WHERE value * nx < 0),
    picks AS (SELECT segment, trace_no, list_sort(list(k) FILTER (WHERE k >= 32)) AS a, list_sort(list(k) FILTER (WHERE k < 32)) AS b FROM flips GROUP BY ALL)
    SELECT t.segment, t.trace_no, CASE WHEN len(b) >= 2 THEN b[len(b) - 1] + 1 END AS pick_from, a[2] AS pick_to FROM traces t LEFT JOIN picks p ON t.segment = p.segment AND t.trace_no = p.trace_no""").replace(")\n, flips", "),\nflips"))
def reflections(s, d):
    picked = radar.pick_reflection(views.traces(s, d), 32)
    return picked.select("segment", "trace_no", F.col("pick_from").cast("long").alias("pick_from"), F.col("pick_to").cast("long").alias("pick_to"))


# grids


@query(sql("track", f"""SELECT line_id, iy, ix, {r6("min_x - 0.01 * rx + ix * rx * 1.02 / 9")} AS x, {r6("min_y - 0.01 * ry + iy * ry * 1.02 / 9")} AS y FROM
    (SELECT line_id, min(easting) AS min_x, max(easting) - min(easting) AS rx, min(northing) AS min_y, max(northing) - min(northing) AS ry FROM track GROUP BY line_id), (SELECT unnest(range(0, 10)) AS iy), (SELECT unnest(range(0, 10)) AS ix)""").replace("SELECT line_id, iy, ix,", "SELECT line_id, CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix,"))
def grid_mesh(s, d):
    out = grid.mesh(tables.bounds(views.track(s, d), "easting", "northing", ["line_id"]), 10, 10)
    return rounded(out, "x", "y").withColumns({"iy": F.col("iy").cast("long"), "ix": F.col("ix").cast("long")})


_NODES = "nodes AS (SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, ix / 39.0::DOUBLE AS x, iy / 39.0::DOUBLE AS y FROM (SELECT unnest(range(0, 40)) AS iy), (SELECT unnest(range(0, 40)) AS ix))"
_POINTS = sql("points", "SELECT 1").replace("SELECT 1", "").rstrip()


@query(_POINTS + f", {_NODES}" + f""" SELECT iy, ix, {r6("sum(w)")} AS weight, {r6("sum(w * z) / sum(w)")} AS target FROM (SELECT iy, ix, z, exp(-pow(sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)) / 0.018, 2)) AS w
    FROM points p JOIN nodes n ON sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)) <= 0.06) GROUP BY iy, ix""")
def influence_grid(s, d):
    out = grid.influence(views.points(s, d), 0.0, 0.0, 1 / 39, 1 / 39, 40, 40, 0.06)
    return rounded(out, "weight", "target").withColumns({"iy": F.col("iy").cast("long"), "ix": F.col("ix").cast("long")})


@query(_POINTS + f", {_NODES}" + f""" SELECT iy, ix, {r6("min(d)")} AS d, {r6("min_by(z, (d, z))")} AS value FROM (SELECT iy, ix, z, sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)) AS d FROM points p, nodes n) GROUP BY iy, ix""")
def nearest_grid(s, d):
    nodes = s.range(40).select(F.col("id").alias("iy")).crossJoin(s.range(40).select(F.col("id").alias("ix"))).withColumns({"x": F.col("ix") / 39.0, "y": F.col("iy") / 39.0})
    return rounded(grid.nearest_points(nodes, views.points(s, d), 0.03).withColumnRenamed("z", "value"), "d", "value").select("iy", "ix", "d", "value")


@query(_POINTS + f", {_NODES}" + """, turns AS (SELECT iy, ix, atan2(p.y - n.y, p.x - n.x) AS a, p.x = n.x AND p.y = n.y AS met FROM nodes n, points p),
    gaps AS (SELECT iy, ix, met, coalesce(lead(a) OVER w, first_value(a) OVER w + 2 * pi()) - a AS gap FROM turns WINDOW w AS (PARTITION BY iy, ix ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT iy, ix, max(gap) <= pi() + 1e-9 OR bool_or(met) AS inside FROM gaps GROUP BY iy, ix""")
def hull_mask(s, d):
    """Every node with whether it lies on or inside the hull of the points."""
    nodes = s.range(40).select(F.col("id").alias("iy")).crossJoin(s.range(40).select(F.col("id").alias("ix"))).withColumns({"x": F.col("ix") / 39.0, "y": F.col("iy") / 39.0})
    hull = grid.hull_points(views.points(s, d))  # one row
    return nodes.crossJoin(F.broadcast(hull)).select("iy", "ix", grid.inside_hull(F.col("corners")).alias("inside"))


_CELLS = "segment AS grid_id, trace_no AS iy, k AS ix"
_DX = """CASE WHEN lag(value) OVER r IS NULL THEN lead(value) OVER r - value WHEN lead(value) OVER r IS NULL THEN value - lag(value) OVER r ELSE (lead(value) OVER r - lag(value) OVER r) / 2 END AS d_dx,
    CASE WHEN lag(value) OVER c IS NULL THEN lead(value) OVER c - value WHEN lead(value) OVER c IS NULL THEN value - lag(value) OVER c ELSE (lead(value) OVER c - lag(value) OVER c) / 2 END AS d_dy"""
_DERIVED = f"derived AS (SELECT *, sqrt(d_dx * d_dx + d_dy * d_dy) AS hg FROM (SELECT {_CELLS}, value, {_DX} FROM cells WINDOW r AS (PARTITION BY segment, trace_no ORDER BY k), c AS (PARTITION BY segment, k ORDER BY trace_no)))"
_CELL = sql("cells", "SELECT 1").replace("SELECT 1", "").rstrip()


def _longs(df):
    return df.withColumns({"iy": F.col("iy").cast("long"), "ix": F.col("ix").cast("long")})


@query(_CELL + f", {_DERIVED} SELECT grid_id, iy, ix, {r6('d_dx')} AS d_dx, {r6('d_dy')} AS d_dy FROM derived")
def grid_derivatives(s, d):
    return _longs(rounded(grid.horizontal_derivatives(views.grid(s, d)), "d_dx", "d_dy")).select("grid_id", "iy", "ix", "d_dx", "d_dy")


@query(_CELL + f", {_DERIVED} SELECT grid_id, {r6('avg(hg)')} AS mean_gradient, {r6('max(hg)')} AS max_gradient FROM derived GROUP BY grid_id")
def horizontal_gradient(s, d):
    out = grid.horizontal_derivatives(views.grid(s, d)).groupBy("grid_id").agg(F.avg("horizontal_gradient").alias("mean_gradient"), F.max("horizontal_gradient").alias("max_gradient"))
    return rounded(out, "mean_gradient", "max_gradient")


@query(_CELL + f""", {_DERIVED}, tops AS (SELECT *, max(m) OVER (PARTITION BY grid_id, ix ORDER BY iy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mm, avg(hg) OVER (PARTITION BY grid_id) AS mean FROM
    (SELECT *, max(hg) OVER (PARTITION BY grid_id, iy ORDER BY ix ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM derived)) SELECT grid_id, iy, ix FROM tops WHERE hg = mm AND hg > mean""")
def blakely_peaks(s, d):
    return _longs(grid.gradient_peaks(grid.horizontal_derivatives(views.grid(s, d)))).select("grid_id", "iy", "ix")


@query(sql("cells", f"SELECT segment AS grid_id, {r6('min(value)')} AS min, {r6('max(value)')} AS max, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS std, {r6('median(value)')} AS median, 1.0::DOUBLE AS coverage FROM cells GROUP BY segment"))
def grid_statistics(s, d):
    return rounded(grid.grid_statistics(views.grid(s, d)), "min", "max", "mean", "std", "median")


@query(sql("cells", f"SELECT segment AS grid_id, trace_no AS iy, k AS ix, {r6('(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)')} AS level, max(trace_no) OVER w - trace_no AS row_from_north FROM cells WINDOW w AS (PARTITION BY segment)"))
def raster_levels(s, d):
    out = _longs(rounded(grid.normalised(views.grid(s, d)), "level"))
    return out.select("grid_id", "iy", "ix", "level", F.col("row_from_north").cast("long").alias("row_from_north"))


@query(_POINTS + f", p2 AS (SELECT floor(x * 20) AS lon, floor(y * 20) AS lat, z FROM points) SELECT CAST(lat AS BIGINT) AS lat, CAST(lon AS BIGINT) AS lon, {r6('avg(z)')} AS value, dense_rank() OVER (ORDER BY lat) - 1 AS iy, dense_rank() OVER (ORDER BY lon) - 1 AS ix FROM p2 GROUP BY lat, lon")
def grid_pivot(s, d):
    cells = views.points(s, d).select(F.floor(F.col("x") * 20).alias("lon"), F.floor(F.col("y") * 20).alias("lat"), F.col("z").alias("value"))
    return _longs(rounded(grid.grid_pivot(cells), "value")).select("lat", "lon", "value", "iy", "ix")


@query(f"SELECT {r6('sqrt(avg(pow(o - p, 2)))')} AS rmse, {r6('avg(abs(o - p))')} AS mae, {r6('pow(corr(o, p), 2)')} AS r2, {r6('avg(o - p)')} AS mean_residual, {r6('stddev_pop(o - p)')} AS std_residual, count(o - p) AS n FROM (SELECT l_quantity AS o, l_extendedprice / 1000 AS p FROM lineitem)")
def residual_metrics(s, d):
    rows = views.table(s, d, "lineitem").select(F.col("l_quantity").alias("o"), (F.col("l_extendedprice") / 1000).alias("p"))
    out = grid.residual_metrics(rows, "o", "p")
    return rounded(out, "rmse", "mae", "r2", "mean_residual", "std_residual")


@query(_CELL + f""", g AS (SELECT {_CELLS}, value, min(value) OVER p AS lo, (max(value) OVER p - min(value) OVER p) / 10 AS st, lead(value) OVER r AS e, lead(value) OVER c AS n FROM cells
      WINDOW p AS (PARTITION BY segment), r AS (PARTITION BY segment, trace_no ORDER BY k), c AS (PARTITION BY segment, k ORDER BY trace_no)),
    l AS (SELECT *, floor((greatest(value, e) - lo) / st) AS ea, floor((least(value, e) - lo) / st) AS eb, floor((greatest(value, n) - lo) / st) AS na, floor((least(value, n) - lo) / st) AS nb FROM g)
    SELECT grid_id, iy, ix, CAST(level_no AS BIGINT) AS level_no FROM (SELECT *, greatest(CASE WHEN e IS NOT NULL AND ea > eb THEN ea END, CASE WHEN n IS NOT NULL AND na > nb THEN na END) AS level_no FROM l) WHERE level_no IS NOT NULL""")
def contours(s, d):
    return _longs(grid.contour_cells(views.grid(s, d))).select("grid_id", "iy", "ix", F.col("level_no").cast("long").alias("level_no"))


_GAUSS = """shape AS (SELECT segment, max(trace_no) + 1 AS ny, max(k) + 1 AS nx FROM cells GROUP BY segment), bell AS (SELECT t, exp(-0.5 * pow(t / {s}::DOUBLE, 2)) / (SELECT sum(exp(-0.5 * pow(u / {s}::DOUBLE, 2))) FROM (SELECT unnest(range(-{r}, {r} + 1)) AS u)) AS w FROM (SELECT unnest(range(-{r}, {r} + 1)) AS t)),
    down AS (SELECT a.segment, a.trace_no, a.k, sum(b.value * w) AS value FROM cells a JOIN shape s ON s.segment = a.segment JOIN bell ON true JOIN cells b ON b.segment = a.segment AND b.k = a.k AND b.trace_no = CASE WHEN a.trace_no + t < 0 THEN -a.trace_no - t - 1 WHEN a.trace_no + t >= ny THEN 2 * ny - 1 - a.trace_no - t ELSE a.trace_no + t END GROUP BY ALL),
    smooth AS (SELECT a.segment, a.trace_no, a.k, sum(b.value * w) AS value FROM down a JOIN shape s ON s.segment = a.segment JOIN bell ON true JOIN down b ON b.segment = a.segment AND b.trace_no = a.trace_no AND b.k = CASE WHEN a.k + t < 0 THEN -a.k - t - 1 WHEN a.k + t >= nx THEN 2 * nx - 1 - a.k - t ELSE a.k + t END GROUP BY ALL)"""
#: Vertical derivative of {z} by its discrete Fourier transform, one axis at a time.
_SPECTRAL = """size AS (SELECT segment, max(trace_no) + 1 AS ny, max(k) + 1 AS nx FROM {z} GROUP BY segment),
    f1 AS (SELECT z.segment, trace_no, u, sum(value * cos(2 * pi() * u * k / nx)) AS re, -sum(value * sin(2 * pi() * u * k / nx)) AS im FROM {z} z JOIN (SELECT segment, nx, unnest(range(0, nx)) AS u FROM size) s ON s.segment = z.segment GROUP BY ALL),
    f2 AS (SELECT f.segment, v, u, sum(re * cos(2 * pi() * v * trace_no / ny) + im * sin(2 * pi() * v * trace_no / ny)) AS re, sum(im * cos(2 * pi() * v * trace_no / ny) - re * sin(2 * pi() * v * trace_no / ny)) AS im FROM f1 f JOIN (SELECT segment, ny, unnest(range(0, ny)) AS v FROM size) s ON s.segment = f.segment GROUP BY ALL),
    f3 AS (SELECT f.segment, v, u, 2 * pi() * sqrt(pow(least(u, nx - u) / nx::DOUBLE, 2) + pow(least(v, ny - v) / ny::DOUBLE, 2)) AS g, re, im FROM f2 f JOIN size s ON s.segment = f.segment),
    f4 AS (SELECT f.segment, trace_no, u, sum(g * (re * cos(2 * pi() * v * trace_no / ny) - im * sin(2 * pi() * v * trace_no / ny))) / any_value(ny) AS re, sum(g * (im * cos(2 * pi() * v * trace_no / ny) + re * sin(2 * pi() * v * trace_no / ny))) / any_value(ny) AS im FROM f3 f JOIN (SELECT segment, ny, unnest(range(0, ny)) AS trace_no FROM size) s ON s.segment = f.segment GROUP BY f.segment, trace_no, u),
    up AS (SELECT f.segment, trace_no, k, sum(re * cos(2 * pi() * u * k / nx) - im * sin(2 * pi() * u * k / nx)) / any_value(nx) AS dz FROM f4 f JOIN (SELECT segment, nx, unnest(range(0, nx)) AS k FROM size) s ON s.segment = f.segment GROUP BY f.segment, trace_no, k),
    slopes AS (SELECT z.*, ny, nx, CASE WHEN k = 0 THEN lead(value) OVER r - value WHEN k = nx - 1 THEN value - lag(value) OVER r ELSE (lead(value) OVER r - lag(value) OVER r) / 2 END AS gx,
      CASE WHEN trace_no = 0 THEN lead(value) OVER c - value WHEN trace_no = ny - 1 THEN value - lag(value) OVER c ELSE (lead(value) OVER c - lag(value) OVER c) / 2 END AS gy FROM {z} z JOIN size s ON s.segment = z.segment WINDOW r AS (PARTITION BY z.segment, trace_no ORDER BY k), c AS (PARTITION BY z.segment, k ORDER BY trace_no))"""


def _grid_sql(steps: str, body: str) -> str:
    return sql("cells", ", " + steps + body).replace(")\n, ", "),\n")


_SIGNALS = f"""{r6("sqrt(gx * gx + gy * gy + dz * dz)")} AS analytic_signal, {r6("atan2(dz, sqrt(gx * gx + gy * gy) + 1e-10)")} AS tilt"""


@query(_grid_sql(_SPECTRAL.format(z="cells"), f" SELECT s.segment AS grid_id, s.trace_no AS iy, s.k AS ix, {_SIGNALS} FROM slopes s JOIN up u ON u.segment = s.segment AND u.trace_no = s.trace_no AND u.k = s.k"))
def analytic_signal(s, d):
    derived = grid.per_grid(views.grid(s, d), lambda z: grid.derivatives(z, 1.0, 1.0), ["d_dx", "d_dy", "d_dz"])
    return _longs(rounded(grid.signals(derived), "analytic_signal", "tilt")).select("grid_id", "iy", "ix", "analytic_signal", "tilt")


@query(_grid_sql(_GAUSS.format(s=1, r=4), f" SELECT segment AS grid_id, trace_no AS iy, k AS ix, {r6('value')} AS value FROM smooth"))
def gaussian_smooth(s, d):
    return _longs(rounded(grid.per_grid(views.grid(s, d), lambda z: {"value": grid.gaussian(z, 1.0)}, ["value"]), "value"))


@query()
def euler(s, d):
    smooth = grid.per_grid(views.grid(s, d), lambda z: {"value": grid.gaussian(z, 2.0)}, ["value"])
    return rounded(grid.euler_solutions(smooth, 1.0, 1.0, 1.0, 10, "corrected"), "x", "y", "depth")




@query()
def cubic_grid(s, d):
    return _longs(rounded(grid.scatter_grid(views.points(s, d), 30, 30), "x", "y", "value"))


@query()
def mincurve_soft(s, d):
    from .scripts import GridParams

    p = GridParams(soft=True)
    return _longs(rounded(grid.minimum_curvature(views.points(s, d), p.nodes, p.nodes, p.soft, p.iterations), "x", "y", "value"))


@query()
def mincurve_hard(s, d):
    from .scripts import GridParams

    p = GridParams(soft=False)
    return _longs(rounded(grid.minimum_curvature(views.points(s, d), p.nodes, p.nodes, p.soft, p.iterations), "x", "y", "value"))


# layers


@query(sql("layers", """SELECT position, CASE WHEN processor = 'magnetic' THEN 'Magnetic Processing' WHEN processor = 'gamma' THEN 'Gamma Processing' WHEN last_step LIKE '%gpr%' THEN 'GPR Processing'
    WHEN source = 'data_viewer' THEN 'Survey Data' WHEN source = 'annotation' THEN 'Annotations' WHEN source = 'processing' THEN 'Data Processing' ELSE 'Other' END AS group_name FROM layers"""))
def layer_groups(s, d):
    rows = views.layers(s, d)
    return rows.select("position", styling.layer_group(F.col("processor"), F.col("last_step"), F.col("source")).alias("group_name"))


@query(sql("layers", """SELECT position, CASE WHEN data_type LIKE '%anomaly%' THEN 'Anomalies' WHEN data_type LIKE '%segment%' THEN 'Segments' WHEN script LIKE '%magbase%' THEN 'Magbase Data' WHEN script LIKE '%grid_interpolator%' THEN 'Interpolated Grid'
    WHEN name LIKE 'grid%' THEN 'Interpolated Grid' WHEN name LIKE '%contour%' THEN 'Contours' WHEN name LIKE 'flight%' THEN 'Flight Data' WHEN name LIKE 'survey%' THEN 'Survey ' || position WHEN name LIKE 'walk%' THEN 'Walk ' || position ELSE 'Raw ' || position END AS label FROM layers"""))
def layer_names(s, d):
    rows = views.layers(s, d)
    return rows.select("position", styling.layer_name(F.col("name"), F.col("data_type"), F.col("script")).alias("label"))


@query(sql("layers", "SELECT position, CAST(row_number() OVER (ORDER BY z_index, position) AS BIGINT) AS place FROM layers WHERE is_visible"))
def visible_order(s, d):
    shown = layers.visible(views.layers(s, d)).select("position", "z_index")  # the keys alone, so that both looks at them share one shuffle
    return tables.with_row_id(shown, ["z_index", "position"]).select("position", (F.col("row_id") + 1).alias("place"))


@query(sql("layers", "SELECT source AS group_name, processor AS script, run_id, count(*) AS n_layers FROM layers GROUP BY ROLLUP (source, processor, run_id)"))
def layer_hierarchy(s, d):
    rows = views.layers(s, d).select(F.col("source").alias("group_name"), F.col("processor").alias("script"), "run_id")
    return layers.hierarchy(rows).select("group_name", "script", "run_id", "n_layers")


@query("SELECT event_id, '[' || strftime(ts, '%H:%M:%S') || '] ' || CASE WHEN event_type = 'click' THEN 'Started: s' || user_id WHEN event_type = 'view' THEN 'Finished: s' || user_id ELSE event_type END AS line FROM events")
def history_summary(s, d):
    rows = views.table(s, d, "events")
    kind = F.when(F.col("event_type") == "click", "processing.started").when(F.col("event_type") == "view", "processing.completed").otherwise(F.col("event_type"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    data = F.to_json(F.struct(F.concat(F.lit("s"), "user_id").alias("script_id"), F.lit("success").alias("status")))
    return rows.select("event_id", styling.event_summary(stamp, kind, data).alias("line"))


@query("SELECT event_type AS processor, script, used_at FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY used_at DESC, script) AS n FROM (SELECT event_type, user_id % 20 AS script, max(epoch_us(ts) // 1000) AS used_at FROM events GROUP BY ALL)) WHERE n = 1")
def latest_script(s, d):
    runs = views.events(s, d).select(F.col("event_type").alias("processor"), (F.col("user_id") % 20).alias("script"), F.col("t_ms").alias("used_at"))
    return layers.latest_script(runs)


@query("SELECT event_type AS processor, script, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY used_at DESC, script) AS rank FROM (SELECT event_type, user_id % 20 AS script, max(epoch_us(ts) // 1000) AS used_at FROM events GROUP BY ALL)) WHERE rank <= 5")
def recent_scripts(s, d):
    runs = views.events(s, d).select(F.col("event_type").alias("processor"), (F.col("user_id") % 20).alias("script"), F.col("t_ms").alias("used_at"))
    return layers.recent_scripts(runs).select("processor", "script", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id AS line_id, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n_rows, (round(avg(value), 6) + 0.0) AS mean_field FROM events GROUP BY ALL".replace("user_id AS line_id, ", ""))
def hourly_rates(s, d):
    from stratafield.streaming import flightline

    rows = views.table(s, d, "events").select("ts", F.col("value").alias("field"))
    return rounded(flightline.rates(rows, "1 hour"), "mean_field")


# bookkeeping


@query(sql("track", f"""SELECT line_id, {r6("min(v)")} AS min_kmh, {r6("max(v)")} AS max_kmh, {r6("median(v)")} AS median_kmh, count(*) FILTER (WHERE v > 200) AS n_fast, count(*) FILTER (WHERE v < 1) AS n_slow, {r6("(max(t_ms) - min(t_ms)) / 60000.0::DOUBLE")} AS minutes
    FROM (SELECT *, field * 3 AS v FROM track) GROUP BY line_id"""))
def speed_summary(s, d):
    out = survey.speed_summary(views.track(s, d).withColumn("speed_kmh", F.col("field") * 3))
    return rounded(out, "min_kmh", "max_kmh", "median_kmh", "minutes").drop("mean_kmh", "per_minute")


@query(sql("members", f"""SELECT t.line_id, t.n AS n_all, coalesce(m.n, 0) AS n_kept, {r6("coalesce(m.minutes, 0)")} AS minutes, {r6("100.0::DOUBLE * coalesce(m.n, 0) / t.n")} AS percent FROM (SELECT line_id, count(*) AS n FROM track GROUP BY line_id) t
    LEFT JOIN (SELECT line_id, count(*) AS n, (max(t_ms) - min(t_ms)) / 60000.0::DOUBLE AS minutes FROM members GROUP BY line_id) m ON t.line_id = m.line_id"""))
def retention(s, d):
    return rounded(survey.retention(views.track(s, d), _members(s, d)), "minutes", "percent").select("line_id", "n_all", "n_kept", "minutes", "percent")


@query("SELECT event_type, min(event_id) AS first_row, row_number() OVER (ORDER BY min(event_id)) - 1 AS rank FROM events GROUP BY event_type")
def distinct_in_order(s, d):
    return survey.distinct_in_order(views.table(s, d, "events"), "event_type", "event_id").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT event_id // 100 AS frame, count(*) AS n FROM events GROUP BY 1")
def progressive_frames(s, d):
    return survey.progressive_frames(views.table(s, d, "events"), "event_id", 1000).groupBy("frame").agg(F.count("*").alias("n"))


@query(sql("track", f"SELECT event_id, {r6('(k * 3600 + seq / 250.0::DOUBLE) % 86400')} AS progress_s FROM track"))
def progressive_time(s, d):
    return rounded(survey.progressive_time(views.track(s, d), F.col("k") * 3600.0), "progress_s").select("event_id", "progress_s")


@query(sql("walk", f"SELECT line_id, seq, {r6(f'first_value(lat IGNORE NULLS) OVER ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS lat FROM walk"))
def first_valid(s, d):
    return rounded(survey.first_valid(views.walk(s, d), ["lat"]), "lat").select("line_id", "seq", "lat")


@query(f"SELECT event_id, {r6('CASE WHEN value > 20 THEN value * 1.1 ELSE value * 0.9 END')} AS scaled FROM events")
def conditional_scale(s, d):
    return rounded(views.table(s, d, "events").select("event_id", survey.scaled_by_threshold(F.col("value"), 20).alias("scaled")), "scaled")


@query(sql("track", "SELECT k, min(seq * 1000 + line_id) AS row_id FROM track WHERE k IN (SELECT unnest(range(0, 50, 7))) GROUP BY k"))
def first_rows(s, d):
    wanted = s.range(0, 50, 7).select(F.col("id").alias("k"))
    rows = views.track(s, d).select("k", (F.col("seq") * 1000 + F.col("line_id")).alias("row_id"))
    return asof.first_rows(wanted, rows, "k")


@query(sql("track", "SELECT event_id AS row_id, CASE WHEN event_type = 'view' AND k % 2 = 0 THEN field * 2 ELSE field END AS field FROM track"))
def update_rows(s, d):
    old = views.track(s, d).select(F.col("event_id").alias("row_id"), "event_type", "k", "field")
    new = old.filter("event_type = 'view'").select("row_id", F.when(F.col("k") % 2 == 0, F.col("field") * 2).alias("field"))
    return asof.update_rows(old, new, ["field"]).select("row_id", "field")


@query(sql("members", "SELECT CASE WHEN direction IN ('N', 'S') THEN 'North_South' WHEN direction IN ('E', 'W') THEN 'East_West' WHEN direction IN ('NE', 'SW') THEN 'Northeast_Southwest' ELSE 'Northwest_Southeast' END AS pair, count(*) AS n FROM members GROUP BY 1"))
def opposite_pairs(s, d):
    named = angles.cardinal(F.col("mean_heading"), angles.LONG_CARDINALS)
    return _members(s, d).groupBy(segments.cardinal_pair(named).alias("pair")).agg(F.count("*").alias("n"))


@query(_POINTS + f", {_NODES}" + " SELECT DISTINCT iy, ix FROM nodes n JOIN points p ON sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)) <= 0.02")
def mask_buffer(s, d):
    nodes = s.range(40).select(F.col("id").alias("iy")).crossJoin(s.range(40).select(F.col("id").alias("ix"))).withColumns({"x": F.col("ix") / 39.0, "y": F.col("iy") / 39.0})
    return survey.near_points(nodes, views.points(s, d), 0.02).select("iy", "ix")


@query(_POINTS + f", {_NODES}" + f""", f AS (SELECT c_custkey, x * 39 - floor(x * 39) AS u, y * 39 - floor(y * 39) AS v, CAST(floor(x * 39) AS BIGINT) AS i, CAST(floor(y * 39) AS BIGINT) AS j FROM points)
    SELECT c_custkey, {r6("(a.iy * 3 + a.ix * a.ix) * (1 - u) * (1 - v) + (b.iy * 3 + b.ix * b.ix) * u * (1 - v) + (c.iy * 3 + c.ix * c.ix) * (1 - u) * v + (e.iy * 3 + e.ix * e.ix) * u * v")} AS fitted
    FROM f JOIN nodes a ON a.ix = i AND a.iy = j JOIN nodes b ON b.ix = i + 1 AND b.iy = j JOIN nodes c ON c.ix = i AND c.iy = j + 1 JOIN nodes e ON e.ix = i + 1 AND e.iy = j + 1""")
def bilinear_fit(s, d):
    cells = s.range(40).select(F.col("id").alias("iy")).crossJoin(s.range(40).select(F.col("id").alias("ix"))).withColumn("value", (F.col("iy") * 3 + F.col("ix") ** 2).cast("double"))
    out = survey.bilinear(views.points(s, d), cells, 0.0, 0.0, 1 / 39, 1 / 39)
    return rounded(out, "fitted").select("c_custkey", "fitted")


@query("SELECT turn, count(*) AS n, CASE WHEN contains(lower(role), 'gps') THEN 'gps' ELSE 'other' END AS category FROM conversations GROUP BY turn, category")
def metadata_groups(s, d):
    return views.table(s, d, "conversations").groupBy("turn", styling.metadata_group(F.col("role")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, printf('%.6f', s_acctbal) AS shown FROM supplier")
def cell_format(s, d):
    return views.table(s, d, "supplier").select("s_suppkey", survey.cell_text(F.col("s_acctbal")).alias("shown"))


def _magbase_sql() -> str:
    a, e = geodesy.ALPHA, geodesy.E2**0.5
    xi = " + ".join(["xi0"] + [f"{x!r}::DOUBLE * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, x in enumerate(a, 1)])
    eta = " + ".join(["eta0"] + [f"{x!r}::DOUBLE * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, x in enumerate(a, 1)])
    fix = "CASE WHEN fix THEN {{'seq': seq, 'lat': lat, 'lon': lon}} END".replace("{{", "{").replace("}}", "}")
    return sql("walk", f""", trim AS (SELECT * FROM (SELECT *, min(CASE WHEN fix THEN seq END) OVER (PARTITION BY line_id) AS f0, max(CASE WHEN fix THEN seq END) OVER (PARTITION BY line_id) AS f1 FROM walk) WHERE f0 IS NULL OR seq BETWEEN f0 AND f1),
    ends AS (SELECT *, last_value({fix} IGNORE NULLS) OVER ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo, first_value({fix} IGNORE NULLS) OVER ({LINE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM trim),
    filled AS (SELECT event_id, t_ms, sqrt(bx * bx + "by" * "by" + bz * bz) AS b1, field AS b2, CASE WHEN hi.seq > lo.seq THEN lo.lat + (seq - lo.seq) / (hi.seq - lo.seq)::DOUBLE * (hi.lat - lo.lat) ELSE lat END AS lat,
      CASE WHEN hi.seq > lo.seq THEN lo.lon + (seq - lo.seq) / (hi.seq - lo.seq)::DOUBLE * (hi.lon - lo.lon) ELSE lon END AS lon FROM ends),
    base AS (SELECT t_ms, min(field) AS nT FROM track WHERE event_type = 'error' GROUP BY t_ms),
    near AS (SELECT f.event_id, min_by(b.nT, (abs(b.t_ms - f.t_ms), b.t_ms)) AS nT FROM filled f, base b GROUP BY f.event_id)
    SELECT event_id, (round(500000 + {geodesy.K0 * geodesy.RECTIFYING!r}::DOUBLE * ({eta}) + 0.0375, 3) + 0.0) AS utm_easting1, (round({geodesy.K0 * geodesy.RECTIFYING!r}::DOUBLE * ({xi}) - 0.56, 3) + 0.0) AS utm_northing1,
      {r6("b1 - nT")} AS r1, {r6("b2 - nT")} AS r2, {r6("(b1 - nT) - (b2 - nT)")} AS va FROM
      (SELECT *, atan2(t, cos(lam)) AS xi0, atanh(sin(lam) / sqrt(1 + t * t)) AS eta0 FROM (SELECT *, radians(lon - 15) AS lam, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t FROM filled JOIN near USING (event_id)))""").replace(")\n, trim", "),\ntrim")


@query(_magbase_sql())
def magbase_chain(s, d):
    from .scripts import MagbaseParams, magbase

    _, base = _observed(s, d)
    walk = views.walk(s, d).withColumns({"bx1": F.col("bx"), "by1": F.col("by"), "bz1": F.col("bz"), "btotal2": F.col("field")}).drop("bx", "by", "bz", "easting", "northing")
    out = magbase(walk, MagbaseParams(base=base, vertical_alignment=True)).data
    metres = {c: F.round(c, 3) for c in ("utm_easting1", "utm_northing1")}
    return rounded(out.withColumns(metres), "r1", "r2", "va").select("event_id", "utm_easting1", "utm_northing1", "r1", "r2", "va")


@query(_grid_sql(_GAUSS.format(s=1, r=4) + ", " + _SPECTRAL.format(z="smooth"), f" SELECT s.segment AS grid_id, s.trace_no AS iy, s.k AS ix, {_SIGNALS}, {r6('sqrt(gx * gx + gy * gy)')} AS horizontal_gradient FROM slopes s JOIN up u ON u.segment = s.segment AND u.trace_no = s.trace_no AND u.k = s.k"))
def anomaly_grid_chain(s, d):
    from .scripts import AnomalyParams, anomaly_processor

    return _longs(rounded(anomaly_processor(views.grid(s, d), AnomalyParams()).data, "analytic_signal", "tilt", "horizontal_gradient")).select("grid_id", "iy", "ix", "analytic_signal", "tilt", "horizontal_gradient")
