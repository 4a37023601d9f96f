"""Further registered queries: registry, reports, clock, styling, radar helpers
and loaded files, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from stratafield.functions import clock, geodesy, styling, udtf
from stratafield.operators import grid, layers, radar, segments, survey, tables
from stratafield.operators.frozen import shared_folder
from stratafield.sources import delimited

from . import views
from .catalog import _flat, _longs, _members, _runs, query
from .views import r6, rounded, sql

_PLACES = "SELECT event_id, ((event_id * 37) % 1700) / 10.0::DOUBLE - 85 AS lat, ((event_id * 61) % 3600) / 10.0::DOUBLE - 180 AS lon FROM events"


def _places(s, d):
    key = F.col("event_id")
    return views.table(s, d, "events").select("event_id", (((key * 37) % 1700) / 10.0 - 85).alias("lat"), (((key * 61) % 3600) / 10.0 - 180).alias("lon"))


@query(f"""WITH p AS ({_PLACES}), q AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 AS plain FROM p)
    SELECT event_id, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 42 THEN (CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END) ELSE plain END AS zone FROM q""")
def utm_zones(s, d):
    return _places(s, d).select("event_id", geodesy.utm_zone(F.col("lat"), F.col("lon")).alias("zone"))


@query(f"SELECT event_id, CASE WHEN lon < 12 THEN 32 WHEN lon < 18 THEN 33 WHEN lon < 24 THEN 34 ELSE 35 END AS zone FROM ({_PLACES})")
def centre_zones(s, d):
    return _places(s, d).select("event_id", geodesy.norwegian_zone(F.col("lon")).alias("zone"))


@query(f"SELECT event_id, lat, lon FROM ({_PLACES}) ORDER BY lat, lon, event_id")
def sorted_places(s, d):
    return _places(s, d).orderBy("lat", "lon", "event_id")


@query(f"SELECT event_id FROM ({_PLACES}) WHERE lat BETWEEN -60 AND 60 AND lon BETWEEN -100 AND 100")
def range_valid(s, d):
    return tables.within(tables.within(_places(s, d), "lat", F.lit(-60), F.lit(60)), "lon", F.lit(-100), F.lit(100)).select("event_id")


_TIME = "SELECT event_id, printf('%02d:%02d:%02d', event_id % 24, (event_id * 7) % 60, (event_id * 11) % 60) || '.' || (event_id % 9 + 1) AS t FROM events"


def _times(s, d):
    key = F.col("event_id")
    text = F.concat(F.format_string("%02d:%02d:%02d", key % 24, (key * 7) % 60, (key * 11) % 60), F.lit("."), (key % 9 + 1).cast("string"))
    return views.table(s, d, "events").select("event_id", text.alias("t"))


@query(f"""SELECT event_id, {r6("(event_id % 24) * 3600 + ((event_id * 7) % 60) * 60 + ((event_id * 11) % 60) + (event_id % 9 + 1) / 10.0::DOUBLE")} AS seconds,
    CAST(printf('%02d', (event_id % 24 + 2) % 24) || printf('%02d', (event_id * 7) % 60) || replace(CAST(CAST(printf('%d.%d', (event_id * 11) % 60, event_id % 9 + 1) AS DOUBLE) AS VARCHAR), '.', '') AS DOUBLE) AS code FROM events""")
def time_codes(s, d):
    t = F.col("t")
    return rounded(_times(s, d).select("event_id", clock.seconds_of_day(t).alias("seconds"), clock.compat_code(t).alias("code")), "seconds")


@query(f"SELECT event_id, {r6("((event_id % 24) * 3600 + ((event_id * 7) % 60) * 60 + ((event_id * 11) % 60))::DOUBLE")} AS seconds FROM events")
def packed_times(s, d):
    packed = F.regexp_replace(F.substring("t", 1, 8), ":", "")
    return rounded(_times(s, d).select("event_id", clock.packed_seconds(packed).alias("seconds")), "seconds")


@query("SELECT event_id, printf('%02d/%02d/%04d %02d:%02d:%02d', event_id % 28 + 1, event_id % 12 + 1, 2000 + event_id % 25, event_id % 24, (event_id * 7) % 60, (event_id * 11) % 60) AS label FROM events")
def run_labels(s, d):
    key = F.col("event_id")
    run = F.format_string("%04d%02d%02d_%02d%02d%02d", 2000 + key % 25, key % 12 + 1, key % 28 + 1, key % 24, (key * 7) % 60, (key * 11) % 60)
    return views.table(s, d, "events").select("event_id", clock.run_label(run).alias("label"))


def _ramp_sql(channel: int) -> str:
    stops = styling.RASTER_STOPS
    parts = " ".join(f"WHEN v < {b[0]} THEN {a[channel]} + (v - {a[0]}) * {b[channel] - a[channel]!r}::DOUBLE / {b[0] - a[0]!r}::DOUBLE" for a, b in zip(stops, stops[1:], strict=False))
    return f"CASE WHEN v IS NULL THEN 0.0 WHEN v <= 0 THEN {stops[0][channel]} {parts} ELSE {stops[-1][channel]} END::DOUBLE"


@query(f"SELECT s_suppkey, {r6(_ramp_sql(1))} AS red, {r6(_ramp_sql(2))} AS green, {r6(_ramp_sql(3))} AS blue, CASE WHEN v IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS alpha FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 > 0 THEN s_acctbal / 9000 END AS v FROM supplier)")
def raster_colours(s, d):
    level = F.when(F.col("s_suppkey") % 9 > 0, F.col("s_acctbal") / 9000)
    out = views.table(s, d, "supplier").select("s_suppkey", styling.raster_colour(level).alias("c"))
    return out.select("s_suppkey", *[F.round(F.col("c")[i], 6).alias(n) for i, n in enumerate(("red", "green", "blue", "alpha"))])


_REGISTRY = "registry AS (SELECT 'layer' || s_suppkey AS name, s_suppkey AS position, s_suppkey % 3 AS z_index, s_suppkey % 2 = 0 AS is_visible, (s_suppkey % 10) / 10.0::DOUBLE AS opacity, (s_suppkey % 5) / 10.0::DOUBLE AS fill_opacity FROM supplier)"


def _registry(s, d):
    key = F.col("s_suppkey")
    return views.table(s, d, "supplier").select(F.concat(F.lit("layer"), key.cast("string")).alias("name"), key.alias("position"), (key % 3).alias("z_index"), (key % 2 == 0).alias("is_visible"), ((key % 10) / 10.0).alias("opacity"), ((key % 5) / 10.0).alias("fill_opacity"))


@query(f"WITH {_REGISTRY} SELECT name, CASE WHEN name = 'layer7' THEN 1.0 ELSE opacity END AS opacity, CASE WHEN name = 'layer7' THEN 0.8 ELSE fill_opacity END AS fill_opacity FROM registry")
def layer_opacity(s, d):
    return layers.set_opacity(_registry(s, d), "layer7", 1.7).select("name", "opacity", "fill_opacity")


@query(f"""WITH {_REGISTRY}, c AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'layer' ELSE 'added' END || s_suppkey AS name, 9 AS z_index FROM supplier WHERE s_suppkey % 2 = 1)
    SELECT r.name, r.position, coalesce(c.z_index, r.z_index) AS z_index FROM registry r LEFT JOIN c ON c.name = r.name
    UNION ALL SELECT name, (SELECT max(position) FROM registry) + row_number() OVER (ORDER BY name), z_index FROM c WHERE name NOT IN (SELECT name FROM registry)""")
def layer_upsert(s, d):
    key = F.col("s_suppkey")
    name = F.concat(F.when(key % 3 == 0, "layer").otherwise("added"), key.cast("string"))
    changes = views.table(s, d, "supplier").filter(key % 2 == 1).select(name.alias("name"), F.lit(0).cast("long").alias("position"), F.lit(9).cast("long").alias("z_index"))
    return layers.upsert(_registry(s, d).select("name", "position", "z_index"), changes)


@query(f"WITH {_REGISTRY} SELECT name FROM registry WHERE name NOT IN ('layer3', 'layer8', 'layer999999')")
def layer_remove(s, d):
    return layers.remove(_registry(s, d), ["layer3", "layer8", "layer999999"]).select("name")


@query("SELECT r_name AS name, 4 - r_regionkey AS position, 4 - r_regionkey AS z_index FROM region")
def layer_reorder(s, d):
    registry = views.table(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("position"), F.lit(0).cast("long").alias("z_index"))
    names = [r["name"] for r in registry.orderBy(F.desc("position")).collect()]  # the five layers of one map
    out = layers.reorder(registry, names)
    return out.select("name", F.col("position").cast("long").alias("position"), F.col("z_index").cast("long").alias("z_index"))


@query(f"WITH {_REGISTRY} SELECT name, CASE WHEN position % 4 = 0 THEN NOT is_visible ELSE is_visible END AS is_visible, CASE WHEN position % 4 = 0 THEN 0.25 ELSE opacity END AS opacity FROM registry")
def layer_restore(s, d):
    registry = _registry(s, d)
    saved = registry.filter("position % 4 = 0").select("name", (~F.col("is_visible")).alias("is_visible"), F.lit(0.25).alias("opacity"))
    saved = saved.unionByName(s.createDataFrame([("gone", True, 0.5)], "name string, is_visible boolean, opacity double"))
    return layers.restore(registry, saved, ["is_visible", "opacity"]).select("name", "is_visible", "opacity")


@query("SELECT 'layer' || n_nationkey AS name, CASE WHEN n_regionkey < 3 THEN 'in' || n_regionkey ELSE 'own' || n_nationkey END AS input, CASE WHEN n_regionkey < 2 THEN 'out' || n_regionkey WHEN n_regionkey < 3 THEN 'in' || n_regionkey ELSE 'own' || n_nationkey END AS reprocess FROM nation")
def layer_lineage(s, d):
    key = F.col("n_nationkey").cast("string")
    registry = views.table(s, d, "nation").select(F.concat(F.lit("layer"), key).alias("name"), F.col("n_regionkey").alias("run_id"), F.concat(F.lit("own"), key).alias("input_file"))
    region = F.col("r_regionkey")
    file = lambda word: F.array(F.concat(F.lit(word), region.cast("string")))
    runs = views.table(s, d, "region").filter(region < 3).select(region.alias("run_id"), file("in").alias("inputs"), F.when(region < 2, file("out")).otherwise(F.array().cast("array<string>")).alias("outputs"))
    return layers.lineage(registry, runs).select("name", "input", "reprocess")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_activity(s, d):
    return layers.history(views.table(s, d, "events").withColumn("timestamp", F.col("ts"))).limit(50).select("event_id")  # the feature: the latest 50


@query("SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS a, TRY_CAST(split_part(o_orderpriority, '-', 2) AS DOUBLE) AS b FROM orders")
def coerced_numbers(s, d):
    parts = F.split("o_orderpriority", "-")
    out = views.table(s, d, "orders").select("o_orderkey", F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b"))
    return tables.numbers(out, ["a", "b"])


@query(sql("walk", "SELECT event_id FROM walk WHERE lat IS NOT NULL AND lon IS NOT NULL AND field IS NOT NULL"))
def complete_triples(s, d):
    return tables.complete_rows(views.walk(s, d), ["lat", "lon", "field"]).select("event_id")


@query(sql("track", f"""SELECT channel, count(v) AS n, {r6("min(v)")} AS min, {r6("max(v)")} AS max, {r6("avg(v)")} AS mean, {r6("stddev_samp(v)")} AS std FROM (SELECT unnest(['countrate', 'u238', 'total']) AS channel, unnest([field, field * k / 100.0::DOUBLE, 10.0 * k]) AS v FROM track) GROUP BY channel"""))
def gamma_report(s, d):
    return rounded(survey.channel_report(views.gamma(s, d), ["countrate", "u238", "total", "cs137"]), "min", "max", "mean", "std")


@query(sql("members", """SELECT direction, printf('%s: %d lines, %d points, mean heading %.1f', direction, n_lines, n, h) AS line FROM (SELECT direction, count(DISTINCT line_id * 1000000 + start_seq) AS n_lines, count(*) AS n,
    round((degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) + 360) % 360, 6) AS h FROM members GROUP BY direction)"""))
def segmentation_report(s, d):
    return survey.segment_report(rounded(segments.segment_statistics(_members(s, d)), "mean_heading"))


@query()
def opposite_headings(s, d):
    runs = _runs(s, d).withColumns({"survey": F.col("line_id") % 5, "heading": F.col("mean_heading")})
    groups = runs.groupBy("survey", F.round("heading").alias("heading")).agg(F.min(F.struct("line_id", "start_seq")).alias("first"))
    order = F.row_number().over(Window.partitionBy("survey").orderBy("first"))
    return segments.match_opposites(groups.withColumn("heading_group", order))


@query(sql("walk", f"""SELECT event_id, CASE WHEN fix THEN printf('%02d:%02d:00.000', k % 24, k % 60) WHEN t IS NOT NULL AND nx IS NOT NULL THEN t || printf('%06.3f', (seq * 7 + 0.5) % 60) END AS clock FROM
    (SELECT *, last_value(CASE WHEN fix THEN printf('%02d:%02d:', k % 24, k % 60) END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t,
      first_value(CASE WHEN fix THEN seq END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM walk) w"""))
def filled_clock(s, d):
    walk = views.walk(s, d).withColumns({"num": F.col("seq") * 7 + 0.5, "clock": F.when(F.col("fix"), F.format_string("%02d:%02d:00.000", F.col("k") % 24, F.col("k") % 60)), "day": F.when(F.col("fix"), F.lit("2024-01-01"))})
    return survey.fill_times(walk, "num", "clock", "day").select("event_id", "clock")


@query(sql("walk", f"SELECT event_id, {r6('2 * (max(k) OVER (PARTITION BY line_id) - k) * 100 / 30.0::DOUBLE')} AS twt_ns FROM walk"))
def air_time(s, d):
    return rounded(radar.air_time(views.track(s, d).withColumn("segment", F.col("line_id")), "k"), "twt_ns").select("event_id", "twt_ns")


@query(sql("cells", f"SELECT segment, trace_no, k, {r6('value * 0.3 * k')} AS value FROM cells"))
def linear_gain(s, d):
    return _flat(radar.apply_gain(views.traces(s, d), radar.gains(64, 1.0, "linear", velocity=0.3)))


@query(sql("cells", f"SELECT segment, trace_no, k, {r6('value / (0.3 * CASE WHEN k = 0 THEN 0.01 ELSE k END)')} AS value FROM cells"))
def attenuation_gain(s, d):
    return _flat(radar.apply_gain(views.traces(s, d), radar.gains(64, 1.0, "attenuation", velocity=0.3)))


@query(sql("cells", f"SELECT segment, trace_no, k, {r6('value * CASE WHEN k <= 3 THEN pow(3.0, 0.5) WHEN k <= 40 THEN pow(k - 3.0, 0.5) ELSE 1 END * CASE WHEN k <= 40 THEN exp(0.05 * k) ELSE 1 END')} AS value FROM cells"))
def power_exponential_gain(s, d):
    return _flat(radar.apply_gain(views.traces(s, d), radar.power_then_exponential(64, 1.0, 0.5, 0.05, 40.0, 3.0)))


@query(sql("cells", f"SELECT segment, trace_no, k, {r6('value * pow(0.1 * 0.8 * k, 1.5)')} AS value FROM cells"))
def spreading_gain(s, d):
    return _flat(radar.spreading(views.traces(s, d), 0.8, 0.1, 1.5))


@query(sql("traces", """, p AS (SELECT *, CAST(round_even(((trace_no * 13) % 17) / 10.0::DOUBLE / 0.25, 0) AS BIGINT) + 1 AS shift FROM traces), q AS (SELECT *, max(shift) OVER (PARTITION BY segment) AS most FROM p),
    e AS (SELECT segment, trace_no, shift, samples, unnest(range(0, len(samples) + most)) AS k FROM q) SELECT segment, trace_no, k, round(CASE WHEN k >= shift AND k < shift + len(samples) THEN samples[k - shift + 1] ELSE 0.0 END, 6) + 0.0 AS value FROM e""").replace(")\n, p", "),\np"))
def depth_topography(s, d):
    traces = views.traces(s, d).withColumn("height", ((F.col("trace_no") * 13) % 17) / 10.0)
    return _flat(radar.topography_depth(traces, "height", 0.25).drop("height"))


@query(f"SELECT s_suppkey, CASE WHEN r BETWEEN 0 AND 1 THEN round(greatest(1.0, least(80.0, pow((1 + r) / (1 - r), 2))), 2) END AS e FROM (SELECT s_suppkey, (s_suppkey % 97) / 90.0::DOUBLE AS r FROM supplier WHERE s_suppkey % 97 <> 90)")
def layer_permittivities(s, d):
    key = F.col("s_suppkey")
    return views.table(s, d, "supplier").filter(key % 97 != 90).select("s_suppkey", radar.layer_permittivity((key % 97) / 90.0).alias("e"))


@query(sql("cells", "SELECT segment AS grid_id, trace_no AS iy, k AS ix, CASE WHEN k >= trace_no THEN round(greatest(-0.1, least(0.1, value)), 6) + 0.0 END AS value FROM cells"))
def masked_grid(s, d):
    return _longs(rounded(grid.masked(views.grid(s, d), F.col("ix") >= F.col("iy"), -0.1, 0.1), "value")).select("grid_id", "iy", "ix", "value")


@query("SELECT iy, ix, round(ix * 0.25::DOUBLE, 9) AS x, round(-1 + iy * 0.5::DOUBLE, 9) AS y FROM (SELECT unnest(range(0, 5)) AS iy), (SELECT unnest(range(0, 9)) AS ix)")
def mesh_function(s, d):
    udtf.register(s)
    return s.sql("SELECT cast(iy AS bigint) AS iy, cast(ix AS bigint) AS ix, round(x, 9) AS x, round(y, 9) AS y FROM mesh(0.0D, -1.0D, 2.0D, 1.0D, 9, 5)")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS _row_id, CAST(s_suppkey AS VARCHAR) AS t, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def loaded_table(s, d):
    """A logger file with metadata, blank lines and a trailing delimiter, scanned."""
    rows = views.table(s, d, "supplier").select(F.concat_ws(";", "s_suppkey", "s_name", "s_nationkey", F.lit("")).alias("value"), F.col("s_suppkey").alias("i"))
    head = s.createDataFrame([("Probe: 7", -4), ("", -3), ("Date: 2024-05-01;;", -2), ("Timestamp [ms];Name;Nation;", -1)], "value string, i long")
    path = f"{shared_folder(s)}/loaded-{uuid.uuid4().hex}"
    head.unionByName(rows).repartition(1).sortWithinPartitions("i").select("value").write.text(path)  # one file of a small table
    table, _ = delimited.load(s, path)
    return table.select("_row_id", F.col("`Timestamp [ms]`").alias("t"), F.col("Name").alias("name"), F.col("Nation").alias("nation"))


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def united_pages(s, d):
    page = lambda t, p: views.table(s, d, t).select(F.col(f"{p}_{'supp' if p == 's' else 'cust'}key").alias("key"), F.col(f"{p}_name").alias("name"))
    return page("supplier", "s").unionByName(page("customer", "c"))


@query("SELECT column_name, count(*) AS n FROM (SELECT unnest(['s_suppkey', 's_nationkey', 's_acctbal']) AS column_name FROM supplier) GROUP BY column_name")
def numeric_summary(s, d):
    suppliers = views.table(s, d, "supplier")
    return tables.long_form(suppliers, tables.numeric_columns(suppliers)).groupBy("column_name").agg(F.count("*").alias("n"))
