import math

import pytest
from pyspark.sql import functions as F

from stratafield.functions import angles, clock, geodesy, styling
from stratafield.operators import asof, grid, kinematics, layers, radar, roles, runner, segments, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_nearest_prefers_the_earlier_on_ties_and_reaches_over_buckets(spark):
    base = spark.createDataFrame([(0, 1.0), (10, 2.0), (10, 1.5), (50_000_000, 9.0)], "t_ms long, nT double")
    seen = spark.createDataFrame([(1, -5), (2, 5), (3, 6), (4, 10), (5, 20_000_000), (6, 90_000_000)], "id int, t_ms long")
    out = asof.nearest(seen, base, "nT").select("id", "base_t", "base_nT")
    assert rows(out, "id") == [(1, 0, 1.0), (2, 0, 1.0), (3, 10, 1.5), (4, 10, 1.5), (5, 10, 1.5), (6, 50_000_000, 9.0)]


def test_nearest_by_key_and_without_base(spark):
    base = spark.createDataFrame([("a", 5, 1.0)], "s string, t_ms long, nT double")
    seen = spark.createDataFrame([("a", 1), ("b", 1)], "s string, t_ms long")
    assert rows(asof.nearest(seen, base, "nT", by=["s"]).select("s", "base_nT"), "s") == [("a", 1.0), ("b", None)]


def test_diurnal_without_base_uses_the_totals(spark):
    base = spark.createDataFrame([], "t_ms long, nT double")
    seen = spark.createDataFrame([(1, 10.0, 7.0)], "t_ms long, btotal1 double, btotal2 double")
    assert asof.diurnal(seen, base).select("r1", "va").first() == (None, 3.0)


def test_update_never_overwrites_with_null(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "row_id int, v double")
    new = spark.createDataFrame([(1, None), (2, 5.0)], "row_id int, v double")
    assert rows(asof.update_rows(old, new, ["v"]), "row_id") == [(1, 1.0), (2, 5.0)]


def track(spark, points):
    return spark.createDataFrame([(1, i, float(x), float(y), i * 1000) for i, (x, y) in enumerate(points)], "line_id long, seq long, easting double, northing double, t_ms long")


def test_headings_of_a_corner(spark):
    t = track(spark, [(0, 0), (0, 1), (1, 1)])
    assert [r["heading"] for r in kinematics.heading_backward(t).orderBy("seq").collect()] == [0, 0, 90]
    assert [r["heading"] for r in kinematics.heading_forward(t).orderBy("seq").collect()] == [0, 90, 90]
    assert kinematics.heading_backward(track(spark, [(0, 0)])).first()["heading"] == 0


@pytest.mark.parametrize("size", [3, 4, 5])
def test_reflect_average_against_padding(spark, size):
    import numpy as np

    x = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "line_id long, seq long, v double")
    got = [r["m"] for r in kinematics.reflect_average(df, {"m": F.col("v")}, size).orderBy("seq").collect()]
    padded = np.pad(x, (size // 2, size - size // 2 - 1), mode="symmetric")
    assert got == pytest.approx([padded[i : i + size].mean() for i in range(len(x))])


def test_merge_of_islands(spark):
    t = track(spark, [(0, i) for i in range(40)]).withColumn("heading", F.lit(0.0))
    runs = spark.createDataFrame([(1, 0, 9, 10, 2.0), (1, 12, 20, 9, 358.0), (1, 30, 33, 4, 90.0)], "line_id long, start_seq long, end_seq long, n_rows long, mean_heading double")
    out = [(r["start_seq"], r["end_seq"]) for r in segments.merge_islands(t, runs, 5.0, 5).collect()]
    assert out == [(0, 20)]


def test_trailing_island_counts(spark):
    t = spark.createDataFrame([(1, i, 1.0 if i < 3 or i > 6 else 500.0, 2.0, 10.0) for i in range(10)], "line_id long, seq long, stability double, speed double, heading double")
    assert rows(segments.islands(t, 10.0, 0.5, 3).select("start_seq", "end_seq", "n_rows"), "start_seq") == [(0, 2, 3), (7, 9, 3)]


def test_group_headings_over_north(spark):
    runs = spark.createDataFrame([(1, 1, 358.0), (1, 2, 4.0), (1, 3, 90.0)], "survey int, run_no int, mean_heading double")
    assert [r["heading_group"] for r in segments.group_headings(runs).orderBy("run_no").collect()] == [0, 0, 1]


def test_circular_mean_and_cardinals(spark):
    df = spark.createDataFrame([(350.0,), (10.0,)], "h double")
    assert df.agg(angles.circular_mean(F.col("h")).alias("m")).first()["m"] % 360 == pytest.approx(0, abs=1e-9)
    names = spark.createDataFrame([(0.0,), (22.5,), (337.4,), (337.5,), (180.0,)], "h double").select(angles.cardinal(F.col("h")).alias("c"))
    assert [r["c"] for r in names.collect()] == ["N", "NE", "NW", "N", "S"]


def test_utm_of_known_points(spark):
    """Values of the central meridian and the equator follow from the definition."""
    df = spark.createDataFrame([(0.0, 15.0), (0.0, 18.0), (60.0, 15.0)], "lat double, lon double")
    e, n = geodesy.to_utm(F.col("lat"), F.col("lon"), 33)
    out = df.select(e.alias("e"), n.alias("n")).collect()
    assert out[0]["e"] == pytest.approx(500000) and out[0]["n"] == pytest.approx(0, abs=1e-6)
    assert out[1]["e"] == pytest.approx(833978.557, abs=0.01)
    assert out[2]["n"] == pytest.approx(6651411.19, abs=0.5)


def test_zones(spark):
    df = spark.createDataFrame([(60.0, 5.0), (50.0, 5.0), (78.0, 15.0), (10.0, -180.0)], "lat double, lon double")
    assert [r[0] for r in df.select(geodesy.utm_zone(F.col("lat"), F.col("lon"))).collect()] == [32, 31, 33, 1]


def test_geodesic_of_one_degree(spark):
    df = spark.range(1).select(geodesy.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("e"), geodesy.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("n"), geodesy.geodesic_m(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("z")).first()
    assert df["e"] == pytest.approx(111319.49, abs=1) and df["n"] == pytest.approx(110574.4, abs=1) and df["z"] == 0


def test_times(spark):
    df = spark.createDataFrame([("09:05:36.004", "90536.004"), ("bad", "x")], "a string, b string")
    out = df.select(clock.seconds_of_day(F.col("a")).alias("s"), clock.packed_seconds(F.col("b")).alias("p"), clock.compat_code(F.col("a")).alias("c")).collect()
    assert out[0]["s"] == pytest.approx(32736.004) and out[0]["p"] == pytest.approx(32736.004) and out[1]["s"] is None and out[1]["p"] is None
    assert out[0]["c"] == 110536004.0
    assert spark.range(1).select(clock.clock_text(F.lit(90061.5)).alias("t"), clock.run_label(F.lit("20240115_143000")).alias("r")).first() == ("01:01:01.500", "15/01/2024 14:30:00")


def test_roles():
    columns = ["Timestamp [ms]", "Latitude [Decimal Degrees]", "Longitude [Decimal Degrees]", "B1x [nT]", "Btotal1 [nT]", "b10"]
    assert roles.detect(columns)["latitude"] == columns[1]
    assert roles.detect(["Eastingy", "lat"], exact=False)["latitude"] == "Eastingy"
    assert roles.detect_walk(columns)["bx1"] == "B1x [nT]"
    assert "blue" not in roles.detect_bands(["b10"]) and roles.detect_bands(["b10"], exact=False)["blue"] == "b10"
    assert roles.detect_viewer(["lat", "lat2", "lon"]) == {"latitude": "lat2", "longitude": "lon"}
    assert roles.sensor(["U238", "K40"]) == "gamma" and roles.sensor(["U238"], compat=True) == "magnetic"
    assert roles.coordinate_system(["UTM_Easting 35"]) == "EPSG:25835" and roles.coordinate_system(["lat"]) == "EPSG:4326"


def test_search_edges(spark):
    df = spark.createDataFrame([(0, "Foo bar", "x"), (1, "foobar", "foo.")], "i int, a string, b string")
    find = lambda **k: rows(tables.cell_search(df, "i", ["a", "b"], **k), "column_no", "row")
    assert find(needle="foo") == [(0, 0), (1, 0), (1, 1)]
    assert find(needle="foo", whole_word=True) == [(0, 0), (1, 1)]
    assert find(needle="foo", match_case=True) == [(1, 0), (1, 1)]
    assert find(needle="(", is_regex=True) == [] and find(needle=" ") == [] and find(needle="foo.") == [(1, 1)]


def test_tables_of_odd_shape(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert tables.column_statistics(empty).collect() == [] and tables.histogram(empty, "a", 5).collect() == []
    flat = spark.createDataFrame([(2.0,), (2.0,), (None,)], "a double")
    assert rows(tables.histogram(flat, "a", 5), "bin") == [(0, 2)]
    assert tables.column_statistics(flat).first()["missing"] == 1
    assert tables.export_size(10, 3, "JSON") == 1200 and tables.sampling_step(2500) == 2 and tables.step_result(2, 3) == 0
    assert tables.validate_survey(spark.createDataFrame([(95.0, 1.0)], "lat double, lon double"), "lat", "lon") == ["1 rows, 10 needed", "lat out of range"]


def test_row_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [r["row_id"] for r in tables.with_row_id(df, ["k"]).orderBy("k").collect()] == list(range(1000))


def test_styling(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (9.9,), (float("nan"),), (None,)], "v double")
    out = [r[0] for r in df.select(styling.colour_bucket(F.col("v"), F.lit(0.0), F.lit(10.0))).collect()]
    assert out == ["#000080", "#00FF00", "#FF0000", "#0066CC", "#0066CC"]
    assert df.select(styling.raster_colour(F.col("v")).alias("c")).collect()[0]["c"] == pytest.approx([0.267, 0.004, 0.329, 0.9])
    name = lambda *a: spark.range(1).select(styling.layer_name(*map(F.lit, a))).first()[0]
    assert name("my_walk_20240115_143000.csv", "", "") == "My Walk" and name("_Output", "", "") == "Layer Data" and name("a", "", "x/magbase_2.py") == "Magbase Data"
    group = lambda mode: spark.range(1).select(styling.layer_group(F.lit(""), F.lit(""), F.lit("processing"), mode)).first()[0]
    assert group("corrected") == "Data Processing" and group("compat") == "Other"
    assert [r[0] for r in spark.createDataFrame([("Sample time",), ("GPS fix",), ("Probe",), ("x",)], "k string").select(styling.metadata_group(F.col("k"))).collect()] == ["survey", "gps", "probe", "other"]
    assert styling.default_style(2000, ["Class"])["point_size"] == 5 and styling.human_size(2048) == "2.0 KB"


def registry(spark):
    return spark.createDataFrame([("a", 0, 1, True, 1.0, 0.8), ("b", 1, 0, True, 1.0, 0.8), ("c", 2, 0, False, 1.0, 0.8)], "name string, position long, z_index long, is_visible boolean, opacity double, fill_opacity double")


def test_layers(spark):
    held = registry(spark)
    assert [r["name"] for r in layers.visible(held).collect()] == ["b", "a"]
    changed = layers.upsert(held, spark.createDataFrame([("b", 0, 9, False, 1.0, 0.8), ("d", 0, 1, True, 1.0, 0.8)], held.schema))
    assert [(r["name"], r["position"], r["z_index"]) for r in changed.orderBy("position").collect()] == [("a", 0, 1), ("b", 1, 9), ("c", 2, 0), ("d", 3, 1)]
    assert [r["name"] for r in layers.reorder(held, ["c", "a", "b"]).orderBy("position").collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        layers.reorder(held, ["a"])
    assert layers.set_opacity(held, "a", 1.7).filter("name = 'a'").first()["fill_opacity"] == 0.8
    assert layers.set_opacity(held, "a", 0.5).filter("name = 'a'").first()["fill_opacity"] == 0.4
    saved = spark.createDataFrame([("a", 5), ("gone", 7)], "name string, z_index long")
    assert [r["z_index"] for r in layers.restore(held, saved, ["z_index"]).orderBy("name").collect()] == [5, 0, 0]
    assert layers.remove(held, ["a"]).count() == 2


def test_radar_edges(spark):
    df = spark.createDataFrame([(0, 0, [1.0, float("nan"), float("inf"), 2.0])], "segment int, trace_no int, samples array<double>")
    assert radar.sanitise(df).first()["samples"] == [1.0, 0.0, 0.0, 2.0]
    assert radar.trace_quality(df).select("n_nan", "n_inf").first() == (1, 1)
    fine = radar.sanitise(df)
    assert len(radar.cut_samples(fine, 1.0, -1).first()["samples"]) == 3 and len(radar.cut_samples(fine, 1.0, 2.0).first()["samples"]) == 2
    assert radar.align_first_break(spark.createDataFrame([(0, 0, [0.0, 0.0, 1.0, 2.0])], df.schema), 0.1).first()["samples"] == [1.0, 2.0, 0.0, 0.0]
    assert [n for n, _ in radar.run_steps(fine, [("dc_shift", {"first": 0, "last": 3}), ("background", {})])] == ["raw", "dc_shift", "background"]
    with pytest.raises(ValueError):
        radar.run_steps(fine, [("nothing", {})])
    assert radar.gains(4, 1.0, "attenuation") == [100.0, 1.0, 0.5, pytest.approx(1 / 3)]
    assert radar.step_order(["a", "b"], ["b", "x", "a"]) == ["b", "a"]


def test_hull_mask_and_steps(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], "x double, y double")
    nodes = spark.createDataFrame([(0.2, 0.2, 1.0), (0.9, 0.9, 5.0), (0.5, 0.5, 9.0)], "x double, y double, value double")
    out = grid.masked(nodes.crossJoin(grid.hull_points(pts)), grid.inside_hull(F.col("corners")), 2.0, 8.0)
    assert sorted((r["x"], r["value"]) for r in out.collect()) == [(0.2, 2.0), (0.5, 8.0), (0.9, None)]
    assert grid.influence_radius(100, 10, 10, 0.1, 0.1) == pytest.approx(1.0)


def test_runner(spark):
    op = runner.Operator("count", lambda df: df.groupBy().count(), requires=("a",))
    held = runner.Registry()
    held.register(op)
    out = runner.run(held.get("count"), spark.createDataFrame([(1,)], "a int"))
    assert out.data.first()[0] == 1 and [e["event_type"] for e in out.events] == ["processing.started", "processing.completed"]
    with pytest.raises(runner.OperatorError, match="^count: missing column a"):
        runner.run(op, spark.createDataFrame([(1,)], "b int"))
    with pytest.raises(runner.OperatorError):
        held.get("none")
    assert runner.check_value(5, "int") == 5
    with pytest.raises(ValueError):
        runner.check_value(500, "float")
    errors, warnings = runner.check_script("import os\nclass A:\n  def name(self): eval('1')\nSCRIPT_CLASS = A", {"numpy"})
    assert errors == ["import of os is not allowed", "fewer than three of the script methods"] and warnings == ["line 3 calls eval"]


def test_nan_free_heading(spark):
    assert not math.isnan(kinematics.heading_backward(track(spark, [(0, 0), (0, 0)])).first()["heading"])
