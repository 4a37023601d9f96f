import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafield.operators import radar, runner, survey
from stratafield.plans import scripts, views
from stratafield.sources import store


def run(name, df, params=None):
    return runner.run(scripts.REGISTRY.get(name), df, params)


def square_flight(spark, legs=4, n=120):
    rows, x, y, seq = [], 0.0, 0.0, 0
    for leg in range(legs):
        dx, dy = [(0, 1), (1, 0), (0, -1), (1, 0)][leg % 4]
        for _ in range(n if dy else 10):
            rows.append((1, seq, seq * 1000, x, y))
            x, y, seq = x + dx, y + dy, seq + 1
    return spark.createDataFrame(rows, "line_id long, seq long, t_ms long, easting double, northing double")


def test_magnetic_lines_of_a_lawnmower_flight(spark):
    p = scripts.SegmenterParams(5, 5, 5.0, 10, 50, 3.0, 20, 0.5, True, 30.0)
    out = run("flight_path_segmenter", square_flight(spark), p)
    stats = {r["direction"]: r["n_points"] for r in out.tables["statistics"].collect()}
    assert set(stats) == {"Combined_0_180"} and 150 < stats["Combined_0_180"] <= 240
    p.combine_opposite_headings = False
    assert {r["direction"] for r in run("flight_path_segmenter", square_flight(spark), p).data.select("direction").distinct().collect()} == {"Heading_0", "Heading_180"}


def test_gamma_lines(spark):
    p = scripts.GammaSegmenterParams(3, 20, 15.0, 10, 50, 0.1, 300.0, 5)
    out = run("gamma_segmenter", square_flight(spark), p)
    rows = out.tables["segments"].orderBy("start_seq").collect()
    assert len(rows) >= 1 and all(r["end_seq"] - r["start_seq"] >= 50 for r in rows)
    assert out.tables["speed"].first()["max_kmh"] == pytest.approx(3.6)


def test_magbase(spark, sf):
    walk = views.walk(spark, sf).withColumns({f"b{a}{n}": F.col(f"b{a}") for a in "xyz" for n in (1, 2)}).drop("bx", "by", "bz")
    base = views.track(spark, sf).filter("event_type = 'error'").select("t_ms", F.col("field").alias("nT"))
    out = run("magbase", walk, scripts.MagbaseParams(base=base, vertical_alignment=True)).data
    row = out.filter("va IS NOT NULL").first()
    assert row["va"] == pytest.approx(row["btotal1"] - row["btotal2"]) and row["r1"] == pytest.approx(row["btotal1"] - row["base_nT"])
    assert row["utm_northing2"] - row["utm_northing1"] == pytest.approx(1.12)
    assert "va" not in run("magbase", walk, scripts.MagbaseParams(base=base)).data.columns
    assert run("magbase", walk, scripts.MagbaseParams(sampling="downsample", vertical_alignment=True)).data.filter("lat IS NULL").count() == 0


def test_grids(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x), float(y), float(g + x)) for g in (1, 2) for x, y in rng.random((40, 2))]
    pts = spark.createDataFrame(rows, "grid_id long, x double, y double, z double")
    for name, params in (("grid_interpolator", scripts.GridParams(12, 60, soft=False)), ("gamma_interpolator", scripts.GammaGridParams(12, 60)), ("grid_interpolator", scripts.GridParams(12, 60, boundary="alpha_shape"))):
        out = run(name, pts, params)
        cells = out.data.toPandas()
        assert len(cells) == 2 * 144 and cells["value"].notna().any()
        known = cells[cells["value"].notna()]
        assert np.abs(known["value"] - known["grid_id"] - known["x"]).median() < 0.2
    derived = run("anomaly_processor", out.data.select("grid_id", "iy", "ix", "value"), scripts.AnomalyParams(window=4))
    assert derived.data.filter("analytic_signal IS NOT NULL").count() > 0 and derived.tables["euler"].count() >= 0


def test_other_scripts(spark, sf):
    track = views.track(spark, sf)
    assert run("path_visualizer", track).data.count() == track.select("line_id").distinct().count()
    assert run("statistical_anomaly", track).data.filter("is_anomaly").count() > 0
    out = run("multispectral", views.bands(spark, sf), scripts.MultispectralParams())
    assert out.tables["counts"].first()["n_anomalies"] > 0 and "ndvi" in out.data.columns
    traces = views.traces(spark, sf)
    done = run("radar_segment", traces, scripts.RadarParams(dt_ns=1.0, low_ghz=0.05, high_ghz=0.2))
    assert done.data.count() == traces.count() and "3_band_pass" in done.tables
    assert run("radar_trace", traces, scripts.RadarTraceParams(dt_ns=1.0, low_ghz=0.05, high_ghz=0.2, segment=99, trace=1)).data.count() == 1


def test_radar_survey(spark):
    places = spark.createDataFrame([(float(t), 60.0 + t * 1e-5, 10.0, float(t)) for t in range(60)], "t_s double, lat double, lon double, trace_no double")
    marks = spark.createDataFrame([(1, 0.0), (1, 30.0)], "survey_no int, t_s double")
    traces = spark.createDataFrame([(0, t, [float(t)] * 8) for t in range(60)], "segment int, trace_no long, samples array<double>")
    out = run("radar_preprocessor", traces, scripts.RadarSurveyParams(0.5, 4.0, 1.0, positions=places, waypoints=marks)).data
    rows = out.orderBy("segment", "trace_no").collect()
    assert {r["segment"] for r in rows} == {0, 1} and len(rows[0]["samples"]) == 4
    steps = [b["dist_m"] - a["dist_m"] for a, b in zip(rows, rows[1:], strict=False) if a["segment"] == b["segment"]]
    assert steps == pytest.approx([0.5] * len(steps))


def test_survey_helpers(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (5.0, 5.0), (5.0, 5.0)], "x double, y double")
    assert survey.spacing_threshold(pts, 2.0) == 2.0 and survey.spacing_threshold(pts.limit(0), 2.0) == 0.01
    z = np.array([[0.0, 1.0, 2.0], [1.0, np.nan, 3.0], [2.0, 3.0, 4.0]])
    assert survey.fill_holes(z)[1, 1] == pytest.approx(2.0) and np.isnan(survey.fill_holes(np.full((2, 2), np.nan))).all()
    t = spark.createDataFrame([(1, 0, 5.25, "09:05:05.250", "d"), (1, 1, 65.5, None, None), (1, 2, 66.0, "09:06:06.000", "d"), (1, 3, 67.0, None, None)], "line_id long, seq long, num double, text string, day string")
    assert [(r["text"], r["day"]) for r in survey.fill_times(t, "num", "text", "day").orderBy("seq").collect()] == [("09:05:05.250", "d"), ("09:05:05.500", "d"), ("09:06:06.000", "d"), (None, None)]
    shown = spark.createDataFrame([(1234.56789,), (0.0,), (None,), (float("nan"),)], "v double").select(survey.cell_text(F.col("v"), True)).collect()
    assert [r[0] for r in shown] == ["1234.57", "0", "NaN", "NaN"]
    assert survey.style_overrides({"size": 3, "nothing": 1}) == {"point_size": 3}
    assert radar.power_then_exponential(2, 1.0, 1.0, 0.1, 10.0, 3.0)[1] == pytest.approx(3 * math.exp(0.1))


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "a int, b double")
    entry = store.save_layer(df, str(tmp_path), "l1", group="x")
    assert store.load_layer(spark, str(tmp_path), entry, verify=True).count() == 2
    with pytest.raises(ValueError):
        store.load_layer(spark, str(tmp_path), entry | {"checksum": "0"}, verify=True)
    with pytest.raises(store.UnsupportedFormat):
        store.load_layer(spark, str(tmp_path), entry | {"data": "x.pkl"})
    store.save_bundle(str(tmp_path / "b.zip"), str(tmp_path), {"name": "p"}, {}, {"zoom": 3}, [entry])
    parts = store.load_bundle(str(tmp_path / "b.zip"), str(tmp_path / "out"))
    assert parts["metadata.json"] == {"version": "1.0", "name": "p"}
    assert store.load_layer(spark, str(tmp_path / "out"), parts["layers/layer_registry.json"][0], verify=True).count() == 2
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.json", "{}")
    with pytest.raises(ValueError):
        store.load_bundle(str(tmp_path / "bad.zip"), str(tmp_path / "bad"))
    text = store.config_json(scripts.RadarParams(dt_ns=1.0))
    assert store.config_from_json(scripts.RadarParams, text) == scripts.RadarParams(dt_ns=1.0) and json.loads(text)["order"] == 4
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "a.py").write_text("import os\nclass A:\n  def f(self): pass\n")
    (tmp_path / "a.txt").write_text("1;2;3\n")
    assert store.describe_file(str(tmp_path / "a.json"))["items"] == 1 and store.describe_file(str(tmp_path / "a.py"))["functions"] == 1
    assert store.describe_file(str(tmp_path / "a.txt")) == {"delimiter": ";", "numeric": True}
