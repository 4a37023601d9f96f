"""Registered queries give all rows of the whole tables, by brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafield.operators import grid
from stratafield.plans import catalog, scripts, views


def got(spark, sf, name):
    return [tuple(r) for r in catalog.queries()[name](spark, sf).collect()]


def read(sf, text):
    return duckdb.execute(text.replace("{sf}", sf)).fetchall()


def test_every_waypoint_has_its_row(spark, sf):
    every = read(sf, "SELECT event_id, event_type, epoch_us(ts) // 1000 FROM '{sf}/events.parquet'")
    rows = [(t, i) for i, kind, t in every if kind == "error"]
    want = {(i, min(rows, key=lambda r: (abs(r[0] - t), *r))[1]) for i, kind, t in every if kind == "signup"}
    assert sorted(got(spark, sf, "waypoint_lookup")) == sorted(want)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_all_visible_layers_are_numbered(spark, sf, scale):
    sf = sf.replace("sf0.001", scale)
    keys = sorted((k % 7, k) for (k,) in read(sf, "SELECT o_orderkey FROM '{sf}/orders.parquet'") if k % 3)
    assert sorted(got(spark, sf, "visible_order")) == sorted((k, n) for n, (_, k) in enumerate(keys, 1))


def test_hull_mask_of_all_nodes(spark, sf):
    p = np.array(read(sf, "SELECT c_custkey * 7919 % 1000 / 1000, c_custkey * 104729 % 1000 / 1000 FROM '{sf}/customer.parquet'"))
    side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    ways = side(p[:, None, None], p[None, :, None], p[None, None])
    edges = [(p[i], p[j]) for i, j in np.argwhere((ways >= -1e-12).all(2)) if (p[i] != p[j]).any()]
    want = {(iy, ix, all(side(a, b, np.array([ix / 39, iy / 39])) >= -1e-12 for a, b in edges)) for iy in range(40) for ix in range(40)}
    assert set(got(spark, sf, "hull_mask")) == want
    assert {inside for _, _, inside in want} == {True, False}


@pytest.mark.parametrize("far", [0.2, 40.0])
def test_nearest_points_at_any_distance(spark, far):
    rng = np.random.default_rng(3)
    points = np.round(np.vstack([rng.normal(-far, 0.01, (150, 2)), rng.normal((far, far / 3), 0.01, (150, 2)), [[0.03, 0.01]]]), 4)
    held = [(float(x), float(y), float(z)) for z, (x, y) in enumerate(points)]
    nodes = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-far, far, (40, 2)))]
    places = spark.createDataFrame(nodes, "id long, x double, y double")
    out = grid.nearest_points(places, spark.createDataFrame(held, "x double, y double, z double"), 0.001, 2).collect()
    want = {k: min((float(np.hypot(x - px, y - py)), z) for px, py, z in held) for k, x, y in nodes}
    assert len(out) == len(want) and all((r["d"], r["z"]) == (pytest.approx(want[r["id"]][0], abs=1e-9), want[r["id"]][1]) for r in out)
    none = grid.nearest_points(places, spark.createDataFrame([], "x double, y double, z double"), 0.001, 2).collect()
    assert sorted(tuple(r) for r in none) == [(*n, None, None) for n in nodes]


def test_visible_bounds_by_the_layers(spark, sf):
    lines = read(sf, """SELECT user_id, min(500000 + 10 * n + k / 10), max(500000 + 10 * n + k / 10) FROM (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM '{sf}/events.parquet') GROUP BY user_id""")
    shown = {r["position"] for r in views.layers(spark, sf).collect() if r["is_visible"]}
    kept = [r for r in lines if r[0] in shown]
    assert got(spark, sf, "visible_bounds") == [pytest.approx((min(r[1] for r in kept), max(r[2] for r in kept)), abs=1e-5)]
    assert any(r[0] % 2 for r in kept)


@pytest.mark.parametrize("name, soft", [("mincurve_soft", True), ("mincurve_hard", False)])
def test_curvature_grids_have_the_default_mesh(spark, sf, monkeypatch, name, soft):
    asked = []
    monkeypatch.setattr(grid, "minimum_curvature", lambda points, *args: asked.append(args) or views.grid(spark, sf).withColumns({"x": F.lit(0.0), "y": F.lit(0.0)}))
    catalog.queries()[name](spark, sf)
    assert asked == [(scripts.GridParams.nodes, scripts.GridParams.nodes, soft, scripts.GridParams.iterations)]


def test_row_ids_of_a_file_of_many_splits(spark, tmp_path):
    """Dense in file order, whatever the splits and partitions."""
    from stratafield.operators import tables
    from stratafield.sources import delimited

    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(2):
        lines = ["date: 2020-01-01", "", "Timestamp [ms];a;b;c"] + [f"{part * 50_000 + i};{i % 7};{'x' * 20};{i}" + "\n" * (i % 1000 == 0) for i in range(50_000)]
        (folder / f"{part}.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150000")
    try:
        table, meta = delimited.load(spark, str(folder))
        rows = table.select("_row_id", F.col("`Timestamp [ms]`").cast("long").alias("t")).collect()
        assert table.rdd.getNumPartitions() > 4 and meta["date"] == "2020-01-01"
        assert len(rows) == 100_000 and all(r["_row_id"] == r["t"] for r in rows)
        assert tables.row_range(table, "_row_id", 99_998, 100_005).count() == 2
        assert tables.every_kth(table, "_row_id", 1000).count() == 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_masks_stay_within_their_grid(spark):
    """Two surveys side by side: neither hull nor points of one mask the other."""
    from stratafield.operators import survey

    points = spark.createDataFrame([(g, 10.0 * g + x, y, 1.0 + x + y) for g in (0, 1) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.3, 0.3), (0.2, 0.6))], "grid_id long, x double, y double, z double")
    hulls = {r["grid_id"]: r["corners"] for r in grid.hull_points(points, "grid_id").collect()}
    assert sorted(hulls[1]) == [[10.0, 0.0], [10.0, 1.0], [11.0, 0.0]] and len(hulls) == 2
    out = scripts.grid_interpolator(points, scripts.GridParams(nodes=12, iterations=20)).data.collect()
    for r in out:
        inside = r["x"] - 10 * r["grid_id"] >= -1e-9 and r["y"] >= -1e-9 and r["x"] - 10 * r["grid_id"] + r["y"] <= 1 + 1e-9
        assert (r["value"] is not None) == inside
    nodes = spark.createDataFrame([(0, 10.0, 0.0), (1, 10.0, 0.0)], "grid_id long, x double, y double")
    assert [r["grid_id"] for r in survey.near_points(nodes, points, 0.1).collect()] == [1]


def test_spacing_of_far_places(spark):
    from stratafield.operators import survey

    for places in ([(0.0, 0.0), (100.0, 0.0), (0.0, 250.0)], [(0.0, 0.0), (0.5, 0.0), (40.0, 40.0), (41.0, 40.0), (90.0, 3.0)]):
        each = sorted(min(np.hypot(a - x, b - y) for x, y in places if (x, y) != (a, b)) for a, b in places)
        df = spark.createDataFrame(places, "x double, y double")
        assert survey.spacing_threshold(df, 1.0) == pytest.approx(2 * np.median(each))
    assert survey.spacing_threshold(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), 1.0, 0.3) == 0.3
