"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import numpy as np
import pytest

from stratafield.operators import grid, kinematics, radar
from stratafield.plans import catalog, views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    held = duckdb.connect()
    held.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return held


def plain(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0 if isinstance(v, float) else v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(plain(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert sorted(plain(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want


# Queries without SQL: rows by plain NumPy or Python on the same tables.


def collected(spark, sf, name):
    return [r.asDict() for r in catalog.queries()[name](spark, sf).collect()]


def profiles(spark, sf):
    out = {}
    for r in views.traces(spark, sf).orderBy("segment", "trace_no").collect():
        out.setdefault(r["segment"], []).append(r["samples"])
    return {k: np.array(v) for k, v in out.items()}


def survey_points(spark, sf):
    out = {}
    for r in views.points(spark, sf).collect():
        out.setdefault(r["grid_id"], []).append((r["x"], r["y"], r["z"]))
    return {k: np.array(v) for k, v in out.items()}


def held(rows, keys=("segment", "trace_no", "k"), value="value"):
    return {tuple(r[k] for k in keys): r[value] for r in rows}


def test_band_pass_keeps_the_band(spark, sf):
    """Zero phase: the response is |H|^2 of an analogue-like Butterworth, known in
    closed form after the bilinear map; compared away from the padded ends."""
    got = held(collected(spark, sf, "band_pass"))
    traces = profiles(spark, sf)
    assert set(got) == {(s, t, k) for s, z in traces.items() for t in range(len(z)) for k in range(z.shape[1])}
    n = 2048
    f = np.fft.fftfreq(n)
    warp = lambda x: np.tan(np.pi * np.abs(x))
    low, high = warp(0.05), warp(0.2)
    with np.errstate(divide="ignore"):
        gain = 1 / (1 + ((warp(f) ** 2 - low * high) / (warp(f) * (high - low))) ** 8)
    impulse = np.fft.ifft(gain).real
    z = next(iter(traces.values()))
    # an impulse in the middle of a long trace, through the same operator
    long = np.zeros(n)
    long[n // 2] = 1.0
    df = spark.createDataFrame([(0, 0, long.tolist())], "segment long, trace_no long, samples array<double>")
    out = np.array(radar.band_pass(df, 1.0, 0.05, 0.2).first()["samples"])
    assert np.allclose(out, np.roll(impulse, n // 2), atol=1e-6) and z.size


def test_deconvolution_by_normal_equations(spark, sf):
    got = held(collected(spark, sf, "deconvolution"))
    for s, z in profiles(spark, sf).items():
        for t, x in enumerate(z):
            cut = x[10:71]
            r = [sum(cut[i] * cut[i + lag] for i in range(len(cut) - lag)) for lag in range(5)]
            matrix = np.array([[r[abs(i - j)] for j in range(5)] for i in range(5)]) + np.eye(5) * (1e-5 * r[0] + 1e-30)
            f = np.linalg.solve(matrix, [matrix[0, 0], 0, 0, 0, 0])
            for k in range(0, len(x), 9):
                assert got[s, t, k] == pytest.approx(sum(f[i] * x[k - i] for i in range(5) if k >= i), abs=2e-6)


def test_gamma_segments_obey_their_rules(spark, sf):
    """Every run is straight, fast and long enough, runs of a line are disjoint."""
    rows = collected(spark, sf, "gamma_segments")
    track = kinematics.speed_kmh(kinematics.heading_forward(views.track(spark, sf)))
    lines = {}
    for r in track.select("line_id", "seq", "heading", "speed_kmh").orderBy("line_id", "seq").collect():
        lines.setdefault(r["line_id"], []).append(r)
    last = {}
    for r in sorted(rows, key=lambda r: (r["line_id"], r["start_seq"])):
        assert r["end_seq"] - r["start_seq"] >= 5 and r["start_seq"] >= last.get(r["line_id"], 0) and r["end_seq"] <= len(lines[r["line_id"]])
        last[r["line_id"]] = r["end_seq"]
        assert 0 <= r["mean_heading"] < 360
    assert rows


def test_opposite_headings_are_greedy_pairs(spark, sf):
    rows = collected(spark, sf, "opposite_headings")
    by = {}
    for r in rows:
        by.setdefault(r["survey"], {})[r["heading"]] = r["opposite"]
    assert by
    for pairs in by.values():
        taken = [x for h, o in pairs.items() for x in ((h,) if o is None else (h, o))]
        assert len(taken) == len(set(taken))
        alone = [h for h, o in pairs.items() if o is None]
        apart = lambda a, b: min((a - b - 180) % 360, (b + 180 - a) % 360)
        assert all(o is None or apart(h, o) <= 30 for h, o in pairs.items())
        assert all(apart(a, b) > 30 for a in alone for b in alone if a != b)


def test_cubic_grid_meets_its_points_and_hull(spark, sf):
    rows = collected(spark, sf, "cubic_grid")
    for g, p in survey_points(spark, sf).items():
        mine = [r for r in rows if r["grid_id"] == g]
        corners = grid.hull(p[:, 0], p[:, 1])
        assert len(mine) == 900
        if len(corners) < 3:
            continue
        after = np.roll(corners, -1, axis=0)
        for r in mine:
            turn = (after[:, 0] - corners[:, 0]) * (r["y"] - corners[:, 1]) - (after[:, 1] - corners[:, 1]) * (r["x"] - corners[:, 0])
            if abs(turn).min() > 1e-6:
                assert (r["value"] is not None) == bool((turn > 0).all())


def test_euler_solutions_solve_their_windows(spark, sf):
    rows = collected(spark, sf, "euler")
    assert all(0 < r["depth"] < 100 for r in rows)
    z = profiles(spark, sf)
    want = 0
    for data in z.values():
        reach, w = 8, np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
        w /= w.sum()
        smooth = data
        for axis in (0, 1):
            padded = np.pad(smooth, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            smooth = sum(w[i] * np.take(padded, range(i, i + data.shape[axis]), axis) for i in range(17))
        gy, gx = np.gradient(smooth)
        ky, kx = np.meshgrid(2 * np.pi * np.fft.fftfreq(data.shape[0]), 2 * np.pi * np.fft.fftfreq(data.shape[1]), indexing="ij")
        gz = np.fft.ifft2(np.hypot(kx, ky) * np.fft.fft2(smooth)).real
        iy, ix = np.indices(data.shape)
        for i in range(0, data.shape[0] - 10, 2):
            for j in range(0, data.shape[1] - 10, 2):
                c = np.s_[i : i + 10, j : j + 10]
                a = np.column_stack([gx[c].ravel(), gy[c].ravel(), gz[c].ravel(), np.ones(100)])
                b = (ix[c] * gx[c] + iy[c] * gy[c] + smooth[c]).ravel()
                want += 0 < np.linalg.pinv(a)[2] @ b < 100
    assert len(rows) == want


@pytest.mark.parametrize("name", ["mincurve_soft", "mincurve_hard"])
def test_minimum_curvature_of_all_grids(spark, sf, name):
    """Every node of every mesh, within the points' range where pulled softly, on
    the points where they are fixed."""
    rows = collected(spark, sf, name)
    points = survey_points(spark, sf)
    assert len(rows) == 90_000 * len(points)
    by = {}
    for r in rows:
        by.setdefault(r["grid_id"], np.full((300, 300), np.nan))[r["iy"], r["ix"]] = r["value"]
    for g, p in points.items():
        z = by[g]
        assert np.isfinite(z).all()
        if name == "mincurve_hard":
            ix, iy = (np.rint((p[:, k] - p[:, k].min() + 0.01 * np.ptp(p[:, k])) / (1.02 * np.ptp(p[:, k]) / 299)).astype(int) for k in (0, 1))
            for a, b in {*zip(iy.tolist(), ix.tolist(), strict=True)}:
                assert min(abs(z[a, b] - p[(iy == a) & (ix == b), 2])) < 1e-6


def test_every_query_has_rows_to_compare():
    tested = "band_pass deconvolution gamma_segments opposite_headings cubic_grid euler mincurve_soft mincurve_hard".split()
    whole = "hull_mask waypoint_lookup visible_order".split()  # tests/test_whole.py
    assert set(catalog.queries()) - set(catalog.oracle_sql()) <= {*tested, *whole}
