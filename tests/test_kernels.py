"""Kernels against their plain sequential statements."""

import numpy as np
import pytest

from stratafield.operators import grid, radar, segments

RNG = np.random.default_rng(5)


def sequential_sweep(z, weight, target, omega, low, high):
    most = 0.0
    for i in range(1, z.shape[0] - 1):
        for j in range(1, z.shape[1] - 1):
            old = z[i, j]
            new = old + omega * ((z[i + 1, j] + z[i - 1, j] + z[i, j + 1] + z[i, j - 1]) / 4 - old)
            if weight[i, j] > 0.01:
                c = 0.1 * weight[i, j]
                new = new * (1 - c) + target[i, j] * c
            z[i, j] = min(high, max(low, new))
            most = max(most, abs(z[i, j] - old))
    return most


@pytest.mark.parametrize("shape", [(3, 3), (4, 9), (12, 7), (3, 15)])
def test_wavefront_equals_the_sequential_sweep(shape):
    z, w, t = RNG.normal(size=shape), RNG.random(shape), RNG.normal(size=shape)
    a, b = z.copy(), z.copy()
    assert grid.soft_sweep(a, w, t, 0.5, -1, 1) == sequential_sweep(b, w, t, 0.5, -1, 1)
    assert np.array_equal(a, b)


def test_hard_curvature_keeps_data():
    known = np.full((9, 11), np.nan)
    known[2, 3], known[6, 8] = 5.0, -2.0
    out = grid.hard_minimum_curvature(np.zeros((9, 11)), known, rounds=50)
    assert out[2, 3] == 5 and out[6, 8] == -2 and np.isfinite(out).all()


def test_soft_curvature_of_a_plane_stays_a_plane():
    gy, gx = np.mgrid[0:8, 0:9].astype(float)
    plane = 2 * gx - gy
    out = grid.soft_minimum_curvature(plane, np.ones_like(plane), plane, plane.ravel(), 20)
    assert np.allclose(out, plane)


def test_linear_grid_reproduces_a_plane_inside_the_hull():
    x, y = RNG.random(60), RNG.random(60)
    gx, gy = np.meshgrid(np.linspace(0, 1, 12), np.linspace(0, 1, 12))
    out = grid.linear_grid(x, y, 3 * x - y + 1, gx, gy)
    inside = np.isfinite(out)
    assert inside.sum() > 60 and np.allclose(out[inside], (3 * gx - gy + 1)[inside])


def test_hull_of_a_square_with_inner_points():
    x, y = np.array([0, 1, 1, 0, 0.5, 0.5]), np.array([0, 0, 1, 1, 0.5, 0])
    assert sorted(map(tuple, grid.hull(x, y).tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_vertical_derivative_of_a_wave():
    n, k = 64, 3
    wave = np.cos(2 * np.pi * k * np.arange(n) / n)[None, :].repeat(8, 0)
    assert np.allclose(grid.vertical_derivative(wave, 1.0, 1.0), 2 * np.pi * k / n * wave)


def test_gaussian_of_a_constant():
    assert np.allclose(grid.gaussian(np.full((6, 7), 2.5), 1.0), 2.5)


def test_euler_finds_a_point_source():
    gx, gy = np.meshgrid(np.arange(60.0), np.arange(60.0))
    depth, index = 6.0, 3.0
    r2 = (gx - 30) ** 2 + (gy - 31) ** 2 + depth**2
    m = r2 ** (-index / 2)
    slopes = {"d_dx": -index * (gx - 30) * r2 ** (-index / 2 - 1), "d_dy": -index * (gy - 31) * r2 ** (-index / 2 - 1), "d_dz": index * depth * r2 ** (-index / 2 - 1)}
    found = grid.euler(m, gx, gy, slopes, index, 10, "corrected")
    assert len(found) and np.allclose(np.median(found, axis=0), [30, 31, depth], atol=0.1)
    assert np.isfinite(grid.euler(m, gx, gy, slopes, index, 10)).all()


def scan_plainly(heading, speed, window, tolerance, min_length, min_rows, low, high):
    out, i = [], 0
    ok = [low <= v <= high for v in speed]
    while i < len(heading) - min_length:
        end = min(i + window, len(heading))
        if sum(ok[i:end]) < 0.5 * (end - i) or np.std(heading[i:end]) > tolerance:
            i += 1
            continue
        mean, bad, j = np.mean(heading[i:end]), 0, end
        while j < len(heading) and bad < 10:
            gap = abs(heading[j] - mean)
            bad = bad + 1 if min(gap, 360 - gap) > tolerance else 0
            bad = bad + 1 if not ok[j] else max(0, bad - 1)
            j += 1
        if j - bad - i >= min_rows:
            out.append((i, j - bad, mean))
        i = max(j - bad, i + 1)
    return out


def test_scan_of_lines():
    for _ in range(20):
        heading = np.cumsum(RNG.normal(scale=4, size=200)) % 360
        speed = RNG.uniform(0, 10, 200)
        args = (12, 9.0, 10, 15, 1.0, 9.0)
        got, want = segments.scan_line(heading, speed, *args), scan_plainly(heading, speed, *args)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_opposites():
    assert segments.pair_opposites([10, 185, 200, 95], 30) == {10: 185, 200: None, 95: None}


def test_butterworth_gain():
    for low, high, flat, gone in ((None, 0.1, 0.01, 0.4), (0.2, None, 0.4, 0.01), (0.1, 0.2, 0.1414, 0.01)):
        sections = radar.butterworth(4, low, high, 1.0)
        gain = lambda f: abs(np.prod([np.polyval(b, np.exp(2j * np.pi * f)) / np.polyval(a, np.exp(2j * np.pi * f)) for b, a in sections]))  # noqa: E731, B023
        assert gain(flat) == pytest.approx(1, abs=0.02) and gain(gone) < 0.01
        for corner in filter(None, (low, high)):
            assert gain(corner) == pytest.approx(0.5**0.5, abs=1e-6)


def test_zero_phase_keeps_a_constant_and_a_peak():
    sections = radar.butterworth(4, None, 0.1, 1.0)
    assert np.allclose(radar.zero_phase(sections, np.full((2, 80), 3.0)), 3.0)
    bump = np.exp(-((np.arange(101) - 50) ** 2) / 200)[None, :]
    assert radar.zero_phase(sections, bump).argmax() == 50


def test_savitzky_golay_keeps_a_parabola():
    x = (np.arange(40.0) ** 2)[None, :]
    assert np.allclose(radar.savitzky_golay(x, 11, 2), x)


def test_permittivity_of_its_own_reflectivity():
    for e in (5.0, 9.3, 20.0):
        r = abs((1 - e**0.5) / (1 + e**0.5))
        assert radar.permittivity(r) == pytest.approx(e, abs=0.01)
    assert radar.permittivity(1.0) == 80 and radar.permittivity(0.0) == 1
    with pytest.raises(ValueError):
        radar.permittivity(1.2)


def test_migration_collapses_a_diffraction(spark):
    dx, dt, v, n, m = 0.1, 1.0, 0.1, 41, 120
    rows = []
    for i in range(n):
        trace = np.zeros(m)
        k = round(2 * np.hypot(3.0, (i - 20) * dx) / v / dt)
        if k < m:
            trace[k] = 1.0
        rows.append((0, i, trace.tolist()))
    df = spark.createDataFrame(rows, "segment int, trace_no int, samples array<double>")
    out = np.array([r["samples"] for r in radar.migrate(df, dx, dt, v).orderBy("trace_no").collect()])
    assert np.unravel_index(out.argmax(), out.shape) == (20, 60)


def test_cubic_grid_keeps_planes_points_and_slopes():
    x, y = RNG.random(40), RNG.random(40)
    gx, gy = np.meshgrid(np.linspace(0.1, 0.9, 25), np.linspace(0.1, 0.9, 25))
    flat = grid.cubic_grid(x, y, 2 * x - 3 * y + 1, gx, gy)
    inside = np.isfinite(flat)
    assert inside.sum() > 400 and np.allclose(flat[inside], (2 * gx - 3 * gy + 1)[inside])
    z = np.sin(4 * x) * np.cos(3 * y)
    assert np.allclose(grid.cubic_grid(x, y, z, x[None], y[None])[0], z, atol=1e-7)
    line = np.linspace(0.2, 0.8, 60_001)
    walk = grid.cubic_grid(x, y, z, line[None], np.full_like(line, 0.437)[None])[0]
    slopes = np.diff(walk) / np.diff(line)
    assert np.isfinite(slopes).all() and np.abs(np.diff(slopes)).max() < 5e-3
    rough = grid.linear_grid(x, y, z, line[None], np.full_like(line, 0.437)[None])[0]
    assert np.abs(np.diff(np.diff(rough) / np.diff(line))).max() > 0.05
    truth = np.sin(4 * gx) * np.cos(3 * gy)
    error = lambda f: np.sqrt(np.nanmean((f(x, y, z, gx, gy) - truth) ** 2))
    assert error(grid.cubic_grid) < error(grid.linear_grid)


@pytest.mark.parametrize("n", [3, 4, 10, 60])
def test_triangles_cover_the_hull(n):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x, y = rng.random(n), rng.random(n)
        a, b, c = (np.column_stack([x, y])[grid.triangulate(x, y)[:, k]] for k in range(3))
        covered = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (c - a)[:, 0] * (b - a)[:, 1]).sum() / 2
        h = grid.hull(x, y)
        after = np.roll(h, -1, axis=0)
        assert covered == pytest.approx(abs((h[:, 0] * after[:, 1] - after[:, 0] * h[:, 1]).sum()) / 2, rel=1e-9)
