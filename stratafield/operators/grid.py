"""Gridding and potential-field operators.

A grid is long: (grid_id, iy, ix, x, y, value), null where masked.  What is
local is a join or a window; what iterates over a whole grid runs as one NumPy
kernel per grid_id, so grids are handled in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

CELLS = "iy int, ix int, value double"


def mesh(extent: DataFrame, nx: int, ny: int, pad: float = 0.01) -> DataFrame:
    """Nodes of an evenly spaced mesh over bounds widened by ``pad`` of their
    range; one row of bounds per grid."""
    rx, ry = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    wide = extent.withColumns({"_x0": F.col("min_x") - pad * rx, "_y0": F.col("min_y") - pad * ry, "_dx": rx * (1 + 2 * pad) / (nx - 1), "_dy": ry * (1 + 2 * pad) / (ny - 1)})
    rows = wide.withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    return rows.select(*[c for c in extent.columns if c not in ("min_x", "min_y", "max_x", "max_y")], "iy", "ix", (F.col("_x0") + F.col("ix") * F.col("_dx")).alias("x"), (F.col("_y0") + F.col("iy") * F.col("_dy")).alias("y"))


def influence_radius(n: int, x_range: float, y_range: float, dx: float, dy: float) -> float:
    """max(2 dx, 2 dy, mean spacing), at most a tenth of the smaller range."""
    return min(max(2 * dx, 2 * dy, (x_range * y_range / n) ** 0.5), 0.1 * min(x_range, y_range))


def influence(points: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, radius: float) -> DataFrame:
    """Gaussian weights and weighted targets of the nodes within ``radius`` of a
    point: every point visits its own window of nodes and the sums combine
    before the shuffle."""
    gi, gj = (F.col("y") - y0) / dy, (F.col("x") - x0) / dx
    span = lambda g, r, n: F.sequence(F.greatest(F.lit(0), F.ceil(g - r).cast("int")), F.least(F.lit(n - 1), F.floor(g + r).cast("int")))
    inside = (gi + radius / dy >= 0) & (gi - radius / dy <= ny - 1) & (gj + radius / dx >= 0) & (gj - radius / dx <= nx - 1)
    seen = points.filter(inside).withColumn("iy", F.explode(span(gi, radius / dy, ny))).withColumn("ix", F.explode(span(gj, radius / dx, nx)))
    d = F.hypot(F.col("x") - (x0 + F.col("ix") * dx), F.col("y") - (y0 + F.col("iy") * dy))
    w = F.exp(-F.pow(d / (0.3 * radius), 2))
    near = seen.filter(F.col("iy").between(0, ny - 1) & F.col("ix").between(0, nx - 1) & (d <= radius))
    return near.groupBy("iy", "ix").agg(F.sum(w).alias("weight"), (F.sum(w * F.col("z")) / F.sum(w)).alias("target"))


def nearest_points(nodes: DataFrame, points: DataFrame, cell: float, most_rings: int = 24) -> DataFrame:
    """Each node with the nearest point (distance, value; smallest value on
    ties).  Points are hashed to square cells; a node looks at the rings of
    cells around its own, doubling until nothing nearer can lie outside.  Nodes
    that are not sure within ``most_rings`` go by ``nearest_far``; without any
    point, distance and value are null."""
    key = lambda v: F.floor(F.col(v) / cell).cast("long")
    hashed = points.select(key("x").alias("cx"), key("y").alias("cy"), F.col("x").alias("px"), F.col("y").alias("py"), "z")
    keys = [c for c in nodes.columns if c not in ("x", "y")]
    waiting, done, ring = nodes, None, 1
    while True:
        reach = F.sequence(F.lit(-ring), F.lit(ring))
        looks = waiting.withColumn("_i", F.explode(reach)).withColumn("_j", F.explode(reach)).withColumns({"cx": key("x") + F.col("_i"), "cy": key("y") + F.col("_j")})
        best = _best(looks.join(hashed, ["cx", "cy"], "inner"), keys)
        sure = best.filter(F.col("d") <= ring * cell)
        done = sure if done is None else done.unionByName(sure)
        waiting = waiting.join(sure.select(*keys), keys, "left_anti")
        if waiting.isEmpty():
            return done
        if ring >= most_rings:
            break
        ring *= 2
    far = nearest_far(waiting, hashed, cell)
    alone = waiting.join(far.select(*keys), keys, "left_anti").select(*keys, "x", "y", F.lit(None).cast("double").alias("d"), F.lit(None).cast(points.schema["z"].dataType).alias("z"))
    return done.unionByName(far).unionByName(alone)


def _best(met: DataFrame, keys: list[str]) -> DataFrame:
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    return met.groupBy(*keys, "x", "y").agg(F.min(F.struct(d.alias("d"), F.col("z").alias("z"))).alias("b")).select(*keys, "x", "y", "b.d", "b.z")


def nearest_far(nodes: DataFrame, hashed: DataFrame, cell: float, fan: int = 8) -> DataFrame:
    """``nearest_points`` at any distance: from the few cells that hold all
    points down to ``cell``, ``fan`` times smaller at each level, a node keeps
    the occupied cells that can hold its nearest point."""
    keys = [c for c in nodes.columns if c not in ("x", "y")]
    occupied = hashed.select("cx", "cy").na.drop().distinct()
    ends = occupied.agg(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).first()  # one row
    levels = 0
    while fan**levels <= max(x or 0 for x in ends):
        levels += 1
    up = lambda level, *names: [F.floor(F.col(f"c{a}") / fan**level).cast("long").alias(f"{b}{a}") for b in names for a in "xy"]
    kept = None
    for level in range(levels, -1, -1):
        size = cell * fan**level
        cells = occupied.select(*up(level, "c"), *up(level + 1, "p")).distinct() if level < levels else occupied.select(*up(level, "c")).distinct()
        seen = nodes.crossJoin(F.broadcast(cells)) if kept is None else kept.join(cells, ["px", "py"])  # four cells at most
        low = [F.greatest(F.col(f"c{a}") * size - F.col(a), F.col(a) - (F.col(f"c{a}") + 1) * size, F.lit(0.0)) for a in "xy"]
        high = [F.greatest(F.abs(F.col(a) - F.col(f"c{a}") * size), F.abs(F.col(a) - (F.col(f"c{a}") + 1) * size)) for a in "xy"]
        bounds = seen.withColumns({"_low": F.hypot(*low), "_most": F.min(F.hypot(*high)).over(Window.partitionBy(*keys))})
        # a part in 1e9 more, for points that rounding put into the next cell
        kept = bounds.filter(F.col("_low") <= F.col("_most") * (1 + 1e-9) + cell * 1e-9).select(*keys, "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py"))
    return _best(kept.withColumnsRenamed({"px": "cx", "py": "cy"}).join(hashed, ["cx", "cy"]), keys)


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chain, counter-clockwise."""
    points = np.unique(np.column_stack([x, y]), axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(p - out[-1], 0))[2] <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def hull_points(points: DataFrame, by: str | None = None) -> DataFrame:
    """One row per value of ``by`` (one row without it) with the hull's corners
    (array of x, y; counter-clockwise).  A task reduces its rows to one hull per
    value, only these corners are shuffled."""
    keyed = points.na.drop(subset=["x", "y"]).select((F.col(by) if by else F.lit(0)).alias("hull_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = keyed.schema["hull_id"].dataType.simpleString()

    def reduce(frames):
        held: dict = {}
        for frame in frames:
            for key, rows in frame.groupby("hull_id"):
                here = rows[["x", "y"]].to_numpy()
                here = np.vstack([held[key], here]) if key in held else here
                held[key] = hull(here[:, 0], here[:, 1])
        for key, corners in held.items():
            yield pd.DataFrame({"hull_id": key, "x": corners[:, 0], "y": corners[:, 1]})

    def join(key, rows):
        corners = hull(rows["x"].to_numpy(), rows["y"].to_numpy())
        return pd.DataFrame({"hull_id": [key[0]], "corners": [corners.tolist()]})

    found = keyed.mapInPandas(reduce, f"hull_id {kind}, x double, y double").groupBy("hull_id").applyInPandas(join, f"hull_id {kind}, corners array<array<double>>")
    return found.withColumnRenamed("hull_id", by) if by else found.drop("hull_id")


def inside_hull(corners: Column) -> Column:
    """Whether (x, y) lies in the hull or on its border; true where there is none
    or it has fewer than three corners."""
    after = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    turns = F.zip_with(corners, after, lambda p, q: (q[0] - p[0]) * (F.col("y") - p[1]) - (q[1] - p[1]) * (F.col("x") - p[0]))
    return F.when(corners.isNull() | (F.size(corners) < 3), True).otherwise(F.forall(turns, lambda t: t >= -1e-12))


def masked(grid: DataFrame, mask: Column, low: float | None = None, high: float | None = None) -> DataFrame:
    value = F.col("value")
    if low is not None:
        value = F.greatest(F.lit(low), value)
    if high is not None:
        value = F.least(F.lit(high), value)
    return grid.withColumn("value", F.when(mask & F.col("value").isNotNull(), value))


def along_row():
    return Window.partitionBy("grid_id", "iy").orderBy("ix")


def along_column():
    return Window.partitionBy("grid_id", "ix").orderBy("iy")


def _slope(window, step: float) -> Column:
    back, ahead, here = F.lag("value").over(window), F.lead("value").over(window), F.col("value")
    first, last = F.row_number().over(window) == 1, F.lead("ix").over(window).isNull()
    return F.when(first, (ahead - here) / step).when(last, (here - back) / step).otherwise((ahead - back) / (2 * step))


def horizontal_derivatives(grid: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """d_dx, d_dy (central, one-sided at the borders) and their length."""
    out = grid.withColumns({"d_dx": _slope(along_row(), dx), "d_dy": _slope(along_column(), dy)})
    return out.withColumn("horizontal_gradient", F.hypot("d_dx", "d_dy"))


def signals(grid: DataFrame) -> DataFrame:
    """Analytic signal and tilt of d_dx, d_dy, d_dz."""
    h2 = F.col("d_dx") ** 2 + F.col("d_dy") ** 2
    return grid.withColumns({"analytic_signal": F.sqrt(h2 + F.col("d_dz") ** 2), "tilt": F.atan2("d_dz", F.sqrt(h2) + 1e-10)})


def gradient_peaks(grid: DataFrame, column: str = "horizontal_gradient") -> DataFrame:
    """Nodes that are the largest of their 3 x 3 surroundings and above the mean
    of the grid: two one-dimensional windows."""
    across = grid.withColumn("_r", F.max(column).over(along_row().rowsBetween(-1, 1)))
    around = across.withColumn("_m", F.max("_r").over(along_column().rowsBetween(-1, 1)))
    mean = grid.groupBy("grid_id").agg(F.avg(column).alias("_mean"))
    return around.join(mean, "grid_id").filter((F.col(column) == F.col("_m")) & (F.col(column) > F.col("_mean"))).drop("_r", "_m", "_mean")


def grid_pivot(points: DataFrame) -> DataFrame:
    """Mean per (lat, lon) with the ranks of the sorted axes: axis values are
    ranked among their distinct values only."""
    cells = points.groupBy("lat", "lon").agg(F.avg("value").alias("value"))
    rank = lambda c, out: cells.select(c).distinct().select(c, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c)) - 1).alias(out))  # noqa: E731  one row per axis value
    return cells.join(rank("lat", "iy"), "lat").join(rank("lon", "ix"), "lon")


def residual_metrics(df: DataFrame, observed: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    r = F.col(observed) - F.col(predicted)
    return df.groupBy(*(by or [])).agg(F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.pow(F.corr(observed, predicted), 2).alias("r2"), F.avg(r).alias("mean_residual"), F.stddev_pop(r).alias("std_residual"), F.count(r).alias("n"))


def grid_statistics(grid: DataFrame) -> DataFrame:
    return grid.groupBy("grid_id").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.median("value").alias("median"), F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))


def normalised(grid: DataFrame) -> DataFrame:
    """0 to 1 per grid (a flat grid is 0), rows counted from the north."""
    whole = Window.partitionBy("grid_id")
    low, high = F.min("value").over(whole), F.max("value").over(whole)
    return grid.withColumns({"level": F.when(F.col("value").isNotNull(), F.coalesce(F.try_divide(F.col("value") - low, high - low), F.lit(0.0))), "row_from_north": F.max("iy").over(whole) - F.col("iy")})


def contour_cells(grid: DataFrame, levels: int = 11) -> DataFrame:
    """Cells whose edge to the right or upper neighbour is crossed by one of
    ``levels`` even levels; the highest crossing level is kept."""
    whole = Window.partitionBy("grid_id")
    wide = grid.withColumns({"_lo": F.min("value").over(whole), "_hi": F.max("value").over(whole), "_e": F.lead("value").over(along_row()), "_n": F.lead("value").over(along_column())})
    step = (F.col("_hi") - F.col("_lo")) / (levels - 1)
    (ea, eb), (na, nb) = _levels("_e", step), _levels("_n", step)
    level = F.greatest(F.when(ea > eb, ea), F.when(na > nb, na))
    return wide.withColumn("level_no", level).filter("level_no IS NOT NULL").drop("_lo", "_hi", "_e", "_n")


def _levels(other: str, step: Column) -> tuple[Column, Column]:
    above = lambda v: F.floor((v - F.col("_lo")) / step)
    known = F.col("value").isNotNull() & F.col(other).isNotNull() & (step > 0)
    return F.when(known, above(F.greatest("value", other))), F.when(known, above(F.least("value", other)))


# kernels


def spread(table: DataFrame, key: str = "grid_id") -> DataFrame:
    """Groups dealt to all partitions: a small table of large groups would else
    be coalesced into one task."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), key)


def per_grid(grid: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], columns: list[str]) -> DataFrame:
    """Run a kernel over each grid as a dense array (nan where masked or absent)."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        dense = np.full((cells["iy"].max() + 1, cells["ix"].max() + 1), np.nan)
        dense[cells["iy"], cells["ix"]] = cells["value"].astype(float)
        out = kernel(dense)
        iy, ix = np.indices(dense.shape)
        frame = pd.DataFrame({"grid_id": cells["grid_id"].iloc[0], "iy": iy.ravel(), "ix": ix.ravel()})
        for c in columns:
            frame[c] = [None if np.isnan(v) else v for v in out[c].ravel()]
        return frame

    kind = grid.schema["grid_id"].dataType.simpleString()
    return spread(grid.select("grid_id", "iy", "ix", "value")).groupBy("grid_id").applyInPandas(run, f"grid_id {kind}, iy int, ix int, " + ", ".join(f"{c} double" for c in columns))


def vertical_derivative(z: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """Spectral first vertical derivative; masked nodes count as the mean."""
    filled = np.where(np.isnan(z), np.nanmean(z), z)
    ky, kx = 2 * np.pi * np.fft.fftfreq(z.shape[0], dy), 2 * np.pi * np.fft.fftfreq(z.shape[1], dx)
    k = np.hypot(ky[:, None], kx[None, :])
    k[0, 0] = 1e-10
    return np.where(np.isnan(z), np.nan, np.fft.ifft2(k * np.fft.fft2(filled)).real)


def derivatives(z: np.ndarray, dx: float, dy: float) -> dict[str, np.ndarray]:
    filled = np.where(np.isnan(z), np.nanmean(z), z)
    gy, gx = np.gradient(filled, dy, dx)
    hole = np.isnan(z)
    return {"d_dx": np.where(hole, np.nan, gx), "d_dy": np.where(hole, np.nan, gy), "d_dz": vertical_derivative(z, dx, dy)}


def gaussian(z: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian with mirrored borders."""
    reach = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (0, 1):
        padded = np.pad(z, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        z = np.apply_along_axis(np.convolve, axis, padded, weights, "valid")
    return z


def borders(z: np.ndarray) -> None:
    """Zero second derivative: first and last rows, then columns."""
    if z.shape[0] >= 3:
        z[0], z[-1] = 2 * z[1] - z[2], 2 * z[-2] - z[-3]
    if z.shape[1] >= 3:
        z[:, 0], z[:, -1] = 2 * z[:, 1] - z[:, 2], 2 * z[:, -2] - z[:, -3]


def soft_sweep(z: np.ndarray, weight: np.ndarray, target: np.ndarray, omega: float, low: float, high: float) -> float:
    """One in-place row-major relaxation of the inner nodes with soft pulls to
    the targets.  Nodes of an anti-diagonal depend only on the ones before and
    after it, so each is updated at once with the sequential sweep's result."""
    ny, nx = z.shape
    flat, w, t = z.reshape(-1), weight.reshape(-1), target.reshape(-1)  # views: a diagonal is a strided slice
    pull = np.where(w > 0.01, 0.1 * w, 0.0)
    most = 0.0
    for k in range(2, ny + nx - 3):
        first, last = max(1, k - nx + 2), min(ny - 2, k - 1)
        at = slice(k + first * (nx - 1), k + last * (nx - 1) + 1, nx - 1)
        side = lambda d, at=at: flat[at.start + d : at.stop + d : nx - 1]
        old = flat[at].copy()
        new = old + omega * ((side(nx) + side(-nx) + side(1) + side(-1)) / 4 - old)
        new = np.where(pull[at] > 0, new * (1 - pull[at]) + t[at] * pull[at], new)
        np.clip(new, low, high, out=new)
        flat[at] = new
        most = max(most, np.abs(new - old).max(initial=0.0))
    return most


def soft_minimum_curvature(start: np.ndarray, weight: np.ndarray, target: np.ndarray, values: np.ndarray, rounds: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
    z, spread = start.copy(), np.ptp(values)
    weight = weight / weight.max() if weight.max() > 0 else weight
    for _ in range(rounds):
        change = soft_sweep(z, weight, target, 0.5, values.mean() - 3 * spread, values.mean() + 3 * spread)
        borders(z)
        if change > spread or change < tolerance:
            break
    return z


def hard_minimum_curvature(start: np.ndarray, known: np.ndarray, omega: float = 1.8, rounds: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
    """Simultaneous relaxation with data nodes (finite ``known``) held fixed."""
    fixed, z = np.isfinite(known), start.copy()
    values = known[fixed]
    spread = np.ptp(values)
    low, high = values.mean() - 3 * spread, values.mean() + 3 * spread
    z[fixed] = values
    for _ in range(rounds):
        old = z.copy()
        inner = old[1:-1, 1:-1]
        new = np.clip(inner + omega * ((old[2:, 1:-1] + old[:-2, 1:-1] + old[1:-1, 2:] + old[1:-1, :-2]) / 4 - inner), low, high)
        z[1:-1, 1:-1] = np.where(fixed[1:-1, 1:-1], inner, new)
        change = np.abs(z[1:-1, 1:-1] - inner).max(initial=0.0)
        borders(z)
        z[fixed] = values
        if change > spread or change < tolerance:
            break
    return z


def triangulate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Delaunay triangles (rows of point numbers) by incremental insertion."""
    n = len(x)
    cx, cy, size = x.mean(), y.mean(), 20_000 * max(np.ptp(x), np.ptp(y), 1e-12)
    px, py = np.append(x, [cx - size, cx + size, cx]), np.append(y, [cy - size, cy - size, cy + size])
    corners = np.zeros((8 * n + 16, 3), int)
    circles = np.zeros((8 * n + 16, 3))  # centre and squared radius; a dead triangle has none
    corners[0], used = (n, n + 1, n + 2), 1

    def circle(c):
        (ax, bx, cx_), (ay, by, cy_) = px[c].T, py[c].T
        d = 2 * (ax * (by - cy_) + bx * (cy_ - ay) + cx_ * (ay - by))
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx_ * cx_ + cy_ * cy_
        ux, uy = (a2 * (by - cy_) + b2 * (cy_ - ay) + c2 * (ay - by)) / d, (a2 * (cx_ - bx) + b2 * (ax - cx_) + c2 * (bx - ax)) / d
        return np.column_stack([ux, uy, (ux - ax) ** 2 + (uy - ay) ** 2])

    circles[:1] = circle(corners[:1])
    for p in range(n):
        bad = np.flatnonzero((px[p] - circles[:used, 0]) ** 2 + (py[p] - circles[:used, 1]) ** 2 < circles[:used, 2] * (1 - 1e-12))
        edges: dict[tuple[int, int], int] = {}
        for t in corners[bad].tolist():
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                e = (min(e), max(e))
                edges[e] = edges.get(e, 0) + 1
        circles[bad, 2] = -1.0
        new = [(a, b, p) for (a, b), seen in edges.items() if seen == 1 and abs((px[b] - px[a]) * (py[p] - py[a]) - (py[b] - py[a]) * (px[p] - px[a])) > 1e-14 * size]
        if new:
            places = np.concatenate([bad[: len(new)], np.arange(used, used + max(0, len(new) - len(bad)))])
            used += max(0, len(new) - len(bad))
            if used + 16 > len(corners):
                corners, circles = np.vstack([corners, np.zeros_like(corners)]), np.vstack([circles, np.zeros_like(circles)])
            corners[places], circles[places] = new, circle(np.array(new))
    alive = (circles[:used, 2] >= 0) & (corners[:used].max(axis=1) < n)
    return corners[:used][alive]


def axes_of(gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Axes of a mesh in ascending order; None for places of any other kind."""
    ax, ay = gx[0], gy[:, 0]
    even = (gx == ax).all() and (gy == ay[:, None]).all() and (np.diff(ax) > 0).all() and (np.diff(ay) > 0).all()
    return (ax, ay) if even else None


def box(axes: tuple[np.ndarray, np.ndarray] | None, low, high) -> tuple[slice, slice]:
    """The part of a mesh that a box can touch; all of it without axes."""
    if axes is None:
        return slice(None), slice(None)
    part = lambda a, k: slice(int(np.searchsorted(a, low[k] - 1e-12)), int(np.searchsorted(a, high[k] + 1e-12, side="right")))
    return part(axes[1], 1), part(axes[0], 0)


def linear_grid(x: np.ndarray, y: np.ndarray, z: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Barycentric interpolation over the Delaunay triangles, nan outside; a
    triangle visits the nodes of its own box only."""
    out, axes = np.full(gx.shape, np.nan), axes_of(gx, gy)
    for t in triangulate(x, y):
        a, b, c = t
        d = (y[b] - y[c]) * (x[a] - x[c]) + (x[c] - x[b]) * (y[a] - y[c])
        near = box(axes, (x[t].min(), y[t].min()), (x[t].max(), y[t].max()))
        qx, qy, part = gx[near], gy[near], out[near]
        u = ((y[b] - y[c]) * (qx - x[c]) + (x[c] - x[b]) * (qy - y[c])) / d
        v = ((y[c] - y[a]) * (qx - x[c]) + (x[a] - x[c]) * (qy - y[c])) / d
        hit = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9) & np.isnan(part)
        part[hit] = (u * z[a] + v * z[b] + (1 - u - v) * z[c])[hit]
    return out


def vertex_gradients(x: np.ndarray, y: np.ndarray, z: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Gradient at each point: plane through it that fits the points it shares a
    triangle with best, nearer ones weighing more; 0 for lone points."""
    pairs = np.unique(np.vstack([triangles[:, [i, j]] for i in range(3) for j in range(3) if i != j]), axis=0)
    a, b = pairs.T
    dx, dy, dz = x[b] - x[a], y[b] - y[a], z[b] - z[a]
    w = 1 / np.maximum(dx * dx + dy * dy, 1e-300)
    total = lambda v: np.bincount(a, w * v, len(x))
    xx, xy, yy, xz, yz = total(dx * dx), total(dx * dy), total(dy * dy), total(dx * dz), total(dy * dz)
    det = xx * yy - xy * xy
    safe = np.where(det > 1e-12 * np.maximum(xx * yy, 1e-300), det, np.inf)
    return np.column_stack([(yy * xz - xy * yz) / safe, (xx * yz - xy * xz) / safe])


def cubic_grid(x: np.ndarray, y: np.ndarray, z: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Smooth interpolation over the Delaunay triangles, nan outside: every
    triangle is split at its centroid into three cubics in Bernstein form, with
    the vertex gradients and a slope across each edge that is linear along it,
    so that value and slope are continuous everywhere."""
    out, triangles = np.full(gx.shape, np.nan), triangulate(x, y)
    if not len(triangles):
        return out
    axes = axes_of(gx, gy)
    slope, place = vertex_gradients(x, y, z, triangles), np.column_stack([x, y])
    for t in triangles:
        v, f, g = place[t], z[t], slope[t]
        c = v.mean(axis=0)
        window = box(axes, v.min(axis=0), v.max(axis=0))
        part = out[window]
        near = np.isnan(part)
        if not near.any():
            continue
        toward = lambda i, q: f[i] + g[i] @ (q - v[i]) / 3  # noqa: B023, E731
        inner = [toward(i, c) for i in range(3)]
        edges = {}
        for i, j in ((0, 1), (1, 2), (2, 0)):
            along = v[j] - v[i]
            normal = np.array([-along[1], along[0]])
            wj, wc = np.linalg.solve(np.column_stack([along, c - v[i]]), normal)
            wi = -wj - wc
            bij, bji = toward(i, v[j]), toward(j, v[i])
            first, last = wi * f[i] + wj * bij + wc * inner[i], wi * bji + wj * f[j] + wc * inner[j]
            edges[i, j] = bij, bji, ((first + last) / 2 - wi * bij - wj * bji) / wc
        deep = [(inner[i] + edges[i, (i + 1) % 3][2] + edges[(i + 2) % 3, i][2]) / 3 for i in range(3)]
        middle = sum(deep) / 3
        qx, qy = gx[window][near], gy[window][near]
        found = np.full(qx.shape, np.nan)
        for (i, j), (bij, bji, bij1) in edges.items():
            base = np.column_stack([v[j] - v[i], c - v[i]])
            lj, lc = np.linalg.solve(base, np.vstack([qx - v[i, 0], qy - v[i, 1]]))
            li = 1 - lj - lc
            value = (
                li**3 * f[i] + lj**3 * f[j] + lc**3 * middle + 3 * (li**2 * lj * bij + li * lj**2 * bji + li**2 * lc * inner[i] + lj**2 * lc * inner[j] + li * lc**2 * deep[i] + lj * lc**2 * deep[j]) + 6 * li * lj * lc * bij1
            )
            hit = (li >= -1e-9) & (lj >= -1e-9) & (lc >= -1e-9) & np.isnan(found)
            found[hit] = value[hit]
        part[near] = found
    return out


def nearest_grid(x, y, z, gx, gy, rows: int = 512) -> np.ndarray:
    flat = np.column_stack([gx.ravel(), gy.ravel()])
    picks = [((f[:, None, :] - np.column_stack([x, y])[None]) ** 2).sum(-1).argmin(1) for f in np.array_split(flat, -(-len(flat) // rows))]
    return z[np.concatenate(picks)].reshape(gx.shape)


def euler(z: np.ndarray, gx: np.ndarray, gy: np.ndarray, dz: dict[str, np.ndarray], index: float = 3.0, window: int = 10, mode: str = "compat") -> np.ndarray:
    """Rows (x, y, depth) of windows whose least-squares depth lies in 0 to 100.
    ``compat`` takes the field's term on the right-hand side with a minus sign;
    ``corrected`` with the plus sign of Euler's equation."""
    out, sign = [], 1 if mode == "corrected" else -1
    for i in range(0, z.shape[0] - window, 2):
        for j in range(0, z.shape[1] - window, 2):
            cut = np.s_[i : i + window, j : j + window]
            m, mx, my, mz = (a[cut].ravel() for a in (z, dz["d_dx"], dz["d_dy"], dz["d_dz"]))
            left = np.column_stack([mx, my, mz, np.full(len(m), sign * index)])
            right = gx[cut].ravel() * mx + gy[cut].ravel() * my + sign * index * m
            if np.isfinite(left).all() and np.isfinite(right).all():
                found = np.linalg.lstsq(left, right, rcond=None)[0]
                if np.isfinite(found).all() and 0 < found[2] < 100:
                    out.append(found[:3])
    return np.array(out).reshape(-1, 3)


def euler_solutions(grid: DataFrame, dx: float, dy: float, index: float = 3.0, window: int = 10, mode: str = "compat") -> DataFrame:
    """Euler deconvolution of each grid in node units scaled by dx, dy."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        dense = np.full((cells["iy"].max() + 1, cells["ix"].max() + 1), np.nan)
        dense[cells["iy"], cells["ix"]] = cells["value"].astype(float)
        iy, ix = np.indices(dense.shape)
        found = euler(dense, ix * dx, iy * dy, derivatives(dense, dx, dy), index, window, mode)
        return pd.DataFrame(found, columns=["x", "y", "depth"]).assign(grid_id=cells["grid_id"].iloc[0])[["grid_id", "x", "y", "depth"]]

    kind = grid.schema["grid_id"].dataType.simpleString()
    return spread(grid.select("grid_id", "iy", "ix", "value")).groupBy("grid_id").applyInPandas(run, f"grid_id {kind}, x double, y double, depth double")


def minimum_curvature(points: DataFrame, nx: int, ny: int, soft: bool = True, rounds: int = 1000, pad: float = 0.01) -> DataFrame:
    """Points (grid_id, x, y, z) to grids: linear start, nearest outside, then
    relaxation.  One task per grid_id; the points of a grid are one survey."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.dropna(subset=["x", "y", "z"]).sort_values(["x", "y", "z"])
        x, y, z = (table[c].to_numpy(float) for c in "xyz")
        rx, ry = np.ptp(x), np.ptp(y)
        ax, ay = np.linspace(x.min() - pad * rx, x.max() + pad * rx, nx), np.linspace(y.min() - pad * ry, y.max() + pad * ry, ny)
        gx, gy = np.meshgrid(ax, ay)
        start = linear_grid(x, y, z, gx, gy)
        start = np.where(np.isnan(start), nearest_grid(x, y, z, gx, gy), start)
        dx, dy = ax[1] - ax[0], ay[1] - ay[0]
        if soft:
            r = influence_radius(len(x), rx, ry, dx, dy)
            weight, target, axes = np.zeros(gx.shape), np.zeros(gx.shape), axes_of(gx, gy)
            for px, py, pz in zip(x, y, z, strict=True):
                near = box(axes, (px - r, py - r), (px + r, py + r))
                d = np.hypot(gx[near] - px, gy[near] - py)
                w = np.where(d <= r, np.exp(-((d / (0.3 * r)) ** 2)), 0)
                weight[near] += w
                target[near] += w * pz
            out = soft_minimum_curvature(start, weight, np.divide(target, weight, out=np.zeros_like(target), where=weight > 0), z, rounds)
        else:
            known = np.full(gx.shape, np.nan)
            known[np.rint((y - ay[0]) / dy).astype(int), np.rint((x - ax[0]) / dx).astype(int)] = z
            out = hard_minimum_curvature(start, known, rounds=rounds)
        iy, ix = np.indices(gx.shape)
        return pd.DataFrame({"grid_id": table["grid_id"].iloc[0], "iy": iy.ravel(), "ix": ix.ravel(), "x": gx.ravel(), "y": gy.ravel(), "value": out.ravel()})

    kind = points.schema["grid_id"].dataType.simpleString()
    return spread(points.select("grid_id", "x", "y", "z")).groupBy("grid_id").applyInPandas(run, f"grid_id {kind}, iy int, ix int, x double, y double, value double")


SCATTER = {"linear": linear_grid, "nearest": nearest_grid, "cubic": cubic_grid}


def scatter_grid(points: DataFrame, nx: int, ny: int, method: str = "cubic", pad: float = 0.01) -> DataFrame:
    """Scattered points (grid_id, x, y, z) on a mesh: linear, nearest or cubic;
    null outside the hull for the first and last.  One task per grid."""
    if method not in SCATTER:
        raise ValueError(f"unknown method {method!r}")

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.dropna(subset=["x", "y", "z"]).groupby(["x", "y"], as_index=False).agg({"grid_id": "first", "z": "mean"})
        x, y, z = (table[c].to_numpy(float) for c in "xyz")
        ax, ay = (np.linspace(v.min() - pad * np.ptp(v), v.max() + pad * np.ptp(v), n) for v, n in ((x, nx), (y, ny)))
        gx, gy = np.meshgrid(ax, ay)
        value = SCATTER[method](x, y, z, gx, gy).ravel()
        iy, ix = np.indices(gx.shape)
        return pd.DataFrame({"grid_id": table["grid_id"].iloc[0], "iy": iy.ravel(), "ix": ix.ravel(), "x": gx.ravel(), "y": gy.ravel(), "value": [None if np.isnan(v) else v for v in value]})

    kind = points.schema["grid_id"].dataType.simpleString()
    return spread(points.select("grid_id", "x", "y", "z")).groupBy("grid_id").applyInPandas(run, f"grid_id {kind}, iy int, ix int, x double, y double, value double")
