"""Smaller survey operators: track bookkeeping, reports, grid fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import grid
from .frozen import frozen
from .kinematics import line
from .tables import long_form


def fill_times(track: DataFrame, numeric: str, text: str, date: str) -> DataFrame:
    """Inside gaps between anchor rows: the date of the anchor before, and its
    hour and minute with the (interpolated) numeric time modulo 60."""
    anchored = F.col(text).isNotNull()
    before = lambda c: F.last(F.when(anchored, F.col(c)), True).over(line().rowsBetween(Window.unboundedPreceding, 0))
    known = track.withColumns({"_t": before(text), "_d": before(date), "_next": F.first(F.when(anchored, F.col("seq")), True).over(line().rowsBetween(0, Window.unboundedFollowing))})
    inside = F.col("_t").isNotNull() & F.col("_next").isNotNull()
    clock = F.concat(F.regexp_extract("_t", r"^(\d+:\d+):", 1), F.lit(":"), F.format_string("%06.3f", F.pmod(F.col(numeric), F.lit(60.0))))
    return known.withColumns({text: F.when(anchored, F.col(text)).when(inside & F.col(numeric).isNotNull(), clock), date: F.when(inside, F.coalesce(F.col(date), "_d")).otherwise(F.col(date))}).drop("_t", "_d", "_next")


def first_valid(track: DataFrame, columns: list[str]) -> DataFrame:
    """Every row takes the line's first known value of each column."""
    whole = line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return track.withColumns({c: F.first(c, True).over(whole) for c in columns})


def progressive_time(track: DataFrame, start_s: Column, rate_hz: float = 250.0) -> DataFrame:
    """Seconds of the day at a steady rate from the line's start."""
    return track.withColumn("progress_s", F.pmod(start_s + F.col("seq") / rate_hz, F.lit(86_400.0)))


def progressive_frames(rows: DataFrame, order: str, n: int, frames: int = 10) -> DataFrame:
    """Frame by which a row has appeared: frames grow by n // frames rows; row r
    is in frame f and all later ones."""
    step = max(1, n // frames)
    return rows.withColumn("frame", F.floor(F.col(order) / step))


def scaled_by_threshold(value: Column, threshold: float) -> Column:
    return F.when(value > threshold, value * 1.1).otherwise(value * 0.9)


def speed_summary(track: DataFrame) -> DataFrame:
    """Range, mean, median and odd values of speed_kmh with span and rate."""
    minutes = (F.max("t_ms") - F.min("t_ms")) / 60_000.0
    v = F.col("speed_kmh")
    return track.groupBy("line_id").agg(F.min(v).alias("min_kmh"), F.max(v).alias("max_kmh"), F.avg(v).alias("mean_kmh"), F.median(v).alias("median_kmh"), F.count_if(v > 200).alias("n_fast"), F.count_if(v < 1).alias("n_slow"), minutes.alias("minutes"), F.try_divide(F.count("*").cast("double"), minutes).alias("per_minute"))


def channel_report(rows: DataFrame, channels: list[str]) -> DataFrame:
    """Range, mean and sample deviation of each channel that the table has."""
    cells = long_form(rows, [c for c in channels if c in rows.columns], "channel")
    return cells.groupBy("channel").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def segment_report(stats: DataFrame) -> DataFrame:
    """One line of text per direction of ``segments.segment_statistics``."""
    text = F.format_string("%s: %d lines, %d points, mean heading %.1f", "direction", "n_lines", "n_points", "mean_heading")
    return stats.select("direction", text.alias("line"))


def retention(track: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of rows in segments and their duration, per line."""
    total = track.groupBy("line_id").agg(F.count("*").alias("n_all"))
    inside = kept.groupBy("line_id").agg(F.count("*").alias("n_kept"), ((F.max("t_ms") - F.min("t_ms")) / 60_000.0).alias("minutes"))
    both = total.join(inside, "line_id", "left").na.fill({"n_kept": 0, "minutes": 0.0})
    return both.withColumn("percent", 100.0 * F.col("n_kept") / F.col("n_all"))


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with their rank by first appearance."""
    firsts = rows.groupBy(key).agg(F.min(order).alias("first_row"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_row")) - 1)  # one row per key


def spacing_threshold(points: DataFrame, cell: float, fallback: float = 0.01) -> float:
    """Twice the median distance to the nearest other place, at whatever distance
    that lies; ``cell`` is the size of the squares that are searched first."""
    places = points.select("x", "y").na.drop().distinct()
    near = _nearest_other(places, cell)
    found = near.agg(F.median("d").alias("m")).first()["m"]
    return fallback if found is None else 2 * found


def _nearest_other(places: DataFrame, cell: float) -> DataFrame:
    """ax, ay, d of every place that has another one: within its own and the
    neighbour squares, and for those not sure there in squares twice as wide."""
    done, waiting, size = None, places, cell
    while True:
        key = lambda c, size=size: F.floor(F.col(c) / size).cast("long")
        offsets = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        a = waiting.withColumn("_i", offsets).withColumn("_j", offsets).select(F.col("x").alias("ax"), F.col("y").alias("ay"), (key("x") + F.col("_i")).alias("cx"), (key("y") + F.col("_j")).alias("cy"))
        b = places.select("x", "y", key("x").alias("cx"), key("y").alias("cy"))
        d = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))
        found = a.join(b, ["cx", "cy"], "left").withColumn("d", F.when(d > 0, d)).groupBy("ax", "ay").agg(F.min("d").alias("d"))
        found = frozen(found)
        sure = found.filter(F.col("d") <= size)  # nothing nearer can lie beyond the neighbour squares
        done = sure if done is None else done.unionByName(sure)
        waiting = found.filter(F.coalesce(F.col("d") > size, F.lit(True))).select(F.col("ax").alias("x"), F.col("ay").alias("y"))
        ends = places.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
        if waiting.isEmpty() or ends["n"] < 2 or size > ends["w"] + ends["h"]:
            return done
        size *= 2


def near_points(nodes: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """Nodes within ``distance`` of a point (alpha mask, buffer of a mask); where
    both have a grid_id, of a point of the same grid."""
    same = [c for c in ("grid_id",) if c in nodes.columns and c in points.columns]
    key = lambda c: F.floor(F.col(c) / distance).cast("long")
    offsets = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    held = points.select(*same, F.col("x").alias("px"), F.col("y").alias("py"), key("x").alias("cx"), key("y").alias("cy"))
    looks = nodes.withColumn("_i", offsets).withColumn("_j", offsets).withColumns({"cx": key("x") + F.col("_i"), "cy": key("y") + F.col("_j")})
    met = looks.join(held, [*same, "cx", "cy"]).filter(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= distance)
    return met.select(*nodes.columns).distinct()


def bilinear(points: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Grid value at each point from the four nodes around it; null outside."""
    gx, gy = (F.col("x") - x0) / dx, (F.col("y") - y0) / dy
    placed = points.withColumns({"_ix": F.floor(gx).cast("int"), "_iy": F.floor(gy).cast("int"), "_u": gx - F.floor(gx), "_v": gy - F.floor(gy)})
    out = placed
    for name, i, j in (("_a", 0, 0), ("_b", 1, 0), ("_c", 0, 1), ("_d", 1, 1)):
        corner = cells.select((F.col("ix") - i).alias("_ix"), (F.col("iy") - j).alias("_iy"), F.col("value").alias(name))
        out = out.join(corner, ["_ix", "_iy"], "left")
    u, v = F.col("_u"), F.col("_v")
    edge = lambda near, far, share: F.when(share == 0, F.col(near)).otherwise(F.col(near) * (1 - share) + F.col(far) * share)
    low, high = edge("_a", "_b", u), edge("_c", "_d", u)
    return out.withColumn("fitted", F.when(v == 0, low).otherwise(low * (1 - v) + high * v)).drop("_ix", "_iy", "_u", "_v", "_a", "_b", "_c", "_d")


def fill_holes(z: np.ndarray) -> np.ndarray:
    """Missing nodes linear over the known ones, outside their hull nearest."""
    known = np.isfinite(z)
    if known.all() or known.sum() < 3:
        return np.where(known, z, z[known].mean() if known.any() else np.nan)
    iy, ix = np.indices(z.shape).astype(float)
    x, y, v = ix[known], iy[known], z[known]
    out = grid.linear_grid(x, y, v, ix, iy)
    out = np.where(np.isnan(out), grid.nearest_grid(x, y, v, ix, iy), out)
    return np.where(known, z, out)


#: Names of style settings in scripts and in layers.
STYLE_KEYS = {
    "color": "point_color", "size": "point_size", "opacity": "point_opacity", "line_color": "line_color", "line_width": "line_width",
    "line_opacity": "line_opacity", "fill_color": "fill_color", "color_field": "color_field", "color_scheme": "color_ramp", "use_graduated_colors": "use_graduated_colors",
}


def style_overrides(info: dict) -> dict:
    return {new: info[old] for old, new in STYLE_KEYS.items() if old in info}


def cell_text(value: Column, paged: bool = False) -> Column:
    """Numbers as shown in tables: six decimals, or six digits when paged."""
    digits = F.format_string("%.5e", value)
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(value)))))
    short = F.when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e6), F.regexp_replace((F.round(value * scale) / scale).cast("decimal(38,10)").cast("string"), r"\.?0+$", "")).when(value == 0, "0").otherwise(digits)
    shown = short if paged else F.format_string("%.6f", value)
    return F.when(value.isNull() | F.isnan(value), "NaN").otherwise(shown)
