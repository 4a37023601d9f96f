"""Stable flight lines: islands, merging, grouping by heading."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratafield.functions import angles

from .kinematics import line


def islands(track: DataFrame, threshold: float, min_speed: float, min_rows: int) -> DataFrame:
    """Runs of rows with stability below ``threshold`` and speed above
    ``min_speed``: line_id, start_seq, end_seq, n_rows, mean_heading."""
    stable = (F.col("stability") < threshold) & (F.col("speed") > min_speed)
    marked = track.withColumn("_ok", F.coalesce(stable, F.lit(False)))
    turned = (F.col("_ok") != F.lag("_ok", 1, False).over(line())).cast("int")
    numbered = marked.withColumn("_island", F.sum(turned).over(line())).filter("_ok")
    runs = numbered.groupBy("line_id", "_island").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("n_rows"), angles.circular_mean(F.col("heading")).alias("mean_heading"))
    return runs.filter(F.col("n_rows") >= min_rows).drop("_island")


def merge_islands(track: DataFrame, runs: DataFrame, tolerance: float, min_length: int) -> DataFrame:
    """Neighbouring runs joined from left to right while their headings differ
    by at most ``tolerance`` and the gap is at most ``min_length`` rows; the
    merged heading is that of all rows between, gap included, by prefix sums.
    Runs of end - start below ``min_length`` go.  One fold per line."""
    sums = track.select("line_id", "seq", F.sum(F.sin(F.radians("heading"))).over(line()).alias("_s"), F.sum(F.cos(F.radians("heading"))).over(line()).alias("_c"), F.sin(F.radians("heading")).alias("_ds"), F.cos(F.radians("heading")).alias("_dc"))
    at = lambda end, out: sums.select("line_id", F.col("seq").alias(end), *[F.col(a).alias(b) for a, b in out.items()])
    starts = at("start_seq", {"_s": "s0", "_c": "c0", "_ds": "ds0", "_dc": "dc0"})
    ends = at("end_seq", {"_s": "s1", "_c": "c1"})
    rich = runs.join(starts, ["line_id", "start_seq"]).join(ends, ["line_id", "end_seq"])
    run = F.struct("start_seq", "end_seq", F.col("mean_heading").alias("h"), (F.col("s0") - F.col("ds0")).alias("s"), (F.col("c0") - F.col("dc0")).alias("c"), "s1", "c1")
    lists = rich.groupBy("line_id").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    kind = "struct<start_seq:bigint,end_seq:bigint,h:double,s:double,c:double,s1:double,c1:double>"
    folded = F.expr(f"""
        aggregate(slice(runs, 2, size(runs)), named_struct('now', element_at(runs, 1), 'done', cast(array() as array<{kind}>)), (a, x) ->
          if(least(abs(a.now.h - x.h), 360 - abs(a.now.h - x.h)) <= {tolerance} AND x.start_seq - a.now.end_seq <= {min_length},
             named_struct('now', named_struct('start_seq', a.now.start_seq, 'end_seq', x.end_seq,
               'h', pmod(degrees(atan2(x.s1 - a.now.s, x.c1 - a.now.c)), 360D), 's', a.now.s, 'c', a.now.c, 's1', x.s1, 'c1', x.c1), 'done', a.done),
             named_struct('now', x, 'done', array_append(a.done, a.now))), a -> array_append(a.done, a.now))""")
    out = lists.select("line_id", F.explode(folded).alias("r")).select("line_id", "r.start_seq", "r.end_seq", F.col("r.h").alias("mean_heading"))
    return out.filter(F.col("end_seq") - F.col("start_seq") >= min_length)


def scan_line(heading: np.ndarray, speed: np.ndarray, window: int, tolerance: float, min_length: int, min_rows: int, low: float, high: float, most_bad: int = 10) -> list[tuple[int, int, float]]:
    """Sequential scan for half-open runs (start, end, mean heading) that begin
    with a quiet window and end after ``most_bad`` bad points."""
    out, i, n = [], 0, len(heading)
    fast = (speed >= low) & (speed <= high)
    while i < n - min_length:
        to = min(i + window, n)
        if fast[i:to].sum() < 0.5 * (to - i) or heading[i:to].std() > tolerance:
            i += 1
            continue
        mean, j, bad = heading[i:to].mean(), to, 0
        while j < n and bad < most_bad:
            off = abs(heading[j] - mean)
            bad = bad + 1 if min(off, 360 - off) > tolerance else 0
            bad = max(0, bad - 1) if fast[j] else bad + 1
            j += 1
        end = j - bad
        if end - i >= min_rows:
            out.append((i, end, float(mean)))
        i = max(end, i + 1)
    return out


def scan_segments(track: DataFrame, window: int = 100, tolerance: float = 15.0, min_length: int = 50, min_rows: int = 200, low: float = 1.0, high: float = 300.0) -> DataFrame:
    """``scan_line`` for every line: the scan's state runs along the line, so a
    line is one group; lines are bounded by a flight."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        found = scan_line(rows["heading"].to_numpy(), rows["speed_kmh"].to_numpy(), window, tolerance, min_length, min_rows, low, high)
        return pd.DataFrame([(rows["line_id"].iloc[0], *x) for x in found], columns=["line_id", "start_seq", "end_seq", "mean_heading"])

    return track.select("line_id", "seq", "heading", "speed_kmh").groupBy("line_id").applyInPandas(run, "line_id long, start_seq long, end_seq long, mean_heading double")


def segment_rows(track: DataFrame, runs: DataFrame, trim: int = 0, half_open: bool = False) -> DataFrame:
    """Rows of each run (ends inclusive, or half-open with ``trim`` rows off both
    ends): an equi-join on the line with the range as its condition."""
    first, last = F.col("start_seq") + trim, F.col("end_seq") - trim - (1 if half_open else 0)
    return track.join(runs, "line_id").filter(F.col("seq").between(first, last))


def segment_statistics(rows: DataFrame, by: str = "direction") -> DataFrame:
    """Lines, points, circular mean and linear population deviation of the
    headings per direction."""
    return rows.groupBy(by).agg(F.countDistinct("line_id", "start_seq").alias("n_lines"), F.count("*").alias("n_points"), angles.circular_mean(F.col("heading")).alias("mean_heading"), F.stddev_pop("heading").alias("std_heading"))


def size_statistics(rows: DataFrame, by: str = "direction") -> DataFrame:
    """Segments and their total, mean, smallest and largest number of points."""
    sizes = rows.groupBy(by, "line_id", "start_seq").agg(F.count("*").alias("points"))
    return sizes.groupBy(by).agg(F.count("*").alias("n_segments"), F.sum("points").alias("total_points"), F.avg("points").alias("avg_points"), F.min("points").alias("min_points"), F.max("points").alias("max_points"))


def top_directions(stats: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` directions with most points, names break ties."""
    return stats.orderBy(F.desc("n_points"), "direction").limit(k)


def group_headings(runs: DataFrame, tolerance: float = 5.0, by: str = "survey") -> DataFrame:
    """Greedy clusters of headings in order of ``run_no``: a run joins the first
    open cluster whose first member lies within 2 * tolerance.  One group per
    survey; its runs are few (segments, not points)."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("run_no")
        heads: list[float] = []
        group = []
        for h in table["mean_heading"]:
            near = [i for i, x in enumerate(heads) if min(abs(x - h), 360 - abs(x - h)) <= 2 * tolerance]
            group.append(near[0] if near else len(heads))
            if not near:
                heads.append(h)
        return table.assign(heading_group=group)

    return runs.groupBy(by).applyInPandas(run, runs.schema.simpleString().removeprefix("struct<").removesuffix(">") + ", heading_group long")


def pair_opposites(headings: list[int], tolerance: float = 30.0) -> dict[int, int | None]:
    """Greedy pairs of opposite integer headings: each takes the unused heading
    nearest to its opposite, the first on ties; others stay alone."""
    out: dict[int, int | None] = {}
    used: set[int] = set()
    for h in headings:
        if h in used:
            continue
        away = {x: min(abs(x - (h + 180) % 360), 360 - abs(x - (h + 180) % 360)) for x in headings if x not in used and x != h}
        near = [x for x in away if away[x] <= tolerance]
        out[h] = min(near, key=away.get) if near else None
        used |= {h, *([] if out[h] is None else [out[h]])}
    return out


def match_opposites(groups: DataFrame, tolerance: float = 30.0, by: str = "survey") -> DataFrame:
    """``pair_opposites`` of each survey: (by, heading, opposite) for the rounded
    headings of its groups in order of ``heading_group``; opposite is null for those
    left alone.  A group is one survey's headings, 360 at most."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        heads = list(dict.fromkeys(table.sort_values("heading_group")["heading"].round().astype(int).tolist()))
        pairs = pair_opposites(heads, tolerance)
        return pd.DataFrame({by: table[by].iloc[0], "heading": list(pairs), "opposite": pd.array(list(pairs.values()), "Int64")})

    kind = groups.schema[by].dataType.simpleString()
    return groups.select(by, "heading_group", "heading").groupBy(by).applyInPandas(run, f"{by} {kind}, heading long, opposite long")


def cardinal_pair(direction: Column) -> Column:
    """North and South, and so on, as one name for both."""
    pairs = {"North": "North_South", "South": "North_South", "East": "East_West", "West": "East_West", "Northeast": "Northeast_Southwest", "Southwest": "Northeast_Southwest", "Northwest": "Northwest_Southeast", "Southeast": "Northwest_Southeast"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), direction)


def linestrings(rows: DataFrame) -> DataFrame:
    """Lines of two or more points as arrays of (x, y) in order."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "easting", "northing"))), lambda p: F.array(p["easting"], p["northing"]))
    return rows.groupBy("line_id").agg(points.alias("points")).filter(F.size("points") >= 2)


def line_numbers(rows: DataFrame) -> DataFrame:
    """Ordinal of each line in its direction by first row."""
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("direction").orderBy("line_id", "start_seq")))
