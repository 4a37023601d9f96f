"""Track kinematics.  A track has ``line_id`` and an order column ``seq`` that
counts from 0 without gaps within the line; every window is by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratafield.functions import angles

def line():
    return Window.partitionBy("line_id").orderBy("seq")


def whole():
    return Window.partitionBy("line_id")


def _first_from_second(value: Column) -> Column:
    return F.coalesce(value, F.lead(value).over(line()))


def heading_backward(track: DataFrame) -> DataFrame:
    """Heading from the row before; the first row takes the second's, a line of
    one row has 0."""
    step = track.withColumn("_h", angles.bearing(F.col("easting") - F.lag("easting").over(line()), F.col("northing") - F.lag("northing").over(line())))
    return step.withColumn("heading", F.coalesce("_h", F.lead("_h").over(line()), F.lit(0.0))).drop("_h")


def heading_forward(track: DataFrame) -> DataFrame:
    """Heading to the next row; the last row takes the one before."""
    step = track.withColumn("_h", angles.bearing(F.lead("easting").over(line()) - F.col("easting"), F.lead("northing").over(line()) - F.col("northing")))
    return step.withColumn("heading", F.coalesce("_h", F.lag("_h").over(line()), F.lit(0.0))).drop("_h")


def _step_m(shift) -> Column:
    return F.hypot(shift("easting").over(line()) - F.col("easting"), shift("northing").over(line()) - F.col("northing"))


def speed_ms(track: DataFrame) -> DataFrame:
    """Metres per second from the row before; equal times count as 1e-6 s."""
    dt = (F.col("t_ms") - F.lag("t_ms").over(line())) / 1000.0
    step = track.withColumn("_v", _step_m(F.lag) / F.when(dt == 0, 1e-6).otherwise(dt))
    return step.withColumn("speed", F.coalesce("_v", F.lead("_v").over(line()), F.lit(0.0))).drop("_v")


def speed_kmh(track: DataFrame, smooth: int = 5) -> DataFrame:
    """Kilometres per hour to the next row: time step held to 0.01 to 60 s, speed
    to 0 to 500, smoothed over ``smooth`` rows in lines of more; the last row
    takes the one before."""
    dt = F.greatest(F.lit(0.01), F.least(F.lit(60.0), (F.lead("t_ms").over(line()) - F.col("t_ms")) / 1000.0))
    step = track.withColumn("_v", F.when(F.lead("t_ms").over(line()).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(500.0), _step_m(F.lead) / dt * 3.6))))
    step = step.withColumn("_n", F.count("*").over(whole()))
    mean = reflect_average(step, {"_s": F.col("_v")}, smooth, F.col("_v").isNotNull())
    mean = mean.withColumn("_x", F.when(F.col("_n") - 1 > smooth, F.col("_s")).otherwise(F.col("_v")))
    return mean.withColumn("speed_kmh", F.coalesce("_x", F.lag("_x").over(line()), F.lit(0.0))).drop("_v", "_s", "_n", "_x")


def reflect_average(track: DataFrame, columns: dict[str, Column], size: int, use: Column | None = None) -> DataFrame:
    """Moving averages over ``size`` rows with mirrored ends: row i averages rows
    i - size//2 to i + (size-1)//2.  The mirror rows are made per row, so the
    average is one window of the line; lines need at least size//2 rows.  Rows
    outside ``use`` (the last ones of a line) stay out and get null."""
    left, right = size // 2, size - size // 2 - 1
    use = F.lit(True) if use is None else use
    n, i = F.col("_rows"), F.col("seq").cast("long")
    numbered = track.select("*", use.alias("_use"), F.count_if(use).over(whole()).alias("_rows"))
    far = F.lit(1 << 60)
    places = F.when(F.col("_use"), F.filter(F.array(i, F.when(i < left, -1 - i), F.when(i >= n - right, 2 * n - 1 - i)), lambda p: p.isNotNull())).otherwise(F.array(far))
    spread = numbered.withColumns({f"_in_{k}": c for k, c in columns.items()}).withColumn("_at", F.explode(places))
    around = Window.partitionBy("line_id").orderBy("_at").rowsBetween(-left, right)
    out = spread.withColumns({k: F.when(F.col("_use"), F.avg(f"_in_{k}").over(around)) for k in columns})
    return out.filter((F.col("_at") == i) | (F.col("_at") == far)).drop("_at", "_rows", "_use", *[f"_in_{k}" for k in columns])


def smooth_heading(track: DataFrame, size: int) -> DataFrame:
    """Circular moving average of ``heading``; lines shorter than the window
    keep their heading."""
    parts = {"_s": F.sin(F.radians("heading")), "_c": F.cos(F.radians("heading"))}
    counted = track.withColumn("_count", F.count("*").over(whole()))
    out = reflect_average(counted, parts, size)
    mean = angles.turn(F.degrees(F.atan2("_s", "_c")))
    return out.withColumn("smooth_heading", F.when(F.col("_count") < size, F.col("heading")).otherwise(mean)).drop("_s", "_c", "_count")


def heading_change(track: DataFrame, column: str = "heading") -> DataFrame:
    """Unsigned change to the next row; the last row repeats the one before."""
    step = track.withColumn("_d", angles.difference(F.lead(column).over(line()), F.col(column)))
    return step.withColumn("heading_change", F.coalesce("_d", F.lag("_d").over(line()), F.lit(0.0))).drop("_d")


def stability(track: DataFrame, size: int = 200, outside: float = 999.0) -> DataFrame:
    """Moving average of ``heading_change`` with ``outside`` beyond both ends."""
    around = line().rowsBetween(-(size // 2), size - size // 2 - 1)
    total, rows = F.sum("heading_change").over(around), F.count("heading_change").over(around)
    return track.withColumn("stability", (total + outside * (size - rows)) / size)


def cumulative_m(track: DataFrame, step: Column) -> DataFrame:
    """Distance along the line; ``step`` is the length from the row before."""
    return track.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("dist_m", F.sum("_step").over(line())).drop("_step")


def denoise_distance(track: DataFrame, least_step: float) -> DataFrame:
    """Distance without steps shorter than ``least_step`` / 1000, in lines of
    as many rows as there are good steps (plus the first)."""
    step = F.col("dist_m") - F.lag("dist_m").over(line())
    good = F.coalesce(step * 1000 >= least_step, F.lit(True))
    return track.withColumn("good", good).withColumn("clean_m", F.first("dist_m").over(line().rowsBetween(Window.unboundedPreceding, 0)) + F.sum(F.when(F.col("good"), F.coalesce(step, F.lit(0.0))).otherwise(0.0)).over(line()))


def elapsed_hours(track: DataFrame) -> DataFrame:
    return track.withColumn("elapsed_h", (F.col("t_ms") - F.first("t_ms").over(line())) / 3_600_000.0)


def resample(track: DataFrame, columns: list[str], spacing: float) -> DataFrame:
    """Rows at constant spacing of ``dist_m`` (half-open up to the last), every
    column linear between the bracketing rows.  Distances must not fall."""
    following = {f"_to_{c}": F.lead(c).over(line()) for c in [*columns, "dist_m"]}
    first = F.min("dist_m").over(whole())
    pairs = track.withColumns(following | {"_first": first}).filter("_to_dist_m > dist_m")
    low, high = F.ceil((F.col("dist_m") - F.col("_first")) / spacing), F.ceil((F.col("_to_dist_m") - F.col("_first")) / spacing) - 1
    pairs = pairs.filter(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    x = F.col("_first") + F.col("k") * spacing
    share = (x - F.col("dist_m")) / (F.col("_to_dist_m") - F.col("dist_m"))
    return pairs.select("line_id", "k", x.alias("dist_m"), *[(F.col(c) + share * (F.col(f"_to_{c}") - F.col(c))).alias(c) for c in columns])
