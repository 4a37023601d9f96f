"""The built-in processing scripts as registered operators with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from stratafield.functions import angles, geodesy
from stratafield.operators import anomaly, asof, grid, kinematics, radar, segments, spectral, survey, tables
from stratafield.operators.runner import Operator, Registry, RunResult


@dataclass
class MagbaseParams:
    sensor1_offset_east: float = 0.0375
    sensor1_offset_north: float = -0.56
    sensor2_offset_east: float = 0.0375
    sensor2_offset_north: float = 0.56
    utm_zone: int = 33
    northern: bool = True
    sampling: str = "interpolate"
    vertical_alignment: bool = False
    disable_basestation: bool = False
    base: DataFrame | None = field(default=None, repr=False)


def magbase(track: DataFrame, p: MagbaseParams) -> RunResult:
    """Trim to the GPS span, fill or drop rows without a fix, project, offset
    the sensors, total fields, base correction.  Columns: line_id, seq, t_ms,
    lat, lon, bx1 ... bz2 (or btotal1, btotal2)."""
    fixed = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("lat") != 0) & (F.col("lon") != 0)
    rows = asof.gps_trim(track, fixed)
    rows = asof.gap_fill(rows, fixed, ["lat", "lon"]) if p.sampling == "interpolate" else tables.valid_coordinates(rows, "lat", "lon")
    east, north = geodesy.to_utm(F.col("lat"), F.col("lon"), p.utm_zone, p.northern)
    rows = rows.withColumns({"utm_easting": east, "utm_northing": north})
    moved = {f"utm_{axis}{n}": F.col(f"utm_{axis}") + getattr(p, f"sensor{n}_offset_{side}") for n in (1, 2) for axis, side in (("easting", "east"), ("northing", "north"))}
    norm = lambda n: F.sqrt(sum((F.col(f"b{a}{n}") ** 2 for a in "yz"), F.col(f"bx{n}") ** 2))
    totals = {f"btotal{n}": norm(n) if f"bx{n}" in track.columns else F.col(f"btotal{n}") for n in (1, 2) if f"bx{n}" in track.columns or f"btotal{n}" in track.columns}
    rows = rows.withColumns(moved | totals)
    if p.base is not None and not p.disable_basestation:
        rows = asof.diurnal(rows, p.base)
        rows = rows if p.vertical_alignment else rows.drop("va")
    elif p.vertical_alignment:
        rows = rows.withColumn("va", F.col("btotal1") - F.col("btotal2"))
    return RunResult(rows, {"diagnostics": tables.column_statistics(rows)})


@dataclass
class SegmenterParams:
    heading_window: int = 51
    min_segment_length: int = 100
    heading_tolerance: float = 5.0
    stability_window: int = 200
    min_stable_duration: int = 5000
    heading_change_threshold: float = 10.0
    min_points_for_valid_line: int = 50
    min_speed: float = 0.5
    combine_opposite_headings: bool = True
    opposite_heading_tolerance: float = 30.0


def flight_path_segmenter(track: DataFrame, p: SegmenterParams) -> RunResult:
    """Magnetic flight lines: stable islands, merged, grouped by heading."""
    headed = kinematics.speed_ms(kinematics.heading_backward(track))
    smooth = kinematics.smooth_heading(headed, p.heading_window).withColumn("heading", F.col("smooth_heading")).drop("smooth_heading")
    steady = kinematics.stability(kinematics.heading_change(smooth), p.stability_window)
    runs = segments.merge_islands(steady, segments.islands(steady, p.heading_change_threshold, p.min_speed, p.min_stable_duration), p.heading_tolerance, p.min_segment_length)
    runs = runs.filter(F.col("end_seq") - F.col("start_seq") + 1 >= p.min_points_for_valid_line)
    direction = F.concat(F.lit("Heading_"), F.pmod(F.round("mean_heading").cast("int"), F.lit(360)).cast("string"))
    if p.combine_opposite_headings:
        found = sorted(r[0] for r in runs.select(F.pmod(F.round("mean_heading").cast("int"), F.lit(360))).distinct().collect())  # at most 360
        names = {}
        for a, b in segments.pair_opposites(found, p.opposite_heading_tolerance).items():
            if b is not None:
                names |= dict.fromkeys((a, b), f"Combined_{a}_{b}")
        if names:
            mapped = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.pmod(F.round("mean_heading").cast("int"), F.lit(360)))
            direction = F.coalesce(mapped, direction)
    rows = segments.segment_rows(steady, runs).withColumn("direction", direction)
    stats = segments.segment_statistics(rows)
    return RunResult(rows, {"segments": runs, "statistics": stats, "top": segments.top_directions(stats), "retention": survey.retention(track, rows)})


@dataclass
class GammaSegmenterParams:
    heading_window: int = 31
    min_segment_length: int = 50
    heading_tolerance: float = 15.0
    stability_window: int = 100
    min_stable_duration: int = 200
    min_speed_kmh: float = 1.0
    max_speed_kmh: float = 300.0
    trim: int = 20
    combine_opposite: bool = False
    quality_control: bool = False
    min_counts: float = 0
    max_counts: float = 50_000


def gamma_segmenter(track: DataFrame, p: GammaSegmenterParams) -> RunResult:
    """Gamma flight lines by the sequential scan, with trimmed ends."""
    rows = tables.gamma_quality(track, "total", [c for c in ("u238", "k40", "th232") if c in track.columns], "height", p.min_counts, p.max_counts) if p.quality_control else track
    speed = kinematics.speed_kmh(kinematics.heading_forward(rows))
    smooth = kinematics.smooth_heading(speed, p.heading_window).withColumn("heading", F.col("smooth_heading")).drop("smooth_heading")
    runs = segments.scan_segments(smooth, p.stability_window, p.heading_tolerance, p.min_segment_length, p.min_stable_duration, p.min_speed_kmh, p.max_speed_kmh)
    direction = angles.cardinal(F.col("mean_heading"), angles.LONG_CARDINALS)
    direction = segments.cardinal_pair(direction) if p.combine_opposite else direction
    kept = segments.segment_rows(smooth, runs, p.trim, half_open=True).withColumn("direction", direction)
    return RunResult(kept, {"segments": runs, "statistics": segments.size_statistics(kept), "speed": survey.speed_summary(speed)})


@dataclass
class GridParams:
    nodes: int = 300
    iterations: int = 1000
    soft: bool = True
    boundary: str = "convex_hull"
    buffer: float = 0.0
    include_original_points: bool = False


def _gridded(points: DataFrame, p: GridParams) -> RunResult:
    cells = grid.minimum_curvature(points, p.nodes, p.nodes, p.soft, p.iterations)
    if p.boundary == "convex_hull":
        cells = cells.join(grid.hull_points(points, "grid_id"), "grid_id", "left")
        cells = grid.masked(cells, grid.inside_hull(F.col("corners"))).drop("corners")
    elif p.boundary == "alpha_shape":
        near = survey.near_points(cells, points, survey.spacing_threshold(points, 1.0) + p.buffer)
        cells = cells.join(near.select("grid_id", "iy", "ix", F.lit(True).alias("_in")), ["grid_id", "iy", "ix"], "left").withColumn("value", F.when(F.col("_in"), F.col("value"))).drop("_in")
    out = {"statistics": grid.grid_statistics(cells), "contours": grid.contour_cells(cells)}
    if p.include_original_points:
        out["points"] = points
    return RunResult(cells, out)


def grid_interpolator(points: DataFrame, p: GridParams) -> RunResult:
    return _gridded(points, p)


@dataclass
class GammaGridParams(GridParams):
    nodes: int = 150


def gamma_interpolator(points: DataFrame, p: GammaGridParams) -> RunResult:
    """One grid per measurement (grid_id), gridded in parallel."""
    result = _gridded(points, p)
    result.tables["colour_range"] = tables.colour_range(points, ["z"], pooled=True, sample=False)
    return result


@dataclass
class AnomalyParams:
    smoothing: float = 1.0
    structural_index: float = 3.0
    window: int = 10
    dx: float = 1.0
    dy: float = 1.0
    method: str = "all"


def anomaly_processor(cells: DataFrame, p: AnomalyParams) -> RunResult:
    """Derivatives, analytic signal, tilt, horizontal gradient, peaks, Euler."""
    filled = grid.per_grid(cells, lambda z: {"value": grid.gaussian(survey.fill_holes(z), p.smoothing)}, ["value"])
    derived = grid.per_grid(filled, lambda z: grid.derivatives(z, p.dx, p.dy), ["d_dx", "d_dy", "d_dz"])
    signals = grid.signals(derived).withColumn("horizontal_gradient", F.hypot("d_dx", "d_dy"))
    out = {"peaks": grid.gradient_peaks(signals), "statistics": grid.grid_statistics(filled)}
    if p.method in ("all", "euler"):
        out["euler"] = grid.euler_solutions(filled, p.dx, p.dy, p.structural_index, p.window)
    return RunResult(signals, out)


def path_visualizer(track: DataFrame) -> RunResult:
    """Lines, bounds and statistics of a track, thinned to 1000 points."""
    step = tables.sampling_step(track.count())
    thin = tables.every_kth(track, "seq", step)
    return RunResult(segments.linestrings(thin), {"bounds": tables.bounds(track, "easting", "northing"), "statistics": tables.column_statistics(track)})


@dataclass
class StatisticalParams:
    method: str = "zscore"
    threshold: float = 2.5
    smoothing: int = 5
    remove_outliers: bool = True
    use_gradient: bool = True
    column: str = "field"


def statistical_anomaly(track: DataFrame, p: StatisticalParams) -> DataFrame:
    return anomaly.statistical_anomalies(track, p.column, p.method, p.threshold, p.smoothing, p.remove_outliers, p.use_gradient)


@dataclass
class MultispectralParams:
    stretch_percent: float = 2.0
    texture: bool = True


def multispectral(pixels: DataFrame, p: MultispectralParams) -> RunResult:
    """NDVI, stretch, RX anomalies and texture of the bands present."""
    bands = [b for b in ("blue", "green", "red", "nir", "swir1", "swir2") if b in pixels.columns]
    out = pixels.withColumn("ndvi", spectral.ndvi(F.col("red"), F.col("nir"))) if {"red", "nir"} <= set(bands) else pixels
    out = spectral.rx_distance(spectral.stretch(out, bands, p.stretch_percent), bands)
    if p.texture and {"line_id", "seq"} <= set(out.columns):
        out = spectral.texture(out, bands[0])
    return RunResult(out, {"covariance": spectral.covariance(pixels, bands), "counts": out.agg(F.count_if("is_anomaly").alias("n_anomalies"), F.count("*").alias("n"))})


@dataclass
class RadarParams:
    dt_ns: float = 100 / 512
    dc_first: int = 250
    dc_last: int = 450
    low_ghz: float = 0.15
    high_ghz: float = 0.55
    order: int = 4
    gain_alpha: float = 1.0
    gain_te: float = 70.0
    gain_tcst: float = 3.0
    steps: tuple[str, ...] = ("dc_shift", "background", "band_pass", "gain")


def _radar(traces: DataFrame, p: RadarParams) -> RunResult:
    n = traces.select(F.max(F.size("samples"))).first()[0] or 0
    options = {
        "dc_shift": {"first": min(p.dc_first, n // 2), "last": min(p.dc_last, max(0, n - 1))}, "background": {},
        "band_pass": {"dt_ns": p.dt_ns, "low_ghz": p.low_ghz, "high_ghz": p.high_ghz, "order": p.order},
        "gain": {"gain": radar.gains(n, p.dt_ns, "power", p.gain_alpha, p.gain_te, p.gain_tcst)},
    }
    done = radar.run_steps(radar.sanitise(traces), [(s, options.get(s, {})) for s in p.steps])
    return RunResult(done[-1][1], {f"{i}_{name}": df for i, (name, df) in enumerate(done)} | {"spectrum": radar.power_spectrum(done[-1][1], p.dt_ns), "quality": radar.trace_quality(done[-1][1])})


def radar_segment(traces: DataFrame, p: RadarParams) -> RunResult:
    return _radar(traces, p)


@dataclass
class RadarTraceParams(RadarParams):
    segment: int = 1
    trace: int = 1


def radar_trace(traces: DataFrame, p: RadarTraceParams) -> RunResult:
    """One trace by 1-based segment and trace number, held to what there is."""
    held = [r[0] for r in traces.select("segment").distinct().orderBy("segment").collect()]
    chosen = traces.filter(F.col("segment") == held[min(max(p.segment, 1), len(held)) - 1])
    last = chosen.agg(F.max("trace_no")).first()[0]
    return _radar(chosen.filter(F.col("trace_no") == min(max(p.trace - 1, 0), last)), p)


@dataclass
class RadarSurveyParams:
    spacing_m: float = 0.05
    time_cut_ns: float = 70.0
    dt_ns: float = 100 / 512
    least_step: float = 0.01
    positions: DataFrame | None = field(default=None, repr=False)
    waypoints: DataFrame | None = field(default=None, repr=False)


def radar_preprocessor(traces: DataFrame, p: RadarSurveyParams) -> RunResult:
    """Raw survey to segments: waypoints cut the positions (t_s, lat, lon,
    trace_no) into segments, distances are cleaned and resampled to constant
    spacing, each new place takes the nearest trace's samples, cut in time."""
    timed = p.positions.withColumn("t_ms", (F.col("t_s") * 1000).cast("long"))
    marks = p.waypoints.withColumn("t_ms", (F.col("t_s") * 1000).cast("long")).select("survey_no", "t_ms")
    begun = asof.nearest(timed, marks.select("t_ms", F.col("t_ms").alias("mark")), "mark", direction="backward").filter("base_mark IS NOT NULL").withColumn("line_id", F.col("base_mark"))
    track = begun.withColumn("seq", (F.row_number().over(Window.partitionBy("line_id").orderBy("t_ms", "trace_no")) - 1).cast("long"))
    step = geodesy.geodesic_m(F.lag("lat").over(kinematics.line()), F.lag("lon").over(kinematics.line()), F.col("lat"), F.col("lon"))
    far = kinematics.denoise_distance(kinematics.cumulative_m(track, step), p.least_step).withColumn("dist_m", F.col("clean_m"))
    even = kinematics.resample(far, ["lat", "lon", "trace_no"], p.spacing_m)
    segment = survey.distinct_in_order(even, "line_id", "line_id").select("line_id", F.col("rank").alias("segment"))
    placed = even.join(F.broadcast(segment), "line_id").withColumn("source", F.rint("trace_no").cast("long"))  # one row per segment
    samples = radar.cut_samples(traces, p.dt_ns, p.time_cut_ns or -1).select(F.col("trace_no").alias("source"), "samples")
    out = placed.join(samples, "source").select("segment", F.col("k").alias("trace_no"), "dist_m", "lat", "lon", "samples")
    return RunResult(out, {"positions": placed})


REGISTRY = Registry()
for _name, _apply, _params, _requires in (
    ("magbase", magbase, MagbaseParams, ("line_id", "seq", "t_ms", "lat", "lon")),
    ("flight_path_segmenter", flight_path_segmenter, SegmenterParams, ("line_id", "seq", "t_ms", "easting", "northing")),
    ("gamma_segmenter", gamma_segmenter, GammaSegmenterParams, ("line_id", "seq", "t_ms", "easting", "northing")),
    ("grid_interpolator", grid_interpolator, GridParams, ("grid_id", "x", "y", "z")),
    ("gamma_interpolator", gamma_interpolator, GammaGridParams, ("grid_id", "x", "y", "z")),
    ("anomaly_processor", anomaly_processor, AnomalyParams, ("grid_id", "iy", "ix", "value")),
    ("path_visualizer", path_visualizer, None, ("line_id", "seq", "easting", "northing")),
    ("statistical_anomaly", statistical_anomaly, StatisticalParams, ("line_id", "seq")),
    ("multispectral", multispectral, MultispectralParams, ()),
    ("radar_preprocessor", radar_preprocessor, RadarSurveyParams, ("trace_no", "samples")),
    ("radar_segment", radar_segment, RadarParams, ("segment", "trace_no", "samples")),
    ("radar_trace", radar_trace, RadarTraceParams, ("segment", "trace_no", "samples")),
):
    REGISTRY.register(Operator(_name, _apply, _params, _requires, (_apply.__doc__ or "").strip()))
