"""Colours, names and groups of map layers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bucket limits and default ramp of graduated points.
COLOUR_CUTS = [0.167, 0.333, 0.5, 0.667, 0.833, 0.95]
COLOUR_RAMP = ["#000080", "#0000FF", "#00FFFF", "#00FF00", "#FFFF00", "#FF8000", "#FF0000"]
#: Fixed values: (level, red, green, blue) stops of the raster ramp; alpha 0.9.
RASTER_STOPS = [(0.0, 0.267, 0.004, 0.329), (0.2, 0.282, 0.140, 0.457), (0.4, 0.253, 0.265, 0.529), (0.6, 0.163, 0.471, 0.558), (0.8, 0.477, 0.741, 0.408), (1.0, 0.993, 0.906, 0.144)]
#: Words that name a layer, by where they are looked for, first hit wins.
TYPE_NAMES = [("anomal(y|ies)", "Anomalies"), ("grid|interpolated", "Interpolated Grid"), ("contour", "Contours"), ("flight|path", "Flight Path"), ("segment", "Segments"), ("processed", "Processed Data")]
SCRIPT_NAMES = [("magbase", "Magbase Data"), ("grid_interpolator", "Interpolated Grid"), ("anomaly", "Anomalies"), ("flight_path_segmenter", "Flight Segments"), ("basic_processing", "Basic Processing")]
LAYER_NAMES = [("anomal(y|ies)", "Anomalies"), ("grid|interp", "Interpolated Grid"), ("contour", "Contours"), ("flight|path|segment", "Flight Data"), ("proc", "Processed Data"), ("magbase|magnetic", "Magnetic Data")]
SENSORS = {"magnetic": "Magnetic Processing", "gpr": "GPR Processing", "gamma": "Gamma Processing", "multispectral": "Multispectral Processing"}
SOURCES = {"data_viewer": "Survey Data", "annotation": "Annotations"}
METADATA_GROUPS = [("field|date|time|walk|sample", "survey"), ("probe|voltage|temperature|firmware", "probe"), ("gps", "gps")]


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def colour_bucket(value: Column, low: Column, high: Column, ramp: list[str] = COLOUR_RAMP, plain: str = "#0066CC") -> Column:
    """Colour of the bucket that a value falls in; equal limits are the middle,
    a missing value has the plain colour."""
    level = F.when(high == low, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))
    out = F.lit(ramp[-1])
    for cut, colour in reversed(list(zip(COLOUR_CUTS, ramp, strict=False))):
        out = F.when(level < cut, colour).otherwise(out)
    return F.when(value.isNull() | F.isnan(value) | low.isNull() | high.isNull(), plain).otherwise(out)


def raster_colour(level: Column) -> Column:
    """Array (r, g, b, a), linear between the stops; missing is transparent."""
    def channel(i: int) -> Column:
        out = F.lit(RASTER_STOPS[-1][i])
        for a, b in reversed(list(zip(RASTER_STOPS, RASTER_STOPS[1:], strict=False))):
            out = F.when(level < b[0], a[i] + (level - a[0]) / (b[0] - a[0]) * (b[i] - a[i])).otherwise(out)
        return F.when(level <= 0, RASTER_STOPS[0][i]).otherwise(out)
    missing = level.isNull() | F.isnan(level)
    return F.when(missing, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(channel(1), channel(2), channel(3), F.lit(0.9)))


def geojson_point(lon: Column, lat: Column, properties: Column, colour: Column) -> Column:
    """One GeoJSON feature; missing properties stay as null."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        properties.withField("_point_color", colour).alias("properties"),
    )
    return F.to_json(feature, {"ignoreNullFields": "false"})


def layer_name(name: Column, data_type: Column, script: Column) -> Column:
    """Readable name from the data type, else the script, else words of the
    layer's own name, else that name cleaned of signs, time stamps and Output."""
    clean = F.initcap(F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(".csv"), F.lit("")))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, r"\d{8}[\s_]\d{6}", ""), r"\d{14}", ""), r"(?i)\bOutput\b", "")
    clean = F.trim(F.regexp_replace(clean, r"\s+", " "))
    base = F.element_at(F.split(script, "/"), -1)
    return F.coalesce(_first(data_type, TYPE_NAMES), _first(base, SCRIPT_NAMES), _first(name, LAYER_NAMES), F.when(clean != "", clean), F.lit("Layer Data"))


def layer_group(processor: Column, last_step: Column, source: Column, mode: str = "corrected") -> Column:
    """Group by processor, else by the last step's words, else by source.
    ``compat`` sends plain processing layers to "Other" like a missing group."""
    by_processor = F.lit(None).cast("string")
    for key, name in SENSORS.items():
        by_processor = F.when(F.lower(processor) == key, name).otherwise(by_processor)
    by_source = F.lit(None).cast("string")
    for key, name in (SOURCES | ({"processing": "Data Processing"} if mode == "corrected" else {})).items():
        by_source = F.when(source == key, name).otherwise(by_source)
    return F.coalesce(by_processor, _first(last_step, list(SENSORS.items())), by_source, F.lit("Other"))


def metadata_group(key: Column) -> Column:
    return F.coalesce(_first(key, METADATA_GROUPS), F.lit("other"))


def event_summary(timestamp: Column, kind: Column, data: Column) -> Column:
    """One line of history: clock time and what happened (``data`` is JSON)."""
    clock = F.when(timestamp.contains("T"), F.substring(F.substring_index(timestamp, "T", -1), 1, 8)).otherwise(F.substring(timestamp, 1, 8))
    field = lambda path: F.get_json_object(data, path)
    script = F.coalesce(field("$.metadata.execution_details.processing_script"), field("$.metadata.script_metadata.script"), field("$.metadata.script"), field("$.metadata.processing_script"), field("$.metadata.parameters.script_selection.script_name.value"), field("$.script_id"), F.lit("Unknown Script"))
    text = (
        F.when(kind == "project.created", F.concat(F.lit("Project Created: "), F.coalesce(field("$.project_name"), F.lit(""))))
        .when(kind == "project.loaded", "Project Loaded")
        .when(kind == "processing.started", F.concat(F.lit("Started: "), F.coalesce(field("$.script_id"), F.lit("Unknown Script"))))
        .when(kind == "processing.completed", F.concat(F.when(field("$.status") == "success", "Finished: ").otherwise("Failed: "), script))
        .otherwise(kind)
    )
    return F.concat(F.lit("["), F.coalesce(clock, F.lit("??:??:??")), F.lit("] "), text)


def default_style(rows: int, columns: list[str]) -> dict:
    """Point size and clustering by number of rows, colours by column words."""
    size = (4, True, 80) if rows > 10_000 else (5, True, 50) if rows > 1000 else (8, False, None)
    style = dict(zip(("point_size", "enable_clustering", "cluster_distance"), size, strict=True))
    names = " ".join(columns).lower()
    if "anomaly" in names:
        style["point_color"] = "#FF0000"
    elif "class" in names or "type" in names:
        style |= {"use_graduated_colors": True, "color_ramp": ["#0066CC", "#00CC66", "#FFCC00", "#FF6600", "#CC00CC"]}
    return style


def human_size(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"
