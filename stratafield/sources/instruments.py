"""Instrument files: base-station text, drone logs, positions, SEG-Y, NPZ."""

from __future__ import annotations

import io
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratafield.functions.clock import seconds_of_day




def base_station(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Base-station text: lines that begin with / are head, the last of them
    names the columns if it holds the delimiter; else the first data line does
    where its first cell is no number; else time, nT, sq.  ``time`` stays text,
    other columns become double, lines of one cell are skipped."""
    top = [r["value"] for r in spark.read.text(path).limit(200).collect()]
    marked = [x.lstrip("/ ").strip() for x in top if x.startswith("/")]
    data = [x for x in top if x.strip() and not x.startswith("/")]
    names, skip = ["time", "nT", "sq"], None
    if marked and sep in marked[-1]:
        names = [c.strip() for c in marked[-1].split(sep)]
    elif data and not re.match(r"\s*[0-9.+-]", data[0]):
        names, skip = [c.strip() for c in data[0].split(sep)], data[0]
    if not any(c == "nT" or "nt" in c.lower() or "magnetic" in c.lower() for c in names):
        raise ValueError("base station: no nT column")
    lines = spark.read.text(path).filter(~F.col("value").startswith("/") & (F.length(F.trim("value")) > 0))
    if skip is not None:
        lines = lines.filter(F.col("value") != skip)
    cells = F.split("value", re.escape(sep))
    value = lambda i, c: F.trim(F.get(cells, F.lit(i))) if c == "time" else F.trim(F.get(cells, F.lit(i))).try_cast("double")
    return lines.filter(F.size(cells) >= 2).select(*[value(i, c).alias(c) for i, c in enumerate(names)])


def system_log(spark: SparkSession, path: str) -> DataFrame:
    """Waypoints of a drone's log: survey_no, t_s, text.  A survey begins at
    waypoint 1 and ends with the last waypoint reached."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"), F.input_file_name().alias("file"))
    parsed = lines.select("file", "line_no", F.regexp_extract("value", r"^\[(\d\d:\d\d:\d\d\.\d{3})\]", 1).alias("clock"), F.regexp_extract("value", r"^\[[^\]]*\]\s*(.*)$", 1).alias("text"))
    points = parsed.filter(F.col("text").rlike(r"Going to waypoint #\d+|Last waypoint reached"))
    starts = F.col("text").rlike(r"waypoint #1\b").cast("int")
    survey = F.sum(starts).over(Window.partitionBy("file").orderBy("line_no"))
    return points.withColumn("survey_no", survey).filter("survey_no > 0").select("file", "survey_no", "line_no", seconds_of_day(F.col("clock")).alias("t_s"), "text")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Position CSV of either layout: rows with a trace number other than 0,
    without the newer layout's bookkeeping columns."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    trace = next((c for c in df.columns if c in ("GPR:Trace", "zGPR:Trace")), None)
    if trace:
        df = df.filter(F.col(f"`{trace}`").isNotNull() & (F.col(f"`{trace}`") != 0))
    extra = [c for c in df.columns if c.startswith("OBS:") or c == "ALT:ID"]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in extra])


def ibm_floats(raw: np.ndarray) -> np.ndarray:
    """IBM 32-bit floats (big-endian unsigned) as double."""
    sign = np.where(raw >> 31, -1.0, 1.0)
    exponent = ((raw >> 24) & 0x7F).astype(int) - 64
    return sign * (raw & 0xFFFFFF) / 2.0**24 * 16.0**exponent


#: SEG-Y sample formats that are read, by code.
FORMATS = {1: ">u4", 2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}


def parse_segy(data: bytes) -> tuple[float, np.ndarray]:
    """Sampling interval in ns (header microseconds / 1000) and traces by row."""
    interval, count, code = (int.from_bytes(data[3200 + a : 3202 + a], "big") for a in (16, 20, 24))
    kind = np.dtype(FORMATS[code])
    size = 240 + count * kind.itemsize
    n = (len(data) - 3600) // size
    body = np.frombuffer(data, np.uint8, n * size, 3600).reshape(n, size)[:, 240:]
    values = np.ascontiguousarray(body).view(kind).reshape(n, count)
    return interval * 0.001, ibm_floats(values.astype(np.uint32)) if code == 1 else values.astype(float)


def segy(spark: SparkSession, path: str) -> DataFrame:
    """file, trace_no, dt_ns, samples: a file is one binary row, its traces are
    sent on in batches."""

    def run(frames):
        for f in frames:
            for path_, content in zip(f["path"], f["content"], strict=True):
                dt, traces = parse_segy(content)
                for a in range(0, len(traces), 500):
                    part = traces[a : a + 500]
                    yield pd.DataFrame({"file": path_, "trace_no": np.arange(a, a + len(part)), "dt_ns": dt, "samples": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, trace_no long, dt_ns double, samples array<double>")


def npz_table(spark: SparkSession, path: str) -> DataFrame:
    """The largest array of each archive as rows (file, row_no, values); objects
    are never unpickled."""

    def run(frames):
        for f in frames:
            for path_, content in zip(f["path"], f["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    arrays = [held[k] for k in held.files if held[k].dtype.kind in "fiub"]
                best = max(arrays, key=lambda a: a.size, default=np.zeros((0, 0)))
                rows = np.atleast_2d(best.T).T.reshape(best.shape[0] if best.ndim else 1, -1)
                for a in range(0, len(rows), 5000):
                    part = rows[a : a + 5000].astype(float)
                    yield pd.DataFrame({"file": path_, "row_no": np.arange(a, a + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row_no long, values array<double>")


def radar_project(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """Radar project archive: configuration, positions (row_no, values) and
    traces (segment, trace_no, dist_m, samples)."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with np.load(io.BytesIO(content), allow_pickle=False) as held:
        config = json.loads(str(held["config"])) if "config" in held.files else {}
        config["columns"] = [str(c) for c in held["df_Pos_columns"]] if "df_Pos_columns" in held.files else []

    def read(frames):
        for f in frames:
            for data in f["content"]:
                with np.load(io.BytesIO(data), allow_pickle=False) as held:
                    for name in held.files:
                        if found := re.fullmatch(r"gprProfile_array_(\d+)", name):
                            profile, dist = held[name], held[f"distVec_array_{found[1]}"]
                            yield pd.DataFrame({"segment": int(found[1]), "trace_no": np.arange(profile.shape[1]), "dist_m": dist.astype(float), "samples": list(profile.T.astype(float))})

    def place(frames):
        for f in frames:
            for data in f["content"]:
                with np.load(io.BytesIO(data), allow_pickle=False) as held:
                    table = held["df_Pos"].astype(float)
                yield pd.DataFrame({"row_no": np.arange(len(table)), "values": list(table)})

    archive = spark.read.format("binaryFile").load(path).select("content")
    return config, archive.mapInPandas(place, "row_no long, values array<double>"), archive.mapInPandas(read, "segment int, trace_no long, dist_m double, samples array<double>")
