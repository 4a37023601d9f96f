"""JSON, history and bundle sources, and result sinks."""

from __future__ import annotations

import json
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

HISTORY = "event_id string, timestamp string, event_type string, event_data string"
#: Files that a bundle must hold.
REQUIRED = ("metadata.json", "project.json", "map_state.json")


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns named a.b.c; arrays stay."""

    def walk(kind: StructType, at: str, name: str) -> list[Column]:
        out = []
        for f in kind.fields:
            path, label = f"{at}`{f.name}`", f"{name}{f.name}"
            out += walk(f.dataType, path + ".", label + ".") if isinstance(f.dataType, StructType) else [F.col(path).alias(label)]
        return out

    return df.select(*walk(df.schema, "", ""))


def json_table(spark: SparkSession, path: str) -> DataFrame:
    return flatten(spark.read.option("multiLine", True).json(path))


def is_nested(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, (StructType, ArrayType)) for f in df.schema)


def json_tree(value, path: str = "$", cut: int = 100) -> list[tuple[str, str, str]]:
    """(path, text, type) of a parsed document; containers show their size."""
    if isinstance(value, (dict, list)):
        items = list(value.items() if isinstance(value, dict) else enumerate(value))
        rows = [(path, f"{len(items)} items", type(value).__name__)]
        for k, v in items:
            rows += json_tree(v, f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", cut)
        return rows
    text = str(value)
    return [(path, text[:cut] + "..." if len(text) > cut else text, type(value).__name__)]


def count_items(value) -> int:
    """Entries of a container plus the counts of its children; a leaf is one."""
    if isinstance(value, dict):
        value = list(value.values())
    return len(value) + sum(map(count_items, value)) if isinstance(value, list) else 1


def history(spark: SparkSession, path: str) -> DataFrame:
    """Events newest first; lines that are no JSON are skipped; ``event_data``
    stays JSON text."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), "value")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    events = rows.select("seq", *[field(c.split()[0]).alias(c.split()[0]) for c in HISTORY.split(", ")])
    return events.filter("event_type IS NOT NULL").orderBy(F.desc("seq")).drop("seq")


def append_history(spark: SparkSession, path: str, events: list[dict]) -> None:
    spark.createDataFrame([(json.dumps(e),) for e in events], "value string").coalesce(1).write.mode("append").text(path)


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Result as csv, tsv, json (records) or parquet; unknown kinds as csv."""
    writer = df.write.mode("overwrite")
    if kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    elif kind == "tsv":
        writer.option("header", True).option("sep", "\t").csv(path)
    else:
        writer.option("header", True).csv(path)


def write_labels(rows: DataFrame, path: str) -> None:
    """segment, lat, lon and trace number from 0 per segment: tabs, no header."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("segment").orderBy("trace_no")) - 1
    rows.select("segment", "lat", "lon", number.alias("traceNr")).write.mode("overwrite").option("sep", "\t").csv(path)


def write_segments(rows: DataFrame, path: str, directions: list[str] | None = None) -> None:
    """Segment rows by direction (all, or the named ones)."""
    kept = rows if directions is None else rows.filter(F.col("direction").isin(directions))
    kept.write.mode("overwrite").partitionBy("direction").option("header", True).csv(path)


def write_grid(grid: DataFrame, path: str) -> None:
    grid.filter("value IS NOT NULL").select("x", "y", "value").write.mode("overwrite").option("header", True).csv(path)


def result_name(stem: str, processor: str, script: str, stamp: str, kind: str) -> str:
    return str(PurePosixPath("processed") / processor / f"{stem}_{processor}_{script}_{stamp}.{kind}")


def check_bundle(path: str) -> list[str]:
    """Problems of a project bundle: not an archive, files missing, values out
    of range."""
    if not zipfile.is_zipfile(path):
        return ["not a zip archive"]
    problems = []
    with zipfile.ZipFile(path) as held:
        names = set(held.namelist())
        problems += [f"missing {n}" for n in REQUIRED if n not in names]
        read = lambda n: json.loads(held.read(n)) if n in names else {}
        try:
            meta, state = read("metadata.json"), read("map_state.json")
        except ValueError as e:
            return [*problems, f"broken JSON: {e}"]
    if "metadata.json" in names and meta.get("version") != "1.0":
        problems.append("unknown version")
    for key, low, high in (("latitude", -90, 90), ("longitude", -180, 180), ("zoom", 0, 25)):
        if key in state and not low <= state[key] <= high:
            problems.append(f"{key} out of range")
    return problems


def repair_bundle(path: str, out: str) -> list[str]:
    """A copy of a bundle with empty required files added; their names."""
    with zipfile.ZipFile(path) as held, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        names = held.namelist()
        for n in names:
            new.writestr(n, held.read(n))
        missing = [n for n in REQUIRED if n not in names]
        for n in missing:
            new.writestr(n, json.dumps({"version": "1.0"} if n == "metadata.json" else {}))
    return missing


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size and time of files, newest first; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("size"), "modificationTime").orderBy(F.desc("modificationTime"), "path")
