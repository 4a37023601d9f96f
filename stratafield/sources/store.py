"""Layer store and project bundle: parquet data beside JSON registries."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


class UnsupportedFormat(Exception):
    """A format that needs a library which is not installed."""


def excel_table(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise UnsupportedFormat(f"Excel needs openpyxl: {path}") from e
    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def checksum(df: DataFrame) -> str:
    """Order-free digest of a table: sum of row hashes, with the row count."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{df.columns}:{row['n']}:{row['h']}".encode()).hexdigest()


def save_layer(df: DataFrame, folder: str, name: str, **entry) -> dict:
    """Write a layer's table; returns its registry entry."""
    path = f"{folder}/layers/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return {"name": name, "data": f"layers/{name}.parquet", "checksum": checksum(df.sparkSession.read.parquet(path)), "layer_type": "points", "geometry": "point", "source": "import"} | entry


def load_layer(spark: SparkSession, folder: str, entry: dict, verify: bool = False) -> DataFrame:
    if not entry["data"].endswith(".parquet"):
        raise UnsupportedFormat(f"layer data is not parquet: {entry['data']}")
    df = spark.read.parquet(f"{folder}/{entry['data']}")
    if verify and checksum(df) != entry["checksum"]:
        raise ValueError(f"layer {entry['name']}: checksum differs")
    return df


def save_bundle(path: str, folder: str, metadata: dict, project: dict, map_state: dict, entries: list[dict]) -> None:
    """A bundle from a local folder of layers, put in place in one step."""
    own = f"{path}.{os.getpid()}.tmp"
    with zipfile.ZipFile(own, "w", zipfile.ZIP_DEFLATED) as out:
        for name, value in (("metadata.json", {"version": "1.0"} | metadata), ("project.json", project), ("map_state.json", map_state), ("layers/layer_registry.json", entries)):
            out.writestr(name, json.dumps(value))
        for entry in entries:
            base = os.path.join(folder, entry["data"])
            for top, _, names in os.walk(base):
                for n in names:
                    full = os.path.join(top, n)
                    out.write(full, os.path.relpath(full, folder))
    os.replace(own, path)


def load_bundle(path: str, folder: str) -> dict:
    """Unpack a bundle to a folder (members that would leave it are refused);
    returns its JSON parts by name."""
    with zipfile.ZipFile(path) as held:
        root = os.path.abspath(folder)
        for n in held.namelist():
            if not os.path.abspath(os.path.join(root, n)).startswith(root + os.sep):
                raise ValueError(f"unsafe path in bundle: {n}")
        held.extractall(root)
        return {n: json.loads(held.read(n)) for n in held.namelist() if n.endswith(".json")}


def describe_file(path: str) -> dict:
    """Kind and size figures of a JSON, text, Python or PNG file (its head only
    for text)."""
    kind = path.rpartition(".")[2].lower()
    if kind == "json":
        with open(path) as f:
            value = json.load(f)
        return {"type": "object" if isinstance(value, dict) else "array", "items": len(value), "keys": list(value)[:5] if isinstance(value, dict) else []}
    if kind == "py":
        import ast

        with open(path) as f:
            nodes = list(ast.walk(ast.parse(f.read())))
        return {"functions": sum(isinstance(n, ast.FunctionDef) for n in nodes), "classes": sum(isinstance(n, ast.ClassDef) for n in nodes), "imports": sum(isinstance(n, (ast.Import, ast.ImportFrom)) for n in nodes)}
    with open(path, "rb") as f:
        head = f.read(64 << 10)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return {"width": int.from_bytes(head[16:20], "big"), "height": int.from_bytes(head[20:24], "big")}
    from .delimited import count_delimiters, find_delimiter, is_number

    lines = head.decode("utf-8", "replace").splitlines()
    sep = find_delimiter(lines)
    numeric = any(sum(is_number(c) for c in x.split(sep)) >= 3 for x in lines)
    return {"delimiter": sep if any(map(count_delimiters, lines)) else None, "numeric": numeric}


def config_json(params) -> str:
    """Parameters of an operator as JSON; tables among them are left out."""
    values = asdict(params) if is_dataclass(params) and not any(isinstance(v, DataFrame) for v in vars(params).values()) else {k: v for k, v in vars(params).items() if not isinstance(v, DataFrame)}
    return json.dumps(values)


def config_from_json(kind: type, text: str):
    held = json.loads(text)
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items() if k in kind.__dataclass_fields__})
