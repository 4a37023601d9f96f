"""Delimited logger files: sniff the head on the driver, scan with Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

DELIMITERS = ";,\t|"
HEAD = 400


def head(spark: SparkSession, path: str, n: int = HEAD) -> list[str]:
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]  # a look at the head, never the data


def count_delimiters(line: str) -> int:
    return sum(line.count(d) for d in DELIMITERS)


def find_header(lines: list[str]) -> tuple[int, dict[str, str]]:
    """Line number of the header and the ``key: value`` metadata before it.

    The header has three or more delimiters and a first cell with "timestamp".
    Without one, data starts at the first line of five or more delimiters whose
    cells are numbers to 60 per cent; else at line 0."""
    metadata = {}
    for i, line in enumerate(lines):
        first = re.split(f"[{DELIMITERS}]", line)[0].lower()
        if count_delimiters(line) >= 3 and "timestamp" in first:
            return i, metadata
        if ":" in line and ("=" not in line or "[" in line):
            key, _, value = line.partition(":")
            metadata[key.strip()] = value.strip().rstrip(DELIMITERS)
    for i, line in enumerate(lines):
        cells = re.split(f"[{DELIMITERS}]", line)
        if count_delimiters(line) >= 5 and sum(is_number(c) for c in cells) >= 0.6 * len(cells):
            return i, metadata
    return 0, metadata


def is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def find_delimiter(lines: list[str]) -> str:
    """The delimiter seen most often in the next five lines, in order ; , tab |."""
    counts = {d: sum(x.count(d) for x in lines[:5]) for d in DELIMITERS}
    return max(counts, key=counts.get) if any(counts.values()) else ";"


def drop_blank_columns(df: DataFrame) -> DataFrame:
    """Columns without a single non-blank character go; one pass over the data."""
    if not df.columns:
        return df
    seen = df.agg(*[F.max(F.length(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))))).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if seen[i]])


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of a file.  Spark's text source reads UTF-8 only; for other
    encodings the CSV source is used with a separator that no text holds."""
    if encoding == "UTF-8":
        return spark.read.text(path)
    return spark.read.schema("value string").option("encoding", encoding).option("sep", "\u0001").option("quote", "").csv(path)


def numbered_lines(lines: DataFrame, skip: int) -> DataFrame:
    """Lines that are not blank, without the first ``skip`` of each file, with
    ``_row_id``: dense from 0 in the order of files and lines.  Lines are numbered
    within the blocks in which files are read; blocks are shifted by the counts
    before them, so no line moves."""
    seen = lines.filter(F.length(F.trim("value")) > 0).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    seen = seen.withColumn("_mid", F.monotonically_increasing_id())
    blocks = seen.groupBy("_file", "_block").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))  # one row per block of a file
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
    blocks = blocks.withColumn("_kept", F.col("_n") - F.least(F.col("_n"), F.greatest(F.lit(0), skip - F.col("_before"))))
    whole = Window.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_kept").over(whole), F.lit(0)) - (F.col("_n") - F.col("_kept")))
    placed = seen.join(F.broadcast(blocks), ["_file", "_block"])
    at = F.col("_mid") - F.col("_first")
    return placed.filter(F.col("_before") + at >= skip).select("value", (F.col("_base") + at).alias("_row_id"))


def load(spark: SparkSession, path: str, row_id: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """Table (with a dense ``_row_id`` in file order) and metadata of one file, or
    of a folder of files with one layout; falls back to Latin-1 where the head is
    not UTF-8."""
    lines = head(spark, path)
    encoding = "ISO-8859-1" if any("�" in x for x in lines) else "UTF-8"
    start, metadata = find_header(lines)
    sep = find_delimiter(lines[start:])
    has_names = not all(is_number(c) or not c for c in lines[start].split(sep)) if lines else False
    names = [c.strip() or f"_c{i}" for i, c in enumerate(lines[start].split(sep))] if has_names else [f"c{i}" for i in range(len(lines[start].split(sep)) if lines else 0)]
    if not names:
        return spark.createDataFrame([], "_row_id long"), metadata
    unique = [c if names.index(c) == i else f"{c}_{i}" for i, c in enumerate(names)]
    skip = sum(bool(x.strip()) for x in lines[:start]) + has_names
    numbered = numbered_lines(_lines(spark, path, encoding), skip)
    cells = F.split("value", re.escape(sep))
    table = numbered.select("_row_id", *[F.trim(F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(unique)])
    kept = drop_blank_columns(table.drop("_row_id"))
    return table.select(*(["_row_id"] if row_id else []), *[F.col(f"`{c}`") for c in kept.columns]), metadata


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """Plain text table: the first of comma, tab, space and semicolon that gives
    more than one column."""
    first = head(spark, path, 1)
    sep = next((s for s in ",\t ;" if first and len(first[0].split(s)) > 1), ",")
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def profile(spark: SparkSession, path: str) -> dict:
    """Columns, first names, rows and kinds of a CSV file."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double")]
    return {"columns": len(df.columns), "names": df.columns[:5], "rows": df.count(), "numeric": len(numeric), "text": len(df.columns) - len(numeric)}
