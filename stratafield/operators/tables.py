"""Browsing of tables: profile, search, slice, sample, bounds, quality filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from .frozen import frozen
from .quantiles import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def long_form(df: DataFrame, columns: list[str], name: str = "column_name", value: str = "value") -> DataFrame:
    """One row per (row, column) with the value as double; one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(F.inline(pairs))


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """mean, sample deviation, min, max, values and missing per numeric column."""
    cells = long_form(df, columns or numeric_columns(df)).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return cells.groupBy("column_name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"))


def summary(df: DataFrame) -> dict:
    return {"rows": df.count(), "columns": len(df.columns), "numeric": numeric_columns(df)}


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts over equal bins between min and max, the last one closed."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    placed = df.filter(F.col(column).isNotNull()).select(column).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1)))
    return placed.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cell_search(df: DataFrame, row: str, columns: list[str], needle: str, is_regex: bool = False, whole_word: bool = False, match_case: bool = False) -> DataFrame:
    """Places (row, column number) of cells whose text holds the needle; blank
    needles and patterns that don't compile find nothing."""
    pattern = needle if is_regex else re.escape(needle)
    if whole_word:
        pattern = rf"\b{pattern}\b"
    try:
        re.compile(pattern)
        usable = bool(needle.strip())
    except re.error:
        usable = False
    cells = df.select(F.col(row).alias("row"), F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("column_no", "cell"))
    found = cells.filter(F.col("cell").rlike(("" if match_case else "(?i)") + pattern)) if usable else cells.filter("false")
    return found.select("row", "column_no")


def step_result(current: int, n: int, by: int = 1) -> int | None:
    return (current + by) % n if n else None


def row_range(df: DataFrame, row: str, first: int, last: int) -> DataFrame:
    return df.filter(F.col(row).between(first, last))


def export_slice(df: DataFrame, row: str, columns: list[str], rows: str | tuple[int, int] | list[int] = "all") -> DataFrame:
    """Known columns of all rows, of a 1-based inclusive range, or of chosen
    0-based rows; an empty list of columns means all."""
    picked = [c for c in columns if c in df.columns] or [c for c in df.columns if c != row]
    if isinstance(rows, tuple):
        df = df.filter(F.col(row).between(rows[0] - 1, rows[1] - 1))
    elif isinstance(rows, list):
        df = df.filter(F.col(row).isin(sorted(set(rows))))
    return df.select(row, *[c for c in picked if c != row])


def export_size(rows: int, columns: int, kind: str) -> int:
    """Estimated bytes: 20 a cell, times the format's overhead (fixed values)."""
    return int(rows * columns * 20 * {"CSV": 1.1, "TSV": 1.1, "Excel": 1.5, "JSON": 2.0}.get(kind, 1.2))


def every_kth(df: DataFrame, row: str, k: int) -> DataFrame:
    return df.filter(F.pmod(F.col(row), F.lit(k)) == 0)


def sampling_step(n: int, most: int = 1000) -> int:
    return max(1, n // most)


def bounds(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def colour_range(df: DataFrame, columns: list[str], pooled: bool, sample: bool) -> DataFrame:
    """mean - 2 std to mean + 2 std, over all columns together or each alone."""
    cells = long_form(df, columns)
    std = F.stddev_samp("value") if sample else F.stddev_pop("value")
    low, high = (F.avg("value") - 2 * std).alias("vmin"), (F.avg("value") + 2 * std).alias("vmax")
    return cells.agg(low, high) if pooled else cells.groupBy("column_name").agg(low, high)


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as double, what is no number as null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def valid_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.col(lat) != 0) & (F.col(lon) != 0))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop("any", subset=columns)


def within(df: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def iqr_filter(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles (exact, linear)."""
    q = quantiles(df, column, [0.25, 0.75], "_q")
    span = F.col("_q")[1] - F.col("_q")[0]
    return df.crossJoin(F.broadcast(q)).filter(F.col(column).between(F.col("_q")[0] - k * span, F.col("_q")[1] + k * span)).drop("_q")  # one row


def gamma_quality(df: DataFrame, total: str, isotopes: list[str], height: str, low: float = 0, high: float = 50_000, floor: float = -1000) -> DataFrame:
    """Counts within limits, isotopes above ``floor``, height above 0."""
    keep = F.col(total).between(low, high) & (F.col(height) > 0)
    for c in isotopes:
        keep = keep & (F.col(c) > floor)
    return df.filter(keep)


def validate_survey(df: DataFrame, lat: str, lon: str, least: int = 10) -> list[str]:
    """Problems of a survey table: too few rows, coordinates out of range."""
    r = df.agg(F.count("*").alias("n"), F.min(F.col(lat).between(-90, 90)).alias("lat"), F.min(F.col(lon).between(-180, 180)).alias("lon")).first()
    problems = [f"{r['n']} rows, {least} needed"] if r["n"] < least else []
    return problems + [f"{name} out of range" for name, ok in ((lat, r["lat"]), (lon, r["lon"])) if ok is False]


def log_level(df: DataFrame, text: str, threshold: str) -> DataFrame:
    """Lines whose level (INFO where none is named) reaches the threshold."""
    levels = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
    named = F.regexp_extract(text, "(DEBUG|INFO|WARNING|ERROR|CRITICAL)", 1)
    level = F.when(named == "", "INFO").otherwise(named)
    return df.withColumn("level", level).filter(F.array_position(F.array(*map(F.lit, levels)), F.col("level")) > levels.index(threshold))


def with_row_id(df: DataFrame, order: list[str]) -> DataFrame:
    """Dense ``row_id`` from 0 by a total order, without gathering rows: ranges
    of the order are numbered by themselves and shifted by the earlier counts.
    The dealt rows are frozen first: counts and rows must see the same ranges."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    dealt = frozen(dealt).withColumns({"_part": F.shiftright("_mid", 33), "_in": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_mid")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(sizes), "_part").withColumn("row_id", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")
