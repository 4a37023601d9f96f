"""Streaming twins of the track operators.  An extension: batch results are the
reference, a stream gives the same rows as its watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_logger(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";") -> DataFrame:
    """Logger CSV files of a folder as a stream."""
    return spark.readStream.schema(schema).option("sep", sep).option("header", True).csv(path)


def flight_lines(rows: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Flight lines as session windows: rows of a line with no longer gap.
    Works on a stream (with watermark) and on a table."""
    timed = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return timed.groupBy("line_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_rows"), F.avg("field").alias("mean_field")).select("line_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_rows", "mean_field")


def rates(rows: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and mean field by tumbling or sliding windows."""
    timed = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return timed.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n_rows"), F.avg("field").alias("mean_field")).select(F.col("w.start").alias("start"), "n_rows", "mean_field")


def with_base(rows: DataFrame, base: DataFrame, seconds: int = 1) -> DataFrame:
    """Stream-static correction: the base table's mean per time step."""
    step = lambda ts: F.floor(F.unix_timestamp(ts) / seconds)
    levels = base.groupBy(step("ts").alias("_step")).agg(F.avg("nT").alias("base_nT"))
    return rows.withColumn("_step", step("ts")).join(levels, "_step", "left").drop("_step").withColumn("residual", F.col("field") - F.col("base_nT"))
