"""Where intermediate tables live: the folder that every executor shares.

The folder is the session's ``spark.checkpoint.dir``, else the context's
checkpoint folder.  Where there is neither, a local master (tests, a laptop) gets
a fresh temporary folder; any other master is refused, as a folder of the
driver's machine would be wrong there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stratafield-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it.

    This cuts the lineage: a lost executor costs a re-read, never a second run
    of what stands above.  It also freezes anything that depends on how rows
    were dealt to tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like ``materialize``, bucketed by ``key``: a later join or cogroup on the
    key reads the table as it lies and shuffles the other side alone."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)  # resolved here, with its buckets
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry alone: the files are external
    return table


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
