"""Survey-shaped views of the test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratafield.functions.clock import epoch_ms


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumns({"t_ms": epoch_ms("ts"), "k": F.get_json_object("props", "$.k").cast("long")})


def track(spark: SparkSession, sf: str) -> DataFrame:
    """One line per user: seq, t_ms, k, easting, northing, field."""
    rows = events(spark, sf).select(F.col("user_id").alias("line_id"), "ts", "event_id", "event_type", "t_ms", "k", F.col("value").alias("field"))
    seq = (F.row_number().over(Window.partitionBy("line_id").orderBy("ts", "event_id")) - 1).cast("long")  # by the name that later windows use: one shuffle serves all
    rows = rows.select("line_id", seq.alias("seq"), "event_id", "event_type", "t_ms", "k", "field")
    return rows.withColumns({"easting": F.lit(500000.0) + 10 * F.col("seq") + F.col("k") / 10.0, "northing": F.lit(7000000.0) + F.col("field")})


def walk(spark: SparkSession, sf: str) -> DataFrame:
    """Track with sensor axes and positions known at GPS rows only."""
    fix = F.col("event_type").isin("view", "signup")
    return track(spark, sf).withColumns({"bx": F.col("field"), "by": F.col("k").cast("double"), "bz": F.sqrt("field"), "fix": fix, "lat": F.when(fix, 60 + F.col("k") / 100.0), "lon": F.when(fix, 10 + F.col("field") / 1000.0)})


def gamma(spark: SparkSession, sf: str) -> DataFrame:
    return track(spark, sf).withColumns({"countrate": F.col("field"), "u238": F.col("field") * F.col("k") / 100.0, "height": F.col("k").cast("double"), "total": 10.0 * F.col("k")})


def bands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_quantity").alias("blue"), F.col("l_discount").alias("green"), F.col("l_tax").alias("red"), F.col("l_extendedprice").alias("nir"), "l_returnflag")


def points(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("grid_id"), ((key * 7919) % 1000 / 1000.0).alias("x"), ((key * 104729) % 1000 / 1000.0).alias("y"), F.col("c_acctbal").alias("z"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("segment"), "vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    number = (F.row_number().over(Window.partitionBy("segment").orderBy("vec_id")) - 1).cast("long")
    return rows.select("segment", number.alias("trace_no"), "samples")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    cells = traces(spark, sf).select(F.col("segment").alias("grid_id"), F.col("trace_no").cast("int").alias("iy"), F.posexplode("samples").alias("ix", "value"))
    return cells.select("grid_id", "iy", "ix", "value")


def layers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(key / n) % len(values) + 1).cast("int"))
    return table(spark, sf, "orders").select(
        key.cast("long").alias("position"),
        F.concat(pick(["survey_", "grid_", "my_contour_", "walk.csv_", "flight_", "raw_Output_"], 1), key.cast("string")).alias("name"),
        pick(["", "anomaly map", "", "segment", "", ""], 3).alias("data_type"),
        pick(["", "x/magbase.py", "", "a/b/grid_interpolator.py"], 5).alias("script"),
        pick(["magnetic", "", "gamma", ""], 2).alias("processor"),
        pick(["", "gpr filter", ""], 7).alias("last_step"),
        pick(["data_viewer", "processing", "annotation", "import"], 4).alias("source"),
        (key % 7).cast("long").alias("z_index"),
        (key % 3 != 0).alias("is_visible"),
        F.concat(F.lit("run"), (key % 11).cast("string")).alias("run_id"),
    )


SQL = {
    "track0": """track0 AS (SELECT user_id AS line_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq, event_id,
        event_type, epoch_us(ts) // 1000 AS t_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS field FROM events)""",
    "track": "track AS (SELECT *, 500000.0::DOUBLE + 10 * seq + k / 10.0::DOUBLE AS easting, 7000000.0::DOUBLE + field AS northing FROM track0)",
    "walk": """walk AS (SELECT *, field AS bx, CAST(k AS DOUBLE) AS "by", sqrt(field) AS bz, event_type IN ('view', 'signup') AS fix,
        CASE WHEN event_type IN ('view', 'signup') THEN 60 + k / 100.0::DOUBLE END AS lat, CASE WHEN event_type IN ('view', 'signup') THEN 10 + field / 1000.0::DOUBLE END AS lon FROM track)""",
    "bands": "bands AS (SELECT l_quantity AS blue, l_discount AS green, l_tax AS red, l_extendedprice AS nir, l_returnflag FROM lineitem)",
    "points": "points AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS grid_id, ((c_custkey * 7919) % 1000) / 1000.0::DOUBLE AS x, ((c_custkey * 104729) % 1000) / 1000.0::DOUBLE AS y, c_acctbal AS z FROM customer)",
    "traces": "traces AS (SELECT CAST(label AS BIGINT) AS segment, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS trace_no, CAST(embedding AS DOUBLE[]) AS samples FROM embeddings)",
    "cells": "cells AS (SELECT segment, trace_no, CAST(k - 1 AS BIGINT) AS k, samples[k] AS value FROM (SELECT segment, trace_no, samples, unnest(range(1, len(samples) + 1)) AS k FROM traces))",
    "heads": """heads0 AS (SELECT *, degrees(atan2(easting - lag(easting) OVER w, northing - lag(northing) OVER w)) AS h0 FROM track WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
        heads1 AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h1 FROM heads0),
        heads AS (SELECT *, coalesce(h1, lead(h1) OVER (PARTITION BY line_id ORDER BY seq), 0.0) AS heading FROM heads1)""",
    "speeds": """speeds0 AS (SELECT *, sqrt(pow(lag(easting) OVER w - easting, 2) + pow(lag(northing) OVER w - northing, 2)) / CASE WHEN t_ms = lag(t_ms) OVER w THEN 1e-6 ELSE (t_ms - lag(t_ms) OVER w) / 1000.0::DOUBLE END AS v0 FROM heads WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
        speeds AS (SELECT *, coalesce(v0, lead(v0) OVER (PARTITION BY line_id ORDER BY seq), 0.0) AS speed FROM speeds0)""",
    "changes": """changes0 AS (SELECT *, least(abs(lead(heading) OVER w - heading), 360 - abs(lead(heading) OVER w - heading)) AS d0 FROM speeds WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
        changes AS (SELECT *, coalesce(d0, lag(d0) OVER (PARTITION BY line_id ORDER BY seq), 0.0) AS heading_change FROM changes0)""",
    "stable": "stable AS (SELECT *, (sum(heading_change) OVER w + 999.0 * (5 - count(heading_change) OVER w)) / 5 AS stability FROM changes WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))",
    "runs": """flags AS (SELECT *, stability < 75 AND speed > 0 AS ok FROM stable),
        marks AS (SELECT *, sum(CASE WHEN ok <> coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY seq) AS island FROM (SELECT *, lag(ok) OVER (PARTITION BY line_id ORDER BY seq) AS prev FROM flags)),
        runs AS (SELECT line_id, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n_rows, degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) AS m0 FROM marks WHERE ok GROUP BY line_id, island HAVING count(*) >= 4)""",
    "members": """members AS (SELECT s.line_id, s.seq, s.heading, s.t_ms, r.start_seq, r.end_seq, r.m0,
        ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(((r.m0 + 720 + 22.5) % 360) / 45) AS INTEGER) + 1] AS direction FROM stable s JOIN runs r ON s.line_id = r.line_id AND s.seq BETWEEN r.start_seq AND r.end_seq)""",
    "layers": """layers AS (SELECT o_orderkey AS position,
        ['survey_', 'grid_', 'my_contour_', 'walk.csv_', 'flight_', 'raw_Output_'][o_orderkey % 6 + 1] || o_orderkey AS name,
        ['', 'anomaly map', '', 'segment', '', ''][(o_orderkey // 3) % 6 + 1] AS data_type, ['', 'x/magbase.py', '', 'a/b/grid_interpolator.py'][(o_orderkey // 5) % 4 + 1] AS script,
        ['magnetic', '', 'gamma', ''][(o_orderkey // 2) % 4 + 1] AS processor, ['', 'gpr filter', ''][(o_orderkey // 7) % 3 + 1] AS last_step,
        ['data_viewer', 'processing', 'annotation', 'import'][(o_orderkey // 4) % 4 + 1] AS source, o_orderkey % 7 AS z_index, o_orderkey % 3 <> 0 AS is_visible, 'run' || (o_orderkey % 11) AS run_id FROM orders)""",
}
CHAIN = {"track": ["track0"], "walk": ["track"], "heads": ["track"], "speeds": ["heads"], "changes": ["speeds"], "stable": ["changes"], "runs": ["stable"], "members": ["runs"], "cells": ["traces"]}


def sql(view: str, body: str, *more: str) -> str:
    """``body`` over a view (and further ones) with all that they rest on."""
    need: list[str] = []

    def add(name: str) -> None:
        for below in CHAIN.get(name, []):
            add(below)
        if name not in need:
            need.append(name)

    for name in (view, *more):
        if name:
            add(name)
    return "WITH " + ",\n".join(SQL[n] for n in need) + "\n" + body if need else body


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"
