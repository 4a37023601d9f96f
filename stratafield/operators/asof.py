"""Nearest-in-time joins.

Rows are dealt by (key, time bucket), never to one task: within a bucket the
neighbours come from windows, and what lies beyond the bucket's ends comes from
a table with one row per bucket that has base rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def nearest(observations: DataFrame, base: DataFrame, value: str, time: str = "t_ms", by: list[str] | None = None, bucket: int = 3_600_000, direction: str = "nearest") -> DataFrame:
    """``observations`` with ``base_t`` and ``base_<value>`` of the base row
    nearest in integral ``time``; of two equally near the earlier wins.  With
    ``direction="backward"`` the last one not later.  Of base rows of one time
    the smallest value counts."""
    by = by or []
    record = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    single = base.groupBy(*by, time).agg(F.min(value).alias(value)).withColumn("_bucket", F.floor(F.col(time) / bucket))
    nothing = F.lit(None).cast(single.select(record.alias("r")).schema["r"].dataType)
    edges = single.groupBy(*by, "_bucket").agg(F.min(record).alias("_head"), F.max(record).alias("_tail"))
    left = observations.withColumns({"_bucket": F.floor(F.col(time) / bucket), "_base": nothing, "_head": nothing, "_tail": nothing, "_kind": F.lit(0)})
    right = single.select(*by, time, "_bucket", record.alias("_base")).withColumn("_kind", F.lit(1))
    inside = Window.partitionBy(*by, "_bucket").orderBy(time)
    both = left.drop("_head", "_tail").unionByName(right, allowMissingColumns=True)
    near = both.withColumns({"_lo": F.last("_base", True).over(inside.rangeBetween(Window.unboundedPreceding, -1)), "_hi": F.first("_base", True).over(inside.rangeBetween(0, Window.unboundedFollowing))}).filter("_kind = 0")
    # one row per bucket in use: the last record before and the first one after
    used = left.select(*by, "_bucket").distinct().join(edges, [*by, "_bucket"], "full")
    order = Window.partitionBy(*by).orderBy("_bucket") if by else Window.partitionBy(F.lit(0)).orderBy("_bucket")
    beyond = used.select(*by, "_bucket", F.last("_tail", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_head", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    met = near.join(beyond, [*by, "_bucket"], "left").withColumns({"_lo": F.coalesce("_lo", "_before"), "_hi": F.coalesce("_hi", "_after")})
    nearer = F.col("_hi.t") - F.col(time) < F.col(time) - F.col("_lo.t")
    if direction == "backward":
        pick = F.when(F.col("_hi.t") == F.col(time), F.col("_hi")).otherwise(F.col("_lo"))
    else:
        pick = F.when(F.col("_lo").isNull() | nearer, F.col("_hi")).otherwise(F.coalesce("_lo", "_hi"))
    out = met.withColumn("_pick", pick)
    return out.select(*observations.columns, F.col("_pick.t").alias("base_t"), F.col("_pick.v").alias(f"base_{value}"))


def diurnal(observations: DataFrame, base: DataFrame, **options) -> DataFrame:
    """Residuals of both sensors against the nearest base reading ``nT`` and
    their vertical gradient; without a base value the gradient is taken of the
    totals themselves."""
    met = nearest(observations, base, "nT", **options)
    r1, r2 = F.col("btotal1") - F.col("base_nT"), F.col("btotal2") - F.col("base_nT")
    return met.withColumns({"r1": r1, "r2": r2, "va": F.coalesce(r1 - r2, F.col("btotal1") - F.col("btotal2"))})


def waypoint_rows(waypoints: DataFrame, rows: DataFrame, time: str = "t_ms", order: str = "row_id") -> DataFrame:
    """For each waypoint the row nearest in time, the first on ties: the as-of
    join finds the nearest times, an equi-join their first rows."""
    met = nearest(waypoints, rows.select(time, F.col(time).alias("t")), "t", time=time)
    first = rows.groupBy(F.col(time).alias("base_t")).agg(F.min(order).alias(order))
    return met.join(first, "base_t").drop("base_t").withColumnRenamed("base_t", "row_t")


def first_rows(wanted: DataFrame, rows: DataFrame, key: str, order: str = "row_id") -> DataFrame:
    """First row of each wanted key; keys without rows are left out."""
    return wanted.join(rows.groupBy(key).agg(F.min(order).alias(order)), key)


def update_rows(old: DataFrame, new: DataFrame, columns: list[str], key: str = "row_id") -> DataFrame:
    """Values of ``new`` over those of ``old`` by key; nulls never overwrite."""
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(fresh, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def gap_fill(track: DataFrame, anchor: Column, columns: list[str]) -> DataFrame:
    """Columns linear by row between anchor rows of a line; rows outside the
    first and last anchor and gaps with a null end keep their values."""
    line = Window.partitionBy("line_id").orderBy("seq")
    at = F.when(anchor, F.struct("seq", *columns))
    near = track.withColumns({"_lo": F.last(at, True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "_hi": F.first(at, True).over(line.rowsBetween(0, Window.unboundedFollowing))})
    share = (F.col("seq") - F.col("_lo.seq")) / (F.col("_hi.seq") - F.col("_lo.seq"))
    inside = F.col("_hi.seq") > F.col("_lo.seq")
    return near.withColumns({c: F.when(inside, F.coalesce(F.col(f"_lo.{c}") + share * (F.col(f"_hi.{c}") - F.col(f"_lo.{c}")), F.col(c))).otherwise(F.col(c)) for c in columns}).drop("_lo", "_hi")


def forward_fill(track: DataFrame, columns: list[str]) -> DataFrame:
    line = Window.partitionBy("line_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return track.withColumns({c: F.last(c, True).over(line) for c in columns})


def gps_trim(track: DataFrame, valid: Column) -> DataFrame:
    """Rows between the first and last valid row of the line; a line without
    one stays whole."""
    whole = Window.partitionBy("line_id")
    ends = track.withColumns({"_a": F.min(F.when(valid, F.col("seq"))).over(whole), "_b": F.max(F.when(valid, F.col("seq"))).over(whole)})
    return ends.filter(F.col("_a").isNull() | F.col("seq").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
