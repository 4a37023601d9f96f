"""Statistical anomalies along tracks and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quantiles import quantiles

def line():
    return Window.partitionBy("line_id").orderBy("seq")


def rolling_mean(track: DataFrame, column: str, size: int) -> DataFrame:
    """Centred mean over ``size`` rows; where fewer lie around, the value."""
    ahead = (size - 1) // 2
    around = line().rowsBetween(ahead - size + 1, ahead)
    full = F.count(column).over(around) == size
    return track.withColumn("smooth", F.when(full, F.avg(column).over(around)).otherwise(F.col(column)))


def gradient(track: DataFrame, column: str) -> DataFrame:
    """Central differences, one-sided at the ends, 0 in lines of one row."""
    back, ahead = F.lag(column).over(line()), F.lead(column).over(line())
    value = F.when(back.isNull(), ahead - F.col(column)).when(ahead.isNull(), F.col(column) - back).otherwise((ahead - back) / 2)
    return track.withColumn("gradient", F.coalesce(value, F.lit(0.0)))


def _with(df: DataFrame, *scalars) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*scalars)))  # one row


def _median(df: DataFrame, value: Column, name: str) -> DataFrame:
    middle = quantiles(df, value, [0.5], "_q").select(F.col("_q")[0].alias(name))
    return df.crossJoin(F.broadcast(middle))  # one row


def zscore(df: DataFrame, column: str) -> DataFrame:
    both = _with(df, F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return both.withColumn("score", F.abs(F.try_divide(F.col(column) - F.col("_m"), F.col("_s")))).drop("_m", "_s")


def iqr_score(df: DataFrame, column: str) -> DataFrame:
    both = df.crossJoin(F.broadcast(quantiles(df, column, [0.25, 0.5, 0.75], "_q")))  # one row
    return both.withColumn("score", F.try_divide(F.abs(F.col(column) - F.col("_q")[1]), (F.col("_q")[2] - F.col("_q")[0]) / 1.349)).drop("_q")


def mad(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its median and the median absolute deviation from it."""
    middle = _median(df, F.col(column), "_median")
    return _median(middle, F.abs(F.col(column) - F.col("_median")), "_mad")


def modified_zscore(df: DataFrame, column: str) -> DataFrame:
    return mad(df, column).withColumn("score", F.try_divide(0.6745 * F.abs(F.col(column) - F.col("_median")), F.col("_mad"))).drop("_median", "_mad")


def mad_noise(df: DataFrame, column: str) -> DataFrame:
    return mad(df, column).agg((1.4826 * F.max("_mad")).alias("noise"))


def poisson_z(df: DataFrame, column: str) -> DataFrame:
    both = _median(df, F.col(column), "_m")
    return both.withColumn("z", F.when(F.col("_m") > 0, (F.col(column) - F.col("_m")) / F.sqrt("_m")).otherwise(0.0)).drop("_m")


def gradient_flags(track: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """Rows whose absolute gradient passes its percentile."""
    sloped = gradient(track, column).withColumn("_g", F.abs("gradient"))
    cut = quantiles(sloped, "_g", [share], "_t")
    return sloped.crossJoin(F.broadcast(cut)).withColumn("flag", F.col("_g") > F.col("_t")[0]).drop("_g", "_t")  # one row


def statistical_anomalies(track: DataFrame, column: str, method: str = "zscore", threshold: float = 2.5, smoothing: int = 5, outliers: bool = True, slopes: bool = True) -> DataFrame:
    """The whole example chain: outliers, smoothing, score, slopes, flags."""
    from .tables import iqr_filter

    rows = iqr_filter(track, column) if outliers else track
    rows = rolling_mean(rows, column, smoothing) if smoothing > 1 else rows.withColumn("smooth", F.col(column))
    scored = {"zscore": zscore, "iqr": iqr_score, "modified_zscore": modified_zscore}[method](rows, "smooth")
    scored = scored.withColumn("is_anomaly", F.coalesce(F.col("score") > threshold, F.lit(False)))
    if slopes:
        scored = gradient_flags(scored, "smooth").withColumn("is_anomaly", F.col("is_anomaly") | F.col("flag"))
    return scored


def peaks(track: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Local maxima at least k MAD above the median (ties to the left stay)."""
    tops = mad(track, column).withColumns({"_b": F.lag(column).over(line()), "_a": F.lead(column).over(line())})
    return tops.filter((F.col(column) > F.col("_b")) & (F.col(column) >= F.col("_a")) & (F.col(column) >= F.col("_median") + k * F.col("_mad"))).drop("_a", "_b", "_median", "_mad")
