"""Multispectral tables: indices, stretch, covariance, RX distance, texture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .quantiles import quantiles


def ndvi(red: Column, nir: Column) -> Column:
    """Null or non-finite becomes 0."""
    value = F.try_divide(nir - red, nir + red)
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def stretch(df: DataFrame, columns: list[str], percent: float = 2.0) -> DataFrame:
    """Linear stretch between the percentiles, held to 0 to 1; null where they
    coincide."""
    out = df
    for c in columns:
        out = out.crossJoin(F.broadcast(quantiles(df, c, [percent / 100, 1 - percent / 100], f"_p_{c}")))  # one row
    scaled = {f"{c}_stretched": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(c) - F.col(f"_p_{c}")[0], F.col(f"_p_{c}")[1] - F.col(f"_p_{c}")[0]))) for c in columns}
    return out.withColumns(scaled).drop(*[f"_p_{c}" for c in columns])


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """band_a, band_b, cov (sample) of all ordered pairs, from one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*[F.covar_samp(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("band_a"), F.lit(b).alias("band_b"), F.col(f"`{i}`").alias("cov")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def rx_distance(df: DataFrame, columns: list[str], share: float = 0.95, ridge: float = 1e-6) -> DataFrame:
    """Mahalanobis distance ``rxd`` to the mean of the finite rows and
    ``is_anomaly`` above its percentile; rows with a non-finite band have 0, and
    all have where fewer than 10 rows are finite.  The means and the k x k
    covariance go to the driver; the distance is an expression."""
    finite = F.lit(True)
    for c in columns:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    good = df.filter(finite)
    moments = good.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]).first()
    k = len(columns)
    if moments["n"] < 10:
        return df.withColumns({"rxd": F.lit(0.0), "is_anomaly": F.lit(False)})
    inverse = np.linalg.pinv(np.array([[moments[f"c{i}_{j}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k))
    away = [F.col(c) - moments[f"m{i}"] for i, c in enumerate(columns)]
    total = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            total = total + away[i] * float(inverse[i, j]) * away[j]
    scored = df.withColumn("rxd", F.when(finite, F.sqrt(F.greatest(total, F.lit(0.0)))).otherwise(0.0))
    cut = quantiles(scored, "rxd", [share], "_cut")
    return scored.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.col("rxd") > F.col("_cut")[0]).drop("_cut")  # one row


def texture(track: DataFrame, column: str, reach: int = 2) -> DataFrame:
    """Population variance of the rows around, clipped at the ends."""
    around = Window.partitionBy("line_id").orderBy("seq").rowsBetween(-reach, reach)
    return track.withColumn("texture", F.var_pop(column).over(around))
