"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class _Mesh:
    """Nodes of an evenly spaced mesh over bounds: iy, ix, x, y."""

    def eval(self, x0: float, y0: float, x1: float, y1: float, nx: int, ny: int):
        for iy in range(ny):
            for ix in range(nx):
                yield iy, ix, x0 + ix * (x1 - x0) / max(nx - 1, 1), y0 + iy * (y1 - y0) / max(ny - 1, 1)


def register(spark: SparkSession) -> None:
    """Make ``mesh(x0, y0, x1, y1, nx, ny)`` known to SQL."""
    spark.udtf.register("mesh", udtf(_Mesh, returnType="iy int, ix int, x double, y double"))
