import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafield.operators import quantiles as q


@pytest.mark.parametrize("seed", range(4))
def test_narrowing_equals_numpy(spark, seed, monkeypatch):
    monkeypatch.setattr(q, "LAST_ROWS", 20)
    monkeypatch.setattr(q, "BINS", 16)
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=3000), np.repeat([1.0, 5.0, 5.0, 9.0], 500), np.exp(rng.normal(scale=8, size=2500)), np.concatenate([np.zeros(1000), rng.random(2000)])][seed]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
    shares = [0.0, 0.02, 0.25, 0.5, 0.95, 1.0]
    got = q.quantiles(df, "v", shares, "p", state_rows=10).first()["p"]
    assert got == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12, abs=1e-12)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "v int")
    assert q.quantiles(df, "v", [0.5, 0.75], "p").first()["p"] == [2.0, 3.0]
    assert q.quantiles(df, F.col("v") * 2, [0.5], "p", state_rows=1).first()["p"] == [4.0]
    assert q.quantiles(df.limit(0), "v", [0.5], "p").first()["p"] is None
