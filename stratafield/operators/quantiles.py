"""Exact quantiles of a column of any length.

Spark's exact ``percentile`` holds every distinct value in one aggregation
state.  Up to ``STATE_ROWS`` rows that state is bounded and used as it is.
Beyond, each wanted rank is narrowed by passes over the data: a pass counts
``BINS`` even bins of every open interval (with the least and largest value of
each), so its state has a fixed size; a bin of one value, or of at most
``LAST_ROWS`` rows, ends the search.  A value that a third of the rows share is
such a bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATE_ROWS = 2_000_000
BINS = 2048
LAST_ROWS = 50_000


def _ranks(n: int, shares: list[float]) -> list[tuple[int, int, float]]:
    """Lower and upper 0-based rank of each share, and the part of the upper."""
    out = []
    for p in shares:
        at = p * (n - 1)
        low = int(at)
        out.append((low, min(low + 1, n - 1), at - low))
    return out


def values_at(values: DataFrame, ranks: list[int], low: float, high: float) -> dict[int, float]:
    """The values of a one-column frame ``v`` at 0-based ranks; low and high are
    its least and largest value."""
    found: dict[int, float] = {}
    open_ = {r: (low, high, 0) for r in ranks}  # interval (both ends inside), rows before it
    while open_:
        spans = sorted(set(open_.values()))
        pieces = []
        for k, (a, b, _) in enumerate(spans):
            width = (b - a) / BINS
            place = F.least(F.floor((F.col("v") - a) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
            pieces.append(F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("k"), place.cast("long").alias("bin"))))
        tagged = values.select("v", F.explode(F.filter(F.array(*pieces), lambda x: x.isNotNull())).alias("t"))
        counted = tagged.groupBy("t.k", "t.bin").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()  # BINS rows per interval at most
        step = {}
        for k, (a, b, before) in enumerate(spans):
            bins = sorted((r["bin"], r["n"], r["a"], r["b"]) for r in counted if r["k"] == k)
            for rank in [r for r, held in open_.items() if held == (a, b, before)]:
                done = before
                for _, n, first, last in bins:
                    if rank < done + n:
                        break
                    done += n
                if first == last:
                    found[rank] = first
                elif n <= LAST_ROWS:
                    near = values.filter(F.col("v").between(first, last)).agg(F.sort_array(F.collect_list("v")).alias("s"))  # at most LAST_ROWS
                    found[rank] = near.select(F.get("s", F.lit(rank - done))).first()[0]
                else:
                    step[rank] = (first, last, done)
        open_ = step
    return found


def quantiles(df: DataFrame, column: str | Column, shares: list[float], name: str, state_rows: int = STATE_ROWS) -> DataFrame:
    """One row with array ``name``: linear quantiles of the non-null values;
    null where there are none."""
    values = df.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).filter("v IS NOT NULL")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if n <= state_rows:
        return values.agg(F.percentile("v", shares).alias(name))
    ranks = _ranks(n, shares)
    at = values_at(values, sorted({r for a, b, _ in ranks for r in (a, b)}), low, high)
    return df.sparkSession.range(1).select(F.array(*[F.lit(at[a] + (at[b] - at[a]) * part) for a, b, part in ranks]).alias(name))
