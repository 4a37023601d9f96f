"""Ground-penetrating-radar traces: one row per trace with ``segment``,
``trace_no`` and ``samples`` (array of double).

Steps on a trace are array expressions; steps over neighbouring traces are
aggregates or windows by segment; filters with memory run as NumPy kernels on
Arrow batches of traces, which need no grouping.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

def neighbours():
    return Window.partitionBy("segment").orderBy("trace_no")


def samples_long(traces: DataFrame) -> DataFrame:
    return traces.select("segment", "trace_no", F.posexplode("samples").alias("k", "value"))


def cut_samples(traces: DataFrame, dt: float, time_cut: float, first: int = 0, last: int | None = None) -> DataFrame:
    """Samples before ``time_cut`` (all but the last one where it is negative or
    beyond the trace) of the traces first <= trace_no < last."""
    n = F.size("samples")
    k = F.when((F.lit(time_cut) < 0) | (F.lit(time_cut) > dt * n), n - 1).otherwise(int(time_cut / dt) if time_cut >= 0 else 0)
    kept = traces.filter(F.col("trace_no") >= first) if last is None else traces.filter((F.col("trace_no") >= first) & (F.col("trace_no") < last))
    return kept.withColumn("samples", F.slice("samples", F.lit(1), k))


def sanitise(traces: DataFrame) -> DataFrame:
    clean = F.transform("samples", lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    return traces.withColumn("samples", clean)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def dc_shift(traces: DataFrame, first: int, last: int) -> DataFrame:
    """Subtract the mean of samples first to last (0-based, inclusive)."""
    level = traces.withColumn("_m", _mean(F.slice("samples", F.lit(first + 1), F.lit(last - first + 1))))
    return level.withColumn("samples", F.transform("samples", lambda x: x - F.col("_m"))).drop("_m")


def mean_trace(traces: DataFrame, median: bool = False) -> DataFrame:
    """The mean (or median) trace of each segment; partial sums per sample."""
    middle = F.median("value") if median else F.avg("value")
    levels = samples_long(traces).groupBy("segment", "k").agg(middle.alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda p: p["v"])  # one entry per sample
    return levels.groupBy("segment").agg(ordered.alias("background"))


def remove_background(traces: DataFrame, median: bool = False) -> DataFrame:
    both = traces.join(mean_trace(traces, median), "segment")
    return both.withColumn("samples", F.zip_with("samples", "background", lambda x, b: x - b)).drop("background")


def remove_local_background(traces: DataFrame, width: int = 21, trim: float = 0.2) -> DataFrame:
    """Subtract the trimmed mean of the ``width`` traces around, per sample."""
    half = width // 2
    cells = samples_long(traces)
    around = Window.partitionBy("segment", "k").orderBy("trace_no").rowsBetween(-half, half)
    near = cells.withColumn("_s", F.array_sort(F.collect_list("value").over(around)))
    cut = F.floor(F.size("_s") * trim).cast("int")
    kept = F.slice("_s", cut + 1, F.size("_s") - 2 * cut)
    out = near.withColumn("v", F.col("value") - _mean(kept))
    return _gather(traces, out)


def _gather(traces: DataFrame, cells: DataFrame, value: str = "v") -> DataFrame:
    lists = cells.groupBy("segment", "trace_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda p: p[value]).alias("samples"))
    return traces.drop("samples").join(lists, ["segment", "trace_no"])


def median3x3(traces: DataFrame) -> DataFrame:
    """Median of the 3 x 3 surroundings, zeros beyond the profile."""
    zero = F.transform("samples", lambda x: F.lit(0.0))
    sides = traces.withColumns({"_l": F.coalesce(F.lag("samples").over(neighbours()), zero), "_r": F.coalesce(F.lead("samples").over(neighbours()), zero)})
    at = lambda a, i: F.coalesce(F.get(F.col(a), i), F.lit(0.0))
    def middle(_, i):
        cells = F.array(*[at(a, i + d) for a in ("_l", "samples", "_r") for d in (-1, 0, 1)])
        return F.element_at(F.array_sort(cells), 5)
    return sides.withColumn("samples", F.transform("samples", middle)).drop("_l", "_r")


def gains(n: int, dt: float, kind: str, alpha: float = 1.0, te: float = 70.0, tcst: float = 3.0, velocity: float = 1.0) -> list[float]:
    """Gain per sample.  power: tcst**alpha up to tcst, (t - tcst)**alpha up to
    te, then 1; exponential: exp(alpha * t) up to te; linear: v * t;
    attenuation: 1 / (v * t), with 0.01 for t = 0."""
    t = np.arange(n) * dt
    if kind == "power":
        return np.where(t <= tcst, tcst**alpha, np.where(t <= te, np.abs(t - tcst) ** alpha, 1.0)).tolist()
    if kind == "exponential":
        return np.where(t <= te, np.exp(alpha * np.minimum(t, te)), 1.0).tolist()
    if kind == "linear":
        return (velocity * t).tolist()
    if kind == "attenuation":
        return (1 / (velocity * np.where(np.arange(n) == 0, 0.01, t))).tolist()
    raise ValueError(f"unknown gain {kind!r}")


def apply_gain(traces: DataFrame, gain: list[float]) -> DataFrame:
    return traces.withColumn("samples", F.zip_with("samples", F.array(*map(F.lit, gain)), lambda x, g: x * g))


def air_time(positions: DataFrame, altitude: str) -> DataFrame:
    """Two-way travel time in air below the highest position of the survey, ns."""
    top = F.max(altitude).over(Window.partitionBy("segment"))
    return positions.withColumn("twt_ns", 2 * (top - F.col(altitude)) * 100 / 30)


def topography(traces: DataFrame, twt: str, dt: float) -> DataFrame:
    """Shift every trace down by round(twt / dt) + 1 zeros to a common length."""
    shift = F.rint(F.col(twt) / dt).cast("int") + 1
    padded = traces.withColumns({"_k": shift, "_most": F.max(shift).over(Window.partitionBy("segment"))})
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return padded.withColumn("samples", F.concat(zeros(F.col("_k")), "samples", zeros(F.col("_most") - F.col("_k")))).drop("_k", "_most")


def power_spectrum(traces: DataFrame, dt_ns: float) -> DataFrame:
    """Power per non-negative frequency and trace over the trace's largest."""
    n = F.size("samples")
    freq = F.explode(F.sequence(F.lit(0), F.floor(n / 2).cast("int"))).alias("f")
    rows = traces.select("segment", "trace_no", "samples", n.alias("n"), freq)
    angle = lambda i: -2 * np.pi * F.col("f") * i / F.col("n")
    total = lambda wave: F.aggregate(F.transform("samples", lambda x, i: x * wave(angle(i))), F.lit(0.0), lambda a, x: a + x)
    power = rows.select("segment", "trace_no", "f", (F.col("f") / (F.col("n") * dt_ns * 1e-9)).alias("hz"), (F.pow(total(F.cos), 2) + F.pow(total(F.sin), 2)).alias("_p"))
    most = F.max("_p").over(Window.partitionBy("segment", "trace_no"))
    return power.withColumn("power", F.try_divide("_p", most)).drop("_p")


def trace_quality(traces: DataFrame) -> DataFrame:
    x = F.col("value")
    bad = x.isNull() | F.isnan(x)
    fine = F.when(~bad & (F.abs(x) != float("inf")), x)
    return samples_long(traces).groupBy("segment").agg(F.min(fine).alias("min"), F.max(fine).alias("max"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"), F.count_if(bad).alias("n_nan"), F.count_if(~bad & (F.abs(x) == float("inf"))).alias("n_inf"), F.count_if(x == 0).alias("n_zero"))


def first_break(traces: DataFrame, threshold: float = 0.06) -> DataFrame:
    """First sample whose size passes ``threshold`` of the trace's largest."""
    most = F.aggregate("samples", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    over = F.transform("samples", lambda x: F.abs(x) > threshold * F.col("_m"))
    return traces.withColumn("_m", most).withColumn("t0", F.coalesce(F.array_position(over, True) - 1, F.lit(0)).cast("int")).drop("_m")


def align_first_break(traces: DataFrame, threshold: float = 0.06) -> DataFrame:
    """Traces shifted up so that their first breaks are sample 0, zeros behind."""
    found = first_break(traces, threshold)
    n, k = F.size("samples"), F.col("t0")
    return found.withColumn("samples", F.concat(F.slice("samples", k + 1, n - k), F.array_repeat(F.lit(0.0), k)))


def pick_reflection(traces: DataFrame, sample: int) -> DataFrame:
    """Samples between the second sign changes before and after ``sample``."""
    flips = F.transform(F.sequence(F.lit(0), F.size("samples") - 2), lambda i: F.struct(i.alias("i"), (F.get("samples", i) * F.get("samples", i + 1) < 0).alias("x")))
    places = traces.withColumn("_f", F.transform(F.filter(flips, lambda p: p["x"]), lambda p: p["i"]))
    after, before = F.filter("_f", lambda i: i >= sample), F.filter("_f", lambda i: i < sample)
    ends = places.withColumns({"pick_from": F.get(before, F.size(before) - 2) + 1, "pick_to": F.get(after, F.lit(1))})
    return ends.withColumn("reflection", F.slice("samples", F.col("pick_from") + 1, F.col("pick_to") - F.col("pick_from") + 1)).drop("_f")


def layer_permittivity(reflectivity: Column, top: float = 1.0, low: float = 1.0, high: float = 80.0, digits: int = 2) -> Column:
    """Permittivity e of a denser lower layer from r = (sqrt(e) - sqrt(top)) /
    (sqrt(e) + sqrt(top)), solved for e, held to ``low`` to ``high`` and rounded;
    null where r is not in 0 to 1."""
    root = (1 + reflectivity) / (1 - reflectivity)
    exact = F.when(reflectivity == 1, F.lit(float("inf"))).otherwise(top * root * root)
    return F.when(reflectivity.between(0, 1), F.round(F.greatest(F.lit(low), F.least(F.lit(high), exact)), digits))


def permittivity(reflectivity: float, top: float = 1.0, low: float = 1.0, high: float = 80.0, digits: int = 2) -> float:
    """``layer_permittivity`` of one number; ValueError where r is not in 0 to 1."""
    if not 0 <= reflectivity <= 1:
        raise ValueError("reflectivity outside 0 to 1")
    exact = np.inf if reflectivity == 1 else top * ((1 + reflectivity) / (1 - reflectivity)) ** 2
    return round(float(np.clip(exact, low, high)), digits)


# kernels on batches of traces


def per_trace(traces: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a kernel to every trace (rows of equal length in one call)."""

    def run(frames):
        for f in frames:
            out = pd.Series([None] * len(f), index=f.index, dtype=object)
            for n, part in f.groupby(f["samples"].map(len)):
                if n:
                    out[part.index] = list(kernel(np.stack(part["samples"].to_list())))
            yield f.assign(samples=out)

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in traces.schema)
    return traces.mapInPandas(run, schema)


def per_segment(traces: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a kernel to each profile (traces x samples) of one flight line."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("trace_no")
        return f.assign(samples=list(kernel(np.stack(f["samples"].to_list()))))

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in traces.schema)
    return traces.groupBy("segment").applyInPandas(run, schema)


def butterworth(order: int, low: float | None, high: float | None, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital Butterworth filter: analogue
    poles, frequency transformation, bilinear transformation."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if low and high:
        wide, centre = warp(high) - warp(low), (warp(high) * warp(low)) ** 0.5
        half = poles * wide / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), wide**order
    elif high:
        poles, zeros, gain = poles * warp(high), np.zeros(0), warp(high) ** order
    else:
        gain = (1 / np.prod(-poles)).real
        poles, zeros = warp(low) / poles, np.zeros(order)
    digital = (2 * rate + poles) / (2 * rate - poles)
    gain *= (np.prod(2 * rate - zeros) / np.prod(2 * rate - poles)).real
    back = np.concatenate([(2 * rate + zeros) / (2 * rate - zeros), -np.ones(len(poles) - len(zeros))])
    up = sorted((p for p in digital if p.imag > 1e-12), key=lambda p: abs(p))
    real = sorted(p.real for p in digital if abs(p.imag) <= 1e-12)
    pairs = [(p, np.conj(p)) for p in up] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    spread = [z.real for z in sorted(back, key=lambda z: z.real)]
    spread = [x for pair in zip(spread, spread[::-1], strict=True) for x in pair][: len(spread)]
    out = []
    for i, pair in enumerate(pairs):
        own, spread = spread[: len(pair)], spread[len(pair) :]
        out.append((np.poly(own).real * (gain if i == 0 else 1), np.poly(pair).real))
    return out


def _recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    y = np.empty_like(x)
    for k in range(x.shape[1]):
        y[:, k] = b[0] * x[:, k] + state[0]
        for i in range(len(state)):
            state[i] = (b[i + 1] if i + 1 < len(b) else 0) * x[:, k] - (a[i + 1] if i + 1 < len(a) else 0) * y[:, k] + (state[i + 1] if i + 1 < len(state) else 0)
    return y


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of a section after an endless run of ones."""
    n = len(a) - 1
    b = np.pad(b, (0, n + 1 - len(b)))
    level = b.sum() / a.sum()
    state = np.zeros(n)
    for i in range(n - 1, -1, -1):
        state[i] = b[i + 1] - a[i + 1] * level + (state[i + 1] if i + 1 < n else 0)
    return state


def zero_phase(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Forward and backward run over rows with odd extension at both ends."""
    pad = min(3 * (2 * len(sections) + 1), x.shape[1] - 1)
    if pad > 0:
        x = np.hstack([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections:
            x = _recursive(b, a, x, np.outer(_steady(b, a), x[:, 0]))
        x = x[:, ::-1]
    return x[:, pad : x.shape[1] - pad] if pad > 0 else x


def band_pass(traces: DataFrame, dt_ns: float, low_ghz: float | None, high_ghz: float | None, order: int = 4, mode: str = "corrected") -> DataFrame:
    """Zero-phase Butterworth low-, high- or band-pass.  ``compat`` designs for
    half the sampling rate, which doubles the real corner frequencies."""
    rate = 1 / dt_ns if mode == "corrected" else 0.5 / dt_ns
    sections = butterworth(order, low_ghz, high_ghz, rate)
    return per_trace(traces, lambda x: zero_phase(sections, x))


def fir_band_pass(traces: DataFrame, dt_ns: float, corners: tuple[float, float, float, float]) -> DataFrame:
    """Trapezoid band-pass in the frequency domain."""

    def kernel(x: np.ndarray) -> np.ndarray:
        f = np.fft.rfftfreq(x.shape[1], dt_ns)
        return np.fft.irfft(np.fft.rfft(x) * np.interp(f, corners, [0, 1, 1, 0]), x.shape[1])

    return per_trace(traces, kernel)


def savitzky_golay(x: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Local polynomial trend along rows; ends from the outermost fit."""
    window += 1 - window % 2
    if x.shape[1] < window:
        return x.copy()
    half, t = window // 2, np.arange(window) - window // 2
    fit = np.linalg.pinv(np.vander(t, degree + 1, increasing=True))
    out = np.stack([np.convolve(row, fit[0][::-1], "same") for row in x])
    place = np.vander(t, degree + 1, increasing=True) @ fit
    out[:, :half] = x[:, :window] @ place[:half].T
    out[:, -half:] = x[:, -window:] @ place[-half:].T
    return out


def dewow(traces: DataFrame, window: int = 10, degree: int = 2, mode: str = "corrected") -> DataFrame:
    """Trace minus its trend; ``compat`` returns the trend along the traces."""
    if mode == "compat":
        return per_segment(traces, lambda x: savitzky_golay(x.T, window, degree).T)
    return per_trace(traces, lambda x: x - savitzky_golay(x, window, degree))


def upsample(traces: DataFrame, factor: int, reach: int = 10) -> DataFrame:
    """Windowed-sinc interpolation to ``factor`` times as many samples."""
    t = np.arange(-reach * factor, reach * factor + 1)
    taps = np.sinc(t / factor) * np.kaiser(len(t), 5.0)

    def kernel(x: np.ndarray) -> np.ndarray:
        wide = np.zeros((x.shape[0], x.shape[1] * factor))
        wide[:, ::factor] = x
        return np.stack([np.convolve(row, taps, "full")[reach * factor :][: wide.shape[1]] for row in wide])

    return per_trace(traces, kernel)


def deconvolve(traces: DataFrame, dt_ns: float, window: tuple[float, float] = (10.0, 70.0), length: float = 5.0, noise: float = 1e-5) -> DataFrame:
    """Wiener spiking deconvolution: the prediction operator of ``length`` ns
    comes from each trace's autocorrelation in the window."""

    def kernel(x: np.ndarray) -> np.ndarray:
        a, b, n = int(window[0] / dt_ns), int(window[1] / dt_ns), max(2, int(length / dt_ns))
        out = np.empty_like(x)
        for row, trace in enumerate(x):
            cut = trace[a : b + 1] if len(trace[a : b + 1]) > n else trace
            n_row = min(n, len(cut))
            r = np.correlate(cut, cut, "full")[len(cut) - 1 :][:n_row]
            r[0] += noise * r[0] + 1e-30
            matrix = r[np.abs(np.subtract.outer(np.arange(n_row), np.arange(n_row)))]
            operator = np.linalg.solve(matrix, np.eye(n_row)[0] * r[0])
            out[row] = np.convolve(trace, operator)[: len(trace)]
        return out

    return per_trace(traces, kernel)


def migrate(traces: DataFrame, dx: float, dt_ns: float, velocity: float) -> DataFrame:
    """Kirchhoff migration of a profile: every image point sums the samples on
    its diffraction hyperbola, weighted by obliquity."""

    def kernel(x: np.ndarray) -> np.ndarray:
        n, m = x.shape
        depth = np.arange(m) * dt_ns * velocity / 2
        out = np.zeros_like(x)
        for shift in range(-(n - 1), n):
            path = np.hypot(depth, shift * dx)
            sample = np.rint(2 * path / velocity / dt_ns).astype(int)
            weight = np.divide(depth, path, out=np.ones(m), where=path > 0)
            ok = sample < m
            a, b = max(0, -shift), min(n, n - shift)
            out[a:b][:, ok] += x[a + shift : b + shift][:, sample[ok]] * weight[ok]
        return out

    return per_segment(traces, kernel)


STEPS: dict[str, Callable[..., DataFrame]] = {
    "dc_shift": dc_shift, "background": remove_background, "local_background": remove_local_background, "median3x3": median3x3,
    "gain": apply_gain, "time_zero": align_first_break, "band_pass": band_pass, "fir": fir_band_pass, "dewow": dewow,
    "deconvolution": deconvolve, "migration": migrate, "topography": topography, "upsample": upsample, "sanitise": sanitise,
}


def step_order(enabled: list[str], custom: list[str] | None = None) -> list[str]:
    """Enabled steps, in the custom order where one is given."""
    return [s for s in custom if s in enabled] if custom else list(enabled)


def run_steps(traces: DataFrame, steps: list[tuple[str, dict]]) -> list[tuple[str, DataFrame]]:
    """Every intermediate profile by name, in order; unknown steps are errors."""
    out = [("raw", traces)]
    for name, options in steps:
        if name not in STEPS:
            raise ValueError(f"unknown radar step {name!r}")
        out.append((name, STEPS[name](out[-1][1], **options)))
    return out


def power_then_exponential(n: int, dt: float, alpha: float, beta: float, te: float, tcst: float) -> list[float]:
    """Power gain and exponential gain after one another, per sample."""
    return (np.array(gains(n, dt, "power", alpha, te, tcst)) * np.array(gains(n, dt, "exponential", beta, te))).tolist()


def topography_depth(traces: DataFrame, altitude: str, dz: float) -> DataFrame:
    """Shift by depth below the highest position: ``altitude`` is the height
    above it, in the unit of ``dz``."""
    return topography(traces, altitude, dz)


def spreading(traces: DataFrame, dt: float, velocity: float, exponent: float = 1.0) -> DataFrame:
    """Undo geometric spreading: samples times (velocity * time) ** exponent."""
    return traces.withColumn("samples", F.transform("samples", lambda x, i: x * F.pow(velocity * dt * i, F.lit(exponent))))
