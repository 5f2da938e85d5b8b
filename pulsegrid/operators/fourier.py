"""Fourier sums of events and of series of any length.

Two tools share one step.  *Spreading* replaces every point by ``WIDTH`` weighted cells of a periodic grid at least twice as
fine as the wanted spectrum; cells are sums, so they combine before anything is shuffled, and the cost follows points plus grid,
not points times frequencies.  A fast transform of the grid, divided by the kernel's own transform, gives the sums to about
1e-13 of the total weight.

* :func:`nufft` evaluates sums at evenly spaced frequencies straight from event times: the grid is as large as the spectrum.
* :func:`long_power` transforms binned series that are too long for one row.  The grid is a power of two and is cut twice: into
  residues of the cell number, each transformed alone and turned by its twiddle factors, then into residues of the frequency.
  No row or task holds more than about the square root of the grid.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import US
from .asof import small

#: Kernel width in cells, and its shape.
WIDTH, BETA = 15, 2.3 * 15
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
_COMPLEX = "re array<double>, im array<double>"


def frac(c: Column) -> Column:
    return c - F.floor(c)


def kernel_transform(k: np.ndarray, cells: int) -> np.ndarray:
    """What the kernel makes of frequency ``k`` on a grid of ``cells``."""
    shape = _WEIGHTS * np.exp(BETA * (np.sqrt(1 - _NODES ** 2) - 1))
    out = np.empty(len(k))
    for a in range(0, len(k), 1 << 14):
        out[a:a + (1 << 14)] = np.cos(np.outer(k[a:a + (1 << 14)], _NODES) * (math.pi * WIDTH / cells)) @ shape
    return out * (WIDTH / 2)


def spread(points: DataFrame, keys: list[str], cells: Column, turn: Column, values: dict[str, Column]) -> DataFrame:
    """Sums of ``values`` in the cells around ``turn`` (place on the circle, 0 to 1), with the number of points as ``n``."""
    near = points.select(*keys, cells.cast("long").alias("_cells"), (turn * cells).alias("_at"), *[v.alias(c) for c, v in values.items()])
    near = near.withColumn("_first", F.ceil(F.col("_at") - WIDTH / 2))
    rows = near.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(WIDTH)]))).withColumn("_m", F.col("_first") + F.col("_i"))
    z = (F.col("_m") - F.col("_at")) / (WIDTH / 2)
    phi = F.exp(BETA * (F.sqrt(F.greatest(1 - z * z, F.lit(0.0))) - 1))
    rows = rows.withColumn("_phi", phi)
    return rows.groupBy(*keys, F.pmod("_m", "_cells").alias("cell")).agg(
        *[F.sum(F.col(c) * F.col("_phi")).alias(c) for c in values], F.sum(F.when(F.col("_i") == 0, 1).otherwise(0)).alias("n"))


# ------------------------------------------------------------------ evenly spaced frequencies from event times
def _grid_udf(cells: int, n: int):
    """UDF (cells, re, im) -> sums at the n frequencies around the middle one."""
    k = np.arange(n) - n // 2
    scale = kernel_transform(k, cells)

    @F.pandas_udf(_COMPLEX)
    def run(cell: pd.Series, re: pd.Series, im: pd.Series) -> pd.DataFrame:
        out = []
        for c, a, b in zip(cell, re, im):
            grid = np.zeros(cells, complex)
            grid[np.asarray(c, np.int64)] = np.asarray(a) + 1j * np.asarray(b)
            f = np.fft.fft(grid)[k] / scale
            out.append((f.real, f.imag))
        return pd.DataFrame(out, columns=["re", "im"])

    return run


def nufft(ev: DataFrame, keys: list[str], f0: float, df: float, n: int, weight: Column | None = None, centred: bool = False) -> DataFrame:
    """keys, n_events, total, re, im: sum of w exp(-2 pi i f t) at f0 + k df, k = 0 to n - 1, per group.

    ``centred`` takes the mean weight off every weight, which needs no second look at the events since the sum is linear.
    """
    cells, ts = max(2 * n, 4 * WIDTH), F.col("t") / US
    w = F.lit(1.0) if weight is None else weight.cast("double")
    angle = -2 * math.pi * frac((f0 + (n // 2) * df) * ts)
    values = {"re": w * F.cos(angle), "im": w * F.sin(angle)}
    if centred:
        values |= {"re1": F.cos(angle), "im1": F.sin(angle)}
    total = ev.groupBy(*keys).agg(F.sum(w).alias("total"))
    grid = spread(ev, keys, F.lit(cells), frac(df * ts), values)
    g = grid.groupBy(*keys).agg(F.collect_list(F.struct("cell", *values)).alias("_g"), F.sum("n").alias("n_events"))
    g = g.join(total, keys)
    part = {c: F.col(f"_g.{c}") for c in ("re", "im")}
    if centred:
        mean = F.col("total") / F.col("n_events")
        part = {"re": F.transform("_g", lambda s: s["re"] - mean * s["re1"]), "im": F.transform("_g", lambda s: s["im"] - mean * s["im1"])}
    return g.select(*keys, "n_events", "total", _grid_udf(cells, n)(F.col("_g.cell"), part["re"], part["im"]).alias("z")).select(*keys, "n_events", "total", "z.re", "z.im")


# ------------------------------------------------------------------ long series
def _columns_udf():
    """UDF (m1, values, m2, rows, columns) -> the transform over m1 for one residue m2, turned by its twiddle factors."""
    @F.pandas_udf(_COMPLEX)
    def run(at: pd.Series, value: pd.Series, m2: pd.Series, m_1: pd.Series, m_2: pd.Series) -> pd.DataFrame:
        out = []
        for a, v, r, n1, n2 in zip(at, value, m2, m_1, m_2):
            x = np.zeros(int(n1))
            x[np.asarray(a, np.int64)] = v
            f = np.fft.fft(x) * np.exp(-2j * np.pi * r * np.arange(n1) / (float(n1) * n2))
            out.append((f.real, f.imag))
        return pd.DataFrame(out, columns=["re", "im"])

    return run


def hann_transform(k: np.ndarray, n: int) -> np.ndarray:
    """Sum of the symmetric Hann window of length n times exp(-2 pi i k j / n)."""
    out = np.where(k == 0, 0.5 * n, 0).astype(complex)
    for side in (1, -1):
        step = 2 * np.pi * (side / (n - 1) - k / n)
        whole = 2 * np.pi * (side * n / (n - 1) - k)
        near = np.abs(np.expm1(1j * step)) < 1e-300
        out -= 0.25 * np.where(near, n, np.expm1(1j * whole) / np.where(near, 1, np.expm1(1j * step)))
    return out


def _rows_udf(kind: str):
    """UDF (m2, re, im, k1, rows, columns, n, mean) -> powers at k1, k1 + rows, ... up to n / 2."""
    @F.pandas_udf("array<double>")
    def run(at: pd.Series, re: pd.Series, im: pd.Series, k1: pd.Series, m_1: pd.Series, m_2: pd.Series, size: pd.Series, mean: pd.Series) -> pd.Series:
        out = []
        for a, x, y, r, n1, n2, n, mu in zip(at, re, im, k1, m_1, m_2, size, mean):
            grid = np.zeros(int(n2), complex)
            grid[np.asarray(a, np.int64)] = np.asarray(x) + 1j * np.asarray(y)
            k = np.arange(int(r), n // 2 + 1, int(n1))
            f = np.fft.fft(grid)[:len(k)] / kernel_transform(k, int(n1) * int(n2)) - mu * hann_transform(k, int(n))
            p = np.abs(f) ** 2
            if kind == "power":
                p = p / float(n) ** 2 * np.where((k == 0) | (2 * k == n) | (k == n // 2), 1.0, 4.0)
            out.append(p)
        return pd.Series(out)

    return run


def long_power(binned: DataFrame, keys: list[str], kind: str = "power") -> DataFrame:
    """keys, n_bins, k, power: the Hann-windowed spectrum of (keys, n_bins, bin, c), whatever its length.

    ``power`` is the squared one-sided amplitude, ``raw`` the bare square, as in the transform of short series.
    """
    size = binned.groupBy(*keys).agg(F.first("n_bins").alias("_n"), (F.sum("c") / F.first("n_bins")).alias("_mean"))
    bits = F.ceil(F.log2(F.col("_n").cast("double"))) + 1
    size = size.withColumns({"_r": F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long"), "_q": F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("long")})
    size = small(size)
    e = binned.select(*keys, "bin", "c").join(size, keys)
    hann = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("bin") / (F.col("_n") - 1))
    group = [*keys, "_n", "_mean", "_r", "_q"]
    grid = spread(e, group, F.col("_r") * F.col("_q"), F.col("bin") / F.col("_n"), {"v": F.col("c") * hann})
    first = grid.groupBy(*group, (F.col("cell") % F.col("_q")).alias("m2")).agg(F.collect_list(F.struct(F.expr("cell div _q").alias("m1"), "v")).alias("_g"))
    first = first.select(*group, "m2", _columns_udf()(F.col("_g.m1"), F.col("_g.v"), "m2", "_r", "_q").alias("z"))
    turned = first.select(*group, "m2", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("k1", "z"))
    second = turned.groupBy(*group, "k1").agg(F.collect_list(F.struct("m2", "z.re", "z.im")).alias("_g"))
    power = _rows_udf(kind)(F.col("_g.m2"), F.col("_g.re"), F.col("_g.im"), "k1", "_r", "_q", "_n", "_mean")
    rows = second.select(*group, "k1", F.posexplode(power).alias("k2", "power"))
    return rows.select(*keys, F.col("_n").cast("int").alias("n_bins"), (F.col("k1") + F.col("k2") * F.col("_r")).alias("k"), "power")


def row_median(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Median of a positive column per group, of any size: a histogram of logarithms finds the bucket, which alone is ordered."""
    b = rows.select(*keys, F.col(value).alias("_v"), F.floor(F.log(F.col(value) + 1e-300) * 256).cast("long").alias("_b"))
    w = Window.partitionBy(*keys)
    h = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    h = h.withColumns({"_before": F.sum("_n").over(w.orderBy("_b")) - F.col("_n"), "_tot": F.sum("_n").over(w)})
    lo, hi = F.floor((F.col("_tot") - 1) / 2), F.floor(F.col("_tot") / 2)
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))
    h = small(h.where(inside(lo) | inside(hi)).drop("_n"))
    at = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_v")) - 1 + F.col("_before")
    hit = b.join(h, [*keys, "_b"]).withColumn("_r", at).where((F.col("_r") == lo) | (F.col("_r") == hi))
    return hit.groupBy(*keys).agg(F.avg("_v").alias(out))


def long_lines(rows: DataFrame, keys: list[str], fs: Column, fmin: float, fmax: float, n_harmonics: int = 3) -> DataFrame:
    """peak_freq, peak_power, snr, harmonic of the spectra of :func:`long_power`, by the same rules as those of short series."""
    group = [*keys, "n_bins"]
    rows = rows.withColumn("df_hz", fs / F.col("n_bins"))
    k, step = F.col("k"), F.col("df_hz")
    band = (k >= F.ceil(fmin / step - 1e-9)) & (k <= F.floor(fmax / step + 1e-9))
    top = small(rows.groupBy(*group, "df_hz").agg(F.max_by("k", F.when(band, F.struct("power", -k))).alias("_k"), F.max(F.when(band, F.col("power"))).alias("peak_power")))
    noise = row_median(rows.where("k > 0"), keys, "power", "_noise")
    near = rows.join(top.select(*keys, "_k"), keys)
    at = [F.max(F.when((k >= m * F.col("_k") - 1) & (k <= m * F.col("_k") + 2), F.col("power"))).alias(f"_v{m}") for m in range(1, n_harmonics + 2)]
    tops = near.groupBy(*keys).agg(*at)
    j = top.join(tops, keys).join(noise, keys)
    f0, last = F.col("_k") * step, F.least(F.lit(float(fmax)), F.floor(F.col("n_bins") / 2) * step)
    there = [F.when(m * f0 <= last, 1).otherwise(0) for m in range(2, n_harmonics + 2)]
    hits = [F.when((m * f0 <= last) & (F.col(f"_v{m}") > 0.25 * F.col("_v1")), 1).otherwise(0) for m in range(2, n_harmonics + 2)]
    n = sum(there[1:], there[0])
    score = F.when((f0 > 0) & (n > 0), sum(hits[1:], hits[0]) / n).otherwise(0.0)
    has = F.col("_k").isNotNull()
    return j.select(*group, "df_hz", F.when(has, f0).alias("peak_freq"), F.coalesce("peak_power", F.lit(0.0)).alias("peak_power"),
                    F.when(has, F.col("peak_power") / (F.col("_noise") + 1e-12)).otherwise(0.0).alias("snr"), F.when(has, score).otherwise(0.0).alias("harmonic"))
