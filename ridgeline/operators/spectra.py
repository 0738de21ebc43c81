"""Scaling exponents and singularity spectra by regression over scales."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.signals import solve_tau
from .moments import value_d, value_h, value_t


def scale_index(log2_a: float, a_min: float, n_voice: int) -> int:
    """The scale a bound falls on, truncated."""
    return int((log2_a - math.log2(a_min)) / (1.0 / n_voice))


def gradient(value: str, along: str, *keys: str) -> Column:
    """Numerical derivative on an uneven grid: second order inside, one-sided at both ends; null beside a null."""
    w = Window.partitionBy(*keys).orderBy(along)
    f, x = F.col(value), F.col(along)
    f0, x0, f1, x1 = F.lag(value).over(w), F.lag(along).over(w), F.lead(value).over(w), F.lead(along).over(w)
    h0, h1 = x - x0, x1 - x
    inner = (h0 * h0 * f1 + (h1 * h1 - h0 * h0) * f - h1 * h1 * f0) / (h0 * h1 * (h0 + h1))
    return F.when(x0.isNull(), (f1 - f) / h1).when(x1.isNull(), (f - f0) / h0).otherwise(inner)


def _slope(y: Column) -> Column:
    """Least-squares slope on x; null if any value is missing or not finite."""
    fine = y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    return F.when(F.count(F.when(fine, 1)) == F.count("*"), F.regr_slope(y, F.col("x")))


def spectrum(moments: DataFrame, a_min: float, n_voice: int, log2_lo: float, log2_hi: float, mode: str = "extensive", normalize: bool = False, method: str = "canonical") -> DataFrame:
    """series, q, tau_q, h_q, d_q, tau_1, method from a partition function.

    canonical fits H and D over the scales, legendre fits T and differentiates;
    with normalize T(q=1) is taken off, which needs q = 1 among the q. A series with
    fewer than two scales in the range has no spectrum: its values are null."""
    if method not in ("canonical", "legendre"):
        raise ValueError(f"unknown method {method!r}")
    lo, hi = max(scale_index(log2_lo, a_min, n_voice), 0), scale_index(log2_hi, a_min, n_voice)
    x = F.lit(math.log2(a_min)) + F.col("si") / F.lit(float(n_voice))
    rows = moments.where((F.col("si") >= lo) & (F.col("si") <= F.least(F.lit(hi), F.col("index_max")))).withColumn("x", x)
    rows = rows.withColumns({"t": value_t(mode), "h": value_h(mode), "d": value_d(mode)})
    fits = rows.groupBy("series", "q").agg(_slope(F.col("t")).alias("t"), _slope(F.col("h")).alias("h"), _slope(F.col("d")).alias("d"))
    one = F.abs(F.col("q") - 1) <= 1e-8 + 1e-5
    by_series = Window.partitionBy("series")
    fits = fits.withColumn("t1", F.max(F.when(one, F.col("t"))).over(by_series))
    if normalize:
        # as tau(q) - tau(1); without q = 1 this is an error
        fits = fits.withColumn("ones", F.count(F.when(one, 1)).over(by_series))
        fits = fits.withColumn("t1", F.when(F.col("ones") > 0, F.col("t1")).otherwise(F.raise_error(F.lit("normalize needs q = 1")).cast("double")))
        fits = fits.withColumns({"t": F.col("t") - F.col("t1"), "d": F.col("d") + F.col("t1")})
    if method == "canonical":
        out = fits.select("series", "q", (F.col("q") * F.col("h") - F.col("d")).alias("tau_q"), F.col("h").alias("h_q"), F.col("d").alias("d_q"), "t1")
    else:
        out = fits.select("series", "q", F.col("t").alias("tau_q"), gradient("t", "q", "series").alias("h_q"), "t1")
        out = out.withColumn("d_q", F.col("q") * F.col("h_q") - F.col("tau_q"))
    if normalize:
        tau_1 = F.col("t1")
    else:
        # tau at q = 1, else by linear interpolation between its neighbours, held at the ends
        below = F.max_by(F.struct("q", "tau_q"), F.when((F.col("q") <= 1) & F.col("tau_q").isNotNull(), F.col("q"))).over(by_series)
        above = F.min_by(F.struct("q", "tau_q"), F.when((F.col("q") >= 1) & F.col("tau_q").isNotNull(), F.col("q"))).over(by_series)
        exact = F.max(F.when(one, F.col("tau_q"))).over(by_series)
        out = out.withColumns({"lo": below, "hi": above, "fits": F.count("tau_q").over(by_series)})
        between = F.col("lo.tau_q") + (1 - F.col("lo.q")) * (F.col("hi.tau_q") - F.col("lo.tau_q")) / F.nullif(F.col("hi.q") - F.col("lo.q"), F.lit(0.0))
        guess = F.when(F.col("lo").isNull(), F.col("hi.tau_q")).when(F.col("hi").isNull(), F.col("lo.tau_q")).otherwise(between)
        tau_1 = F.coalesce(exact, F.when(F.col("fits") >= 2, guess))
    return out.select("series", "q", "tau_q", "h_q", "d_q", tau_1.alias("tau_1"), F.lit(method).alias("method"))


def theoretical_spectrum(qs: DataFrame, r: list[float], p: list[float], expo: float = -1.0) -> DataFrame:
    """q, tau_q, h_q, d_q of the staircase of a cascade with lengths r and weights p."""

    def solve(batches):
        for b in batches:
            yield pd.DataFrame({"q": b["q"], "tau_q": solve_tau(b["q"].to_numpy(), r, p) + (1 + expo) * b["q"].to_numpy()})

    tau = qs.select(F.col("q").cast("double")).mapInPandas(solve, "q double, tau_q double")
    rows = tau.withColumn("all", F.lit(1)).withColumn("h_q", gradient("tau_q", "q", "all"))
    return rows.select("q", "tau_q", "h_q", (F.col("q") * F.col("h_q") - F.col("tau_q")).alias("d_q"))


def tau_equal_lengths(q: np.ndarray, r: float, p: list[float]) -> np.ndarray:
    """Closed form when all parts have length r."""
    return np.log(np.sum(np.asarray(p)[None, :] ** np.asarray(q)[:, None], axis=1)) / math.log(r)
