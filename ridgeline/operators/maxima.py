"""Modulus maxima of each scale: (series, si, ext, abscissa, ordinate, idx)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTREMA = "series string, si int, ext int, abscissa double, ordinate double, idx long"


def maxima(coefficients: DataFrame, epsilon: float = 1e-6, dx: float = 1.0, x0: float = 0.0) -> DataFrame:
    """Plateau maxima. With epsilon 0 plateaus are runs of equal values, found by windows; else the greedy scan runs per scale."""
    return _by_windows(coefficients, dx, x0) if epsilon == 0 else _by_scan(coefficients, epsilon, dx, x0)


def _place(start: Column, before: Column, value: Column, after: Column, dx: float, x0: float) -> list[Column]:
    """Abscissa and ordinate of the vertex of the parabola through three neighbours."""
    alpha, beta = (after + before) / 2 - value, (after - before) / 2
    return [((start - beta / (2 * alpha)) * dx + x0).alias("abscissa"), (value - beta * beta / (4 * alpha)).alias("ordinate")]


def _by_windows(coefficients: DataFrame, dx: float, x0: float) -> DataFrame:
    w = Window.partitionBy("series", "si").orderBy("pos")
    rows = coefficients.select("series", "si", "pos", "w")
    # position 0 is only ever a neighbour: runs start afresh at 1
    new = F.when(F.col("pos") <= 1, 1).when(F.col("w") != F.lag("w").over(w), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("series", "si")))
    rows = rows.withColumn("back", F.lag("w").over(w)).withColumn("ahead", F.lead("w").over(w))
    runs = rows.where("pos >= 1").groupBy("series", "si", "run").agg(
        F.min("pos").alias("i"), F.max("pos").alias("e"), F.first("w").alias("v"), F.min_by("back", "pos").alias("back"), F.max_by("ahead", "pos").alias("ahead"), F.first("n").alias("n")
    )
    up = (F.col("v") > 0) & (F.col("v") > F.col("back")) & (F.col("v") > F.col("ahead"))
    down = (F.col("v") < 0) & (F.col("v") < F.col("back")) & (F.col("v") < F.col("ahead"))
    found = runs.where("i < n - 3 and e + 1 < n").where(up | down)
    ext = (F.row_number().over(Window.partitionBy("series", "si").orderBy("i")) - 1).cast("int")
    return found.select("series", "si", ext.alias("ext"), *_place(F.col("i"), F.col("back"), F.col("v"), F.col("ahead"), dx, x0), F.expr("(i + e) div 2").alias("idx"))


def scan(y: np.ndarray, epsilon: float, first: int, last: int) -> list[tuple[int, int, float, float, float]]:
    """(start, end, before, value, after) of the maxima of one scale; a plateau spans at most epsilon times the norm."""
    n, out = len(y), []
    allowed = epsilon * float(np.sqrt((y[first : last + 1] ** 2).sum()))
    # a step of more than `allowed` ends any plateau: only stretches of smaller steps need a look at each sample
    small = ~(np.abs(np.diff(y)) > allowed) if n else np.zeros(0, bool)
    lone = np.zeros(n, bool)
    lone[1:-1] = ~small[:-1] & ~small[1:]
    if allowed == allowed:
        peak = np.flatnonzero(lone[: max(n - 3, 0)])
        v, p, q = y[peak], y[peak - 1], y[peak + 1]
        peak = peak[((v > 0) & (v > p) & (v > q)) | ((v < 0) & (v < p) & (v < q))]
        out = [(i, i, y[i - 1], y[i], y[i + 1]) for i in peak.tolist()]
    i = 1
    rest = np.flatnonzero(~lone)
    while i < n - 3:
        if lone[i]:
            k = np.searchsorted(rest, i)
            i = int(rest[k]) if k < len(rest) else n
            continue
        low = high = y[i]
        j = i + 1
        while j < n and max(high, y[j]) - min(low, y[j]) <= allowed:
            low, high = min(low, y[j]), max(high, y[j])
            j += 1
        if j >= n or not allowed == allowed:
            break
        before, after, value = y[i - 1], y[j], high if high >= 0 else low
        if low * high > 0 and ((value > 0 and value > before and value > after) or (value < 0 and value < before and value < after)):
            out.append((i, j - 1, before, value, after))
        i = j
    return sorted(out)


def _by_scan(coefficients: DataFrame, epsilon: float, dx: float, x0: float) -> DataFrame:
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        found = scan(rows["w"].to_numpy(), epsilon, int(rows["firstp"].iloc[0]), int(rows["lastp"].iloc[0]))
        i, e, before, v, after = (np.array(c) for c in zip(*found)) if found else (np.zeros(0),) * 5
        alpha, beta = (after + before) / 2 - v, (after - before) / 2
        return pd.DataFrame({"series": rows["series"].iloc[0], "si": rows["si"].iloc[0], "ext": np.arange(len(i)), "abscissa": (i - beta / (2 * alpha)) * dx + x0, "ordinate": v - beta * beta / (4 * alpha), "idx": ((i + e) // 2).astype(np.int64)})

    return coefficients.groupBy("series", "si").applyInPandas(one, EXTREMA)
