"""Signals: (series STRING, pos LONG, x DOUBLE), positions from 0 without gaps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- from tables ---------------------------------------------------------------------


def in_order(rows: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Values of each series numbered in the given order."""
    w = Window.partitionBy("series").orderBy(*order)
    named = rows.select(F.col(series).cast("string").alias("series"), *order, F.col(value).cast("double").alias("x"))
    return named.select("series", (F.row_number().over(w) - 1).cast("long").alias("pos"), "x")


def per_step(rows: DataFrame, series: str, step: Column, value: str) -> DataFrame:
    """Sums per whole-numbered step between the first and last step of all rows; steps without rows are 0."""
    sums = rows.groupBy(F.col(series).cast("string").alias("series"), step.cast("long").alias("step")).agg(F.sum(value).alias("s"))
    span = rows.agg(F.min(step).cast("long").alias("lo"), F.max(step).cast("long").alias("hi"))
    grid = sums.select("series").distinct().join(F.broadcast(span)).select("series", "lo", F.explode(F.sequence("lo", "hi")).alias("step"))
    return grid.join(sums, ["series", "step"], "left").select("series", (F.col("step") - F.col("lo")).alias("pos"), F.coalesce("s", F.lit(0.0)).alias("x"))


def from_arrays(rows: DataFrame, series: str, array: str) -> DataFrame:
    """One series per row from an array column."""
    return rows.select(F.col(series).cast("string").alias("series"), F.posexplode(array).alias("pos", "x")).select("series", F.col("pos").cast("long"), F.col("x").cast("double"))


# --- text files -----------------------------------------------------------------------


def parse_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """year, julian_day, displacement, quality from lines of four white-space separated fields.

    A malformed number is null, or an error with strict."""
    cast = "cast" if strict else "try_cast"
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 4)
    return f.select(F.col("f")[0].alias("year"), F.expr(f"{cast}(f[1] as double)").alias("julian_day"), F.expr(f"{cast}(f[2] as double)").alias("displacement"), F.col("f")[3].alias("quality"))


def read_text(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return parse_lines(spark.read.text(path), strict)


def time_axis(year: str = "year", julian_day: str = "julian_day") -> Column:
    """Fractional year; every fourth year counts as a leap year."""
    return F.expr(f"cast({year} as int) + ({julian_day} - 1) / (365 + case when pmod(cast({year} as int), 4) = 0 then 1 else 0 end)")


def date_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from start to end, both inclusive; bounds are 'YYYY.DDD', their part after the point a whole day."""
    (y0, d0), (y1, d1) = (tuple(int(p) for p in b.split(".")) for b in (start, end))
    at = F.struct(F.col("year").cast("int").alias("y"), F.col("julian_day").cast("double").alias("d"))
    bound = lambda y, d: F.struct(F.lit(y).alias("y"), F.lit(float(d)).alias("d"))
    return rows.where((at >= bound(y0, d0)) & (at <= bound(y1, d1)))


# --- generators ---------------------------------------------------------------------------


def cascade_measure(spark: SparkSession, size: int, r: list[float], p: list[float], flip: int = 0, series: str = "cascade") -> DataFrame:
    """A multinomial cascade on [0, 1) in `size` cells.

    Each interval is cut into parts of lengths r with weights p until it is no
    longer than a cell; its mass lands in the cell of its first end. Part `flip`
    is passed on with its ends swapped (-1: none). The levels are nested
    explodes in one stage; the cells are summed with partial aggregation."""
    dx = 1.0 / size
    longest = max(r)
    levels = 1 + (math.ceil(math.log(dx) / math.log(longest)) if 0 < longest < 1 else 0)
    rows = spark.sql("select struct(0D as l, 1D as r, 1D as m) as s")
    for _ in range(levels):
        parts, left = [], "s.l"
        for i, (ri, pi) in enumerate(zip(r, p)):
            right = f"({left} + (s.r - s.l) * {float(ri)!r}D)"
            a, b = (right, left) if i == flip else (left, right)
            parts.append(f"named_struct('l', {a}, 'r', {b}, 'm', s.m * {float(pi)!r}D)")
            left = right
        rows = rows.selectExpr(f"explode(case when abs(s.r - s.l) <= {dx!r}D then array(s) else array({', '.join(parts)}) end) as s")
    cells = rows.selectExpr(f"least(cast(s.l / {dx!r}D as bigint), {size - 1}L) as pos", "s.m").groupBy("pos").agg(F.sum("m").alias("x"))
    grid = spark.range(size).withColumnRenamed("id", "pos")
    return grid.join(cells, "pos", "left").select(F.lit(series).alias("series"), "pos", F.coalesce("x", F.lit(0.0)).alias("x"))


def staircase(signals: DataFrame) -> DataFrame:
    """Running sums along each series."""
    w = Window.partitionBy("series").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return signals.select("series", "pos", F.sum("x").over(w).alias("x"))


def tau_equation(tau: Column, q: Column, r: list[float], p: list[float]) -> Column:
    """sum of p**q * r**-tau, minus 1."""
    return sum((F.pow(F.lit(float(pi)), q) * F.pow(F.lit(float(ri)), -tau) for ri, pi in zip(r, p)), F.lit(0.0)) - 1


def solve_tau(q: np.ndarray, r: list[float], p: list[float]) -> np.ndarray:
    """The root in [-20, 20] of the tau equation for each q, by bisection; an error without a change of sign."""
    r_, p_ = np.array(r, dtype=float), np.array(p, dtype=float)
    q = np.asarray(q, dtype=float)[:, None]
    f = lambda t: (p_**q * r_ ** -t[:, None]).sum(axis=1) - 1
    lo, hi = np.full(len(q), -20.0), np.full(len(q), 20.0)
    if np.any(np.sign(f(lo)) == np.sign(f(hi))):
        raise ValueError("no change of sign on [-20, 20]")
    rising = f(hi) > 0
    for _ in range(200):
        mid = (lo + hi) / 2
        up = (f(mid) > 0) == rising
        hi, lo = np.where(up, mid, hi), np.where(up, lo, mid)
    return (lo + hi) / 2
