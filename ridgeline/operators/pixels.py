"""Colour tables and scalogram pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _hsv(hue: Column, value: Column) -> list[Column]:
    """RGB of a hue in sixths of the circle, full saturation."""
    i = F.floor(hue) % 6
    f = hue - F.floor(hue)
    v, p, q, t = value, F.lit(0.0), value * (1 - f), value * f
    pick = lambda *c: F.element_at(F.array(*c), (i + 1).cast("int"))
    return [pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b")]


def colors(spark: SparkSession, kind: str = "color", n: int = 256) -> DataFrame:
    """level, r, g, b: "color" (270 degrees of hue down to 0), "grey" or "b2r" (blue to black to red)."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("level"), (F.col("id") / F.lit(float(max(n - 1, 1)))).alias("t"))
    if kind == "color":
        return rows.select("level", *_hsv((1 - F.col("t")) * 270.0 / 60.0, F.pow("t", F.lit(0.3))))
    if kind == "grey":
        return rows.select("level", F.col("t").alias("r"), F.col("t").alias("g"), F.col("t").alias("b"))
    if kind != "b2r":
        raise ValueError(f"unknown colours {kind!r}")
    half, first = n // 2, n // 2 + n % 2
    down = F.sqrt(F.greatest(1 - F.col("level") / F.lit(float(max(first - 1, 1))), F.lit(0.0)))
    up = F.sqrt(F.greatest((F.col("level") - first) / F.lit(float(max(half - 1, 1))), F.lit(0.0)))
    zero = F.lit(0.0)
    return rows.select("level", F.when(F.col("level") < first, zero).otherwise(up).alias("r"), zero.alias("g"), F.when(F.col("level") < first, down).otherwise(zero).alias("b"))


def pixels(coefficients: DataFrame, norm: str = "lglobal", n_colors: int = 256, signed: bool = False, vlim: tuple[float, float] | None = None, causal: bool = True) -> DataFrame:
    """series, si, pos, v in [0, 1], level, masked (outside the valid range).

    lglobal divides by the scale's greatest valid modulus, global by the series'
    one or vlim[1], signedglobal maps [-max, max] or vlim to [0, 1]; a limit of 0,
    or two equal ones, are a unit apart."""
    norm = "signedglobal" if signed else norm
    inside = (F.col("pos") >= F.col("firstp")) & (F.col("pos") <= F.col("lastp")) if causal else F.lit(True)
    m, series = F.abs("w"), Window.partitionBy("series")
    one = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))
    if norm == "lglobal":
        v = m / one(F.max(F.when(inside, m)).over(Window.partitionBy("series", "si")))
    elif norm == "global":
        v = m / one(F.lit(float(vlim[1])) if vlim else F.max(m).over(series))
    elif norm == "signedglobal":
        top = F.lit(float(vlim[1])) if vlim else F.max(m).over(series)
        low = F.lit(float(vlim[0])) if vlim else -top
        top = F.when(top == low, low + 1.0).otherwise(top)
        v = (F.col("w") - low) / (top - low)
    else:
        raise ValueError(f"unknown norm {norm!r}")
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    rows = coefficients.select("series", "si", "pos", v.alias("v"), (~inside).alias("masked"))
    level = F.least(F.floor(F.round(F.col("v") * n_colors, 9)), F.lit(n_colors - 1)).cast("int")
    return rows.select("series", "si", "pos", "v", level.alias("level"), "masked")


def painted(rows: DataFrame, kind: str = "color", n_colors: int = 256) -> DataFrame:
    """Pixels with r, g, b; the colour table has n_colors rows and is broadcast."""
    return rows.join(F.broadcast(colors(rows.sparkSession, kind, n_colors)), "level")


def _png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGBA image (height, width, 4) as a PNG file."""
    height, width, _ = rgb.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], axis=1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def images(rows: DataFrame) -> DataFrame:
    """series, width, height, png of painted pixels (painted()): the finest scale at the bottom, masked pixels transparent.

    An image has a pixel for each sample; a longer series than one wants to look at is to be thinned before."""

    def draw(p: pd.DataFrame) -> pd.DataFrame:
        width, height = int(p["pos"].max()) + 1, int(p["si"].max()) + 1
        out = np.zeros((height, width, 4), np.uint8)
        rgb = np.rint(p[["r", "g", "b"]].fillna(0).to_numpy() * 255).astype(np.uint8)
        at = height - 1 - p["si"].to_numpy(), p["pos"].to_numpy()
        out[at] = np.column_stack([rgb, np.where(p["masked"].to_numpy(), 0, 255).astype(np.uint8)])
        return pd.DataFrame({"series": [p["series"].iloc[0]], "width": [width], "height": [height], "png": [_png(out)]})

    return rows.select("series", "si", "pos", "r", "g", "b", "masked").groupBy("series").applyInPandas(draw, "series string, width int, height int, png binary")


def extent(coefficients: DataFrame) -> DataFrame:
    """series, x_lo, x_hi, y_lo, y_hi of the image: positions, and log2 scales with half a step around."""
    scale = coefficients.groupBy("series", "a").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    w = Window.partitionBy("series").orderBy("a")
    step = F.log2(F.lead("a").over(w)) - F.log2("a")
    rows = scale.withColumns({"y": F.log2("a"), "step": step, "k": F.row_number().over(w)})
    dy = F.coalesce(F.max(F.when(F.col("k") == 1, F.col("step"))), F.lit(1.0))
    return rows.groupBy("series").agg(F.min("lo").alias("x_lo"), F.max("hi").alias("x_hi"), (F.min("y") - dy / 2).alias("y_lo"), (F.max("y") + dy / 2).alias("y_hi"))
