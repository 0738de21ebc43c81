"""Ridges: maxima linked across scales into chains.

Linking folds over the scales of a series, so it runs as one grouped function per
series on (si, ext, abscissa); everything after it is windows by (series, chain).
A chain is named after its maximum at scale 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Links longer than this are not made.
MAX_LINK = 9_999_999.0
LINKED = "series string, si int, ext int, abscissa double, ordinate double, idx long, coarser int, finer int, chain int"


def nearest(finer: np.ndarray, coarser: np.ndarray) -> np.ndarray:
    """Index of the nearest of the sorted coarser positions for each finer one; ties to the right."""
    right = np.clip(np.searchsorted(coarser, finer), 0, len(coarser) - 1)
    left = np.maximum(right - 1, 0)
    best = np.where(np.abs(coarser[right] - finer) <= np.abs(coarser[left] - finer), right, left)
    # of equal positions the last one counts
    return np.searchsorted(coarser, coarser[best], side="right") - 1


def link_series(rows: pd.DataFrame, max_link: float = MAX_LINK) -> pd.DataFrame:
    """Adds coarser, finer and chain: each eligible finer maximum asks its nearest coarser one, which takes the closest asker, the earliest of equal ones."""
    rows = rows.sort_values(["si", "ext"], kind="stable").reset_index(drop=True)
    at = {int(s): g.index.to_numpy() for s, g in rows.groupby("si")}
    pos = rows["abscissa"].to_numpy()
    n = len(rows)
    coarser, finer, chain = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    chain[at.get(0, [])] = np.arange(len(at.get(0, [])))
    for s in range(1, max(at, default=0) + 1):
        fine, coarse = at.get(s - 1), at.get(s)
        if fine is None or coarse is None:
            continue
        ask = fine if s == 1 else fine[finer[fine] >= 0]
        if not len(ask):
            continue
        to = coarse[nearest(pos[ask], pos[coarse])]
        gap = np.abs(pos[to] - pos[ask])
        order = np.lexsort((ask, gap, to))
        order = order[gap[order] < max_link]
        won = order[np.concatenate([[True], to[order][1:] != to[order][:-1]])] if len(order) else order
        coarser[ask[won]], finer[to[won]], chain[to[won]] = to[won], ask[won], chain[ask[won]]
    ext = rows["ext"].to_numpy()
    pick = lambda i: pd.array(np.where(i >= 0, ext[np.maximum(i, 0)], 0), dtype="Int32").copy()
    for name, i in (("coarser", coarser), ("finer", finer)):
        column = pick(i)
        column[i < 0] = pd.NA
        rows[name] = column
    named = pd.array(np.maximum(chain, 0), dtype="Int32")
    named[chain < 0] = pd.NA
    rows["chain"] = named
    return rows


def link(extrema: DataFrame, max_link: float = MAX_LINK) -> DataFrame:
    """Maxima with coarser, finer (ext of the neighbour, null without) and chain (null for those on none)."""
    columns = ["series", "si", "ext", "abscissa", "ordinate", "idx"]
    return extrema.select(*columns).groupBy("series").applyInPandas(lambda p: link_series(p, max_link)[[*columns, "coarser", "finer", "chain"]], LINKED)


def prune(linked: DataFrame) -> DataFrame:
    """Chains up to their first change of sign; unlinked maxima go, but scale 0 stays whole; ext is numbered anew."""
    along = Window.partitionBy("series", "chain").orderBy("si")
    flips = F.when(F.col("ordinate") * F.lag("ordinate").over(along) < 0, F.col("si"))
    cut = F.min("cut").over(Window.partitionBy("series", "chain"))
    kept = linked.where("chain is not null").withColumn("cut", flips).withColumn("cut", cut).where("si = 0 or cut is null or si < cut")
    ext = (F.row_number().over(Window.partitionBy("series", "si").orderBy("ext")) - 1).cast("int")
    return kept.select("series", "si", ext.alias("ext"), "abscissa", "ordinate", "idx", "chain")


def pruned_count(linked: DataFrame) -> DataFrame:
    """series, n: how many maxima triggered a removal (unlinked ones, and the first flip of each chain)."""
    along = Window.partitionBy("series", "chain").orderBy("si")
    flip = F.col("chain").isNotNull() & (F.col("ordinate") * F.lag("ordinate").over(along) < 0)
    rows = linked.withColumn("flip", F.coalesce(flip, F.lit(False)))
    lone = F.count(F.when((F.col("si") > 0) & F.col("finer").isNull(), 1))
    return rows.groupBy("series").agg((lone + F.count_distinct(F.when(F.col("flip"), F.col("chain")))).alias("n"))


def sup_along(chains: DataFrame, a_min: float, n_voice: int, expo: float = 1.0) -> DataFrame:
    """Each ordinate becomes that of the greatest scaled modulus so far, from fine to coarse; ties to the later scale."""
    v = F.abs("ordinate") * F.lit(a_min) * F.pow(F.lit(2.0), F.lit(expo) * F.col("si") / F.lit(n_voice))
    w = Window.partitionBy("series", "chain").orderBy("si").rowsBetween(Window.unboundedPreceding, 0)
    return chains.withColumn("ordinate", F.max_by("ordinate", F.struct(v.alias("v"), "si")).over(w))


def trace(chains: DataFrame, a_min: float, n_voice: int) -> DataFrame:
    """series, chain, si, abscissa, log2_a, ordinate, sign of the chains of two nodes at least."""
    w = Window.partitionBy("series", "chain")
    first = F.first("ordinate").over(w.orderBy("si"))
    rows = chains.where("chain is not null").withColumn("nodes", F.count("*").over(w)).withColumn("sign", F.when(first > 0, 1).otherwise(-1))
    log2_a = F.log2(F.lit(float(a_min))) + F.col("si") / F.lit(n_voice)
    return rows.where("nodes > 1").select("series", "chain", "si", "abscissa", log2_a.alias("log2_a"), "ordinate", "sign")


def longer_than(chains: DataFrame, least: int) -> DataFrame:
    """Maxima on chains of at least that many nodes."""
    n = F.count("*").over(Window.partitionBy("series", "chain"))
    return chains.where("chain is not null").withColumn("nodes", n).where(F.col("nodes") >= least).drop("nodes")
