"""Hurst exponents by rescaled range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a piece of a series.
CHUNK = 1 << 16


def ladder(n: int, min_block: int = 8, max_blocks: int = 40) -> list[int]:
    """Block sizes: each is the last one times 1.5, down to whole numbers, up to a quarter of the series."""
    out, size = [], min_block
    while size <= n / 4 and len(out) < max_blocks:
        out.append(size)
        size = int(1.5 * size)
    return out


def _groups(t: pa.Table) -> np.ndarray:
    """Numbers of the runs of equal (series, chunk)."""
    name = t.column("series").combine_chunks().dictionary_encode()
    name = (name.combine_chunks() if isinstance(name, pa.ChunkedArray) else name).indices.to_numpy()
    piece = t.column("chunk").to_numpy()
    return np.cumsum(np.concatenate([[False], (name[1:] != name[:-1]) | (piece[1:] != piece[:-1])]))


def _pieces(group: np.ndarray, n: np.ndarray, begin: np.ndarray, at: np.ndarray, x: np.ndarray, chunk: int, min_block: int, max_blocks: int):
    """(group, bs, block, whole, count, total, squares, low, high, rs) for each size; the others have one value a sample, in order.

    A group is a chunk of a series of n samples that begins at `begin`; rs is that of the blocks that lie in their chunk as a whole."""
    for bs in ladder(int(n.max()), min_block, max_blocks):
        block = at // bs
        use = (4 * bs <= n) & (block < n // bs)
        if not use.any():
            continue
        g, own, part, base = group[use], block[use], x[use], begin[use]
        start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (own[1:] != own[:-1])]))
        count = np.diff(np.append(start, len(g)))
        total = np.add.reduceat(part, start)
        mean = total / count
        # a block with a value that isn't finite must not reach the sums of others
        fine = np.isfinite(mean)
        d = np.where(np.repeat(fine, count), part - np.repeat(mean, count), 0.0)
        squares = np.where(fine, np.add.reduceat(d * d, start), np.nan)
        low, high = np.minimum.reduceat(part, start), np.maximum.reduceat(part, start)
        y = np.cumsum(d)
        y -= np.repeat(np.append(0.0, y)[start], count)
        reach = np.maximum.reduceat(y, start) - np.minimum.reduceat(y, start)
        rs = np.where(fine, reach / np.sqrt(squares / (count - 1)), np.nan)
        own, base = own[start], base[start]
        whole = (own * bs >= base) & ((own + 1) * bs <= base + chunk)
        yield g[start], np.full(len(own), bs), own, whole, count, total, squares, low, high, rs


def rescaled_ranges(signals: DataFrame, min_block: int = 8, max_blocks: int = 40, chunk: int = CHUNK) -> DataFrame:
    """series, bs, block, rs of every whole block with values; rs is null where the block is constant.

    A series is cut into pieces of `chunk` samples. Blocks inside a piece are done
    there; of others each piece gives its sums, which tell the block's mean and the
    running sum that the piece begins with, and in a second pass the extremes of the
    running sum come from the pieces by aggregation. No task holds more than a piece."""
    lengths = signals.groupBy("series").agg(F.count("*").alias("n"))
    rows = signals.where("x is not null").join(lengths, "series").select("series", "n", F.floor(F.col("pos") / F.lit(chunk)).alias("chunk"), "pos", F.col("x").cast("double").alias("x"))

    def measure(batches):
        """Whole groups of the sorted rows; the last one of a batch waits for the next batch."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            group = _groups(held)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from digest(held.slice(0, cut), group[:cut])
                held = held.slice(cut)
        if held is not None:
            yield from digest(held, _groups(held))

    def digest(t, group):
        n, piece, at, x = (t.column(k).to_numpy() for k in ("n", "chunk", "pos", "x"))
        with np.errstate(all="ignore"):
            found = list(_pieces(group, n, piece * chunk, at, x, chunk, min_block, max_blocks))
        if not found:
            return
        columns = [np.concatenate(c) for c in zip(*found)]
        names = t.column("series").take(pa.array(np.searchsorted(group, columns[0])))
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.float64()] * 4]
        arrays = [pa.array(c, k) for c, k in zip(columns[1:], types)]
        rs = pa.array(columns[9], pa.float64(), mask=(columns[7] == columns[8]) | (columns[4] < 2))
        yield from pa.Table.from_arrays([names, pa.array(piece[np.searchsorted(group, columns[0])]), *arrays, rs], names=["series", "chunk", "bs", "block", "whole", "n", "total", "squares", "low", "high", "rs"]).to_batches()

    schema = "series string, chunk long, bs long, block long, whole boolean, n long, total double, squares double, low double, high double, rs double"
    pieces = rows.repartition("series", "chunk").sortWithinPartitions("series", "chunk", "pos").mapInArrow(measure, schema)
    # blocks over several pieces: their mean and deviation, and the running sum before each piece
    block = Window.partitionBy("series", "bs", "block")
    before = block.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.where("not whole").withColumn("mean", F.sum("total").over(block) / F.sum("n").over(block))
    parts = parts.withColumn("carry", F.coalesce(F.sum(F.col("total") - F.col("n") * F.col("mean")).over(before), F.lit(0.0)))
    squares = F.sum(F.col("squares") + F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("mean"), F.lit(2))).over(block)
    deviation = F.when(F.max("high").over(block) > F.min("low").over(block), F.sqrt(F.try_divide(squares, F.sum("n").over(block) - 1)))
    parts = parts.select("series", "chunk", "bs", "block", "mean", "carry", deviation.alias("dev"))

    def extremes(key, left, right):
        at, x = left.column("pos").to_numpy(), left.column("x").to_numpy()
        order, out = np.argsort(at, kind="stable"), []
        at, x = at[order], x[order]
        for p in right.select(["bs", "block", "mean", "carry", "dev"]).to_pylist() if len(at) else []:
            i, j = np.searchsorted(at, [p["block"] * p["bs"], (p["block"] + 1) * p["bs"]])
            y = p["carry"] + np.cumsum(x[i:j] - p["mean"])
            out.append((key[0].as_py(), p["bs"], p["block"], y.min(), y.max(), p["dev"]))
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 3]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["series", "bs", "block", "low", "high", "dev"])

    long = rows.where(F.col("n") > chunk).groupBy("series", "chunk")
    ends = long.cogroup(parts.groupBy("series", "chunk")).applyInArrow(extremes, "series string, bs long, block long, low double, high double, dev double")
    crossing = ends.groupBy("series", "bs", "block").agg(F.try_divide(F.max("high") - F.min("low"), F.nullif(F.max("dev"), F.lit(0.0))).alias("rs"))
    return pieces.where("whole").select("series", "bs", "block", "rs").unionByName(crossing)


def ranges_by_size(signals: DataFrame, min_block: int = 8, max_blocks: int = 40) -> DataFrame:
    """series, bs, log_n, log_rs: mean over the positive blocks of each size."""
    blocks = rescaled_ranges(signals, min_block, max_blocks).where("rs > 0 and not isnan(rs)")
    return blocks.groupBy("series", "bs").agg(F.avg("rs").alias("rs")).select("series", "bs", F.log2(F.col("bs").cast("double")).alias("log_n"), F.log2("rs").alias("log_rs"))


def hurst_rs(signals: DataFrame, min_block: int = 8, max_blocks: int = 40) -> DataFrame:
    """series, hurst, se: slope of log range on log size and its standard error; null below three sizes."""
    x, y = F.col("log_n"), F.col("log_rs")
    fits = ranges_by_size(signals, min_block, max_blocks).groupBy("series").agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_sxx(y, x).alias("sxx")
    )
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(F.try_divide(F.try_divide(rss, F.nullif(F.col("n") - 2, F.lit(0))), F.nullif(F.col("sxx"), F.lit(0.0))))
    fits = fits.select("series", F.when(F.col("n") >= 3, F.col("slope")).alias("hurst"), F.when(F.col("n") >= 3, se).alias("se"))
    return signals.select("series").distinct().join(fits, "series", "left")
