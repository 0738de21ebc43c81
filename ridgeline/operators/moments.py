"""Partition functions: sums of powers of the maxima per (series, q, scale)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("stq", "stq_log", "log_stq", "ratio", "log_stq_sq", "ratio_sq", "cross")


def partition_function(extrema: DataFrame, n_scales: int, q_list: list[float], min_chain: int | None = None, series: DataFrame | None = None) -> DataFrame:
    """series, q, si, the seven sums, n_ext, n_nonzero, index_max, signal_number, on the whole (q, scale) grid.

    Scales from a series' first empty one on are 0. With min_chain only maxima on
    chains of that many nodes count; extrema then need a chain column. A series
    whose maxima the filter takes stays, with zeros and index_max -1, and so do
    those of `series` (a table of names) that have no maxima at all.
    The grids are broadcast: their size is that of the arguments."""
    spark = extrema.sparkSession
    names = (series or extrema).select("series").distinct()
    if min_chain is not None:
        from .ridges import longer_than

        extrema = longer_than(extrema, min_chain)
    per_scale = extrema.groupBy("series", "si").agg(F.count("*").alias("n_ext"))
    grid = spark.range(n_scales).select(F.col("id").cast("int").alias("si"))
    dense = names.join(F.broadcast(grid)).join(per_scale, ["series", "si"], "left").fillna(0, ["n_ext"])
    last = dense.groupBy("series").agg((F.coalesce(F.min(F.when(F.col("n_ext") == 0, F.col("si"))), F.lit(n_scales)) - 1).cast("int").alias("index_max"))
    qs = F.explode(F.array(*[F.lit(float(q)) for q in sorted(q_list)]))
    t, ln = F.abs("ordinate"), F.ln(F.abs("ordinate"))
    powers = extrema.where("ordinate <> 0").select("series", "si", t.alias("t"), ln.alias("l"), qs.alias("q"))
    sums = powers.groupBy("series", "q", "si").agg(F.count("*").alias("n_nonzero"), F.sum(F.pow("t", "q")).alias("stq"), F.sum(F.pow("t", "q") * F.col("l")).alias("stq_log"))
    rows = dense.select("series", "si", "n_ext", qs.alias("q")).join(last, "series").join(sums, ["series", "q", "si"], "left")
    live = (F.col("si") <= F.col("index_max")) & (F.col("stq") > 0)
    keep = lambda c: F.coalesce(F.when(live, c), F.lit(0.0))
    rows = rows.withColumns({"log_stq": keep(F.ln(F.col("stq") / F.col("n_nonzero"))), "ratio": keep(F.col("stq_log") / F.col("stq")), "stq": keep(F.col("stq")), "stq_log": keep(F.col("stq_log"))})
    rows = rows.withColumns({"log_stq_sq": F.col("log_stq") ** 2, "ratio_sq": F.col("ratio") ** 2, "cross": F.col("log_stq") * F.col("ratio")})
    inside = F.col("si") <= F.col("index_max")
    counts = [F.when(inside, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in ("n_ext", "n_nonzero")]
    return rows.select("series", "q", "si", *SUMS, *counts, "index_max", F.lit(1).cast("long").alias("signal_number"))


def ensemble(moments: DataFrame, name: str = "ensemble") -> DataFrame:
    """One partition function of all series: sums added up, the smallest index_max. All series need one and the same grid."""
    sizes = moments.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.xxhash64("q", "si").cast("decimal(38,0)")).alias("grid"))
    ok = sizes.agg((F.count_distinct("n", "grid") <= 1).alias("ok"))
    added = moments.groupBy("q", "si").agg(*[F.sum(c).alias(c) for c in (*SUMS, "n_ext", "n_nonzero")], F.min("index_max").alias("index_max"), F.sum("signal_number").alias("signal_number"))
    checked = added.join(F.broadcast(ok)).withColumn("index_max", F.when(F.col("ok"), F.col("index_max")).otherwise(F.raise_error(F.lit("the series have different (q, scale) grids")).cast("int")))
    return checked.select(F.lit(name).alias("series"), "q", "si", *SUMS, "n_ext", "n_nonzero", "index_max", "signal_number")


def _mode(mode: str) -> bool:
    if mode not in ("extensive", "intensive"):
        raise ValueError(f"unknown mode {mode!r}")
    return mode == "extensive"


def value_t(mode: str = "extensive") -> Column:
    """log2 of the sum, or of the mean per signal."""
    return F.when(F.col("stq") > 0, F.log2("stq")) if _mode(mode) else F.col("log_stq") / F.ln(F.lit(2.0)) / F.col("signal_number")


def value_h(mode: str = "extensive") -> Column:
    h = F.col("ratio") / F.ln(F.lit(2.0))
    return h if _mode(mode) else h / F.col("signal_number")


def value_d(mode: str = "extensive") -> Column:
    return F.col("q") * value_h(mode) - value_t(mode)
