"""Scale grid and continuous wavelet transform.

Four plans give the same coefficients. "chunks", the default, cuts a series into
pieces of CHUNK samples with as many neighbouring (or mirrored) samples on both
sides as the widest filter needs, by overlap-save: no task holds a series, and
a piece is transformed at all scales where it is. "arrow" has one task row per series and
scale, "arrays" uses higher-order functions on packed series, and "join" joins every sample
with every tap, piece by piece, and sums in the JVM, where the joined rows stay within
their task; these three are for comparison.

A series shorter than a scale's filter has null coefficients at that scale, or is an
error with short="raise"."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wavelets import wavelet

PRESETS = {"direct": ("convolve", "reflect"), "overlap_save": ("correlate", "edge_mirror")}
#: Samples of a piece of a series.
CHUNK = 1 << 16
#: Samples of a piece in the plan "join", unless the filters are wider, and coefficients that one of its tasks sums up.
JOIN_CHUNK, JOIN_SUMS = 1 << 13, 1 << 20
COEFFICIENTS = "series string, si int, a double, pos long, w double, firstp long, lastp long"


def scale_values(a_min: float, n_oct: int, n_voice: int) -> list[float]:
    factor = 2.0 ** (1.0 / n_voice)
    return [a_min * factor**i for i in range(n_oct * n_voice)]


def scale_grid(spark: SparkSession, a_min: float, n_oct: int, n_voice: int) -> DataFrame:
    """si, a, log2_a."""
    a = F.lit(float(a_min)) * F.pow(F.pow(F.lit(2.0), F.lit(1.0 / n_voice)), F.col("id"))
    grid = spark.range(n_oct * n_voice).select(F.col("id").cast("int").alias("si"), a.alias("a"))
    return grid.withColumn("log2_a", F.log2("a"))


def filters(spark: SparkSession, scales: list[float], name: str) -> DataFrame:
    """si, k, psi: the taps of each scale, k from -S to S. Rows depend on the scales alone."""
    rows = [(i, k - wavelet(name).half_width(a), float(v)) for i, a in enumerate(scales) for k, v in enumerate(wavelet(name).taps(a))]
    return spark.createDataFrame(rows, "si int, k int, psi double")


def pack(signals: DataFrame) -> DataFrame:
    """series, xs: the values of each series in order."""
    packed = signals.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return packed.select("series", F.transform("v", lambda s: s["x"]).alias("xs"))


def extend(x: np.ndarray, s: int, border: str) -> np.ndarray:
    """x with s values on both sides: reflected about its ends, or with its last value repeated on the right."""
    left = x[1 : s + 1][::-1]
    right = x[len(x) - 1 - s : -1][::-1] if border == "reflect" else x[len(x) - s :][::-1] if s else x[:0]
    return np.concatenate([left, x, right])


def convolve(wide: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The part of the convolution that needs nothing outside `wide`; long filters go through FFTs."""
    if len(taps) <= 256:
        return np.convolve(wide, taps, mode="valid")
    n = 1 << (len(wide) + len(taps) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(wide, n) * np.fft.rfft(taps, n), n)[len(taps) - 1 : len(wide)]


def transform_one(x: np.ndarray, a: float, name: str, expo: float, orientation: str, border: str) -> np.ndarray:
    """Coefficients of one series at one scale."""
    w = wavelet(name)
    s, taps = w.half_width(a), w.taps(a)
    if 2 * s + 1 > len(x):
        raise ValueError(f"scale {a}: filter of {2 * s + 1} samples, series of {len(x)}")
    wide = extend(x, s, border)
    if orientation == "correlate":
        taps = taps[::-1]
    return a**expo * convolve(wide, taps)


def _check(orientation: str, border: str) -> None:
    if orientation not in ("convolve", "correlate") or border not in ("reflect", "edge_mirror"):
        raise ValueError(f"unknown orientation {orientation!r} or border {border!r}")


def cwt(signals: DataFrame, a_min: float, n_oct: int, n_voice: int, name: str = "g2", expo: float = -1.0, preset: str = "direct", plan: str = "chunks", short: str = "null") -> DataFrame:
    """Coefficients (series, si, a, pos, w, firstp, lastp) of signals; firstp..lastp is free of border effects."""
    orientation, border = PRESETS[preset]
    _check(orientation, border)
    if short not in ("null", "raise"):
        raise ValueError(f"unknown treatment {short!r} of short series")
    scales = scale_values(a_min, n_oct, n_voice)
    if plan == "chunks":
        return _chunks(signals, scales, name, expo, orientation, border, short)
    if plan == "arrow":
        return _arrow(signals, scales, name, expo, orientation, border, short)
    if plan == "arrays":
        return _arrays(signals, scales, name, expo, orientation, border)
    if plan != "join":
        raise ValueError(f"unknown plan {plan!r}")
    return _join(signals, scales, name, expo, orientation, border, short)


def _too_short(a: float, s: int, n: int, short: str) -> bool:
    if 2 * s + 1 <= n:
        return False
    if short == "raise":
        raise ValueError(f"scale {a}: filter of {2 * s + 1} samples, series of {n}")
    return True


def _pieces(signals: DataFrame, halo: int, border: str, samples: int) -> DataFrame:
    """series, chunk, at, x, n: pieces of so many samples, with what filters that reach `halo` samples need on both sides."""
    size = F.lit(samples)
    lengths = signals.groupBy("series").agg(F.count("*").alias("n"))
    rows = signals.select("series", "pos", "x").join(lengths, "series")
    # a sample stands at its own place and, near an end, at its mirror images; each is needed by the pieces within reach
    mirror = 2 * F.col("n") - (2 if border == "reflect" else 1) - F.col("pos")
    left, right = (F.col("pos") > 0) & (F.col("pos") <= halo), (mirror >= F.col("n")) & (mirror < F.col("n") + halo)
    places = F.filter(F.array("pos", F.when(left, -F.col("pos")), F.when(right, mirror)), lambda p: p.isNotNull())
    rows = rows.select("series", "n", "x", F.explode(places).alias("at"))
    first = F.greatest(F.lit(0), F.floor((F.col("at") - halo) / size))
    last = F.least(F.floor((F.col("n") - 1) / size), F.floor((F.col("at") + halo) / size))
    return rows.where(first <= last).select("series", F.explode(F.sequence(first, last)).alias("chunk"), "at", "x", "n")


def _join(signals, scales, name, expo, orientation, border, short) -> DataFrame:
    """Samples joined with taps; the sums need nothing outside a piece, so only the samples are shuffled."""
    half = [wavelet(name).half_width(a) for a in scales]
    size = max(JOIN_CHUNK, *half)
    parts = -(-signals.count() * len(scales) // JOIN_SUMS)
    rows = _pieces(signals, max(half), border, size).repartition(max(1, parts), "series", "chunk")
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("si") + 1)
    taps = filters(signals.sparkSession, scales, name).select("si", (F.col("k") if orientation == "convolve" else -F.col("k")).alias("m"), "psi")
    pos = F.col("at") + F.col("m")
    inside = (pos >= F.col("chunk") * size) & (pos < F.least(F.col("n"), (F.col("chunk") + 1) * size))
    joined = rows.join(F.broadcast(taps), inside).select("series", "chunk", "si", pos.alias("pos"), "n", (F.col("x") * F.col("psi")).alias("y"))
    sums = joined.groupBy("series", "chunk", "si", "pos").agg(F.sum("y").alias("w"), F.first("n").alias("n")).withColumn("s", at(half).cast("long"))
    message = F.concat(F.lit("filter of "), 2 * F.col("s") + 1, F.lit(" samples, series of "), "n")
    lacking = F.raise_error(message).cast("double") if short == "raise" else F.lit(None).cast("double")
    w = F.when(2 * F.col("s") + 1 > F.col("n"), lacking).otherwise(F.pow(at(scales), F.lit(expo)) * F.col("w"))
    return sums.select("series", "si", at(scales).alias("a"), "pos", w.alias("w"), F.col("s").alias("firstp"), (F.col("n") - 1 - F.col("s")).alias("lastp"))


def _chunks(signals, scales, name, expo, orientation, border, short) -> DataFrame:
    """Overlap-save over pieces of CHUNK samples."""
    wave = wavelet(name)
    half = [wave.half_width(a) for a in scales]
    rows = _pieces(signals, max(half), border, CHUNK)
    rows = rows.repartition("series", "chunk").sortWithinPartitions("series", "chunk", "at")

    def transform(series, chunk, n, at, x):
        begin, end = chunk * CHUNK, min(n, (chunk + 1) * CHUNK)
        for si, (a, s) in enumerate(zip(scales, half)):
            if _too_short(a, s, n, short):
                y = pa.nulls(end - begin, pa.float64())
            else:
                taps = wave.taps(a) if orientation == "convolve" else wave.taps(a)[::-1]
                y = pa.array(a**expo * convolve(x[np.searchsorted(at, begin - s) : np.searchsorted(at, end + s)], taps))
            k = end - begin
            columns = [pa.repeat(pa.scalar(series, pa.string()), k), np.full(k, si, np.int32), np.full(k, a), np.arange(begin, end), y, np.full(k, s), np.full(k, n - 1 - s)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["series", "si", "a", "pos", "w", "firstp", "lastp"])

    def build(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def flush():
            t = pa.Table.from_batches(held)
            x = t.column("x").to_numpy().astype(float)
            yield from transform(key[0], key[1], t.column("n")[0].as_py(), t.column("at").to_numpy(), x)

        for b in batches:
            if not b.num_rows:
                continue
            names, numbers = b.column(0).to_pylist(), b.column(1).to_numpy()
            cuts = [0, *(i for i in range(1, len(names)) if numbers[i] != numbers[i - 1] or names[i] != names[i - 1]), len(names)]
            for i, j in zip(cuts, cuts[1:]):
                own = names[i], int(numbers[i])
                if held and own != key:
                    yield from flush()
                    held.clear()
                key = own
                held.append(b.slice(i, j - i))
        if held:
            yield from flush()

    return rows.mapInArrow(build, COEFFICIENTS)


def _arrow(signals, scales, name, expo, orientation, border, short) -> DataFrame:
    wave = wavelet(name)
    rows = pack(signals).withColumn("si", F.explode(F.array(*[F.lit(i) for i in range(len(scales))])))
    # a series' scales are dealt to different tasks
    rows = rows.repartition("series", "si")

    def build(batches):
        from ..functions import wavelets as registry

        registry._REGISTRY[name] = wave  # as it was when the query was made, whatever this worker ran before
        for b in batches:
            for series, xs, si in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                x, s = xs.values.to_numpy(zero_copy_only=False).astype(float), wave.half_width(scales[si])
                n = len(x)
                y = pa.nulls(n, pa.float64()) if _too_short(scales[si], s, n, short) else pa.array(transform_one(x, scales[si], name, expo, orientation, border))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([series] * n), pa.array(np.full(n, si, np.int32)), pa.array(np.full(n, scales[si])), pa.array(np.arange(n)), y, pa.array(np.full(n, s)), pa.array(np.full(n, n - 1 - s))],
                    names=["series", "si", "a", "pos", "w", "firstp", "lastp"],
                )

    return rows.mapInArrow(build, COEFFICIENTS)


def _arrays(signals, scales, name, expo, orientation, border) -> DataFrame:
    spark = signals.sparkSession
    taps = [(i, float(a), wavelet(name).half_width(a), [float(v) for v in (wavelet(name).taps(a)[::-1] if orientation == "convolve" else wavelet(name).taps(a))], float(a**expo)) for i, a in enumerate(scales)]
    table = spark.createDataFrame(taps, "si int, a double, s int, taps array<double>, scale double")
    rows = pack(signals).join(F.broadcast(table)).withColumn("n", F.size("xs"))
    right = "reverse(slice(xs, n - s, s))" if border == "reflect" else "reverse(slice(xs, n - s + 1, s))"
    rows = rows.withColumn("wide", F.expr(f"if(s = 0, xs, concat(reverse(slice(xs, 2, s)), xs, {right}))"))
    one = "aggregate(zip_with(slice(wide, p + 1, 2 * s + 1), taps, (x, t) -> x * t), 0D, (acc, v) -> acc + v) * scale"
    out = rows.select("series", "si", "a", "n", "s", F.posexplode(F.expr(f"transform(sequence(0, n - 1), p -> {one})")).alias("pos", "w"))
    return out.select("series", "si", "a", F.col("pos").cast("long"), "w", F.col("s").cast("long").alias("firstp"), (F.col("n") - 1 - F.col("s")).cast("long").alias("lastp"))


def valid_ranges(lengths: DataFrame, a_min: float, n_oct: int, n_voice: int, name: str = "g2") -> DataFrame:
    """series, si, firstp, lastp from (series, n)."""
    w = wavelet(name)
    half = [w.half_width(a) for a in scale_values(a_min, n_oct, n_voice)]
    rows = lengths.select("series", "n", F.posexplode(F.array(*[F.lit(int(s)) for s in half])).alias("si", "s"))
    return rows.select("series", "si", F.col("s").cast("long").alias("firstp"), (F.col("n") - 1 - F.col("s")).cast("long").alias("lastp"))


def log2(x: float) -> float:
    return math.log(x) / math.log(2)
