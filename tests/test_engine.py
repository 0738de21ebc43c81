"""Operators against hand-made fixtures, closed forms and each other."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.functions import wavelets as W
from ridgeline.operators import hurst, maxima, moments, pixels, ridges, spectra, transform
from ridgeline.sources import signals
from ridgeline.streaming.windows import windowed_signal


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "series string, pos long, x double")


def test_impulse_shows_orientation(spark):
    x = [0.0] * 256
    x[128] = 1.0
    for preset, sign in (("direct", 1), ("overlap_save", -1)):
        got = transform.cwt(series(spark, x), 1.0, 1, 1, "g1", preset=preset).orderBy("pos").toPandas()["w"].to_numpy()
        taps = W.wavelet("g1").taps(1.0)
        assert np.allclose(got[112:145], sign * taps, atol=1e-12)


@pytest.mark.parametrize("preset", ["direct", "overlap_save"])
@pytest.mark.parametrize("name", ["g1", "g2", "bspline3", "db3"])
def test_plans_agree(spark, preset, name):
    x = np.random.default_rng(3).standard_normal(160)
    plans = [transform.cwt(series(spark, x), 1.0, 1, 3, name, preset=preset, plan=p).orderBy("si", "pos").toPandas() for p in ("chunks", "arrow", "join", "arrays")]
    for other in plans[1:]:
        assert np.allclose(plans[0]["w"], other["w"], atol=1e-10)
        assert (plans[0][["firstp", "lastp"]].to_numpy() == other[["firstp", "lastp"]].to_numpy()).all()


def test_long_filters_go_through_fourier():
    x = np.random.default_rng(1).standard_normal(3000)
    y = transform.transform_one(x, 20.0, "g2", -1.0, "convolve", "reflect")
    wide, taps = transform.extend(x, W.wavelet("g2").half_width(20.0), "reflect"), W.wavelet("g2").taps(20.0)
    assert len(taps) > 256 and np.allclose(y, np.convolve(wide, taps, "valid") / 20.0, atol=1e-9)


@pytest.mark.parametrize("chunk", [7, 64, 1000])
@pytest.mark.parametrize("preset", ["direct", "overlap_save"])
def test_chunks_equal_whole_series(spark, monkeypatch, chunk, preset):
    # pieces shorter and longer than the filters, series that end anywhere in them
    monkeypatch.setattr(transform, "CHUNK", chunk)
    r = np.random.default_rng(4)
    rows = [(name, i, float(v)) for name, n in (("a", 300), ("b", 128), ("c", 97)) for i, v in enumerate(r.standard_normal(n))]
    df = spark.createDataFrame(rows, "series string, pos long, x double")
    one, other = (transform.cwt(df, 1.0, 1, 3, "g2", preset=preset, plan=p).orderBy("series", "si", "pos").toPandas() for p in ("chunks", "arrow"))
    assert len(one) == len(other) == 3 * (300 + 128 + 97) and np.allclose(one["w"], other["w"], atol=1e-9, equal_nan=True)
    assert one[["series", "si", "pos", "firstp", "lastp"]].equals(other[["series", "si", "pos", "firstp", "lastp"]])


def test_long_series_over_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("s").alias("series"), F.col("id").alias("pos"), F.sin(F.col("id") / 50.0).alias("x"))
    got = transform.cwt(df, 4.0, 1, 1, "g2").where("pos % 1000 = 500").orderBy("pos").toPandas()
    x = np.sin(np.arange(2000) / 50.0)
    want = transform.transform_one(x, 4.0, "g2", -1.0, "convolve", "reflect")
    assert len(got) == 1000 and np.allclose(got["w"].iloc[:2], want[[500, 1500]], atol=1e-9)


def test_short_series_are_null_or_an_error(spark):
    df = series(spark, [1.0] * 20, "short").unionByName(series(spark, [1.0] * 200, "long"))
    for plan in ("chunks", "arrow"):
        rows = transform.cwt(df, 1.0, 1, 1, "g2", plan=plan).toPandas()
        assert rows[rows.series == "short"]["w"].isna().all() and rows[rows.series == "long"]["w"].notna().all()
        with pytest.raises(Exception, match="filter of"):
            transform.cwt(df, 1.0, 1, 1, "g2", plan=plan, short="raise").collect()


@pytest.mark.parametrize("preset", ["direct", "overlap_save"])
def test_join_plan_keeps_joined_rows_in_their_task(spark, monkeypatch, preset):
    # pieces end within reach of both ends; short series are null at wide scales
    monkeypatch.setattr(transform, "JOIN_CHUNK", 64)
    monkeypatch.setattr(transform, "JOIN_SUMS", 500)
    r = np.random.default_rng(5)
    rows = [(name, i, float(v)) for name, n in (("a", 300), ("b", 129), ("c", 40), ("d", 1)) for i, v in enumerate(r.standard_normal(n))]
    df = spark.createDataFrame(rows, "series string, pos long, x double")
    plan = transform.cwt(df, 1.0, 1, 3, "g2", preset=preset, plan="join")
    one, other = (x.orderBy("series", "si", "pos").toPandas() for x in (plan, transform.cwt(df, 1.0, 1, 3, "g2", preset=preset, plan="arrow")))
    assert len(one) == len(other) == 3 * 470 and np.allclose(one["w"], other["w"], atol=1e-9, equal_nan=True)
    assert one[["series", "si", "pos", "firstp", "lastp"]].equals(other[["series", "si", "pos", "firstp", "lastp"]])
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in tree[: tree.index("Join")].replace("BroadcastExchange", "")  # nothing is shuffled once samples meet taps
    with pytest.raises(Exception, match="filter of"):
        transform.cwt(df, 1.0, 1, 3, "g2", preset=preset, plan="join", short="raise").collect()


def test_series_without_maxima_stay(spark):
    kept = spark.createDataFrame([("a", s, 0, 0.0, 1.0, 0, None, None, 0) for s in range(3)] + [("b", 0, 0, 0.0, 1.0, 0, None, None, 0)], ridges.LINKED)
    everyone = spark.createDataFrame([("a",), ("b",), ("c",)], "series string")
    rows = moments.partition_function(kept, 3, [1.0], min_chain=2, series=everyone).toPandas()
    assert rows.groupby("series")["index_max"].first().to_dict() == {"a": 2, "b": -1, "c": -1} and rows[rows.series != "a"]["stq"].eq(0).all()
    total = moments.ensemble(moments.partition_function(kept, 3, [1.0], min_chain=2)).toPandas()
    assert total["signal_number"].eq(2).all() and total["index_max"].eq(-1).all()


def test_images(spark):
    c = spark.createDataFrame([("s", si, 1.0, i, float(i), 1, 3) for si in range(2) for i in range(5)], transform.COEFFICIENTS)
    (row,) = pixels.images(pixels.painted(pixels.pixels(c))).collect()
    assert (row.width, row.height) == (5, 2) and bytes(row.png[:4]) == b"\x89PNG"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=0, max_size=40), st.sampled_from([0.0, 0.05, 0.2]))
def test_scan_equals_the_plain_loop(y, epsilon):
    y = np.array(y, dtype=float)
    n, want, i = len(y), [], 1
    allowed = epsilon * math.sqrt(float((y**2).sum()))
    while i < n - 3:
        j = i + 1
        while j < n and max(y[i : j + 1]) - min(y[i : j + 1]) <= allowed:
            j += 1
        if j >= n:
            break
        low, high = y[i:j].min(), y[i:j].max()
        v = high if high >= 0 else low
        if low * high > 0 and (v > 0 and v > y[i - 1] and v > y[j] or v < 0 and v < y[i - 1] and v < y[j]):
            want.append((i, j - 1))
        i = j
    assert [(i, e) for i, e, *_ in maxima.scan(y, epsilon, 0, n - 1)] == want


def test_too_short_and_unknown_arguments(spark):
    with pytest.raises(ValueError):
        transform.transform_one(np.zeros(10), 1.0, "g2", -1.0, "convolve", "reflect")
    with pytest.raises(KeyError):
        W.wavelet("nope")
    with pytest.raises(ValueError):
        transform.cwt(series(spark, [0.0] * 64), 1.0, 1, 1, plan="nope")
    with pytest.raises(ValueError):
        pixels.pixels(spark.createDataFrame([], transform.COEFFICIENTS), "nope")


def test_wavelet_families():
    u = np.linspace(-4, 4, 2001)
    h = u[1] - u[0]
    for q in (0.7, 1.4, 2.2):
        lo = W.q_gaussian(u, q, 0)
        inner = np.abs(u) < (1.0 if q < 1 else 3.5)
        for n in range(1, 4):
            lo = -np.gradient(lo, h)
            assert np.allclose(lo[inner], W.q_gaussian(u, q, n)[inner], atol=2e-3 * 10**n / 10), (q, n)
    assert np.allclose(W.q_gaussian(u, 1.0, 2), W.wavelet("g2").evaluate(u))
    for m, n in ((3, 1), (4, 2)):
        assert np.allclose(np.gradient(W.bspline_derivative(u, m, n - 1), h)[5:-5], W.bspline_derivative(u, m, n)[5:-5], atol=5e-2)
    wide = np.linspace(-400, 400, 2_000_001)
    for q in (0.3, 0.9, 1.5, 2.0):
        assert abs(np.trapezoid(W.q_mexican_hat(wide, q) ** 2, wide) - 1) < 1e-3
    assert np.isfinite(W.q_hat_norm(1.001)) and np.isfinite(W.q_hat_norm(0.999))
    x = np.linspace(-60, 60, 600_001)
    for q in (0.5, 1.0, 1.5, 2.0):
        f = W.q_mexican_hat(x, q)
        for w in (0.7, 1.5):
            direct = np.trapezoid(f * np.cos(w * x), x) / math.sqrt(2 * math.pi)
            assert abs(direct - W.q_mexican_hat_fourier(w, q)[0]) < 2e-3 + 0.02 * abs(direct), (q, w)
    assert np.allclose(W.fractional_derivative(u, 3.0, 1.0), W.bspline_derivative(u, 3, 1), atol=1e-9)
    with pytest.raises(ValueError):
        W.register_fractional(1.0, 2.0)
    with pytest.raises(ValueError):
        W.q_gaussian(u, 1.2, 5)


def test_compact_filters():
    for low in (*map(W.daubechies, (2, 3, 4)), W.COIF1, W.COIF2, W.COIF3):
        assert abs(low.sum() - math.sqrt(2)) < 1e-9
        for k in range(1, len(low) // 2):
            assert abs(np.dot(low[2 * k :], low[: -2 * k])) < 1e-8
        t, psi = W.cascade(low, 8, "standard")
        assert abs((psi.sum()) * (t[1] - t[0])) < 1e-6
    t, psi = W.cascade(W.daubechies(2), 8, "aliased")
    assert (np.diff(np.sign(psi[np.abs(psi) > 1e-6])) != 0).mean() > 0.9


def coefficients(spark, y):
    return spark.createDataFrame([("s", 0, 1.0, i, float(v), 0, len(y) - 1) for i, v in enumerate(y)], transform.COEFFICIENTS)


def test_plateau_short_and_nan(spark):
    y = [0, 1, 3, 3, 3, 1, 0, 0, 0, 0]
    for eps in (0, 1e-12):
        (row,) = maxima.maxima(coefficients(spark, y), eps).collect()
        assert (row.abscissa, row.ordinate, row.idx) == (2.0, 3.0, 3)
    assert maxima.maxima(coefficients(spark, [1, 5, 1]), 0).count() == 0
    assert maxima.maxima(coefficients(spark, [0, 1, 3, float("nan"), 3, 1, 0, 0, 0]), 1e-6).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=0, max_size=40))
def test_scan_at_zero_finds_runs(y):
    got = [(i, e) for i, e, *_ in maxima.scan(np.array(y, dtype=float), 0.0, 0, len(y))]
    want, i = [], 1
    while i < len(y) - 3:
        e = i
        while e + 1 < len(y) and y[e + 1] == y[i]:
            e += 1
        if e + 1 < len(y) and ((y[i] > 0 and y[i] > y[i - 1] and y[i] > y[e + 1]) or (y[i] < 0 and y[i] < y[i - 1] and y[i] < y[e + 1])):
            want.append((i, e))
        i = e + 1
    assert got == want


def links_of(finer, coarser):
    rows = pd.DataFrame([("s", s, k, p, 1.0, 0) for s, ps in enumerate((finer, coarser)) for k, p in enumerate(ps)], columns=["series", "si", "ext", "abscissa", "ordinate", "idx"])
    out = ridges.link_series(rows)
    return out[out.si == 0]["coarser"].tolist()


def test_tie_and_steal():
    assert links_of([10.0], [9.0, 11.0]) == [1]
    assert links_of([10.0, 10.4], [10.5]) == [pd.NA, 0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=12, unique=True), st.lists(st.integers(0, 60), min_size=1, max_size=12, unique=True))
def test_links_equal_the_sequential_rule(finer, coarser):
    finer, coarser = sorted(map(float, finer)), sorted(map(float, coarser))
    holder = {}
    for i, p in enumerate(finer):
        c = min(range(len(coarser)), key=lambda c: (abs(coarser[c] - p), -c))
        if c not in holder or abs(coarser[c] - p) < abs(coarser[c] - finer[holder[c]]):
            holder[c] = i
    want = [next((c for c, i in holder.items() if i == k), pd.NA) for k in range(len(finer))]
    assert [x if x is not pd.NA else None for x in links_of(finer, coarser)] == [x if x is not pd.NA else None for x in want]


def chain(spark, ordinates):
    rows = [("s", i, 0, 10.0, float(o), 10, None if i + 1 == len(ordinates) else 0, None if i == 0 else 0, 0) for i, o in enumerate(ordinates)]
    return spark.createDataFrame(rows, ridges.LINKED)


def test_prune_and_sup(spark):
    linked = chain(spark, [1, 2, -1, -2])
    assert [r.si for r in ridges.prune(linked).orderBy("si").collect()] == [0, 1]
    assert ridges.pruned_count(linked).first()["n"] == 1
    out = ridges.sup_along(chain(spark, [5, -1, 4, 0.1]), 1.0, 1, 1.0).orderBy("si").collect()
    assert [r.ordinate for r in out] == [5, 5, 4, 4]
    assert ridges.trace(linked, 1.0, 1).count() == 4 and ridges.longer_than(linked, 5).count() == 0


def test_zero_ordinates_and_empty_scale(spark):
    ext = spark.createDataFrame([("s", s, k, 0.0, o, 0) for s, k, o in ((0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (1, 0, 1.0), (3, 0, 1.0))], maxima.EXTREMA)
    pf = {(r.q, r.si): r for r in moments.partition_function(ext, 5, [0.0, 2.0]).collect()}
    assert pf[0.0, 0].stq == 2 and pf[0.0, 0].log_stq == 0 and pf[0.0, 0].n_ext == 3 and pf[0.0, 0].index_max == 1
    assert all(pf[q, s].stq == 0 and pf[q, s].n_ext == 0 for q in (0.0, 2.0) for s in (2, 3, 4))
    with pytest.raises(ValueError):
        moments.value_t("nope")


def test_ensemble_checks_grids(spark):
    ext = spark.createDataFrame([(n, 0, 0, 0.0, 1.0, 0) for n in "ab"], maxima.EXTREMA)
    pf = moments.partition_function(ext, 1, [1.0])
    assert moments.ensemble(pf).first()["signal_number"] == 2
    odd = pf.where("series = 'a'").unionByName(pf.where("series = 'b'").withColumn("q", F.lit(3.0)))
    with pytest.raises(Exception, match="different"):
        moments.ensemble(odd).collect()


def test_staircase_has_the_known_spectrum(spark):
    """Small q only: at larger ones the cells' finite size biases the fit at this length."""
    size, r, p = 2**13, [0.5, 0.5], [0.3, 0.7]
    stairs = signals.staircase(signals.cascade_measure(spark, size, r, p, flip=-1))
    ext = maxima.maxima(transform.cwt(stairs, 1.0, 6, 4, "g2"), 1e-9)
    pf = moments.partition_function(ridges.sup_along(ridges.prune(ridges.link(ext)), 1.0, 4), 24, [0.5, 1.0])
    got = {x.q: x.tau_q for x in spectra.spectrum(pf, 1.0, 4, 1.0, 4.0).collect()}
    want = spectra.tau_equal_lengths(np.array(list(got)), 0.5, p)
    assert np.allclose(list(got.values()), want, atol=0.08)
    theory = spectra.theoretical_spectrum(spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "q double"), [0.4, 0.6], p).toPandas().sort_values("q")
    assert abs(theory.tau_q.iloc[0] - -1) < 1e-6 and abs(theory.tau_q.iloc[1]) < 1e-9


def test_cascade_masses(spark):
    got = [x.x for x in signals.cascade_measure(spark, 8, [0.5, 0.5], [0.3, 0.7], flip=-1).orderBy("pos").collect()]
    want = [math.prod(0.7 if i >> k & 1 else 0.3 for k in range(3)) for i in range(8)]
    assert np.allclose(got, want)
    assert abs(signals.cascade_measure(spark, 100, [1 / 3, 1 / 3, 1 / 3], [0.5, 0.0, 0.5]).agg(F.sum("x")).first()[0] - 1) < 1e-12


def test_rescaled_ranges_over_pieces(spark):
    x = np.random.default_rng(3).normal(size=5000).cumsum()
    x[100:140] = 0.1
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, None if i % 7 == 3 else float("nan") if i == 50 else float(i % 11)) for i in range(400)] + [("c", 0, 1.0)]
    signals = spark.createDataFrame(rows, "series string, pos long, x double")

    def ranges(chunk):
        return {(r.series, r.bs, r.block): r.rs for r in hurst.rescaled_ranges(signals, chunk=chunk).collect()}

    expected = {}
    for name in "ab":
        own = [v for s, _, v in rows if s == name]
        for bs in hurst.ladder(len(own)):
            for b in range(len(own) // bs):
                v = np.array([k for k in own[b * bs : (b + 1) * bs] if k is not None])
                y = np.cumsum(v - v.mean())
                expected[name, bs, b] = None if v.min() == v.max() else (y.max() - y.min()) / v.std(ddof=1)
    for chunk in (64, 700, 1 << 16):
        got = ranges(chunk)
        assert got.keys() == expected.keys()
        for k, v in expected.items():
            assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-9, nan_ok=True)), (chunk, k)


def test_hurst(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(2048)
    row = hurst.hurst_rs(series(spark, x)).first()
    assert 0.4 < row.hurst < 0.75 and row.se < 0.1
    assert hurst.hurst_rs(series(spark, [1.0] * 100)).first().hurst is None
    assert hurst.rescaled_ranges(series(spark, [0.1] * 100), chunk=30).where("rs is not null").count() == 0
    assert hurst.ladder(16384) == [8, 12, 18, 27, 40, 60, 90, 135, 202, 303, 454, 681, 1021, 1531, 2296, 3444]


def test_text_reader(spark, tmp_path):
    (tmp_path / "creep.txt").write_text(" 2000 1 0.5 A\n2001  366.5\t-1e3 B \n2100 1 oops C\n\n")
    rows = signals.read_text(spark, str(tmp_path / "creep.txt")).withColumn("t", signals.time_axis()).collect()
    assert [(r.year, r.displacement, r.quality) for r in rows] == [("2000", 0.5, "A"), ("2001", -1000.0, "B"), ("2100", None, "C")]
    assert rows[0].t == 2000.0 and rows[2].t == 2100.0
    with pytest.raises(Exception):
        signals.read_text(spark, str(tmp_path / "creep.txt"), strict=True).collect()
    days = spark.createDataFrame([("2004", 5.0), ("2004", 50.0), ("2004", 100.5), ("2004", 100.0)], "year string, julian_day double")
    assert signals.date_range(days, "2004.5", "2004.100").count() == 3
    assert signals.date_range(days, "2004.50", "2004.100").count() == 2


def test_colours_and_pixels(spark):
    c = pixels.colors(spark, "color", 5).orderBy("level").collect()
    assert (c[-1].r, c[-1].g, c[-1].b) == (1.0, 0.0, 0.0) and c[0].r == 0.0
    rows = [("s", 0, 1.0, i, w, 1, 3) for i, w in enumerate([9.0, -2.0, 1.0, 0.5, 0.0])]
    v = pixels.pixels(spark.createDataFrame(rows, transform.COEFFICIENTS)).orderBy("pos").collect()
    assert [x.v for x in v] == [1.0, 1.0, 0.5, 0.25, 0.0] and [x.masked for x in v] == [True, False, False, False, True]
    assert pixels.painted(pixels.pixels(spark.createDataFrame(rows, transform.COEFFICIENTS))).count() == 5


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2024-01-01 0{h}:30:00", 1.5) for h in (0, 0, 1, 5)], "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_signal(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, windowed_signal(rows).collect()))
