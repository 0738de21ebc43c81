"""Queries over the test tables, one per operator, each with DuckDB SQL that states it independently.

Coefficients are rounded to 9 decimals before any discrete decision, and results
to fewer, since the engines add in different orders."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wavelets as W
from ..operators import hurst, maxima, moments, pixels, ridges, spectra, transform
from ..sources import signals
from ..streaming.windows import windowed_signal

A_MIN, N_OCT, N_VOICE = 1.0, 2, 4
N_SCALES = N_OCT * N_VOICE
Q_LIST = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0]
LO, HI = 0.25, 1.75
CASCADE = (1024, [0.5, 0.5], [0.3, 0.7])
THIRDS = (729, [1 / 3, 1 / 3, 1 / 3], [0.5, 0.0, 0.5])

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# --- SQL building blocks ---------------------------------------------------------------

EVENTS_SEQ = "sig AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, value AS x FROM events)"
EVENTS_USER = "sig AS (SELECT user_id::VARCHAR AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS x FROM events)"
EMBEDDINGS = "sig AS (SELECT vec_id::VARCHAR AS series, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"
LENGTHS = "len AS (SELECT series, count(*) AS n FROM sig GROUP BY series)"


def sql_scales(n_oct: int = N_OCT, n_voice: int = N_VOICE) -> str:
    return f"sc AS (SELECT i::INTEGER AS si, {A_MIN}::DOUBLE * pow(pow(2.0::DOUBLE, {1 / n_voice!r}::DOUBLE), i) AS a FROM range({n_oct * n_voice}) t(i))"


def sql_cwt(name: str = "g2", preset: str = "direct", n_oct: int = N_OCT, n_voice: int = N_VOICE, form: str | None = None) -> list[str]:
    """The transform on lists; `form` states the wavelet in terms of {u} apart from the registry's expression."""
    w = W.wavelet(name)
    order, right = ("DESC", "xs[n - s:n - 1]") if preset == "direct" else ("ASC", "xs[n - s + 1:n]")
    psi = (form or w.sql).replace("{u}", f"(m / (a * {w.stretch!r}::DOUBLE))")
    return [
        LENGTHS,
        sql_scales(n_oct, n_voice),
        f"hw AS (SELECT *, floor(a * ({w.half!r}::DOUBLE * {w.stretch!r}::DOUBLE))::BIGINT AS s FROM sc)",
        "tm AS (SELECT *, unnest(range(-s, s + 1)) AS m FROM hw)",
        f"tp AS (SELECT *, ({psi})::DOUBLE AS psi FROM tm)",
        f"tl AS (SELECT si, a, s, list(psi ORDER BY m {order}) AS taps FROM tp GROUP BY ALL)",
        "pk AS (SELECT series, list(x ORDER BY pos) AS xs, count(*) AS n FROM sig GROUP BY series)",
        f"wd AS (SELECT series, n, si, a, s, taps, list_concat(list_reverse(xs[2:s + 1]), xs, list_reverse({right})) AS wide FROM pk, tl)",
        "wl AS (SELECT series, n, si, a, s, CASE WHEN 2 * s + 1 <= n THEN list_transform(range(n), lambda p: list_dot_product(wide[p + 1:p + 2 * s + 1], taps)) ELSE list_transform(range(n), lambda p: NULL::DOUBLE) END AS ws FROM wd)",
        "cw AS MATERIALIZED (SELECT series, n, si, a, s AS firstp, n - 1 - s AS lastp, pos, round(v / a, 9) + 0.0 AS w FROM (SELECT series, n, si, a, s, unnest(range(n)) AS pos, unnest(ws) AS v FROM wl))",
    ]


SQL_MAXIMA = [
    "m1 AS (SELECT series, si, pos, n, w, CASE WHEN pos <= 1 OR w <> lag(w) OVER (PARTITION BY series, si ORDER BY pos) THEN 1 ELSE 0 END AS nw FROM cw)",
    "m2 AS (SELECT *, sum(nw) OVER (PARTITION BY series, si ORDER BY pos) AS run FROM m1)",
    "m3 AS (SELECT series, si, run, min(pos) AS i, max(pos) AS e, any_value(w) AS v, any_value(n) AS n FROM m2 WHERE pos >= 1 GROUP BY series, si, run)",
    "m4 AS (SELECT m3.*, b.w AS p, c.w AS q FROM m3 JOIN cw b ON b.series = m3.series AND b.si = m3.si AND b.pos = m3.i - 1 "
    "JOIN cw c ON c.series = m3.series AND c.si = m3.si AND c.pos = m3.e + 1 WHERE m3.i < m3.n - 3)",
    "ext AS (SELECT series, si, row_number() OVER (PARTITION BY series, si ORDER BY i) - 1 AS ext, round(i - ((q - p) / 2) / (2 * ((q + p) / 2 - v)), 9) AS abscissa, "
    "round(v - pow((q - p) / 2, 2) / (4 * ((q + p) / 2 - v)), 9) AS ordinate, (i + e) // 2 AS idx FROM m4 WHERE (v > 0 AND v > p AND v > q) OR (v < 0 AND v < p AND v < q))",
]
SQL_LINKS = [
    "nn AS (SELECT f.series, c.si AS s, f.ext AS f, arg_min(c.ext, row(abs(c.abscissa - f.abscissa), -c.ext)) AS c, min(abs(c.abscissa - f.abscissa)) AS d "
    "FROM ext f JOIN ext c ON f.series = c.series AND c.si = f.si + 1 GROUP BY f.series, c.si, f.ext)",
    "lk AS (SELECT series, s, f, c FROM (SELECT *, row_number() OVER (PARTITION BY series, c ORDER BY d, f) AS rn FROM nn WHERE s = 1) WHERE rn = 1 "
    "UNION ALL SELECT series, s, f, c FROM (SELECT nn.*, row_number() OVER (PARTITION BY nn.series, nn.c ORDER BY nn.d, nn.f) AS rn "
    "FROM lk JOIN nn ON nn.series = lk.series AND nn.s = lk.s + 1 AND nn.f = lk.c) WHERE rn = 1)",
    "ch AS (SELECT series, ext AS chain, si AS s, ext AS e FROM ext WHERE si = 0 UNION ALL SELECT ch.series, ch.chain, lk.s, lk.c FROM ch JOIN lk ON lk.series = ch.series AND lk.s = ch.s + 1 AND lk.f = ch.e)",
    "cn AS (SELECT ext.*, ch.chain, lag(ordinate) OVER (PARTITION BY ch.series, ch.chain ORDER BY ext.si) AS finer_ord FROM ch JOIN ext ON ext.series = ch.series AND ext.si = ch.s AND ext.ext = ch.e)",
    "cu AS (SELECT *, min(CASE WHEN ordinate * finer_ord < 0 THEN si END) OVER (PARTITION BY series, chain) AS cut FROM cn)",
    "pr AS (SELECT series, si, row_number() OVER (PARTITION BY series, si ORDER BY ext) - 1 AS ext, abscissa, ordinate, idx, chain FROM cu WHERE cut IS NULL OR si < cut)",
    f"su AS (SELECT series, si, ext, abscissa, idx, chain, arg_max(ordinate, row(abs(ordinate) * {A_MIN}::DOUBLE * pow(2.0::DOUBLE, si / {N_VOICE}::DOUBLE), si)) "
    "OVER (PARTITION BY series, chain ORDER BY si ROWS UNBOUNDED PRECEDING) AS ordinate FROM pr)",
]


def sql_moments(source: str) -> list[str]:
    return [
        f"mo AS (SELECT series, si, ordinate FROM {source})",
        f"qs AS (SELECT unnest({Q_LIST!r}::DOUBLE[]) AS q)",
        f"grid AS (SELECT series, i::INTEGER AS si FROM (SELECT DISTINCT series FROM sig), range({N_SCALES}) t(i))",
        "ne AS (SELECT grid.series, grid.si, count(ordinate) AS n_ext FROM grid LEFT JOIN mo ON mo.series = grid.series AND mo.si = grid.si GROUP BY ALL)",
        f"im AS (SELECT series, (coalesce(min(CASE WHEN n_ext = 0 THEN si END), {N_SCALES}) - 1)::INTEGER AS index_max FROM ne GROUP BY series)",
        "sm AS (SELECT series, q, si, count(*) AS m0, sum(pow(abs(ordinate), q)) AS m1, sum(pow(abs(ordinate), q) * ln(abs(ordinate))) AS m2 FROM mo, qs WHERE ordinate <> 0 GROUP BY ALL)",
        "pf AS (SELECT ne.series, qs.q, ne.si, index_max, CASE WHEN ne.si <= index_max THEN n_ext ELSE 0 END AS n_ext, "
        "CASE WHEN ne.si <= index_max THEN coalesce(m1, 0) ELSE 0 END AS stq, CASE WHEN ne.si <= index_max AND m1 > 0 THEN ln(m1 / m0) ELSE 0 END AS log_stq, "
        "CASE WHEN ne.si <= index_max AND m1 > 0 THEN m2 / m1 ELSE 0 END AS ratio, 1 AS k FROM ne JOIN im USING (series) CROSS JOIN qs "
        "LEFT JOIN sm ON sm.series = ne.series AND sm.q = qs.q AND sm.si = ne.si)",
    ]


SQL_ENSEMBLE = "pe AS (SELECT 'ensemble' AS series, q, si, min(index_max) AS index_max, sum(n_ext)::BIGINT AS n_ext, sum(stq) AS stq, sum(log_stq) AS log_stq, sum(ratio) AS ratio, count(*) AS k FROM pf GROUP BY q, si)"


def sql_fits(source: str = "pf", extensive: bool = True) -> list[str]:
    t = "CASE WHEN stq > 0 THEN log2(stq) END" if extensive else "log_stq / ln(2.0::DOUBLE) / k"
    h = "ratio / ln(2.0::DOUBLE)" if extensive else "ratio / ln(2.0::DOUBLE) / k"
    lo, hi = spectra.scale_index(LO, A_MIN, N_VOICE), spectra.scale_index(HI, A_MIN, N_VOICE)
    return [
        f"fx AS (SELECT series, q, {math.log2(A_MIN)!r}::DOUBLE + si / {N_VOICE}::DOUBLE AS x, {t} AS t, {h} AS h FROM {source} WHERE si BETWEEN {lo} AND least({hi}, index_max))",
        "ft AS (SELECT series, q, regr_slope(t, x) AS t, regr_slope(h, x) AS h, regr_slope(q * h - t, x) AS d FROM fx GROUP BY series, q)",
        "f1 AS (SELECT *, max(CASE WHEN q = 1 THEN t END) OVER (PARTITION BY series) AS t1 FROM ft)",
    ]


SELECT_SPECTRUM = "SELECT series, q, round({tau}, 5) AS tau_q, round({h}, 5) AS h_q, round({d}, 5) AS d_q, round({t1}, 5) AS tau_1, '{method}' AS method FROM {source}"


# --- signals and helpers ------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.in_order(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")


def events_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.in_order(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def steady(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def coefficients(spark, sf_dir, name="g2", preset="direct", plan="chunks") -> DataFrame:
    return steady(transform.cwt(events_seq(spark, sf_dir), A_MIN, N_OCT, N_VOICE, name, preset=preset, plan=plan), "w")


def extrema(spark, sf_dir) -> DataFrame:
    return steady(maxima.maxima(coefficients(spark, sf_dir), 0), "abscissa", "ordinate")


def linked(spark, sf_dir) -> DataFrame:
    return ridges.link(extrema(spark, sf_dir))


def supped(spark, sf_dir) -> DataFrame:
    return ridges.sup_along(ridges.prune(linked(spark, sf_dir)), A_MIN, N_VOICE)


def raw_moments(spark, sf_dir) -> DataFrame:
    return moments.partition_function(extrema(spark, sf_dir), N_SCALES, Q_LIST, series=events_seq(spark, sf_dir))


def chain_moments(spark, sf_dir) -> DataFrame:
    return moments.partition_function(supped(spark, sf_dir), N_SCALES, Q_LIST, min_chain=2, series=events_seq(spark, sf_dir))


def grid_of_u(spark: SparkSession) -> DataFrame:
    return spark.range(-80, 81).select((F.col("id") / 10.0).alias("u"))


U_GRID = "ug AS (SELECT i / 10.0::DOUBLE AS u FROM range(-80, 81) t(i))"


# --- scale grid and wavelets -----------------------------------------------------------------


@query(with_(sql_scales(3, 5), select="SELECT si, round(a, 9) AS a, round(log2(a), 9) AS log2_a FROM sc"))
def scale_grid(spark, sf_dir):
    return steady(transform.scale_grid(spark, A_MIN, 3, 5), "a", "log2_a")


def _table(name: str, evaluated: bool = False):
    """psi on a grid: the SQL expression in Spark against the same family's closed form in the oracle."""

    def run(spark, sf_dir):
        w = W.wavelet(name)
        return grid_of_u(spark).select("u", F.round(F.expr(w.sql.replace("{u}", "u")), 9).alias("psi"))

    run.__name__ = f"wavelet_table_{name}"
    return run


_PLAIN = {  # closed forms, written apart from the registry's expressions
    "g0": "exp(-pow(u, 2) / 2)",
    "g1": "u * exp(-pow(u, 2) / 2)",
    "g2": "(pow(u, 2) - 1) * exp(-pow(u, 2) / 2)",
    "g3": "(pow(u, 3) - 3 * u) * exp(-pow(u, 2) / 2)",
    "g4": "(pow(u, 4) - 6 * pow(u, 2) + 3) * exp(-pow(u, 2) / 2)",
}


def _spline(n: int) -> str:
    """Central differences of order n of the cubic-or-lower B-spline of degree 2, term by term."""
    outer = []
    for k in range(n + 1):
        inner = " + ".join(f"({(-1) ** j * math.comb(3, j)}) * pow(greatest(u + {n / 2 - k + 1.5 - j}::DOUBLE, 0), 2)" for j in range(4))
        outer.append(f"({(-1) ** k * math.comb(n, k)}) * ({inner}) / 2")
    return " + ".join(outer)


_PLAIN |= {f"bspline{n}": _spline(n) for n in (1, 2, 3, 4)}
for _name, _form in _PLAIN.items():
    query(with_(U_GRID, select=f"SELECT u, round({_form}, 9) + 0.0 AS psi FROM ug"))(_table(_name))


@query(with_(U_GRID, "qn AS (SELECT unnest([0, 1, 2, 3, 4]) AS n)", select="""
SELECT n::INTEGER AS n, u, round(CASE n WHEN 0 THEN pow(b, -2.5) WHEN 1 THEN 2.5 * 0.4 * u * pow(b, -3.5)
  WHEN 2 THEN -2.5 * 0.4 * pow(b, -4.5) * (b - 3.5 * 0.4 * u * u)
  WHEN 3 THEN -2.5 * 3.5 * 0.16 * u * pow(b, -5.5) * (3 * b - 4.5 * 0.4 * u * u)
  ELSE 2.5 * 3.5 * 0.16 * pow(b, -6.5) * (3 * b * b - 6 * 4.5 * 0.4 * u * u * b + 4.5 * 5.5 * 0.16 * pow(u, 4)) END, 9) + 0.0 AS psi
FROM (SELECT *, 1 + 0.4::DOUBLE * u * u / 2 AS b FROM ug, qn)"""))
def qgauss_table(spark, sf_dir):
    return _union([grid_of_u(spark).select(F.lit(n).alias("n"), "u", (F.round(F.expr(W.q_gaussian_sql(1.4, n).replace("{u}", "u")), 9) + F.lit(0.0)).alias("psi")) for n in range(5)])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(with_(U_GRID, select="""
SELECT u, round(pow(0.5, 0.25) / (pow(pi(), 0.25) * sqrt(3)) * sqrt(pow(0.5, 2.5) * exp(lgamma(6) - lgamma(3.5)))
  * (1 - 1.5 * 0.5 * u * u) * pow(1 + 0.5 * 0.5 * u * u, -3.0), 9) + 0.0 AS psi FROM ug"""))
def qmhat_table(spark, sf_dir):
    return grid_of_u(spark).select("u", (F.round(F.expr(W.q_mexican_hat_sql(1.5).replace("{u}", "u")), 9) + F.lit(0.0)).alias("psi"))


_SUPPORTS = " UNION ALL ".join(f"SELECT '{n}' AS name, si, round(-a * {W.wavelet(n).half!r}::DOUBLE * {W.wavelet(n).stretch!r}::DOUBLE, 9) AS lo, round(a * {W.wavelet(n).half!r}::DOUBLE * {W.wavelet(n).stretch!r}::DOUBLE, 9) AS hi FROM sc" for n in ("g0", "g2", "bspline3", "db3"))


@query(with_(sql_scales(), select=_SUPPORTS))
def wavelet_support(spark, sf_dir):
    grid = transform.scale_grid(spark, A_MIN, N_OCT, N_VOICE)
    return _union([grid.select(F.lit(n).alias("name"), "si", F.round(W.support("a", n)["lo"], 9).alias("lo"), F.round(W.support("a", n)["hi"], 9).alias("hi")) for n in ("g0", "g2", "bspline3", "db3")])


_NORM2 = "4 * sqrt(2.0::DOUBLE)"
_LIT = lambda taps: f"{[float(x) for x in taps]!r}::DOUBLE[]"
#: Low-pass taps: closed forms of order 2 and 3 (Daubechies 1992) and the first Coiflet, else the registry's values.
_LOW = {
    "db2": f"list_transform([1 - sqrt(3.0), 3 - sqrt(3.0), 3 + sqrt(3.0), 1 + sqrt(3.0)], lambda x: x / ({_NORM2}))",
    "db3": "list_transform([1 + z - w, 5 + z - 3 * w, 10 - 2 * z - 2 * w, 10 - 2 * z + 2 * w, 5 + z + 3 * w, 1 + z + w], lambda x: x / (16 * sqrt(2.0)))",
    "db4": _LIT(W.daubechies(4)),
    "coif1": "list_transform([sqrt(7.0) - 3, 1 - sqrt(7.0), 14 - 2 * sqrt(7.0), 14 + 2 * sqrt(7.0), 5 + sqrt(7.0), 1 - sqrt(7.0)], lambda x: x / (16 * sqrt(2.0)))",
    "coif2": _LIT(W.COIF2),
    "coif3": _LIT(W.COIF3),
}


def sql_cascade(names, rounds: int) -> list[str]:
    """(name, construction, i, v): refinement as a join of samples and taps, summed by place."""
    return [
        "wz AS (SELECT sqrt(10.0::DOUBLE) AS z, sqrt(5 + 2 * sqrt(10.0::DOUBLE)) AS w)",
        "lo AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {_LOW[n]} AS taps FROM wz" for n in names) + ")",
        "cs AS (SELECT unnest(['standard', 'aliased']) AS construction)",
        "tk AS (SELECT name, k, sqrt(2.0::DOUBLE) * taps[k + 1] AS low, sqrt(2.0::DOUBLE) * taps[len(taps) - k] * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS high, len(taps) AS n FROM lo, unnest(range(len(taps))) u(k))",
        "rf AS (SELECT name, construction, 0 AS step, 0::BIGINT AS i, 1.0::DOUBLE AS v FROM lo, cs UNION ALL "
        "SELECT rf.name, construction, step + 1, 2 * i + k, sum(v * CASE WHEN (construction = 'standard' AND step = 0) "
        f"OR (construction = 'aliased' AND step = {rounds}) THEN high ELSE low END) FROM rf JOIN tk ON tk.name = rf.name WHERE step <= {rounds} GROUP BY rf.name, construction, step, 2 * i + k)",
        f"cy AS (SELECT name, construction, i, i * pow(2.0::DOUBLE, {-rounds - 1}) - (n - 1) / 2.0::DOUBLE AS t, v FROM rf JOIN (SELECT DISTINCT name, n FROM tk) USING (name) WHERE step = {rounds + 1})",
    ]


_COMPACT = {"db2": W.daubechies(2), "db3": W.daubechies(3), "db4": W.daubechies(4), "coif1": W.COIF1, "coif2": W.COIF2, "coif3": W.COIF3}


@query(with_(*sql_cascade(_COMPACT, 12), select="SELECT name, construction, t, round(v, 6) + 0.0 AS psi FROM cy"))
def compact_tables(spark, sf_dir):
    """All samples of the wavelets without a closed form, after all rounds, in both constructions."""

    def build(batches):
        for b in batches:
            for name, construction in zip(*(c.to_pylist() for c in b.columns)):
                t, y = W.cascade(_COMPACT[name], construction=construction)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(t)), pa.array([construction] * len(t)), pa.array(t), pa.array(y)], names=["name", "construction", "t", "psi"])

    specs = spark.createDataFrame([(n, c) for n in _COMPACT for c in ("standard", "aliased")], "name string, construction string").repartition("name")
    return steady(specs.mapInArrow(build, "name string, construction string, t double, psi double"), "psi", digits=6)


def _spline_through(points: int):
    """A cubic is its own not-a-knot spline."""
    x = [-1.0 + k * 0.25 for k in range(points)]
    return W.cubic_spline(x[0], 0.25, np.array([v**3 - 2 * v * v + 0.5 for v in x]))


@query("SELECT u, round(CASE WHEN u BETWEEN -1 AND 3 THEN u * u * u - 2 * u * u + 0.5 ELSE 0 END, 9) + 0.0 AS y FROM (SELECT i / 16.0::DOUBLE AS u FROM range(-40, 65) t(i))")
def spline_table(spark, sf_dir):
    """The spline evaluator between, at and outside its knots."""
    evaluate = _spline_through(17)

    def build(frames):
        for p in frames:
            yield p.assign(y=evaluate(p["u"].to_numpy()))

    return steady(spark.range(-40, 65).select((F.col("id") / 16.0).alias("u")).mapInPandas(build, "u double, y double"), "y")


def _product(n: float, k: int) -> str:
    """The binomial of a real n as a product."""
    return "(" + " * ".join(["1.0::DOUBLE", *(f"(({n!r}::DOUBLE - {i}) / {i + 1})" for i in range(k))]) + ")"


def _fractional(alpha: float, n: float) -> str:
    """The derivative of order n of the fractional B-spline, term by term as its definition has it."""
    d, terms = alpha - n, []
    for k in range(math.ceil(n) + 2):
        for j in range(math.floor(d + 1) + 2):
            x = f"({{u}} + {n / 2 - k + (d + 1) / 2 - j!r}::DOUBLE)"
            terms.append(f"{(-1) ** (k + j)} * {_product(n, k)} * {_product(d + 1, j)} * CASE WHEN {x} > 0 THEN pow({x}, {d!r}::DOUBLE) ELSE 0 END")
    return "((" + " + ".join(terms) + f") / gamma({d + 1!r}::DOUBLE))"


#: Added before rounding: polynomials on the grid end in exact halves.
_OFF_GRID = 0.0000000000123
_ALPHAS = [(2.5, 0.5), (3.0, 1.0), (3.5, 1.5), (2.75, 1.5)]


@query(with_(U_GRID, select=" UNION ALL ".join(f"SELECT {a!r}::DOUBLE AS alpha, {n!r}::DOUBLE AS n, u, round({_fractional(a, n).replace('{u}', 'u')} + {_OFF_GRID!r}::DOUBLE, 9) + 0.0 AS psi FROM ug" for a, n in _ALPHAS)))
def fractional_tables(spark, sf_dir):
    return _union([grid_of_u(spark).select(F.lit(a).alias("alpha"), F.lit(n).alias("n"), "u", (F.round(F.expr(W.fractional_sql(a, n).replace("{u}", "u")) + F.lit(_OFF_GRID), 9) + F.lit(0.0)).alias("psi")) for a, n in _ALPHAS])


@query(with_(U_GRID, select=f"SELECT u, round({_fractional(2.5, 0.0).replace('{u}', 'u')}, 8) + 0.0 AS psi FROM ug"))
def fractional_spline(spark, sf_dir):
    """The fractional B-spline itself, by the evaluator."""

    def build(frames):
        for p in frames:
            yield p.assign(psi=W.fractional_bspline(p["u"].to_numpy(), 2.5))

    return steady(grid_of_u(spark).mapInPandas(build, "u double, psi double"), "psi", digits=8)


@query(with_(U_GRID, "qn AS (SELECT unnest([0, 1, 2, 3, 4]) AS n)", select="""
SELECT n::INTEGER AS n, u, round(CASE WHEN b <= 0 THEN 0 WHEN n = 0 THEN pow(b, 2.5) WHEN n = 1 THEN u * pow(b, 1.5)
  WHEN n = 2 THEN 0.6 * u * u * pow(b, 0.5) - pow(b, 1.5)
  WHEN n = 3 THEN 0.12 * u * u * u * pow(b, -0.5) - 1.8 * u * pow(b, 0.5)
  ELSE -0.024 * pow(u, 4) * pow(b, -1.5) - 0.72 * u * u * pow(b, -0.5) + 1.8 * pow(b, 0.5) END, 7) + 0.0 AS psi
FROM (SELECT *, 1 - 0.4::DOUBLE * u * u / 2 AS b FROM ug, qn)"""))
def qgauss_compact(spark, sf_dir):
    """q below 1: compact support."""
    return _union([grid_of_u(spark).select(F.lit(n).alias("n"), "u", (F.round(F.expr(W.q_gaussian_sql(0.6, n).replace("{u}", "u")), 7) + F.lit(0.0)).alias("psi")) for n in range(5)])


@query(with_(U_GRID, select="""
SELECT 0.5::DOUBLE AS q, u, round(CASE WHEN abs(u) < 2 THEN pow(0.5, 0.25) / (pow(pi(), 0.25) * sqrt(3)) * (sqrt(4.5) * sqrt(3.5) / 2) * sqrt(sqrt(0.5) * gamma(3.5) / gamma(3.0)) * (1 - 1.25 * u * u) * (1 - 0.25 * u * u) ELSE 0 END, 9) + 0.0 AS psi FROM ug
UNION ALL SELECT 1.0::DOUBLE AS q, u, round(2 / (pow(pi(), 0.25) * sqrt(3)) * (1 - u * u) * exp(-u * u / 2), 9) + 0.0 AS psi FROM ug"""))
def qmhat_compact(spark, sf_dir):
    return _union([grid_of_u(spark).select(F.lit(q).alias("q"), "u", (F.round(F.expr(W.q_mexican_hat_sql(q).replace("{u}", "u")), 9) + F.lit(0.0)).alias("psi")) for q in (0.5, 1.0)])


@query(with_(
    "og AS (SELECT i / 10.0::DOUBLE AS omega, abs(i / 10.0::DOUBLE) AS w FROM range(-40, 41) t(i))",
    "nq AS (SELECT 2 / (pow(pi(), 0.25) * sqrt(3)) AS a1, pow(0.5, 0.25) / (pow(pi(), 0.25) * sqrt(3)) AS f)",
    # norms at q = 0.5, 1.5, 2 from gamma functions
    "ny AS (SELECT a1, f * (sqrt(4.5) * sqrt(3.5) / 2) * sqrt(sqrt(0.5) * gamma(3.5) / gamma(3.0)) AS a05, f * sqrt(pow(0.5, 2.5) * gamma(6.0) / gamma(3.5)) AS a15, f * sqrt(gamma(4.0) / gamma(1.5)) AS a2 FROM nq)",
    # J of order 3.5 by its power series
    "bj AS (SELECT omega, sum(CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END * exp((2 * m + 3.5) * ln(w) - lgamma(m + 1.0) - lgamma(m + 4.5))) AS j FROM og, range(60) t(m) WHERE w > 0 GROUP BY omega)",
    select="""SELECT q, omega, round(CASE WHEN w = 0 THEN 0 WHEN q = 1 THEN a1 * w * w * exp(-w * w / 2) WHEN q = 2 THEN a2 * sqrt(pi()) * sqrt(2) * w * exp(-w * sqrt(2))
  WHEN q = 1.5 THEN a15 / (0.25 * sqrt(2) * 0.5) * w * w * sqrt(w) * sqrt(pi() / (4 * w)) * exp(-2 * w)
  ELSE a05 * gamma(4.0) / (1.5 * sqrt(2) * 0.5) * w * w * pow(1 / w, 3.5) * j END, 8) + 0.0 AS value
FROM og JOIN (SELECT unnest([0.5, 1.0, 1.5, 2.0]::DOUBLE[]) AS q) ON true CROSS JOIN ny LEFT JOIN bj USING (omega)"""))  # fmt: skip
def qmhat_fourier(spark, sf_dir):
    def build(frames):
        for p in frames:
            for q in (0.5, 1.0, 1.5, 2.0):
                yield pd.DataFrame({"q": q, "omega": p["omega"], "value": W.q_mexican_hat_fourier(p["omega"].to_numpy(), q)})

    grid = spark.range(-40, 41).select((F.col("id") / 10.0).alias("omega"))
    return steady(grid.mapInPandas(build, "q double, omega double, value double"), "value", digits=8)


@query(with_(U_GRID, sql_scales(), select="SELECT si, u, round((pow(u / (3 * a), 2) - 1) * exp(-pow(u / (3 * a), 2) / 2), 9) + 0.0 AS psi FROM ug, sc"))
def direct_column(spark, sf_dir):
    """A wavelet as a column of positions and scales."""
    rows = transform.scale_grid(spark, A_MIN, N_OCT, N_VOICE).select("si", "a", F.explode(F.sequence(F.lit(-80), F.lit(80))).alias("i")).withColumn("u", F.col("i") / 10.0)
    return steady(rows.select("si", "u", W.direct("u", "a", "g2").alias("psi")), "psi")


# --- transform -----------------------------------------------------------------------------------

#: Added before coefficients are rounded for output: values of two decimals under dyadic taps end in exact halves.
_OFF_HALF = 0.0000123
_W4 = f"SELECT series, si, pos, round(w + {_OFF_HALF}::DOUBLE, 4) AS w FROM cw"


def _cwt(name, preset="direct", plan="chunks"):
    return lambda spark, sf_dir: coefficients(spark, sf_dir, name, preset, plan).select("series", "si", "pos", F.round(F.col("w") + F.lit(_OFF_HALF), 4).alias("w"))


for _key, _args in {
    "cwt_g2_events": ("g2",), "cwt_g2_join_plan": ("g2", "direct", "join"), "cwt_g2_arrays_plan": ("g2", "direct", "arrays"), "cwt_g1_reflect": ("g1", "direct"),
    "cwt_g1_overlap": ("g1", "overlap_save"), "cwt_bspline3_overlap": ("bspline3", "overlap_save"),
}.items():
    _f = _cwt(*_args)
    _f.__name__ = _key
    query(with_(EVENTS_SEQ, *sql_cwt(*_args[:2]), select=_W4))(_f)


def _events_cwt(key: str, register, form: str, n_oct: int = 1, n_voice: int = 4):
    """A query with a wavelet that it registers first; the oracle states the wavelet by itself."""
    name = register()

    def run(spark, sf_dir):
        rows = steady(transform.cwt(events_seq(spark, sf_dir), A_MIN, n_oct, n_voice, register()), "w")
        return rows.select("series", "si", "pos", F.round(F.col("w") + F.lit(_OFF_HALF), 4).alias("w"))

    run.__name__ = key
    query(with_(EVENTS_SEQ, *sql_cwt(name, "direct", n_oct, n_voice, form), select=_W4))(run)


_U2 = "pow({u}, 2)"
_events_cwt("cwt_q_gaussian", lambda: W.register_q_gaussian(1.4, 2), f"(-pow(1 + 0.2 * {_U2}, -4.5) * ((1 + 0.2 * {_U2}) - 1.4 * {_U2}))")
_events_cwt("cwt_q_mexican_hat", lambda: W.register_q_mexican_hat(1.5), f"(pow(0.5, 0.25) / (pow(pi(), 0.25) * sqrt(3)) * sqrt(pow(0.5, 2.5) * exp(lgamma(6) - lgamma(3.5))) * (1 - 0.75 * {_U2}) * pow(1 + 0.25 * {_U2}, -3.0))")
_events_cwt("cwt_fractional", lambda: W.register_fractional(3.0, 1.0), _fractional(3.0, 1.0))
# on a dyadic stretch the taps of scales 1 and 2 are samples of the cascade


def _dyadic() -> str:
    return W.register_compact("db3_dyadic", W.daubechies(3), 8.0, 2.5, "standard")


def _dyadic_sql() -> str:
    w = W.wavelet(_dyadic())
    ctes = sql_cwt(w.name, "direct", 2, 1, "0")
    taps = f"tp AS (SELECT tm.*, coalesce(v, 0) AS psi FROM tm LEFT JOIN cy ON construction = 'standard' AND cy.i = round((m / (a * {w.stretch!r}::DOUBLE) + 2.5) * 8192)::BIGINT)"
    return with_(EVENTS_SEQ, *sql_cascade(["db3"], 12), *[taps if c.startswith("tp AS") else c for c in ctes], select=_W4)


@query(_dyadic_sql())
def cwt_db3(spark, sf_dir):
    rows = steady(transform.cwt(events_seq(spark, sf_dir), A_MIN, 2, 1, _dyadic()), "w")
    return rows.select("series", "si", "pos", F.round(F.col("w") + F.lit(_OFF_HALF), 4).alias("w"))


@query(with_(EVENTS_USER, *sql_cwt("g2", "direct", 2, 2), select=_W4))
def cwt_short_series(spark, sf_dir):
    """Series of some 50 to 90 samples, shorter than the widest filters: null there."""
    rows = steady(transform.cwt(events_user(spark, sf_dir), A_MIN, 2, 2, "g2"), "w")
    return rows.select("series", "si", "pos", F.round(F.col("w") + F.lit(_OFF_HALF), 4).alias("w"))


@query(with_(EMBEDDINGS, *sql_cwt("g2", "direct", 1, 4), select=_W4))
def cwt_embeddings(spark, sf_dir):
    sig = signals.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = steady(transform.cwt(sig, A_MIN, 1, 4, "g2"), "w")
    return rows.select("series", "si", "pos", F.round(F.col("w") + F.lit(_OFF_HALF), 4).alias("w"))


@query(with_(EVENTS_SEQ, LENGTHS, sql_scales(), select="SELECT series, si, floor(a * 18.0::DOUBLE)::BIGINT AS firstp, n - 1 - floor(a * 18.0::DOUBLE)::BIGINT AS lastp FROM len, sc"))
def valid_ranges(spark, sf_dir):
    return transform.valid_ranges(events_seq(spark, sf_dir).groupBy("series").agg(F.count("*").alias("n")), A_MIN, N_OCT, N_VOICE)


# --- maxima and ridges ---------------------------------------------------------------------------

CHAIN = [EVENTS_SEQ, *sql_cwt(), *SQL_MAXIMA]
_R4 = "round(abscissa, 4) + 0.0 AS abscissa, round(ordinate, 4) + 0.0 AS ordinate"


def _r4(df: DataFrame, *columns: str) -> DataFrame:
    return steady(df, "abscissa", "ordinate", digits=4).select(*columns)


@query(with_(*CHAIN, select=f"SELECT series, si, ext::INTEGER AS ext, {_R4}, idx FROM ext"))
def maxima_g2(spark, sf_dir):
    return _r4(extrema(spark, sf_dir), "series", "si", "ext", "abscissa", "ordinate", "idx")


@query(with_(*CHAIN, select="SELECT series, si, count(*) AS n FROM ext GROUP BY ALL"))
def maxima_count_by_scale(spark, sf_dir):
    return extrema(spark, sf_dir).groupBy("series", "si").agg(F.count("*").alias("n"))


@query(with_(*CHAIN, select="SELECT series, si, count(*) AS n FROM ext GROUP BY ALL"))
def maxima_scan(spark, sf_dir):
    """The greedy scan with a threshold too small to join any two values."""
    return maxima.maxima(coefficients(spark, sf_dir), 1e-15).groupBy("series", "si").agg(F.count("*").alias("n"))


def sql_scan(epsilon: float) -> list[str]:
    """The greedy scan sample by sample: a plateau grows while its values span at most epsilon times the norm of the valid range."""
    return [
        f"yl AS (SELECT series, si, any_value(n) AS n, list(w ORDER BY pos) AS ys, {epsilon!r}::DOUBLE * sqrt(sum(CASE WHEN pos BETWEEN firstp AND lastp THEN w * w END)) AS room FROM cw GROUP BY series, si)",
        "sn AS (SELECT series, si, 1::BIGINT AS i, 2::BIGINT AS j, ys[2] AS low, ys[2] AS high, NULL::BIGINT AS ci, NULL::BIGINT AS ce, NULL::DOUBLE AS cl, NULL::DOUBLE AS ch FROM yl WHERE n > 4 UNION ALL "
        "SELECT series, si, CASE WHEN fits THEN i ELSE j END, j + 1, CASE WHEN fits THEN least(low, y) ELSE y END, CASE WHEN fits THEN greatest(high, y) ELSE y END, "
        "CASE WHEN NOT fits THEN i END, CASE WHEN NOT fits THEN j - 1 END, CASE WHEN NOT fits THEN low END, CASE WHEN NOT fits THEN high END FROM "
        "(SELECT sn.*, ys[j + 1] AS y, greatest(high, ys[j + 1]) - least(low, ys[j + 1]) <= room AS fits FROM sn JOIN yl USING (series, si) WHERE i < n - 3 AND j < n))",
        "pl AS (SELECT series, si, ci AS i, ce AS e, ys[ci] AS p, CASE WHEN ch >= 0 THEN ch ELSE cl END AS v, ys[ce + 2] AS q FROM sn JOIN yl USING (series, si) WHERE ci IS NOT NULL AND cl * ch > 0)",
        "ext AS (SELECT series, si, row_number() OVER (PARTITION BY series, si ORDER BY i) - 1 AS ext, round(i - ((q - p) / 2) / (2 * ((q + p) / 2 - v)), 9) AS abscissa, "
        "round(v - pow((q - p) / 2, 2) / (4 * ((q + p) / 2 - v)), 9) AS ordinate, (i + e) // 2 AS idx FROM pl WHERE (v > 0 AND v > p AND v > q) OR (v < 0 AND v < p AND v < q))",
    ]


def _scanned(key: str, epsilon: float):
    def run(spark, sf_dir):
        return _r4(steady(maxima.maxima(coefficients(spark, sf_dir), epsilon), "abscissa", "ordinate"), "series", "si", "ext", "abscissa", "ordinate", "idx")

    run.__name__ = key
    query(with_(EVENTS_SEQ, *sql_cwt(), *sql_scan(epsilon), select=f"SELECT series, si, ext::INTEGER AS ext, {_R4}, idx FROM ext"))(run)


_scanned("maxima_default", 1e-6)
_scanned("maxima_coarse", 1e-2)


@query(with_(*CHAIN, *SQL_LINKS, select="SELECT e.series, e.si, e.ext::INTEGER AS ext, u.c::INTEGER AS coarser, d.f::INTEGER AS finer FROM ext e "
             "LEFT JOIN lk u ON u.series = e.series AND u.s = e.si + 1 AND u.f = e.ext LEFT JOIN lk d ON d.series = e.series AND d.s = e.si AND d.c = e.ext"))  # fmt: skip
def ridge_links(spark, sf_dir):
    return linked(spark, sf_dir).select("series", "si", "ext", "coarser", "finer")


@query(with_(*CHAIN, *SQL_LINKS, select=f"SELECT series, si, ext::INTEGER AS ext, {_R4}, chain::INTEGER AS chain FROM pr"))
def ridge_pruned(spark, sf_dir):
    return _r4(ridges.prune(linked(spark, sf_dir)), "series", "si", "ext", "abscissa", "ordinate", "chain")


@query(with_(*CHAIN, *SQL_LINKS, select="SELECT series, count(*) FILTER (WHERE si > 0 AND chain IS NULL) + (SELECT count(DISTINCT chain) FROM cu WHERE cu.series = z.series AND cut IS NOT NULL) AS n "
             "FROM (SELECT e.series, e.si, ch.chain FROM ext e LEFT JOIN ch ON ch.series = e.series AND ch.s = e.si AND ch.e = e.ext) z GROUP BY series"))  # fmt: skip
def ridge_pruned_count(spark, sf_dir):
    return ridges.pruned_count(linked(spark, sf_dir))


@query(with_(*CHAIN, *SQL_LINKS, select=f"SELECT series, si, ext::INTEGER AS ext, {_R4} FROM su"))
def ridge_sup(spark, sf_dir):
    return _r4(supped(spark, sf_dir), "series", "si", "ext", "abscissa", "ordinate")


_TINY = [5e-12, -1e-12, 4e-12, 1e-13]


@query(f"SELECT si, arg_max(ordinate, row(abs(ordinate) * pow(2.0::DOUBLE, si), si)) OVER (ORDER BY si ROWS UNBOUNDED PRECEDING) AS ordinate FROM (SELECT (i - 1)::INTEGER AS si, ({_TINY!r}::DOUBLE[])[i] AS ordinate FROM range(1, 5) t(i))")
def ridge_sup_tiny(spark, sf_dir):
    """Ordinates far below any rounding."""
    rows = spark.createDataFrame([("s", 0, i, v) for i, v in enumerate(_TINY)], "series string, chain int, si int, ordinate double")
    return ridges.sup_along(rows, 1.0, 1).select("si", "ordinate")


@query(with_(*CHAIN, *SQL_LINKS, select=f"SELECT series, chain::INTEGER AS chain, si, {_R4}, round(si / {N_VOICE}::DOUBLE, 9) AS log2_a, sign FROM "
             "(SELECT *, count(*) OVER w AS k, CASE WHEN first(ordinate) OVER (PARTITION BY series, chain ORDER BY si) > 0 THEN 1 ELSE -1 END AS sign FROM cn WINDOW w AS (PARTITION BY series, chain)) WHERE k > 1"))  # fmt: skip
def ridge_trace(spark, sf_dir):
    rows = ridges.trace(linked(spark, sf_dir), A_MIN, N_VOICE).withColumn("log2_a", F.round("log2_a", 9))
    return _r4(rows, "series", "chain", "si", "abscissa", "log2_a", "ordinate", "sign")


@query(with_(*CHAIN, *SQL_LINKS, select="SELECT series, si, ext::INTEGER AS ext FROM (SELECT *, count(*) OVER (PARTITION BY series, chain) AS k FROM cn) WHERE k >= 4"))
def ridge_len_filter(spark, sf_dir):
    return ridges.longer_than(linked(spark, sf_dir), 4).select("series", "si", "ext")


# --- moments and spectra --------------------------------------------------------------------------

LONG_SUP = "sl AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series, chain) AS k FROM su) WHERE k >= 2)"
RAW, CHAINED = [*CHAIN, *sql_moments("ext")], [*CHAIN, *SQL_LINKS, LONG_SUP, *sql_moments("sl")]
_PF = "SELECT series, q, si, index_max, n_ext, round(CASE WHEN stq > 0 THEN ln(stq) ELSE -1 END, 5) AS ln_stq, round(log_stq, 5) + 0.0 AS log_stq, round(ratio, 5) + 0.0 AS ratio, round(log_stq * ratio, 4) + 0.0 AS cross_, {k}::BIGINT AS signal_number FROM {t}"


def _moment_rows(df: DataFrame) -> DataFrame:
    rows = df.withColumn("ln_stq", F.when(F.col("stq") > 0, F.ln("stq")).otherwise(-1.0)).withColumnRenamed("cross", "cross_")
    rows = steady(steady(rows, "ln_stq", "log_stq", "ratio", digits=5), "cross_", digits=4)
    return rows.select("series", "q", "si", "index_max", "n_ext", "ln_stq", "log_stq", "ratio", "cross_", "signal_number")


@query(with_(*RAW, select=_PF.format(k="k", t="pf")))
def moments_raw(spark, sf_dir):
    return _moment_rows(raw_moments(spark, sf_dir))


@query(with_(*CHAINED, select=_PF.format(k="k", t="pf")))
def moments_chains(spark, sf_dir):
    return _moment_rows(chain_moments(spark, sf_dir))


@query(with_(EVENTS_SEQ, select=f"SELECT series, q, si::INTEGER AS si, (-1)::INTEGER AS index_max, 0::BIGINT AS n_ext, -1.0::DOUBLE AS ln_stq, 0.0::DOUBLE AS log_stq, 0.0::DOUBLE AS ratio, 0.0::DOUBLE AS cross_, 1::BIGINT AS signal_number "
             f"FROM (SELECT DISTINCT series FROM sig), unnest({Q_LIST!r}::DOUBLE[]) t(q), range({N_SCALES}) u(si)"))  # fmt: skip
def moments_no_chain(spark, sf_dir):
    """No chain is long enough: every series stays, with zeros."""
    return _moment_rows(moments.partition_function(supped(spark, sf_dir), N_SCALES, Q_LIST, min_chain=N_SCALES + 1))


@query(with_(*RAW, SQL_ENSEMBLE, select="SELECT series, q, si, round(log_stq / ln(2.0::DOUBLE) / k, 5) + 0.0 AS t, round(ratio / ln(2.0::DOUBLE) / k, 5) + 0.0 AS h, round((q * ratio - log_stq) / ln(2.0::DOUBLE) / k, 5) + 0.0 AS d FROM pe"))
def moments_thd_intensive(spark, sf_dir):
    rows = moments.ensemble(raw_moments(spark, sf_dir))
    mode = "intensive"
    return steady(rows.select("series", "q", "si", moments.value_t(mode).alias("t"), moments.value_h(mode).alias("h"), moments.value_d(mode).alias("d")), "t", "h", "d", digits=5)


@query(with_(*RAW, SQL_ENSEMBLE, select="SELECT series, q, si, index_max, n_ext, k::BIGINT AS signal_number, round(log_stq, 4) + 0.0 AS log_stq, round(ratio, 4) + 0.0 AS ratio FROM pe"))
def moments_ensemble(spark, sf_dir):
    rows = moments.ensemble(raw_moments(spark, sf_dir))
    return steady(rows, "log_stq", "ratio", digits=4).select("series", "q", "si", "index_max", "n_ext", "signal_number", "log_stq", "ratio")


@query(with_(*RAW, select="SELECT series, q, si, round(CASE WHEN stq > 0 THEN log2(stq) END, 5) AS t, round(ratio / ln(2.0::DOUBLE), 5) + 0.0 AS h, round(q * ratio / ln(2.0::DOUBLE) - CASE WHEN stq > 0 THEN log2(stq) END, 5) + 0.0 AS d FROM pf"))
def moments_thd(spark, sf_dir):
    rows = raw_moments(spark, sf_dir)
    return steady(rows.select("series", "q", "si", moments.value_t().alias("t"), moments.value_h().alias("h"), moments.value_d().alias("d")), "t", "h", "d", digits=5)


def _spectrum(df: DataFrame, **how) -> DataFrame:
    return steady(spectra.spectrum(df, A_MIN, N_VOICE, LO, HI, **how), "tau_q", "h_q", "d_q", "tau_1", digits=5)


_GRAD = ("gr AS (SELECT *, lag(q) OVER w AS q0, lag({t}) OVER w AS t0, lead(q) OVER w AS q1, lead({t}) OVER w AS t9 FROM f1 WINDOW w AS (PARTITION BY series ORDER BY q))",
         "gh AS (SELECT series, q, {t} AS tau, t1, CASE WHEN q0 IS NULL THEN (t9 - {t}) / (q1 - q) WHEN q1 IS NULL THEN ({t} - t0) / (q - q0) ELSE "
         "(pow(q - q0, 2) * t9 + (pow(q1 - q, 2) - pow(q - q0, 2)) * {t} - pow(q1 - q, 2) * t0) / ((q - q0) * (q1 - q) * (q1 - q0)) END AS h FROM gr)")  # fmt: skip
_CANON = SELECT_SPECTRUM.format(tau="q * h - d", h="h", d="d", t1="max(CASE WHEN q = 1 THEN q * h - d END) OVER (PARTITION BY series)", method="canonical", source="f1")


@query(with_(*CHAINED, *sql_fits(), select=_CANON))
def spectrum_canonical(spark, sf_dir):
    """The flagship: signal, transform, maxima, ridges, moments and spectrum."""
    return _spectrum(chain_moments(spark, sf_dir))


@query(with_(*RAW, *sql_fits(), *(g.format(t="t") for g in _GRAD), select=SELECT_SPECTRUM.format(tau="tau", h="h", d="q * h - tau", t1="t1", method="legendre", source="gh")))
def spectrum_legendre(spark, sf_dir):
    return _spectrum(raw_moments(spark, sf_dir), method="legendre")


@query(with_(*RAW, *sql_fits(), select=SELECT_SPECTRUM.format(tau="q * h - d - t1", h="h", d="d + t1", t1="t1", method="canonical", source="f1")))
def spectrum_normalized(spark, sf_dir):
    return _spectrum(raw_moments(spark, sf_dir), normalize=True)


@query(with_(*RAW, *sql_fits("(SELECT * FROM pf WHERE q <> 1)"), "tc AS (SELECT *, q * h - d AS tau FROM f1)",
             "ti AS (SELECT series, max(CASE WHEN q = 0.5 THEN tau END) AS a, max(CASE WHEN q = 1.5 THEN tau END) AS b FROM tc GROUP BY series)",
             select="SELECT tc.series, q, round(tau, 5) AS tau_q, round(h, 5) AS h_q, round(d, 5) AS d_q, round(a + (b - a) * 0.5, 5) AS tau_1, 'canonical' AS method FROM tc JOIN ti USING (series)"))
def spectrum_without_one(spark, sf_dir):
    """tau(1) between its neighbours where the list of q has no 1."""
    without = [q for q in Q_LIST if q != 1]
    return _spectrum(moments.partition_function(extrema(spark, sf_dir), N_SCALES, without, series=events_seq(spark, sf_dir)))


@query(with_(*RAW, SQL_ENSEMBLE, *sql_fits("pe", False), select=_CANON))
def spectrum_intensive(spark, sf_dir):
    return _spectrum(moments.ensemble(raw_moments(spark, sf_dir)), mode="intensive")


# --- rescaled range --------------------------------------------------------------------------------

_LADDER = "ld AS (SELECT 8::BIGINT AS bs, 1 AS step UNION ALL SELECT floor(1.5 * bs)::BIGINT, step + 1 FROM ld WHERE step < 40 AND bs < 100000000)"
_RS = [
    LENGTHS, _LADDER,
    "rb AS (SELECT sig.series, bs, pos // bs AS block, pos, x FROM sig JOIN len USING (series) JOIN ld ON bs * 4 <= n WHERE pos // bs < n // bs)",
    "rd AS (SELECT *, x - avg(x) OVER (PARTITION BY series, bs, block) AS d FROM rb)",
    "ry AS (SELECT *, sum(d) OVER (PARTITION BY series, bs, block ORDER BY pos) AS y FROM rd)",
    "rs AS (SELECT series, bs, block, (max(y) - min(y)) / nullif(stddev_samp(x), 0) AS rs FROM ry GROUP BY ALL)",
    "rl AS (SELECT series, bs, log2(bs) AS x, log2(avg(rs)) AS y FROM rs WHERE rs > 0 GROUP BY series, bs)",
]


@query(with_(EVENTS_SEQ, *_RS, select="SELECT series, bs, round(x, 6) AS log_n, round(y, 6) AS log_rs FROM rl"))
def rs_blocks(spark, sf_dir):
    return steady(hurst.ranges_by_size(events_seq(spark, sf_dir)), "log_n", "log_rs", digits=6)


_FIT = "SELECT len.series, round(CASE WHEN count(y) >= 3 THEN regr_slope(y, x) END, 6) AS hurst, round(CASE WHEN count(y) >= 3 THEN sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(y) - 2) / regr_sxx(y, x)) END, 6) AS se FROM len LEFT JOIN rl USING (series) GROUP BY len.series"


@query(with_(EVENTS_SEQ, *_RS, select=_FIT))
def hurst_events(spark, sf_dir):
    return steady(hurst.hurst_rs(events_seq(spark, sf_dir)), "hurst", "se", digits=6)


@query(with_(EVENTS_USER, *_RS, select=_FIT))
def hurst_users(spark, sf_dir):
    return steady(hurst.hurst_rs(events_user(spark, sf_dir)), "hurst", "se", digits=6)


# --- generators and theory -----------------------------------------------------------------------------

_CASCADE = [
    f"ca AS (SELECT 0.0::DOUBLE AS l, 1.0::DOUBLE AS r, 1.0::DOUBLE AS m UNION ALL SELECT * FROM ("
    "SELECT l + (r - l) * 0.5::DOUBLE AS l, CASE WHEN i = 0 THEN l ELSE l + (r - l) * 0.5::DOUBLE + (r - l) * 0.5::DOUBLE END AS r, "
    f"m * CASE WHEN i = 0 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS m FROM ca, range(2) t(i) WHERE abs(r - l) > {1 / CASCADE[0]!r}::DOUBLE))",
    f"ce AS (SELECT least(floor(l / {1 / CASCADE[0]!r}::DOUBLE)::BIGINT, {CASCADE[0] - 1}) AS pos, sum(m) AS x FROM ca WHERE abs(r - l) <= {1 / CASCADE[0]!r}::DOUBLE GROUP BY 1)",
    f"cg AS (SELECT i AS pos, coalesce(x, 0) AS x FROM range({CASCADE[0]}) t(i) LEFT JOIN ce ON ce.pos = i)",
]


@query(with_(*_CASCADE, select="SELECT 'cascade' AS series, pos, round(x, 12) AS x FROM cg"))
def cascade_measure(spark, sf_dir):
    return steady(signals.cascade_measure(spark, *CASCADE), "x", digits=12)


@query(with_(*_CASCADE, select="SELECT 'cascade' AS series, pos, round(sum(x) OVER (ORDER BY pos), 9) AS x FROM cg"))
def staircase(spark, sf_dir):
    return steady(signals.staircase(signals.cascade_measure(spark, *CASCADE)), "x")


@query("SELECT q, tau, round(pow(0.3::DOUBLE, q) * pow(0.4::DOUBLE, -tau) + pow(0.7::DOUBLE, q) * pow(0.6::DOUBLE, -tau) - 1, 9) + 0.0 AS residual FROM (SELECT a / 2.0::DOUBLE AS q, b / 4.0::DOUBLE AS tau FROM range(-4, 9) t(a), range(-8, 9) u(b))")
def tau_residual(spark, sf_dir):
    grid = spark.range(-4, 9).select((F.col("id") / 2.0).alias("q"), F.explode(F.array(*[F.lit(b / 4.0) for b in range(-8, 9)])).alias("tau"))
    return grid.withColumn("residual", F.round(signals.tau_equation(F.col("tau"), F.col("q"), [0.4, 0.6], [0.3, 0.7]), 9) + F.lit(0.0))


_THEORY = [
    "hq AS (SELECT *, lag(tau) OVER w AS t0, lead(tau) OVER w AS t1 FROM tq WINDOW w AS (ORDER BY q))",
    "hd AS (SELECT q, tau, CASE WHEN t0 IS NULL THEN (t1 - tau) / 0.5 WHEN t1 IS NULL THEN (tau - t0) / 0.5 ELSE t1 - t0 END AS h FROM hq)",
]
_THEORY_ROWS = "SELECT q, round(tau, 8) + 0.0 AS tau_q, round(h, 8) + 0.0 AS h_q, round(q * h - tau, 8) + 0.0 AS d_q FROM hd"


def _theory(spark, r, p, expo=-1.0) -> DataFrame:
    qs = spark.range(-4, 9).select((F.col("id") / 2.0).alias("q"))
    return steady(spectra.theoretical_spectrum(qs, r, p, expo), "tau_q", "h_q", "d_q", digits=8)


@query(with_("tq AS (SELECT a / 2.0::DOUBLE AS q, ln(pow(0.3::DOUBLE, a / 2.0::DOUBLE) + pow(0.7::DOUBLE, a / 2.0::DOUBLE)) / ln(0.5::DOUBLE) AS tau FROM range(-4, 9) t(a))", *_THEORY, select=_THEORY_ROWS))
def theory_equal_r(spark, sf_dir):
    return _theory(spark, *CASCADE[1:])


@query(with_(
    "bs AS (SELECT a / 2.0::DOUBLE AS q, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, 0 AS step FROM range(-4, 9) t(a) UNION ALL "
    "SELECT q, CASE WHEN up THEN lo ELSE (lo + hi) / 2 END, CASE WHEN up THEN (lo + hi) / 2 ELSE hi END, step + 1 FROM (SELECT *, pow(0.3::DOUBLE, q) * pow(0.4::DOUBLE, -(lo + hi) / 2) + pow(0.7::DOUBLE, q) * pow(0.6::DOUBLE, -(lo + hi) / 2) > 1 AS up FROM bs WHERE step < 60))",
    "tq AS (SELECT q, (lo + hi) / 2 + 1.5 * q AS tau FROM bs WHERE step = 60)", *_THEORY, select=_THEORY_ROWS))
def theory_unequal_r(spark, sf_dir):
    """Parts of different lengths, at another exponent."""
    return _theory(spark, [0.4, 0.6], [0.3, 0.7], 0.5)


# --- pixels and colours -----------------------------------------------------------------------------------

_IN = "pos BETWEEN firstp AND lastp"
_PX = "SELECT series, si, pos, round(v, 4) + 0.0 AS v, NOT (" + _IN + ") AS masked FROM (SELECT *, greatest(0, least(1, {v})) AS v FROM cw)"


def _pixels(norm):
    def run(spark, sf_dir):
        return steady(pixels.pixels(coefficients(spark, sf_dir), norm), "v", digits=4).select("series", "si", "pos", "v", "masked")

    return run


for _key, _norm, _v in (
    ("pixels_lglobal", "lglobal", f"abs(w) / coalesce(nullif(max(CASE WHEN {_IN} THEN abs(w) END) OVER (PARTITION BY series, si), 0), 1)"),
    ("pixels_global", "global", "abs(w) / coalesce(nullif(max(abs(w)) OVER (PARTITION BY series), 0), 1)"),
    ("pixels_signed", "signedglobal", "coalesce((w + max(abs(w)) OVER (PARTITION BY series)) / nullif(2 * max(abs(w)) OVER (PARTITION BY series), 0), w)"),
):
    _f = _pixels(_norm)
    _f.__name__ = _key
    query(with_(EVENTS_SEQ, *sql_cwt(), select=_PX.format(v=_v)))(_f)


_HUE_TABLE = """(SELECT level, v - v * greatest(0, least(1, least((5 + h6) % 6, 4 - (5 + h6) % 6))) AS r, v - v * greatest(0, least(1, least((3 + h6) % 6, 4 - (3 + h6) % 6))) AS g,
  v - v * greatest(0, least(1, least((1 + h6) % 6, 4 - (1 + h6) % 6))) AS b FROM (SELECT i::INTEGER AS level, (1 - i / 255.0::DOUBLE) * 4.5 AS h6, pow(i / 255.0::DOUBLE, 0.3) AS v FROM range(256) t(i)))"""


@query(with_(EVENTS_SEQ, *sql_cwt(), "pv AS (SELECT *, greatest(0, least(1, (w + 40) / 100)) AS v FROM cw)", "pw AS (SELECT *, least(255, floor(round(v * 256, 9)))::INTEGER AS level FROM pv)",
             select=f"SELECT series, si, pos, pw.level, NOT ({_IN}) AS masked, round(r, 6) + 0.0 AS r, round(g, 6) + 0.0 AS g, round(b, 6) + 0.0 AS b FROM pw JOIN {_HUE_TABLE} h ON h.level = pw.level"))
def pixels_painted(spark, sf_dir):
    """Levels and colours between given limits."""
    rows = pixels.painted(pixels.pixels(coefficients(spark, sf_dir), signed=True, vlim=(-40.0, 60.0)))
    return steady(rows, "r", "g", "b", digits=6).select("series", "si", "pos", "level", "masked", "r", "g", "b")


@query("SELECT k AS kind, i AS pos, CASE WHEN k = 'zeros' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0, i - 3)) END AS v FROM (SELECT unnest(['zeros', 'equal']) AS k), range(8) t(i)")
def pixels_flat(spark, sf_dir):
    """A series of zeros, and two equal limits: the upper one moves up by 1."""
    rows = spark.range(8).select(F.lit("s").alias("series"), F.lit(0).alias("si"), F.lit(1.0).alias("a"), F.col("id").alias("pos"), F.col("id").cast("double").alias("w"), F.lit(0).cast("long").alias("firstp"), F.lit(7).cast("long").alias("lastp"))
    zeros = pixels.pixels(rows.withColumn("w", F.lit(0.0)), signed=True).select(F.lit("zeros").alias("kind"), "pos", "v")
    return zeros.unionByName(pixels.pixels(rows, signed=True, vlim=(3.0, 3.0)).select(F.lit("equal").alias("kind"), "pos", "v"))


@query(with_(EVENTS_SEQ, *sql_cwt(), select="SELECT series, min(pos) AS x_lo, max(pos) AS x_hi, round(min(log2(a)) - 0.125, 9) AS y_lo, round(max(log2(a)) + 0.125, 9) AS y_hi FROM cw GROUP BY series"))
def pixels_extent(spark, sf_dir):
    return steady(pixels.extent(coefficients(spark, sf_dir)), "y_lo", "y_hi")


def _colors(kind):
    run = lambda spark, sf_dir: steady(pixels.colors(spark, kind), "r", "g", "b")
    run.__name__ = f"colors_{kind}"
    return run


_HUE = """SELECT level, round(v - v * greatest(0, least(1, least((5 + h6) % 6, 4 - (5 + h6) % 6))), 9) + 0.0 AS r,
  round(v - v * greatest(0, least(1, least((3 + h6) % 6, 4 - (3 + h6) % 6))), 9) + 0.0 AS g, round(v - v * greatest(0, least(1, least((1 + h6) % 6, 4 - (1 + h6) % 6))), 9) + 0.0 AS b
FROM (SELECT i::INTEGER AS level, (1 - i / 255.0::DOUBLE) * 4.5 AS h6, pow(i / 255.0::DOUBLE, 0.3) AS v FROM range(256) t(i))"""
query(_HUE)(_colors("color"))
query("SELECT i::INTEGER AS level, round(i / 255.0::DOUBLE, 9) AS r, round(i / 255.0::DOUBLE, 9) AS g, round(i / 255.0::DOUBLE, 9) AS b FROM range(256) t(i)")(_colors("grey"))
query("SELECT i::INTEGER AS level, CASE WHEN i < 128 THEN 0 ELSE round(sqrt((i - 128) / 127.0::DOUBLE), 9) END AS r, 0.0::DOUBLE AS g, CASE WHEN i < 128 THEN round(sqrt(1 - i / 127.0::DOUBLE), 9) ELSE 0 END AS b FROM range(256) t(i)")(_colors("b2r"))


# --- text, time and streams -----------------------------------------------------------------------------------


def _lines(spark, sf_dir) -> DataFrame:
    """Order totals written as the lines of a text file."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.format_string("  %d\t%d  %.2f %s ", F.year("o_orderdate"), F.dayofyear("o_orderdate"), F.col("o_totalprice"), F.col("o_orderstatus")).alias("value"))


_DAY = "dy AS (SELECT year(o_orderdate)::VARCHAR AS year, dayofyear(o_orderdate)::DOUBLE AS julian_day, round(o_totalprice, 2) AS displacement, o_orderstatus AS quality FROM orders)"


@query(with_(_DAY, select="SELECT year, quality, count(*) AS n, round(sum(julian_day), 1) AS days, round(sum(displacement), 0) AS total FROM dy GROUP BY ALL"))
def text_parse(spark, sf_dir):
    rows = signals.parse_lines(_lines(spark, sf_dir))
    return rows.groupBy("year", "quality").agg(F.count("*").alias("n"), F.round(F.sum("julian_day"), 1).alias("days"), F.round(F.sum("displacement"), 0).alias("total"))


@query(with_(_DAY, select="SELECT round(year::INTEGER + (julian_day - 1) / (365 + CASE WHEN year::INTEGER % 4 = 0 THEN 1 ELSE 0 END), 9) AS t, count(*) AS n FROM dy GROUP BY 1"))
def time_axis(spark, sf_dir):
    return signals.parse_lines(_lines(spark, sf_dir)).groupBy(F.round(signals.time_axis(), 9).alias("t")).agg(F.count("*").alias("n"))


@query(with_(_DAY, select="SELECT year, julian_day, count(*) AS n FROM dy WHERE (year = '1995' AND julian_day >= 50) OR (year = '1996' AND julian_day <= 5) GROUP BY ALL"))
def date_range(spark, sf_dir):
    return signals.date_range(signals.parse_lines(_lines(spark, sf_dir)), "1995.50", "1996.5").groupBy("year", "julian_day").agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT event_type AS series, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS step, sum(value) AS s FROM events GROUP BY ALL),
b AS (SELECT min(step) AS lo, max(step) AS hi FROM h), g AS (SELECT DISTINCT series FROM h)
SELECT g.series, i - lo AS pos, round(coalesce(s, 0), 6) AS x FROM g, b, unnest(range(lo, hi + 1)) u(i) LEFT JOIN h ON h.series = g.series AND h.step = i""")
def signal_events_hourly(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600)
    return steady(signals.per_step(e, "event_type", hour, "value"), "x", digits=6)


@query("SELECT event_type AS series, date_trunc('hour', ts) AS start, round(sum(value), 6) AS x FROM events GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    """The streaming operator on a bounded input."""
    rows = windowed_signal(table(spark, sf_dir, "events"))
    return steady(rows, "x", digits=6).withColumn("start", F.col("start").cast("timestamp_ntz"))
