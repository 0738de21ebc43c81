"""The wavelet registry: each wavelet has a NumPy evaluator and, where one
exists, an expression that Spark SQL runs inside generated code.

A wavelet is read at u = x / (a * stretch) and vanishes for |u| > half. Families
follow their published sign: Gaussian ones are (-1)^n times the n-th derivative,
splines the plain derivative. register() adds an entry to the process's registry
or replaces the one of that name; entries themselves are immutable, and an unknown
name is a KeyError."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Evaluator = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Wavelet:
    name: str
    stretch: float
    half: float
    evaluate: Evaluator
    sql: str | None = None  # in terms of {u}

    def half_width(self, a: float) -> int:
        """Samples on each side of the centre at scale a."""
        return int(a * (self.half * self.stretch))

    def taps(self, a: float) -> np.ndarray:
        """psi(m / (a * stretch)) for m from -half_width to half_width."""
        s = self.half_width(a)
        return self.evaluate(np.arange(-s, s + 1) / (a * self.stretch))


_REGISTRY: dict[str, Wavelet] = {}


def register(name: str, evaluate: Evaluator, stretch: float, half: float, sql: str | None = None) -> str:
    """Add a wavelet, or replace the one of that name."""
    _REGISTRY[name] = Wavelet(name, float(stretch), float(half), evaluate, sql)
    return name


def wavelet(name: str) -> Wavelet:
    return _REGISTRY[name]


def names() -> list[str]:
    return list(_REGISTRY)


# --- Gaussian derivatives -----------------------------------------------------

_BELL = "exp(-({u})*({u})/2.0)"
_GAUSS = {  # name: polynomial in NumPy, in SQL, stretch, half
    "g0": (lambda u: np.ones_like(u), "1.0", 1.7, math.sqrt(2 * math.log(10)) * 2.44949),
    "g1": (lambda u: u, "({u})", 2.8, 6.0),
    "g2": (lambda u: u * u - 1, "(({u})*({u})-1.0)", 3.0, 6.0),
    "g3": (lambda u: -u * (3 - u * u), "(-({u})*(3.0-({u})*({u})))", 3.2, 6.3),
    "g4": (lambda u: 3 - 6 * u * u + u**4, "(3.0-6.0*({u})*({u})+({u})*({u})*({u})*({u}))", 3.2, 6.4),
}
for _name, (_poly, _text, _stretch, _half) in _GAUSS.items():
    register(_name, lambda u, p=_poly: p(u) * np.exp(-u * u / 2), _stretch, _half, f"{_text}*{_BELL}")


# --- B-splines -----------------------------------------------------------------


def bspline(u: np.ndarray, m: int) -> np.ndarray:
    """Centred B-spline of degree m, by truncated powers."""
    u = np.asarray(u, dtype=float)
    return sum((-1) ** k * math.comb(m + 1, k) * np.maximum(u + (m + 1) / 2 - k, 0.0) ** m for k in range(m + 2)) / math.factorial(m)


def bspline_derivative(u: np.ndarray, m: int, n: int) -> np.ndarray:
    """n-th derivative of the centred B-spline of degree m: central differences of a lower degree."""
    u = np.asarray(u, dtype=float)
    return sum((-1) ** k * math.comb(n, k) * bspline(u + n / 2 - k, m - n) for k in range(n + 1))


def bspline_sql(m: int, n: int) -> str:
    """The same as one SQL expression: equal shifts of truncated powers are added up first."""
    d = m - n
    shift: dict[float, int] = {}
    for k in range(n + 1):
        for j in range(d + 2):
            x = n / 2 - k + (d + 1) / 2 - j
            shift[x] = shift.get(x, 0) + (-1) ** (k + j) * math.comb(n, k) * math.comb(d + 1, j)
    terms = [f"({c / math.factorial(d)!r})*power(greatest(({{u}})+({x!r}),0.0),{d})" for x, c in sorted(shift.items(), reverse=True) if c]
    return "(" + "+".join(terms) + ")"


for _n, (_stretch, _half) in {1: (9.0, 2.0), 2: (7.2, 2.5), 3: (6.0, 3.0), 4: (5.14, 3.5)}.items():
    register(f"bspline{_n}", lambda u, n=_n: bspline_derivative(u, n + 2, n), _stretch, _half, bspline_sql(_n + 2, _n))


def _inverse_gamma(x: float) -> float:
    """1 / gamma(x), 0 at the poles."""
    return 0.0 if x <= 0 and x == int(x) else 1.0 / math.gamma(x)


def _choose(n: float, k: int) -> float:
    """Binomial coefficient of a real n."""
    return math.gamma(n + 1) * _inverse_gamma(k + 1) * _inverse_gamma(n - k + 1)


def fractional_bspline(u: np.ndarray, alpha: float) -> np.ndarray:
    """Fractional B-spline, its series cut after floor(alpha + 1) + 1."""
    u = np.asarray(u, dtype=float)
    out = np.zeros_like(u)
    for k in range(int(math.floor(alpha + 1)) + 2):
        v = u + (alpha + 1) / 2 - k
        out += (-1) ** k * _choose(alpha + 1, k) * np.where(v > 0, np.maximum(v, 1e-300) ** alpha, 0.0)
    return out * _inverse_gamma(alpha + 1)


def fractional_derivative(u: np.ndarray, alpha: float, n: float) -> np.ndarray:
    """Derivative of real order n of the fractional B-spline of degree alpha."""
    u = np.asarray(u, dtype=float)
    return sum((-1) ** k * _choose(n, k) * fractional_bspline(u + n / 2 - k, alpha - n) for k in range(int(math.ceil(n)) + 2))


def fractional_sql(alpha: float, n: float) -> str:
    """fractional_derivative as one SQL expression: equal shifts of truncated powers are added up first."""
    d = alpha - n
    shift: dict[float, float] = {}
    for k in range(int(math.ceil(n)) + 2):
        for j in range(int(math.floor(d + 1)) + 2):
            x = n / 2 - k + (d + 1) / 2 - j
            shift[x] = shift.get(x, 0.0) + (-1) ** (k + j) * _choose(n, k) * _choose(d + 1, j) * _inverse_gamma(d + 1)
    terms = [f"({c!r})*(case when ({{u}})+({x!r}) > 0 then power(({{u}})+({x!r}),{d!r}) else 0.0 end)" for x, c in sorted(shift.items(), reverse=True) if c]
    return "(" + "+".join(terms) + ")"


def register_fractional(alpha: float, n: float | None = None, name: str | None = None) -> str:
    n = alpha - 2 if n is None else n
    if alpha - n <= -0.5:
        raise ValueError("alpha - n must be above -0.5")
    half = (alpha + 1) / 2
    return register(name or f"fbspline{alpha}", lambda u: fractional_derivative(u, alpha, n), 18.0 / half, half, fractional_sql(alpha, n))


# --- q-Gaussians ---------------------------------------------------------------------


def _near_one(q: float) -> bool:
    return abs(q - 1) < 1e-12


def q_gaussian(u: np.ndarray, q: float, n: int = 0) -> np.ndarray:
    """(-1)^n times the n-th derivative of the Tsallis q-Gaussian, n from 0 to 4."""
    u = np.asarray(u, dtype=float)
    if not 0 <= n <= 4:
        raise ValueError("n must be from 0 to 4")
    if q >= 3:
        raise ValueError("q must be below 3")
    if _near_one(q):
        return _GAUSS[f"g{n}"][0](u) * np.exp(-u * u / 2)
    s, p = q - 1.0, 1.0 / (1.0 - q)
    base = 1 + s * u * u / 2
    b, v = np.maximum(base, 1e-15), s * u * u
    if n == 0:
        out = b**p
    elif n == 1:
        out = -p * s * u * b ** (p - 1)
    elif n == 2:
        out = p * s * b ** (p - 2) * (b + (p - 1) * v)
    elif n == 3:
        out = -p * (p - 1) * s * s * u * b ** (p - 3) * (3 * b + (p - 2) * v)
    else:
        out = p * (p - 1) * s * s * b ** (p - 4) * (3 * b * b + 6 * (p - 2) * v * b + (p - 2) * (p - 3) * v * v)
    return np.where(base > 0, out, 0.0)


def q_gaussian_sql(q: float, n: int) -> str:
    if _near_one(q):
        return _REGISTRY[f"g{n}"].sql
    s, p = q - 1.0, 1.0 / (1.0 - q)
    base = f"(1.0+({s!r})*({{u}})*({{u}})/2.0)"
    b, v = f"greatest({base},1e-15)", f"(({s!r})*({{u}})*({{u}}))"
    body = {
        0: f"power({b},{p!r})",
        1: f"({-p * s!r})*({{u}})*power({b},{p - 1!r})",
        2: f"({p * s!r})*power({b},{p - 2!r})*({b}+({p - 1!r})*{v})",
        3: f"({-p * (p - 1) * s * s!r})*({{u}})*power({b},{p - 3!r})*(3.0*{b}+({p - 2!r})*{v})",
        4: f"({p * (p - 1) * s * s!r})*power({b},{p - 4!r})*(3.0*{b}*{b}+({6 * (p - 2)!r})*{v}*{b}+({(p - 2) * (p - 3)!r})*{v}*{v})",
    }[n]
    return f"(case when {base} > 0 then {body} else 0.0 end)"


def register_q_gaussian(q: float, n: int = 2, name: str | None = None) -> str:
    if q >= 3 or not 0 <= n <= 4:
        raise ValueError("q must be below 3 and n from 0 to 4")
    if _near_one(q):
        half, stretch = 6.0 + 0.1 * n, 3.0
    else:
        half = math.sqrt(2 / (1 - q)) + 0.1 if q < 1 else min(math.sqrt(2 * (1e-3 ** -(q - 1) - 1) / (q - 1)), 20.0)
        stretch = 18.0 / half
    return register(name or f"qg{n}_q{q}", lambda u: q_gaussian(u, q, n), stretch, half, q_gaussian_sql(q, n))


# --- q-Mexican hats -----------------------------------------------------------------


def q_hat_norm(q: float, beta: float = 0.5) -> float:
    """The factor that gives the q-Mexican hat norm 1; finite near q = 1 thanks to log gammas."""
    if not -1 < q < 3:
        raise ValueError("q must be between -1 and 3")
    if _near_one(q):
        return 2 / (math.pi**0.25 * math.sqrt(3))
    front = beta**0.25 / (math.pi**0.25 * math.sqrt(3))
    if q > 1:
        z = 2 * q / (q - 1)
        return front * math.exp(0.5 * (2.5 * math.log(q - 1) + math.lgamma(z) - math.lgamma(z - 2.5)))
    y = 2 * q / (1 - q)
    return front * (math.sqrt(5 - q) * math.sqrt(3 + q) / 2) * math.exp(0.5 * (0.5 * math.log(1 - q) + math.lgamma(y + 1.5) - math.lgamma(y + 1)))


def q_mexican_hat(u: np.ndarray, q: float, beta: float = 0.5) -> np.ndarray:
    u, a = np.asarray(u, dtype=float), q_hat_norm(q, beta)
    if _near_one(q):
        return a * (1 - 2 * beta * u * u) * np.exp(-beta * u * u)
    base = 1 - (1 - q) * beta * u * u
    return a * (1 - (3 - q) * beta * u * u) * np.where(base > 0, np.maximum(base, 1e-300) ** (q / (1 - q)), 0.0)


def q_mexican_hat_sql(q: float, beta: float = 0.5) -> str:
    a = q_hat_norm(q, beta)
    if _near_one(q):
        return f"({a!r})*(1.0-({2 * beta!r})*({{u}})*({{u}}))*exp(({-beta!r})*({{u}})*({{u}}))"
    base = f"(1.0-({(1 - q) * beta!r})*({{u}})*({{u}}))"
    return f"(case when {base} > 0 then ({a!r})*(1.0-({(3 - q) * beta!r})*({{u}})*({{u}}))*power({base},{q / (1 - q)!r}) else 0.0 end)"


def register_q_mexican_hat(q: float, beta: float = 0.5, name: str | None = None) -> str:
    q_hat_norm(q, beta)
    if _near_one(q):
        half, stretch = 6.0, 3.0
    else:
        half = 1 / math.sqrt((1 - q) * beta) + 0.1 if q < 1 else min(math.sqrt((1e-3 ** ((1 - q) / q) - 1) / ((q - 1) * beta)), 20.0)
        stretch = 18.0 / half
    return register(name or f"qmhat_q{q}", lambda u: q_mexican_hat(u, q, beta), stretch, half, q_mexican_hat_sql(q, beta))


def _gauss_legendre(lo: float, hi: float, pieces: int = 16, order: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of a composite Gauss-Legendre rule."""
    x, w = np.polynomial.legendre.leggauss(order)
    edges = np.linspace(lo, hi, pieces + 1)
    half = (edges[1] - edges[0]) / 2
    return ((edges[:-1] + half)[:, None] + half * x).ravel(), np.tile(half * w, pieces)


def _bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """Modified Bessel function of the second kind: the integral of exp(-x cosh t) cosh(nu t)."""
    t, weight = _gauss_legendre(0, 12)
    return (np.exp(-np.outer(x, np.cosh(t))) * np.cosh(nu * t)) @ weight


def _bessel_j(nu: float, x: np.ndarray) -> np.ndarray:
    """Bessel function of the first kind for x > 0, by Schlaefli's integrals."""
    t, weight = _gauss_legendre(0, math.pi)
    first = np.cos(nu * t - np.outer(x, np.sin(t))) @ weight / math.pi
    s, weight = _gauss_legendre(0, 20)
    second = np.exp(-np.outer(x, np.sinh(s)) - nu * s) @ weight * math.sin(nu * math.pi) / math.pi
    return first - second


def q_mexican_hat_fourier(omega: np.ndarray, q: float, beta: float = 0.5) -> np.ndarray:
    """Fourier transform of the q-Mexican hat with the factor 1 / sqrt(2 pi); 0 at 0."""
    w = np.abs(np.atleast_1d(np.asarray(omega, dtype=float)))
    a, out, some = q_hat_norm(q, beta), np.zeros_like(w), w > 0
    x = w[some]
    if _near_one(q):
        out[some] = a / (2 * beta) * x * x * np.exp(-x * x / (4 * beta)) / math.sqrt(2 * beta)
    elif abs(q - 2) < 1e-8:
        out[some] = a * math.sqrt(math.pi) / (math.sqrt(2) * beta) * x * np.exp(-x / math.sqrt(beta))
    elif q > 1:
        root = math.sqrt((q - 1) * beta)
        nu = (2 - q) / (q - 1) - 0.5
        front = a / ((2 - q) * beta * math.sqrt(2) * root) * _inverse_gamma((2 - q) / (q - 1))
        out[some] = front * x * x * (x / (2 * root)) ** nu * _bessel_k(nu, x / root)
    else:
        root = math.sqrt((1 - q) * beta)
        order = (2 - q) / (1 - q) + 0.5
        front = a * math.gamma((2 - q) / (1 - q) + 1) / (2 * (2 - q) * beta * math.sqrt(2) * root)
        out[some] = front * x * x * (2 * root / x) ** order * _bessel_j(order, x / root)
    return out


# --- compactly supported wavelets from a low-pass filter ------------------------------


def daubechies(p: int) -> np.ndarray:
    """Low-pass taps with p vanishing moments, in decomposition order, by spectral factorisation."""
    poly = [math.comb(p - 1 + k, k) for k in range(p)]
    # roots in y = (2 - z - 1/z) / 4 become pairs in z; those inside the unit circle stay
    inside = []
    for y in np.roots(poly[::-1]) if p > 1 else []:
        z = np.roots([1, 4 * y - 2, 1])
        inside.append(z[np.argmin(np.abs(z))])
    taps = np.real(np.poly(np.concatenate([-np.ones(p), inside])))
    return (taps / taps.sum() * math.sqrt(2))[::-1]


_S7 = math.sqrt(7)
#: Coiflet of order 1 in closed form.
COIF1 = np.array([_S7 - 3, 1 - _S7, 14 - 2 * _S7, 14 + 2 * _S7, 5 + _S7, 1 - _S7]) / (16 * math.sqrt(2))
# Published low-pass taps of the Coiflets of order 2 and 3 (Daubechies 1992), decomposition order.
COIF2 = np.array([
    -0.0007205494453645122, -0.0018232088707029932, 0.0056114348193944995, 0.023680171946334084, -0.0594344186464569, -0.0764885990783064,
    0.41700518442169254, 0.8127236354455423, 0.3861100668211622, -0.06737255472196302, -0.04146493678175915, 0.016387336463522112,
])
COIF3 = np.array([
    -3.459977283621256e-05, -7.098330313814114e-05, 0.0004662169601128863, 0.0011175187708906016, -0.0025745176887502236, -0.00900797613666158,
    0.015880544863615904, 0.03455502757306163, -0.08230192710688598, -0.07179982161931202, 0.42848347637761874, 0.7937772226256206,
    0.4051769024096169, -0.06112339000267287, -0.0657719112818555, 0.023452696141836267, 0.007782596427325418, -0.003793512864491014,
])


def cascade(low: np.ndarray, rounds: int = 12, construction: str = "aliased") -> tuple[np.ndarray, np.ndarray]:
    """(t, psi) of the wavelet of a low-pass filter on the grid of step 2**-(rounds + 1).

    A wavelet is the high-pass combination of its scaling function at half its
    width, and a scaling function the fixed point of refining by the low-pass filter:
    "standard" starts from the high-pass taps and refines them. "aliased" refines first
    and combines on the finest grid, so that psi changes sign from sample to sample."""
    n = len(low)
    low = np.asarray(low, dtype=float)
    high = (-1.0) ** np.arange(n) * low[::-1]

    def refine(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        wide = np.zeros(2 * len(x) - 1)
        wide[::2] = x
        return np.convolve(wide, math.sqrt(2) * h)

    steps = {"standard": [high, *[low] * rounds], "aliased": [*[low] * rounds, high]}
    if construction not in steps:
        raise ValueError(f"unknown construction {construction!r}")
    y = np.ones(1)
    for h in steps[construction]:
        y = refine(y, h)
    t = np.arange(len(y)) * 2.0 ** -(rounds + 1)
    return t - (n - 1) / 2, y


def cubic_spline(x0: float, step: float, y: np.ndarray) -> Evaluator:
    """Not-a-knot cubic interpolation on an even grid, 0 outside."""
    n = len(y)
    d = np.zeros(n)  # second derivatives times step**2 / 6, by a tridiagonal sweep
    r = y[2:] - 2 * y[1:-1] + y[:-2]
    m = n - 2
    diag, upper, lower = np.full(m, 4.0), np.ones(m), np.ones(m)
    diag[0] = diag[-1] = 6.0
    upper[0] = lower[-1] = 0.0
    c, z = np.zeros(m), np.zeros(m)
    c[0], z[0] = upper[0] / diag[0], r[0] / diag[0]
    for i in range(1, m):
        den = diag[i] - lower[i] * c[i - 1]
        c[i], z[i] = upper[i] / den, (r[i] - lower[i] * z[i - 1]) / den
    for i in range(m - 2, -1, -1):
        z[i] -= c[i] * z[i + 1]
    d[1:-1] = z
    d[0], d[-1] = 2 * d[1] - d[2], 2 * d[-2] - d[-3]

    def evaluate(u: np.ndarray) -> np.ndarray:
        v = (np.asarray(u, dtype=float) - x0) / step
        i = np.clip(np.floor(v).astype(int), 0, n - 2)
        b = v - i
        a = 1 - b
        out = a * y[i] + b * y[i + 1] + (a**3 - a) * d[i] + (b**3 - b) * d[i + 1]
        return np.where((v >= 0) & (v <= n - 1), out, 0.0)

    return evaluate


@lru_cache(maxsize=32)
def _compact(low: tuple[float, ...], construction: str) -> Evaluator:
    t, y = cascade(np.array(low), construction=construction)
    return cubic_spline(t[0], t[1] - t[0], y)


def register_compact(name: str, low: np.ndarray, stretch: float, half: float, construction: str = "aliased") -> str:
    taps = tuple(float(x) for x in low)
    return register(name, lambda u: _compact(taps, construction)(u), stretch, half)


for _name, _low, _stretch, _half in (
    ("db2", daubechies(2), 12.0, 1.5),
    ("db3", daubechies(3), 7.2, 2.5),
    ("db4", daubechies(4), 5.14, 3.5),
    ("coif1", COIF1, 7.2, 2.5),
    ("coif2", COIF2, 3.27, 5.5),
    ("coif3", COIF3, 2.12, 8.5),
):
    register_compact(_name, _low, _stretch, _half)


# --- columns --------------------------------------------------------------------------


def direct(x: str, a: str = "1.0", name: str = "g2") -> Column:
    """psi(x / (a * stretch)) as a column; x and a are SQL expressions."""
    w = wavelet(name)
    if w.sql is None:
        raise ValueError(f"{name} has no SQL expression")
    return F.expr(w.sql.replace("{u}", f"(({x})/(({a})*{w.stretch!r}))"))


def support(a: str, name: str = "g2") -> Column:
    """struct(lo, hi): where the wavelet at scale a can differ from 0."""
    w = wavelet(name)
    return F.expr(f"struct(({a})*{-w.half!r}*{w.stretch!r} as lo, ({a})*{w.half!r}*{w.stretch!r} as hi)")
