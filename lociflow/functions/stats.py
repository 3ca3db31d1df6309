"""Distribution functions of columns: gamma, beta, t, chi-square, F, normal and Kolmogorov-Smirnov.

They run on whole Arrow batches: series and continued fractions are numpy loops over all rows of a batch at once, which
end when every row has settled. (As column expressions, with a fixed number of steps for each row, they were some
hundred times slower.) A null argument gives null; one outside a function's domain gives null too."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative change below which a sum or fraction has settled, and the steps after which it is given up (null).
SETTLED, STEPS = 1e-15, 100_000
TINY = 1e-300
# Coefficients of Lanczos' approximation of the gamma function for g = 7, from the literature.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function, for x > 0."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        y = np.where(x < 0.5, 1.0 - x, x) - 1.0
        series = LANCZOS[0] + sum(c / (y + k) for k, c in enumerate(LANCZOS[1:], 1))
        t = y + 7.5
        high = 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(series)
        low = np.log(math.pi / np.sin(math.pi * x)) - high
        return np.where(x > 0, np.where(x < 0.5, low, high), np.nan)


def _fraction(start: np.ndarray, first: float, steps) -> np.ndarray:
    """A continued fraction by Lentz's way: start is its first denominator, first what its numerators' fraction begins
    with; steps(k) gives the numerators and denominators of a step, as pairs. Rows that don't settle are nan."""
    away = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    d = 1.0 / away(start)
    c, h, done = np.full(len(start), first), d.copy(), np.zeros(len(start), bool)
    for k in range(1, STEPS):
        last = h.copy()
        for up, down in steps(k):
            d = 1.0 / away(up * d + down)
            c = away(down + up / c)
            h = np.where(done, h, h * d * c)
        done |= ~(np.abs(h - last) > SETTLED * np.abs(h))
        if done.all():
            return h
    return np.where(done, h, np.nan)


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function Q(a, x): for a > 0, x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where((a > 0) & (x == 0), 1.0, np.nan)
    with np.errstate(all="ignore"):
        for low in (True, False):
            on = np.flatnonzero((a > 0) & (x > 0) & ((x < a + 1) == low))
            if not len(on):
                continue
            p, z = a[on], x[on]
            front = np.exp(p * np.log(z) - z - log_gamma(p))
            if low:
                term = total = 1.0 / p
                for k in range(1, STEPS):
                    term = term * z / (p + k)
                    total = total + term
                    if not (term > SETTLED * total).any():
                        break
                out[on] = 1.0 - front * total
            else:
                out[on] = front * _fraction(z + 1.0 - p, 1.0 / TINY, lambda k: [(k * (p - k), z + 1.0 - p + 2.0 * k)])
    return out


def beta_lower(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b): for a, b > 0 and 0 <= x <= 1."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    fine = (a > 0) & (b > 0)
    out = np.where(fine & ((x == 0) | (x == 1)), x, np.nan)
    with np.errstate(all="ignore"):
        for near in (True, False):  # the fraction settles fast on one side; the other is its mirror image
            on = np.flatnonzero(fine & (x > 0) & (x < 1) & ((x < (a + 1) / (a + b + 2)) == near))
            if not len(on):
                continue
            z, p, q = (x[on], a[on], b[on]) if near else (1 - x[on], b[on], a[on])

            def steps(m: int, z=z, p=p, q=q) -> list[tuple[np.ndarray, np.ndarray]]:
                even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
                odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
                return [(even, 1.0), (odd, 1.0)]

            front = np.exp(p * np.log(z) + q * np.log1p(-z) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
            value = front * _fraction(1.0 - (p + q) * z / (p + 1.0), 1.0, steps)
            out[on] = value if near else 1.0 - value
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.where(df > 0, beta_lower(df / (df + t * t), df / 2.0, 0.5), np.nan)


def normal_lower_of(z: np.ndarray) -> np.ndarray:
    half = gamma_upper(np.full(len(z), 0.5), z * z / 2.0) / 2.0
    return np.where(z < 0, half, 1.0 - half)


def normal_quantile_of(p: np.ndarray) -> np.ndarray:
    """By bisection between -40 and 40."""
    low, high = np.full(len(p), -40.0), np.full(len(p), 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        up = normal_lower_of(middle) < p
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return np.where((p > 0) & (p < 1), (low + high) / 2, np.nan)


def _column(f, *columns: Column) -> Column:
    """f over whole batches of the columns as numbers; nan is null."""

    def run(*parts: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(f(*(p.to_numpy(float, na_value=np.nan) for p in parts)), dtype="float64")

    # as many named arguments as columns, so that the kind of function can be told
    wrapped = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[len(columns)]
    wrapped.__annotations__ = {n: pd.Series for n in ("a", "b", "c")[: len(columns)]} | {"return": pd.Series}
    return F.pandas_udf(wrapped, T.DoubleType())(*[c.cast("double") for c in columns])


def t_tail(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with df > 0 degrees of freedom."""
    return _column(t_two_sided, t, df)


def chi_square_tail(x: Column, df: Column) -> Column:
    return _column(lambda x, df: gamma_upper(df / 2.0, np.maximum(x, 0.0) / 2.0), x, df)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    return _column(lambda f, n, m: beta_lower(m / (m + n * np.maximum(f, 0.0)), m / 2.0, n / 2.0), f, df1, df2)


def normal_lower(z: Column) -> Column:
    return _column(normal_lower_of, z)


def normal_quantile(p: Column) -> Column:
    """z with P(Z <= z) = p, for 0 < p < 1."""
    return _column(normal_quantile_of, p)


def kolmogorov_of(x: float, terms: int = 10) -> float:
    """P(K >= x) of Kolmogorov's limit distribution: genetics.kolmogorov_tail() for one number."""
    if x <= 0:
        return 1.0
    k = np.arange(1, terms + 1)
    if x < 1:
        return float(1.0 - math.sqrt(2 * math.pi) / x * np.exp(-((2 * k - 1) ** 2) * math.pi**2 / 8 / (x * x)).sum())
    return float(2.0 * ((-1.0) ** (k - 1) * np.exp(-2.0 * k * k * x * x)).sum())


def smirnov(m: int, n: int, d: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """P(D < d) of two-sample Kolmogorov-Smirnov distances of samples of m and n values, for each distance: the share of
    the monotone paths from (0, 0) to (m, n) whose points stay nearer than d to the diagonal, all paths' points of one
    sum of coordinates at a time. A path's points are the pooled values in order; with ties, ends says by distance and
    point (1 to m + n) whether it is the last of equal values: the distance is taken at those alone."""
    m, n = min(m, n), max(m, n)
    d = np.atleast_1d(np.asarray(d, float))
    if not m > 0:
        return np.full(len(d), math.nan)
    # distances are multiples of 1 / (m n): compared as whole numbers
    least = np.floor(d * m * n - 1e-7) + 1
    i = np.arange(m + 1)
    share = np.zeros((len(d), m + 1))  # the part of the paths to (i, k - i) that stayed near
    share[:, 0] = 1.0
    for k in range(1, m + n + 1):
        # a path to (i, j) comes from (i - 1, j) in i of i + j cases
        new = share * ((k - i) / k)
        new[:, 1:] += share[:, :-1] * (i[1:] / k)
        off = np.abs(i * n - (k - i) * m)
        far = off >= least[:, None]
        if ends is not None:
            far &= ends[:, k - 1, None]
        new[far] = 0.0
        new[:, (i > k) | (k - i > n)] = 0.0
        share = new
    return share[:, m]


@F.pandas_udf(T.DoubleType())
def smirnov_tail(n: pd.Series, m: pd.Series, d: pd.Series, groups: pd.Series) -> pd.Series:
    """P(D >= d) of two samples of n and m values, exactly; groups holds how many pooled values are equal, in their
    order, or is null where none are. Null sizes or distances give null. Rows of equal sizes are worked out together, in
    n + m steps."""
    out = np.full(len(d), np.nan)
    known = (n.notna() & m.notna() & d.notna()).to_numpy()
    low, high = np.minimum(n, m).to_numpy(), np.maximum(n, m).to_numpy()
    for a, b in {(low[k], high[k]) for k in np.flatnonzero(known)}:
        of = np.flatnonzero(known & (low == a) & (high == b))
        for some in np.array_split(of, max(1, len(of) * int(a + b) // 4_000_000)):
            ends = np.ones((len(some), int(a + b)), bool)
            for row, g in enumerate(groups.iloc[some]):
                if g is not None:
                    ends[row] = False
                    ends[row, np.cumsum(g) - 1] = True
            out[some] = 1.0 - smirnov(int(a), int(b), d.iloc[some].to_numpy(), None if ends.all() else ends)
    return pd.Series(out).where(known, None)


def kolmogorov_one(n: int, d: float) -> float:
    """P(D_n < d) of the one-sample distance: the Durbin matrix of order 2 k - 1 raised to the n-th power by squaring
    (Marsaglia, Tsang and Wang 2003), scaled as it grows."""
    if n < 1 or d <= 0:
        return 0.0
    if d >= 1:
        return 1.0
    k = int(n * d) + 1
    order, h = 2 * k - 1, k - n * d
    at = np.arange(order)
    gap = at[:, None] - at[None, :] + 1
    matrix = (gap >= 0).astype(float)
    ends = h ** (at + 1)
    matrix[:, 0] -= ends
    matrix[-1, :] -= ends[::-1]
    if 2 * h > 1:
        matrix[-1, 0] += (2 * h - 1) ** order
    matrix /= np.array([math.factorial(g) if g > 0 else 1 for g in gap.ravel()], float).reshape(gap.shape)
    power, scale, left, base, base_scale = np.eye(order), 0, n, matrix, 0
    while left:
        if left & 1:
            power, scale = power @ base, scale + base_scale
        left >>= 1
        if left:
            base, base_scale = base @ base, 2 * base_scale
        for _ in range(2):
            if power.max() > 1e140:
                power, scale = power * 1e-140, scale + 140
            if base.max() > 1e140:
                base, base_scale = base * 1e-140, base_scale + 140
    log = math.log(max(power[k - 1, k - 1], TINY)) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return min(1.0, math.exp(log))
