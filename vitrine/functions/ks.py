"""Two-sample Kolmogorov–Smirnov p-value (D3).

Chosen per feature from its sample sizes (as the default two-sided test of the
usual scientific Python stack does):

* exact, when both samples hold at most ``KS_EXACT_MAX_N`` values: the lattice-path
  probability (Hodges 1957) that a random interleaving of the two samples keeps
  ``|i·n2 − j·n1| < D·n1·n2`` at every step; ``p = 1 − that``.
* otherwise the one-sample two-sided law of ``n = rint(n1·n2/(n1+n2))`` values, at
  that finite n (regions after Simard and L'Ecuyer 2011):
  - ``n·D² ≥ 18``: ``2·exp(−2·n·D²)`` (below 1e-15);
  - ``n ≤ 2000``, or ``n ≤ 100 000`` and ``n·D^1.5 ≤ 1.4``: exact, by a power of the
    matrix of Marsaglia, Tsang and Wang (2003);
  - else the series of Pelz and Good (1976), the limiting law with its corrections
    of order n^-1/2, n^-1 and n^-3/2 (off by 1e-7 at most there).

All of it is one Pandas UDF over a table with one row per feature (bounded by the
schema): features are computed in parallel, and nothing is collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.config import KS_EXACT_MAX_N

#: Terms of each Pelz–Good sum (k = 0 … TERMS − 1 and their mirror images): beyond them
#: every term is under 1e-30 where z² < 18.
TERMS = 16
TAIL = 18.0
#: Up to this n the matrix is used for every D.
MATRIX_MAX_N = 2000


def _pelz_good(z: float, n: float) -> float:
    """P(D ≤ z/√n)."""
    s = z * z
    half = (np.arange(TERMS) + 0.5) ** 2 * math.pi ** 2  # both signs of k give the same term
    full = np.arange(1, TERMS) ** 2 * math.pi ** 2
    e, f = np.exp(-half / (2 * s)), np.exp(-full / (2 * s))
    k0 = e.sum()
    k1 = ((half - s) * e).sum()
    k2 = ((6 * s ** 3 + 2 * s ** 2 + half * (2 * s ** 2 - 5 * s) + half ** 2 * (1 - 2 * s)) * e).sum()
    k2b = (full * f).sum()
    k3 = ((half ** 3 * (5 - 30 * s) + half ** 2 * (212 * s ** 2 - 60 * s) + half * (135 * s ** 2 - 96 * s ** 3)
           - (30 * s ** 3 + 90 * s ** 4)) * e).sum()
    k3b = ((3 * full * s - full ** 2) * f).sum()
    c = math.sqrt(math.pi / 2)
    return (2 * c * k0 / z + c * k1 / (3 * s ** 2) / math.sqrt(n)
            + c * (k2 / (36 * z ** 7) - k2b / (18 * z ** 3)) / n
            + c * (k3 / (3240 * z ** 10) + k3b / (54 * z ** 6)) / (n * math.sqrt(n)))


def pelz_good_np(d: float, n: int) -> float:
    """1 − P(D_n ≤ d) by the series."""
    return float(min(max(1.0 - _pelz_good(d * math.sqrt(n), float(n)), 0.0), 1.0))


def sql_asymptotic_pvalue(d: str, n1: str, n2: str) -> str:
    """The law as DuckDB SQL text, by list functions over k. Sizes of the matrix's regions
    do not occur with tables of more than 10 000 rows unless D is so small that p is 1."""
    n = f"round_even(CAST({n1} AS DOUBLE) * CAST({n2} AS DOUBLE) / (CAST({n1} AS DOUBLE) + CAST({n2} AS DOUBLE)), 0)"
    z = f"(({d}) * sqrt({n}))"

    def total(ks: str, h: str, poly: str) -> str:
        term = f"({poly}) * exp(-0.5e0 * h / s)"
        return (f"list_sum(list_transform(list_transform(range({ks}), lambda k: {h}), lambda h: {term}))")

    half, full = "power(CAST(k AS DOUBLE) + 0.5e0, 2) * pi() * pi()", "power(CAST(k AS DOUBLE), 2) * pi() * pi()"
    k0 = total(f"0, {TERMS}", half, "1.0e0")
    k1 = total(f"0, {TERMS}", half, "h - s")
    k2 = total(f"0, {TERMS}", half, "6.0e0 * s * s * s + 2.0e0 * s * s + h * (2.0e0 * s * s - 5.0e0 * s) + h * h * (1.0e0 - 2.0e0 * s)")
    k2b = total(f"1, {TERMS}", full, "h")
    k3 = total(f"0, {TERMS}", half, "h * h * h * (5.0e0 - 30.0e0 * s) + h * h * (212.0e0 * s * s - 60.0e0 * s) "
               "+ h * (135.0e0 * s * s - 96.0e0 * s * s * s) - (30.0e0 * s * s * s + 90.0e0 * s * s * s * s)")
    k3b = total(f"1, {TERMS}", full, "3.0e0 * h * s - h * h")
    c = "sqrt(pi() / 2.0e0)"
    law = (f"(2.0e0 * {c} * {k0} / z + {c} * {k1} / (3.0e0 * s * s) / sqrt(n) "
           f"+ {c} * ({k2} / (36.0e0 * power(z, 7)) - {k2b} / (18.0e0 * power(z, 3))) / n "
           f"+ {c} * ({k3} / (3240.0e0 * power(z, 10)) + {k3b} / (54.0e0 * power(z, 6))) / (n * sqrt(n)))")
    return (f"(SELECT CASE WHEN z <= 0 THEN 1.0e0 WHEN s >= {TAIL}e0 THEN 2.0e0 * exp(-2.0e0 * s) WHEN z < 0.15e0 THEN 1.0e0 "
            f"ELSE least(greatest(1.0e0 - {law}, 0.0e0), 1.0e0) END FROM (SELECT {z} AS z, {z} * {z} AS s, {n} AS n))")


def matrix_pvalue_np(d: float, n: int) -> float:
    """1 − P(D_n < d), exactly: the (k, k) entry of the n-th power of the transition
    matrix of Marsaglia, Tsang and Wang, with n·d = k − h."""
    k = math.ceil(n * d)
    h, m = k - n * d, 2 * k - 1
    if m < 1 or d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    t = np.zeros((m, m))
    for i in range(m):
        t[i, :min(m, i + 2)] = 1.0
    t[:, 0] -= h ** np.arange(1, m + 1)
    t[m - 1, :] -= h ** np.arange(m, 0, -1)
    t[m - 1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0.0
    gap = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    inverse = np.exp([-math.lgamma(g + 1) for g in range(m + 1)])  # of the factorials
    t *= inverse[np.maximum(gap, 0)]
    power, scale = np.eye(m), 0  # the power times 10 ** scale
    base, base_scale, e = t, 0, n
    while e:
        if e & 1:
            power, scale = power @ base, scale + base_scale
        base, base_scale = base @ base, 2 * base_scale
        if base[k - 1, k - 1] > 1e140:
            base, base_scale = base * 1e-140, base_scale + 140
        if power[k - 1, k - 1] > 1e140:
            power, scale = power * 1e-140, scale + 140
        e >>= 1
    log_factor = math.lgamma(n + 1) - n * math.log(n) + scale * math.log(10)
    top = power[k - 1, k - 1]
    return float(min(max(1.0 - (math.exp(math.log(top) + log_factor) if top > 0 else 0.0), 0.0), 1.0))


def exact_pvalue_np(d_int: int, n1: int, n2: int) -> float:
    """P(D ≥ d) for two samples of sizes n1, n2 with D·n1·n2 = ``d_int`` (an exact integer).

    Walks the lattice by anti-diagonals s = i + j: ``a[i]`` is the probability that
    a uniformly random path reaches (i, s−i) without touching the boundary
    ``|i·n2 − j·n1| ≥ d_int``. Only the band between the boundaries is kept.
    """
    n1, n2, d_int = int(n1), int(n2), int(d_int)
    if d_int <= 0:
        return 1.0
    total = n1 + n2
    prev = np.zeros(n1 + 2)  # prev[i] on the last diagonal; prev[n1+1] stays 0
    prev[0] = 1.0  # (0, 0) is inside for d_int > 0
    for s in range(1, total + 1):
        # inside ⇔ |i·(n1+n2) − s·n1| < d_int; intersect with the lattice
        i_lo = max(0, s - n2, (s * n1 - d_int) // total + 1)
        i_hi = min(n1, s, (s * n1 + d_int - 1) // total)
        cur = np.zeros(n1 + 2)
        if i_lo <= i_hi:
            i = np.arange(i_lo, i_hi + 1, dtype=np.int64)
            j = s - i
            # from (i-1, j) with probability i/s, from (i, j-1) with probability j/s
            left = prev[np.maximum(i - 1, 0)] * (i >= 1) * (i / s)
            down = prev[i] * (j >= 1) * (j / s)
            val = left + down
            inside = np.abs(i * n2 - j * n1) < d_int
            cur[i_lo:i_hi + 1] = np.where(inside, val, 0.0)
        prev = cur
    stay = prev[n1]
    return float(min(max(1.0 - stay, 0.0), 1.0))


def one_sample_pvalue_np(d: float, n: int) -> float:
    """P(D_n ≥ d) of the one-sample law, by the tail, the matrix or the series."""
    s = n * d * d
    if d <= 0 or not n:
        return 1.0
    if s >= TAIL:
        return 2.0 * math.exp(-2.0 * s)
    if n <= MATRIX_MAX_N or (n <= 100_000 and n * d ** 1.5 <= 1.4):
        return matrix_pvalue_np(d, n)
    return pelz_good_np(d, n) if s >= 0.15 ** 2 else 1.0  # below 0.15 the law is under 1e-20


def ks_pvalue_np(d: float, n1: int, n2: int, exact_max_n: int = KS_EXACT_MAX_N) -> float:
    """D3 of the statistic ``d`` and the sample sizes. The exact two-sample law works on the
    integer D·n1·n2 (``rint`` of the double; exact there since n1·n2 ≤ 10⁸ by default)."""
    if max(n1, n2) <= exact_max_n:
        return exact_pvalue_np(int(np.rint(d * n1 * n2)), n1, n2)
    return one_sample_pvalue_np(d, int(np.rint(float(n1) * float(n2) / (float(n1) + float(n2)))))


@F.pandas_udf(T.DoubleType())
def _pvalue_udf(d: pd.Series, n1: pd.Series, n2: pd.Series, exact_max_n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(a) or pd.isna(b) else ks_pvalue_np(float(x), int(a), int(b), int(m))
                      for x, a, b, m in zip(d, n1, n2, exact_max_n)], dtype="float64")


def ks_pvalue(d, n1, n2, exact_max_n: int = KS_EXACT_MAX_N) -> Column:
    """D3: p-value Column from the KS statistic ``d`` and the sample sizes."""
    d, n1, n2 = [F.col(c) if isinstance(c, str) else c for c in (d, n1, n2)]
    return _pvalue_udf(d, n1, n2, F.lit(exact_max_n))
