"""Scalar Column functions (E1–E15). All JVM-side expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.config import BAND_HIGH_FACTOR, BAND_LOW_FACTOR, DamageRules


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def np_round(col, n: int) -> Column:
    """NumPy's ``round(x, n)``: half-to-even on the scaled double,
    ``rint(x·10ⁿ)/10ⁿ``. Differs from ``F.round`` (half-up on the decimal text):
    0.025 → 0.02 here, 0.03 there."""
    scale = float(10 ** n)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def sql_np_round(expr: str, n: int) -> str:
    """The same rounding as DuckDB SQL text (for oracle queries)."""
    scale = f"{float(10 ** n)!r}e0" if "e" not in repr(float(10 ** n)) else repr(float(10 ** n))
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def truncate_to_long(col) -> Column:
    """Python ``int(x)``: toward zero; out-of-range raises under ANSI."""
    return _c(col).cast("bigint")


def status_score(col, weights: dict) -> Column:
    """Score of a part status; unknown or NULL statuses score 0."""
    expr = None
    for status, w in weights.items():
        cond = _c(col) == F.lit(status)
        expr = F.when(cond, F.lit(float(w))) if expr is None else expr.when(cond, F.lit(float(w)))
    return expr.otherwise(F.lit(0.0)) if expr is not None else F.lit(0.0)


def weighted_sum(cols, weights) -> Column:
    """Σ col·weight, left to right."""
    expr = None
    for c, w in zip(cols, weights):
        term = _c(c) * F.lit(float(w))
        expr = term if expr is None else expr + term
    return expr


def risk_score(damage, rules: DamageRules = DamageRules()) -> Column:
    """Rule-based expert risk score of a damage struct, as double.

    Expects the struct after defaults (see ``validate.apply_defaults``);
    fields: {roof,hood,trunk}_status, {doors,fenders}_{changed,painted,local}.
    """
    d = _c(damage)
    score = (status_score(d["roof_status"], rules.roof)
             + status_score(d["hood_status"], rules.hood)
             + status_score(d["trunk_status"], rules.trunk))
    doors = weighted_sum([d["doors_changed"], d["doors_painted"], d["doors_local"]], rules.doors)
    fenders = weighted_sum([d["fenders_changed"], d["fenders_painted"], d["fenders_local"]], rules.fenders)
    return (score + doors + fenders).cast("double")


def widen_band(q05, q50, q95, low: float = BAND_LOW_FACTOR, high: float = BAND_HIGH_FACTOR):
    """(low, high, margin %) with low = q05·0.98, high = q95·1.02 and
    margin = ((high − low)/2)/q50·100; NULL margin when q50 = 0 (ANSI-safe)."""
    lo = _c(q05) * F.lit(low)
    hi = _c(q95) * F.lit(high)
    margin = F.try_divide((hi - lo) / F.lit(2.0), _c(q50)) * F.lit(100.0)
    return lo, hi, margin


def safe_ratio(num, den, zero_den_positive: float, zero_den_zero: float = 0.0) -> Column:
    """num/den if den > 0; otherwise ``zero_den_positive`` if num > 0 else
    ``zero_den_zero``."""
    n, d = _c(num), _c(den)
    return (F.when(d > 0, n / F.when(d > 0, d))
            .when(n > 0, F.lit(zero_den_positive))
            .otherwise(F.lit(zero_den_zero)))


def linspace_edges(lo, hi, bins: int) -> Column:
    """NumPy ``linspace(lo, hi, bins+1)`` as an array: i·((hi−lo)/bins)+lo,
    last edge set to ``hi`` exactly."""
    step = (_c(hi) - _c(lo)) / F.lit(float(bins))
    inner = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                        lambda i: i.cast("double") * step + _c(lo))
    return F.concat(inner, F.array(_c(hi).cast("double")))
