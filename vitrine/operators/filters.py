"""Optional filters as Column predicates.

Predicates are plain Columns, so Catalyst folds the ``TRUE`` seeds away and
pushes the comparisons into the parquet scan (``PushedFilters``). Values are
literals, never spliced into SQL text, so quotes in values need no escaping.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.config import ALL_TOKEN, ListingConfig


def _unset(value, zero_means_unset: bool = True) -> bool:
    """Bounds are tested by truthiness: None, and by default 0, mean no bound."""
    if value is None:
        return True
    return zero_means_unset and not value


def is_chosen(value: str | None, all_token: str = ALL_TOKEN) -> bool:
    """a value selects rows unless it is None, empty or the "All" token."""
    return bool(value) and value != all_token


def eq_unless_all(col: str, value: str | None, all_token: str = ALL_TOKEN) -> Column:
    """``col = value`` where a value is chosen, else TRUE."""
    return F.col(col) == F.lit(value) if is_chosen(value, all_token) else F.lit(True)


def optional_range(col: str, lo=None, hi=None, cast=float, zero_means_unset: bool = True) -> Column:
    """Inclusive bounds, each optional. NULL measures drop out (3-valued logic)."""
    cond = F.lit(True)
    if not _unset(lo, zero_means_unset):
        cond = cond & (F.col(col) >= F.lit(cast(lo)))
    if not _unset(hi, zero_means_unset):
        cond = cond & (F.col(col) <= F.lit(cast(hi)))
    return cond


@dataclass(frozen=True)
class ListingFilters:
    brand: str | None = None
    series: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_year: int | None = None
    max_year: int | None = None
    min_km: int | None = None
    max_km: int | None = None
    fuel: str | None = None


def conjunction(conds) -> Column:
    """AND of predicates seeded with TRUE."""
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def listing_filter(filters: ListingFilters, cfg: ListingConfig = ListingConfig(),
                   exclude: frozenset | set = frozenset(), zero_means_unset: bool = True) -> Column:
    """conjunction of all optional filters; names in ``exclude`` are skipped
    (the option lists ignore their own facet: ``exclude={"series"}``)."""
    conds = []
    if "brand" not in exclude:
        conds.append(eq_unless_all(cfg.brand, filters.brand, cfg.all_token))
    if "series" not in exclude:
        conds.append(eq_unless_all(cfg.series, filters.series, cfg.all_token))
    if "price" not in exclude:
        conds.append(optional_range(cfg.price, filters.min_price, filters.max_price, float, zero_means_unset))
    if "year" not in exclude:
        conds.append(optional_range(cfg.year, filters.min_year, filters.max_year, int, zero_means_unset))
    if "mileage" not in exclude:
        conds.append(optional_range(cfg.mileage, filters.min_km, filters.max_km, int, zero_means_unset))
    if "fuel" not in exclude:
        conds.append(eq_unless_all(cfg.fuel, filters.fuel, cfg.all_token))
    return conjunction(conds)


def qcol(name: str) -> Column:
    """A top-level column by its exact name (dots and backticks quoted)."""
    return F.col("`" + name.replace("`", "``") + "`")


def not_null(*cols: str) -> Column:
    """every named column is non-NULL."""
    return conjunction([F.col(c).isNotNull() for c in cols])


def eq_bound(**values) -> Column:
    """equality on bound values with no sentinel handling (option lists)."""
    return conjunction([F.col(c) == F.lit(v) for c, v in values.items()])


def select_features(df: DataFrame, names: list[str]) -> DataFrame:
    """columns in the given order; an unknown name fails before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not in frame: {missing}")
    return df.select(*names)


def numeric_features(df: DataFrame, first: str | None = "price",
                     columns: list[str] | None = None) -> list[str]:
    """numeric columns in schema order (``first`` moved to the front).

    Integer and floating types count; boolean, decimal, date/time and interval
    types do not. An explicit ``columns`` list overrides discovery.
    """
    if columns is not None:
        names = list(columns)
    else:
        numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, numeric)]
    if first and first in names:
        names.remove(first)
        names.insert(0, first)
    return names


def finite(col: Column) -> Column:
    """non-NULL, non-NaN and finite (±Inf would break pooled bin edges)."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(math.inf))


def segment_pair(ref: DataFrame, curr: DataFrame, col: str, value) -> tuple[DataFrame, DataFrame]:
    """filter each side on ``col = value`` only if it has the column.

    Raises FileNotFoundError when either side is left empty (one short
    ``isEmpty`` job per side: a LIMIT 1 scan that stops at the first row).
    """
    if value is None or value == "":
        return ref, curr
    if col in ref.columns:
        ref = ref.where(F.col(col) == F.lit(value))
    if col in curr.columns:
        curr = curr.where(F.col(col) == F.lit(value))
    if ref.isEmpty() or curr.isEmpty():
        raise FileNotFoundError(f"no rows for {col} = {value!r} in one or both snapshots")
    return ref, curr
