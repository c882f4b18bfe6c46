"""Cascading option lists.

The three lists (all brands; series of the chosen brand; models of the chosen
brand and series) come from one scan and one aggregation: every row emits the
(level, value) entries it qualifies for, and ``distinct`` keeps one of each.
Selected values are bound literals, compared as-is (the "All" token is not
special here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.config import ListingConfig


def cascade_options(df: DataFrame, brand: str | None = None, series: str | None = None,
                    cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """→ (level, value) with level in {'brands', 'series', 'models'}; order by value
    for display (binary order, as in the source lists)."""
    b, s, m = F.col(cfg.brand), F.col(cfg.series), F.col(cfg.model)
    levels = [F.struct(F.lit("brands").alias("level"), b.alias("value"))]
    if brand:
        levels.append(F.struct(F.lit("series").alias("level"),
                               F.when(b == F.lit(brand), s).alias("value")))
        if series:
            levels.append(F.struct(F.lit("models").alias("level"),
                                   F.when((b == F.lit(brand)) & (s == F.lit(series)), m).alias("value")))
    return (df.select(F.inline(F.array(*levels)))
            .where(F.col("value").isNotNull())
            .distinct()
            .orderBy("level", "value"))  # K3: binary (UTF-8) order, as in the source lists


def option_tree(df: DataFrame, cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """Every (brand, series, model) path at once, for clients that cascade locally."""
    return (df.select(F.col(cfg.brand).alias("brand"), F.col(cfg.series).alias("series"),
                      F.col(cfg.model).alias("model"))
            .where(F.col("brand").isNotNull())
            .distinct())
