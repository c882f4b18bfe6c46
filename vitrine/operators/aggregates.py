"""Dashboard aggregates.

All charts are long rows. Charts that show raw values (box, scatter) stay one
row per listing and are never gathered into one array per group, so a group
holding a third of the table is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.config import RADAR_HEADROOM, ListingConfig


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """A1/K3: non-NULL distinct values of several columns in one scan → (field, value).

    One ``explode`` per row feeds one aggregation; map-side partial aggregation
    keeps only the distinct values of each task before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return (df.select(F.inline(pairs))
            .where(F.col("value").isNotNull())
            .distinct()
            .orderBy("field", "value"))


def kpi(df: DataFrame, measure: str = "price") -> DataFrame:
    """A2: row count and mean measure (NULL mean → 0)."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.coalesce(F.avg(measure), F.lit(0.0)).alias("avg_price"))


def group_values(df: DataFrame, group: str, measure: str) -> DataFrame:
    """A4 (box plot values): (group, value) per non-NULL measure; NULL groups kept."""
    return (df.where(F.col(measure).isNotNull())
            .select(F.col(group).alias("group"), F.col(measure).cast("double").alias("value")))


def group_points(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """A5 (scatter): (group, x, y) where both coordinates are non-NULL."""
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .select(F.col(group).alias("group"), F.col(x).cast("double").alias("x"),
                    F.col(y).cast("double").alias("y")))


def trend(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Mean measure per non-NULL key, ordered by key (NULL mean kept)."""
    return (df.where(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("key"))
            .agg(F.avg(measure).alias("avg_value"))
            .orderBy("key"))


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per non-NULL category."""
    return (df.where(F.col(col).isNotNull())
            .groupBy(F.col(col).alias("name"))
            .agg(F.count(F.lit(1)).alias("value")))


def paired_sum(cols: list[str]) -> Column:
    """E4 + A8: SUM of the NULL-safe sum of the columns, per row."""
    expr = None
    for c in cols:
        term = F.coalesce(F.col(c), F.lit(0))
        expr = term if expr is None else expr + term
    return F.sum(expr)


def damage_by_part(df: DataFrame, cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """One scan, one global aggregate of 11 paired sums, unpivoted in fixed order
    → (ordinal, part, value). No rows when the input is empty."""
    parts = cfg.damage_columns()
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [paired_sum(cols).cast("bigint").alias(f"_p{i}") for i, (_, cols) in enumerate(parts)]
    wide = df.agg(*aggs).where(F.col("_n") > 0)
    entries = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(label).alias("part"),
                                 F.col(f"_p{i}").alias("value"))
                        for i, (label, _) in enumerate(parts)])
    return wide.select(F.inline(entries))


def group_cardinality(df: DataFrame, group: str, conditions: list[Column] | None = None) -> DataFrame:
    """A10: the number of distinct non-NULL groups → (n_groups), or with ``conditions``
    (set_id, n_groups), the number of groups that have a row under each of them: one
    aggregate by group keeps per condition whether any row meets it, a second counts."""
    if conditions is None:
        return df.agg(F.count_distinct(F.col(group)).alias("n_groups"))
    met = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"_h{k}") for k, c in enumerate(conditions)]
    wide = df.where(F.col(group).isNotNull()).groupBy(group).agg(*met).agg(
        *[F.count_if(F.col(f"_h{k}") == 1).alias(f"_g{k}") for k in range(len(conditions))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k + 1).alias("set_id"), F.col(f"_g{k}").alias("n_groups"))
                                          for k in range(len(conditions))])))


def radar_indicators(df: DataFrame, cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """Global maxima (NULL → 0) × 1.1 per radar axis → (ordinal, name, max).
    No rows when the input is empty."""
    measures = cfg.radar_measures()
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [(F.coalesce(F.max(c), F.lit(0)).cast("double") * F.lit(RADAR_HEADROOM)).alias(f"_m{i}")
             for i, (_, c) in enumerate(measures)]
    entries = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(name).alias("name"),
                                 F.col(f"_m{i}").alias("max"))
                        for i, (name, _) in enumerate(measures)])
    return df.agg(*aggs).where(F.col("_n") > 0).select(F.inline(entries))


def radar_series(df: DataFrame, cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """Per group (NULL group kept) the mean of each radar axis (NULL → 0)
    → long rows (group, ordinal, name, value)."""
    measures = cfg.radar_measures()
    wide = df.groupBy(F.col(cfg.brand).alias("group")).agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_a{i}") for i, (_, c) in enumerate(measures)])
    entries = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(name).alias("name"),
                                 F.col(f"_a{i}").alias("value"))
                        for i, (name, _) in enumerate(measures)])
    return wide.select("group", F.inline(entries))


def gate_by_cardinality(chart: DataFrame, source: DataFrame, group: str, limit: int) -> DataFrame:
    """Keep ``chart`` only if ``source`` has at most ``limit`` distinct non-NULL
    groups. The count is a scalar subquery, evaluated once inside the plan: no
    driver-side branch, no join."""
    n = source.select(F.count_distinct(F.col(group))).scalar()
    return chart.where(n <= F.lit(limit))


def radar(df: DataFrame, cfg: ListingConfig = ListingConfig()) -> tuple[DataFrame, DataFrame]:
    """(indicators, series), both empty when there are more than
    ``cfg.radar_max_groups`` distinct groups."""
    lim = cfg.radar_max_groups
    return (gate_by_cardinality(radar_indicators(df, cfg), df, cfg.brand, lim),
            gate_by_cardinality(radar_series(df, cfg), df, cfg.brand, lim))
