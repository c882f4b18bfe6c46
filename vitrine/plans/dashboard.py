"""Dashboard bundle (A14): every chart of one filtered selection.

``dashboard`` returns a dict of DataFrames, one per chart. Two plans give the
same rows:

* ``fused=False``: one aggregation per chart over the filtered frame (each chart
  its own scan, with filters and columns pushed into parquet);
* ``fused=True``: KPI, maxima, damage sums, radar means, trend and fuel counts
  read **one** ``GROUPING SETS ((brand), (year), (fuel))`` result that is written to
  the checkpoint folder first (a row per brand, year and fuel), so that no chart
  aggregates the listings again; raw-value charts (box, scatter) are a second scan
  and the option lists (which ignore the series filter) a third.

``dashboard_long`` unions a bundle into long rows (chart, key, label, x, y) for a
single output table; ``dashboard_table(fused=True)`` builds that table in four
passes over the data, each emitting the rows of several charts with
``inline`` (no per-chart filter, so no per-chart re-aggregation):

1. a global aggregate (always one row): KPI, damage sums, radar maxima;
2. ``GROUPING SETS ((brand), (year), (fuel))``: radar means, trend, fuel counts;
3. the raw selected rows: box and scatter points;
4. the option lists under the base filter;

plus one scalar subquery (distinct brands) for the radar gate.

Every chart or pass reads the listings for itself. That is cheap over a file, but a
frame that is computed (a join) would be computed as often, with all its shuffles:
``freeze=True`` computes it once, writes the rows and columns the charts read as
parquet to the checkpoint folder, and all charts scan that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.config import RADAR_HEADROOM, ListingConfig
from vitrine.operators import aggregates as A
from vitrine.operators.filters import ListingFilters, listing_filter
from vitrine.session import ensure_checkpoint_dir


def facet_lists(df: DataFrame, filters: ListingFilters, cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """Distinct brands and series under every filter except series
    → (field, value) with field in {'brands', 'series_list'}."""
    base = df.where(listing_filter(filters, cfg, exclude={"series"}))
    pairs = F.array(F.struct(F.lit("brands").alias("field"), F.col(cfg.brand).alias("value")),
                    F.struct(F.lit("series_list").alias("field"), F.col(cfg.series).alias("value")))
    return (base.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
            .orderBy("field", "value"))  # K3: binary (UTF-8) order


def frozen_listings(df: DataFrame, filters: ListingFilters, cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """The rows under every filter except series (the option lists ignore it) with the
    columns that charts and option lists read, computed once and read back as parquet."""
    cols = [cfg.brand, cfg.series, cfg.price, cfg.year, cfg.mileage, cfg.fuel, *(c for _, c in cfg.radar_measures()),
            *(c for _, group in cfg.damage_columns() for c in group)]
    base = df.where(listing_filter(filters, cfg, exclude={"series"})).select(*dict.fromkeys(cols))
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/dashboard-{uuid.uuid4().hex}"
    base.write.parquet(path)
    return df.sparkSession.read.schema(base.schema).parquet(path)


def dashboard(df: DataFrame, filters: ListingFilters = ListingFilters(), cfg: ListingConfig = ListingConfig(),
              fused: bool = False, freeze: bool = False) -> dict[str, DataFrame]:
    if freeze:
        df = frozen_listings(df, filters, cfg)
    lists = facet_lists(df, filters, cfg)
    sel = df.where(listing_filter(filters, cfg))
    out = {
        "brands": lists.where(F.col("field") == "brands").select("value"),
        "series_list": lists.where(F.col("field") == "series_list").select("value"),
        "box": A.group_values(sel, cfg.brand, cfg.price),
        "scatter": A.group_points(sel, cfg.brand, cfg.mileage, cfg.price),
    }
    if not fused:
        ind, ser = A.radar(sel, cfg)
        out.update({
            "kpi": A.kpi(sel, cfg.price),
            "trend": A.trend(sel, cfg.year, cfg.price),
            "fuel": A.category_counts(sel, cfg.fuel),
            "damage": A.damage_by_part(sel, cfg),
            "radar_indicators": ind,
            "radar_series": ser,
        })
    else:
        out.update(_fused_charts(sel, cfg))
    return out


# grouping_id bits: brand is the most significant of (brand, year, fuel)
_G_BRAND, _G_YEAR, _G_FUEL = 0b011, 0b101, 0b110


def _fused_charts(sel: DataFrame, cfg: ListingConfig) -> dict[str, DataFrame]:
    parts = cfg.damage_columns()
    measures = cfg.radar_measures()
    aggs = [F.count(F.lit(1)).alias("n"), F.count(cfg.price).alias("n_price"), F.sum(F.col(cfg.price).cast("double")).alias("sum_price")]
    aggs += [F.avg(c).alias(f"avg{i}") for i, (_, c) in enumerate(measures)]
    aggs += [F.max(c).cast("double").alias(f"max{i}") for i, (_, c) in enumerate(measures)]
    aggs += [A.paired_sum(cols).cast("bigint").alias(f"dmg{i}") for i, (_, cols) in enumerate(parts)]
    aggs.append(F.grouping_id().alias("gid"))
    ensure_checkpoint_dir(sel.sparkSession)
    g = sel.groupingSets([[cfg.brand], [cfg.year], [cfg.fuel]], cfg.brand, cfg.year, cfg.fuel).agg(*aggs).checkpoint(eager=True)

    by_brand = g.where(F.col("gid") == _G_BRAND)
    # always one row, also for an empty selection
    whole = by_brand.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("sum_price"), F.sum("n_price")).alias("avg_price"),
        *[F.max(f"max{i}").alias(f"max{i}") for i in range(len(measures))], *[F.sum(f"dmg{i}").alias(f"dmg{i}") for i in range(len(parts))])
    kpi = whole.select(F.col("n").alias("total"), F.coalesce("avg_price", F.lit(0.0)).alias("avg_price"))
    total = whole.where(F.col("n") > 0)
    trend = (g.where((F.col("gid") == _G_YEAR) & F.col(cfg.year).isNotNull())
             .select(F.col(cfg.year).alias("key"), F.try_divide("sum_price", "n_price").alias("avg_value"))
             .orderBy("key"))
    fuel = (g.where((F.col("gid") == _G_FUEL) & F.col(cfg.fuel).isNotNull())
            .select(F.col(cfg.fuel).alias("name"), F.col("n").alias("value")))
    damage = total.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(label).alias("part"), F.col(f"dmg{i}").alias("value"))
        for i, (label, _) in enumerate(parts)])))
    indicators = total.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(name).alias("name"),
                 (F.coalesce(F.col(f"max{i}"), F.lit(0.0)) * F.lit(RADAR_HEADROOM)).alias("max"))
        for i, (name, _) in enumerate(measures)])))
    series = by_brand.select(F.col(cfg.brand).alias("group"), F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(name).alias("name"),
                 F.coalesce(F.col(f"avg{i}"), F.lit(0.0)).alias("value"))
        for i, (name, _) in enumerate(measures)])))
    # gate on the number of non-NULL brand groups, read from the grouped rows
    n_groups = by_brand.select(F.count(F.col(cfg.brand))).scalar()
    lim = F.lit(cfg.radar_max_groups)
    return {
        "kpi": kpi, "trend": trend, "fuel": fuel, "damage": damage,
        "radar_indicators": indicators.where(n_groups <= lim),
        "radar_series": series.where(n_groups <= lim),
    }


def dashboard_long(charts: dict[str, DataFrame]) -> DataFrame:
    """All charts as (chart, key, label, x, y) rows."""
    s, d = "string", "double"

    def rows(name, key, label, x, y):
        return F.lit(name).alias("chart"), key.cast(s).alias("key"), label.cast(s).alias("label"), \
            x.cast(d).alias("x"), y.cast(d).alias("y")

    none = F.lit(None)
    parts = [
        charts["brands"].select(*rows("brands", F.col("value"), none, none, none)),
        charts["series_list"].select(*rows("series_list", F.col("value"), none, none, none)),
        charts["kpi"].select(F.inline(F.array(
            F.struct(*rows("kpi", F.lit("total"), none, none, F.col("total"))),
            F.struct(*rows("kpi", F.lit("avg_price"), none, none, F.col("avg_price")))))),
        charts["box"].select(*rows("box", F.col("group"), none, none, F.col("value"))),
        charts["scatter"].select(*rows("scatter", F.col("group"), none, F.col("x"), F.col("y"))),
        charts["trend"].select(*rows("trend", F.col("key"), none, F.col("key"), F.col("avg_value"))),
        charts["fuel"].select(*rows("fuel", F.col("name"), none, none, F.col("value"))),
        charts["damage"].select(*rows("damage", F.col("part"), none, F.col("ordinal"), F.col("value"))),
        charts["radar_indicators"].select(*rows("radar_indicators", F.col("name"), none,
                                                F.col("ordinal"), F.col("max"))),
        charts["radar_series"].select(*rows("radar_series", F.col("group"), F.col("name"),
                                            F.col("ordinal"), F.col("value"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _row(chart, key, label, x, y):
    s_, d = "string", "double"
    return F.struct(F.lit(chart).alias("chart"), key.cast(s_).alias("key"), label.cast(s_).alias("label"),
                    x.cast(d).alias("x"), y.cast(d).alias("y"))


_ROWS_TYPE = "array<struct<chart:string,key:string,label:string,x:double,y:double>>"


def _when_rows(cond, rows):
    """The rows if ``cond`` holds, else none (an empty array, so ``concat`` keeps the others)."""
    return F.when(cond, F.array(*rows)).otherwise(F.array().cast(_ROWS_TYPE))


def dashboard_table(df: DataFrame, filters: ListingFilters = ListingFilters(),
                    cfg: ListingConfig = ListingConfig(), fused: bool = True, freeze: bool = False) -> DataFrame:
    """The whole bundle as one long table (chart, key, label, x, y)."""
    if freeze:
        df = frozen_listings(df, filters, cfg)
    if not fused:
        return dashboard_long(dashboard(df, filters, cfg, fused=False))
    none = F.lit(None)
    sel = df.where(listing_filter(filters, cfg))
    parts = cfg.damage_columns()
    measures = cfg.radar_measures()
    n_groups = sel.select(F.count_distinct(F.col(cfg.brand))).scalar()
    gate = n_groups <= F.lit(cfg.radar_max_groups)

    # 1. global aggregate: one row even for an empty selection
    tot = sel.agg(F.count(F.lit(1)).alias("n"), F.avg(cfg.price).alias("avg_price"),
                  *[F.max(c).cast("double").alias(f"max{i}") for i, (_, c) in enumerate(measures)],
                  *[A.paired_sum(cols).cast("bigint").alias(f"dmg{i}") for i, (_, cols) in enumerate(parts)])
    has = F.col("n") > 0
    tot_rows = F.concat(
        F.array(_row("kpi", F.lit("total"), none, none, F.col("n")),
                _row("kpi", F.lit("avg_price"), none, none, F.coalesce(F.col("avg_price"), F.lit(0.0)))),
        _when_rows(has, [_row("damage", F.lit(label), none, F.lit(i + 1), F.col(f"dmg{i}"))
                         for i, (label, _) in enumerate(parts)]),
        _when_rows(has & gate, [_row("radar_indicators", F.lit(name), none, F.lit(i + 1),
                                     F.coalesce(F.col(f"max{i}"), F.lit(0.0)) * F.lit(RADAR_HEADROOM))
                                for i, (name, _) in enumerate(measures)]))
    from_totals = tot.select(F.inline(tot_rows))

    # 2. grouped charts in one aggregation
    g = sel.groupingSets([[cfg.brand], [cfg.year], [cfg.fuel]], cfg.brand, cfg.year, cfg.fuel).agg(
        F.count(F.lit(1)).alias("n"), F.avg(cfg.price).alias("avg_price"),
        *[F.avg(c).alias(f"avg{i}") for i, (_, c) in enumerate(measures)],
        F.grouping_id().alias("gid"))
    gid = F.col("gid")
    g_rows = F.concat(
        _when_rows((gid == _G_BRAND) & gate,
                   [_row("radar_series", F.col(cfg.brand), F.lit(name), F.lit(i + 1),
                         F.coalesce(F.col(f"avg{i}"), F.lit(0.0)))
                    for i, (name, _) in enumerate(measures)]),
        _when_rows((gid == _G_YEAR) & F.col(cfg.year).isNotNull(),
                   [_row("trend", F.col(cfg.year), none, F.col(cfg.year), F.col("avg_price"))]),
        _when_rows((gid == _G_FUEL) & F.col(cfg.fuel).isNotNull(),
                   [_row("fuel", F.col(cfg.fuel), none, none, F.col("n"))]))
    from_groups = g.select(F.inline(g_rows))

    # 3. raw-value charts in one pass
    p, km, b = F.col(cfg.price), F.col(cfg.mileage), F.col(cfg.brand)
    raw_rows = F.concat(
        _when_rows(p.isNotNull(), [_row("box", b, none, none, p)]),
        _when_rows(p.isNotNull() & km.isNotNull(), [_row("scatter", b, none, km, p)]))
    from_raw = sel.select(F.inline(raw_rows))

    # 4. option lists under the base filter
    lists = facet_lists(df, filters, cfg).select(
        F.inline(F.array(_row(F.col("field"), F.col("value"), none, none, none))))
    return from_totals.unionByName(from_groups).unionByName(from_raw).unionByName(lists)
