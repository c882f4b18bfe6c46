"""Filters, aggregates, option lists and the dashboard on inline edge rows."""

import pytest
from pyspark.sql import functions as F

from vitrine.config import ListingConfig
from vitrine.operators import aggregates as A
from vitrine.operators.filters import ListingFilters, listing_filter
from vitrine.operators.options import cascade_options, option_tree
from vitrine.operators.quantiles import box_summary
from vitrine.plans.dashboard import dashboard, dashboard_long, dashboard_table, facet_lists
from vitrine.sources import adapters
from tests.conftest import SF_SMALL

SCHEMA = ("brand string, series string, model string, price double, kb_year int, kb_mileage bigint, "
          "kb_fuel string, power_hp_val int, kb_fuel_cons_avg double")


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    data = [
        ("A", "s1", "m1", 100.0, 2010, 1000, "Benzin", 90, 5.0),
        ("A", "s1", "m2", 200.0, 2011, 2000, "Dizel", 110, 6.0),
        ("A", "s2", "m3", None, 2011, None, None, 100, 4.0),
        ("O'Neil", "s3", "m4", 300.0, 2012, 3000, "Benzin", 150, 7.0),
        (None, "s4", "m5", 400.0, 2012, 4000, "Dizel", 200, 8.0),
        ("B", "s5", "m6", 500.0, 2013, 5000, "Benzin", 120, None),
        ("B", "s5", "m7", None, 2014, 6000, "Benzin", 130, 6.5),  # 2014: prices all NULL
    ]
    return rows(spark, data)


def count(df, f):
    return df.where(listing_filter(f)).count()


def test_sentinel_zero_bounds_and_quotes(edge):
    assert count(edge, ListingFilters()) == 7
    assert count(edge, ListingFilters(brand="Tümü", series="", fuel="Tümü")) == 7
    assert count(edge, ListingFilters(min_price=0, max_km=0)) == 7  # zero means unset
    assert count(edge, ListingFilters(brand="O'Neil")) == 1
    assert count(edge, ListingFilters(min_price=150)) == 4  # NULL prices drop out
    assert count(edge, ListingFilters(min_year=2011, max_year=2012, fuel="Benzin")) == 1


def test_adding_a_filter_never_raises_the_count(edge):
    base = ListingFilters(min_year=2010)
    assert count(edge, ListingFilters(min_year=2010, brand="A")) <= count(edge, base)
    assert count(edge, ListingFilters(min_year=2010, max_km=3000)) <= count(edge, base)


def test_filters_reach_the_parquet_scan(spark):
    df = adapters.table(spark, SF_SMALL, "lineitem").select("l_extendedprice", "l_quantity")
    f = df.where((F.col("l_extendedprice") >= 1000.0) & (F.col("l_quantity") <= 10.0))
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_extendedprice), IsNotNull(l_quantity), GreaterThanOrEqual(l_extendedprice" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double>" in plan


def test_kpi_and_empty_selection(edge):
    k = A.kpi(edge).first()
    assert k.total == 7 and k.avg_price == pytest.approx(300.0)
    sel = edge.where(listing_filter(ListingFilters(brand="nobody")))
    assert tuple(A.kpi(sel).first()) == (0, 0.0)
    charts = dashboard(adapters.listings(edge.sparkSession, SF_SMALL), ListingFilters(brand="nobody"))
    assert charts["brands"].count() == 0
    for name in ("box", "scatter", "trend", "fuel", "damage", "radar_indicators", "radar_series"):
        assert charts[name].count() == 0, name


def test_trend_keeps_year_with_only_null_prices(edge):
    t = {r.key: r.avg_value for r in A.trend(edge, "kb_year", "price").collect()}
    assert t[2014] is None and t[2011] == 200.0


def test_null_group_in_box_scatter_radar(edge):
    groups = {r.group for r in A.group_values(edge, "brand", "price").collect()}
    assert None in groups
    pts = A.group_points(edge, "brand", "kb_mileage", "price").collect()
    assert all(p.x is not None and p.y is not None for p in pts)
    series = A.radar_series(edge).collect()
    assert None in {r.group for r in series}


def test_radar_gate_five_versus_six(spark):
    base = [(b, "s", "m", 10.0, 2010, 1, "f", 1, 1.0) for b in "ABCDE"]
    five = rows(spark, base + [(None, "s", "m", 10.0, 2010, 1, "f", 1, 1.0)])  # NULL not counted
    six = rows(spark, base + [("F", "s", "m", 10.0, 2010, 1, "f", 1, 1.0)])
    ind5, ser5 = A.radar(five, ListingConfig())
    ind6, ser6 = A.radar(six, ListingConfig())
    assert ind5.count() == 4 and ser5.count() == 6 * 4
    assert ind6.count() == 0 and ser6.count() == 0
    ind = {r.name: r.max for r in ind5.collect()}
    assert ind["Fiyat"] == pytest.approx(11.0)


def test_damage_sums_are_null_safe(spark):
    cfg = ListingConfig()
    cols = [c for _, pair in cfg.damage_columns() for c in pair]
    schema = ", ".join(f"{c} int" for c in cols)
    r1 = [1] * len(cols)
    r2 = [None] * len(cols)
    df = spark.createDataFrame([r1, r2], schema)
    d = A.damage_by_part(df, cfg).orderBy("ordinal").collect()
    assert [r.part for r in d][:3] == ["Kaput", "Tavan", "Bagaj"]
    assert all(r.value == 2 for r in d)


def test_fused_equals_unfused(spark):
    df = adapters.listings(spark, SF_SMALL)
    for f in (ListingFilters(), ListingFilters(brand="Brand#22"), ListingFilters(min_year=1999, fuel="2-HIGH"),
              ListingFilters(brand="nobody")):
        key = lambda r: tuple("" if v is None else str(v) for v in r)
        a = sorted(dashboard_long(dashboard(df, f, fused=False)).collect(), key=key)
        b = sorted(dashboard_long(dashboard(df, f, fused=True)).collect(), key=key)
        c = sorted(dashboard_table(df, f, fused=True).collect(), key=key)
        assert len(b) == len(c)
        for x, y in zip(b, c):
            assert x[:4] == y[:4]
            assert (x.y is None and y.y is None) or x.y == pytest.approx(y.y, rel=1e-12)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x[:4] == y[:4]
            assert (x.y is None and y.y is None) or x.y == pytest.approx(y.y, rel=1e-12)


def test_facets_ignore_series_filter(edge):
    f = facet_lists(edge, ListingFilters(series="s1")).collect()
    series = {r.value for r in f if r.field == "series_list"}
    assert series == {"s1", "s2", "s3", "s4", "s5"}


def test_cascade_options(edge):
    got = {(r.level, r.value) for r in cascade_options(edge, "A", "s1").collect()}
    assert got == {("brands", "A"), ("brands", "B"), ("brands", "O'Neil"),
                   ("series", "s1"), ("series", "s2"), ("models", "m1"), ("models", "m2")}
    only_brands = {r.level for r in cascade_options(edge, None, "s1").collect()}
    assert only_brands == {"brands"}  # series ignored without a brand
    tree = option_tree(edge).collect()
    assert ("A", "s1", "m1") in {tuple(r) for r in tree}


def test_box_summary_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = {"A": rng.integers(0, 30, 400).astype(float), "B": rng.normal(5, 2, 77), None: np.array([4.0])}
    data = [(g, "s", "m", float(v), 2000, 1, "f", 1, 1.0) for g, vs in vals.items() for v in vs]
    data.append(("A", "s", "m", None, 2000, 1, "f", 1, 1.0))
    df = rows(spark, data)
    for n in (1, 4, 16):
        got = {r.group: r for r in box_summary(df, "brand", "price", partitions=n).collect()}
        for g, vs in vals.items():
            want = np.percentile(vs, [0, 25, 50, 75, 100])
            r = got[g]
            assert r.n == len(vs)
            assert [r.q0, r.q1, r.q2, r.q3, r.q4] == pytest.approx(list(want), rel=1e-12)


def test_box_summary_large_null_group_keeps_all_rows(spark):
    from vitrine.operators.quantiles import group_quantiles
    import numpy as np
    vals = np.arange(3000, dtype=float)
    data = [(None if i % 3 else "A", "s", "m", float(v), 2000, 1, "f", 1, 1.0) for i, v in enumerate(vals)]
    df = rows(spark, data)
    # many partitions: both groups cross borders, the NULL one included
    got = {r.group: r for r in group_quantiles(df, "brand", "price", partitions=30).collect()}
    assert got[None].n == 2000 and got["A"].n == 1000
    assert got[None].q2 == float(np.percentile([v for i, v in enumerate(vals) if i % 3], 50))


def test_donut_sums_to_non_null_fuel_and_order_does_not_matter(spark):
    df = adapters.listings(spark, SF_SMALL)
    f = ListingFilters(min_year=1997)
    sel = df.where(listing_filter(f))
    donut = sum(r.value for r in A.category_counts(sel, "kb_fuel").collect())
    assert donut == sel.where(F.col("kb_fuel").isNotNull()).count()
    shuffled = df.orderBy(F.rand(seed=3)).repartition(5)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    a = sorted(dashboard_table(df, f).collect(), key=key)
    b = sorted(dashboard_table(shuffled, f).collect(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:4] == y[:4]
        assert (x.y is None and y.y is None) or x.y == pytest.approx(y.y, rel=1e-12)


def test_small_filter_and_list_helpers(edge):
    from vitrine.operators.filters import eq_bound, not_null, select_features
    vals = A.distinct_values(edge, ["brand", "kb_fuel"]).collect()
    assert [(r.field, r.value) for r in vals] == [("brand", "A"), ("brand", "B"), ("brand", "O'Neil"),
                                                  ("kb_fuel", "Benzin"), ("kb_fuel", "Dizel")]
    assert edge.where(eq_bound(brand="A", series="s1")).count() == 2
    assert edge.where(eq_bound(brand="Tümü")).count() == 0  # no sentinel in bound equality
    assert edge.where(not_null("price", "kb_mileage")).count() == 5
    assert select_features(edge, ["price", "brand"]).columns == ["price", "brand"]
    with pytest.raises(KeyError):
        select_features(edge, ["price", "nope"])
