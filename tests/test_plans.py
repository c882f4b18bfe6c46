"""Physical-plan properties the scale design relies on."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from vitrine.operators.drift import drift_stats
from vitrine.operators.filters import ListingFilters
from vitrine.operators.scoring import LinearQuantileModel, score
from vitrine.plans.dashboard import dashboard_table
from vitrine.sources import adapters
from tests.conftest import SF_SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_expression_scoring_stays_in_the_jvm(spark):
    model = LinearQuantileModel({"power_hp_val": 1.0, "year": 2.0}, 3.0)
    res, _ = score(adapters.requests(spark, SF_SMALL), model, "v", keep=["request_id"], method="expr")
    p = plan_of(res)
    assert "ArrowEvalPython" not in p and "MapInPandas" not in p and "BatchEvalPython" not in p
    assert "PythonUDF" not in p


def test_arrow_scoring_uses_map_in_pandas(spark):
    model = LinearQuantileModel({"power_hp_val": 1.0, "year": 2.0}, 3.0)
    res, _ = score(adapters.requests(spark, SF_SMALL), model, "v", keep=["request_id"], method="arrow")
    assert "MapInPandas" in plan_of(res)


def test_fused_dashboard_scans_less(spark):
    df = adapters.listings(spark, SF_SMALL)
    f = ListingFilters(min_year=1996)
    fused = plan_of(dashboard_table(df, f, fused=True)).count("FileScan parquet")
    unfused = plan_of(dashboard_table(df, f, fused=False)).count("FileScan parquet")
    assert fused < unfused


@pytest.mark.parametrize("name", ["dashboard_empty", "dashboard", "dashboard_charts", "dashboard_unfused", "dashboard_one_brand"])
def test_dashboard_joins_the_listings_once(spark, name):
    """The join ran once per chart or pass; now the charts scan its frozen rows."""
    p = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "lineitem" not in p and "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


@pytest.mark.parametrize("filters", [ListingFilters(), ListingFilters(series="STANDARD", min_year=1996), ListingFilters(brand="nobody")])
def test_frozen_listings_change_no_row(spark, filters):
    cols = ("brand string, series string, price double, kb_year int, kb_mileage bigint, kb_fuel string, power_hp_val int, "
            "kb_fuel_cons_avg double, " + ", ".join(f"{c} int" for _, group in E.CFG.damage_columns() for c in group))
    flags = [1, None] * 11
    twice = ("A", "STANDARD", 100.0, 1996, 1000, "x", 90, 5.0, *flags)
    df = spark.createDataFrame([twice, twice, ("A", "LARGE", None, 1997, None, None, None, None, *flags),
                                (None, "STANDARD", 7.5, None, 3, "y", 1, 0.5, *flags[::-1]), ("B", None, -1.0, 1998, 0, "x", 2, None, *flags)], cols)

    def sorted_rows(fused, freeze):
        return sorted(map(repr, dashboard_table(df, filters, E.CFG, fused=fused, freeze=freeze).collect()))

    assert sorted_rows(True, True) == sorted_rows(True, False)
    assert sorted_rows(False, True) == sorted_rows(False, False)


@pytest.mark.parametrize("name", ["kpi_empty", "radar_series", "drift_segment_stats"])
def test_selection_by_brand_meets_part_before_orders(spark, name, monkeypatch):
    """Orders met every line, and the lines were shuffled a second time to meet part."""
    seen, listings = [], adapters.listings
    monkeypatch.setattr(adapters, "listings", lambda *a, **k: seen.append(listings(*a, **k)) or seen[-1])
    E.queries()[name](spark, SF_SMALL)
    assert seen and all(depths(df)["part"] > depths(df)["orders"] for df in seen)


@pytest.mark.parametrize("name", ["dashboard_one_brand", "dashboard_empty", "dashboard"])
def test_dashboard_of_one_brand_meets_part_before_orders(spark, name, monkeypatch):
    seen, listings = [], adapters.listings
    monkeypatch.setattr(adapters, "listings", lambda *a, **k: seen.append(listings(*a, **k)) or seen[-1])
    E.queries()[name](spark, SF_SMALL)
    assert len(seen) == 1 and (depths(seen[0])["part"] > depths(seen[0])["orders"]) == (name != "dashboard")


def depths(df) -> dict[str, int]:
    """How deep in the plan each table lies: the deeper one is joined first."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return {t: next(len(line) - len(line.lstrip(" :+-")) for line in lines if f"Relation [{key}" in line)
            for t, key in (("part", "p_partkey"), ("orders", "o_orderkey"))}


def test_order_of_the_joins_changes_no_row(spark, tmp_dir):
    """Keys that repeat, are NULL or have no partner, on every side."""
    li = [(k, p, 1, n, 2.0, 10.0 * n, 0.01, "R", "1996-03-01") for k in (1, 1, 2, None, 9) for p in (5, 6, None, 8) for n in (1, 7)]
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                              "l_tax double, l_returnflag string, l_shipdate string") \
        .withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{tmp_dir}/lineitem.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (1, "2-HIGH"), (2, None), (None, "x")], "o_orderkey long, o_orderpriority string") \
        .write.parquet(f"{tmp_dir}/orders.parquet")
    spark.createDataFrame([(5, "a", "Brand#22", "T", 1), (5, "b", "Brand#13", None, 2), (6, "c", None, "T", None), (None, "d", "Brand#22", "T", 3)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_dir}/part.parquet")
    one, two = (adapters.listings(spark, tmp_dir, part_first=first) for first in (False, True))
    assert one.schema == two.schema
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert one.count() == 2 * 5 * 3  # line numbers; orders of keys 1, 1, 2; parts of keys 5, 6


def test_running_totals_are_dealt_by_range(spark):
    ref, curr = adapters.orders_pair(spark, SF_SMALL)
    st = drift_stats(ref, curr, ["o_totalprice", "o_custkey"], partitions=4).stats
    p = plan_of(st)
    assert "hashpartitioning(_range" in p
    # windows run over the small table of borders only; no row is joined or windowed by feature
    assert all("own_" in line or "_first" in line for line in p.splitlines() if "Window [" in line)
    assert "SortMergeJoin" not in p and "percentile" not in p


def test_scoring_code_is_small_enough_to_be_compiled(spark, tmp_dir):
    """The JVM interprets methods of more than 8000 bytes; the whole scoring stage must stay below."""
    import re

    adapters.requests(spark, SF_SMALL).write.parquet(f"{tmp_dir}/requests")
    model = LinearQuantileModel({"power_hp_val": 310.0, "year": 2.5, "expert_risk_score": -40.0}, 100.0)
    res, _ = score(spark.read.parquet(f"{tmp_dir}/requests"), model, "v", keep=["request_id", "line"], method="expr")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", res._jdf.queryExecution().explainString(mode))]
    assert sizes and max(sizes) < 7000
