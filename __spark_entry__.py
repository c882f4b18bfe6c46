"""

Every query reads the benchmark tables of ``sf_dir`` through the adapters in
``vitrine.sources.adapters`` (listings, snapshot pairs, requests, registry
records) and runs the library's operators over whole tables. Each oracle is
the same column names and types. Averages and other order-sensitive float
results are rounded the NumPy way (half-even on the scaled double) on both
sides; sums of prices are compared in integer cents.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections.abc import Callable

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.config import DAMAGE_PARTS, LISTINGS_FILE, RADAR_AXES, SHAP_FILE, ListingConfig
from vitrine.functions.ks import sql_asymptotic_pvalue
from vitrine.functions.scalars import np_round, risk_score, sql_np_round
from vitrine.operators import aggregates as A
from vitrine.operators.drift import (drift_histogram, drift_report, drift_result, drift_result_json,
                                     drift_stats)
from vitrine.operators.filters import ListingFilters, is_chosen, listing_filter
from vitrine.operators.options import cascade_options, option_tree
from vitrine.operators.quantiles import box_summary
from vitrine.operators.scoring import LinearQuantileModel, score, score_tagged
from vitrine.operators.validate import apply_defaults, split_valid, validate
from vitrine.plans.dashboard import dashboard, dashboard_long, dashboard_table, facet_lists
from vitrine.plans import service
from vitrine.plans.scoring_job import score_version
from vitrine.session import ensure_checkpoint_dir
from vitrine.sources import adapters
from vitrine.sources.artifacts import artifact_catalog, missing_artifacts, read_artifacts, read_object, write_artifacts
from vitrine.sources.listings import read_listings, snapshot_path
from vitrine.sources.registry import latest_version, read_registry, registry_newest_first

CFG = ListingConfig()
SMALL_SF = "/root/testdata/sf0.001"

# Training-data operators: registered only where their subpackage is present.
# A missing subpackage (or pipeline module) is the only import error tolerated.
try:
    import corpus_pipeline as _pipeline
    from vitrine.llm import queries as _llm
except ModuleNotFoundError as err:
    if err.name not in ("corpus_pipeline", "vitrine.llm"):
        raise
    _llm = _pipeline = None

# ---------------------------------------------------------------------------
# Parameters of the registered queries
# ---------------------------------------------------------------------------

FILTER_SETS = (
    ListingFilters(),
    ListingFilters(brand="Brand#22"),
    ListingFilters(brand="Tümü", fuel=""),
    ListingFilters(min_price=0, max_price=50000),
    ListingFilters(min_year=1996, max_year=1998, min_km=0, max_km=100000),
    ListingFilters(brand="O'Neil"),
    ListingFilters(brand="Brand#22", series="STANDARD", fuel="2-HIGH"),
    ListingFilters(min_price=1000.5, max_km=0, fuel="Tümü", series="Tümü"),
    ListingFilters(min_km=40000, max_year=1997),
)
DASH_FILTERS = ListingFilters(min_year=1996, max_price=90000, series="Tümü")
ONE_BRAND = ListingFilters(brand="Brand#22", min_year=1996)
KPI_FILTERS = ListingFilters(min_year=1996, max_year=2000, fuel="3-MEDIUM")
EMPTY_FILTERS = ListingFilters(brand="O'Neil")
FACET_FILTERS = ListingFilters(series="LARGE", min_year=1996, max_km=150000)
CASCADE = ("Brand#22", "STANDARD")
SEGMENT = ("brand", "Brand#22")
MODEL = LinearQuantileModel({"power_hp_val": 310.0, "year": 2.5, "expert_risk_score": -40.0},
                            intercept=100.0, low=0.9, high=1.1)
MODEL_VERSION = "v_linear"
MODEL_B = LinearQuantileModel({"power_hp_val": 95.0, "year": 4.0}, intercept=-20.0, low=0.8, high=1.3)
DRIFT_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax"]
DRIFT_ORDERS = ["o_orderkey", "o_custkey", "o_totalprice"]
#: Numeric columns as discovery orders them: price first, then schema order.
DRIFT_DISCOVERED = ["price", "power_hp_val", "kb_year", "kb_mileage", "kb_fuel_cons_avg"]
DRIFT_LISTINGS = ["price", "kb_year", "kb_mileage", "power_hp_val", "kb_fuel_cons_avg"]


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def _listings(spark: SparkSession, sf: str, filters: ListingFilters = ListingFilters()) -> DataFrame:
    """The whole listings; ``filters``: what will be selected from them, for the order of the joins."""
    return adapters.listings(spark, sf, part_first=is_chosen(filters.brand, CFG.all_token))


def q_price_trend_by_year(spark, sf):
    t = A.trend(_listings(spark, sf), CFG.year, CFG.price)
    return t.select("key", np_round("avg_value", 4).alias("avg_value"))


def q_filter_combinations(spark, sf):
    df = _listings(spark, sf)
    aggs = []
    for k, f in enumerate(FILTER_SETS, start=1):
        cond = listing_filter(f, CFG)
        aggs += [F.count_if(cond).alias(f"n{k}"),
                 F.sum(F.when(cond, F.rint(F.col("price") * 100).cast("bigint"))).alias(f"s{k}")]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("set_id"), F.col(f"n{k}").alias("n"), F.col(f"s{k}").alias("sum_cents"))
        for k in range(1, len(FILTER_SETS) + 1)])))


def q_facet_lists(spark, sf):
    return facet_lists(_listings(spark, sf), FACET_FILTERS, CFG)


def q_kpi(spark, sf):
    sel = _listings(spark, sf).where(listing_filter(KPI_FILTERS, CFG))
    return A.kpi(sel, CFG.price).select("total", np_round("avg_price", 4).alias("avg_price"))


def q_kpi_empty(spark, sf):
    sel = _listings(spark, sf, EMPTY_FILTERS).where(listing_filter(EMPTY_FILTERS, CFG))
    return A.kpi(sel, CFG.price).select("total", np_round("avg_price", 4).alias("avg_price"))


def q_box_values(spark, sf):
    sel = _listings(spark, sf).where(listing_filter(DASH_FILTERS, CFG))
    return A.group_values(sel, CFG.brand, CFG.price)


def q_box_summary(spark, sf):
    sel = _listings(spark, sf).where(listing_filter(DASH_FILTERS, CFG))
    b = box_summary(sel, CFG.brand, CFG.price)
    return b.select("group", "n", *[np_round(c, 4).alias(c) for c in ("q0", "q1", "q2", "q3", "q4")])


def q_scatter_points(spark, sf):
    sel = _listings(spark, sf).where(listing_filter(DASH_FILTERS, CFG))
    return A.group_points(sel, CFG.brand, CFG.mileage, CFG.price)


def q_fuel_counts(spark, sf):
    sel = _listings(spark, sf).where(listing_filter(DASH_FILTERS, CFG))
    return A.category_counts(sel, CFG.fuel)


def q_damage_by_part(spark, sf):
    sel = _listings(spark, sf).where(listing_filter(DASH_FILTERS, CFG))
    return A.damage_by_part(sel, CFG)


def q_radar_indicators(spark, sf):
    sel = _listings(spark, sf, ONE_BRAND).where(listing_filter(ONE_BRAND, CFG))
    ind, _ = A.radar(sel, CFG)
    return ind.select("ordinal", "name", np_round("max", 4).alias("max"))


def q_radar_series(spark, sf):
    sel = _listings(spark, sf, ONE_BRAND).where(listing_filter(ONE_BRAND, CFG))
    _, ser = A.radar(sel, CFG)
    return ser.select("group", "ordinal", "name", np_round("value", 4).alias("value"))


def q_radar_series_gated(spark, sf):
    sel = _listings(spark, sf).where(listing_filter(DASH_FILTERS, CFG))
    _, ser = A.radar(sel, CFG)
    return ser.select("group", "ordinal", "name", np_round("value", 4).alias("value"))


def _dashboard(spark, sf, filters, fused):
    long = dashboard_table(_listings(spark, sf, filters), filters, CFG, fused=fused, freeze=True)
    return long.select("chart", "key", "label", "x", np_round("y", 4).alias("y"))


def q_dashboard(spark, sf):
    return _dashboard(spark, sf, DASH_FILTERS, fused=True)


def q_dashboard_unfused(spark, sf):
    return _dashboard(spark, sf, DASH_FILTERS, fused=False)


def q_dashboard_one_brand(spark, sf):
    return _dashboard(spark, sf, ONE_BRAND, fused=True)


def q_cascade_options(spark, sf):
    return cascade_options(_listings(spark, sf), CASCADE[0], CASCADE[1], CFG)


def q_risk_score(spark, sf):
    r = adapters.requests(spark, sf)
    return r.select("request_id", "line", risk_score(apply_defaults(F.col("damage_details"))).alias("risk_score"))


def q_validate_requests(spark, sf):
    v = validate(adapters.requests(spark, sf), keep=["request_id", "line"])
    return v.select("request_id", "line", F.size("errors").alias("n_errors"),
                    F.concat_ws(",", "errors").alias("errors"))


def _score(spark, sf, method):
    res, _ = score(adapters.requests(spark, sf), MODEL, MODEL_VERSION, keep=["request_id", "line"],
                   method=method)
    return res


def q_score_requests(spark, sf):
    return _score(spark, sf, "expr")


def q_score_requests_arrow(spark, sf):
    return _score(spark, sf, "arrow")


def q_registry_newest_first(spark, sf):
    return registry_newest_first(adapters.registry_records(spark, sf)).select(
        "rank", "pos", "version_id", "date", "n_orders", "revenue")


def q_latest_version(spark, sf):
    return latest_version(adapters.registry_records(spark, sf)).select("pos", "version_id", "date")


def _drift(spark, sf, kind):
    ref, curr = adapters.lineitem_pair(spark, sf, kind)
    return drift_report(ref, curr, DRIFT_LI)


def q_drift_report(spark, sf):
    return _drift(spark, sf, "drifted")


def q_drift_report_scaled(spark, sf):
    return _drift(spark, sf, "scaled")


def q_drift_report_identical(spark, sf):
    return _drift(spark, sf, "identical")


def q_drift_report_orders(spark, sf):
    ref, curr = adapters.orders_pair(spark, sf)
    return drift_report(ref, curr, DRIFT_ORDERS)


def q_drift_stats_orders(spark, sf):
    ref, curr = adapters.orders_pair(spark, sf)
    s = drift_stats(ref, curr, DRIFT_ORDERS).stats
    return s.select("feature", "n_ref", "n_curr", np_round("ks", 6).alias("ks"),
                    np_round("emd", 2).alias("emd"), np_round("std_ref", 2).alias("std_ref"),
                    "vmin", "vmax")


def q_drift_histogram(spark, sf):
    ref, curr = adapters.lineitem_pair(spark, sf, "drifted")
    return drift_histogram(ref, curr, DRIFT_LI)


def q_drift_segment(spark, sf):
    from vitrine.operators.drift import segment_drift
    ref, curr = adapters.listings_pair(spark, sf, part_first=True)
    return segment_drift(ref, curr, SEGMENT[0], SEGMENT[1], DRIFT_LISTINGS)


def q_group_cardinality(spark, sf):
    """A10 under every filter set in one pass."""
    return A.group_cardinality(_listings(spark, sf), CFG.brand, [listing_filter(f, CFG) for f in FILTER_SETS])


def q_option_tree(spark, sf):
    return option_tree(_listings(spark, sf), CFG)


def q_drift_result_json(spark, sf):
    ref, curr = adapters.orders_pair(spark, sf)
    rep = drift_report(ref, curr, DRIFT_ORDERS)
    return drift_result_json(drift_result(rep, drift_histogram(ref, curr, DRIFT_ORDERS)))


def q_score_latest_version(spark, sf):
    res, _ = score_version(adapters.requests(spark, sf), adapters.registry_records(spark, sf),
                           lambda v: MODEL, keep=["request_id", "line"], method="expr", nested=False)
    return res


def q_drift_segment_stats(spark, sf):
    from vitrine.operators.filters import segment_pair
    ref, curr = segment_pair(*adapters.listings_pair(spark, sf, part_first=True), SEGMENT[0], SEGMENT[1])
    s = drift_stats(ref, curr, DRIFT_LISTINGS).stats
    return s.select("feature", "n_ref", "n_curr", np_round("ks", 6).alias("ks"),
                    np_round("emd", 2).alias("emd"), np_round("std_ref", 2).alias("std_ref"),
                    "vmin", "vmax")


def _scratch(spark) -> str:
    """A fresh folder under the checkpoint folder that all nodes share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/queries-{uuid.uuid4().hex}"


def q_listings_round_trip(spark, sf):
    """The listings table written and read by the source, and the KPI of a table that is not there."""
    root = _scratch(spark)
    df = _listings(spark, sf).select("brand", "series", "model", "price")
    df.write.parquet(f"{root}/{LISTINGS_FILE}")
    there = service.listings(spark, root)
    gone = read_listings(spark, f"{root}/none.parquet", on_missing="empty", schema=there.schema)
    return A.kpi(there).select(F.lit("there").alias("source"), "total", np_round("avg_price", 4).alias("avg_price")).unionAll(
        A.kpi(gone).select(F.lit("missing"), "total", np_round("avg_price", 4)))


def _drift_snapshots(spark, sf) -> str:
    """Two model versions' training snapshots: price not first, one feature with
    NaN on both sides, one that the later version does not have a value of."""
    root = _scratch(spark)
    power = F.when(F.col("power_hp_val") % 10 == 3, F.lit(float("nan"))).when(
        F.col("power_hp_val") % 10 == 4, F.lit(float("inf"))).otherwise(F.col("power_hp_val").cast("double"))
    for version, df in zip(("v1", "v2"), adapters.listings_pair(spark, sf)):
        km = F.col("kb_mileage") if version == "v1" else F.lit(None).cast("bigint")
        df.select("brand", power.alias("power_hp_val"), "kb_year", km.alias("kb_mileage"), "price", "kb_fuel_cons_avg") \
            .write.parquet(snapshot_path(root, version))
    return root


def q_version_drift(spark, sf):
    """D9 with S2, F14 (no column list), F15 and A16 (a feature with an empty side is left out)."""
    return service.get_drift_data(spark, _drift_snapshots(spark, sf), "v1", "v2").report()


def q_registry_json_lines(spark, sf):
    """S3, K1, V7: JSON Lines in several files, read back; positions follow files and lines."""
    path = f"{_scratch(spark)}/registry"
    adapters.registry_records(spark, sf).repartitionByRange(4, "pos").sortWithinPartitions("pos").drop("pos").write.json(path)
    return _registry_rows(read_registry(spark, path, lines=True))


def q_registry_json_array(spark, sf):
    """The same records as one JSON array (one row per month: bounded)."""
    path = f"{_scratch(spark)}/registry.json"
    records = adapters.registry_records(spark, sf).agg(F.sort_array(F.collect_list(
        F.struct("pos", "version_id", "date", "n_orders", "revenue"))).alias("a"))
    entry = F.transform("a", lambda r: r.dropFields("pos"))
    records.select(F.to_json(entry).alias("value")).write.text(path)
    return _registry_rows(read_registry(spark, path))


def _registry_rows(records: DataFrame) -> DataFrame:
    return registry_newest_first(records).select(
        "rank", "pos", "version_id", "date", F.col("extra")["n_orders"].cast("bigint").alias("n_orders"),
        F.col("extra")["revenue"].cast("double").alias("revenue"))


def q_rejected_requests(spark, sf):
    """V4, V5: the rejected rows where fields have the wrong type: fractional years,
    counts as text (some of it no integer), NaN mileages."""
    ln = F.col("line")
    raw = adapters.requests(spark, sf).withColumns({
        "year": F.when(ln == 5, F.col("year") + 0.7).otherwise(F.col("year").cast("double")),
        "cylinder_count": F.when(ln == 3, "six").when(ln == 4, "3.9").otherwise(F.col("cylinder_count").cast("string")),
        "mileage": F.when(ln == 2, F.lit(float("nan"))).otherwise(F.col("mileage"))})
    _, rejected = split_valid(validate(raw, keep=["request_id", "line"]))
    return rejected.select("request_id", "line", F.concat_ws(",", "errors").alias("errors"))


def q_score_two_models(spark, sf):
    """Two models under one version name, each scored by its own values in one session."""
    requests = adapters.requests(spark, sf)
    out = [score(requests, m, MODEL_VERSION, keep=["request_id", "line"], method="arrow")[0].select(
        F.lit(name).alias("model"), "request_id", "line", "price", "price_min", "price_max")
        for name, m in (("a", MODEL), ("b", MODEL_B))]
    return out[0].unionAll(out[1])


def q_dashboard_empty(spark, sf):
    """A3: the whole bundle over an empty selection."""
    return _dashboard(spark, sf, EMPTY_FILTERS, fused=True)


def q_dashboard_charts(spark, sf):
    """A14, dict form: every chart reads one frozen grouping-sets result."""
    long = dashboard_long(dashboard(_listings(spark, sf), DASH_FILTERS, CFG, fused=True, freeze=True))
    return long.select("chart", "key", "label", "x", np_round("y", 4).alias("y"))


def _artifacts(spark, sf) -> str:
    """A storage folder: versions of even months have an image, those of every third
    month notes under a hidden name."""
    root = f"{_scratch(spark)}/artifacts"
    v = adapters.registry_records(spark, sf)
    image = F.concat(F.lit("image of "), "version_id", F.lit(" after "), F.col("n_orders").cast("string"), F.lit(" orders"))
    write_artifacts(v.where("pos % 2 = 0").select(F.concat("version_id", F.lit(f"/{SHAP_FILE}")).alias("key"), image.alias("content"))
                    .unionAll(v.where("pos % 3 = 0").select(F.concat("version_id", F.lit("/_notes.json")), F.lit("{}"))), root)
    return root


def q_version_artifacts(spark, sf):
    """What the catalog says of every version's image and notes; hidden names are listed."""
    root = _artifacts(spark, sf)
    versions = adapters.registry_records(spark, sf).select("version_id")
    wanted = versions.select(F.concat("version_id", F.lit(f"/{SHAP_FILE}")).alias("key")).unionAll(
        versions.select(F.concat("version_id", F.lit("/_notes.json"))))
    catalog = artifact_catalog(spark, root)
    return catalog.select("key", F.lit("present").alias("state"), "length").unionAll(
        missing_artifacts(wanted, catalog).select("key", F.lit("missing"), F.lit(None).cast("long")))


def q_artifact_bytes(spark, sf):
    """The bytes of every version's image, read back."""
    found = read_artifacts(spark, _artifacts(spark, sf), SHAP_FILE)
    return found.select("version_id", "length", F.sha2("content", 256).alias("digest"))


def q_missing_listings(spark, sf):
    """A folder with listings beside one without: option lists, and the dashboard's
    number of rows or its error."""
    root = _scratch(spark)
    _listings(spark, sf).write.parquet(f"{root}/{LISTINGS_FILE}")
    out = None
    for name, folder in (("there", root), ("missing", f"{root}/none")):
        options = service.options_of_folder(spark, folder, *CASCADE).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
        board = service.dashboard_of_folder(spark, folder).groupBy("chart").agg(F.count(F.lit(1)).alias("n"))
        rows = options.select(F.lit(name).alias("source"), F.concat(F.lit("options "), "level").alias("part"), "n").unionAll(
            board.select(F.lit(name), F.concat(F.lit("dashboard "), "chart"), "n"))
        out = rows if out is None else out.unionAll(rows)
    return out


def _load_linear(root: str):
    """A loader of linear models that tasks run: it reads ``{root}/{version}/model.json``."""
    def load(version: str):
        return LinearQuantileModel(**json.loads(read_object(f"{root}/{version}/model.json")))
    return load


def q_score_stored_model(spark, sf):
    """Workers load the model from storage; after its file is replaced under the same
    version the new one is used."""
    root = _scratch(spark)
    requests, registry = adapters.requests(spark, sf), spark.createDataFrame([(0, MODEL_VERSION, "2024-01-01")], "pos long, version_id string, date string")
    out = []
    for name, m in (("first", MODEL), ("replaced", MODEL_B)):
        content = json.dumps({"coefficients": m.coefficients, "intercept": m.intercept, "low": m.low, "high": m.high})
        write_artifacts(spark.createDataFrame([(f"{MODEL_VERSION}/model.json", content)], "key string, content string"), root)
        res, _ = score_version(requests, registry, _load_linear(root), keep=["request_id", "line"], method="arrow", nested=False, root=root)
        res.select(F.lit(name).alias("model"), "request_id", "line", "price", "price_min", "price_max").write.parquet(f"{root}/scored_{name}")
        out.append(spark.read.parquet(f"{root}/scored_{name}"))
    return out[0].unionAll(out[1])


def q_score_tagged(spark, sf):
    """Results and rejected rows of one pass over the requests."""
    tagged = score_tagged(adapters.requests(spark, sf), MODEL, MODEL_VERSION, keep=["request_id", "line"])
    return tagged.select("request_id", "line", "outcome", "price", "price_min", "price_max", "margin_percent",
                         F.concat_ws(",", "errors").alias("errors"))


def q_registry_open_schema(spark, sf):
    """V7: extra keys of every JSON type, nested ones too, through the registry file and back."""
    path = f"{_scratch(spark)}/registry"
    r = adapters.registry_records(spark, sf)
    many = F.col("n_orders") > 300
    r.repartitionByRange(4, "pos").sortWithinPartitions("pos").select(
        "version_id", "date", F.struct(F.col("n_orders").alias("orders"), F.array(F.col("revenue"), F.lit(0.5)).alias("sums")).alias("nested"),
        F.when(many, F.lit(True)).otherwise(F.lit(False)).alias("many"), F.when(many, F.col("n_orders")).alias("only_many")).write.json(path)
    extra = F.col("extra")
    got = read_registry(spark, path, lines=True)
    return got.select("pos", "version_id", "date",
                      F.variant_get(extra["nested"], "$.orders", "bigint").alias("n_orders"),
                      F.variant_get(extra["nested"], "$.sums[0]", "double").alias("revenue"),
                      F.variant_get(extra["many"], "$", "boolean").alias("many"), F.schema_of_variant(extra["many"]).alias("many_type"),
                      F.variant_get(extra["only_many"], "$", "bigint").alias("only_many"))


def q_drift_result_nested(spark, sf):
    """The nested result of every feature, written as JSON, read back and laid out in rows."""
    bins = "array<struct<bin:double,ref_density:double,curr_density:double>>"
    doc = f"feature string, drift_detected boolean, p_value double, ks_statistic double, emd_score double, chart_data {bins}, normalized_emd double"
    rows = q_drift_result_json(spark, sf).select("ordinal", F.from_json("json", doc).alias("d"))
    return rows.select("ordinal", "d.feature", "d.drift_detected", "d.p_value", "d.ks_statistic", "d.emd_score", "d.normalized_emd",
                       F.posexplode("d.chart_data").alias("k", "c")).select(
        "ordinal", "feature", "drift_detected", "p_value", "ks_statistic", "emd_score", "normalized_emd", (F.col("k") + 1).alias("bin_index"), "c.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "price_trend_by_year": q_price_trend_by_year,
    "filter_combinations": q_filter_combinations,
    "facet_lists": q_facet_lists,
    "kpi": q_kpi,
    "kpi_empty": q_kpi_empty,
    "box_values": q_box_values,
    "box_summary": q_box_summary,
    "scatter_points": q_scatter_points,
    "fuel_counts": q_fuel_counts,
    "damage_by_part": q_damage_by_part,
    "radar_indicators": q_radar_indicators,
    "radar_series": q_radar_series,
    "radar_series_gated": q_radar_series_gated,
    "dashboard": q_dashboard,
    "dashboard_unfused": q_dashboard_unfused,
    "dashboard_one_brand": q_dashboard_one_brand,
    "cascade_options": q_cascade_options,
    "risk_score": q_risk_score,
    "validate_requests": q_validate_requests,
    "score_requests": q_score_requests,
    "score_requests_arrow": q_score_requests_arrow,
    "registry_newest_first": q_registry_newest_first,
    "latest_version": q_latest_version,
    "drift_report": q_drift_report,
    "drift_report_scaled": q_drift_report_scaled,
    "drift_report_identical": q_drift_report_identical,
    "drift_report_orders": q_drift_report_orders,
    "drift_stats_orders": q_drift_stats_orders,
    "drift_histogram": q_drift_histogram,
    "drift_segment": q_drift_segment,
    "group_cardinality": q_group_cardinality,
    "option_tree": q_option_tree,
    "drift_result_json": q_drift_result_json,
    "score_latest_version": q_score_latest_version,
    "drift_segment_stats": q_drift_segment_stats,
    "listings_round_trip": q_listings_round_trip,
    "version_drift": q_version_drift,
    "registry_json_lines": q_registry_json_lines,
    "registry_json_array": q_registry_json_array,
    "rejected_requests": q_rejected_requests,
    "score_two_models": q_score_two_models,
    "dashboard_empty": q_dashboard_empty,
    "version_artifacts": q_version_artifacts,
    "dashboard_charts": q_dashboard_charts,
    "artifact_bytes": q_artifact_bytes,
    "missing_listings": q_missing_listings,
    "score_stored_model": q_score_stored_model,
    "score_tagged": q_score_tagged,
    "registry_open_schema": q_registry_open_schema,
    "drift_result_nested": q_drift_result_nested,
}


# ---------------------------------------------------------------------------
# DuckDB side
# ---------------------------------------------------------------------------

def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _num(v) -> str:
    return f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))


def filters_sql(f: ListingFilters, include_series: bool = True) -> str:
    """The filter rule as SQL text: None/''/'Tümü' and zero bounds mean no filter."""
    c = ["TRUE"]
    if f.brand and f.brand != "Tümü":
        c.append(f"brand = {_q(f.brand)}")
    if include_series and f.series and f.series != "Tümü":
        c.append(f"series = {_q(f.series)}")
    if f.min_price:
        c.append(f"price >= {_num(f.min_price)}")
    if f.max_price:
        c.append(f"price <= {_num(f.max_price)}")
    if f.min_year:
        c.append(f"kb_year >= {int(f.min_year)}")
    if f.max_year:
        c.append(f"kb_year <= {int(f.max_year)}")
    if f.min_km:
        c.append(f"kb_mileage >= {int(f.min_km)}")
    if f.max_km:
        c.append(f"kb_mileage <= {int(f.max_km)}")
    if f.fuel and f.fuel != "Tümü":
        c.append(f"kb_fuel = {_q(f.fuel)}")
    return " AND ".join(c)


def _with_listings(*ctes: str) -> str:
    parts = [f"listings AS ({adapters.listings_sql()})", *ctes]
    return "WITH " + ", ".join(parts) + " "


def _r(expr: str, n: int = 4) -> str:
    return sql_np_round(expr, n)


def _damage_sql(src: str) -> str:
    rows = []
    for i, (label, stem) in enumerate(DAMAGE_PARTS, start=1):
        rows.append(f"SELECT {i} AS ordinal, {_q(label)} AS part, "
                    f"CAST(SUM(COALESCE({stem}_degisen, 0) + COALESCE({stem}_boyali, 0)) AS BIGINT) AS value "
                    f"FROM {src} HAVING count(*) > 0")
    return " UNION ALL ".join(rows)


_RADAR_COLS = {"price": "price", "mileage": "kb_mileage", "power": "power_hp_val",
               "fuel_consumption": "kb_fuel_cons_avg"}


def _radar_ind_sql(src: str) -> str:
    rows = []
    for i, (name, attr) in enumerate(RADAR_AXES, start=1):
        c = _RADAR_COLS[attr]
        rows.append(f"SELECT {i} AS ordinal, {_q(name)} AS name, "
                    f"CAST(COALESCE(max({c}), 0) AS DOUBLE) * 1.1e0 AS max FROM {src} "
                    f"HAVING count(*) > 0 AND (SELECT count(DISTINCT brand) FROM {src}) <= 5")
    return " UNION ALL ".join(rows)


def _radar_series_sql(src: str) -> str:
    rows = []
    for i, (name, attr) in enumerate(RADAR_AXES, start=1):
        c = _RADAR_COLS[attr]
        rows.append(f"SELECT brand AS \"group\", {i} AS ordinal, {_q(name)} AS name, "
                    f"COALESCE(avg({c}), 0.0e0) AS value FROM {src} "
                    f"WHERE (SELECT count(DISTINCT brand) FROM {src}) <= 5 GROUP BY brand")
    return " UNION ALL ".join(rows)


def _dashboard_sql(f: ListingFilters) -> str:
    pre = _with_listings(f"sel AS (SELECT * FROM listings WHERE {filters_sql(f)})",
                         f"base AS (SELECT * FROM listings WHERE {filters_sql(f, include_series=False)})")
    n = "CAST(NULL AS VARCHAR)"
    d = "CAST(NULL AS DOUBLE)"
    parts = [
        f"SELECT 'brands' AS chart, brand AS key, {n} AS label, {d} AS x, {d} AS y "
        f"FROM (SELECT DISTINCT brand FROM base WHERE brand IS NOT NULL)",
        f"SELECT 'series_list', series, {n}, {d}, {d} FROM (SELECT DISTINCT series FROM base WHERE series IS NOT NULL)",
        f"SELECT 'kpi', 'total', {n}, {d}, CAST(count(*) AS DOUBLE) FROM sel",
        f"SELECT 'kpi', 'avg_price', {n}, {d}, COALESCE(avg(price), 0.0e0) FROM sel",
        f"SELECT 'box', brand, {n}, {d}, price FROM sel WHERE price IS NOT NULL",
        f"SELECT 'scatter', brand, {n}, CAST(kb_mileage AS DOUBLE), price FROM sel "
        f"WHERE kb_mileage IS NOT NULL AND price IS NOT NULL",
        f"SELECT 'trend', CAST(kb_year AS VARCHAR), {n}, CAST(kb_year AS DOUBLE), avg(price) FROM sel "
        f"WHERE kb_year IS NOT NULL GROUP BY kb_year",
        f"SELECT 'fuel', kb_fuel, {n}, {d}, CAST(count(*) AS DOUBLE) FROM sel WHERE kb_fuel IS NOT NULL GROUP BY kb_fuel",
        f"SELECT 'damage', part, {n}, CAST(ordinal AS DOUBLE), CAST(value AS DOUBLE) FROM ({_damage_sql('sel')})",
        f"SELECT 'radar_indicators', name, {n}, CAST(ordinal AS DOUBLE), max FROM ({_radar_ind_sql('sel')})",
        f"SELECT 'radar_series', \"group\", name, CAST(ordinal AS DOUBLE), value FROM ({_radar_series_sql('sel')})",
    ]
    body = " UNION ALL ".join(f"({p})" for p in parts)
    return pre + f"SELECT chart, key, label, x, {_r('y')} AS y FROM ({body})"


def _sel(f: ListingFilters) -> str:
    return _with_listings(f"sel AS (SELECT * FROM listings WHERE {filters_sql(f)})")


def _exact_p_ctes() -> str:
    """Exact two-sample p-value (both samples ≤ 10 000) as a recursive CTE: one
    row per feature and anti-diagonal, the band of path probabilities as a list
    (the same lattice walk as the Pandas UDF, independently written in SQL)."""
    return (
        "prm AS (SELECT ordinal AS fid, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, "
        "CAST(round_even(ks * CAST(n1 AS DOUBLE) * CAST(n2 AS DOUBLE), 0) AS BIGINT) AS dint "
        "FROM st JOIN ord ON st.feature = ord.feature WHERE n1 <= 10000 AND n2 <= 10000), "
        "lat(fid, s, lo, a) AS (SELECT fid, CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(1.0 AS DOUBLE)] "
        "FROM prm WHERE dint > 0 UNION ALL "
        "SELECT fid, s1, nlo, list_transform(range(nlo, nhi + 1), lambda i: "
        "CASE WHEN abs(i * n2 - (s1 - i) * n1) >= dint THEN CAST(0.0 AS DOUBLE) ELSE "
        "(CASE WHEN i >= 1 AND i - 1 >= lo AND i - 1 < lo + len(a) THEN a[i - 1 - lo + 1] * i / s1 ELSE 0.0 END) "
        "+ (CASE WHEN s1 - i >= 1 AND i >= lo AND i < lo + len(a) THEN a[i - lo + 1] * (s1 - i) / s1 ELSE 0.0 END) "
        "END) FROM (SELECT lat.fid, s + 1 AS s1, lo, a, n1, n2, dint, "
        "greatest(0, s + 1 - n2, CAST(floor(((s + 1) * n1 - dint) / (n1 + n2)) AS BIGINT) + 1) AS nlo, "
        "least(n1, s + 1, CAST(floor(((s + 1) * n1 + dint - 1) / (n1 + n2)) AS BIGINT)) AS nhi "
        "FROM lat JOIN prm ON lat.fid = prm.fid WHERE s < n1 + n2)), "
        "ex AS (SELECT lat.fid, least(greatest(1 - (CASE WHEN n1 >= lo AND n1 < lo + len(a) "
        "THEN a[n1 - lo + 1] ELSE 0 END), 0.0), 1.0) AS p_exact "
        "FROM lat JOIN prm ON lat.fid = prm.fid WHERE s = n1 + n2), "
    )


def _drift_sql(ref: str, curr: str, features: list[str], pre: str = "") -> str:
    """KS, EMD, normalised EMD with plain windows; p-value: exact lattice (recursive
    CTE) when both samples ≤ 10 000, else the corrected asymptotic series."""
    longs = []
    for side, (cr, cc) in ((ref, (1, 0)), (curr, (0, 1))):
        for f in features:
            longs.append(f"SELECT {_q(f)} AS feature, CAST({f} AS DOUBLE) AS value, "
                         f"{cr} AS c_ref, {cc} AS c_curr FROM ({side})")
    order = ", ".join(f"({_q(f)}, {i})" for i, f in enumerate(features, start=1))
    small = "n1 <= 10000 AND n2 <= 10000"
    ks_small = (f"CASE WHEN {small} THEN "
                "CAST(round_even(ks * CAST(n1 AS DOUBLE) * CAST(n2 AS DOUBLE), 0) AS BIGINT) "
                "/ (CAST(n1 AS DOUBLE) * CAST(n2 AS DOUBLE)) ELSE ks END")
    nemd = "(CASE WHEN sd > 0 THEN emd / sd WHEN emd > 0 THEN 999.0e0 ELSE 0.0e0 END)"
    p = (f"(CASE WHEN {small} THEN COALESCE(ex.p_exact, 1.0e0) "
         f"ELSE {sql_asymptotic_pvalue('ks', 'n1', 'n2')} END)")
    return (
        "WITH RECURSIVE " + pre + "lng AS (" + " UNION ALL ".join(longs) + "), "
        "fin AS (SELECT * FROM lng WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)), "
        "counts AS (SELECT feature, value, SUM(c_ref) AS c_ref, SUM(c_curr) AS c_curr FROM fin GROUP BY feature, value), "
        "tot AS (SELECT feature, SUM(c_ref) AS n1, SUM(c_curr) AS n2, "
        "SUM(c_ref * value) / SUM(c_ref) AS mean_ref FROM counts GROUP BY feature "
        "HAVING SUM(c_ref) > 0 AND SUM(c_curr) > 0), "
        "cum AS (SELECT c.feature, c.value, c.c_ref, t.n1, t.n2, t.mean_ref, "
        "CAST(SUM(c.c_ref) OVER w AS DOUBLE) / CAST(t.n1 AS DOUBLE) AS f1, "
        "CAST(SUM(c.c_curr) OVER w AS DOUBLE) / CAST(t.n2 AS DOUBLE) AS f2, "
        "LEAD(c.value) OVER (PARTITION BY c.feature ORDER BY c.value) AS nv "
        "FROM counts c JOIN tot t ON c.feature = t.feature "
        "WINDOW w AS (PARTITION BY c.feature ORDER BY c.value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
        "st AS (SELECT feature, n1, n2, max(abs(f1 - f2)) AS ks, "
        "sum(abs(f1 - f2) * COALESCE(nv - value, 0.0e0)) AS emd, "
        "sqrt(sum(c_ref * (value - mean_ref) * (value - mean_ref)) / n1) AS sd "
        "FROM cum GROUP BY feature, n1, n2), "
        f"ord AS (SELECT * FROM (VALUES {order}) o(feature, ordinal)), "
        + _exact_p_ctes() +
        f"rep AS (SELECT o.ordinal, st.feature, {p} AS p, {ks_small} AS ks2, emd, {nemd} AS nemd "
        "FROM st JOIN ord o ON st.feature = o.feature LEFT JOIN ex ON ex.fid = o.ordinal) "
        "SELECT CAST(ordinal AS INTEGER) AS ordinal, feature, (p < 0.05e0 AND nemd > 0.1e0) AS drift_detected, "
        f"{_r('p', 5)} AS p_value, {_r('ks2', 4)} AS ks_statistic, {_r('emd', 2)} AS emd_score, "
        f"{_r('nemd', 3)} AS normalized_emd FROM rep"
    )


def _li_pair_sql(kind: str) -> tuple[str, str]:
    early = "SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'"
    late = "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'"
    if kind == "identical":
        return "SELECT * FROM lineitem", "SELECT * FROM lineitem"
    if kind == "drifted":
        changed = {"l_discount": "l_discount * 0.8e0 AS l_discount"}
    else:
        changed = {"l_extendedprice": "l_extendedprice * 1.03e0 AS l_extendedprice"}
    cols = ", ".join(changed.get(c, c) for c in DRIFT_LI)
    return early, f"SELECT {cols} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'"


def _histogram_sql(ref: str, curr: str, features: list[str], bins: int = 20) -> str:
    longs = []
    for side, (cr, cc) in ((ref, (1, 0)), (curr, (0, 1))):
        for f in features:
            longs.append(f"SELECT {_q(f)} AS feature, CAST({f} AS DOUBLE) AS value, "
                         f"{cr} AS c_ref, {cc} AS c_curr FROM ({side})")
    return (
        "WITH lng AS (" + " UNION ALL ".join(longs) + "), "
        "fin AS (SELECT * FROM lng WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)), "
        "pf AS (SELECT feature, min(value) AS vmin, max(value) AS vmax, SUM(c_ref) AS n1, SUM(c_curr) AS n2 "
        "FROM fin GROUP BY feature HAVING SUM(c_ref) > 0 AND SUM(c_curr) > 0 AND min(value) < max(value)), "
        f"ed AS (SELECT feature, n1, n2, list_concat(list_transform(range(0, {bins}), "
        f"lambda i: CAST(i AS DOUBLE) * ((vmax - vmin) / {float(bins)!r}e0) + vmin), [vmax]) AS edges FROM pf), "
        f"b AS (SELECT f.feature, least({bins}, len(list_filter(ed.edges[1:{bins}], lambda e: e <= f.value))) AS bin_index, "
        "SUM(f.c_ref) AS k1, SUM(f.c_curr) AS k2 FROM fin f JOIN ed ON f.feature = ed.feature GROUP BY 1, 2), "
        f"sp AS (SELECT feature, n1, n2, edges, CAST(unnest(range(1, {bins + 1})) AS INTEGER) AS bin_index FROM ed) "
        f"SELECT sp.feature, sp.bin_index, {_r('(sp.edges[sp.bin_index] + sp.edges[sp.bin_index + 1]) / 2.0e0', 2)} AS bin, "
        "CAST(COALESCE(b.k1, 0) AS DOUBLE) / (sp.edges[sp.bin_index + 1] - sp.edges[sp.bin_index]) / CAST(sp.n1 AS DOUBLE) AS ref_density, "
        "CAST(COALESCE(b.k2, 0) AS DOUBLE) / (sp.edges[sp.bin_index + 1] - sp.edges[sp.bin_index]) / CAST(sp.n2 AS DOUBLE) AS curr_density "
        "FROM sp LEFT JOIN b ON sp.feature = b.feature AND sp.bin_index = b.bin_index"
    )


def _requests_cte() -> str:
    return f"req AS ({adapters.requests_sql()})"


def _defaults_sql() -> str:
    return (
        "SELECT *, COALESCE(d_roof_status, 'Orjinal') AS roof, COALESCE(d_hood_status, 'Orjinal') AS hood, "
        "COALESCE(d_trunk_status, 'Orjinal') AS trunk, COALESCE(d_doors_changed, 0) AS dc, "
        "COALESCE(d_doors_painted, 0) AS dp, COALESCE(d_doors_local, 0) AS dl, "
        "COALESCE(d_fenders_changed, 0) AS fc, COALESCE(d_fenders_painted, 0) AS fp, "
        "COALESCE(d_fenders_local, 0) AS fl FROM req"
    )


def _risk_sql() -> str:
    def st(col, w):
        return (f"(CASE WHEN {col} = 'Değişen' THEN {w[0]}e0 WHEN {col} = 'Boyalı' THEN {w[1]}e0 "
                f"WHEN {col} = 'Lokal Boyalı' THEN {w[2]}e0 ELSE 0.0e0 END)")
    return (f"CAST({st('roof', (150, 75, 40))} + {st('hood', (60, 30, 15))} + {st('trunk', (40, 20, 10))} "
            "+ (dc * 10.0e0 + dp * 5.0e0 + dl * 2.0e0) + (fc * 8.0e0 + fp * 4.0e0 + fl * 2.0e0) AS DOUBLE)")


def _errors_sql() -> list[tuple[str, str]]:
    req = ["brand", "series", "model", "transmission", "fuel", "body_type", "kb_drivetrain",
           "gb_warranty_status", "segment_clean", "year", "mileage", "engine_cc_val", "power_hp_val",
           "torque_nm", "cylinder_count"]
    rules = []
    for c in req:
        rules.append((f"missing:{c}", f"{c} IS NULL"))
        if c == "year":
            rules.append(("range:year", "year <= 1900"))
            rules.append(("range:year", "year > 2100"))
        if c == "mileage":
            rules.append(("range:mileage", "mileage < 0"))
    for fld, col in (("doors_changed", "dc"), ("doors_painted", "dp"), ("doors_local", "dl"),
                     ("fenders_changed", "fc"), ("fenders_painted", "fp"), ("fenders_local", "fl")):
        rules.append((f"range:damage_details.{fld}", f"{col} < 0"))
        rules.append((f"range:damage_details.{fld}", f"{col} > 4"))
    return rules


def _score_sql(version_sql: str | None = None, model: LinearQuantileModel = MODEL) -> str:
    q05, q50, q95 = model.sql()
    version = version_sql or f"'{MODEL_VERSION}'"
    reg = _registry_sql()[len("WITH "):].rstrip() + ", " if version_sql else ""
    feats = (f"SELECT request_id, line, power_hp_val, year, {_risk_sql()} AS expert_risk_score "
             f"FROM dflt WHERE {' AND NOT '.join(['TRUE'] + ['(' + c + ')' for _, c in _errors_sql()])}")
    ok = f"ok AS ({feats})"
    pred = f"pr AS (SELECT *, {q05} AS q05, {q50} AS q50, {q95} AS q95 FROM ok)"
    margin = "(((q95 * 1.02e0) - (q05 * 0.98e0)) / 2.0e0) / NULLIF(q50, 0.0e0) * 100.0e0"
    return (f"WITH {reg}{_requests_cte()}, dflt AS ({_defaults_sql()}), {ok}, {pred} "
            "SELECT request_id, line, CAST(trunc(q50) AS BIGINT) AS price, "
            "CAST(trunc(q05 * 0.98e0) AS BIGINT) AS price_min, CAST(trunc(q95 * 1.02e0) AS BIGINT) AS price_max, "
            f"{_r(margin, 1)} AS margin_percent, {version} AS version, "
            "expert_risk_score AS calculated_risk_score, 'TL' AS currency FROM pr")


def _rejected_sql() -> str:
    """The rules of ``_errors_sql`` with the type rules that the wrong fields of ``rejected_requests`` break."""
    rules = []
    for label, cond in _errors_sql():
        if label == "missing:year":
            label, cond = "type:year", "line = 5"
        elif label == "missing:cylinder_count":
            label, cond = "type:cylinder_count", "line IN (3, 4)"
        elif label == "range:year":
            cond = f"line <> 5 AND {cond}"
        elif label == "range:mileage":
            cond = f"line = 2 OR {cond}"  # NaN
        rules.append(f"CASE WHEN {cond} THEN {_q(label)} END")
    return (f"WITH {_requests_cte()}, dflt AS ({_defaults_sql()}), e AS (SELECT request_id, line, "
            f"list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL) AS errs FROM dflt) "
            "SELECT request_id, line, array_to_string(errs, ',') AS errors FROM e WHERE len(errs) > 0")


def _version_drift_sql() -> str:
    power = ("CASE WHEN power_hp_val % 10 = 3 THEN 'nan'::DOUBLE WHEN power_hp_val % 10 = 4 THEN 'inf'::DOUBLE "
             "ELSE CAST(power_hp_val AS DOUBLE) END AS power_hp_val")
    return _drift_sql(f"SELECT * REPLACE ({power}) FROM listings WHERE kb_year < 1998",
                      f"SELECT * REPLACE ({power}, CAST(NULL AS BIGINT) AS kb_mileage) FROM listings WHERE kb_year >= 1998",
                      DRIFT_DISCOVERED, pre=f"listings AS ({adapters.listings_sql()}), ")


def _registry_sql() -> str:
    return (
        "WITH g AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n_orders, "
        "round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1), "
        "r AS (SELECT CAST(year(m) * 100 + month(m) AS BIGINT) AS pos, 'v' || strftime(m, '%Y%m') AS version_id, "
        "CASE WHEN quarter(m) = 3 THEN NULL ELSE strftime(date_trunc('quarter', m), '%Y-%m-%d') END AS date, "
        "CAST(n_orders AS BIGINT) AS n_orders, revenue FROM g) "
    )


def _box_summary_sql(f: ListingFilters) -> str:
    qs = ", ".join(f"{_r(f'quantile_cont(price, {p})')} AS q{i}" for i, p in
                   enumerate(("0.0e0", "0.25e0", "0.5e0", "0.75e0", "1.0e0")))
    return _sel(f) + (f"SELECT brand AS \"group\", count(*) AS n, {qs} FROM sel "
                      "WHERE price IS NOT NULL GROUP BY brand")


#: The content of a version's image in ``_artifacts``.
_IMAGE = "('image of ' || version_id || ' after ' || CAST(n_orders AS VARCHAR) || ' orders')"


def _tagged_sql() -> str:
    """Every request once: the result's columns where no rule is broken, else the rules."""
    errors = f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {_q(lbl)} END' for lbl, c in _errors_sql())}], lambda x: x IS NOT NULL), ',')"
    return (f"SELECT e.request_id, e.line, CASE WHEN e.errors = '' THEN 'result' ELSE 'rejected' END AS outcome, "
            f"s.price, s.price_min, s.price_max, s.margin_percent, e.errors FROM (WITH {_requests_cte()}, dflt AS ({_defaults_sql()}) "
            f"SELECT request_id, line, {errors} AS errors FROM dflt) e LEFT JOIN ({_score_sql()}) s "
            "ON e.request_id = s.request_id AND e.line = s.line")


def _missing_listings_sql() -> str:
    options = (f"SELECT DISTINCT 'brands' AS level, brand AS value FROM listings WHERE brand IS NOT NULL UNION ALL "
               f"SELECT DISTINCT 'series', series FROM listings WHERE brand = {_q(CASCADE[0])} AND series IS NOT NULL UNION ALL "
               f"SELECT DISTINCT 'models', model FROM listings WHERE brand = {_q(CASCADE[0])} AND series = {_q(CASCADE[1])} AND model IS NOT NULL")
    return (f"SELECT 'there' AS source, 'dashboard ' || chart AS part, count(*) AS n FROM ({_dashboard_sql(ListingFilters())}) GROUP BY chart "
            f"UNION ALL SELECT 'there', 'options ' || level, count(*) FROM ({_with_listings()} {options}) GROUP BY level "
            "UNION ALL SELECT 'missing', 'dashboard error', 1")


def _oracle() -> dict[str, str]:
    fs = []
    for k, f in enumerate(FILTER_SETS, start=1):
        fs.append(f"SELECT {k} AS set_id, count(*) AS n, "
                  f"CAST(SUM(CAST(round_even(price * 100.0e0, 0) AS BIGINT)) AS BIGINT) AS sum_cents "
                  f"FROM listings WHERE {filters_sql(f)}")
    ff = FACET_FILTERS
    drift_li = {k: _drift_sql(*_li_pair_sql(k), DRIFT_LI) for k in ("drifted", "scaled", "identical")}
    o_early = "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'"
    o_late = "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"
    err_rules = _errors_sql()
    err_list = ", ".join(f"CASE WHEN {c} THEN {_q(lbl)} END" for lbl, c in err_rules)
    reg = _registry_sql()
    order = "ORDER BY COALESCE(date, '') DESC, pos ASC"
    json_rows = reg + (f", q AS (SELECT * REPLACE (row_number() OVER (ORDER BY pos) - 1 AS pos) FROM r) "
                       f"SELECT row_number() OVER ({order}) AS rank, pos, version_id, date, n_orders, revenue FROM q")
    return {
        "price_trend_by_year": _with_listings() + (
            f"SELECT kb_year AS key, {_r('avg(price)')} AS avg_value FROM listings "
            "WHERE kb_year IS NOT NULL GROUP BY kb_year"),
        "filter_combinations": _with_listings() + " UNION ALL ".join(fs),
        "facet_lists": _with_listings(f"base AS (SELECT * FROM listings WHERE {filters_sql(ff, False)})") + (
            "SELECT DISTINCT 'brands' AS field, brand AS value FROM base WHERE brand IS NOT NULL UNION ALL "
            "SELECT DISTINCT 'series_list', series FROM base WHERE series IS NOT NULL"),
        "kpi": _sel(KPI_FILTERS) + f"SELECT count(*) AS total, {_r('COALESCE(avg(price), 0.0e0)')} AS avg_price FROM sel",
        "kpi_empty": _sel(EMPTY_FILTERS) + f"SELECT count(*) AS total, {_r('COALESCE(avg(price), 0.0e0)')} AS avg_price FROM sel",
        "box_values": _sel(DASH_FILTERS) + "SELECT brand AS \"group\", price AS value FROM sel WHERE price IS NOT NULL",
        "box_summary": _box_summary_sql(DASH_FILTERS),
        "scatter_points": _sel(DASH_FILTERS) + (
            "SELECT brand AS \"group\", CAST(kb_mileage AS DOUBLE) AS x, price AS y FROM sel "
            "WHERE kb_mileage IS NOT NULL AND price IS NOT NULL"),
        "fuel_counts": _sel(DASH_FILTERS) + (
            "SELECT kb_fuel AS name, count(*) AS value FROM sel WHERE kb_fuel IS NOT NULL GROUP BY kb_fuel"),
        "damage_by_part": _sel(DASH_FILTERS) + _damage_sql("sel"),
        "radar_indicators": _sel(ONE_BRAND) + f"SELECT ordinal, name, {_r('max')} AS max FROM ({_radar_ind_sql('sel')})",
        "radar_series": _sel(ONE_BRAND) + (
            f"SELECT \"group\", ordinal, name, {_r('value')} AS value FROM ({_radar_series_sql('sel')})"),
        "radar_series_gated": _sel(DASH_FILTERS) + (
            f"SELECT \"group\", ordinal, name, {_r('value')} AS value FROM ({_radar_series_sql('sel')})"),
        "dashboard": _dashboard_sql(DASH_FILTERS),
        "dashboard_unfused": _dashboard_sql(DASH_FILTERS),
        "dashboard_one_brand": _dashboard_sql(ONE_BRAND),
        "cascade_options": _with_listings() + (
            "SELECT DISTINCT 'brands' AS level, brand AS value FROM listings WHERE brand IS NOT NULL UNION ALL "
            f"SELECT DISTINCT 'series', series FROM listings WHERE brand = {_q(CASCADE[0])} AND series IS NOT NULL "
            f"UNION ALL SELECT DISTINCT 'models', model FROM listings WHERE brand = {_q(CASCADE[0])} "
            f"AND series = {_q(CASCADE[1])} AND model IS NOT NULL"),
        "risk_score": f"WITH {_requests_cte()}, dflt AS ({_defaults_sql()}) "
                      f"SELECT request_id, line, {_risk_sql()} AS risk_score FROM dflt",
        "validate_requests": f"WITH {_requests_cte()}, dflt AS ({_defaults_sql()}), "
                             f"e AS (SELECT request_id, line, list_filter([{err_list}], lambda x: x IS NOT NULL) AS errs FROM dflt) "
                             "SELECT request_id, line, CAST(len(errs) AS INTEGER) AS n_errors, "
                             "array_to_string(errs, ',') AS errors FROM e",
        "score_requests": _score_sql(),
        "score_requests_arrow": _score_sql(),
        "registry_newest_first": reg + (
            f"SELECT row_number() OVER ({order}) AS rank, pos, version_id, date, n_orders, revenue FROM r"),
        "latest_version": reg + f"SELECT pos, version_id, date FROM r {order} LIMIT 1",
        "listings_round_trip": _with_listings() + (
            f"SELECT 'there' AS source, count(*) AS total, {_r('COALESCE(avg(price), 0.0e0)')} AS avg_price FROM listings "
            "UNION ALL SELECT 'missing', 0, 0.0e0"),
        "version_drift": _version_drift_sql(),
        "registry_json_lines": json_rows,
        "registry_json_array": json_rows,
        "rejected_requests": _rejected_sql(),
        "version_artifacts": reg + (
            f"SELECT version_id || '/{SHAP_FILE}' AS key, CASE WHEN pos % 2 = 0 THEN 'present' ELSE 'missing' END AS state, "
            f"CASE WHEN pos % 2 = 0 THEN CAST(strlen({_IMAGE}) AS BIGINT) END AS length FROM r "
            "UNION ALL SELECT version_id || '/_notes.json', CASE WHEN pos % 3 = 0 THEN 'present' ELSE 'missing' END, "
            "CASE WHEN pos % 3 = 0 THEN 2 END FROM r"),
        "artifact_bytes": reg + (
            f"SELECT version_id, CAST(strlen({_IMAGE}) AS BIGINT) AS length, sha256({_IMAGE}) AS digest FROM r WHERE pos % 2 = 0"),
        "missing_listings": _missing_listings_sql(),
        "score_stored_model": " UNION ALL ".join(
            f"SELECT '{name}' AS model, request_id, line, price, price_min, price_max FROM ({_score_sql(model=m)})"
            for name, m in (("first", MODEL), ("replaced", MODEL_B))),
        "score_tagged": _tagged_sql(),
        "registry_open_schema": reg + (
            "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, version_id, date, n_orders, revenue, n_orders > 300 AS many, "
            "'BOOLEAN' AS many_type, CASE WHEN n_orders > 300 THEN n_orders END AS only_many FROM r"),
        "drift_result_nested": (
            f"SELECT r.*, h.bin_index, h.bin, h.ref_density, h.curr_density FROM ({_drift_sql(o_early, o_late, DRIFT_ORDERS)}) r "
            f"JOIN ({_histogram_sql(o_early, o_late, DRIFT_ORDERS)}) h ON r.feature = h.feature"),
        "dashboard_charts": _dashboard_sql(DASH_FILTERS),
        "score_two_models": " UNION ALL ".join(
            f"SELECT '{name}' AS model, request_id, line, price, price_min, price_max FROM ({_score_sql(model=m)})"
            for name, m in (("a", MODEL), ("b", MODEL_B))),
        "dashboard_empty": _dashboard_sql(EMPTY_FILTERS),
        "group_cardinality": _with_listings() + " UNION ALL ".join(
            f"SELECT {k} AS set_id, count(DISTINCT brand) AS n_groups FROM listings WHERE {filters_sql(f)}"
            for k, f in enumerate(FILTER_SETS, start=1)),
        "option_tree": _with_listings() + (
            "SELECT DISTINCT brand, series, model FROM listings WHERE brand IS NOT NULL"),
        "score_latest_version": _score_sql(version_sql="(SELECT version_id FROM r ORDER BY COALESCE(date, '') "
                                                       "DESC, pos ASC LIMIT 1)"),
        "drift_report": drift_li["drifted"],
        "drift_report_scaled": drift_li["scaled"],
        "drift_report_identical": drift_li["identical"],
        "drift_report_orders": _drift_sql(o_early, o_late, DRIFT_ORDERS),
        "drift_segment": _drift_sql(
            f"SELECT * FROM listings WHERE kb_year < 1998 AND {SEGMENT[0]} = {_q(SEGMENT[1])}",
            f"SELECT * FROM listings WHERE kb_year >= 1998 AND {SEGMENT[0]} = {_q(SEGMENT[1])}",
            DRIFT_LISTINGS, pre=f"listings AS ({adapters.listings_sql()}), "),
        "drift_stats_orders": _drift_stats_sql(o_early, o_late, DRIFT_ORDERS),
        "drift_histogram": _histogram_sql(*_li_pair_sql("drifted"), DRIFT_LI),
        "drift_segment_stats": f"WITH listings AS ({adapters.listings_sql()}), " + _drift_stats_sql(
            f"SELECT * FROM listings WHERE kb_year < 1998 AND {SEGMENT[0]} = {_q(SEGMENT[1])}",
            f"SELECT * FROM listings WHERE kb_year >= 1998 AND {SEGMENT[0]} = {_q(SEGMENT[1])}",
            DRIFT_LISTINGS)[len("WITH "):],
    }


def _drift_stats_sql(ref: str, curr: str, features: list[str]) -> str:
    longs = []
    for side, (cr, cc) in ((ref, (1, 0)), (curr, (0, 1))):
        for f in features:
            longs.append(f"SELECT {_q(f)} AS feature, CAST({f} AS DOUBLE) AS value, "
                         f"{cr} AS c_ref, {cc} AS c_curr FROM ({side})")
    return (
        "WITH lng AS (" + " UNION ALL ".join(longs) + "), "
        "fin AS (SELECT * FROM lng WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)), "
        "counts AS (SELECT feature, value, SUM(c_ref) AS c_ref, SUM(c_curr) AS c_curr FROM fin GROUP BY feature, value), "
        "tot AS (SELECT feature, SUM(c_ref) AS n1, SUM(c_curr) AS n2, SUM(c_ref * value) / SUM(c_ref) AS mean_ref, "
        "min(value) AS vmin, max(value) AS vmax FROM counts GROUP BY feature HAVING SUM(c_ref) > 0 AND SUM(c_curr) > 0), "
        "cum AS (SELECT c.feature, c.value, c.c_ref, t.n1, t.n2, t.mean_ref, t.vmin, t.vmax, "
        "CAST(SUM(c.c_ref) OVER w AS DOUBLE) / CAST(t.n1 AS DOUBLE) AS f1, "
        "CAST(SUM(c.c_curr) OVER w AS DOUBLE) / CAST(t.n2 AS DOUBLE) AS f2, "
        "LEAD(c.value) OVER (PARTITION BY c.feature ORDER BY c.value) AS nv "
        "FROM counts c JOIN tot t ON c.feature = t.feature "
        "WINDOW w AS (PARTITION BY c.feature ORDER BY c.value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
        "SELECT feature, CAST(n1 AS BIGINT) AS n_ref, CAST(n2 AS BIGINT) AS n_curr, "
        f"{_r('max(abs(f1 - f2))', 6)} AS ks, {_r('sum(abs(f1 - f2) * COALESCE(nv - value, 0.0e0))', 2)} AS emd, "
        f"{_r('sqrt(sum(c_ref * (value - mean_ref) * (value - mean_ref)) / n1)', 2)} AS std_ref, vmin, vmax "
        "FROM cum GROUP BY feature, n1, n2, vmin, vmax"
    )


# ---------------------------------------------------------------------------
# Contract
# ---------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the drift report between the early and late orders of sf0.001
    (both samples under 10 000, so the exact p-value branch runs)."""
    return q_drift_report_orders(spark, SMALL_SF)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = dict(QUERIES)
    if _llm is not None:
        out.update(_llm.QUERIES)
        out["pipeline"] = _pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    out = _oracle()
    if _llm is not None:
        out.update(_llm.ORACLE_SQL)
    return out
