"""The six jobs a client of the listing service runs, as Spark calls.

Each function takes the storage ``root`` (a folder with ``car_listings.parquet``,
``registry.json`` and ``{version}/...`` artifacts) or a listings DataFrame, and
returns DataFrames; nothing is collected. Web serving is out of scope.

| job                         | function                |
| --------------------------- | ----------------------- |
| list model versions         | ``get_versions``        |
| SHAP summary image          | ``get_shap_plot``       |
| price a batch of cars       | ``predict_price``       |
| drift between two versions  | ``get_drift_data``      |
| dashboard bundle            | ``get_dashboard_data``  |
| cascading dropdown options  | ``get_dropdown_options``|
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.config import LISTINGS_FILE, REGISTRY_FILE, SHAP_FILE, ListingConfig
from vitrine.operators.filters import ListingFilters
from vitrine.operators.options import cascade_options
from vitrine.plans.dashboard import dashboard, dashboard_table
from vitrine.plans.scoring_job import score_version
from vitrine.plans.version_drift import DriftJob, version_drift
from vitrine.sources.artifacts import read_artifact
from vitrine.sources.listings import read_listings
from vitrine.sources.registry import read_registry, registry_newest_first


def listings(spark: SparkSession, root: str, on_missing: str = "error", cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """The listings of a storage folder; where there are none an error, or with
    ``on_missing='empty'`` a table without rows."""
    return read_listings(spark, f"{root.rstrip('/')}/{LISTINGS_FILE}", on_missing=on_missing, cfg=cfg)


def get_versions(spark: SparkSession, root: str) -> DataFrame:
    """Registry entries with their newest-first ``rank``; none where there is no registry."""
    return registry_newest_first(read_registry(spark, f"{root.rstrip('/')}/{REGISTRY_FILE}", on_missing="empty"))


def get_shap_plot(spark: SparkSession, root: str, version_id: str) -> DataFrame:
    """(path, length, content) of the version's SHAP image; FileNotFoundError if absent."""
    return read_artifact(spark, root, version_id, SHAP_FILE)


def predict_price(spark: SparkSession, root: str, requests: DataFrame, loader: Callable[[str], object],
                  version_id: str | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, rejected) for a table of requests; newest version when none is named."""
    records = read_registry(spark, f"{root.rstrip('/')}/{REGISTRY_FILE}")
    return score_version(requests, records, loader, version=version_id, keep=keep, nested=True,
                         root=root.rstrip("/"))


def get_drift_data(spark: SparkSession, root: str, ref_ver: str, curr_ver: str,
                   brand: str | None = None, **kw) -> DriftJob:
    """Drift job between two versions' training snapshots (``.result()`` for the
    nested per-feature records, ``.report()``/``.histogram()`` for flat tables;
    ``.close()`` releases the cached counts)."""
    return version_drift(spark, root, ref_ver, curr_ver, segment_value=brand, **kw)


def get_dashboard_data(df: DataFrame, brand=None, series=None, min_price=None, max_price=None,
                       min_year=None, max_year=None, min_km=None, max_km=None, fuel=None,
                       cfg: ListingConfig = ListingConfig(), as_table: bool = True):
    """The dashboard for the given optional filters: one long table (default) or
    a dict of one DataFrame per chart."""
    f = ListingFilters(brand, series, min_price, max_price, min_year, max_year, min_km, max_km, fuel)
    return dashboard_table(df, f, cfg, fused=True) if as_table else dashboard(df, f, cfg, fused=True)


def get_dropdown_options(df: DataFrame, brand: str | None = None, series: str | None = None,
                         cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """(level, value) rows: all brands; series of ``brand``; models of both."""
    return cascade_options(df, brand, series, cfg)


def dashboard_of_folder(spark: SparkSession, root: str, cfg: ListingConfig = ListingConfig(), **filters) -> DataFrame:
    """The long dashboard table of a storage folder; where it has no listings, one
    ``error`` row that names what is missing (S7). ``filters`` as for ``get_dashboard_data``."""
    try:
        return get_dashboard_data(listings(spark, root, cfg=cfg), cfg=cfg, **filters)
    except FileNotFoundError:
        none = F.lit(None)
        return spark.range(1).select(
            F.lit("error").alias("chart"), F.lit("not_found").alias("key"), F.lit(LISTINGS_FILE).alias("label"),
            none.cast("double").alias("x"), none.cast("double").alias("y"))


def options_of_folder(spark: SparkSession, root: str, brand: str | None = None, series: str | None = None,
                      cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """The option lists of a storage folder; none where it has no listings."""
    return get_dropdown_options(listings(spark, root, on_missing="empty", cfg=cfg), brand, series, cfg)
