"""Sources: listings table, versioned snapshots, missing-source policy."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vitrine.config import SNAPSHOT_FILE, ListingConfig


def _missing(exc: AnalysisException) -> bool:
    cond = getattr(exc, "getCondition", None)
    cond = cond() if cond else getattr(exc, "getErrorClass", lambda: None)()
    return cond == "PATH_NOT_FOUND" or "Path does not exist" in str(exc)


def read_parquet(spark: SparkSession, path: str, on_missing: str = "error",
                 schema: T.StructType | str | None = None) -> DataFrame:
    """Read a parquet path; ``on_missing='empty'`` returns an empty frame of ``schema``,
    which it then needs: a frame without columns would fail in the first chart.

    Column pruning and filter pushdown happen in the scan once the caller
    selects and filters; nothing here reads data.
    """
    if on_missing not in ("error", "empty") or (on_missing == "empty" and not schema):
        raise ValueError("on_missing is 'error', or 'empty' with a schema")
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if on_missing == "empty" and _missing(exc):
            return spark.createDataFrame([], schema)
        if _missing(exc):
            raise FileNotFoundError(f"not found: {path}") from exc
        raise


def read_listings(spark: SparkSession, path: str, on_missing: str = "error",
                  schema: T.StructType | str | None = None, cfg: ListingConfig = ListingConfig()) -> DataFrame:
    """The listings fact table; with ``on_missing='empty'`` a table that is not
    there has the columns of ``cfg`` (or ``schema``) and no rows."""
    return read_parquet(spark, path, on_missing=on_missing, schema=schema or cfg.schema())


def snapshot_path(root: str, version: str, name: str = SNAPSHOT_FILE) -> str:
    return f"{root.rstrip('/')}/{version}/{name}"


def read_snapshot(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The training snapshot of one model version; missing → FileNotFoundError."""
    return read_parquet(spark, snapshot_path(root, version))


def read_snapshot_pair(spark: SparkSession, root: str, ref_version: str,
                       curr_version: str) -> tuple[DataFrame, DataFrame]:
    return read_snapshot(spark, root, ref_version), read_snapshot(spark, root, curr_version)
