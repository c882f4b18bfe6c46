"""Model version registry (S3, K1, K2, V7).

The registry is a JSON array of objects with a required ``version_id``, an
optional ISO ``date`` and any other keys. It is read as one document
(``wholetext``) and exploded with its position, so source order survives for
stable tie-breaking; keys other than ``version_id``/``date`` are kept in ``extra``, a
map of VARIANT values: numbers, booleans, lists and nested objects keep their types.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.ranking import global_rank
from vitrine.sources.listings import _missing


ENTRY = "map<string,variant>"
SCHEMA = f"pos long, version_id string, date string, extra {ENTRY}"


def read_registry(spark: SparkSession, path: str, lines: bool = False, on_missing: str = "error") -> DataFrame:
    """→ (pos, version_id, date, extra map<string,variant>).

    A registry file is one JSON array, read as one document (one task; a model
    registry is small). ``lines=True`` reads JSON Lines in parallel instead: ``pos``
    is then the rank in order of file path, offset in the file and line (Spark packs
    large files first, so a row's id alone does not follow the files).
    ``on_missing="empty"`` gives an empty registry where there is no file.
    """
    try:
        return _read_registry(spark, path, lines)
    except AnalysisException as exc:
        if on_missing == "empty" and _missing(exc):
            return spark.createDataFrame([], SCHEMA)
        raise


def _fields(entry: str) -> list[Column]:
    """version_id, date and the other keys of an entry."""
    e = F.col(entry)
    return [F.variant_get(e["version_id"], "$", "string").alias("version_id"), F.variant_get(e["date"], "$", "string").alias("date"),
            F.map_filter(e, lambda k, _v: ~k.isin("version_id", "date")).alias("extra")]


def _read_registry(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    if lines:
        # lines are parsed one by one: no pass over the file to find a schema
        rows = spark.read.text(path).where(F.trim("value") != "").select(
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"), F.from_json("value", ENTRY).alias("m"))
        ranked = global_rank(rows.select("_file", "_start", "_line", *_fields("m")), [F.col(c) for c in ("_file", "_start", "_line")],
                             rank_col="pos")
        return ranked.select((F.col("pos") - 1).alias("pos"), "version_id", "date", "extra")
    doc = spark.read.text(path, wholetext=True)
    entries = doc.select(F.posexplode(F.from_json("value", f"array<{ENTRY}>")).alias("pos", "m"))
    return entries.select(F.col("pos").cast("bigint").alias("pos"), *_fields("m"))


def newest_first_order() -> list[Column]:
    """K1: text date descending, a missing (or NULL) date as "" (last), then
    source position (stable)."""
    return [F.coalesce(F.col("date"), F.lit("")).desc(), F.col("pos").asc()]


def registry_newest_first(records: DataFrame) -> DataFrame:
    """K1: records with a 1-based ``rank`` in newest-first order."""
    return global_rank(records, newest_first_order())


def latest_version(records: DataFrame) -> DataFrame:
    """K2: the first record in newest-first order (a distributed top-1)."""
    return records.orderBy(*newest_first_order()).limit(1)
