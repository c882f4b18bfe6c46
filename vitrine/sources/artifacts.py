"""Per-version artifacts in a storage folder.

Layout: ``{root}/{version_id}/{name}``, e.g. ``v12/model.cbm``,
``v12/shap_summary.png``, ``v12/train_data.parquet``. The catalog lists every object
by ``sources.listing`` (hidden names too) without reading any; contents come from the
``binaryFile`` source.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkAttributeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import ship_package
from vitrine.sources.listing import FORMAT, PrefixListing, file_system
from vitrine.sources.listings import _missing


def _root_uri(spark: SparkSession, root: str) -> str:
    """Qualified form of ``root``, by the cluster's default file system where it names none."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return fs.makeQualified(p).toString().rstrip("/")
    except PySparkAttributeError:  # no JVM gateway (Spark Connect): qualify local paths ourselves
        import os
        return root.rstrip("/") if "://" in root else "file:" + os.path.abspath(root).rstrip("/")


def artifact_catalog(spark: SparkSession, root: str, partitions: int = 64) -> DataFrame:
    """(key, version_id, name, kind, length, modified) for every file under
    ``root``, whatever its name; ``version_id`` is NULL for files directly in ``root``.
    A folder that does not exist has no files."""
    ship_package(spark)
    spark.dataSource.register(PrefixListing)
    files = spark.read.format(FORMAT).option("path", _root_uri(spark, root)).option("partitions", partitions).load()
    name = F.substring_index("key", "/", -1)
    return files.select(
        "key",
        F.when(F.instr("key", "/") > 0, F.substring_index("key", "/", 1)).alias("version_id"),
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"),
        "length", "modified")


def missing_artifacts(wanted: DataFrame, catalog: DataFrame, key: str = "key") -> DataFrame:
    """Wanted keys that do not exist (left anti join on the key)."""
    return wanted.join(catalog.select(F.col("key").alias(key)), key, "left_anti")


def version_fingerprint(spark: SparkSession, root: str, version_id: str) -> str | None:
    """A hash of the names, lengths and times of a version's files; None without any. A
    replaced file changes it. One row reaches the driver."""
    files = artifact_catalog(spark, f"{root.rstrip('/')}/{version_id}", 8)
    each = F.concat_ws("\0", "key", F.col("length").cast("string"), F.unix_micros("modified").cast("string"))
    # a version has a handful of files
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(each)), "\n"), 256).alias("h")).first()
    return row.h if row.n else None


def read_artifact(spark: SparkSession, root: str, version_id: str, name: str) -> DataFrame:
    """(path, length, content) of one artifact; FileNotFoundError if absent."""
    try:
        return (spark.read.format("binaryFile")
                .load(f"{root.rstrip('/')}/{version_id}/{name}")
                .select("path", "length", "content"))
    except AnalysisException as exc:
        if _missing(exc):
            raise FileNotFoundError(f"{version_id}/{name}") from exc
        raise


def read_artifacts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """S4 for every version: (version_id, path, length, content) of the artifacts called
    ``name``, read in parallel; versions without one have no row."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(root)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("version_id"), "path", "length", "content")


def write_artifacts(objects: DataFrame, root: str) -> int:
    """Write ``objects`` (key string, content binary) below ``root``, one object a row, in the
    tasks that hold them; returns their number. A retried task writes the same objects again."""
    spark = objects.sparkSession
    ship_package(spark)
    base = _root_uri(spark, root)

    def run(batches):
        import pyarrow as pa

        fs, folder = file_system(base)
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{folder}/{key}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path, compression=None) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    written = objects.select("key", F.col("content").cast("binary")).mapInArrow(run, "n long")
    return written.agg(F.sum("n")).first()[0] or 0


def read_object(uri: str) -> bytes:
    """The bytes of one object, for model loaders that run in tasks; ``uri`` as the
    workers see it (a path, or with a scheme that pyarrow knows)."""
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()
