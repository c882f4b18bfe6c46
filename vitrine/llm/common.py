"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import ensure_checkpoint_dir, ship_package

#: Copies of a group's row that a join hands out, so that one group's members spread over so many tasks.
SALTS = 16
#: Bytes at which a batch of texts for a Python worker ends; memory only, no effect on results.
BATCH_BYTES = 1 << 22
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to ``spark.checkpoint.dir`` and go on from the files: later
    reads neither recompute it nor depend on an executor that may be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Python workers import the operator modules."""
    ship_package(spark)


def ship_texts(spark: SparkSession) -> None:
    """As ``ship``; workers get whole texts in batches of ``BATCH_BYTES`` instead of 10,000
    rows or 64 MB, for every task holds several copies of a batch in the executor and in
    its worker. A limit that the session sets itself stays."""
    ship(spark)
    if spark.conf.get(BATCH_LIMIT, None) in (None, "67108864b"):  # Spark's default
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the checkpoint folder that all nodes share."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def with_group(rows: DataFrame, groups: DataFrame, key: str, row_id: Column) -> DataFrame:
    """Left-join ``groups`` (one row per ``key``) to ``rows`` with a salt, so a
    key that holds a third of the rows is spread over ``SALTS`` join tasks.

    Callers pass only groups of two or more members; rows of other keys get nulls.
    """
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int"))
    return left.join(salted, [key, "_salt"], "left").drop("_salt")


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast ``df`` only after counting that it has at most ``limit`` rows;
    beyond that the join is left to shuffle (and to adaptive skew handling)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def utf8_rows(batch, text: int) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column of an Arrow batch."""
    import pyarrow as pa

    for v in batch.column(text).cast(pa.binary()).to_pylist():
        yield v
