"""Scoring requests as they arrive (Structured Streaming).

Validation, risk score, feature assembly and expression models are stateless
projections, and ``mapInPandas`` models are per-batch, so
``operators.scoring.score_tagged`` applies unchanged to a streaming DataFrame. One
query reads the requests once and writes one file sink that is split by
``outcome``; its checkpoint gives exactly-once output of both parts and recovery
after a lost executor or driver restart. The counts of results and rejected rows are
in the query's progress (``observedMetrics["scoring"]``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators.scoring import score_tagged


def read_request_stream(spark: SparkSession, path: str, schema: T.StructType,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def start_scoring(requests: DataFrame, model, version: str, path: str, checkpoint: str,
                  keep: list[str] | None = None, available_now: bool = False, method: str = "auto") -> StreamingQuery:
    """Start one append-mode stream into ``{path}/outcome=result`` and ``{path}/outcome=rejected``."""
    tagged = score_tagged(requests, model, version, keep=keep, method=method, observation="scoring")
    w = (tagged.writeStream.format("parquet").outputMode("append").partitionBy("outcome")
         .option("path", path).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w).start()
