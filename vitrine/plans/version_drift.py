"""Drift between the training snapshots of two model versions.

``version_drift`` reads ``{root}/{ref}/train_data.parquet`` and
``{root}/{curr}/train_data.parquet`` (only the numeric columns and the segment
column are scanned), applies the optional segment filter, and returns the
report, the histogram and the nested per-feature result.

The paired counts (D1) are read twice (borders of the range exchange, running
totals); ``DriftJob`` persists them once so the snapshots are shuffled once. Persisted blocks lost with an executor are rebuilt from
lineage: the counts are sums of integers, so a rebuild gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from vitrine.operators.drift import (drift_features, drift_histogram, drift_report, drift_result,
                                     drift_result_json, drift_stats, non_finite_counts, paired_counts)
from vitrine.operators.filters import segment_pair
from vitrine.sources.listings import read_snapshot_pair


@dataclass
class DriftJob:
    ref: DataFrame
    curr: DataFrame
    columns: list[str] | None = None
    method: str = "ranged"
    partitions: int | None = None
    persist: bool = True
    _counts: DataFrame | None = field(default=None, init=False)

    def __post_init__(self):
        self.features = drift_features(self.ref, self.curr, self.columns)
        counts = paired_counts(self.ref, self.curr, self.features)
        self._counts = counts.persist(StorageLevel.MEMORY_AND_DISK) if self.persist else counts
        self._stats = drift_stats(self.ref, self.curr, self.features, self.method, self.partitions,
                                  counts=self._counts)

    def report(self) -> DataFrame:
        return drift_report(self.ref, self.curr, self.features, stats=self._stats)

    def histogram(self) -> DataFrame:
        return drift_histogram(self.ref, self.curr, features=self.features)

    def result(self) -> DataFrame:
        return drift_result(self.report(), self.histogram())

    def dropped(self) -> DataFrame:
        """Per feature and side, the NaN and ±Inf values left out."""
        return non_finite_counts(self.ref, self.curr, self.features)

    def result_json(self) -> DataFrame:
        return drift_result_json(self.result())

    def close(self):
        if self.persist and self._counts is not None:
            self._counts.unpersist()


def version_drift(spark: SparkSession, root: str, ref_version: str, curr_version: str,
                  segment_value=None, segment_col: str = "brand",
                  columns: list[str] | None = None, **kw) -> DriftJob:
    """S2 → F11 → F14 → D1–D8. Raises FileNotFoundError for a missing snapshot or
    an empty segment."""
    ref, curr = read_snapshot_pair(spark, root, ref_version, curr_version)
    if segment_value:
        ref, curr = segment_pair(ref, curr, segment_col, segment_value)
    return DriftJob(ref, curr, columns, **kw)
