"""Scoring against a version from the registry (P6 with K2).

``score_version`` scores a request table with the model of ``version``, or of
the newest registry entry when no version is given. Only the chosen version id
(one row) reaches the driver, to load the model; the scoring itself is the
distributed ``operators.scoring.score``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from vitrine.operators.scoring import cached_model, score
from vitrine.sources.artifacts import version_fingerprint
from vitrine.sources.registry import latest_version


def resolve_version(records: DataFrame, version: str | None = None) -> str:
    """The requested version if it is registered, else the newest one."""
    if version is not None:
        if records.where(records.version_id == version).isEmpty():
            raise FileNotFoundError(f"version not in registry: {version}")
        return version
    row = latest_version(records).select("version_id").first()
    if row is None:
        raise FileNotFoundError("registry is empty")
    return row.version_id


def score_version(requests: DataFrame, records: DataFrame, loader: Callable[[str], object],
                  version: str | None = None, keep: list[str] | None = None, method: str = "auto",
                  nested: bool = True, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """→ (results, rejected) scored with the chosen version's model. ``root`` names the
    storage that ``loader`` reads: versions of different roots are different models, and
    a version whose files were replaced is loaded anew (its fingerprint is taken here)."""
    v = resolve_version(records, version)
    mark = version_fingerprint(requests.sparkSession, root, v) if root is not None else None
    model = cached_model(v, loader, root, mark)
    return score(requests, model, v, keep=keep, method=method, nested=nested, loader=loader, root=root, fingerprint=mark)
