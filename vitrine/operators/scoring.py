"""Batch scoring with versioned multi-quantile models.

A model is anything with ``feature_names`` and ``predict(pandas_frame) -> n×3``
(q05, q50, q95). Models that can also express themselves as Columns
(``as_columns``) run fully JVM-side; others run in ``mapInPandas`` — Arrow
batches, the model loaded once per Python worker and version (P4).
"""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.config import CURRENCY, DamageRules
from vitrine.functions.scalars import np_round, risk_score, truncate_to_long, widen_band
from vitrine.operators.validate import split_valid, validate
from vitrine.session import ship_package

# The features in the order the scoring record lists them.
FEATURES = (
    ("brand", "string"), ("series", "string"), ("model", "string"),
    ("engine_cc_val", "double"), ("power_hp_val", "double"),
    ("kb_drivetrain", "string"), ("gb_warranty_status", "string"),
    ("torque_nm", "double"), ("cylinder_count", "int"), ("is_heavy_damaged", "int"),
    ("year", "int"), ("mileage", "double"), ("transmission", "string"), ("fuel", "string"),
    ("body_type", "string"), ("segment_clean", "string"), ("expert_risk_score", "double"),
)
CATEGORICAL = tuple(name for name, typ in FEATURES if typ == "string")


def assemble_features(df: DataFrame, keep: list[str] | None = None,
                      rules: DamageRules = DamageRules()) -> DataFrame:
    """The 17 model features, ``expert_risk_score`` computed by E3."""
    cols = []
    for name, typ in FEATURES:
        if name == "expert_risk_score":
            cols.append(risk_score(F.col("damage_details"), rules).alias(name))
        else:
            cols.append(F.col(name).cast(typ).alias(name))
    return df.select(*(keep or []), *cols)


def conform_to_model(df: DataFrame, feature_names: list[str], keep: list[str] | None = None) -> DataFrame:
    """The model's features in its order, categorical ones as strings."""
    missing = [n for n in feature_names if n not in df.columns]
    if missing:
        raise KeyError(f"model features not in frame: {missing}")
    return df.select(*(keep or []), *[F.col(n).cast("string").alias(n) if n in CATEGORICAL else F.col(n)
                                      for n in feature_names])


class LinearQuantileModel:
    """A deterministic expression model: q50 = intercept + Σ coef·feature (left to
    right), q05 = low·q50, q95 = high·q50."""

    def __init__(self, coefficients: dict[str, float], intercept: float = 0.0,
                 low: float = 0.9, high: float = 1.1):
        self.coefficients = dict(coefficients)
        self.intercept = float(intercept)
        self.low, self.high = float(low), float(high)
        self.feature_names = list(self.coefficients)

    def as_columns(self) -> tuple[Column, Column, Column]:
        q50 = F.lit(self.intercept)
        for name, c in self.coefficients.items():
            q50 = q50 + F.lit(float(c)) * F.col(name).cast("double")
        return q50 * F.lit(self.low), q50, q50 * F.lit(self.high)

    def predict(self, pdf: pd.DataFrame) -> np.ndarray:
        q50 = np.full(len(pdf), self.intercept)
        for name, c in self.coefficients.items():
            q50 = q50 + float(c) * pdf[name].astype("float64").to_numpy()
        return np.column_stack([q50 * self.low, q50, q50 * self.high])

    def sql(self) -> tuple[str, str, str]:
        """The same arithmetic as SQL text (oracle)."""
        q50 = f"{self.intercept!r}e0" if "e" not in repr(self.intercept) else repr(self.intercept)
        for name, c in self.coefficients.items():
            q50 = f"({q50} + {float(c)!r} * CAST({name} AS DOUBLE))"
        return f"({q50} * {self.low!r})", q50, f"({q50} * {self.high!r})"


# Models per Python process, the most recently used last.
_MODEL_CACHE: OrderedDict[tuple[str, str, str], object] = OrderedDict()
#: Models that a process keeps.
MAX_MODELS = 8


def cached_model(version: str, loader: Callable[[str], object], root: str | None = None, fingerprint: str | None = None):
    """The model of ``version`` under ``root`` whose files have this ``fingerprint``
    (``sources.artifacts.version_fingerprint``), loaded once per process. A replaced file
    has another fingerprint: the model is loaded anew and the old one dropped. Beyond
    ``MAX_MODELS`` the least recently used goes. Without a root or a fingerprint nothing
    tells a replaced model from the old one, so it is loaded each time."""
    if root is None or fingerprint is None:
        return loader(version)
    key = (root, version, fingerprint)
    if key not in _MODEL_CACHE:
        model = loader(version)
        for old in [k for k in _MODEL_CACHE if k[:2] == key[:2]]:
            del _MODEL_CACHE[old]
        _MODEL_CACHE[key] = model
        while len(_MODEL_CACHE) > MAX_MODELS:
            _MODEL_CACHE.popitem(last=False)
    _MODEL_CACHE.move_to_end(key)
    return _MODEL_CACHE[key]


def score_quantiles(df: DataFrame, model, version: str, method: str = "auto",
                    loader: Callable[[str], object] | None = None, root: str | None = None,
                    fingerprint: str | None = None, only: str | None = None) -> DataFrame:
    """Add q05, q50, q95 (double). ``method``: 'expr' (Columns), 'arrow'
    (``mapInPandas``) or 'auto' (Columns when the model offers them). With ``loader``,
    ``root`` and ``fingerprint`` the workers load the model themselves, once each;
    a model passed as an object travels with the task and is never cached. ``only``
    names a boolean column: other rows get NULLs and are not shown to the model."""
    if method == "auto":
        method = "expr" if hasattr(model, "as_columns") else "arrow"
    if method == "expr":
        q = [c if only is None else F.when(F.col(only), c) for c in model.as_columns()]
        return df.select("*", *[c.alias(name) for c, name in zip(q, ("q05", "q50", "q95"))])
    ship_package(df.sparkSession)
    feature_names = list(model.feature_names)
    out_schema = T.StructType(df.schema.fields + [T.StructField(q, T.DoubleType(), True)
                                                  for q in ("q05", "q50", "q95")])
    load = loader or (lambda _v, _m=model: _m)
    where = root if loader is not None else None

    def predict_batches(batches):
        m = cached_model(version, load, where, fingerprint)
        for pdf in batches:
            shown = pdf if only is None else pdf[pdf[only].to_numpy(dtype=bool)]
            pred = np.full((len(pdf), 3), np.nan)
            if len(shown):
                rows = slice(None) if only is None else pdf[only].to_numpy(dtype=bool)
                pred[rows] = np.asarray(m.predict(shown[feature_names]), dtype="float64").reshape(len(shown), 3)
            yield pdf.assign(q05=pred[:, 0], q50=pred[:, 1], q95=pred[:, 2])

    return df.mapInPandas(predict_batches, out_schema)


def price_result(df: DataFrame, version: str, keep: list[str] | None = None,
                 nested: bool = False) -> DataFrame:
    """P5: the result record: price (trunc q50), band (trunc q05·0.98, q95·1.02),
    margin % (rounded to 1 place, NumPy rule; NULL when q50 = 0), version, score,
    currency. A prediction that is NULL, NaN or too large for a price gives NULL
    prices in its row instead of ending the job."""
    # one guard for all outputs: the three predictions in a struct that is NULL where one is
    # unusable (NaN fails the comparison); it is used more than once, so it stays a projection of its own
    usable = reduce(Column.__and__, [F.abs(F.col(q)) < F.lit(9e18) for q in ("q05", "q50", "q95")])
    guarded = F.when(usable, F.struct("q05", "q50", "q95")).alias("_q")
    df = df.select(*(keep or []), "expert_risk_score", guarded)
    lo, hi, margin = widen_band(F.col("_q.q05"), F.col("_q.q50"), F.col("_q.q95"))
    price = truncate_to_long(F.col("_q.q50")).alias("price")
    pmin, pmax = truncate_to_long(lo), truncate_to_long(hi)
    mp = np_round(margin, 1)
    common = [F.lit(version).alias("version"),
              F.col("expert_risk_score").alias("calculated_risk_score"),
              F.lit(CURRENCY).alias("currency")]
    if nested:
        band = F.struct(pmin.alias("min"), pmax.alias("max"), mp.alias("margin_percent"))
        return df.select(*(keep or []), price, band.alias("price_range"), *common)
    return df.select(*(keep or []), price, pmin.alias("price_min"), pmax.alias("price_max"),
                     mp.alias("margin_percent"), *common)


def _conformed(checked: DataFrame, model, keep: list[str], rules: DamageRules) -> DataFrame:
    """P1 → P2 of validated rows; the risk score is kept beside the model's features."""
    more = [] if "expert_risk_score" in model.feature_names else ["expert_risk_score"]
    return conform_to_model(assemble_features(checked, keep=keep, rules=rules), model.feature_names, keep=[*keep, *more])


def score(requests: DataFrame, model, version: str, keep: list[str] | None = None,
          method: str = "auto", nested: bool = False, rules: DamageRules = DamageRules(),
          loader: Callable[[str], object] | None = None, root: str | None = None,
          fingerprint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate → split → assemble → conform → predict → result.

    Returns (results, rejected); rejected rows carry their ``errors``. Each of the two
    reads the requests; ``score_tagged`` gives both from one pass.
    """
    keep = keep or []
    ok, rejected = split_valid(validate(requests, keep=keep))
    scored = score_quantiles(_conformed(ok, model, keep, rules), model, version, method, loader, root, fingerprint)
    return price_result(scored, version, keep=keep, nested=nested), rejected


#: Values of ``outcome``: a priced request, a rejected one.
RESULT, REJECTED = "result", "rejected"


def score_tagged(requests: DataFrame, model, version: str, keep: list[str] | None = None,
                 method: str = "auto", nested: bool = False, rules: DamageRules = DamageRules(),
                 loader: Callable[[str], object] | None = None, root: str | None = None,
                 fingerprint: str | None = None, observation=None) -> DataFrame:
    """P6 in one pass over the requests, also of a stream: every row of ``requests`` once,
    with its ``outcome`` ('result' or 'rejected'), the result's columns (NULL for rejected
    rows, which the model does not see) and ``errors`` (empty for results). Written with
    ``partitionBy("outcome")`` it is split at write time.

    ``observation`` (an ``Observation``, or a name for a stream's progress) counts
    ``n_result`` and ``n_rejected`` while the rows pass by."""
    keep = keep or []
    checked = validate(requests, keep=keep)
    scored = score_quantiles(_conformed(checked, model, [*keep, "valid", "errors"], rules), model, version, method,
                             loader, root, fingerprint, only="valid")
    rows = price_result(scored, version, keep=[*keep, "valid", "errors"], nested=nested)
    outcome = F.when(F.col("valid"), F.lit(RESULT)).otherwise(F.lit(REJECTED))
    shown = [c for c in rows.columns if c not in (*keep, "valid", "errors")]
    tagged = rows.select(*keep, outcome.alias("outcome"), *[F.when(F.col("valid"), F.col(c)).alias(c) for c in shown], "errors")
    if observation is None:
        return tagged
    n = F.count_if(F.col("outcome") == RESULT).alias("n_result"), F.count_if(F.col("outcome") == REJECTED).alias("n_rejected")
    return tagged.observe(observation, *n)
