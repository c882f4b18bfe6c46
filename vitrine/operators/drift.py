"""Two-sample drift report over every numeric column.

Plan (all features at once, no per-feature job):

* D1 ``paired_counts``: both samples unpivoted to (feature, value), non-finite
  values dropped, one aggregation to (feature, value, c_ref, c_curr). Map-side
  partial aggregation collapses repeated values before the shuffle, so a value
  holding a third of the rows costs one row per task.
* D2/D4/A17: the counts dealt into ranges of (feature, value) and read in order
  (``prefix.range_scan``), so that no feature sits in one task. Per distinct value:
  F1 = cum_ref/n1, F2 = cum_curr/n2; KS = max|F1−F2|; EMD = Σ |F1−F2|·(next value −
  value); population std of the reference Σ c·(v−mean)². A partition hands on one
  row per feature.
* D3: p-value per feature (``functions.ks``), on a table of one row per feature.
* D6: 20 equal-width bins on the pooled min/max. Both passes read the columns side by
  side, in Arrow batches, and hand on one row per feature, or feature and bin, of a
  task; nothing is unpivoted.

Reports are plans: building one runs no job. Only the histogram reads the extremes
(a row per feature and side) while it is built.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.config import (DRIFT_CONSTANT_SENTINEL, DRIFT_EMD_THRESHOLD, DRIFT_P_THRESHOLD,
                            HISTOGRAM_BINS, KS_EXACT_MAX_N)
from vitrine.functions.ks import ks_pvalue
from vitrine.functions.scalars import linspace_edges, np_round, safe_ratio
from vitrine.operators.filters import finite, numeric_features, qcol, segment_pair
from vitrine.operators.prefix import Segments, default_partitions, range_scan, running_totals_simple, sample_rate
from vitrine.session import ship_package


def drift_features(ref: DataFrame, curr: DataFrame, columns: list[str] | None = None,
                   first: str = "price") -> list[str]:
    """F14 on the reference schema; a reference column missing from the current
    frame is an error (current-only columns are ignored)."""
    names = numeric_features(ref, first=first, columns=columns)
    missing = [c for c in names if c not in curr.columns]
    if missing:
        raise KeyError(f"columns of the reference snapshot missing from the current one: {missing}")
    return names


def _long(df: DataFrame, features: list[str], c_ref: int, c_curr: int) -> DataFrame:
    # features travel as their 1-based report position (an int), not their name:
    # the shuffles below carry every distinct value, so every byte per row counts
    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    pairs = ", ".join(f"named_struct('fid', {i + 1}, 'value', cast({quoted(f)} as double))" for i, f in enumerate(features))
    return (df.select(F.expr(f"inline(array({pairs}))"))
            .where(finite(F.col("value")))
            .select("fid", "value", F.lit(c_ref).cast("long").alias("c_ref"),
                    F.lit(c_curr).cast("long").alias("c_curr")))


def paired_long(ref: DataFrame, curr: DataFrame, features: list[str]) -> DataFrame:
    """Both samples as (fid, value, c_ref, c_curr) raw rows, finite values only;
    ``fid`` is the feature's 1-based position in ``features``."""
    return _long(ref, features, 1, 0).unionByName(_long(curr, features, 0, 1))


def non_finite_counts(ref: DataFrame, curr: DataFrame, features: list[str]) -> DataFrame:
    """(feature, side, n_nan, n_inf): values dropped before the statistics (NaN as
    NULL does; ±Inf would break the pooled bin edges). One partial aggregation
    per side, all features at once."""
    spark = ref.sparkSession
    out = None
    for side, df in (("ref", ref), ("curr", curr)):
        aggs = []
        for i, f in enumerate(features):
            v = qcol(f).cast("double")
            aggs += [F.count_if(F.isnan(v)).alias(f"nan{i}"), F.count_if(F.abs(v) == F.lit(float("inf"))).alias(f"inf{i}")]
        wide = df.agg(*aggs).select(F.inline(F.array(*[
            F.struct(F.lit(i + 1).alias("fid"), F.lit(side).alias("side"), F.col(f"nan{i}").alias("n_nan"),
                     F.col(f"inf{i}").alias("n_inf")) for i in range(len(features))])))
        out = wide if out is None else out.unionByName(wide)
    return out.join(feature_names(spark, features), "fid").select("feature", "side", "n_nan", "n_inf")


def paired_counts(ref: DataFrame, curr: DataFrame, features: list[str]) -> DataFrame:
    """(fid, value, c_ref, c_curr), one row per distinct finite value."""
    return paired_long(ref, curr, features).groupBy("fid", "value").agg(
        F.sum("c_ref").alias("c_ref"), F.sum("c_curr").alias("c_curr"))


def feature_names(spark: SparkSession, features: list[str]) -> DataFrame:
    """(fid, feature): report order (price first, then schema order); one row per
    feature, broadcast wherever names are attached."""
    return F.broadcast(spark.createDataFrame([(i + 1, f) for i, f in enumerate(features)],
                                             "fid int, feature string"))


@dataclass
class DriftStats:
    """Unrounded per-feature statistics (one row per feature) and the counts."""

    stats: DataFrame
    counts: DataFrame
    features: list[str]


_STATS = ("fid int, ks double, emd double, ss_ref double, n_ref long, n_curr long, vmin double, vmax double, "
          "own long")


def _fold_stats(s: Segments) -> dict:
    """Per segment of a partition: its largest gap, its share of the EMD and of the
    reference's squared deviations."""
    out: dict[str, list] = {name.split()[0]: [] for name in _STATS.split(", ")}
    for k, (a, b) in enumerate(zip(s.start, s.stop)):
        n_ref, n_curr = int(s.total["c_ref"][k]), int(s.total["c_curr"][k])
        v, c_ref = s.value[a:b], s.weight["c_ref"][a:b]
        out["fid"].append(s.parts[int(a)].as_py())
        out["n_ref"].append(n_ref)
        out["n_curr"].append(n_curr)
        out["own"].append(int(s.own["c_ref"][k] + s.own["c_curr"][k]))
        out["vmin"].append(v[0])
        out["vmax"].append(v[-1])
        if not n_ref or not n_curr:
            for name in ("ks", "emd", "ss_ref"):
                out[name].append(0.0)
            continue
        gap = np.abs((s.before["c_ref"][k] + np.cumsum(c_ref)) / n_ref
                     - (s.before["c_curr"][k] + np.cumsum(s.weight["c_curr"][a:b])) / n_curr)
        after = s.next_value[k]
        step = np.diff(v, append=v[-1] if math.isnan(after) else after)
        dev = v - s.total["s_ref"][k] / n_ref
        out["ks"].append(gap.max())
        out["emd"].append(float(np.sum(gap * step)))
        out["ss_ref"].append(float(np.sum(c_ref * dev * dev)))
    return out


def _sampled_rows(ref: DataFrame, curr: DataFrame, features: list[str], partitions: int) -> DataFrame:
    """(fid, value) of some rows, told by a hash of the whole row: only these are unpivoted."""
    n = ref.select(F.count(F.lit(1))).scalar() + curr.select(F.count(F.lit(1))).scalar()
    some = F.pmod(F.xxhash64(*[qcol(f) for f in features]), sample_rate(n, partitions)) == 0
    return paired_long(ref.where(some), curr.where(some), features).select("fid", "value")


def _ranged_stats(counts: DataFrame, partitions: int, sample: DataFrame) -> DataFrame:
    weighted = counts.withColumn("s_ref", F.col("c_ref") * F.col("value"))
    parts = range_scan(weighted, "fid", "value", ["c_ref", "c_curr", "s_ref"], _fold_stats,
                       T.StructType.fromDDL(_STATS), partitions, sample)
    g = parts.groupBy("fid").agg(
        F.max("ks").alias("ks"), F.sum("emd").alias("emd"), F.sum("ss_ref").alias("ss_ref"), F.max("n_ref").alias("n_ref"),
        F.max("n_curr").alias("n_curr"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.sum("own").alias("own"))
    torn = F.raise_error(F.lit("drift_stats: a feature's partitions do not add up"))
    return (g.withColumn("n_ref", F.when(F.col("own") != F.col("n_ref") + F.col("n_curr"), torn).otherwise(F.col("n_ref")))
            .where((F.col("n_ref") > 0) & (F.col("n_curr") > 0)))


def _simple_stats(counts: DataFrame) -> DataFrame:
    """One window per feature: the reference form."""
    totals = counts.groupBy("fid").agg(
        F.sum("c_ref").alias("n_ref"), F.sum("c_curr").alias("n_curr"),
        F.sum(F.col("c_ref") * F.col("value")).alias("sum_ref_v"),
        F.min("value").alias("vmin"), F.max("value").alias("vmax")) \
        .where((F.col("n_ref") > 0) & (F.col("n_curr") > 0)).withColumn("mean_ref", F.col("sum_ref_v") / F.col("n_ref"))
    rows = running_totals_simple(counts, "fid", "value", ["c_ref", "c_curr"])
    # one row per feature: bounded by the schema
    j = rows.join(F.broadcast(totals.select("fid", "n_ref", "n_curr", "mean_ref")), "fid")
    gap = F.abs(F.col("cum_c_ref") / F.col("n_ref") - F.col("cum_c_curr") / F.col("n_curr"))
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    dev = F.col("value") - F.col("mean_ref")
    per_feature = j.groupBy("fid").agg(
        F.max(gap).alias("ks"), F.sum(gap * step).alias("emd"), F.sum(F.col("c_ref") * dev * dev).alias("ss_ref"))
    return totals.join(per_feature, "fid")


def drift_stats(ref: DataFrame, curr: DataFrame, columns: list[str] | None = None,
                method: str = "ranged", partitions: int | None = None,
                counts: DataFrame | None = None) -> DriftStats:
    """Per feature: fid, feature, n_ref, n_curr, ks, emd, std_ref (population) and
    the pooled min/max. Features with an empty side are left out (A16).
    ``method``: 'ranged' (an exchange of ``partitions`` partitions) or 'simple'
    (one window per feature, the form that tests compare with)."""
    features = drift_features(ref, curr, columns)
    counts = counts if counts is not None else paired_counts(ref, curr, features)
    if method not in ("ranged", "simple"):
        raise ValueError(method)
    if method == "ranged":
        partitions = partitions or default_partitions(ref)
        per = _ranged_stats(counts, partitions, _sampled_rows(ref, curr, features, partitions))
    else:
        per = _simple_stats(counts)
    stats = per.join(feature_names(ref.sparkSession, features), "fid").select(
        "fid", "feature", "n_ref", "n_curr", "ks", "emd", F.sqrt(F.col("ss_ref") / F.col("n_ref")).alias("std_ref"), "vmin", "vmax")
    return DriftStats(stats=stats, counts=counts, features=features)


def drift_report(ref: DataFrame, curr: DataFrame, columns: list[str] | None = None,
                 method: str = "ranged", partitions: int | None = None,
                 stats: DriftStats | None = None, exact_max_n: int = KS_EXACT_MAX_N) -> DataFrame:
    """(ordinal, feature, drift_detected, p_value, ks_statistic, emd_score,
    normalized_emd), rounded to 5/4/2/3 places the NumPy way; the flag uses
    unrounded values. A plan: building it runs no job. ``exact_max_n``: largest
    sample of the exact two-sample law."""
    spark = ref.sparkSession
    ds = stats or drift_stats(ref, curr, columns, method, partitions)
    ship_package(spark)  # p-values of small samples run in a Pandas UDF
    # one row per feature, spread so that each task has the p-value of one feature or two
    s = ds.stats.repartition(max(1, min(len(ds.features), spark.sparkContext.defaultParallelism)), "fid")
    n1, n2 = F.col("n_ref"), F.col("n_curr")
    small = (n1 <= exact_max_n) & (n2 <= exact_max_n)
    # exact branch works on the integer D·n1·n2 (fits a long there)
    d_int = F.when(small, F.rint(F.col("ks") * n1.cast("double") * n2.cast("double")).cast("long"))
    ks_exact = d_int.cast("double") / (n1.cast("double") * n2.cast("double"))
    ks = F.when(small, ks_exact).otherwise(F.col("ks"))
    nemd = safe_ratio(F.col("emd"), F.col("std_ref"), DRIFT_CONSTANT_SENTINEL)
    rep = s.select("fid", "feature", ks_pvalue(F.col("ks"), "n_ref", "n_curr", exact_max_n).alias("p"),
                   ks.alias("ks"), F.col("emd"), nemd.alias("nemd"))
    return rep.select(
        F.col("fid").alias("ordinal"), "feature",
        ((F.col("p") < DRIFT_P_THRESHOLD) & (F.col("nemd") > DRIFT_EMD_THRESHOLD)).alias("drift_detected"),
        np_round("p", 5).alias("p_value"),
        np_round("ks", 4).alias("ks_statistic"),
        np_round("emd", 2).alias("emd_score"),
        np_round("nemd", 3).alias("normalized_emd"))


def _wide(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*[qcol(f).cast("double").alias(f"v{i}") for i, f in enumerate(features)])


def _finite_columns(batch):
    for column in batch.columns:
        v = column.to_numpy(zero_copy_only=False)  # NULL is NaN
        yield v[np.isfinite(v)]


def _extremes(df: DataFrame, features: list[str]) -> DataFrame:
    """(i, n, lo, hi): per feature the number of finite values and their extremes; features
    without one have no row."""
    ship_package(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        n, lo, hi = np.zeros(len(features), np.int64), np.full(len(features), np.inf), np.full(len(features), -np.inf)
        for b in batches:
            for i, v in enumerate(_finite_columns(b)):
                if len(v):
                    n[i], lo[i], hi[i] = n[i] + len(v), min(lo[i], v.min()), max(hi[i], v.max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(features), dtype=np.int32)), pa.array(n), pa.array(lo), pa.array(hi)],
                                         names=["i", "n", "lo", "hi"])

    per = _wide(df, features).mapInArrow(run, "i int, n long, lo double, hi double").where("n > 0")
    return per.groupBy("i").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _bin_counts(df: DataFrame, ranges: dict[str, tuple[int, float, float]], bins: int) -> DataFrame:
    """``(key, n)``; the key of a feature's bin is fid·bins + bin, bins from 0. A value's bin
    is the number of inner edges (those of ``linspace_edges``) that are at most the value,
    so edges that rounding makes coincide are told apart as NumPy does."""
    ship_package(df.sparkSession)
    inner = [np.array([i * ((hi - lo) / float(bins)) + lo for i in range(1, bins)]) for _, lo, hi in ranges.values()]
    first = [fid * bins for fid, _, _ in ranges.values()]

    def run(batches):
        import pyarrow as pa

        counts = np.zeros((len(inner), bins), np.int64)
        for b in batches:
            for i, v in enumerate(_finite_columns(b)):
                counts[i] += np.bincount(np.searchsorted(inner[i], v, side="right"), minlength=bins)
        keys = (np.array(first)[:, None] + np.arange(bins)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(counts.ravel())], names=["key", "n"])

    return _wide(df, list(ranges)).mapInArrow(run, "key int, n long").where("n > 0").groupBy("key").agg(F.sum("n").alias("n"))


def drift_histogram(ref: DataFrame, curr: DataFrame, columns: list[str] | None = None,
                    bins: int = HISTOGRAM_BINS, features: list[str] | None = None) -> DataFrame:
    """(feature, bin_index, bin, ref_density, curr_density); no rows for a
    feature whose pooled min equals its max or that has an empty side. Where a
    feature's range is so narrow that edges coincide, the densities of its bins
    of no width are NULL; other bins and features are not affected.

    The extremes (a row per feature and side) are read while the frame is built: the second
    pass gets the edges with its code."""
    spark = ref.sparkSession
    features = features or drift_features(ref, curr, columns)
    both = _extremes(ref, features).withColumn("side", F.lit(0)).unionByName(_extremes(curr, features).withColumn("side", F.lit(1)))
    found = {(r.side, r.i): r for r in both.collect()}
    rows = []
    for i, f in enumerate(features):
        a, b = found.get((0, i)), found.get((1, i))
        if a and b and min(a.lo, b.lo) < max(a.hi, b.hi):
            rows.append((i + 1, f, a.n, b.n, min(a.lo, b.lo), max(a.hi, b.hi)))
    schema = "fid int, feature string, n_ref long, n_curr long, vmin double, vmax double"
    # one row per feature and bin: bounded by the schema
    spine = (spark.createDataFrame(rows, schema).withColumn("edges", linspace_edges(F.col("vmin"), F.col("vmax"), bins))
             .withColumn("bin_index", F.explode(F.sequence(F.lit(1), F.lit(bins))))
             .withColumn("key", F.col("fid") * bins + F.col("bin_index") - 1))
    counts = spark.createDataFrame([], "key int, n_r long, n_c long")
    if rows:
        ranges = {f: (fid, lo, hi) for fid, f, _, _, lo, hi in rows}
        zero = F.lit(0).cast("long")
        counts = _bin_counts(ref, ranges, bins).select("key", F.col("n").alias("n_r"), zero.alias("n_c")).unionByName(
            _bin_counts(curr, ranges, bins).select("key", zero.alias("n_r"), F.col("n").alias("n_c")))
    counts = counts.groupBy("key").agg(F.sum("n_r").alias("k_ref"), F.sum("n_c").alias("k_curr"))
    lo, hi = F.element_at("edges", F.col("bin_index")), F.element_at("edges", F.col("bin_index") + 1)
    width = hi - lo
    k_ref, k_curr = [F.coalesce(F.col(k), F.lit(0)).cast("double") for k in ("k_ref", "k_curr")]
    return (spine.join(F.broadcast(counts), "key", "left")
            .select("feature", "bin_index",
                    np_round((lo + hi) / F.lit(2.0), 2).alias("bin"),
                    (F.try_divide(k_ref, width) / F.col("n_ref")).alias("ref_density"),
                    (F.try_divide(k_curr, width) / F.col("n_curr")).alias("curr_density")))


def drift_result(report: DataFrame, histogram: DataFrame) -> DataFrame:
    """The nested form: one row per feature with ``chart_data`` as
    array<struct<bin, ref_density, curr_density>> in bin order (20 entries per
    feature at most, so the per-feature array is bounded)."""
    charts = histogram.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("bin_index", "bin", "ref_density", "curr_density")))
        .alias("_bins"))
    return (report.join(charts, "feature", "left")
            .select("ordinal", "feature", "drift_detected", "p_value", "ks_statistic", "emd_score",
                    "normalized_emd",
                    F.coalesce(F.transform("_bins", lambda b: F.struct(
                        b["bin"].alias("bin"), b["ref_density"].alias("ref_density"),
                        b["curr_density"].alias("curr_density"))),
                        F.array().cast("array<struct<bin:double,ref_density:double,curr_density:double>>"))
                    .alias("chart_data")))


def segment_drift(ref: DataFrame, curr: DataFrame, segment_col: str | None = None,
                  segment_value=None, columns: list[str] | None = None, **kw) -> DataFrame:
    """D9 core: optional segment filter (F11), then the report."""
    if segment_col is not None:
        ref, curr = segment_pair(ref, curr, segment_col, segment_value)
    return drift_report(ref, curr, columns, **kw)


def drift_result_json(result: DataFrame) -> DataFrame:
    """Each feature's nested result (at most 20 bins) as one JSON document
    → (ordinal, feature, json)."""
    body = F.struct("feature", "drift_detected", "p_value", "ks_statistic", "emd_score", "chart_data",
                    "normalized_emd")
    return result.select("ordinal", "feature", F.to_json(body).alias("json"))
