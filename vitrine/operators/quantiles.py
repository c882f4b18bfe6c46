"""Exact quantiles per group without gathering a group (A4, scale form).

``percentile`` buffers every value of a group in one aggregation buffer, so a
group with a third of the rows lands in one task. Here values are first
collapsed to (group, value, count) and dealt into ranges of (group, value)
(``prefix.range_scan``): a large group spreads over many ranges, each of which
knows how many values come before its own. With n values, p gives h = (n−1)·p and
q = v[⌊h⌋] + (h − ⌊h⌋)·(v[⌈h⌉] − v[⌊h⌋]) (linear interpolation, 0-based ranks);
the range that holds a rank hands on its value. Nothing is joined on the group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.prefix import Segments, range_scan

BOX_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def group_quantiles(df: DataFrame, group: str, measure: str, probs=BOX_PROBS, partitions: int | None = None) -> DataFrame:
    """(group, n, q0 … q{k-1}) for the non-NULL values of ``measure``; NULL group kept."""
    probs = [float(p) for p in probs]
    counts = (df.where(F.col(measure).isNotNull())
              .groupBy(F.col(group).alias("group"), F.col(measure).cast("double").alias("value"))
              .agg(F.count(F.lit(1)).alias("c")))
    ranks = [f"{side}{k}" for k in range(len(probs)) for side in ("lo", "hi")]
    schema = T.StructType([counts.schema["group"], T.StructField("n", T.LongType()), T.StructField("own", T.LongType()),
                           *[T.StructField(r, T.DoubleType()) for r in ranks]])

    def pick(s: Segments) -> dict:
        import pyarrow as pa

        n, own, before = s.total["c"].astype(np.int64), s.own["c"], s.before["c"].astype(np.int64)
        upto = np.cumsum(s.weight["c"])
        base = upto[s.stop - 1] - own  # of the partition, before the segment
        out = {"group": s.parts.take(pa.array(s.start)), "n": n, "own": own}
        for k, p in enumerate(probs):
            h = (n - 1) * p
            for side, rank in (("lo", np.floor(h)), ("hi", np.ceil(h))):
                local = rank.astype(np.int64) - before
                here = (local >= 0) & (local < own)
                at = np.searchsorted(upto, np.where(here, local, 0) + base, side="right")
                out[f"{side}{k}"] = pa.array(s.value[at], pa.float64(), mask=~here)
        return out

    rows = range_scan(counts, "group", "value", ["c"], pick, schema, partitions)
    g = rows.groupBy("group").agg(F.max("n").alias("n"), F.sum("own").alias("own"), *[F.max(r).alias(r) for r in ranks])
    torn = F.raise_error(F.lit("group_quantiles: a group's partitions do not add up"))
    out = [F.col("group"), F.when(F.col("own") != F.col("n"), torn).otherwise(F.col("n")).alias("n")]
    for k, p in enumerate(probs):
        lo, hi, h = F.col(f"lo{k}"), F.col(f"hi{k}"), (F.col("n") - 1).cast("double") * F.lit(p)
        out.append(F.when(hi == lo, lo).otherwise(lo + (h - F.floor(h)) * (hi - lo)).alias(f"q{k}"))
    return g.select(*out)


def box_summary(df: DataFrame, group: str, measure: str, partitions: int | None = None) -> DataFrame:
    """Box-plot summary per group: (group, n, q0=min, q1, q2=median, q3, q4=max)."""
    return group_quantiles(df, group, measure, BOX_PROBS, partitions)
