"""Randomised properties (hypothesis): drift statistics against NumPy, filter
monotonicity, quantiles against NumPy. Few examples: each one runs Spark jobs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.test_drift import np_emd, np_ks
from vitrine.operators.drift import drift_stats
from vitrine.operators.quantiles import group_quantiles

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.integers(min_value=-20, max_value=20), min_size=1, max_size=60)


@SETTINGS
@given(a=values, b=values, partitions=st.sampled_from([1, 2, 5]))
def test_drift_stats_match_numpy(spark, a, b, partitions):
    a = np.array(a, dtype=float) / 4
    b = np.array(b, dtype=float) / 4
    ref = spark.createDataFrame(pd.DataFrame({"v": a}))
    curr = spark.createDataFrame(pd.DataFrame({"v": b}))
    r = drift_stats(ref, curr, partitions=partitions).stats.first()
    assert r.ks == pytest.approx(np_ks(a, b), abs=1e-15)
    assert r.emd == pytest.approx(np_emd(a, b), rel=1e-9, abs=1e-12)
    assert r.std_ref == pytest.approx(float(np.std(a)), rel=1e-9, abs=1e-12)
    assert (r.n_ref, r.n_curr) == (len(a), len(b))


@SETTINGS
@given(groups=st.lists(st.tuples(st.sampled_from(["A", "B", None]), st.integers(-50, 50)), min_size=1,
                       max_size=80),
       partitions=st.sampled_from([1, 3, 10]))
def test_group_quantiles_match_numpy(spark, groups, partitions):
    df = spark.createDataFrame(groups, "g string, v int")
    got = {r.group: r for r in group_quantiles(df, "g", "v", partitions=partitions).collect()}
    by = {}
    for g, v in groups:
        by.setdefault(g, []).append(v)
    assert set(got) == set(by)
    for g, vs in by.items():
        want = np.percentile(np.array(vs, dtype=float), [0, 25, 50, 75, 100])
        r = got[g]
        assert r.n == len(vs)
        assert [r.q0, r.q1, r.q2, r.q3, r.q4] == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_quantiles_of_a_hot_group(spark):
    """One brand holds a third of the rows, a tie holds a third of it: the brand's values lie in many ranges."""
    from pyspark.sql import functions as F
    n = 30_000
    v = F.when(F.col("id") % 9 == 0, F.lit(77.0)).otherwise((F.col("id") * 7919 % n) / 4)
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("b"), F.col("id") % 500)).alias("g"), v.alias("v"))
    got = {r.group: r for r in group_quantiles(df, "g", "v", partitions=24).collect()}
    want = df.toPandas().groupby("g")["v"]
    assert set(got) == set(want.groups)
    for g, x in want:
        assert [got[g].n, *[got[g][f"q{k}"] for k in range(5)]] == pytest.approx([len(x), *np.percentile(x, [0, 25, 50, 75, 100])])
