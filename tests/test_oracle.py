"""Every registered query against its DuckDB oracle (sf0.001 for speed; the
driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_MID, SF_SMALL
from tests.oracle_harness import compare, duck

ORACLES = E.oracle_sql()
# Lineitem pairs take the exact p-value branch at sf0.001 and the asymptotic one
# (above 10 000 rows per side) at sf0.01: compare them at both.
NEEDS_MID = {"drift_report", "drift_report_scaled", "drift_report_identical"}


@pytest.fixture(scope="module")
def cons():
    return {SF_SMALL: duck(SF_SMALL), SF_MID: duck(SF_MID)}


CASES = [(n, SF_SMALL) for n in sorted(E.queries())] + [(n, SF_MID) for n in sorted(NEEDS_MID)]


@pytest.mark.parametrize("name,sf", CASES)
def test_query_matches_oracle(spark, cons, name, sf):
    res = compare(spark, sf, name, E.queries()[name], ORACLES.get(name), cons[sf])
    assert res["status"] in ("ok", "rows-only"), res


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert [f.name for f in df.schema.fields] == [
        "ordinal", "feature", "drift_detected", "p_value", "ks_statistic", "emd_score", "normalized_emd"]
