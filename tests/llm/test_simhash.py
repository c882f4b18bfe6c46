import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import brute
from vitrine.llm import queries, simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def classes(df, **kw):
    return {r.id: (r.fp & (2**64 - 1), r.component_id, r.kept) for r in simhash.simhash_classes(df, **kw).collect()}


def expected(rows):
    fps = {i: brute.simhash(t) for i, t in rows}
    comp = brute.components(fps, brute.hamming_links(fps))
    return {i: (fps[i], comp[i], comp[i] == i) for i in fps}


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = expected([(r.doc_id, r.text) for r in rows])
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id, r.kept)
           for r in queries.op7_simhash_near_dedup(spark, SF_SMALL).collect()}
    assert got == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (4, "one"), (5, "ONE"), (6, "a b c d " * 20000), (7, "É é"), (8, "é é"),
            (9, "x y z")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)  # clashing names are not read
    assert classes(df) == expected(rows)
    assert classes(df.limit(0)) == {}
    twice = df.where("doc_id = 4").unionAll(df.where("doc_id = 4"))
    assert [r.kept for r in simhash.simhash_classes(twice).collect()] == [True, True]
    null_id = spark.createDataFrame([(None, "one", "", ""), (4, "one", "", "")], SCHEMA)
    assert {(r.id, r.component_id, r.kept) for r in simhash.simhash_classes(null_id).collect()} == {
        (None, 4, False), (4, 4, True)}


@pytest.mark.parametrize("hot_cell", [3, 2000])
def test_links_exact_for_dense_fingerprints(spark, hot_cell):
    rng = random.Random(5)
    fps = {0, 2**64 - 1, 1 << 63}
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in fps.items()], "fp long, rep long")
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.simhash_links(df, hot_cell=hot_cell).collect()}
    assert got == set(brute.hamming_links(fps))


def test_popcount_embedding_is_a_lower_bound(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long").select(
        "a", "b", F.bit_count(simhash.segment_popcounts(F.col("a")).bitwiseXOR(
            simhash.segment_popcounts(F.col("b")))).alias("l1"))
    for r in df.collect():
        counts = [[((x >> k) & 3).bit_count() for k in range(0, 64, 2)] for x in (r.a, r.b)]
        assert r.l1 == sum(abs(p - q) for p, q in zip(*counts)) <= (r.a ^ r.b).bit_count()


def test_a_hot_cell_is_cut_into_parts(spark):
    """Fingerprints of one cell, and of one finer cell, beyond the limit: links are exact, and no cell keeps more rows than its parts."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:  # all differ in the low 24 bits only, so they share cells of both grids
        x = base
        for b in rng.sample(range(24), rng.randint(1, 6)):
            x ^= 1 << b
        fps.add(x)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in fps.items()], "fp long, rep long")
    for hot_cell in (20, 100):
        got = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.simhash_links(df, hot_cell=hot_cell).collect()}
        assert got == set(brute.hamming_links(fps))
    cells = simhash._cells(df, "fp", simhash._grid_masks(1, 7, 4), [])
    keys = ["grid", "cell"]
    hot = simhash._hot_cells(cells, keys, 20)
    parted = simhash._in_parts(cells, hot, keys)
    largest = parted.groupBy(*keys, "lo", "hi").count().agg(F.max("count")).first()[0]
    assert cells.groupBy(*keys).count().agg(F.max("count")).first()[0] == 400 and largest <= 60
