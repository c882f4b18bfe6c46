import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import brute
from vitrine.llm import lattice, queries


def expected(rows, threshold=0.93):
    ok = [(i, lab, np.array(v, dtype=float)) for i, lab, v in rows
          if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, x, u), (j, y, w) = ok[a], ok[b]
            if x == y and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= threshold:
                links.append((i, j))
    comp = brute.components([r[0] for r in rows], links)
    n = {r[0]: sum(r[0] in e for e in links) for r in rows}
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


def result(df, **kw):
    return {r[0]: (r.n_links, r.component_id, r.kept) for r in df}


def clusters(seed, sizes, noise=0.02, dim=16, labels=(1, 2)):
    rng, out = np.random.default_rng(seed), []
    for size in sizes:
        c = rng.standard_normal(dim)
        for _ in range(size):
            out.append((len(out) + 1, int(rng.choice(labels)), (c + noise * np.linalg.norm(c) * rng.standard_normal(dim)).tolist()))
    return out


SCHEMA = "vec_id long, label int, embedding array<double>"


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8)) * 2
    near = lattice.neighbours()
    p = lattice.nearest_e8(x)
    best = ((x - p) ** 2).sum(1)
    assert len({tuple(v) for v in near}) == 240 and np.allclose((near ** 2).sum(1), 2)
    for v in near:  # a point of E8 is nearest if none of its 240 neighbours is nearer
        assert (((x - p - v) ** 2).sum(1) >= best - 1e-9).all()


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert result(queries.op1_lattice_near_dedup(spark, SF_SMALL).select("vec_id", "n_links", "component_id", "kept").collect()) == expected(rows)


@pytest.mark.parametrize("cell_rows", [7, 4096])
def test_dense_clusters_and_split_cells(spark, cell_rows):
    rows = clusters(3, [60, 25, 1, 1, 9, 2])
    rows += [(1000 + k, 1, rows[0][2]) for k in range(30)]  # copies
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(lattice.near_duplicates(df, cell_rows=cell_rows).collect()) == expected(rows)


def test_recall_at_the_threshold(spark):
    rng, rows = np.random.default_rng(8), []
    for k in range(400):  # pairs at a cosine just above the threshold, the hardest to find
        u, w = rng.standard_normal((2, 64))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        c = 0.9305
        rows += [(2 * k, k % 3, u.tolist()), (2 * k + 1, k % 3, (c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist())]
    got = lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).agg(F.sum("n_links")).first()[0]
    assert got >= 0.95 * 800


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, 1, v), (2, 1, [2.0, 4.0, 6.0]), (3, 2, v), (4, None, v), (5, 1, None), (6, 1, []), (7, 1, [0.0, 0.0, 0.0]),
            (8, 1, [1.0, None, 3.0]), (9, 1, [1.0, float("nan"), 0.0]), (10, 1, [float("inf"), 1.0, 0.0]), (11, 1, [1.0, 2.0]),
            (12, 1, [1e200, 2e200, 3e200]), (13, 1, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rep": F.lit("x"), "cell": F.lit(1), "n": F.lit(2)})
    want = expected([(i, lab, v if i == 12 else e) for i, lab, e in rows])
    assert result(lattice.near_duplicates(df).collect()) == want
    assert lattice.near_duplicates(df.limit(0)).collect() == []
    twice = df.where("vec_id = 3").unionAll(df.where("vec_id = 3"))
    assert [(r.id, r.n_links, r.component_id) for r in lattice.near_duplicates(twice).collect()] == [(3, 1, 3)] * 2
