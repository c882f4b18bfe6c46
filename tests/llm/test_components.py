import random

from tests.llm import brute
from vitrine.llm.components import connected_components


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = brute.components({x for e in real for x in e}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_a_hub_is_spread(spark):
    """A hub's edges are joined under as many keys as there are salts."""
    from pyspark.sql import functions as F

    from vitrine.llm import components

    rows = [(0, k) for k in range(1, 4001)]
    edges = spark.createDataFrame(rows, "u long, v long")
    got = components._with_low(edges, F.min("v"))
    assert got.count() == 4000 and got.select("m").distinct().collect() == [(1,)]
    salts = edges.groupBy(components._salt("v").alias("s")).count().collect()
    assert len(salts) == 16 and max(r["count"] for r in salts) < 400
    comp = connected_components(spark.createDataFrame([*rows, (5000, 4000)], "u long, v long"), "u", "v")
    assert comp.select("component").distinct().collect() == [(0,)] and comp.count() == 4002
