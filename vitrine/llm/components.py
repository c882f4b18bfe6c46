"""Connected components of a link table, by alternating large-star and small-star
rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Every round is two aggregations and two joins on the edge table, written to the
checkpoint folder; links and labels never reach the driver. A round keeps at
most one edge per (node, minimum), so hubs end as stars instead of cliques. The joins
are salted by the neighbour: a node's minimum is handed out once for every salt that
its edges use, so a hub's edges are spread over ``SALTS`` tasks and other nodes'
rows stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import SALTS, freeze


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _salt(v: str) -> Column:
    return F.pmod(F.xxhash64(v), F.lit(SALTS)).cast("int")


def _with_low(edges: DataFrame, low: Column) -> DataFrame:
    """``edges`` with ``m``, the value of the aggregate ``low`` over the edges of ``u``."""
    used = F.bit_or(F.call_function("shiftleft", F.lit(1), _salt("v"))).alias("used")
    per = edges.groupBy("u").agg(low.alias("m"), used)
    per = per.select("u", "m", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("used", k) == 1)).alias("salt"))
    return edges.withColumn("salt", _salt("v")).join(per, ["u", "salt"]).select("u", "v", "m")


def connected_components(links: DataFrame, u: str, v: str) -> DataFrame:
    """``(node, component)`` for every node that has a link; ``component`` is the
    smallest node reachable. Nulls and self-links are ignored; an empty table
    gives an empty result."""
    e = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    e = freeze(e)
    seen = _checksum(e)
    while seen[0]:
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_low(both, F.least(F.min("v"), F.first("u"))).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        # small star: every smaller neighbour, and the node, move to the smallest
        small = _with_low(large, F.min("v")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionAll(large.groupBy("u").agg(F.min("v").alias("v")))
        e = freeze(small.distinct())
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
