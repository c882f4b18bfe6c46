"""Sharding by **k-d tree partitioning**, in DataFrame operations only.

The documents are points in a space of metadata (size, source, language, id). A
node of the tree that stands for k leaves is split along its widest dimension at
the weighted quantile floor(k/2)/k of its bytes, until every node is one leaf of
the target size. Law: ``bytes`` (leaves nearly equal in bytes).

The weighted medians are found by distributed histograms: one aggregation per
round narrows the cut of all nodes of a level to one of ``BUCKETS`` intervals,
until the interval is light enough (``TOLERANCE`` of a leaf) or holds one row. A
point's key along a dimension is 62 bits: the coordinate on a grid of 2**20 steps,
then a hash of its text, then a hash of its id, so that points with equal
coordinates can be split as well. Rows with equal texts have equal coordinates
(the least of their group) and stay together; only a group that weighs more than
``GROUP_TOLERANCE`` of a leaf may be cut. The driver sees one row per node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import broadcast_if_small, freeze, with_group
from vitrine.operators.ranking import global_rank

COORD_BITS, TEXT_BITS, ID_BITS = 20, 21, 21
TIE_BITS = TEXT_BITS + ID_BITS
BUCKETS_LOG2 = 10
TOLERANCE = 0.002
GROUP_TOLERANCE = 0.05
#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Rows that one task numbers.
SLOT_ROWS = 1 << 20
#: More distinct values of a source or language than this are joined by salted shuffle instead of broadcast.
BROADCAST_VALUES = 20_000


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the strings of ``column`` replaced by their rank among its different values; null: -1."""
    values = rows.where(F.col(column).isNotNull()).select(column).distinct()
    ranks = freeze(global_rank(values, [F.col(column)], "_rank"))
    small = broadcast_if_small(ranks, BROADCAST_VALUES)
    if small is not ranks:
        out = rows.join(small, column, "left")
    else:
        out = with_group(rows, ranks, column, F.struct("id", "th"))
    return out.withColumn(column, F.coalesce(F.col("_rank").cast("double"), F.lit(-1.0))).drop("_rank")


@dataclass
class Node:
    """A tree node over the shards ``first`` to ``first + leaves - 1``."""

    leaves: int
    first: int
    dim: int = 0
    cut: int = 0


def _of_node(values: list) -> Column:
    """The value of the row's node, from a literal array (a level has fewer nodes than shards)."""
    return F.array(*[F.lit(v) for v in values])[F.col("node")]


def _key(level: list[Node], dims: int) -> Column:
    coord = F.array(*[F.col(f"q{d}") for d in range(dims)])[_of_node([n.dim for n in level])]
    return F.shiftleft(coord.cast("long"), TIE_BITS).bitwiseOR(F.col("tie"))


def _find_cuts(at: DataFrame, level: list[Node], dims: int, leaf_bytes: float) -> None:
    """Set the dimension and the cut of every node of a level."""
    stats = at.groupBy("node").agg(F.sum("size").alias("bytes"), *[
        x for d in range(dims) for x in (F.min(f"q{d}").alias(f"lo{d}"), F.max(f"q{d}").alias(f"hi{d}"))]).collect()
    ranges = {}
    for r in stats:  # a node without rows keeps the cut 0: everything below it is empty
        n = level[r["node"]]
        n.dim = max(range(dims), key=lambda d: (r[f"hi{d}"] - r[f"lo{d}"], -d))
        lo, hi = r[f"lo{n.dim}"] << TIE_BITS, (r[f"hi{n.dim}"] + 1) << TIE_BITS
        ranges[r["node"]] = (lo, hi, 0, r["bytes"] * (n.leaves // 2) / n.leaves)  # bytes before lo, bytes wanted below the cut
    while ranges:
        shift = {k: max(0, (hi - lo - 1).bit_length() - BUCKETS_LOG2) for k, (lo, hi, _, _) in ranges.items()}

        def per_node(f, rest=0):
            return _of_node([f(k) if k in ranges else rest for k in range(len(level))])

        offset = F.col("key") - per_node(lambda k: ranges[k][0])
        rows = (at.select("node", "size", _key(level, dims).alias("key"))
                .where((F.col("key") >= per_node(lambda k: ranges[k][0])) & (F.col("key") < per_node(lambda k: ranges[k][1]))))
        width = per_node(lambda k: 1 << shift[k], 1)
        bucket = F.call_function("div", offset, width)
        sums = rows.select("node", bucket.alias("bucket"), "size").groupBy("node", "bucket").agg(
            F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        up = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        want = per_node(lambda k: float(ranges[k][3] - ranges[k][2]), 0.0)
        # the first bucket that reaches the wanted bytes; at most 2**BUCKETS_LOG2 buckets per node in the window
        found = (sums.withColumn("cum", F.sum("w").over(up)).where(F.col("cum") >= want)
                 .groupBy("node").agg(F.min_by(F.struct("bucket", "w", "n", "cum"), "bucket").alias("b")).collect())
        for r in found:
            k, b = r["node"], r["b"]
            lo, hi, before, goal = ranges.pop(k)
            s = shift[k]
            start, end = lo + (b["bucket"] << s), min(hi, lo + ((b["bucket"] + 1) << s))
            below = before + b["cum"] - b["w"]
            one_text = s <= ID_BITS
            if s == 0 or b["n"] == 1 or b["w"] <= TOLERANCE * leaf_bytes or one_text and b["w"] <= GROUP_TOLERANCE * leaf_bytes:
                level[k].cut = start if goal - below < below + b["w"] - goal else end
            else:
                ranges[k] = (start, end, below, goal)


def _descend(at: DataFrame, level: list[Node], dims: int) -> tuple[DataFrame, list[Node]]:
    """Rows at the children of their nodes; those at a leaf get its shard and node -1."""
    below, node, shard = [], {}, {}
    for k, n in enumerate(level):
        half = n.leaves // 2
        for side, child in (("low", Node(half, n.first)), ("high", Node(n.leaves - half, n.first + half))):
            shard[k, side] = child.first if child.leaves == 1 else -1
            node[k, side] = -1 if child.leaves == 1 else len(below)
            if child.leaves > 1:
                below.append(child)
    low = _key(level, dims) < _of_node([n.cut for n in level])
    go = {name: F.when(low, _of_node([v[k, "low"] for k in range(len(level))]))
          .otherwise(_of_node([v[k, "high"] for k in range(len(level))])) for name, v in (("node", node), ("shard", shard))}
    inside = F.col("node") >= 0
    rest = [c for c in at.columns if c not in ("node", "shard")]
    # written, so that the next level's passes do not descend from the root again
    return freeze(at.select(*rest, F.when(inside, go["node"]).otherwise(-1).alias("node"),
                            F.when(inside, go["shard"]).otherwise(F.col("shard")).alias("shard"))), below


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          dims: dict[str, Column] | None = None) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)``, one row per row of ``docs``.

    ``dims``: numeric metadata columns; by default the logarithm of the size and,
    as far as ``docs`` has them, the ranks of source and language among their
    different values, and the id. Null metadata is the lowest
    coordinate, a null text has no bytes and is not a copy of an empty one. Rows of
    one id and text are copies like any other; shards may be empty where documents are
    few; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    names = 0  # so many of the first dimensions are strings
    if dims is None:
        dims = {c: F.col(c).cast("string") for c in ("source", "lang") if c in docs.columns}
        names = len(dims)
        dims |= {"id": F.coalesce(F.col(id_col).cast("double"), F.lit(-1.0))}
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    meta = freeze(docs.select(
        F.col(id_col).cast("long").alias("id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("th"), *[c.alias(f"m{k}") for k, c in enumerate(dims.values())]))
    for k in range(names):
        meta = _ranked(meta, f"m{k}")
    if names:
        meta = freeze(meta)
    n = len(dims)
    groups = meta.groupBy("th").agg(F.count(F.lit(1)).alias("copies"), *[F.min(f"m{k}").alias(f"g{k}") for k in range(n)])
    meta = with_group(meta, groups.where("copies > 1"), "th", F.col("id"))
    coords = [F.log2(F.col("size").cast("double")), *[F.coalesce(f"g{k}", f"m{k}") for k in range(n)]]
    meta = meta.select("id", "size", "text_crc32", "th", *[c.alias(f"d{k}") for k, c in enumerate(coords)])
    dims_n = n + 1
    span = meta.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[
        x for k in range(dims_n) for x in (F.min(f"d{k}").alias(f"lo{k}"), F.max(f"d{k}").alias(f"hi{k}"))]).first()

    def grid(k: int) -> Column:
        lo, hi = span[f"lo{k}"], span[f"hi{k}"]
        if lo is None or hi <= lo:
            return F.lit(0)
        return F.floor((F.col(f"d{k}") - F.lit(lo)) / F.lit(hi - lo) * ((1 << COORD_BITS) - 1)).cast("int")

    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("th"), 64 - TEXT_BITS), ID_BITS).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64("id"), 64 - ID_BITS))
    points = freeze(meta.select("id", "size", "text_crc32", tie.alias("tie"), *[grid(k).alias(f"q{k}") for k in range(dims_n)]))
    root = Node(shards, 0)
    level = [root] if span["n"] and shards > 1 else []
    at = points.withColumns({"node": F.lit(0), "shard": F.lit(0)})
    while level:
        _find_cuts(at.where("node >= 0"), level, dims_n, span["bytes"] / shards)
        at, level = _descend(at, level, dims_n)
    placed = at.select("id", "size", "text_crc32", "shard")

    # gapless slots without one task per shard: ranks inside parts, plus the rows of the parts before
    parts = max(1, -(-span["n"] // (shards * SLOT_ROWS)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32"))
    out = placed.join(offsets, ["shard", "part"])
    return out.select("id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      (F.col("off") + rank - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
