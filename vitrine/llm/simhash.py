"""Near-duplicate classes from 64-bit SimHash fingerprints.

Method: **segment-popcount embedding**. A fingerprint is cut into 32 segments of
2 bits and mapped to the vector of their bit counts (0, 1 or 2). Two
fingerprints that differ in d bits lie at Manhattan distance <= d there, so a
range join under Manhattan distance finds a superset of the links, and an exact
bit count of the XOR verifies.

The vector is kept in one long: the counts are written in unary (0 -> 00, 1 -> 01,
2 -> 11), where the Manhattan distance of two vectors is the bit count of their
XOR. The grid: the 32 dimensions are dealt into ``max_bits + 3`` groups. A
distance of at most ``max_bits`` leaves at least three groups untouched, so the
two vectors share a cell of one of the grids spanned by three groups: 20 grids
for 3 bits. That is exact, with no probing of neighbouring cells.

Cells that may hold more than ``hot_cell`` different fingerprints are told beforehand,
from one fingerprint in some (a wrong guess costs time only), and refined: their
members are dealt again into the cells of finer grids (segments of one bit, four
of seven groups), which is exact by the same argument. A finer cell that is still hot
is cut into parts by a hash, and every pair of parts is joined by itself, so that no
task holds a hot cell.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import broadcast_if_small, freeze, ship_texts, with_group
from vitrine.llm.components import connected_components

HOT_CELL = 2000
#: More hot cells than this are joined by shuffle instead of broadcast.
BROADCAST_CELLS = 100_000


def fingerprint_bytes(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one UTF-8 text: ASCII letters lowered, words split
    at ASCII white space, one XXH64 (seed 42) per shingle, repeats included. A
    text without words (or a null) has fingerprint 0."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        joined, at, starts = b" ".join(words), 0, []
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [s - 1 for s in starts[shingle:]] + [len(joined)]
        grams = [joined[a:b] for a, b in zip(starts, ends)]
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 4096):  # bounded memory for very long texts
        ones += np.unpackbits(h[k:k + 4096].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` for every row; one narrow pass over whole texts."""
    ship_texts(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint_bytes(t.as_py(), shingle) for t in texts], pa.int64())],
                names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, fp long")


def segment_popcounts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each in unary."""
    half = F.lit(0x5555555555555555)
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(half).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(half), 1))


def _grid_masks(unit: int, groups: int, kept: int) -> list[int]:
    """Signed 64-bit masks of ``kept`` of ``groups`` groups of ``unit``-bit segments."""
    segs = 64 // unit
    edges = [unit * (segs * k // groups) for k in range(groups + 1)]
    spans = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    out = []
    for pick in combinations(spans, kept):
        m = sum(pick)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _cells(fps: DataFrame, point: str, masks: list[int], extra: list[str]) -> DataFrame:
    """One row per grid: its number and the point's coordinates in its dimensions."""
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), F.col(point).bitwiseAND(F.lit(m)).alias("cell"))
                               for k, m in enumerate(masks)]))
    return fps.select(*extra, "fp", "rep", cell.alias("c")).select(*extra, "fp", "rep", "c.grid", "c.cell")


def _range_join(cells: DataFrame, keys: list[str], max_bits: int, parts: bool = False) -> DataFrame:
    """Pairs that share a cell, lie within ``max_bits`` in Manhattan distance and
    differ in at most ``max_bits`` bits (both checks run inside the join). ``parts``: rows
    of two parts meet, and rows of one part where it is paired with itself."""
    a, b = cells.alias("a"), cells.alias("b")
    pa, pb = segment_popcounts(F.col("a.fp")), segment_popcounts(F.col("b.fp"))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    cond = on[0]
    for c in [*on[1:], F.col("a.fp") < F.col("b.fp"),
              F.bit_count(pa.bitwiseXOR(pb)) <= max_bits,
              F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits]:
        cond &= c
    if parts:
        cond &= (F.col("a.part") != F.col("b.part")) | (F.col("a.lo") == F.col("a.hi"))
    return a.join(b, cond).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))


def _hot_cells(cells: DataFrame, keys: list[str], hot_cell: int) -> DataFrame:
    """``(keys, parts)`` of the cells that may have more than ``hot_cell`` rows, judged
    from the fingerprints whose hash is 0 modulo a rate: about 16 of them are expected in
    half a hot cell. Written out, since the rows are dealt by it."""
    rate = max(1, hot_cell // 32)
    seen = cells.where(F.pmod(F.xxhash64("fp"), F.lit(rate)) == 0).groupBy(*keys).agg((F.count(F.lit(1)) * rate).alias("n"))
    return freeze(seen.where(F.col("n") > (hot_cell if rate == 1 else hot_cell // 2))
                  .select(*keys, F.ceil(2 * F.col("n") / F.lit(float(hot_cell))).cast("int").alias("parts")))


def _in_parts(cells: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with ``part``, ``lo`` and ``hi``: a row of part p of a hot cell once for
    every pair of parts that p belongs to, other rows once."""
    dealt = cells.join(broadcast_if_small(hot, BROADCAST_CELLS), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.withColumn("q", other).withColumns({"lo": F.least("q", "part"), "hi": F.greatest("q", "part")}).drop("q", "parts")


def simhash_links(fps: DataFrame, max_bits: int = 3, hot_cell: int = HOT_CELL) -> DataFrame:
    """Links ``(u, v)`` between the representatives of different fingerprints at
    most ``max_bits`` apart. ``fps``: ``(fp, rep)``, one row per fingerprint."""
    points = fps.withColumn("p", segment_popcounts(F.col("fp")))
    cells = _cells(points, "p", _grid_masks(2, max_bits + 3, 3), [])
    hot = _hot_cells(cells, ["grid", "cell"], hot_cell)
    any_hot = not hot.isEmpty()
    few = broadcast_if_small(hot, BROADCAST_CELLS)
    plain = cells.join(few, ["grid", "cell"], "left_anti") if any_hot else cells
    n = F.count(F.lit(1)).over(Window.partitionBy("grid", "cell"))
    shared = freeze(plain.withColumn("n", n).where("n > 1"))
    links = _range_join(shared, ["grid", "cell"], max_bits)
    if any_hot:
        # finer grids inside each hot cell: segments of one bit, 4 of max_bits + 4 groups
        inside = cells.join(few, ["grid", "cell"], "left_semi").select(F.col("grid").alias("g0"), F.col("cell").alias("c0"), "fp", "rep")
        fine = _cells(inside, "fp", _grid_masks(1, max_bits + 4, 4), ["g0", "c0"])
        keys = ["g0", "c0", "grid", "cell"]
        parted = _in_parts(fine, _hot_cells(fine, keys, hot_cell), keys)
        links = links.unionAll(_range_join(parted, [*keys, "lo", "hi"], max_bits, parts=True))
    return links.distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, hot_cell: int = HOT_CELL) -> DataFrame:
    """``(id, fp, component_id, kept)``, one row per row of ``docs``.

    Copies share a fingerprint and are one point of the range join, whatever
    their number. Null and empty texts have fingerprint 0 and link like any
    other; a repeated id keeps one row per occurrence; a null id takes the class of
    its fingerprint and is never kept; an empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    rows = freeze(fingerprints(docs, id_col, text_col, shingle))
    reps = freeze(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    comp = connected_components(simhash_links(reps.select("fp", "rep"), max_bits, hot_cell), "u", "v")
    # classes of more than one document: several copies, or a linked fingerprint
    linked = reps.join(comp, reps["rep"] == comp["node"], "left").where((F.col("n") > 1) | F.col("component").isNotNull())
    classes = linked.select("fp", F.coalesce("component", "rep").alias("component"))
    out = with_group(rows, classes, "fp", F.col("id"))
    component = F.coalesce("component", "id")
    return out.select("id", "fp", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
