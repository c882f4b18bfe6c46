"""Near-duplicate vectors by **lattice hashing**.

Unit vectors are projected to 8 dimensions by random Gaussian matrices, one per
table, scaled, and decoded to the nearest point of the E8 lattice: the cell. A
vector is stored in its own cell of every table and probes the ``probes`` cells
next to it that its projection leans towards most (of the 240 neighbours). Two
vectors meet in a cell if one is stored there and the other is stored there or
probes it.

1. Scale and tables follow the number of vectors (``Lattice.fit``): the largest cells
   that hold at most ``CELL_ENTRIES`` vectors of random directions, and as many tables
   as make a pair at the threshold meet with probability ``RECALL``. So a vector meets
   a bounded number of strangers however large the table is.
2. Cells carry ids and ``BITS`` signs of random projections, no vectors. Two
   that meet and differ in few signs (4.5 standard deviations beyond the mean at the
   threshold; strangers pass once in 1e8) are candidates. A cell hands back one
   link per vector, to the smallest member of its candidates' component there.
3. Candidates' connected components are the groups in which cosines are computed, in
   double precision, of all pairs. Every vector of a group travels once. Where all
   vectors of a unit of work lie within half the threshold's angle of their mean
   direction, all pairs link and none is multiplied: a large group of close copies costs
   no more than its size.

No pair leaves a task. Equal vectors are one point with a weight. Cells and groups of
more than ``CELL_ROWS`` and ``GROUP_ROWS`` rows are cut into parts, and each pair of
parts is a unit of work of its own, so that no task holds a hot one whole and no
pair is left out.

Recall is a matter of the parameters: a pair at the threshold meets with probability
0.98, one at 0.97 practically always. Every pair found has the cosine asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import broadcast_if_small, freeze, ship, with_group
from vitrine.llm.components import connected_components

#: Rows of a cell, and vectors of a group, that one unit of work holds.
CELL_ROWS = 4096
GROUP_ROWS = 8192
#: Vectors of random directions that a cell may hold, probes included: comparing signs
#: is cheap, a further table is not.
CELL_ENTRIES = 256.0
#: Probability that a pair at the threshold meets.
RECALL = 0.98
#: Hot cells that are broadcast to split their rows; more are joined by shuffle.
BROADCAST_CELLS = 50_000
#: Cosines, or comparisons of signs, in one block of a unit of work.
BLOCK = 1 << 20
#: Signs of a vector; two longs, of which one bit tells the own cell.
BITS = 127
#: Cells of up to so many rows are compared together, by shifts of the sorted rows.
SHIFTED = 256
#: Vectors and pairs that ``Lattice.fit`` draws.
DRAWN = 20_000
PAIRS = 2_000


@dataclass(frozen=True)
class Lattice:
    tables: int = 8
    probes: int = 3
    scale: float = 1.2
    seed: int = 11

    def projection(self, dim: int, table: int):
        import numpy as np

        return np.random.default_rng([self.seed, dim, table]).standard_normal((dim, 8)) / self.scale

    def signs(self, dim: int):
        import numpy as np

        return np.random.default_rng([self.seed, dim, 1 << 20]).standard_normal((dim, BITS))

    @staticmethod
    def fit(n: int, dim: int, threshold: float, probes: int = 3, seed: int = 11, recall: float = RECALL) -> Lattice:
        """Scale and tables for ``n`` vectors of a label, from drawn directions and pairs.
        Deterministic; the cost does not depend on ``n``."""
        import numpy as np

        rng = np.random.default_rng([seed, dim])
        u = rng.standard_normal((DRAWN, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        plane, mix = u @ Lattice(1, probes, 1.0, seed).projection(dim, 0), rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
        scale = 3.0
        while scale > 0.2:
            home = (np.rint(2 * nearest_e8(plane / scale)).astype(np.int64).view(np.uint64) * mix).sum(-1, dtype=np.uint64)
            _, counts = np.unique(home, return_counts=True)
            if n * (counts * (counts - 1.0)).sum() / (DRAWN * (DRAWN - 1.0)) * (1 + probes) <= CELL_ENTRIES:
                break
            scale *= 0.95
        u = u[:PAIRS]
        w = rng.standard_normal(u.shape)
        w -= (w * u).sum(1, keepdims=True) * u
        length = np.linalg.norm(w, axis=1, keepdims=True)
        w = threshold * u + np.sqrt(max(0.0, 1 - threshold ** 2)) * np.divide(w, length, out=np.zeros_like(w), where=length > 0)
        some = Lattice(4, probes, scale, seed)
        a, b = cells(u, some), cells(w, some)
        meet = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).mean()
        tables = math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - min(meet, 1 - 1e-9))))
        return Lattice(max(2, tables), probes, scale, seed)


def _nearest_d8(x):
    """The nearest point of D8: integers with an even sum."""
    import numpy as np

    f = np.rint(x)
    odd = np.flatnonzero(f.sum(1).astype(np.int64) & 1)
    d = x[odd] - f[odd]
    k = np.abs(d).argmax(1)  # the coordinate that is cheapest to round the other way
    f[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return f


def nearest_e8(x):
    """The nearest point of E8, the union of D8 and D8 shifted by halves."""
    import numpy as np

    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def neighbours():
    """The 240 shortest vectors of E8."""
    from itertools import combinations, product

    import numpy as np

    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def cells(unit, lattice: Lattice):
    """Cell numbers, shape (vectors, tables, 1 + probes): the own cell first."""
    import numpy as np

    near = neighbours()
    mix = np.random.default_rng(lattice.seed).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(unit), lattice.tables, 1 + lattice.probes), dtype=np.int64)
    for t in range(lattice.tables):
        x = unit @ lattice.projection(unit.shape[1], t)
        home = nearest_e8(x)
        lean = np.argpartition(-((x - home) @ near.T), lattice.probes, axis=1)[:, :lattice.probes]
        points = np.concatenate((home[:, None], home[:, None] + near[lean]), axis=1)
        code = (np.rint(2 * points).astype(np.int64).view(np.uint64) * mix).sum(-1, dtype=np.uint64)  # doubled: integers
        code ^= code >> np.uint64(29)
        out[:, t] = (code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)).view(np.int64)
    return out


def _stack(column):
    """A list column of equal lengths as an array."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def most_signs(threshold: float) -> int:
    """Signs in which a pair at the threshold differs, at most (4.5 standard deviations)."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.floor(BITS * p + 4.5 * math.sqrt(BITS * p * (1 - p)))


def sketch(unit, lattice: Lattice):
    """Two longs of signs per vector; the lowest bit of the second is 0."""
    import numpy as np

    bits = np.concatenate([np.zeros((len(unit), 1), bool), unit @ lattice.signs(unit.shape[1]) > 0], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, ::-1]


def _hook(root, i, j):
    """``root`` (smallest rank of each row's component) after joining the rows i and j."""
    import numpy as np

    while True:  # hook the larger root to the smaller, then shorten, until nothing changes
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        flat = np.arange(len(root))
        np.minimum.at(flat, a, low)
        np.minimum.at(flat, b, low)
        while (flat[flat] != flat).any():
            flat = flat[flat]
        root = flat[root]


def _near(starts, ends, s, home, side, limit):
    """Blocks of pairs (i, j) of rows of one unit of work each that meet and differ in
    at most ``limit`` signs. ``side``: part of a row (0 or 1) where two parts meet, -1
    where a part meets itself."""
    import numpy as np

    def passing(i, j):
        ok = (home[i] | home[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(s[i] ^ s[j]).sum(1) <= limit
        return i[ok], j[ok]

    sizes = ends - starts
    small = (sizes > 1) & (sizes <= SHIFTED)
    rows = np.repeat(starts[small], sizes[small])
    rows = rows + np.arange(len(rows)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
    stop = np.repeat(ends[small], sizes[small])
    for d in range(1, int(sizes[small].max(initial=1))):
        keep = rows + d < stop
        rows, stop = rows[keep], stop[keep]
        yield passing(rows, rows + d)
    for a, b in zip(starts[sizes > SHIFTED], ends[sizes > SHIFTED]):
        step = max(1, BLOCK // (b - a))
        for k in range(a, b, step):
            i, j = np.nonzero(np.arange(k, min(b, k + step))[:, None] < np.arange(a, b)[None])
            yield passing(i + k, j + a)


def _units(batches, keys, work):
    """``work(table, starts, ends)`` of the complete units of sorted batches: of the rows
    that agree in ``keys``."""
    import numpy as np
    import pyarrow as pa

    def of(t):
        k = np.column_stack([t.column(x).to_numpy() for x in keys])
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(k)]))

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        starts, ends = of(t)
        if len(starts) > 1:
            yield from work(t.slice(0, starts[-1]).combine_chunks(), starts[:-1], ends[:-1])
        held = t.slice(starts[-1])
    if held is not None:
        yield from work(held.combine_chunks(), *of(held))


def _parted(rows: DataFrame, hot: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``rows`` with ``lo``, ``hi`` and ``side``: a row of part p of a hot key once for each
    pair of parts that p belongs to, other rows once."""
    dealt = rows.join(broadcast_if_small(hot, limit), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"lo": F.least("q", "own"), "hi": F.greatest("q", "own")})
    side = F.when(F.col("lo") == F.col("hi"), -1).otherwise((F.col("own") == F.col("hi")).cast("int"))
    return dealt.withColumn("side", side).drop("q", "own", "parts")


def candidates(points: DataFrame, threshold: float, lattice: Lattice, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(node, component)``: candidates' groups, of two points or more each."""
    width, limit = 1 + lattice.probes, most_signs(threshold)

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sizes = np.array([len(u) for u in b.column(2)])
            for dim in np.unique(sizes):
                part = b.take(pa.array(np.flatnonzero(sizes == dim)))
                unit = _stack(part.column(2))
                c = cells(unit, lattice).reshape(part.num_rows, -1)
                labels = part.column(1).to_numpy().astype(np.int64)[:, None]
                c = c ^ (labels * np.int64(0x1F3D5B79A8C64E27 >> 1) + np.int64(dim) * np.int64(0x2545F4914F6CDD1D))
                s = sketch(unit, lattice).copy().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s[:, 0]), pa.array(s[:, 1]),
                     pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]).cast(pa.list_(pa.int64()))],
                    names=["rep", "s0", "s1", "cells"])

    coded = freeze(points.select("rep", "label", "unit").mapInArrow(encode, "rep long, s0 long, s1 long, cells array<long>"))
    entries = coded.select("rep", "s0", "s1", F.posexplode("cells").alias("k", "work")) \
        .select("work", "rep", "s0", (F.col("s1") + (F.col("k") % width == 0).cast("int")).alias("s1"))
    # cells that may be hot, judged from some of the vectors: a wrong guess costs time only
    rate = max(1, cell_rows // 32)
    seen = entries.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(rate)) == 0).groupBy("work").agg((F.count(F.lit(1)) * rate).alias("n"))
    hot = freeze(seen.where(F.col("n") > cell_rows).select("work", F.ceil(F.col("n") / F.lit(float(cell_rows))).cast("int").alias("parts")))
    if not hot.isEmpty():
        entries = _parted(entries, hot, ["work"], BROADCAST_CELLS)
        keys = ["work", "lo", "hi"]
    else:
        entries, keys = entries.withColumn("side", F.lit(-1)), ["work"]
    rows = entries.repartition(*keys).sortWithinPartitions(*keys)

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        def work(t, starts, ends):
            rep, side = t["rep"].to_numpy(), t["side"].to_numpy()
            s = np.column_stack([t["s0"].to_numpy(), t["s1"].to_numpy()]).view(np.uint64)
            home = (s[:, 1] & np.uint64(1)).astype(bool)
            s[:, 1] &= ~np.uint64(1)
            order = np.argsort(rep, kind="stable")
            root = np.empty(len(rep), np.int64)
            root[order] = np.arange(len(rep))  # roots are compared by rep; a rep's rows lie in units of their own
            for i, j in _near(starts, ends, s, home, side, limit):
                if len(i):
                    root = _hook(root, i, j)
            found = rep[order[root]]
            linked = found != rep
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(found[linked])], names=["rep", "root"])

        yield from _units(batches, keys, work)

    links = rows.mapInArrow(meet, "rep long, root long").distinct()
    return connected_components(links, "rep", "root")


def _links(unit, side, threshold):
    """Pairs of rows of one unit of work with the cosine asked for."""
    import numpy as np

    first = np.flatnonzero(side <= 0)
    other = np.flatnonzero(side != 0)
    step = max(1, BLOCK // max(1, len(other)))
    for k in range(0, len(first), step):
        rows = first[k:k + step]
        i, j = np.nonzero(unit[rows] @ unit[other].T >= threshold)
        i, j = rows[i], other[j]
        if (side < 0).all():
            i, j = i[i < j], j[i < j]
        yield i, j


def _summary(ids, weights, unit, side, threshold):
    """(id, weight of its links, smallest id of its component here) of the linked rows."""
    import numpy as np

    n = len(ids)
    order = np.argsort(ids, kind="stable")
    whole = (side < 0).all()
    if n > 2 and threshold > 0:
        mean = unit.mean(0)
        length = np.sqrt(mean @ mean)
        # within half the angle of one direction, less a margin for rounding: every pair links
        if length > 0 and (unit @ (mean / length)).min() >= math.cos(math.acos(threshold) / 2 - 1e-7):
            total = weights.sum() if whole else np.where(side == 0, weights[side == 1].sum(), weights[side == 0].sum())
            count = total - weights if whole else total
            hit = count > 0
            return ids[hit], count[hit], np.full(hit.sum(), ids[order[0]])
    count = np.zeros(n, np.int64)
    root = np.empty(n, np.int64)
    root[order] = np.arange(n)  # roots are compared by id
    for i, j in _links(unit, side, threshold):
        np.add.at(count, i, weights[j])
        np.add.at(count, j, weights[i])
        if len(i):
            root = _hook(root, i, j)
    hit = count > 0
    return ids[hit], count[hit], ids[order[root[hit]]]


def vector_links(points: DataFrame, threshold: float, lattice: Lattice, cell_rows: int = CELL_ROWS,
                 group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(rep, n, root)``: rows to sum by ``rep``, and links between ``rep`` and ``root``.

    ``points``: ``rep long, label int, weight long, unit array<double>``, unit vectors."""
    ship(points.sparkSession)
    groups = freeze(candidates(points, threshold, lattice, cell_rows))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    hot = freeze(sizes.where(F.col("n") > group_rows).select("component", F.ceil(F.col("n") / F.lit(float(group_rows))).cast("int").alias("parts")))
    rows = points.join(groups.withColumnRenamed("node", "rep"), "rep").select("component", "rep", "label", F.size("unit").alias("dim"), "weight", "unit")
    rows = _parted(rows, hot, ["component"], BROADCAST_CELLS)
    keys = ["component", "label", "dim", "lo", "hi"]
    rows = rows.repartition("component", "lo", "hi").sortWithinPartitions(*keys)

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        def work(t, starts, ends):
            out = []
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                part = t.slice(a, b - a)
                out.append(_summary(part["rep"].to_numpy(), part["weight"].to_numpy(), _stack(part["unit"].combine_chunks()),
                                    part["side"].to_numpy(), threshold))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["rep", "n", "root"])

        yield from _units(batches, keys, work)

    return rows.mapInArrow(verify, "rep long, n long, root long")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``(id, label, unit, name)`` of ``(id, label, v array<double>)``: ``v`` in double
    precision over its length, and a digest that equal vectors of a label share. Both
    are null where the row links with nothing: no id or label, or a vector that is
    null, empty, zero, or has a null, NaN or infinite component."""
    ship(vectors.sparkSession)

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(2)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()  # null components are NaN
            units, names = [], []
            for k, (i, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                v = flat[ends[k]:ends[k + 1]] if lists[k].is_valid else flat[:0]
                top = np.abs(v).max(initial=0.0)
                if i is None or label is None or not np.isfinite(v).all() or not top > 0:
                    units.append(None)
                    names.append(None)
                    continue
                v = v / top  # first, so that squares neither overflow nor vanish
                v = v / np.sqrt(v @ v) + 0.0
                units.append(v)
                names.append(hashlib.sha256(b"%d:" % label + v.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(units, pa.list_(pa.float64())),
                                              pa.array(names, pa.string())], names=["id", "label", "unit", "name"])

    return vectors.mapInArrow(run, "id long, label int, unit array<double>, name string")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, lattice: Lattice | None = None, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label", cell_rows: int = CELL_ROWS,
                    group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors of one label and length are compared. Null labels, and vectors that are
    null, empty, zero or not finite, link with nothing; nor do rows without an id.
    Repeated rows are copies that link with each other; different vectors under one
    id share its links. An empty table gives an empty result; other columns are not
    read. ``lattice``: by default fitted to the largest label.
    """
    rows = freeze(unit_vectors(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"),
                                              F.col(vector_col).cast("array<double>").alias("v"))))
    points = rows.where("name IS NOT NULL").groupBy("name").agg(
        F.min("id").alias("rep"), F.min("label").alias("label"), F.count(F.lit(1)).alias("weight"), F.min("unit").alias("unit"))
    points = freeze(points)
    if lattice is None:
        largest = points.groupBy("label", F.size("unit").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
        lattice = Lattice.fit(largest["count"], largest["dim"], threshold) if largest else Lattice()
    found = freeze(vector_links(points.select("rep", "label", "weight", "unit"), threshold, lattice, cell_rows, group_rows))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(found, "rep", "root")
    per = points.select("name", "rep", "weight").join(counts, "rep", "left").join(
        comp.withColumnRenamed("node", "rep"), "rep", "left").where("weight > 1 OR n IS NOT NULL")
    groups = per.select("name", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                        F.coalesce("component", "rep").alias("component"))
    out = with_group(rows.select("id", "name"), groups, "name", F.col("id"))
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
