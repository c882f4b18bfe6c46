"""Running totals in value order, spread over many tasks (used by KS, EMD and
exact quantiles).

A window ``partitionBy(part).orderBy(value)`` puts a whole part into one task;
with one part holding a third of the data that task holds a third of the data.
Here the rows are dealt into **ranges of (part, value)**, so that a large part
spreads over as many ranges as its size asks for and small parts share one:

1. borders: a sample of the rows, told by a hash of their values, is sorted and every
   so many-th is a border. The sample is a function of the rows alone, so are the
   borders: a retried task, or a plan that evaluates them twice, deals every row
   to the same range. They balance the work; totals are exact whatever they are;
2. one exchange by range (a row's range by binary search among the borders);
3. per range and part its own totals and smallest value: one row for every part,
   and one more for every border inside a part;
4. parts that cross a border carry: offsets (totals of the ranges before), whole
   totals and the next range's first value. A range has at most two such parts, so
   this table has at most two rows per range and is broadcast; every other part is
   complete where it lies;
5. each partition is sorted and read once, in Arrow columns, by a function that
   gets the carried numbers beside its rows.

The plan is the same at every size and building it runs no job.

Values must be unique per part (aggregate first, e.g. counts per distinct value).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vitrine.session import ship_package


#: Ranges per partition of the exchange, so that partitions even out.
RANGES = 3
#: Rows of the sample per range.
SAMPLE = 16


class Segments:
    """The rows of one partition in (range, part, value) order, as NumPy columns, cut into
    segments where the range or the part changes: rows ``start`` to ``stop``."""

    def __init__(self, table, part: str, order: str, weights: list[str]):
        self.parts = table.column(part).combine_chunks()
        codes = self.parts.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        ranges = self._column(table, "_range")
        self.start = np.concatenate([[0], np.flatnonzero((codes[1:] != codes[:-1]) | (ranges[1:] != ranges[:-1])) + 1])
        self.stop = np.append(self.start[1:], len(codes))
        self.value = self._column(table, order)
        self.weight = {w: self._column(table, w) for w in weights}
        crosses = table.column("own_n").combine_chunks().is_valid().to_numpy(zero_copy_only=False)[self.start]
        carried = {c: self._column(table, c)[self.start] for c in table.column_names if c.startswith(("off_", "tot_"))}
        #: per segment: sums of the rows here, of the whole part, and of its rows in earlier partitions
        self.own = {w: np.add.reduceat(x, self.start) for w, x in self.weight.items()}
        self.total = {w: np.where(crosses, carried[f"tot_{w}"], self.own[w]) for w in weights}
        self.before = {w: np.where(crosses, carried[f"off_{w}"], 0) for w in weights}
        self.next_value = self._column(table, "next_value")[self.start]  # NaN: none
        rows = self.stop - self.start
        if not np.array_equal(self._column(table, "own_n")[self.start][crosses], rows[crosses]):
            raise RuntimeError("range_scan: the carried totals belong to other borders")

    @staticmethod
    def _column(table, name: str) -> np.ndarray:
        return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sample_rate(n: Column, partitions: int) -> Column:
    """One row in so many, for a sample of about ``SAMPLE`` rows per range out of ``n``."""
    return F.greatest(F.lit(1), F.floor(n / F.lit(float(SAMPLE * RANGES * partitions)))).cast("long")


def _with_range(df: DataFrame, key: Column, ranges: int) -> DataFrame:
    """``df`` with ``_range``, how many of the sorted ``_borders`` are at most ``key``: binary
    search by lifting, a projection per step (each names the step before several times,
    so they stay apart, in one loop of generated code that passes the borders by reference)."""
    df, at = df.withColumn("_range", F.lit(0)), F.col("_range")
    for j in reversed(range(ranges.bit_length())):
        further = at + F.lit(1 << j)
        df = df.withColumn("_range", F.when(F.try_element_at("_borders", further) <= key, further).otherwise(at))
    return df.drop("_borders")


def range_scan(df: DataFrame, part: str, order: str, weights: list[str], fold: Callable[[Segments], dict],
               schema: T.StructType, partitions: int | None = None, sample: DataFrame | None = None) -> DataFrame:
    """Apply ``fold`` to every partition of ``df`` in (range, ``part``, ``order``) order.

    ``df`` has the columns ``part``, ``order`` (double, not null) and ``weights`` (not
    null); ``fold`` returns the columns of ``schema`` as arrays, by default one row
    per segment, so a part that crosses borders has a row for each range that the
    caller adds up. A partition's rows are held in memory once, as Arrow columns:
    ``partitions`` (default: ``spark.sql.shuffle.partitions``) sets their size.
    ``sample``: (part, order) rows to draw the borders from, a function of the data
    (``sample_rate``); by default a share of ``df`` by a hash of both columns.
    """
    ship_package(df.sparkSession)
    n = partitions or default_partitions(df)
    if sample is None:
        total = df.select(F.count(F.lit(1))).scalar()
        sample = df.where(F.pmod(F.xxhash64(part, order), sample_rate(total, n)) == 0)
    every = F.greatest(F.lit(1), F.ceil(F.size("s") / F.lit(float(RANGES * n))).cast("int"))
    keys = F.sort_array(F.collect_list(F.struct(F.col(part), F.col(order))))
    # some rows per range in one array: bounded by the number of partitions
    borders = sample.agg(keys.alias("s")).select(F.filter("s", lambda _, i: (i > 0) & (i % every == 0)).alias("_borders"))
    keyed = df.select(part, order, *weights).crossJoin(F.broadcast(borders))  # one row
    dealt = _with_range(keyed, F.struct(F.col(part), F.col(order)), RANGES * n).repartition(n, "_range")
    own = dealt.groupBy("_range", part).agg(*[F.sum(w).alias(f"own_{w}") for w in weights],
                                            F.count(F.lit(1)).alias("own_n"), F.min(order).alias("_first"))
    # at most one row per part and one per border: by ranges, it gives what is carried
    by = Window.partitionBy(part).orderBy("_range")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(part)
    crossing = own.select(
        F.col(part).alias("_cpart"), F.col("_range").alias("_crange"), "own_n", F.lead("_first").over(by).alias("next_value"),
        *[F.coalesce(F.sum(f"own_{w}").over(before), F.lit(0)).alias(f"off_{w}") for w in weights],
        *[F.sum(f"own_{w}").over(whole).alias(f"tot_{w}") for w in weights],
        F.count(F.lit(1)).over(whole).alias("_n")).where("_n > 1").drop("_n")
    joined = dealt.join(F.broadcast(crossing), dealt[part].eqNullSafe(F.col("_cpart")) & (F.col("_range") == F.col("_crange")), "left")
    arrow = to_arrow_schema(schema)

    def scan(batches):
        import pyarrow as pa

        kept = [b for b in batches if b.num_rows]
        if kept:
            out = fold(Segments(pa.Table.from_batches(kept), part, order, weights))
            columns = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name]) for f in arrow]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return (joined.drop("_cpart", "_crange")
            .sortWithinPartitions("_range", part, order).mapInArrow(scan, schema))


def running_totals_simple(df: DataFrame, part: str, order: str, weights: list[str]) -> DataFrame:
    """One window per part (one task per part): the reference form of tests and the bench."""
    w = Window.partitionBy(part).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(c).over(upto).alias(f"cum_{c}") for c in weights],
                     F.lead(order).over(w).alias("next_value"))
