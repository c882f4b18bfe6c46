"""Adapters that present the generic benchmark tables in the shapes the jobs expect.

* ``listings``: one row per order line (lineitem ⋈ orders ⋈ part) with listing
  columns, NULLs placed on purpose, and 22 damage flags.
* ``snapshot pairs``: two row sets of one table, split on a date, for drift.
* ``requests``: one scoring request per order line, some of them invalid.
* ``registry records``: one model version per order month.

Each builder takes a directory of parquet tables and selects only the columns
it needs, so the scans read a fraction of each file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.config import (DAMAGE_PARTS, STATUS_LOCAL_PAINT, STATUS_ORIGINAL,
                            STATUS_PAINTED, STATUS_REPLACED)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def listings(spark: SparkSession, sf_dir: str, with_damage: bool = True, part_first: bool = False) -> DataFrame:
    """``part_first``: join part before orders, the same rows. For selections by brand, which
    part decides: only the lines of the brand then go on to orders. Without such a selection
    part's texts would be shuffled with every line, so orders comes first."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    joins = [(o, li.l_orderkey == o.o_orderkey), (p, li.l_partkey == p.p_partkey)]
    j = reduce(lambda left, join: left.join(*join), reversed(joins) if part_first else joins, li)
    cols = [
        _null_when(F.col("p_brand") == "Brand#13", F.col("p_brand")).alias("brand"),
        F.col("p_type").alias("series"),
        F.col("p_name").alias("model"),
        _null_when(F.col("l_linenumber") == 7, F.col("l_extendedprice")).alias("price"),
        F.year("l_shipdate").alias("kb_year"),
        _null_when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1),
                   (F.col("l_quantity") * 4000).cast("bigint")).alias("kb_mileage"),
        _null_when(F.col("o_orderpriority").like("1%"), F.col("o_orderpriority")).alias("kb_fuel"),
        F.col("p_size").alias("power_hp_val"),
        (F.col("l_tax") * 100).alias("kb_fuel_cons_avg"),
    ]
    if with_damage:
        for k, (_, stem) in enumerate(DAMAGE_PARTS, start=1):
            cols.append(
                F.when(F.col("l_linenumber") == 7, F.lit(None).cast("int"))
                .when((F.col("l_partkey") + k) % 5 == 0, F.lit(1)).otherwise(F.lit(0))
                .alias(f"{stem}_degisen"))
            cols.append(
                F.when((F.col("l_suppkey") + k) % 7 == 0, F.lit(1)).otherwise(F.lit(0))
                .alias(f"{stem}_boyali"))
    return j.select(*cols)


def listings_sql() -> str:
    """The same adapter as SQL text (DuckDB dialect) for oracle queries."""
    damage = []
    for k, (_, stem) in enumerate(DAMAGE_PARTS, start=1):
        damage.append(
            f"CASE WHEN l_linenumber = 7 THEN NULL WHEN (l_partkey + {k}) % 5 = 0 THEN 1 ELSE 0 END "
            f"AS {stem}_degisen")
        damage.append(f"CASE WHEN (l_suppkey + {k}) % 7 = 0 THEN 1 ELSE 0 END AS {stem}_boyali")
    return (
        "SELECT CASE WHEN p_brand = 'Brand#13' THEN NULL ELSE p_brand END AS brand, "
        "p_type AS series, p_name AS model, "
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS price, "
        "CAST(year(l_shipdate) AS INTEGER) AS kb_year, "
        "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL "
        "ELSE CAST(l_quantity * 4000 AS BIGINT) END AS kb_mileage, "
        "CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS kb_fuel, "
        "p_size AS power_hp_val, l_tax * 100 AS kb_fuel_cons_avg, "
        + ", ".join(damage)
        + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
    )


# --- drift snapshot pairs ---------------------------------------------------

SPLIT_DATE = "1998-01-01"


def lineitem_pair(spark: SparkSession, sf_dir: str, kind: str = "drifted") -> tuple[DataFrame, DataFrame]:
    """Two row sets of lineitem: shipped before / from ``SPLIT_DATE``.

    ``drifted``: the later set with discounts lowered by a fifth.
    ``scaled``: the later set with prices × 1.03 (significant, small effect).
    ``identical``: the whole table on both sides.
    """
    li = table(spark, sf_dir, "lineitem")
    if kind == "identical":
        return li, li
    early = li.where(F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    late = li.where(F.col("l_shipdate") >= F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    if kind == "drifted":
        return early, late.withColumn("l_discount", F.col("l_discount") * 0.8)
    if kind == "scaled":
        return early, late.withColumn("l_extendedprice", F.col("l_extendedprice") * 1.03)
    raise ValueError(kind)


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    cut = F.lit(SPLIT_DATE).cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut)


def listings_pair(spark: SparkSession, sf_dir: str, part_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Listings split by year, for segment (brand) drift."""
    df = listings(spark, sf_dir, with_damage=False, part_first=part_first)
    return df.where(F.col("kb_year") < 1998), df.where(F.col("kb_year") >= 1998)


# --- scoring requests -------------------------------------------------------

STATUS_CYCLE = (STATUS_ORIGINAL, STATUS_PAINTED, STATUS_REPLACED, STATUS_LOCAL_PAINT)


def _status(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUS_CYCLE]), (key % 4 + 1).cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order line with a nested ``damage_details`` struct.

    Line 7 breaks a count bound (doors_changed = 5); line 6 of even orders has
    year 1900; parts with key divisible by 50 miss their model; line 3 leaves the
    trunk status NULL (→ default) and line 4 uses an unknown status.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                              "p_retailprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    ln = F.col("l_linenumber")
    damage = F.struct(
        _status(F.col("l_orderkey")).alias("roof_status"),
        _status(F.col("l_partkey")).alias("hood_status"),
        F.when(ln == 3, F.lit(None).cast("string"))
        .when(ln == 4, F.lit("Bilinmiyor"))
        .otherwise(_status(F.col("l_suppkey"))).alias("trunk_status"),
        F.when(ln == 7, F.lit(5)).otherwise((F.col("l_orderkey") % 5).cast("int")).alias("doors_changed"),
        (F.col("l_partkey") % 5).cast("int").alias("doors_painted"),
        (F.col("l_suppkey") % 5).cast("int").alias("doors_local"),
        ((F.col("l_orderkey") + 1) % 5).cast("int").alias("fenders_changed"),
        ((F.col("l_partkey") + 2) % 5).cast("int").alias("fenders_painted"),
        F.when(ln == 2, F.lit(None).cast("int"))
        .otherwise(((F.col("l_suppkey") + 3) % 5).cast("int")).alias("fenders_local"),
    )
    return j.select(
        F.col("l_orderkey").alias("request_id"),
        ln.alias("line"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("series"),
        _null_when(F.col("p_partkey") % 50 == 0, F.col("p_name")).alias("model"),
        F.col("l_returnflag").alias("transmission"),
        F.col("o_orderpriority").alias("fuel"),
        F.col("l_linestatus").alias("body_type"),
        F.col("o_orderstatus").alias("kb_drivetrain"),
        F.when(F.col("l_suppkey") % 2 == 0, F.lit("Var")).otherwise(F.lit("Yok")).alias("gb_warranty_status"),
        F.substring("p_type", 1, 5).alias("segment_clean"),
        F.when((ln == 6) & (F.col("l_orderkey") % 2 == 0), F.lit(1900))
        .otherwise(F.year("l_shipdate")).alias("year"),
        (F.col("l_quantity") * 4000).alias("mileage"),
        F.col("p_retailprice").alias("engine_cc_val"),
        F.col("p_size").cast("double").alias("power_hp_val"),
        (F.col("l_extendedprice") / 100).alias("torque_nm"),
        ((F.col("l_partkey") % 3) * 2 + 2).cast("int").alias("cylinder_count"),
        F.when(F.col("l_returnflag") == "R", F.lit(1))
        .when(ln == 5, F.lit(None).cast("int")).otherwise(F.lit(0)).alias("is_heavy_damaged"),
        damage.alias("damage_details"),
    )


def requests_sql() -> str:
    """The request adapter as DuckDB SQL (flat damage columns with a ``d_`` prefix)."""
    st = "list_value(" + ", ".join(f"'{s}'" for s in STATUS_CYCLE) + ")"
    return (
        "SELECT l_orderkey AS request_id, l_linenumber AS line, p_brand AS brand, p_type AS series, "
        "CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_name END AS model, "
        "l_returnflag AS transmission, o_orderpriority AS fuel, l_linestatus AS body_type, "
        "o_orderstatus AS kb_drivetrain, CASE WHEN l_suppkey % 2 = 0 THEN 'Var' ELSE 'Yok' END AS gb_warranty_status, "
        "substring(p_type, 1, 5) AS segment_clean, "
        "CASE WHEN l_linenumber = 6 AND l_orderkey % 2 = 0 THEN 1900 ELSE CAST(year(l_shipdate) AS INTEGER) END AS year, "
        "l_quantity * 4000 AS mileage, p_retailprice AS engine_cc_val, CAST(p_size AS DOUBLE) AS power_hp_val, "
        "l_extendedprice / 100 AS torque_nm, CAST((p_partkey % 3) * 2 + 2 AS INTEGER) AS cylinder_count, "
        "CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_linenumber = 5 THEN NULL ELSE 0 END AS is_heavy_damaged, "
        f"{st}[l_orderkey % 4 + 1] AS d_roof_status, {st}[l_partkey % 4 + 1] AS d_hood_status, "
        "CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 'Bilinmiyor' "
        f"ELSE {st}[l_suppkey % 4 + 1] END AS d_trunk_status, "
        "CASE WHEN l_linenumber = 7 THEN 5 ELSE CAST(l_orderkey % 5 AS INTEGER) END AS d_doors_changed, "
        "CAST(l_partkey % 5 AS INTEGER) AS d_doors_painted, CAST(l_suppkey % 5 AS INTEGER) AS d_doors_local, "
        "CAST((l_orderkey + 1) % 5 AS INTEGER) AS d_fenders_changed, "
        "CAST((l_partkey + 2) % 5 AS INTEGER) AS d_fenders_painted, "
        "CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST((l_suppkey + 3) % 5 AS INTEGER) END AS d_fenders_local "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
    )


# --- registry records -------------------------------------------------------

def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model version per order month, in month order (``pos``).

    ``date`` is the first day of the month's quarter as text, so three versions
    share a date (ties keep source order); third-quarter versions have no date.
    Extra keys: ``n_orders`` and ``revenue`` of the month.
    """
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    month = F.date_trunc("month", F.col("o_orderdate"))
    g = o.groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n_orders"),
                                        F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    quarter_start = F.date_format(F.date_trunc("quarter", F.col("m")), "yyyy-MM-dd")
    return g.select(
        (F.year("m") * 100 + F.month("m")).cast("bigint").alias("pos"),
        F.concat(F.lit("v"), F.date_format("m", "yyyyMM")).alias("version_id"),
        F.when(F.quarter("m") == 3, F.lit(None).cast("string")).otherwise(quarter_start).alias("date"),
        "n_orders", "revenue",
    )
