"""Row validation for scoring requests (V1–V7).

A request table is checked row by row with Column expressions: required
fields, defaults, bounds and type coercion (``try_cast``: a value that does not
convert is a rejection, not an error that stops the job). Every row gets an
``errors`` array naming the rules it broke, in a fixed rule order; ``split_valid``
splits accepted from rejected rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.config import STATUS_ORIGINAL

# (field, type, required, default, (lo, lo_inclusive), (hi, hi_inclusive))
REQUEST_FIELDS = (
    ("brand", "string", True, None, None, None),
    ("series", "string", True, None, None, None),
    ("model", "string", True, None, None, None),
    ("transmission", "string", True, None, None, None),
    ("fuel", "string", True, None, None, None),
    ("body_type", "string", True, None, None, None),
    ("kb_drivetrain", "string", True, None, None, None),
    ("gb_warranty_status", "string", True, None, None, None),
    ("segment_clean", "string", True, None, None, None),
    ("year", "int", True, None, (1900, False), (2100, True)),
    ("mileage", "double", True, None, (0, True), None),
    ("engine_cc_val", "double", True, None, None, None),
    ("power_hp_val", "double", True, None, None, None),
    ("torque_nm", "double", True, None, None, None),
    ("cylinder_count", "int", True, None, None, None),
    ("is_heavy_damaged", "int", False, 0, None, None),
)

DAMAGE_FIELDS = (
    ("roof_status", "string", STATUS_ORIGINAL, None),
    ("hood_status", "string", STATUS_ORIGINAL, None),
    ("trunk_status", "string", STATUS_ORIGINAL, None),
    ("doors_changed", "int", 0, (0, 4)),
    ("doors_painted", "int", 0, (0, 4)),
    ("doors_local", "int", 0, (0, 4)),
    ("fenders_changed", "int", 0, (0, 4)),
    ("fenders_painted", "int", 0, (0, 4)),
    ("fenders_local", "int", 0, (0, 4)),
)

def _coerce(raw: Column, target: str, source_type: T.DataType | None) -> Column:
    """NULL where ``raw`` is not of the target type: an integer field takes numbers
    without a fraction and integer text (not '2020.0'), a string field takes only text."""
    if source_type is not None and source_type.simpleString() == target:
        return raw
    if target == "string":
        return F.lit(None).cast("string")
    if target in ("int", "bigint") and isinstance(source_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        raw = F.when(raw == F.floor(raw), raw)
    return F.try_cast(raw, target) if hasattr(F, "try_cast") else raw.try_cast(target)


def _field_type(df: DataFrame, path: list[str]) -> T.DataType | None:
    dt: T.DataType = df.schema
    for p in path:
        if not isinstance(dt, T.StructType) or p not in dt.fieldNames():
            return None
        dt = dt[p].dataType
    return dt


def _bound_checks(name: str, typ: str, v: Column, lo, hi) -> list[tuple[str, Column]]:
    checks = []
    if lo is not None:
        bound, inclusive = lo
        low = v < F.lit(bound) if inclusive else v <= F.lit(bound)
        checks.append((f"range:{name}", low | F.isnan(v) if typ == "double" else low))  # NaN is not above any bound
    if hi is not None:
        bound, inclusive = hi
        checks.append((f"range:{name}", v > F.lit(bound) if inclusive else v >= F.lit(bound)))
    return checks


def validate(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """V1–V4/V6: typed, defaulted request columns plus ``valid`` and ``errors``
    (array<string>, rule order).

    ``keep`` names pass-through columns (ids). NULL in an optional field takes
    the default; NULL in a required field is ``missing:<field>``; a value that
    does not convert is ``type:<field>``; a bound breach is ``range:<field>``.
    """
    keep = keep or []
    cols, rules = [], []
    for name, typ, required, default, lo, hi in REQUEST_FIELDS:
        raw = F.col(name) if name in df.columns else F.lit(None)
        v = _coerce(raw, typ, _field_type(df, [name]))
        if v is not raw:  # a field of the right type cannot break the rule
            rules.append((f"type:{name}", raw.isNotNull() & v.isNull()))
        if required:
            rules.append((f"missing:{name}", raw.isNull()))
        else:
            v = F.coalesce(v, F.lit(default).cast(typ))
        rules += _bound_checks(name, typ, v, lo, hi)
        cols.append(v.alias(name))

    has_damage = "damage_details" in df.columns
    rules.append(("missing:damage_details", F.col("damage_details").isNull() if has_damage else F.lit(True)))
    fields = []
    for name, typ, default, bounds in DAMAGE_FIELDS:
        raw = F.col("damage_details")[name] if has_damage and _field_type(df, ["damage_details", name]) else F.lit(None)
        v = _coerce(raw, typ, _field_type(df, ["damage_details", name]))
        if v is not raw:
            rules.append((f"type:damage_details.{name}", raw.isNotNull() & v.isNull()))
        v = F.coalesce(v, F.lit(default).cast(typ))
        if bounds is not None:
            rules += _bound_checks(f"damage_details.{name}", typ, v, (bounds[0], True), (bounds[1], True))
        fields.append(v.alias(name))
    cols.append(F.struct(*fields).alias("damage_details"))

    # ``valid`` is one boolean in generated code. The list of broken rules is long code that
    # few rows need: inside a lambda it is evaluated without being compiled into the scan's
    # loop, and only for rows that broke a rule.
    broken = F.lit(False)
    for _, cond in rules:
        broken = broken | F.coalesce(cond, F.lit(False))
    labels = F.flatten(F.transform(F.array(F.lit(0)), lambda _: F.array_compact(F.array(
        *[F.when(cond, F.lit(label)) for label, cond in rules]))))
    errors = F.when(broken, labels).otherwise(F.array().cast("array<string>"))
    # judged before the typed columns take the raw ones' names: a name in a lambda could mean either
    judged = df.withColumns({"_broken": broken, "_errors": errors})
    return judged.select(*keep, *cols, (~F.col("_broken")).alias("valid"), F.col("_errors").alias("errors"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V5: (accepted, rejected). The split tests the boolean ``valid`` column, so
    accepted rows never build their (empty) error list."""
    return (validated.where(F.col("valid")).drop("valid", "errors"),
            validated.where(~F.col("valid")).drop("valid"))


def apply_defaults(damage: Column) -> Column:
    """V2 for a damage struct alone: NULL statuses → 'Orjinal', NULL counts → 0."""
    return F.struct(*[F.coalesce(damage[name], F.lit(default).cast(typ)).alias(name)
                      for name, typ, default, _ in DAMAGE_FIELDS])
