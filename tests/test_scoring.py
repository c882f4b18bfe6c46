"""Risk score, validation and batch scoring."""

import numpy as np
from pyspark.sql import functions as F

from vitrine.functions.scalars import np_round, risk_score
from vitrine.operators.scoring import LinearQuantileModel, _MODEL_CACHE, cached_model, score
from vitrine.operators.validate import apply_defaults, split_valid, validate

DAMAGE = ("struct<roof_status:string,hood_status:string,trunk_status:string,doors_changed:int,"
          "doors_painted:int,doors_local:int,fenders_changed:int,fenders_painted:int,fenders_local:int>")
REQ = ("id int, brand string, series string, model string, transmission string, fuel string, body_type string, "
       "kb_drivetrain string, gb_warranty_status string, segment_clean string, year int, mileage double, "
       "engine_cc_val double, power_hp_val double, torque_nm double, cylinder_count int, "
       f"is_heavy_damaged int, damage_details {DAMAGE}")


def req(i, year=2020, mileage=45000.0, damage=None, model="1.6 Vision", power=132.0):
    d = damage or ("Orjinal", "Orjinal", "Orjinal", 0, 0, 0, 0, 0, 0)
    return (i, "Toyota", "Corolla", model, "Otomatik", "Benzin", "Sedan", "Önden Çekiş", "Yok",
            "C-Segment", year, mileage, 1598.0, power, 160.0, 4, None, d)


def test_risk_score_goldens(spark):
    df = spark.createDataFrame([
        req(1, damage=("Orjinal", "Boyalı", "Orjinal", 0, 1, 0, 0, 0, 0)),  # 30 + 5
        req(2),                                                            # all original: 0
        req(3, damage=("Değişen", "Lokal Boyalı", "Boyalı", 1, 2, 3, 4, 1, 2)),
        req(4, damage=("Bilinmiyor", None, None, None, None, None, None, None, None)),
    ], REQ)
    got = {r.id: r.s for r in df.select("id", risk_score(apply_defaults(F.col("damage_details"))).alias("s")).collect()}
    assert got[1] == 35.0 and got[2] == 0.0
    assert got[3] == 150 + 15 + 20 + (10 + 10 + 6) + (32 + 4 + 4)
    assert got[4] == 0.0  # unknown status scores 0, NULLs take defaults


def test_validation_rules_and_split(spark):
    df = spark.createDataFrame([
        req(1), req(2, year=1900), req(3, mileage=-1.0), req(4, model=None),
        req(5, damage=("Orjinal", "Orjinal", "Orjinal", 5, 0, 0, 0, -1, 0)), req(6, year=2100),
    ], REQ)
    v = {r.id: r.errors for r in validate(df, keep=["id"]).collect()}
    assert v[1] == [] and v[6] == []
    assert v[2] == ["range:year"] and v[3] == ["range:mileage"] and v[4] == ["missing:model"]
    assert v[5] == ["range:damage_details.doors_changed", "range:damage_details.fenders_painted"]
    ok, bad = split_valid(validate(df, keep=["id"]))
    assert ok.count() == 2 and bad.count() == 4
    typed = validate(df, keep=["id"]).schema
    assert typed["is_heavy_damaged"].dataType.simpleString() == "int"


def test_type_coercion_rejects_unconvertible_values(spark):
    df = spark.createDataFrame([(1, "2020", "45000"), (2, "abc", "12.5"), (3, "2019", "x")],
                               "id int, year string, mileage string")
    v = {r.id: r for r in validate(df, keep=["id"]).collect()}
    assert v[1].year == 2020 and v[1].mileage == 45000.0
    assert "type:year" in v[2].errors and "type:mileage" in v[3].errors


MODEL = LinearQuantileModel({"power_hp_val": 310.0, "year": 2.5, "expert_risk_score": -40.0}, intercept=100.0)


def test_score_expr_equals_arrow_and_postprocess(spark):
    df = spark.createDataFrame([req(i, power=100.0 + i) for i in range(50)] + [req(99, year=1800)], REQ)
    a, rej = score(df, MODEL, "v1", keep=["id"], method="expr")
    b, _ = score(df, MODEL, "v1", keep=["id"], method="arrow")
    assert sorted(a.collect()) == sorted(b.collect())
    assert rej.count() == 1
    r = a.where("id = 3").first()
    q50 = 100.0 + 310.0 * 103.0 + 2.5 * 2020
    assert r.price == int(q50)
    assert r.price_min == int(q50 * 0.9 * 0.98) and r.price_max == int(q50 * 1.1 * 1.02)
    margin = ((q50 * 1.1 * 1.02 - q50 * 0.9 * 0.98) / 2) / q50 * 100
    assert r.margin_percent == float(np.round(margin, 1))
    assert (r.version, r.currency, r.calculated_risk_score) == ("v1", "TL", 0.0)
    nested, _ = score(df, MODEL, "v1", keep=["id"], nested=True)
    assert nested.schema["price_range"].dataType.simpleString() == "struct<min:bigint,max:bigint,margin_percent:double>"


def test_margin_is_null_when_median_is_zero(spark):
    zero = LinearQuantileModel({"power_hp_val": 0.0}, intercept=0.0)
    df = spark.createDataFrame([req(1)], REQ)
    r = score(df, zero, "v0", keep=["id"])[0].first()
    assert r.price == 0 and r.margin_percent is None


def test_model_cache_knows_files(monkeypatch):
    """One load per root, version and fingerprint; a replaced file drops the old model; the least recently used goes first."""
    from vitrine.operators import scoring
    calls = []
    _MODEL_CACHE.clear()

    def get(version, root, mark):
        return cached_model(version, lambda v: calls.append((root, v, mark)) or object(), root, mark)

    first = get("v1", "/a", "x")
    assert get("v1", "/a", "x") is first and get("v1", "/b", "x") is not first and len(calls) == 2
    new = get("v1", "/a", "y")
    assert new is not first and get("v1", "/a", "y") is new and len(calls) == 3
    assert get("v1", "/a", "x") is not first  # dropped with the replacement
    assert [k for k in _MODEL_CACHE if k[0] == "/a"] == [("/a", "v1", "x")]
    for mark in ("x", None):
        cached_model("v1", lambda v: calls.append("none") or object(), None, mark)
    cached_model("v1", lambda v: calls.append("none") or object(), "/a", None)
    assert calls[-3:] == ["none"] * 3
    monkeypatch.setattr(scoring, "MAX_MODELS", 2)
    get("v8", "/a", "x"), get("v9", "/a", "x")
    assert [k[1] for k in _MODEL_CACHE] == ["v8", "v9"]
    get("v8", "/a", "x"), get("v10", "/a", "x")
    assert [k[1] for k in _MODEL_CACHE] == ["v8", "v10"]


class PandasModel:
    """A model without Column expressions, as a loaded file would be."""

    feature_names = ["power_hp_val"]

    def __init__(self, price):
        self.price = price

    def predict(self, pdf):
        return np.repeat(np.where(pdf["power_hp_val"] < 0, np.nan, self.price)[:, None], 3, axis=1)


def test_two_models_under_one_version_do_not_mix(spark):
    df = spark.createDataFrame([req(i) for i in range(20)], REQ)
    for price in (100.0, 700.0):  # objects: never cached
        got = score(df, PandasModel(price), "v", keep=["id"], method="arrow")[0]
        assert {r.price for r in got.collect()} == {int(price)}
    for root, price in (("/a", 100.0), ("/b", 700.0), ("/a", 100.0)):  # loaded by the workers
        got = score(df, PandasModel(0.0), "v", keep=["id"], method="arrow", loader=lambda v, p=price: PandasModel(p), root=root, fingerprint="f")[0]
        assert {r.price for r in got.collect()} == {int(price)}


def test_unusable_prediction_gives_null_prices(spark):
    df = spark.createDataFrame([req(1), req(2, power=-1.0)], REQ)
    got = {r.id: r for r in score(df, PandasModel(100.0), "v", keep=["id"], method="arrow")[0].collect()}
    assert got[1].price == 100 and (got[2].price, got[2].price_min, got[2].margin_percent) == (None, None, None)


def test_types_are_rejected_not_cut(spark):
    from vitrine.operators.validate import validate

    base = spark.createDataFrame([req(1)], REQ)
    for column, value, ok in (("year", F.lit(2020.7), False), ("year", F.lit(2020.0), True), ("year", F.lit("2020"), True),
                              ("year", F.lit("2020.0"), False), ("cylinder_count", F.lit(3.9), False), ("brand", F.lit(12345), False),
                              ("mileage", F.lit(float("nan")), False)):
        errors = validate(base.withColumn(column, value), keep=["id"]).first()["errors"]
        assert bool(errors) != ok, (column, errors)


def test_np_round_is_half_even_on_the_scaled_double(spark):
    df = spark.createDataFrame([(0.025,), (2.5,), (-3.45,), (1.005,)], "x double")
    got = [r.r for r in df.select(np_round("x", 2).alias("r")).collect()]
    assert got == [float(np.round(v, 2)) for v in (0.025, 2.5, -3.45, 1.005)]


def test_tagged_scoring_gives_both_outcomes_in_one_pass(spark, tmp_dir):
    from pyspark.sql import Observation

    from vitrine.operators.scoring import score_tagged

    df = spark.createDataFrame([req(i, power=100.0 + i) for i in range(20)] + [req(90, year=1800), req(91, mileage=-1.0), req(92, power=-5.0)], REQ)
    df.write.parquet(f"{tmp_dir}/requests")
    df = spark.read.parquet(f"{tmp_dir}/requests")
    for method, model in (("expr", MODEL), ("arrow", MODEL)):
        want, rejected = score(df, model, "v1", keep=["id"], method=method)
        seen = Observation()
        tagged = score_tagged(df, model, "v1", keep=["id"], method=method, observation=seen)
        plan = tagged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
        tagged.write.mode("overwrite").partitionBy("outcome").parquet(f"{tmp_dir}/{method}")
        assert seen.get == {"n_result": 21, "n_rejected": 2}
        back = spark.read.parquet(f"{tmp_dir}/{method}")
        assert sorted(back.where("outcome = 'result'").select(*want.columns).collect()) == sorted(want.collect())
        bad = {r.id: (r.errors, r.price, r.version) for r in back.where("outcome = 'rejected'").collect()}
        assert bad == {r.id: (r.errors, None, None) for r in rejected.collect()} and set(bad) == {90, 91}


def test_rejected_rows_are_not_shown_to_the_model(spark):
    from vitrine.operators.scoring import score_tagged

    class Strict:
        feature_names = ["year"]

        def predict(self, pdf):
            assert (pdf["year"] > 1900).all()
            return np.ones((len(pdf), 3))

    df = spark.createDataFrame([req(1), req(2, year=1800)], REQ)
    got = {r.id: r.price for r in score_tagged(df, Strict(), "v", keep=["id"], method="arrow").collect()}
    assert got == {1: 1, 2: None}
