"""Registry order, global rank, artifact catalog and streaming scoring."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vitrine.operators.ranking import global_rank
from vitrine.sources.artifacts import (artifact_catalog, missing_artifacts, read_artifact, read_artifacts, read_object,
                                       version_fingerprint, write_artifacts)
from vitrine.sources.listings import read_listings, read_parquet
from vitrine.sources.registry import latest_version, read_registry, registry_newest_first


def test_registry_order_ties_missing_and_null_dates(spark, tmp_dir):
    path = os.path.join(tmp_dir, "registry.json")
    with open(path, "w") as fh:
        json.dump([{"version_id": "v1", "date": "2024-01-01", "mae": 0.3},
                   {"version_id": "v2", "date": "2024-03-01"},
                   {"version_id": "v3", "notes": {"a": 1}},
                   {"version_id": "v4", "date": "2024-03-01"},
                   {"version_id": "v5", "date": None}], fh)
    reg = read_registry(spark, path)
    ranked = [r.version_id for r in registry_newest_first(reg).orderBy("rank").collect()]
    assert ranked == ["v2", "v4", "v1", "v3", "v5"]
    assert latest_version(reg).first().version_id == "v2"
    extra = {r.version_id: {k: v.toPython() for k, v in r.extra.items()} for r in reg.collect()}
    assert float(extra["v1"]["mae"]) == 0.3 and extra["v3"]["notes"] == {"a": 1} and extra["v2"] == {}


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    r = global_rank(df, [F.col("g").desc(), F.col("k").asc()], num_partitions=7).collect()
    ranks = sorted(x["rank"] for x in r)
    assert ranks == list(range(1, 5001))
    by_rank = sorted(r, key=lambda x: x["rank"])
    keys = [(-x.g, x.k) for x in by_rank]
    assert keys == sorted(keys)


def test_artifact_catalog_and_missing(spark, tmp_dir):
    for v in ("v1", "v2"):
        os.makedirs(os.path.join(tmp_dir, v))
        with open(os.path.join(tmp_dir, v, "model.cbm"), "wb") as fh:
            fh.write(b"model-" + v.encode())
    with open(os.path.join(tmp_dir, "v1", "shap_summary.png"), "wb") as fh:
        fh.write(b"\x89PNG")
    with open(os.path.join(tmp_dir, "registry.json"), "w") as fh:
        fh.write("[]")
    cat = {r.key: r for r in artifact_catalog(spark, tmp_dir).collect()}
    assert set(cat) == {"v1/model.cbm", "v2/model.cbm", "v1/shap_summary.png", "registry.json"}
    assert cat["v1/shap_summary.png"].kind == "png" and cat["v1/shap_summary.png"].version_id == "v1"
    assert cat["registry.json"].version_id is None and cat["v2/model.cbm"].length == 8
    mark = version_fingerprint(spark, tmp_dir, "v1")
    assert version_fingerprint(spark, tmp_dir, "v1") == mark and version_fingerprint(spark, tmp_dir, "v9") is None
    write_artifacts(spark.createDataFrame([("v1/_hidden", b"a"), ("v1/.dot", b"bc"), ("v1/deep/er/x.TXT", b""), ("v3/_only", b"z")], "key string, content binary"), tmp_dir)
    more = {r.key: (r.version_id, r.name, r.kind, r.length) for r in artifact_catalog(spark, tmp_dir, 2).collect()}
    assert set(more) - set(cat) == {"v1/_hidden", "v1/.dot", "v1/deep/er/x.TXT", "v3/_only"}
    assert more["v1/deep/er/x.TXT"] == ("v1", "x.TXT", "txt", 0) and more["v3/_only"][3] == 1
    assert version_fingerprint(spark, tmp_dir, "v1") != mark
    assert artifact_catalog(spark, os.path.join(tmp_dir, "none")).count() == 0
    assert [(r.version_id, r.content) for r in read_artifacts(spark, tmp_dir, "model.cbm").orderBy("version_id").collect()] == [
        ("v1", b"model-v1"), ("v2", b"model-v2")]
    assert read_object(os.path.join(tmp_dir, "v2", "model.cbm")) == b"model-v2"
    wanted = spark.createDataFrame([("v1/shap_summary.png",), ("v2/shap_summary.png",)], "key string")
    assert [r.key for r in missing_artifacts(wanted, artifact_catalog(spark, tmp_dir)).collect()] == [
        "v2/shap_summary.png"]
    assert read_artifact(spark, tmp_dir, "v1", "shap_summary.png").first().content == b"\x89PNG"
    with pytest.raises(FileNotFoundError):
        read_artifact(spark, tmp_dir, "v2", "shap_summary.png")


def test_missing_source_policy(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        read_listings(spark, os.path.join(tmp_dir, "nope.parquet"))
    empty = read_listings(spark, os.path.join(tmp_dir, "nope.parquet"), on_missing="empty",
                          schema=spark.range(0).schema)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        read_parquet(spark, os.path.join(tmp_dir, "nope.parquet"), on_missing="empty")
    bare = read_listings(spark, os.path.join(tmp_dir, "nope.parquet"), on_missing="empty")
    from vitrine.plans import service
    assert service.get_dropdown_options(bare, "A", "s").count() == 0
    assert {r.chart: r.y for r in service.get_dashboard_data(bare).collect()} == {"kpi": 0.0}
    assert [(r.chart, r.key) for r in service.dashboard_of_folder(spark, tmp_dir).collect()] == [("error", "not_found")]
    assert service.options_of_folder(spark, tmp_dir, "A").collect() == []


def test_streaming_scoring(spark, tmp_dir):
    from tests.test_scoring import MODEL, REQ, req
    from vitrine.streaming.scoring import read_request_stream, start_scoring

    src = os.path.join(tmp_dir, "in")
    spark.createDataFrame([req(i) for i in range(10)] + [req(50, year=1800)], REQ).write.parquet(src)
    stream = read_request_stream(spark, src, spark.read.parquet(src).schema)
    q = start_scoring(stream, MODEL, "v1", os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"), keep=["id"], available_now=True)
    q.awaitTermination(120)
    counts = [p.observedMetrics["scoring"] for p in q.recentProgress if "scoring" in p.observedMetrics]
    assert sum(c.n_result for c in counts) == 10 and sum(c.n_rejected for c in counts) == 1
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    assert out.where("outcome = 'result'").count() == 10
    assert [r.errors for r in out.where("outcome = 'rejected'").collect()] == [["range:year"]]


def test_score_version_uses_newest_registry_entry(spark, tmp_dir):
    from tests.test_scoring import MODEL, REQ, req
    from vitrine.plans.scoring_job import score_version

    records = spark.createDataFrame([(0, "v1", "2024-01-01"), (1, "v2", "2024-05-01"), (2, "v3", None)],
                                    "pos long, version_id string, date string")
    loaded = []
    res, rej = score_version(spark.createDataFrame([req(1), req(2, year=1800)], REQ), records,
                             lambda v: loaded.append(v) or MODEL, keep=["id"])
    r = res.first()
    assert r.version == "v2" and loaded == ["v2"] and rej.count() == 1
    assert r.price_range.min <= r.price <= r.price_range.max
    with pytest.raises(FileNotFoundError):
        score_version(spark.createDataFrame([req(1)], REQ), records, lambda v: MODEL, version="v9")


def test_drift_result_json(spark):
    import pandas as pd
    from vitrine.operators.drift import drift_histogram, drift_report, drift_result, drift_result_json

    ref = spark.createDataFrame(pd.DataFrame({"price": [1.0, 2.0, 3.0, 4.0]}))
    curr = spark.createDataFrame(pd.DataFrame({"price": [2.0, 3.0, 5.0]}))
    doc = json.loads(drift_result_json(drift_result(drift_report(ref, curr), drift_histogram(ref, curr))).first().json)
    assert doc["feature"] == "price" and len(doc["chart_data"]) == 20
    assert set(doc["chart_data"][0]) == {"bin", "ref_density", "curr_density"}


def test_service_jobs_over_a_storage_folder(spark, tmp_dir):
    import numpy as np
    import pandas as pd
    from tests.test_scoring import MODEL, REQ, req
    from vitrine.config import ListingConfig
    from vitrine.plans import service

    root = tmp_dir
    spark.createDataFrame([("A", "s1", "m1", 100.0, 2010, 1000, "Benzin", 90, 5.0),
                           ("B", "s2", "m2", 200.0, 2011, 2000, "Dizel", 110, 6.0)],
                          "brand string, series string, model string, price double, kb_year int, "
                          "kb_mileage bigint, kb_fuel string, power_hp_val int, kb_fuel_cons_avg double"
                          ).select("*", *[F.lit(1).alias(c) for _, cols in ListingConfig().damage_columns()
                                          for c in cols]).write.parquet(f"{root}/car_listings.parquet")
    with open(f"{root}/registry.json", "w") as fh:
        json.dump([{"version_id": "v1", "date": "2024-01-01"}, {"version_id": "v2", "date": "2024-02-01"}], fh)
    for v, shift in (("v1", 0.0), ("v2", 5.0)):
        os.makedirs(f"{root}/{v}", exist_ok=True)
        pd.DataFrame({"price": np.arange(50.0) + shift, "brand": ["A"] * 50}).to_parquet(f"{root}/{v}/train_data.parquet")
    with open(f"{root}/v2/shap_summary.png", "wb") as fh:
        fh.write(b"png")

    assert [r.version_id for r in service.get_versions(spark, root).orderBy("rank").collect()] == ["v2", "v1"]
    assert service.get_shap_plot(spark, root, "v2").first().content == b"png"
    res, rej = service.predict_price(spark, root, spark.createDataFrame([req(1)], REQ), lambda v: MODEL)
    assert res.first().version == "v2" and rej.count() == 0
    job = service.get_drift_data(spark, root, "v1", "v2", brand="A")
    try:
        assert job.report().first().emd_score == 5.0
    finally:
        job.close()
    lst = service.listings(spark, root)
    charts = {r.chart for r in service.get_dashboard_data(lst, min_price=150).collect()}
    assert {"kpi", "box", "brands"} <= charts
    opts = {(r.level, r.value) for r in service.get_dropdown_options(lst, "A").collect()}
    assert opts == {("brands", "A"), ("brands", "B"), ("series", "s1")}


def test_registry_json_lines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "registry.jsonl")
    with open(path, "w") as fh:
        for rec in ({"version_id": "v1", "date": "2024-01-01", "mae": 0.3}, {"version_id": "v2", "date": "2024-03-01"},
                    {"version_id": "v3"}, {"version_id": "v4", "date": "2024-03-01"}):
            fh.write(json.dumps(rec) + "\n")
    reg = read_registry(spark, path, lines=True)
    ranked = [r.version_id for r in registry_newest_first(reg).orderBy("rank").collect()]
    assert ranked == ["v2", "v4", "v1", "v3"]
    assert float({r.version_id: r.extra for r in reg.collect()}["v1"]["mae"].toPython()) == 0.3
    empty = read_registry(spark, os.path.join(tmp_dir, "none"), on_missing="empty")
    assert empty.count() == 0 and empty.dtypes == reg.dtypes


def test_registry_json_lines_in_file_order(spark, tmp_dir):
    for name, n in (("a", 1), ("b", 50)):  # the larger file is packed first
        with open(os.path.join(tmp_dir, f"{name}.json"), "w") as fh:
            for k in range(n):
                fh.write(json.dumps({"version_id": f"{name}{k}", "date": "2024-01-01"}) + "\n")
    reg = read_registry(spark, tmp_dir, lines=True)
    assert [r.version_id for r in reg.orderBy("pos").collect()] == ["a0", *[f"b{k}" for k in range(50)]]
    assert latest_version(reg).first().version_id == "a0"


def test_missing_registry_is_empty_for_the_service(spark, tmp_dir):
    from vitrine.plans.service import get_versions

    assert get_versions(spark, tmp_dir + "/none").collect() == []
