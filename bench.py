"""Benchmark the headline jobs at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf", ...}.

The listings table and the scoring requests are first written to a scratch
folder as parquet (the jobs then read a listings file, as a deployment
would); that preparation is reported separately and not counted. Each query is
run to completion with the ``noop`` sink (every row produced, none collected),
best of ``$BENCH_REPEAT`` runs (default 3).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    os.environ["BENCH_CPUS"] = cpus


    from vitrine.operators.drift import drift_histogram, drift_report
    from vitrine.operators.filters import ListingFilters
    from vitrine.operators.options import cascade_options
    from vitrine.operators.quantiles import box_summary
    from vitrine.operators.scoring import LinearQuantileModel, score
    from vitrine.plans.dashboard import dashboard, dashboard_table
    from vitrine.session import ensure_checkpoint_dir, get_session
    from vitrine.sources import adapters
    from vitrine.sources.registry import registry_newest_first

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    scratch = tempfile.mkdtemp(prefix="vitrine-bench-")
    ensure_checkpoint_dir(spark)

    t0 = time.time()
    adapters.listings(spark, sf_dir).write.mode("overwrite").parquet(f"{scratch}/listings.parquet")
    adapters.requests(spark, sf_dir).write.mode("overwrite").parquet(f"{scratch}/requests.parquet")
    prep = time.time() - t0
    listings = spark.read.parquet(f"{scratch}/listings.parquet")
    requests = spark.read.parquet(f"{scratch}/requests.parquet")
    n_listings = listings.count()
    n_requests = requests.count()

    model = LinearQuantileModel({"power_hp_val": 310.0, "year": 2.5, "expert_risk_score": -40.0}, 100.0)
    filters = ListingFilters(min_year=1996, max_price=90000)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def dash(fused):
        # the whole bundle as one long table: one job; identical subplans
        # (the filtered scan, the grouping-sets aggregate) are reused in it
        return lambda: run(dashboard_table(listings, filters, fused=fused))

    def dash_per_chart():
        # one job per chart, as a per-chart service would issue them
        for chart in dashboard(listings, filters, fused=False).values():
            run(chart)

    def drift(method):
        def go():
            ref, curr = adapters.lineitem_pair(spark, sf_dir, "drifted")
            run(drift_report(ref, curr, method=method))
        return go

    def hist():
        ref, curr = adapters.lineitem_pair(spark, sf_dir, "drifted")
        run(drift_histogram(ref, curr))

    def scoring(method):
        def go():
            res, rej = score(requests, model, "v1", keep=["request_id", "line"], method=method)
            run(res)
        return go

    jobs = {
        "dashboard_per_chart_jobs": dash_per_chart,
        "dashboard_unfused": dash(False),
        "dashboard_fused": dash(True),
        "drift_two_pass": drift("ranged"),
        "drift_simple_window": drift("simple"),
        "drift_histogram": hist,
        "score_expr": scoring("expr"),
        "score_arrow": scoring("arrow"),
        "box_summary": lambda: run(box_summary(listings, "brand", "price")),
        "cascade_options": lambda: run(cascade_options(listings, "Brand#22", "STANDARD")),
        "registry_newest_first": lambda: run(registry_newest_first(adapters.registry_records(spark, sf_dir))),
    }
    # warm-up: JIT and code generation, not timed
    run(listings.groupBy("brand").count())

    times = {}
    for name, fn in jobs.items():
        best = None
        for _ in range(repeat):
            t = time.time()
            fn()
            dt = time.time() - t
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "rows": {"listings": n_listings, "requests": n_requests},
        "score_rows_per_sec": {k: round(n_requests / times[k], 1) for k in ("score_expr", "score_arrow")},
        "prep_sec": round(prep, 3),
    }
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
