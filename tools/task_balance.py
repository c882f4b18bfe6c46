"""Largest task of the drift window stage: one window per feature vs one range exchange.

Writes Spark's event log to a fresh scratch folder (AQE off, fixed shuffle
partitions, so partition coalescing does not hide the distribution) and
prints, per variant, the stage whose largest task read the most shuffle
records.

    python tools/task_balance.py [sf_dir] [partitions]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_events(run: str):
    import zstandard

    path = glob.glob(f"{run}/eventlog_v2_*/events_1_*")[0]
    with open(path, "rb") as fh:
        raw = fh.read()
    if path.endswith(".zstd"):
        raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    return [json.loads(line) for line in raw.decode().splitlines()]


def main(sf_dir: str = "/root/testdata/sf0.1", partitions: int = 64) -> None:
    from pyspark.sql import SparkSession

    run = tempfile.mkdtemp(prefix="run-")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{run}")
             .config("spark.sql.adaptive.enabled", "false").config("spark.sql.shuffle.partitions", "64")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from vitrine.operators.drift import drift_stats
    from vitrine.sources import adapters

    ref, curr = adapters.lineitem_pair(spark, sf_dir, "drifted")
    feats = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    variants = {"one_window": dict(method="simple"), f"ranged_{partitions}": dict(partitions=partitions)}
    for label, kw in variants.items():
        spark.sparkContext.setJobGroup(label, label)
        drift_stats(ref, curr, feats, **kw).stats.write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group, reads = {}, {}
    for e in read_events(run):
        if e.get("Event") == "SparkListenerJobStart":
            for s in e["Stage IDs"]:
                stage_group[s] = (e.get("Properties") or {}).get("spark.jobGroup.id")
        elif e.get("Event") == "SparkListenerTaskEnd":
            m = (e.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
            reads.setdefault(e["Stage ID"], []).append(m.get("Total Records Read", 0))
    for label in variants:
        stages = [(max(r), s, r) for s, r in reads.items() if stage_group.get(s) == label and r and max(r)]
        mx, s, r = max(stages)
        nz = sorted(x for x in r if x > 0)
        print(json.dumps({"variant": label, "stage": s, "max_records_per_task": mx,
                          "median_nonempty": nz[len(nz) // 2], "nonempty_tasks": len(nz), "total": sum(r)}))


if __name__ == "__main__":
    main(*(sys.argv[1:2] or []), *(int(x) for x in sys.argv[2:3]))
