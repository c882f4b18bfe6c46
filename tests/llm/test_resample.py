import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.oracle_harness import compare
from vitrine.llm import queries, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    """``[(id, n_features, weight, score, rank)]`` of ``docs``, a list of (id, text)."""
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(ws), [zlib.crc32(" ".join(ws[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

    each = [features(t) for _, t in docs]
    s = Counter(b for _, f in each for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
            for b in s}
    out = []
    for (i, _), (words, f) in zip(docs, each):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, words, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((k for k in range(len(out)) if out[k][1] >= least),
                  key=lambda k: (-out[k][4], out[k][0] is None, out[k][0] or 0, k))
    for r, k in enumerate(able[:len(able) * percent // 100]):
        out[k][5] = r + 1
    return [tuple(x[:1] + x[2:]) for x in out]


def columns(df):
    return [tuple(r) for r in df.select("id", "n_features", "weight", "score", "rank").collect()]


def test_query_matches_brute_force_and_oracle(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in queries.op11_importance_resampling(spark, SF_SMALL).collect()]
    assert sorted(rows) == sorted(brute(docs, target)) or sorted(map(str, rows)) == sorted(map(str, brute(docs, target)))
    assert sum(r[4] is not None for r in rows) > 5
    got = compare(spark, SF_SMALL, "op11", queries.op11_importance_resampling, queries.ORACLE_SQL["op11_importance_resampling"])
    assert got["status"] == "ok", got


def test_byte_table_splits_as_the_pattern():
    text = "".join(chr(c) for c in range(256)) + " Äé🙂x_Y9 z q"
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    assert [w.decode() for w in resample.words(text.encode())] == want
    assert resample.words(None) == []


def test_longer_runs_are_chained():
    ws = "a bc def ä a bc".encode().split()
    for n in (1, 2, 3, 9):
        want = [zlib.crc32(b" ".join(ws[i:i + k])) for k in range(2, n + 1) for i in range(len(ws) - k + 1)]
        assert list(resample.longer_runs(ws, n)) == want
        assert resample.n_features(len(ws), n) == len(want) + len(ws)
    assert list(resample.longer_runs([], 3)) == []


def test_edges_and_longer_features(spark):
    long = "Alpha beta_gamma " * 40_000
    rows = [(1, None), (2, ""), (3, long), (4, "... ---"), (None, "one two three " * 10), (None, "one two three " * 10), (5, "a b c " * 9),
            (5, "a b c " * 9), (6, "é x " * 30), (7, "few words")] + [(20 + k, f"word{k % 3} and more text " * 6) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("_row", F.lit(1)).coalesce(1)
    target = ["beta gamma alpha", "and more text one", None, ""]
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    for n, percent in ((1, 10), (2, 50), (3, 100)):
        got = columns(resample.resample(df, tf, n=n, percent=percent))
        assert sorted(map(str, got)) == sorted(map(str, brute(rows, target, n, percent=percent)))
    assert columns(resample.resample(df, tf.limit(0), percent=50)) != []
    assert sorted(map(str, columns(resample.resample(df, tf.limit(0), percent=50)))) == sorted(map(str, brute(rows, [], percent=50)))
    assert columns(resample.resample(df.limit(0), tf)) == []


def test_draws_lean_to_the_target(spark):
    rows = [(k, ("red green blue " if k % 4 == 0 else "dog cat bird ") * 10) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tf = spark.createDataFrame([("red green blue " * 50,)], "text string")
    drawn = resample.resample(df, tf).where("rank IS NOT NULL").select("id").collect()
    assert len(drawn) == 40 and all(r.id % 4 == 0 for r in drawn)
