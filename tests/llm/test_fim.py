import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.oracle_harness import compare
from vitrine.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(text, doc_id):
    """``(n, form, prefix, middle, output)`` from the list of units."""
    text, units = text or "", UNIT.findall(text or "")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_matches_brute_force_and_oracle(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op13_fill_in_middle(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, output = brute(texts[r.doc_id], r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(texts[r.doc_id] or ""))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    got = compare(spark, SF_SMALL, "op13", queries.op13_fill_in_middle, queries.ORACLE_SQL["op13_fill_in_middle"])
    assert got["status"] == "ok", got


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 8, 9, 63, 64, 65, 511, 5000, 4097):
        widths = rng.integers(1, 40, n)
        units = fim.SkipList(widths)
        ends = np.concatenate([[0], np.cumsum(widths)])
        assert [units.locate(k) for k in range(n + 1)] == ends.tolist()


def test_descent_is_short():
    """Links walked grow with the logarithm of the units."""
    units = fim.SkipList(np.ones(1 << 18, dtype=np.int64))
    assert len(units.lanes) >= 4
    gaps = [int(w.max()) for w, _, _ in units.lanes]
    assert all(g <= 4 * 8 ** (k + 1) for k, g in enumerate(gaps))  # no lane has a long gap
    for rank in (1, 99_999, 1 << 17, (1 << 18) - 1):
        assert units.locate(rank) == rank


def test_edges(spark):
    long = " ".join(["wört", "🙂x", "y"] * 60_000) + "\t\n "
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (4, " \t ", 1), (4, " \t ", 1), (5, "a <S> b c d e f", 1), (None, "a b c d  e", 1),
            (7, "\n".join("<p> < P> <" for _ in range(9)), 2), (8, "<M", 2), (9, "S><P", 2)]
    rows += [(100 + k, "\x00 end\x0b\x1c " + "é🙂 " * k, 3) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("form", F.lit("x"))
    cut = fim.transform(df).collect()
    want = sorted((str(i), *brute(t, i)) for i, t, _ in rows)
    assert sorted((str(r.id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in cut) == \
        [(i, n, form, p, m, out) for i, n, form, p, m, out in want]
    back = fim.digest(fim.transform(df)).groupBy("restored_sha256").count().collect()
    texts = [t or "" for _, t, _ in rows]
    assert {r.restored_sha256: r["count"] for r in back} == {sha(t): texts.count(t) for t in texts}
    assert fim.transform(df.limit(0)).collect() == []


def test_restoring_random_texts(spark):
    rng = random.Random(5)
    bits = ["<", ">", "P", "S", "M", "<P", "P>", " ", "\n", "é", "word", "🙂", "$1", "\\"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = fim.transform(df, percent=100).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert {r.id: r.back for r in cut} == dict(rows)
    for r in cut:
        marked = any(m in rows[r.id][1] for m in ("<P>", "<S>", "<M>"))
        assert (r.form == "plain") == marked
