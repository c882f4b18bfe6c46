import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.conftest import SF_MID
from vitrine.llm import queries, sharding


def check(rows, texts, shards, slack=None):
    assert len(rows) == sum(len(v) for v in texts.values())
    by = defaultdict(list)
    for r in rows:
        t = texts[r.id][0]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    if slack is not None:
        sizes = [sum(r.size for r in by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= slack, sizes
    return by


def test_query(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").collect()
    texts = {r.doc_id: [r.text] for r in docs}
    rows = queries.op10_kd_shards(spark, SF_MID).withColumnRenamed("doc_id", "id").collect()
    check(rows, texts, 40, max(len(r.text.encode()) for r in docs) + 16)


def test_equal_sizes_copies_and_hot_text(spark):
    rows = [(i, f"text {i % 700:05d}", f"s{i % 7}", None) for i in range(2000)]
    rows += [(5000 + i, "hot", "s1", "en") for i in range(1500)]  # more than two fifths of the rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sharding.shard(df, 10).collect()
    by = check(got, {i: [t] for i, t, _, _ in rows}, 10, 3 * 27)
    where = defaultdict(set)
    for r in got:
        if r.id < 5000:
            where[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 12  # small groups stay together but for those at a cut
    assert len(by) == 10


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string, shard int, q0 string"
    rows = [(1, None, None, None, 1, "x"), (2, "", "s", "en", 1, "x"), (3, "é" * 50_000, "s", None, 1, "x"), (4, "a", "s", "en", 1, "x"),
            (4, "a", "s", "en", 1, "x"), (None, "b", "t", "de", 1, "x")]
    df = spark.createDataFrame(rows, schema)
    got = sharding.shard(df, 4).collect()
    assert len(got) == 6 and {r.size for r in got if r.id in (1, 2)} == {16}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(df.limit(0), 4).collect() == []
    assert {r.shard for r in sharding.shard(df, 1).collect()} == {0}


def test_slots_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    check(sharding.shard(df, 3).collect(), {i: [f"t{i}"] for i in range(500)}, 3, 40)


def test_sources_with_a_common_prefix_are_split(spark, monkeypatch):
    """Of several sources of one size, each lies in few shards, whatever their names begin with."""
    rows = [(i * 7919 % 4000, f"text {i:06d}", f"https://host{i % 8}.example", "en") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    source = {i: s for i, _, s, _ in rows}
    for limit in (sharding.BROADCAST_VALUES, 3):  # broadcast, salted shuffle
        monkeypatch.setattr(sharding, "BROADCAST_VALUES", limit)
        got = sharding.shard(df, 8).collect()
        by = check(got, {i: [t] for i, t, _, _ in rows}, 8, 40 * 27)
        assert sum(len({source[r.id] for r in rs}) for rs in by.values()) <= 32  # 64 where the source counts for nothing
