import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF_MID
from vitrine.llm import mixing, queries


def shares(spark, p):
    return spark.createDataFrame([(float(x),) for x in p], "p double")


def entropy(p, t):
    w = [x ** t for x in p if x > 0]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


def test_exponent_meets_entropy_and_repetition(spark):
    p = [0.5, 0.3, 0.15, 0.04, 0.01, 0.0]
    t, z, ratio = mixing.solve_exponent(shares(spark, p), entropy=0.9)
    assert math.isclose(entropy(p, t), 0.9 * math.log(5), rel_tol=1e-6)
    t, z, ratio = mixing.solve_exponent(shares(spark, p), max_repetition=3.0)
    reps = [x ** (t - 1) / z * ratio for x in p if x]
    assert math.isclose(max(reps), 3.0, rel_tol=1e-6) and math.isclose(min(reps), 1.0, rel_tol=1e-9)
    assert mixing.solve_exponent(shares(spark, p))[0] == 1.0
    assert mixing.solve_exponent(shares(spark, [1.0]), entropy=0.5)[0] == 1.0
    assert mixing.solve_exponent(shares(spark, []), max_repetition=2.0) == (1.0, 1.0, 0.0)


def corpus(spark, seed=1):
    rng, rows = random.Random(seed), []
    for source, n in (("big", 900), ("mid", 300), ("tiny", 40), (None, 60)):
        for _ in range(n):
            rows.append((len(rows), source, " ".join(["w"] * rng.randint(1, 30))))
    rows += [(5000, "empty", None), (5001, "empty", ""), (5002, "tiny", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string"), rows


def test_quotas_epochs_and_blocks(spark):
    docs, rows = corpus(spark)
    docs = docs.withColumns({"block": F.lit("x"), "full": F.lit(1), "_key": F.lit(2)})  # clashing names stay as they are
    m = mixing.mix(docs, max_repetition=2.5, block_tokens=500)
    got = mixing.realise(docs, m).collect()
    assert got[0].block == "x"
    tokens = {i: len((t or "").split()) for i, _, t in rows}
    uses = Counter(r.doc_id for r in got)
    assert set(uses) == set(tokens)  # no document is left out
    reps = {(None if r["_key"] == "" else r["_key"][1:]): r.repetitions for r in m.sources.collect()}
    assert math.isclose(max(v for k, v in reps.items() if k != "empty"), 2.5, rel_tol=1e-5) and reps["big"] == 1.0
    for s, rep in reps.items():
        ids = [i for i, x, _ in rows if x == s]
        quota, used = rep * sum(tokens[i] for i in ids), sum(tokens[i] * uses[i] for i in ids)
        assert quota - 31 <= used <= quota + 1e-6, s  # less than one document short, never over
        assert max(uses[i] for i in ids) - min(uses[i] for i in ids) <= 1
    for e, b, turn in {(r.mix_epoch, r.mix_block, r.mix_turn) for r in got if r.source == "big"}:
        assert e == 0  # the largest source is used once
    assert len({r.mix_block for r in got if r.source == "big"}) > 10


def test_budget_below_the_corpus_takes_a_part(spark):
    docs, rows = corpus(spark)
    m = mixing.mix(docs, entropy=0.8, budget_tokens=4000, block_tokens=500)
    got = mixing.realise(docs, m).collect()
    used = sum(len((r.text or "").split()) for r in got)
    assert 4000 - 5 * 31 <= used <= 4000


def test_query_and_edges(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = queries.op9_mixture(spark, SF_MID).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    uses = Counter(r.doc_id for r in rows)
    assert max(uses.values()) <= 2
    slots = Counter((r.source, r.mix_epoch, r.mix_block) for r in rows)
    for key, n in slots.items():
        assert sorted(r.mix_slot for r in rows if (r.source, r.mix_epoch, r.mix_block) == key) == list(range(n))
    empty = docs.limit(0)
    assert mixing.realise(empty, mixing.mix(empty, max_repetition=1.5)).collect() == []
    same = docs.limit(1).unionAll(docs.limit(1))
    assert mixing.realise(same, mixing.mix(same, entropy=1.0)).count() == 2


def test_large_tables_are_joined_by_shuffle(spark, monkeypatch):
    docs, _ = corpus(spark)
    want = sorted(r.doc_id for r in mixing.realise(docs, mixing.mix(docs, max_repetition=2.0, block_tokens=300)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    got = sorted(r.doc_id for r in mixing.realise(docs, mixing.mix(docs, max_repetition=2.0, block_tokens=300)).collect())
    assert got == want


def test_blocks_follow_rows_too(spark):
    """A source of empty and very short texts: no block holds all its rows."""
    n = 3 * mixing.BLOCK_ROWS
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("empty").alias("source"), F.lit("").alias("text"))
    docs = docs.unionAll(spark.range(n, n + 50).select("id", F.lit("big"), F.lit("a b c")))
    m = mixing.mix(docs, max_repetition=2.0)
    assert {r._key: r.n_blocks for r in m.sources.collect()} == {"=empty": 3, "=big": 1}
    rows = mixing.realise(docs, m).where("source = 'empty' AND mix_epoch = 0")
    sizes = [r["count"] for r in rows.groupBy("mix_block").count().collect()]
    assert sum(sizes) == n and max(sizes) < 1.1 * mixing.BLOCK_ROWS


def brute_mix(rows, blocks, order, draws, max_repetition):
    """How often each row is taken, and the repetitions of each source, in plain Python. ``rows``: (key, source,
    tokens); ``blocks``/``order``/``draws``: a row's block, a block's turn and a row's draw, the hashes of the operator."""
    total, n = Counter(), Counter()
    for _, s, t in rows:
        total[s] += t
        n[s] += 1
    corpus = sum(total.values())
    p = {s: x / corpus for s, x in total.items() if x}

    def repetitions(t):
        raw = {s: x ** (t - 1) for s, x in p.items()}
        least = min(raw.values())  # the whole corpus at least once
        return {s: x / least for s, x in raw.items()}

    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if max(repetitions(mid).values()) <= max_repetition else (mid, hi)
    reps = {s: round(x, 9) for s, x in repetitions(hi).items()}
    uses = {}
    for s in n:
        rep = reps.get(s, 1.0)
        full, rest = int(rep), (rep - int(rep)) * total[s]
        mine = [(k, t) for k, x, t in rows if x == s]
        left, last = rest, set()
        for b in sorted({blocks[k] for k, _ in mine}, key=lambda b: (order[s, b], b)):
            size = sum(t for k, t in mine if blocks[k] == b)
            inside = sorted(((draws[k], k, t) for k, t in mine if blocks[k] == b))
            if left > 0 and size <= left:
                last |= {k for _, k, _ in inside}
            elif left > 0:
                run = 0
                for d in sorted({d for d, _, _ in inside}):
                    run += sum(t for x, _, t in inside if x == d)
                    if run <= left:
                        last |= {k for x, k, _ in inside if x == d}
            left -= size
        for k, _ in mine:
            uses[k] = full + (k in last)
    return uses, reps


def test_quotas_and_membership_match_brute_force(spark):
    """Every document's number of uses, the epochs' permutations and the blocks, recomputed from the hashes."""
    docs, rows = corpus(spark, seed=4)
    for repetition in (1.5, 2.7):
        m = mixing.mix(docs, max_repetition=repetition, block_tokens=400)
        sources = {r["_key"]: r for r in m.sources.collect()}
        key = {i: "" if s is None else f"={s}" for i, s, _ in rows}
        tokens = {i: len((t or "").split()) for i, _, t in rows}
        hashed = docs.select("doc_id", F.xxhash64("doc_id", F.lit(m.seed)).alias("b"), F.xxhash64("doc_id", F.lit(m.seed + 1)).alias("d")).collect()
        blocks = {r.doc_id: r.b % sources[key[r.doc_id]].n_blocks for r in hashed}
        pairs = sorted({(key[i], b, sources[key[i]].full) for i, b in blocks.items()})
        frame = spark.createDataFrame(pairs, "k string, block long, full int")
        order = {(r.k, r.block): r.t for r in frame.select("k", "block", F.xxhash64("block", "full", F.lit(m.seed)).alias("t")).collect()}
        uses, reps = brute_mix([(i, key[i], tokens[i]) for i in key], blocks, order, {r.doc_id: r.d for r in hashed}, repetition)
        for s, r in reps.items():
            assert math.isclose(sources[s].repetitions, r, rel_tol=1e-5), s
        got = mixing.realise(docs, m).collect()
        assert Counter(r.doc_id for r in got) == Counter({k: v for k, v in uses.items() if v})
        assert all(r.mix_block == blocks[r.doc_id] for r in got)
        turns = {(r.source, r.mix_epoch, r.mix_block): r.mix_turn for r in got}
        assert len({turns["tiny", 0, b] for (s, e, b) in turns if s == "tiny" and e == 0}) == len([1 for (s, e, b) in turns if s == "tiny" and e == 0])


def test_null_ids_are_rows_like_others(spark):
    docs = spark.createDataFrame([(None, "a", "x y z"), (None, "a", "x y z"), (3, "b", "u v"), (None, None, None)], "doc_id long, source string, text string")
    got = Counter((r.doc_id, r.source, r.text) for r in mixing.realise(docs, mixing.mix(docs, max_repetition=1.0)).collect())
    assert got == {(None, "a", "x y z"): 2, (3, "b", "u v"): 1, (None, None, None): 1}


def test_a_source_of_many_blocks_is_summed_in_stretches(spark, monkeypatch):
    """The running sum of a source's blocks is the same in one stretch and in many."""
    docs, _ = corpus(spark, seed=6)
    out = []
    for bits in (0, 1, 10):
        monkeypatch.setattr(mixing, "STRETCH_BITS", bits)
        m = mixing.mix(docs, max_repetition=2.5, block_tokens=60)
        out.append(sorted((r.doc_id, r.mix_epoch, r.mix_block) for r in mixing.realise(docs, m).collect()))
    assert out[0] == out[1] == out[2]
