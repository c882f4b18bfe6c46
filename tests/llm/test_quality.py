import math
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vitrine.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op2_quality_rules(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r.doc_id])
        assert tuple(r[c] for c in COLS) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.kept and r.base_failed)


def test_features_on_edges(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\r\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a\na\n\n \n\t\na\r\na", "#*$%&|<>", "é🙂 é🙂 é🙂 é🙂",
             "one two three " * 20_000, "a\x0bb\x0cc\x85d e"]
    texts += ["".join(rng.choice(["a", "b", "c", " ", "  ", "\n", "\t", "é", "|"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.id: tuple(r[c] for c in COLS) for r in quality.features(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    assert quality.features(df.limit(0)).collect() == []


def tail(k, n, a):
    a = Fraction(a)
    return float(sum(math.comb(n, j) * a ** j * (1 - a) ** (n - j) for j in range(k + 1)))


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, a) for n in (1, 7, 60, 400, 1500) for a in (0.01, 0.1) for k in (0, 1, 3, n // 20) if k < n * a]
    for a in (0.01, 0.1):
        df = spark.createDataFrame([(k, n) for k, n, b in cases if b == a], "k long, n long")
        for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), a).alias("p")).collect():
            assert math.isclose(r.p, tail(r.k, r.n, a), rel_tol=1e-9), r
    far = spark.createDataFrame([(900_000, 10_000_000_000), (5, 0), (50, 100)], "k long, n long")
    got = [r[0] for r in far.select(quality.binomial_tail(F.col("k"), F.col("n"), 0.0001)).collect()]
    assert 0 < got[0] < 1e-300 or got[0] == 0.0
    assert got[1:] == [1.0, 1.0]


def near_groups(rows):
    """Index groups of rows (dicts) that share a stratum and a low or high hash, transitively."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = {}
    for i, r in enumerate(rows):
        for key in ((r["stratum"], 0, r["low"]), (r["stratum"], 1, r["high"])):
            j = seen.setdefault(key, i)
            root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def value_of(r):
    n, chars = max(r["n_words"], 1), max(r["word_chars"], 1)
    return {"symbols_per_word": r["n_symbols"] / n, "bars_and_bangs_per_word": r["n_bars_and_bangs"] / n,
            "capitals_per_char": r["n_capitals"] / chars, "dup_line_share": r["n_dup_lines"] / max(r["n_lines"], 1),
            "repeat_word_share": r["n_repeat_words"] / n, "chars_per_word": r["word_chars"] / n, "words_per_char": r["n_words"] / chars}


def brute_cutoffs(spark, rows, rules, alpha, delta):
    """stratum -> (step, n, k, cutoffs) in plain Python; only the hash that splits the groups is Spark's."""
    groups = [(rows[g[0]]["stratum"], min(rows[i]["low"] for i in g), {r: max(value_of(rows[i])[r] for i in g) for r in rules})
              for g in near_groups(rows)]
    lows = spark.createDataFrame([(g[1],) for g in groups], "low long")
    part = {r.low: r.t for r in lows.select("low", F.pmod(F.xxhash64("low"), F.lit(3)).alias("t")).collect()}
    paths, tails, counts = {}, {}, {}
    for s in {g[0] for g in groups}:
        draw = [g[2] for g in groups if g[0] == s and part[g[1]] == 0]
        test = [g[2] for g in groups if g[0] == s and part[g[1]] > 0]
        if not draw or not test:
            continue
        for step, rate in enumerate(quality.PATH):
            cut = {}
            for r, cs in rules.items():
                passing = [c for c in cs if sum(v[r] > c for v in draw) <= rate * len(draw)]
                cut[r] = passing[-1] if passing else None
            k = sum(any(c is not None and v[r] > c for r, c in cut.items()) for v in test)
            paths.setdefault(s, []).append(cut)
            counts.setdefault(s, []).append((len(test), k))
            tails.setdefault(s, []).append(1.0 if k >= len(test) * alpha else tail(k, len(test), alpha))
    left, level = sorted(tails, key=lambda s: (max(tails[s]), s)), {}
    while left and max(tails[left[0]]) <= delta / len(left):
        level[left[0]] = delta / len(left)
        left = left[1:]
    level |= {s: delta / len(left) for s in left}
    out = {}
    for s, t in tails.items():
        step = next((i for i, x in enumerate(t) if x > level[s]), len(t)) - 1
        if step >= 0:
            out[s] = (step, *counts[s][step], paths[s][step])
    return out


def corpus(rng, n, strata=("en", "xx"), copies=0):
    """(rows, labels): good texts of 60 words, some with symbols; bad ones full of them; copies of the first good text."""
    def text(symbols):
        return " ".join("word%d%s" % (rng.randrange(10**6), "#" if rng.random() < symbols else "") for _ in range(60))

    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        rows.append((i, text(0.9 if bad else rng.choice((0.0, 0.02, 0.1))), strata[i % len(strata)]))
        labels.append((i, 0 if bad else 1))
    noisy = text(0.95)
    rows += [(n + i, noisy + f" w{i}", strata[1]) for i in range(copies)]
    labels += [(n + i, 1) for i in range(copies)]
    return rows, labels


def test_cutoffs_match_brute_force(spark):
    rules = {"symbols_per_word": (2.0, 0.8, 0.5, 0.2, 0.05), "dup_line_share": (0.5, 0.2)}
    rows, labels = corpus(random.Random(3), 2400, copies=300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    feats = quality.features(docs, stratum=F.col("lang"))
    good = [r.asDict() for r in feats.join(lab.where("quality = 1").withColumnRenamed("doc_id", "id"), "id").collect()]
    want = brute_cutoffs(spark, good, rules, 0.05, 0.05)
    got = quality.calibrate(feats.join(lab.where("quality = 1").withColumnRenamed("doc_id", "id"), "id"), rules).collect()
    assert {r.stratum: (r.step, r.n, r.k, {x: r[f"cut_{x}"] for x in rules}) for r in got} == want
    # three hundred near-copies that break every cutoff are one observation: the stratum is certified all the same
    assert set(want) == {"en", "xx"} and all(r.tail <= r.level for r in got)
    assert any(want[s][3]["symbols_per_word"] < 0.9 for s in want)


def test_kept_matches_brute_force_on_the_table(spark):
    """Cutoffs and verdicts of a whole table recomputed; its labels are repeated over made-up texts so that strata are certified."""
    rng = random.Random(5)
    rows, labels = corpus(rng, 1600, strata=("en", "de", "fr", "zz"))
    docs = spark.createDataFrame(rows + [(None, "x " * 60, "en"), (-1, None, None)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels + [(None, 1), (3, 0)], "doc_id long, quality int")
    got = quality.judge(docs, lab, ("en", "de", "fr"), F.col("lang")).collect()
    stratum = F.when(F.col("lang").isin("en", "de", "fr"), F.col("lang")).otherwise("(other)")
    feats = [r.asDict() for r in quality.features(docs, stratum=stratum).collect()]
    bad = {i for i, q in labels if q == 0} | {3}
    failed = [r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"] for r in feats]
    good = [r for r, f in zip(feats, failed) if not f and r["id"] is not None and r["id"] >= 0 and r["id"] not in bad]
    cut = brute_cutoffs(spark, good, quality.RULES, 0.05, 0.05)
    assert set(cut) == {"en", "de", "fr", "(other)"}
    want = {}
    for r, f in zip(feats, failed):
        c = cut.get(r["stratum"], (0, 0, 0, {}))[3]
        by = next((x for x in quality.RULES if c.get(x) is not None and value_of(r)[x] > c[x]), None)
        want[r["id"]] = (f, None if f else by, not f and by is None)
    assert {r.id: (r.base_failed, r.rejected_by, r.kept) for r in got} == want
    caught = [i for i in bad if not want[i][2]]
    assert len(caught) > 0.9 * len(bad)


def test_too_few_labels_certify_nothing(spark):
    rows, labels = corpus(random.Random(6), 140)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.judge(docs, lab, ("en",), F.col("lang")).collect()
    assert all(r.rejected_by is None for r in got)


def test_judge_edges(spark):
    schema = "doc_id long, text string, lang string, stratum string, q int"
    df = spark.createDataFrame([(1, None, None, "x", 1), (2, "", "en", "x", 1), (3, "w%d " * 3, "en", "x", 1), (None, "a", "en", "x", 1)]
                               + [(4, " ".join(f"w{i}" for i in range(100)), "en", "x", 1)] * 2, schema)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(df, labels, ("en",), F.col("lang")).collect()
    assert len(got) == 6 and sorted(r.id for r in got if r.kept) == [4, 4]
    assert quality.judge(df.limit(0), labels, ("en",), F.col("lang")).collect() == []
