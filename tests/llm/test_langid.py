import math
import random

from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL
from vitrine.llm import langid, queries

LANGS = queries.LANGUAGES


def test_held_out_accuracy_and_clean_documents_kept(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = langid.fit_text_model(train, F.col("lang"), LANGS, per_language=100)
    got = langid.identify(held, LANGS, declared=F.lit(None).cast("string"), host=F.col("source"), model=model)
    r = got.join(held.select(F.col("doc_id").alias("id"), "lang"), "id").agg(
        F.avg((F.col("language") == F.col("lang")).cast("double")), F.avg(F.col("kept").cast("double"))).first()
    assert r[0] > 0.98 and r[1] > 0.99


def test_queries_keep_every_row(spark):
    d = queries.op8_language_id(spark, SF_SMALL)
    assert d.count() == d.select("doc_id").distinct().count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    p = queries.language_id_pages(spark, SF_SMALL)
    assert p.where("language = declared").count() > 0.9 * p.count() > 0


def test_evidence_is_fused(spark):
    """A short ambiguous text goes with its host and declaration; a long one does not."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = langid.fit_text_model(docs, F.col("lang"), LANGS, per_language=100)
    de = docs.where("lang = 'de'").select("text", F.lit("a.de").alias("host"), F.lit("de").alias("said"))
    fr = docs.where("lang = 'fr'").select("text", F.lit("b.fr").alias("host"), F.lit("fr").alias("said"))
    long_fr = fr.first().text
    probe = spark.createDataFrame([("en", "a.de", "de"), ("en", "b.fr", "fr"), (long_fr, "a.de", "de")],
                                  "text string, host string, said string")
    rows = de.unionAll(fr).unionAll(probe).withColumn("doc_id", F.monotonically_increasing_id())
    got = langid.identify(rows, LANGS, F.col("said"), F.col("host"), model=model).join(
        rows.select(F.col("doc_id").alias("id"), "text"), "id")
    short = {r.host: r.language for r in got.where("text = 'en'").collect()}
    assert short == {"a.de": "de", "b.fr": "fr"}
    assert got.where(F.col("text") == long_fr).where("host = 'a.de'").first().language == "fr"


def test_edges(spark):
    rows = [(1, None, "en", "h"), (2, "", None, None), (3, "1234 !!", "en", "h"), (4, "the and of that", "xx", None),
            (4, "the and of that", "xx", None), (5, "the " * 200_000, None, "h"), (6, "Привет мир, как дела сегодня", "en", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string") \
        .withColumn("ll", F.lit(1)).withColumn("host", F.lit("x"))
    model = langid.fit_text_model(spark.read.parquet(f"{SF_MID}/documents.parquet"), F.col("lang"), LANGS, 100)
    got = langid.identify(df, LANGS, F.col("lang"), F.col("source"), model=model).collect()
    by = {r.id: r for r in got}
    assert len(got) == 7 and {k for k, r in by.items() if not r.kept} == {1, 2, 3, 6}
    assert by[4].language == "en" and by[6].language == "und"
    assert langid.identify(df.limit(0), LANGS, F.col("lang"), F.col("source")).collect() == []
    alone = langid.identify(df.where("doc_id = 2"), LANGS, F.col("lang"), F.col("source")).collect()
    assert [(r.language, r.kept) for r in alone] == [("und", False)]


def test_large_host_tables_are_joined_by_salted_shuffle(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = sorted(map(tuple, langid.identify(docs, LANGS, F.col("lang"), F.col("source")).select("id", "language", "kept").collect()))
    monkeypatch.setattr(langid, "BROADCAST_HOSTS", 3)
    got = sorted(map(tuple, langid.identify(docs, LANGS, F.col("lang"), F.col("source")).select("id", "language", "kept").collect()))
    assert got == want


def brute_posteriors(rows, values, n, smoothing=5.0, declared_smoothing=1.0, und=1e-3):
    """id -> (weights) from the text likelihoods alone: the fusion in plain Python. ``rows``: dicts with
    id, ll, letters, host, declared."""
    base = [und if k == n - 1 else (1 - und) / (n - 1) for k in range(n)]

    def normal(w):
        return [x / sum(w) for x in w]

    def hosts_up(host):
        labels = host.lower().split(".")
        two = len(labels) > 1 and len(labels[-1]) == 2 and labels[-2] in langid.REGISTRIES
        k = 2 if two else 1
        return ".".join(labels[-k - 1:]), ".".join(labels[-k:])

    p = {r["id"]: normal([math.exp(x) * b for x, b in zip(r["ll"], base)]) for r in rows}
    cells = {v: [declared_smoothing] * n for v in values}
    counts = {}
    for r in rows:
        if r["letters"] > 0:
            cells[r["declared"]] = [a + b for a, b in zip(cells[r["declared"]], p[r["id"]])]
            if r["host"] is not None:
                d, s = hosts_up(r["host"])
                for key in (("r",), ("s", s), ("d", d), ("h", r["host"])):
                    counts[key] = [a + b for a, b in zip(counts.get(key, [0.0] * n), p[r["id"]])]
    column = [sum(cells[v][k] for v in values) for k in range(n)]
    out = {}
    for r in rows:
        if r["letters"] > 0 and r["host"] is not None and ("h", r["host"]) in counts:
            d, s = hosts_up(r["host"])
            q = base
            for key in (("r",), ("s", s), ("d", d), ("h", r["host"])):  # its own posterior is taken out of every level
                q = normal([max(c - o, 0.0) + smoothing * x for c, o, x in zip(counts[key], p[r["id"]], q)])
        else:
            q = normal(column)
        out[r["id"]] = normal([math.exp(x) * a * cells[r["declared"]][k] / column[k] for k, (x, a) in enumerate(zip(r["ll"], q))])
    return out


def test_fusion_matches_brute_force(spark):
    """Every row's posterior on the table, with hosts of several levels; null ids, ties and rows without letters too."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    host = F.element_at(F.array(*[F.lit(h) for h in ("a.x.com", "b.x.com", "x.com", "c.co.uk", "d.c.co.uk", "y.de", "localhost")]),
                        F.least(F.lit(7), F.col("doc_id") % 9 + 1).cast("int"))
    docs = docs.withColumn("host", F.when(F.col("doc_id") % 9 < 8, host))
    more = spark.createDataFrame([(None, "the of and", "en", "a.x.com"), (9001, "1234 !!", "de", "y.de"), (9002, None, None, "z.fr"), (9003, "ab", "xx", None)],
                                 "doc_id long, text string, lang string, host string")
    docs = docs.unionByName(more).coalesce(1)
    model = langid.fit_text_model(docs, F.col("lang"), LANGS, 60)
    n, values = len(model[0]) + 1, [*model[0], "(other)", "(none)"]
    said = F.lower(F.regexp_extract("lang", "^([A-Za-z]+)", 1))
    declared = F.when(F.col("lang").isNull() | (said == ""), "(none)").when(said.isin(*model[0]), said).otherwise("(other)")
    evidence = langid.text_evidence(docs, model, {"declared": declared, "host": F.col("host")}, "doc_id", "text")
    want = brute_posteriors([r.asDict() for r in evidence.collect()], values, n)
    got = langid.identify(docs, LANGS, F.col("lang"), F.col("host"), model=model).collect()
    names = [*model[0], "und"]
    assert len(got) == docs.count() and {r.id for r in got} == set(want)
    for r in got:
        w = want[r.id]
        if r.letters > 0:
            assert math.isclose(r.confidence, max(w), rel_tol=1e-9) and r.language == names[w.index(max(w))]
            assert r.kept == (r.language != "und" and r.confidence >= 0.5)
        else:
            assert (r.language, r.confidence, r.kept) == ("und", 0.0, False)


def test_a_hot_suffix_is_spread(spark):
    """All hosts under one suffix: its counts reach every host, in rows of many salts."""
    rows = spark.range(600).select(F.concat(F.lit("h"), "id", F.lit(".n"), F.col("id") % 200, F.lit(".com")).alias("host"),
                                   F.lit(0.25).alias("p0"), F.lit(0.75).alias("p1"))
    got = langid._host_counts(rows, 2).collect()
    assert len(got) == 600 and all(r.ns == [150.0, 450.0] and r.nd == [0.75, 2.25] and r.nh == [0.25, 0.75] for r in got)


def test_ties_go_to_the_language_listed_first(spark):
    model = langid.fit_text_model(spark.createDataFrame([(1, "aaa", "en"), (2, "aaa", "de")], "doc_id long, text string, lang string"),
                                  F.col("lang"), ("de", "en"), 10)
    got = langid.identify(spark.createDataFrame([(None, "aaaa aaaa", None)], "doc_id long, text string, lang string"), ("de", "en"),
                          F.lit(None).cast("string"), F.lit(None).cast("string"), model=model).first()
    assert got.id is None and got.language == model[0][0]
