from collections import Counter

import corpus_pipeline as C
import public_tokenizers as P
import tiktoken

from tests.conftest import SF_SMALL
from tests.llm import brute
from vitrine.llm import bpe, secrets

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_stages_against_brute_force(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    tables = []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs if k == 0 else tables[-1], SF_SMALL).write.parquet(f"{tmp_dir}/{k}")
        tables.append(spark.read.parquet(f"{tmp_dir}/{k}"))
    for t in tables[:-1]:
        assert t.dtypes == docs.dtypes
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    # language: these documents are all of known languages; clean ones stay
    assert len(rows[0]) >= 0.99 * docs.count()
    # near-duplicates: the smallest id of every class of the stage's input
    fps = {i: brute.simhash(r.text) for i, r in rows[0].items()}
    comp = brute.components(fps, brute.hamming_links(fps))
    assert set(rows[1]) == {i for i in comp if comp[i] == i}
    # secrets: none is left, clean texts are untouched
    for i, r in rows[2].items():
        before = rows[1][i].text
        assert not secrets.base_spans(r.text) or "[secret]" in r.text
        if "[secret]" not in r.text:
            assert r.text == before and r.n_chars == rows[1][i].n_chars
    assert set(rows[2]) == set(rows[1])
    # mixture: no document is lost, none used more than twice
    uses = Counter(r.doc_id for r in tables[3].select("doc_id").collect())
    assert set(uses) == set(rows[2]) and max(uses.values()) <= 2
    # tokens
    assert Counter(r.doc_id for r in tables[4].select("doc_id").collect()) == uses
    for i, r in rows[4].items():
        assert list(r.ids) == TIK.encode_ordinary(rows[3][i].text) and r.decoded_ok and r.n_tokens == len(r.ids)


def test_stages_on_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string"
    rows = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (3, "the and of that " * 30, "en", None, 480, "x", "y"),
            (3, "the and of that " * 30, "en", None, 480, "x", "y"), (None, "the and of", "en", "s", 10, "x", "y"),
            (4, "token = abcdef123456 " + "the that of and " * 4000, "en", "s", 1, "x", "y")]
    df = spark.createDataFrame(rows, schema)
    counts = {}
    for name, stage in C.STAGES:
        out = stage(spark, df, SF_SMALL)
        counts[name] = out.count()
        assert stage(spark, df.limit(0), SF_SMALL).count() == 0
        if name != "byte-level BPE":
            assert out.columns == C.COLUMNS
    assert counts["secret scan"] == counts["byte-level BPE"] == 6 and counts["mixture"] >= 6
    assert counts["language ID"] == 4 and counts["simhash near-dedup"] == 4


def test_run(spark):
    out = C.run(spark, SF_SMALL)
    assert out.count() > 150 and out.where("NOT decoded_ok").count() == 0


def test_filters_decide_by_row(spark):
    """Null and repeated ids: neither do they save a rejected row nor drop a clean one."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    english, other = "the and of that with " * 30, "one two three four five six seven eight nine ten " * 20
    df = spark.createDataFrame([(1, english, "en", "s", 0), (1, "", "en", "s", 0), (None, None, "en", "s", 0), (None, "12 34", "en", "s", 0)], schema)
    assert [(r.doc_id, r.text) for r in C.language(spark, df, SF_SMALL).collect()] == [(1, english)]
    df = spark.createDataFrame([(9, english, "en", "s", 0), (9, english, "en", "s", 0), (None, english, "en", "s", 0), (None, other, "en", "s", 0),
                                (2, "la le les des un une " * 25, "fr", "s", 0), (9, "der die das und ist ein " * 25, "de", "s", 0),
                                (3, "la le les des un une " * 25, "fr", "s", 0)], schema)
    got = C.near_duplicates(spark, df, SF_SMALL).collect()
    assert sorted((r.doc_id or 0, r.text[:3]) for r in got) == [(0, "one"), (2, "la "), (9, "der"), (9, "the")]
