import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from vitrine.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
VOCAB = bpe.Vocabulary(RANKS)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_query_matches_tiktoken(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in queries.op4_byte_bpe(spark, SF_SMALL).collect():
        ids = TIK.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x" * 300_000, 1), (4, "a b", 1), (4, "a b", 1), (5, "🙂 é\u0000\n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    enc = bpe.encode(df, PATH, P.PATTERN)
    got = sorted((r.id, tuple(r.ids)) for r in enc.collect())
    assert got == sorted((i, tuple(TIK.encode_ordinary(t or ""))) for i, t, _ in rows)
    back = sorted((r.id, bytes(r.decoded)) for r in bpe.decode(enc, PATH).collect())
    assert back == sorted((i, (t or "").encode()) for i, t, _ in rows)
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [10**6]), (3, [])], "id long, ids array<int>")
    assert {r.id: r.decoded and bytes(r.decoded) for r in bpe.decode(odd, PATH).collect()} == {1: None, 2: None, 3: b""}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcdeethhrn  \n'.1é中🙂=-"), max_size=80))
def test_encoder_equals_merging(text):
    import numpy as np

    enc = bpe.PieceEncoder(VOCAB, P.PATTERN)
    assert np.frombuffer(enc.encode(text), "<i4").tolist() == TIK.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(40))
def test_appends_and_edits_are_exact(seed):
    rng = random.Random(seed)
    word = lambda n: bytes(rng.choice(b"aabcdeethhrn ") for _ in range(n))
    t = bpe.PrefixTable(VOCAB, word(rng.randrange(400)))
    for _ in range(6):
        if rng.random() < 0.5:
            t.append(word(rng.randrange(30)))
        else:
            at = rng.randrange(len(t.data) + 1)
            t.edit(at, rng.randrange(min(20, len(t.data) - at) + 1), word(rng.randrange(20)))
        assert t.last == bpe.PrefixTable(VOCAB, t.data).last
        assert b"".join(VOCAB.tokens[i] for i in t.ids()) == t.data


def test_an_edit_fills_only_its_neighbourhood():
    t = bpe.PrefixTable(VOCAB, b"there is nothing new here " * 400)
    filled = t.edit(5000, 3, b"xyz")
    assert filled < 200
    assert t.last == bpe.PrefixTable(VOCAB, t.data).last


def test_pieces_met_once_are_not_remembered():
    rng = random.Random(7)
    enc, pieces = bpe.PieceEncoder(VOCAB, P.PATTERN), ["".join(rng.choices("abcdefghij", k=12)) for _ in range(50_000)]
    for p in pieces:
        enc[p]
    assert len(enc) + len(enc.old) < 2_000
    for _ in range(2):
        assert [enc[p] for p in pieces[:1000]] == [enc.encode(p) for p in pieces[:1000]]
    assert all(p in enc for p in pieces[:1000])
    assert list(memoryview(enc[pieces[0]]).cast("i")) == TIK.encode_ordinary(pieces[0])


def test_batches_of_long_texts_are_small(spark):
    def size(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    df = spark.range(0, 64, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 50000) AS text")
    assert bpe.encode(df, PATH, P.PATTERN).selectExpr("size(ids) AS n").distinct().count() == 1
    got = df.mapInArrow(size, "n long, size long").collect()
    assert sum(r.n for r in got) == 64 and max(r.size for r in got) < 8 << 20
