import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vitrine.llm import queries, secrets

ANY = "[A-Za-z0-9+/_.=-]"


def base(text):
    """The contract's patterns, as written, failing matches dropped afterwards."""
    out = []
    for m in re.finditer(r"((?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD]))|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
                         r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    bits = ["token", "TOKEN", "api_key", "ApiKey", "passwd", "secret", "=", ":", " ", "\"", "'", "AKIA", "AKIAAKIA", "abc", "0123456789ab",
            "ABCDEFGH12", "ſecret", "toKen", "é", "🙂", "/", "\n", "==", "deadbeefdeadbeefdeadbeef"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert [s[:3] for s in secrets.base_spans(t)] == base(t), t


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op6_secret_scan(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("grammar:")] == [s for s in text.split(",") if s]


def credential(rng):
    return rng.choice([lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
                       lambda: "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16))])()


def word(rng):
    return "-".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9))) for _ in range(4)) + str(rng.randrange(10))


def test_held_out_formats():
    rng = random.Random(4)
    model = secrets.SecretModel([credential(rng) for _ in range(400)], [word(rng) for _ in range(400)])
    assert 1 < len(model.secret.next) < 100  # states were merged
    hit = sum(model.score(credential(rng)) >= model.threshold for _ in range(500))
    false = sum(model.score(word(rng)) >= model.threshold for _ in range(500))
    assert hit > 475 and false < 5
    text = "see " + "AKIA"[:2] + "X" + "A1B2C3D4E5F6G7H8" + " and " + word(rng)  # not a base pattern
    assert [k for _, k, _ in secrets.find_spans(text, model)] == [3]


def test_automaton_probabilities_sum_to_one():
    """Over all strings of a length or less, plus the mass of longer ones."""
    a = secrets.Automaton(["9h9h", "9h", "99"] * 30)
    assert abs(sum(sum(c.values()) for c in a.count) + sum(a.end) - 30 * (5 + 3 + 3)) < 1e-9
    assert a.likelihood("9h") > a.likelihood("XX")


def test_edges(spark):
    long = "token=abcdef " * 20_000
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (4, "token = abcdef", 1), (4, "token = abcdef", 1), (5, "🙂 secret: 'abc/def'", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds int")
    model = secrets.fit(df)
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(df, model)).collect()}
    assert (got[1].spans, got[2].spans, got[3].n_assign, got[4].spans) == ("", "", 20_000, "assign:0:14")
    assert got[5].spans == "assign:2:18"
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    red = {r.doc_id: r.text for r in secrets.redact(df, model).collect()}
    assert red[1] is None and red[4] == "[secret]" and red[5] == "🙂 [secret]'"
    empty = df.limit(0)
    assert secrets.scan(empty, secrets.fit(empty)).collect() == []
    assert secrets.redact_text("abcdef", [(0, 0, 3), (2, 1, 4)]) == "[secret]ef"
    plain = spark.createDataFrame([(1, "x" * 20 + "1")], "doc_id long, text string").withColumn("z", F.lit(1))
    assert secrets.digest(secrets.scan(plain, secrets.fit(plain))).first().spans == ""


def test_planted_unlabelled_credentials_are_reported(spark):
    """Few candidates, so that all of them are in the sample of other tokens."""
    rng = random.Random(8)

    def key():
        return "sk_" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(24))

    planted, others = [key() for _ in range(6)], [word(rng) + "-draft" for _ in range(60)]
    texts = [f"the api_key = {key()} is old" for _ in range(80)] + [f"see {k} here" for k in planted] + [f"as {w} has it" for w in others]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: [texts[r.id][a:b] for a, b, k in zip(r.starts, r.ends, r.kinds) if k == len(secrets.KINDS)]
           for r in secrets.scan(df, secrets.fit(df)).collect()}
    assert [got[80 + k] for k in range(6)] == [[p] for p in planted]
    assert sum(map(len, got.values())) == 6


def test_short_and_partly_covered_tokens_are_scored(spark):
    rng = random.Random(9)

    def draw(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    def short():
        return draw(string.ascii_uppercase, 12)

    planted = [short() for _ in range(4)]  # no digit, under 16 characters
    split = "xy" + draw("0123456789abcdef", 30) + "-"  # hex inside, head and tail outside
    texts = [f"the token = {short()} and {draw('0123456789abcdef', 40)} go" for _ in range(60)]
    texts += [" ".join(draw(string.ascii_lowercase, rng.randint(4, 9)) for _ in range(30)) for _ in range(20)]
    texts += [f"see {k} here" for k in planted] + [f"or {split} there"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secrets.fit(df)
    got = {r.doc_id: r.text for r in secrets.redact(df, model).collect()}
    assert [got[80 + k] for k in range(4)] == ["see [secret] here"] * 4
    assert got[84] == "or [secret] there"
    assert [got[k] for k in range(60, 80)] == texts[60:80]
    assert [c[:2] for c in secrets.candidates("token=abcdef1 token=abcdef1/x", secrets.base_spans("token=abcdef1 token=abcdef1/x"))] == []


def test_held_out_credentials_on_the_table(spark):
    """Half of the table's labelled credentials lose their keyword and their base pattern's length: the automata
    inferred from the other half must find them, and report next to nothing else."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    labelled = sorted({t[v:e] for t in texts if t for _, _, e, v in secrets.base_spans(t)})
    others = sorted({m for t in texts if t for m in secrets.CANDIDATE.findall(t) if not secrets.base_spans(m)} - set(labelled))
    rng = random.Random(2)
    rng.shuffle(labelled)
    train, held = labelled[::2], labelled[1::2]
    sorts = [[s for s in others if bool(secrets.DIGIT.search(s)) == digit] for digit in (False, True)]
    sample = [s for x in sorts for s in rng.sample(x, min(secrets.SAMPLE, len(x)))]
    model = secrets.SecretModel(train, sample, (len(sorts[0]), len(sorts[1])))
    found = sum(model.reports(s) for s in held)
    false = sum(model.reports(s) for s in others)
    assert len(held) >= 50 and found >= 0.9 * len(held), (found, len(held))
    assert false <= 0.001 * len(others), (false, len(others))
