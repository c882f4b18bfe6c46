import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vitrine.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base(text):
    """The contract's patterns, as written, failing matches dropped afterwards."""
    out = []
    for k, p in enumerate(PLAIN.values()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split("."))
                    or k == 2 and 16 <= len(digits) <= 19 and luhn(digits) or k == 3 and 8 <= len(digits) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def context(s):
    return re.sub(r"[\W\d_]+", " ", s.lower()).strip().split(" ")


def brute(texts, least=3, confident=0.8, accepted=0.9):
    """All spans of each text: bootstrapping over dictionaries, whole rounds at a time."""
    occ, spans = [], {}
    for i, text in texts.items():
        spans[i] = base(text)
        for k, p in enumerate(PLAIN.values()):
            # a failing match still ends the gap of the next one, as do cards of other lengths only where they are cards
            every = [m.span() for m in re.finditer(p, text)]
            if k == 2:
                every = [(a, b) for a, b in every if 16 <= len(re.sub("[^0-9]", "", text[a:b])) <= 19]
            edge = [0] + [x for s in every for x in s] + [len(text)]
            for j, (a, b) in enumerate(every):
                if (k, a, b) in spans[i]:
                    occ.append((i, k, a, b, text[a:b], text[edge[2 * j]:a], text[b:edge[2 * j + 3]]))
        every = [m.span() for m in re.finditer(pii_token(), text)]
        edge = [0] + [x for s in every for x in s] + [len(text)]
        for j, (a, b) in enumerate(every):
            body = text[a:b]
            cut = len(body) - len(body.lstrip("._%+/-"))
            body = body.strip("._%+/-")
            a2, b2 = a + cut, a + cut + len(body)
            if len(body) >= 6 and (len(re.sub("[^0-9]", "", body)) >= 3 or "@" in body) \
                    and not any(x < b2 and y > a2 for _, x, y in spans[i]):
                occ.append((i, 4, a2, b2, body, text[edge[2 * j]:a], text[b:edge[2 * j + 3]]))
    edges = {}
    for _, k, _, _, body, left, right in occ:
        lw, rw = context(left[-60:]), context(right[:60])
        if not lw[-1]:
            continue
        names = [f"{lw[-1]} _"] + ([f"{lw[-2]} {lw[-1]} _"] if len(lw) > 1 and lw[-2] else []) + ([f"{lw[-1]} _ {rw[0]}"] if rw[0] else [])
        for p in names:
            edges[p, body.lower()] = min(k, edges.get((p, body.lower()), 4))
    fill = defaultdict(dict)
    for (p, key), k in edges.items():
        fill[p][key] = k
    induced = {p: f for p, f in fill.items() if any(list(f.values()).count(k) >= least for k in range(4))}
    known = {}
    while True:
        votes = defaultdict(lambda: defaultdict(lambda: 1.0))
        for p, f in induced.items():
            kinds = [known.get(key) if k == 4 else k for key, k in f.items()]
            share = [kinds.count(want) / (len(f) - 0.75 * kinds.count(None) + 1) for want in range(4)]
            conf = max(share)
            if conf >= confident:
                for key, k in f.items():
                    if k == 4:
                        votes[key][share.index(conf)] *= 1 - conf
        new = {key: min((miss, k) for k, miss in v.items())[1] for key, v in votes.items()
               if key not in known and 1 - min(v.values()) >= accepted - 1e-12}
        if not new:
            break
        known |= new
    for i, k, a, b, body, _, _ in occ:
        if k == 4 and body.lower() in known:
            spans[i].append((4 + known[body.lower()], a, b))
    return {i: sorted(s) for i, s in spans.items()}, known


def pii_token():
    t = "A-Za-z0-9._%+@/-"
    return rf"(?<![{t}])(?:\+?[0-9]{{2,}}(?:[\x20-][0-9]{{2,}})+(?![{t}])(?![\x20-][0-9]{{2}})|(?=[A-Za-z._%+/-]*[0-9@])[{t}]+)"


def check(rows, texts, **kw):
    want, known = brute({i: t or "" for i, t in texts.items()}, **kw)
    for r in rows:
        w = want[r.id]
        assert [(s.kind, s["first"], s["last"]) for s in r.spans] == w, (r.id, texts[r.id])
    return known


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    want, _ = brute({i: t or "" for i, t in texts.items()})
    rows = queries.op12_contextual_pii(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in spans) for j in range(4)]
        text = [f"{pii.SPAN_KINDS[k]}:{a}:{b}" for k, a, b in spans]
        assert r.spans == ",".join(text)
        assert r.base_sha256 == hashlib.sha256(",".join(t for t in text if not t.startswith("found_")).encode()).hexdigest()


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(7)
    bits = ["a", "b.c", "@", "@@", "x-y.", "mail", ".com", "-", "%", "_", "+", " ", "  ", "1", "12", "255", "256", "0.0", "1.2.3.4", ".", "..", "007",
            "4111111111111111", "4111 1111 1111 1111", "+1 (555) 010-9999", "(", ")", "5500005555555559", "é", "🙂", "\n", "\t"]
    texts = {k: "".join(rng.choice(bits) for _ in range(rng.randrange(16))) for k in range(3000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    for r in pii.scan(df, least_seeds=10**9).collect():
        assert [(s.kind, s["first"], s["last"]) for s in r.spans] == base(texts[r.id]), texts[r.id]


def planted():
    """Identifiers of a form that no base pattern knows, in the contexts of those that one does."""
    rng = random.Random(11)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"dial me +1 (555) {number(3)}-{number(4)} at noon" for _ in range(40)]
    texts += [f"write to {w}{number(2)}@mail.example.com today" for w in "abcdefghijklmnopqrstuvwxyz"]
    hidden = [f"{number(3)}-{number(5)}" for _ in range(4)]
    texts += [f"dial me {h} at noon" for h in hidden]
    chain = f"{number(4)}/{number(6)}"
    texts += [f"dial me {chain} please", f"extension {chain} rings"]
    # a context of all kinds, and one of a kind with too many strangers, discover nothing
    stranger = [f"see item {number(8)} there" for _ in range(9)]
    texts += [f"see {x} there" for x in ("a@b.co", "1.2.3.4", "+1 555 010 0001", "q@b.co", "5.6.7.8")] + ["see 99887766 there"]
    texts += [f"item +1 (555) 010-{number(4)} there" for _ in range(5)] + stranger
    return dict(enumerate(texts)), hidden, chain


def test_patterns_discover_unseen_identifiers(spark):
    texts, hidden, chain = planted()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pii.scan(df).collect()
    known = check(rows, texts)
    got = {texts[r.id][s["first"]:s["last"]]: s["kind"] for r in rows for s in r.spans if s["kind"] >= 4}
    assert set(hidden) | {chain} == set(got) and set(got.values()) == {4 + 3} and set(known) == set(got)
    # the chain is found outside its context too
    assert any("extension" in texts[r.id] and r.spans for r in rows)


def test_held_out_seeds_of_each_kind_are_found(spark):
    """One in six identifiers is written so that its pattern fails; contexts alone must find them."""
    rng = random.Random(13)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = {"email": (lambda: f"user{number(5)}@host.example.org", lambda: f"user{number(5)}@localhost"),
             "ip": (lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: ".".join(str(rng.randrange(300, 999)) for _ in range(4))),
             "phone": (lambda: f"+49 {number(3)} {number(7)}", lambda: f"{number(4)}/{number(7)}")}
    rows, hidden = [], {}
    for kind, (seen, unseen) in forms.items():
        for k in range(60):
            h = unseen() if k % 6 == 0 else seen()
            if k % 6 == 0:
                hidden[h] = kind
            rows.append((len(rows), f"the {kind} address {h} was given"))
    clean = {f"order {number(8)} shipped in crate C{number(5)}" for _ in range(200)}
    rows += [(len(rows) + k, t) for k, t in enumerate(sorted(clean))]
    texts = dict(rows)
    got = pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {texts[r.id][s["first"]:s["last"]]: pii.SPAN_KINDS[s["kind"]] for r in got for s in r.spans if s["kind"] >= 4}
    assert {h: f"found_{k}" for h, k in hidden.items()} == found


def test_edges(spark):
    long = "call +1 (555) 010-9999 now " * 20_000
    rows = [(1, None), (2, ""), (3, long), (4, "a@b.co"), (4, "a@b.co"), (None, "🙂 é 1.2.3.4"), (6, "9" * 50_000), (7, "x" * 50_000 + "@"),
            (8, "1." * 30_000), (9, "a." * 30_000 + "@b"), (10, "+1" + " " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("kind", F.lit("k"))
    got = defaultdict(list)
    for r in pii.digest(pii.scan(df)).collect():
        got[r.doc_id].append(r)
    assert len(got[4]) == 2 and all(r.spans == "email:0:6" for r in got[4])
    assert got[1][0].spans == got[2][0].spans == "" and got[1][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3][0].n_phone == 20_000 and got[None][0].spans == "ip:4:11"
    for i in (6, 7, 8, 9, 10):
        assert got[i][0].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base_linear(dict(rows)[i])).encode()).hexdigest()
    assert pii.digest(pii.scan(df.limit(0))).collect() == []


def base_linear(text):
    """Base spans of the long edge texts, where the plain patterns would take quadratic time."""
    if set(text) == {"1", "."}:
        return [(1, 8 * k, 8 * k + 7) for k in range(len(text) // 8)]
    return []


def test_a_hot_context_is_spread(spark):
    """A third of all fillers in one context, and one filler in a third of all texts."""
    rows = [(k, f"phone +1 555 {k:07d} or") for k in range(300)] + [(1000 + k, "phone 77-123456 or") for k in range(300)]
    rows += [(2000 + k, f"word{k} {k:09d} end") for k in range(300)]
    spans = pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {s["kind"] for r in spans for s in r.spans} == {3, 7}
    assert sum(s["kind"] == 7 for r in spans for s in r.spans) == 300
