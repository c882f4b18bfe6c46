"""Secret scans by **grammar inference**.

Three fixed patterns find labelled credentials. From a bounded sample of them a
probabilistic automaton is inferred: a prefix tree of the credentials (over
character classes) whose statistically compatible states are merged (ALERGIA:
two states are compatible if the frequencies of ending and of every next symbol,
and recursively those of their successors, differ by less than a Hoeffding
bound). Two more automata are inferred from other tokens, those with and those
without a digit, and weighted by their shares of all such tokens. Every token of
``LEAST`` characters or more that does not lie inside a base span is scored by the log-likelihood ratio of the two formats, and
reported where the ratio reaches the number n of different candidates in all
texts, at least ``LEAST_RATIO``. A token of the other formats reaches a ratio of n
with a probability of at most 1/n, so about one of them is reported by chance; no
token's own score moves the threshold.

Texts are read twice: once for the credentials, once for the spans. Only the three
samples (``SAMPLE`` strings each, at most ``LONGEST`` characters) reach the driver.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import freeze, ship_texts

KINDS = ("assign", "access", "hex")
GRAMMAR = "grammar"
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more: shorter runs hold no longer match
HEX = re.compile(r"[0-9a-f]{24,}")
#: Least length of assigned credentials, and of the tokens that are scored.
LEAST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
DIGIT = re.compile(r"[0-9]")

#: Most credentials, and most other tokens with and without a digit, that the automata are inferred from.
SAMPLE = 600
#: Least likelihood ratio at which a token is reported, however few the candidates.
LEAST_RATIO = 1000
#: Times that the automata of other tokens are inferred anew, without the strings of their
#: samples that the credentials' format explains better: unlabelled credentials among them.
REFITS = 2
#: Longer strings are not used for training (they are still scored).
LONGEST = 128
#: Scores that a Python worker remembers.
REMEMBERED = 1 << 18
#: Different tokens of a task that go on to Spark together.
TOKENS_AT_ONCE = 1 << 17
#: Confidence parameter of the Hoeffding bound.
ALPHA = 0.05


def symbols(token: str) -> str:
    """Character classes: digits, hex letters and other letters of either case, punctuation as it is."""
    return token.translate(_CLASSES)


_CLASSES = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "H" for c in "ABCDEF"},
                          **{c: "x" for c in "ghijklmnopqrstuvwxyz"}, **{c: "X" for c in "GHIJKLMNOPQRSTUVWXYZ"}})
ALPHABET = "9hHxX+/_.=-"


class Automaton:
    """A probabilistic automaton inferred from strings by state merging.

    ``next[state][symbol]`` is the successor, ``count[state][symbol]`` how often it
    was taken, ``end[state]`` how often a string ended there. Scoring smooths every
    state with ``1`` spread over the alphabet and the end; a symbol never seen in a
    state leads to the start.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]
        for s in strings:
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.end.append(0)
                at = self.next[at][c]
            self.end[at] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self._score = None

    def _arrivals(self, q: int) -> int:
        return self.end[q] + sum(self.count[q].values())

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return bool(n and m) and abs(x / n - y / m) > self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self._arrivals(p), self._arrivals(q)
            if self._differ(self.end[p], n, self.end[q], m):
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if self._differ(self.count[p].get(c, 0), n, self.count[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q] and self.next[p][c] != self.next[q][c]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below ``q`` to the state ``p``."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.end[p] += self.end[q]
            for c, k in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + k
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge_all(self) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            p, c = blue.pop(0)
            q = self.next[p][c]
            if q in red:
                continue
            for r in red:
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in red]
        place = {q: k for k, q in enumerate(red)}
        self.next = [{c: place[t] for c, t in self.next[q].items()} for q in red]
        self.count, self.end = [self.count[q] for q in red], [self.end[q] for q in red]

    def likelihood(self, s: str) -> float:
        """Natural log of the probability of ``s``, per symbol (its end counts as one)."""
        if self._score is None:
            self._score = []
            for q in range(len(self.next)):
                n = self._arrivals(q) + 1
                low = 1 / (len(ALPHABET) + 1)
                self._score.append((
                    {c: (math.log((self.count[q].get(c, 0) + low) / n), self.next[q].get(c, 0)) for c in ALPHABET},
                    math.log((self.end[q] + low) / n)))
        at, total = 0, 0.0
        for c in s:
            step, at_next = self._score[at][0][c]
            total += step
            at = at_next
        return (total + self._score[at][1]) / (len(s) + 1)


class SecretModel:
    """The automata and the threshold on the log of the ratio of their likelihoods.

    ``n_candidates``: different candidates of the corpus without and with a digit, by
    default those of ``others``. Without credentials nothing is reported; an automaton
    without tokens is uniform.
    """

    def __init__(self, credentials: list[str], others: list[str], n_candidates: tuple[int, int] | None = None):
        sorts = [[s for s in others if bool(DIGIT.search(s)) == digit] for digit in (False, True)]
        counts = n_candidates or [len(x) for x in sorts]
        self.secret = Automaton([symbols(s) for s in credentials]) if credentials else None
        self.share = [math.log((n + 1) / (sum(counts) + 2)) for n in counts]
        self.other = [Automaton([symbols(s) for s in x]) for x in sorts]
        self.known: dict[str, bool] = {}
        for _ in range(REFITS if credentials else 0):
            plain = [[s for s in x if self.score(s) <= 0] for x in sorts]
            if plain == sorts:
                break
            sorts, self.other = plain, [Automaton([symbols(s) for s in x]) for x in plain]
        self.threshold = math.log(max(LEAST_RATIO, sum(counts)))

    def score(self, token: str) -> float:
        if not self.secret:
            return -math.inf
        s, sort = symbols(token), 1 if DIGIT.search(token) else 0
        return (self.secret.likelihood(s) - self.other[sort].likelihood(s)) * (len(s) + 1) - self.share[sort]

    def reports(self, token: str) -> bool:
        got = self.known.get(token)
        if got is None:
            got = self.score(token) >= self.threshold
            if len(token) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[token] = got
        return got


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the credential)``, by start and kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, bool]]:
    """``(start, end, touched)`` of the tokens that do not lie inside a base span (or a
    run of overlapping ones); ``touched``: a base span covers a part."""
    merged: list[list[int]] = []
    for a, _, b, _ in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_right(starts, b - 1) - 1
        touched = k >= 0 and merged[k][1] > a
        if not touched or a < merged[k][0] or merged[k][1] < b:
            out.append((a, b, touched))
    return out


def find_spans(text: str, model: SecretModel) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of base and inferred spans, by start and kind."""
    base = base_spans(text)
    out = [(a, k, b) for a, k, b, _ in base]
    if model.secret and any(model.reports(t) for t in set(CANDIDATE.findall(text))):
        out += [(a, len(KINDS), b) for a, b, _ in candidates(text, base) if model.reports(text[a:b])]
    return sorted(out)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> SecretModel:
    """Infer the automata from the corpus's credentials and its other tokens, with and
    without a digit, that no base span touches: of each, the ``sample`` different strings
    with the smallest hash. The threshold follows the number of all different candidates."""
    ship_texts(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kinds = [set(), set(), set()]  # other tokens without and with a digit, credentials

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([k for k, x in enumerate(kinds) for _ in x], pa.int32()),
                 pa.array([s for x in kinds for s in x], pa.string())], names=["kind", "token"])
            for x in kinds:
                x.clear()
            return out

        for b in batches:
            tokens = set()
            for t in b.column(0):
                text = t.as_py() or ""
                base = base_spans(text)
                if base:
                    kinds[2].update(text[v:e] for _, _, e, v in base if e - v <= LONGEST)
                    tokens.update(text[a:e] for a, e, touched in candidates(text, base) if not touched)
                else:
                    tokens.update(CANDIDATE.findall(text))
            for token in tokens:
                kinds[1 if DIGIT.search(token) else 0].add(token)
            if sum(map(len, kinds)) >= TOKENS_AT_ONCE:
                yield flush()
        yield flush()

    seen = freeze(docs.select(F.col(text_col).cast("string").alias("text"))
                  .mapInArrow(run, "kind int, token string").distinct())

    def draw(kind: int) -> list[str]:
        top = seen.where((F.col("kind") == kind) & (F.length("token") <= LONGEST)).orderBy(F.xxhash64("token"), "token").limit(sample)
        return sorted(r.token for r in top.collect())

    count = {r.kind: r["count"] for r in seen.groupBy("kind").count().collect()}
    return SecretModel(draw(2), draw(0) + draw(1), (count.get(0, 0), count.get(1, 0)))


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, starts, ends, kinds)``, arrays by start and kind (an index of ``KINDS``,
    and their number for inferred spans), in code points, ends exclusive.

    One row per row of ``docs``; null and empty texts have no span; repeated ids
    and rows are kept; an empty table gives an empty result; other columns are not
    read.
    """
    ship_texts(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        long = pa.list_(pa.int64())
        for b in batches:
            spans = [find_spans(t.as_py() or "", shared.value) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([[s[k] for s in x] for x in spans], long) for k in (0, 2, 1)]],
                names=["id", "starts", "ends", "kinds"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, starts array<long>, ends array<long>, kinds array<long>")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every run of overlapping spans becomes ``[secret]``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, model: SecretModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of its texts replaced; rows, their number and every
    other column stay, null texts stay null."""
    ship_texts(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for t in b.column(at):
                text = t.as_py()
                texts.append(text and redact_text(text, find_spans(text, shared.value)))
            yield b.set_column(at, b.schema.field(at), pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as text."""
    names = F.array(*[F.lit(k) for k in (*KINDS, GRAMMAR)])
    each = F.zip_with(F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a, b)), "kinds",
                      lambda s, k: F.struct(F.concat_ws(":", F.element_at(names, k.cast("int") + 1), s).alias("s"), k.alias("k")))
    spans = spans.withColumn("each", each)
    base = F.filter("each", lambda x: x["k"] < len(KINDS))

    def n(k: int):
        return F.size(F.filter("kinds", lambda x: x == k)).cast("long")

    return spans.select(F.col("id").alias("doc_id"), *[n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                        F.sha2(F.array_join(base["s"], ","), 256).alias("base_sha256"),
                        F.array_join(F.col("each")["s"], ",").alias("spans"))
