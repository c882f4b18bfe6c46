"""Personal data by **bootstrapped contextual extraction**, in DataFrame operations only.

1. Seeds: four fixed patterns (email, ip, card, phone) find base spans.
2. Slot fillers: base spans, and every other token of ``LEAST`` characters or more with
   three digits or an ``@`` that no base span touches. The words around a filler induce
   its lexical patterns: the word before it, the two words before it, and the word
   before it with the word after it (letters only, lower case).
3. Pattern-instance graph: one edge per pattern and different filler. A pattern is
   induced where it surrounds ``LEAST_SEEDS`` different seeds of a kind. Its confidence
   for that kind is the share of known identifiers of the kind among its fillers, with
   one filler more that is not; other kinds' identifiers count against it wholly, unknown
   fillers by ``DOUBT``.
4. Each round scores the patterns from the known identifiers, and the unknown fillers
   from the patterns of ``CONFIDENT`` or more (noisy or). Fillers that reach ``ACCEPTED``
   become known of their best kind and stay so; the rounds end when none is added.
5. Every occurrence of an accepted filler is a span of kind ``found_<kind>``.

Texts are read once: matches and their contexts (``CONTEXT`` code points on both sides)
go to the checkpoint folder. The graph lives in tables; only counts reach the driver.
Copies of a text add nothing, since instances are counted once per pattern. Joins on
patterns and instances are salted (one may hold a third of all edges).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import freeze, with_group

KINDS = ("email", "ip", "card", "phone")
#: The kinds that a span can have, in the order of their numbers.
SPAN_KINDS = (*KINDS, *(f"found_{k}" for k in KINDS))
FILLER = len(KINDS)

_LOCAL = "A-Za-z0-9._%+-"
_TOKEN = "A-Za-z0-9._%+@/-"
_TRIM = "._%+/-"
#: The same matches as the plain patterns, in linear time: a run is tried at its start
#: alone, and possessive quantifiers give nothing back. A card's run must have 16 to 19 digits.
PATTERNS = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    # digit groups, or a token with a digit or an @
    rf"(?<![{_TOKEN}])(?:\+?[0-9]{{2,}}+(?:[\x20-][0-9]{{2,}}+)++(?![{_TOKEN}])|(?=[A-Za-z._%+/-]*+[0-9@])[{_TOKEN}]++)",
)
#: A text without these has no match of the pattern.
GATES = ("@", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){15}", r"\+[0-9]", "[0-9@]")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Least length of an unknown filler; longer ones than ``LONGEST`` are known by their SHA-256.
LEAST = 6
LONGEST = 128
#: Code points on either side of a filler that its context words are taken from.
CONTEXT = 60
LEAST_SEEDS = 3
CONFIDENT = 0.8
DOUBT = 0.25
ACCEPTED = 0.9


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _holds(kind: Column, s: Column) -> Column:
    """Whether a match passes its kind's check."""
    n = F.length(_digits(s))
    return (F.when(kind == 0, F.lit(True))
            .when(kind == 1, s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
            .when(kind == 2, F.call_function("luhn_check", _digits(s)))
            .when(kind == 3, (n >= 8) & (n <= 15))
            .otherwise((F.length(s) >= LEAST) & ((n >= 3) | F.contains(s, F.lit("@")))))


def _context(s: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}]+", " ")), " ")


def _found(text: Column) -> Column:
    """array<struct<kind, k, skip, size, ok, key, before, after>> of all matches of the
    five patterns; ``skip``: code points since the match before."""
    def all_of(kind: int) -> Column:
        p = F.lit(PATTERNS[kind])
        there = text.rlike(GATES[kind])
        return F.struct(F.lit(kind).alias("kind"),
                        F.when(there, F.regexp_extract_all(text, p, F.lit(0))).otherwise(F.array().cast("array<string>")).alias("m"),
                        F.when(there, F.split(text, PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>")).alias("gaps"))

    def each(b: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            kind = b["kind"]
            # a filler is known without the punctuation at its ends
            left = F.when(kind == FILLER, F.length(s) - F.length(F.ltrim(s, F.lit(_TRIM)))).otherwise(0)
            body = F.when(kind == FILLER, F.btrim(s, F.lit(_TRIM))).otherwise(s)
            gap, after = b["gaps"][k], b["gaps"][k + 1]
            return F.struct(kind.alias("kind"), k.alias("k"), F.char_length(gap).alias("skip"), F.char_length(s).alias("size"),
                            left.alias("cut"), F.char_length(body).alias("body"), _holds(kind, body).alias("ok"),
                            F.when(F.length(body) <= LONGEST, F.lower(body)).otherwise(F.sha2(body, 256)).alias("key"),
                            _context(F.substring(gap, -CONTEXT, CONTEXT)).alias("before"),
                            _context(F.substring(after, 1, CONTEXT)).alias("after"))
        return F.transform(b["m"], one)

    # the array of structs is evaluated once per text; its elements are bound in the lambda
    return F.flatten(F.transform(F.array(*[all_of(k) for k in range(len(PATTERNS))]), each))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(uid, id, found)``, written out: one row per row of ``docs``."""
    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return freeze(d.select("uid", "id", F.when(F.col("t").rlike("[0-9@]"), _found(F.col("t"))).alias("found")))


def occurrences(found: DataFrame) -> DataFrame:
    """``(uid, kind, first, last, key, before, after)`` of base spans (kinds 0 to 3) and of
    the unknown fillers that touch none (kind 4); code points, ends exclusive; written out."""
    each = found.where(F.size("found") > 0).select("uid", F.inline("found")).repartition("uid")
    upto = Window.partitionBy("uid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.sum(F.col("skip") + F.col("size")).over(upto) - F.col("size") + F.col("cut")
    placed = each.withColumn("first", first.cast("long")).withColumn("last", (F.col("first") + F.col("body")).cast("long")).where("ok")
    base = F.col("kind") < FILLER
    # ends of the base spans that begin at or before a filler, starts of those that begin at or after it
    earlier = Window.partitionBy("uid").orderBy("first", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("uid").orderBy(F.col("first").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    touched = (F.coalesce(F.max(F.when(base, F.col("last"))).over(earlier) > F.col("first"), F.lit(False))
               | F.coalesce(F.min(F.when(base, F.col("first"))).over(later) < F.col("last"), F.lit(False)))
    kept = placed.withColumn("touched", touched).where((F.col("kind") < FILLER) | ~F.col("touched"))
    return freeze(kept.select("uid", "kind", "first", "last", "key", "before", "after"))


def edges(occ: DataFrame) -> DataFrame:
    """``(pattern, key, kind)``: one row per pattern and different filler; ``kind`` is null
    for unknown ones."""
    b1, b2 = F.try_element_at("before", F.lit(-1)), F.coalesce(F.try_element_at("before", F.lit(-2)), F.lit(""))
    a1 = F.try_element_at("after", F.lit(1))
    patterns = F.array(F.concat(b1, F.lit(" _")), F.when(b2 != "", F.concat(b2, F.lit(" "), b1, F.lit(" _"))),
                       F.when(a1 != "", F.concat(b1, F.lit(" _ "), a1)))
    slots = occ.where(b1 != "").select("key", F.when(F.col("kind") < FILLER, F.col("kind")).alias("kind"),
                                       F.explode(F.array_compact(patterns)).alias("pattern"))
    return slots.groupBy("pattern", "key").agg(F.min("kind").alias("kind"))


def discover(occ: DataFrame, least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT, accepted: float = ACCEPTED) \
        -> tuple[DataFrame, DataFrame]:
    """``(key, kind, score)`` of the unknown fillers that are accepted, and the confident
    patterns ``(pattern, kind, confidence)`` that they were found by."""
    graph = freeze(edges(occ))
    seeds = [F.count_if(F.col("kind") == k).alias(f"s{k}") for k in range(len(KINDS))]
    induced = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind").isNull()).alias("open"), *seeds) \
        .where(reduce(Column.__or__, [F.col(f"s{k}") >= least_seeds for k in range(len(KINDS))]) & (F.col("open") > 0))
    induced = freeze(induced)
    unknown = freeze(with_group(graph.where("kind IS NULL").select("pattern", "key"), induced.select("pattern", F.lit(1).alias("_in")),
                                "pattern", F.col("key")).where("_in = 1").drop("_in"))
    known = unknown.select("key", F.lit(0).alias("kind"), F.lit(0.0).alias("score")).limit(0)
    size = 0
    while True:
        # known identifiers of each kind among a pattern's fillers: its seeds, and the accepted ones
        added = with_group(unknown, known, "key", F.col("pattern")).where("kind IS NOT NULL").groupBy("pattern").agg(
            F.count(F.lit(1)).alias("a"), *[F.count_if(F.col("kind") == k).alias(f"a{k}") for k in range(len(KINDS))])
        accepted_of = [F.coalesce(F.col(f"a{k}"), F.lit(0)) for k in range(len(KINDS))]
        fillers = F.col("n") - (1 - DOUBT) * (F.col("open") - F.coalesce("a", F.lit(0))) + 1
        share = [(F.col(f"s{k}") + accepted_of[k]) / fillers for k in range(len(KINDS))]
        best = F.greatest(*[F.struct(s.alias("confidence"), F.lit(-k).alias("k")) for k, s in enumerate(share)])
        scored = induced.join(added, "pattern", "left").select("pattern", best.alias("b"))
        patterns = scored.where(F.col("b.confidence") >= confident).select(
            "pattern", (-F.col("b.k")).alias("kind"), F.col("b.confidence").alias("confidence"))
        votes = with_group(unknown, patterns, "pattern", F.col("key")).where("kind IS NOT NULL").groupBy("key", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        top = votes.where(F.col("score") >= accepted).groupBy("key").agg(
            F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        new = top.join(known.select("key"), "key", "left_anti").select("key", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))
        known = freeze(known.unionByName(new))
        now = known.count()
        if now == size:
            return known, patterns
        size = now


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_seeds: int = LEAST_SEEDS,
         confident: float = CONFIDENT, accepted: float = ACCEPTED) -> DataFrame:
    """``(id, spans)``, one row per row of ``docs``; ``spans`` is an array of (kind, first,
    last) by kind (an index of ``SPAN_KINDS``) and start, in code points, ends exclusive.

    Null and empty texts have no span; repeated ids and rows have a row each; of spans
    that meet, each is listed; a text of any length is read whole; without seeds nothing
    is discovered; an empty table gives an empty result; other columns are not read.
    """
    found = matches(docs, id_col, text_col)
    occ = occurrences(found)
    known, _ = discover(occ, least_seeds, confident, accepted)
    base = occ.where(F.col("kind") < FILLER).select("uid", "kind", "first", "last")
    more = with_group(occ.where(F.col("kind") == FILLER).select("uid", "first", "last", "key"),
                      known.select("key", (F.col("kind") + FILLER).alias("kind")), "key", F.col("uid"))
    spans = base.unionByName(more.where("kind IS NOT NULL").select("uid", "kind", "first", "last"))
    per = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("kind", "first", "last"))).alias("spans"))
    none = F.array().cast("array<struct<kind:int,first:bigint,last:bigint>>")
    return found.select("uid", "id").join(per, "uid", "left").select("id", F.coalesce("spans", none).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as text."""
    names = F.array(*[F.lit(k) for k in SPAN_KINDS])

    def text(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(
            ":", F.element_at(names, x["kind"] + 1), x["first"].cast("string"), x["last"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] < FILLER)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    return spans.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
