"""Quality rules with **risk-controlled thresholds**, in DataFrame operations only.

Every rule compares one feature of a text with a cutoff. The cutoffs are chosen on
labelled good documents so that, for each stratum (language), at most the share
``alpha`` of all good documents falls to the rules together:

* Near-equal labelled documents are one observation: documents that share the
  smallest or the largest hash of their three-word windows form groups (connected
  components), and a group falls to a rule if any member does.
* A third of the groups (by hash) draws up the path: for each target rate of ``PATH``,
  from loose to strict, every rule takes its strictest cutoff whose rate of false
  rejections there is at most the target.
* The other groups test it. With k of n groups rejected by any rule at a step, the
  hypothesis "the rate of false rejections exceeds alpha" is rejected if the exact
  binomial tail P(Bin(n, alpha) <= k) is at most the stratum's level; that is the
  Clopper-Pearson upper bound lying at or below alpha. The steps form a fixed sequence,
  tested until the first that fails: no correction is needed inside it.
* The strata that have such groups share the error ``delta`` by Holm's procedure: a
  stratum whose whole path holds hands its level on to the others. So with probability
  1 - delta no stratum loses more than alpha of its good documents.
* A stratum without a certified step rejects nothing. The first step needs
  (1 - alpha) ** n <= level even if no document falls to it: with alpha = delta = 0.05
  and four strata 86 testing groups, about 130 good documents that are no copies.

Texts are read once; features (a few numbers per document) go to the checkpoint
folder. Cutoffs, rules, steps and strata are parameters, so the threshold table has a
fixed size and is broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import freeze, with_group
from vitrine.llm.components import connected_components

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"

#: Feature and its cutoffs from loose to strict; a document falls to a rule where the feature exceeds the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1),
    "bars_and_bangs_per_word": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1),
    "capitals_per_char": (0.95, 0.8, 0.65, 0.5, 0.35, 0.25, 0.2),
    "dup_line_share": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_word_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "chars_per_word": (40.0, 25.0, 18.0, 14.0, 12.0, 10.0, 9.0),
    "words_per_char": (0.7, 0.5, 0.45, 0.4, 0.35, 0.3),
}


#: Target rates of the path's steps, from loose to strict.
PATH = (0.0, 0.0025, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08)
#: One group in so many draws up the path; the others test it.
DRAWING = 3


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows of three that occur more than once, given their hashes.

    (hash, place) pairs are sorted; a window equal to a neighbour is repeated. Of the
    places in order, each adds the words up to the next place, three at most."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        same = F.filter(p, lambda x, k: ((k > 0) & (F.try_element_at(p, k)["h"] == x["h"]))
                        | F.coalesce(F.try_element_at(p, k + 2)["h"] == x["h"], F.lit(False)))
        return F.sort_array(same["i"])

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                           lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")))["n"]

    # one-element arrays bind the sorted pairs and the places, so that each is computed once
    once = F.transform(F.array(pairs), places)
    n = F.transform(once, covered)[0]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(n)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """Per row: id, stratum, ``n_words``, ``word_chars`` (code points), ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, the rest that the rules need, and the extreme hashes
    ``low`` and ``high`` of the three-word windows (null under three words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"),
                    (stratum if stratum is not None else F.lit("all")).cast("string").alias("stratum"), text.alias("t"))
    d = d.select("id", "stratum", "t", F.filter(F.split("t", BLANKS), lambda w: w != "").alias("w"),
                 F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "").alias("lines"))
    w = F.col("w")
    windows = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    d = d.select("id", "stratum", "t", "w", "lines", windows.alias("h"))
    count = lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    return d.select(
        "id", "stratum", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _repeat_words(F.col("h")).cast("long").alias("n_repeat_words"),
        F.array_min("h").alias("low"), F.array_max("h").alias("high"),
        count(r"[|!]").alias("n_bars_and_bangs"), count(r"[A-Z]").alias("n_capitals"))


def rule_values() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "bars_and_bangs_per_word": F.col("n_bars_and_bangs") / n,
        "capitals_per_char": F.col("n_capitals") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / n,
        "chars_per_word": F.col("word_chars") / n,
        "words_per_char": F.col("n_words") / chars,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series at x + 8 (error under 1e-13 of the result)."""
    y = x + 8
    shift = reduce(Column.__add__, [F.log(x + k) for k in range(8)])
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, a: float) -> Column:
    """P(Bin(n, a) <= k), exactly: the term at k from log-gammas, the terms below it
    from their ratios. Where k reaches n * a the tail is not small and 1 is returned.
    Terms further than 40 standard deviations below (under 1e-300) are left out."""
    k, n = k.cast("double"), n.cast("double")
    top = (log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
           + k * math.log(a) + (n - k) * math.log1p(-a))
    steps = F.least(k, F.ceil(40 * F.sqrt(n) + 100)).cast("long")
    series = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (k - i) / (n - k + i + 1) * ((1 - a) / a)).alias("term"),
                              (s["sum"] + s["term"] * (k - i) / (n - k + i + 1) * ((1 - a) / a)).alias("sum")))["sum"]
    return F.when((n <= 0) | (k >= n * a), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * series))


def observations(good: DataFrame, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """``(stratum, test, <rule>...)``: one row per group of near-equal documents of
    ``good`` (features, each row a document), with the largest value of every rule in
    it; ``test`` is false for the groups that draw up the path."""
    value = rule_values()
    rows = freeze(good.where("low IS NOT NULL").select(F.monotonically_increasing_id().alias("node"), "stratum", "low", "high",
                                                       *[value[r].alias(r) for r in rules]))
    keyed = rows.select("node", F.explode(F.array(F.struct("stratum", F.col("low").alias("h"), F.lit(0).alias("end")),
                                                  F.struct("stratum", F.col("high").alias("h"), F.lit(1).alias("end")))).alias("key"))
    first = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = with_group(keyed, first, "key", F.col("node")).where("first < node").select("node", "first")
    groups = connected_components(links, "node", "first")
    joined = rows.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    per = joined.groupBy("stratum", "group").agg(F.min("low").alias("low"), *[F.max(r).alias(r) for r in rules])
    return freeze(per.select("stratum", (F.pmod(F.xxhash64("low"), F.lit(DRAWING)) > 0).alias("test"), *rules))


def draw_path(groups: DataFrame, rules: dict[str, tuple[float, ...]] = RULES, path: tuple[float, ...] = PATH) -> DataFrame:
    """``(stratum, step, cut_<rule>...)`` of the strata that ``groups`` have: per step the
    strictest cutoff of every rule with a rate of false rejections up to the step's
    target; null where even the loosest exceeds it."""
    sums = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, cs in rules.items() for i, c in enumerate(cs)]
    wide = groups.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    steps = wide.withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(len(path))])))
    target = F.element_at(F.array(*[F.lit(float(x)) for x in path]), F.col("step") + 1) * F.col("n")
    # cutoffs run from loose to strict, so the last that passes is the strictest; counts only grow along them
    cuts = [F.coalesce(*[F.when(F.col(f"{r}_{i}") <= target, F.lit(c)) for i, c in reversed(list(enumerate(cs)))]).alias(f"cut_{r}")
            for r, cs in rules.items()]
    return steps.select("stratum", "step", *cuts)


def rejected(values: dict[str, Column], rules) -> Column:
    """Name of the first rule whose value exceeds its cutoff, else null."""
    return F.coalesce(*[F.when(values[r] > F.col(f"cut_{r}"), F.lit(r)) for r in rules])


def calibrate(good: DataFrame, rules: dict[str, tuple[float, ...]] = RULES, alpha: float = 0.05, delta: float = 0.05,
              path: tuple[float, ...] = PATH) -> DataFrame:
    """``(stratum, step, n, k, tail, level, cut_<rule>...)``: the strictest certified step
    of each stratum; none where no step is. ``good``: the features of the labelled good
    documents. n and k count groups of near-equal documents."""
    groups = observations(good, rules)
    steps = draw_path(groups.where("NOT test"), rules, path)
    # at most strata x steps rows
    hit = groups.where("test").join(F.broadcast(steps), "stratum").groupBy("stratum", "step").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(rejected({r: F.col(r) for r in rules}, rules).isNotNull()).alias("k"))
    tested = freeze(hit.withColumn("tail", binomial_tail(F.col("k"), F.col("n"), alpha)))
    # Holm over the strata by the largest tail of their paths: whole paths hold from the smallest on until one does not
    whole = tested.groupBy("stratum").agg(F.max("tail").alias("worst"))
    by = Window.orderBy("worst", "stratum")  # one row per stratum
    strata = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = whole.select("stratum", "worst", (F.lit(delta) / (strata - F.row_number().over(by) + 1)).alias("own"))
    held = ranked.withColumn("holds", F.min((F.col("worst") <= F.col("own")).cast("int")).over(
        by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    open_ = F.sum(1 - F.col("holds")).over(Window.partitionBy())
    levels = held.select("stratum", F.when(F.col("holds") == 1, F.col("own")).otherwise(F.lit(delta) / open_).alias("level"))
    judged = tested.join(F.broadcast(levels), "stratum")
    bad = judged.groupBy("stratum").agg(F.coalesce(F.min(F.when(F.col("tail") > F.col("level"), F.col("step"))), F.lit(len(path))).alias("bad"))
    best = judged.join(bad, "stratum").where(F.col("step") == F.col("bad") - 1).drop("bad")
    return best.join(steps, ["stratum", "step"])


def judge(docs: DataFrame, labels: DataFrame, strata: tuple[str, ...], stratum: Column, id_col: str = "doc_id",
          text_col: str = "text", alpha: float = 0.05, delta: float = 0.05,
          rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """Features, ``base_failed``, ``rejected_by`` (a rule's name or null) and ``kept``,
    one row per row of ``docs``.

    ``labels``: ``doc_id, quality``; an id labelled both ways is not used. Strata
    outside ``strata`` and nulls form one more. Null texts count as empty and fail
    the base rule. Repeated rows are judged alike; without labels the rules reject
    nothing; an empty table gives an empty result; other columns are not read.
    """
    known = F.when(stratum.isin(*strata), stratum).otherwise("(other)")
    rows = freeze(features(docs, id_col, text_col, known)).withColumn("base_failed", base_failed())
    good = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q")).where("q = 1").select("id")
    cutoffs = calibrate(rows.where("NOT base_failed").join(good, "id"), rules, alpha, delta)
    cuts = cutoffs.select("stratum", *[f"cut_{r}" for r in rules])
    joined = rows.join(F.broadcast(cuts), "stratum", "left")  # at most len(strata) + 1 rows
    return joined.withColumn("rejected_by", F.when(~F.col("base_failed"), rejected(rule_values(), rules))) \
        .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()) \
        .drop("low", "high", *[f"cut_{r}" for r in rules])
