"""Mixing sources to target weights by **temperature**, in DataFrame operations only.

1. Tokens per source give shares p; the mixture weights are w ~ p ** t.
2. The exponent t in [0, 1] is bisected (each round evaluates ``POINTS`` exponents
   in one aggregation over the sources): the largest t whose entropy reaches
   ``entropy`` (a share of the entropy of equal weights), or the smallest t at which
   no source is repeated more than ``max_repetition`` times. The limit on
   repetition goes first where both are given.
3. The budget is a number of tokens, or by default the smallest at which every
   source is used whole at least once, so that no document is left out.
4. A source's quota is realised as epochs. Its documents lie in blocks of about
   ``block_tokens`` tokens and at most about ``block_rows`` rows (by a hash of the id); every epoch takes the blocks in
   its own permutation, and the last epoch ends where the quota is used up: whole
   blocks, and of one more the documents with the smallest hashes that still fit.

Which documents an epoch takes is a function of (source, id) and of two small
tables, one row per source and one per block, so the texts need not be shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import SALTS, broadcast_if_small, freeze

POINTS = 33
ROUNDS = 6
BLOCK_TOKENS = 1 << 18
#: Rows of a block, about: a source of many short or empty texts has more blocks than its tokens ask for.
BLOCK_ROWS = 1 << 14
#: The blocks of a source are summed up in two to this power stretches, for either sign of the hash.
STRETCH_BITS = 10
#: Larger tables of sources or blocks are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A join key that tells a null source from every string."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _statistics(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """Of each exponent: the sum of p ** t, the entropy, the largest p ** (t - 1)."""
    t = F.explode(F.array(*[F.lit(x) for x in exponents])).alias("t")
    w = F.pow("p", F.col("t"))
    rows = (shares.where("p > 0").select("p", t).groupBy("t")
            .agg(F.sum(w).alias("z"), F.sum(w * F.log("p")).alias("l"), F.max(F.pow("p", F.col("t") - 1)).alias("r"))
            .collect())  # one row per exponent asked for
    return {r.t: (r.z, math.log(r.z) - r.t * r.l / r.z, r.r) for r in rows}


def solve_exponent(shares: DataFrame, entropy: float | None = None, max_repetition: float | None = None,
                   budget_ratio: float | None = None) -> tuple[float, float, float]:
    """``(t, sum of p ** t, tokens of the mixture over tokens of the corpus)``.

    ``shares``: a column ``p`` of shares that sum to one. Without a target t is 1."""
    n = shares.where("p > 0").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("m")).first()
    if not n["n"]:
        return 1.0, 1.0, 0.0

    top = n["m"]

    def repetition(t, s):
        # weight over share, times tokens of the mixture over tokens of the corpus
        r = budget_ratio if budget_ratio is not None else s[0] / top ** (t - 1)
        return s[2] / s[0] * r

    t = 1.0
    if entropy is not None:
        goal = entropy * math.log(n["n"]) if n["n"] > 1 else 0.0
        t = _border(shares, lambda x, s: s[1] < goal - 1e-12)[0]
    if max_repetition is not None:
        least = _border(shares, lambda x, s: repetition(x, s) <= max_repetition * (1 + 1e-12))[1]
        t = max(t, least) if entropy is not None else least
    s = _statistics(shares, [t])[t]
    return t, s[0], budget_ratio if budget_ratio is not None else s[0] / top ** (t - 1)


def _border(shares: DataFrame, good) -> tuple[float, float]:
    """The last exponent of [0, 1] that is not ``good`` and the first that is, as
    close as ``ROUNDS`` rounds bring them: good exponents lie above the others.
    Where all (or none) are good, both are 0 (or 1)."""
    a, b = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [a + (b - a) * k / (POINTS - 1) for k in range(POINTS)]
        stats = _statistics(shares, grid)
        k = next((k for k, x in enumerate(grid) if good(x, stats[x])), POINTS)
        if k in (0, POINTS):
            return (a, a) if k == 0 else (b, b)
        a, b = grid[k - 1], grid[k]
    return a, b


class Mixture:
    """A solved mixture: exponent, and the tables of sources and of blocks."""

    def __init__(self, exponent: float, sources: DataFrame, blocks: DataFrame, seed: int):
        self.exponent, self.sources, self.blocks, self.seed = exponent, sources, blocks, seed


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.col("n_blocks"))


def _draw(seed: int) -> Column:
    """Order of the documents inside a block of the last epoch."""
    return F.xxhash64(F.col("_id"), F.lit(seed + 1))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    small = broadcast_if_small(sources, BROADCAST_ROWS)
    if small is not sources:
        return rows.join(small, "_key")
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
            .join(salted, ["_key", "_salt"]).drop("_salt"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        entropy: float | None = None, max_repetition: float | None = None, budget_tokens: int | None = None,
        block_tokens: int = BLOCK_TOKENS, seed: int = 17, block_rows: int = BLOCK_ROWS) -> Mixture:
    """Solve the mixture of ``docs``.

    Tokens are words; null and empty texts have none. A null source is a source of
    its own; a source without tokens is taken once. Repeated rows and ids count and
    go together; an empty table gives empty tables; other columns are not read.
    """
    rows = freeze(docs.select(F.col(id_col).alias("_id"), _key(F.col(source_col)).alias("_key"),
                              words(F.col(text_col).cast("string")).alias("tokens")))
    sums = freeze(rows.groupBy("_key").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n_docs")))
    corpus = sums.agg(F.sum("total")).first()[0] or 0
    shares = sums.withColumn("p", F.col("total") / F.lit(float(corpus or 1)))
    ratio = None if budget_tokens is None else budget_tokens / max(1, corpus)
    t, z, ratio = solve_exponent(shares, entropy, max_repetition, ratio)
    # repetitions = weight x budget / tokens; rounded, so that a whole epoch is not lost to the last bit
    reps = F.when(F.col("p") > 0, F.round(F.pow("p", F.lit(t - 1)) / z * ratio, 9)).otherwise(F.lit(1.0))
    sources = freeze(shares.select(
        "_key", "total", F.pow("p", F.lit(t)).alias("w"), reps.alias("repetitions"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(float(block_tokens))),
                   F.ceil(F.col("n_docs") / F.lit(float(block_rows)))).cast("long").alias("n_blocks"))
        .withColumn("weight", F.when(F.col("total") > 0, F.col("w") / z).otherwise(0.0)).drop("w")
        .withColumn("full", F.floor("repetitions").cast("int"))
        .withColumn("rest", (F.col("repetitions") - F.floor("repetitions")) * F.col("total")))

    placed = _with_sources(rows, sources).withColumn("block", _block(seed))
    sizes = placed.groupBy("_key", "block").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"),
                                                F.max("full").alias("full"))
    # the blocks of a source in the order of their turns, in stretches by the turn's leading bits: a source
    # of very many blocks is summed up stretch by stretch, and no task holds all its blocks
    sizes = freeze(sizes.withColumn("turn", F.xxhash64("block", "full", F.lit(seed))).withColumn("stretch", F.shiftright("turn", 63 - STRETCH_BITS)))
    earlier = Window.partitionBy("_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = sizes.groupBy("_key", "stretch").agg(F.sum("tokens").alias("whole")) \
        .select("_key", "stretch", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("before"))
    turn = Window.partitionBy("_key", "stretch").orderBy("turn", "block")
    cum = F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = freeze(sizes.withColumn("cum", cum).join(stretches, ["_key", "stretch"]).withColumn("cum", F.col("cum") + F.col("before"))
                   .drop("turn", "stretch", "before"))
    # left: tokens of the last epoch's quota when its turn comes
    sizes = sizes.withColumn("left", F.col("rest") - (F.col("cum") - F.col("tokens")))
    border = sizes.where("left > 0 AND tokens > left").select("_key", "block", "left")
    inside = placed.select("_key", "_id", "block", "tokens").join(border, ["_key", "block"])
    run = Window.partitionBy("_key", "block").orderBy("_draw")  # equal draws count together
    cut = (inside.withColumn("_draw", _draw(seed)).withColumn("_run", F.sum("tokens").over(run))
           .where("_run <= left").groupBy("_key", "block").agg(F.max("_draw").alias("cut")))
    blocks = freeze(sizes.where("left > 0").join(cut, ["_key", "block"], "left")
                    .select("_key", "block", (F.col("tokens") <= F.col("left")).alias("whole"), "cut"))
    return Mixture(t, sources, blocks, seed)


def realise(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with ``mix_epoch``,
    ``mix_block`` and ``mix_turn`` (the sort key of the block in that epoch's
    permutation). Columns of ``docs`` keep their names."""
    seed = mixture.seed
    names = [f"c{k}" for k in range(len(docs.columns))]  # own names, so that no column clashes
    rows = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in (id_col, source_col)}
    rows = rows.withColumns({"_id": F.col(at[id_col]), "_key": _key(F.col(at[source_col]))})
    placed = _with_sources(rows, mixture.sources.select("_key", "n_blocks", "full")).withColumn("block", _block(seed))
    placed = placed.join(broadcast_if_small(mixture.blocks, BROADCAST_ROWS), ["_key", "block"], "left")
    last = F.coalesce(F.col("whole"), F.lit(False)) | F.coalesce(_draw(seed) <= F.col("cut"), F.lit(False))
    epochs = F.col("full") + last.cast("int")
    out = placed.where(epochs > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], "mix_epoch",
                      F.col("block").alias("mix_block"),
                      F.xxhash64("block", "mix_epoch", F.lit(seed)).alias("mix_turn"))
