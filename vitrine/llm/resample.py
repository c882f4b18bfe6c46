"""**Importance resampling** towards a target distribution, by hashed n-grams.

Text work is done on bytes: one 256-byte table lower-cases A-Z and blanks every
separator (UTF-8 bytes from 0x80 on stay), ``bytes.split`` yields the words. A
feature is a run of 1 to ``n`` words joined by one blank; its CRC-32 is that of the
run one word shorter, extended by the blank and the word (``zlib.crc32`` takes the
sum so far as its seed), so no n-gram is ever built. Counters reduce the features to
``buckets`` counts per task, and Spark adds those up.

A bucket's gain is floor(1000 ln of the ratio of its smoothed shares in the target
and in the corpus); a document's weight is the sum of its features' gains. A Gumbel
number drawn from its id is added, so that the highest scores are a sample without
replacement in proportion to exp(weight / 1000).

Texts are read twice (counts, then weights). The driver holds two tables of
``buckets`` numbers; ranks come from a range-partitioned sort of ids and scores.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import freeze, ship, utf8_rows
from vitrine.operators.ranking import global_rank

BUCKETS = 10_000
#: Lower-cases A-Z; all bytes of the ranges 00-2F, 3A-60 and 7B-7F but the letters become blanks.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
              for b in range(256))
#: Words whose gain a worker remembers, and the longest word among them.
REMEMBERED = 1 << 17
LONGEST = 64


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def longer_runs(found: list[bytes], n: int):
    """CRC-32 of every run of 2 to ``n`` consecutive words."""
    sums = [zlib.crc32(w) for w in found]
    for k in range(1, min(n, len(found))):
        sums = [zlib.crc32(w, zlib.crc32(b" ", s)) for s, w in zip(sums, found[k:])]
        yield from sums


def n_features(n_words: int, n: int) -> int:
    return sum(max(0, n_words - k) for k in range(n))


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, count)`` over all texts; a task hands on one row per bucket at most."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        total: Counter[int] = Counter()
        for b in batches:
            seen: Counter[bytes] = Counter()
            for text in utf8_rows(b, 0):
                found = words(text)
                seen.update(found)
                if n > 1:
                    total.update(s % buckets for s in longer_runs(found, n))
            for w, k in seen.items():
                total[zlib.crc32(w) % buckets] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())],
                                         names=["bucket", "count"])

    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, count long")
    return part.groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Of each bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * s_all / (float(corpus.get(b, 0) + 1) * t_all)))
            for b in range(buckets)]


class _Remembered(dict):
    """word -> gain of its bucket, for the words met of late."""

    def __init__(self, gain: list[int]):
        self.gain = gain

    def __missing__(self, word: bytes) -> int:
        g = self.gain[zlib.crc32(word) % len(self.gain)]
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = g
        return g


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", n: int = 1,
          seed: int = 2024) -> DataFrame:
    """``(id, n_words, n_features, weight, score)``, one row per row of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        import pyarrow as pa

        table = shared.value
        known, size = _Remembered(table), len(table)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), utf8_rows(b, 1)):
                found = words(text)
                weight = sum(map(known.__getitem__, found))
                if n > 1:
                    weight += sum(table[s % size] for s in longer_runs(found, n))
                rows.append((i, len(found), n_features(len(found), n), weight, weight + gumbel(i, seed)))
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)``, one row per row of ``docs``.

    Of the N documents with at least ``least_words`` words, floor(percent N / 100) are
    drawn: the highest scores, ties to the smaller id (null ids last), then to the
    earlier row; ``rank`` is 1, 2, 3... in that order, null where not drawn. Null and
    empty texts have no words, weight 0 and are never drawn; a null id draws with the
    empty string in its place; repeated rows and ids count as often as they come; an
    empty target leaves the corpus's own counts to decide; an empty table gives an
    empty result; other columns are not read.
    """
    corpus = {r.bucket: r["count"] for r in bucket_counts(docs, text_col, n, buckets).collect()}  # `buckets` rows at most
    wanted = {r.bucket: r["count"] for r in bucket_counts(target, target_text, n, buckets).collect()}
    weighed = freeze(weigh(docs, gains(corpus, wanted, buckets), id_col, text_col, n, seed)
                     .withColumn("_row", F.monotonically_increasing_id()))
    eligible = weighed.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    ranked = global_rank(eligible, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("_row")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_row")
