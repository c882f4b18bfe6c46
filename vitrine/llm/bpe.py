"""Byte-level BPE encoding and decoding by **prefix dynamic programming**.

For every prefix of a byte string the last token of its encoding is unique, and
a token sequence is an encoding exactly if every adjacent pair of its tokens is
one (the two tokens' bytes alone encode to these two tokens). So one table,
``last[i]`` = last token of the encoding of the first i bytes, is filled from
left to right: of the tokens that end at i, the one whose pair with the last
token before it is valid. Walking back from the end reads the encoding.

The table makes appends exact without encoding anything again, and an edit only
fills the table from the edit on, until it agrees with the old one over the
length of the longest token. Time is linear in the bytes, also for a run of a
million letters, where merging is not.

Ranks come from a file of ``base64 rank`` lines; its path is a parameter. A match
of the split pattern that is itself a token gets its id, as usual.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import ship_texts

#: Encoded pieces in each of the two generations that a worker remembers; memory only, no effect on results.
CACHE_PIECES = 1 << 18
#: Marks of pieces met once, one bit each: what never comes again is not remembered.
SEEN_BITS = 1 << 22
#: Tested pairs of tokens that a worker remembers.
CACHED_PAIRS = 1 << 19
#: Tokens in one Arrow batch that a task hands back.
BATCH_TOKENS = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens by rank, an automaton that finds the tokens ending at each byte, and the pair test of the prefix table."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ends = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.pairs = _Pairs(self)
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merge(self, data: bytes, until: int = 1) -> list[int]:
        """Merging by lowest rank, leftmost first, until so many parts are left: the definition, for a token or two."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``; None for a byte and for a token that merging never makes."""
        if t not in self._halves:
            parts = self.merge(self.tokens[t], 2)
            self._halves[t] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[t]

    def reachable(self, t: int) -> bool:
        return len(self.tokens[t]) == 1 or self.halves(t) is not None

    def stand(self, a: int, b: int) -> bool:
        """Whether ``a b`` is the encoding of its own bytes.

        The merges that make the two are undone from the last one back. While ``u``
        ends the left and ``v`` begins the right, they must not merge before the one
        of them that is used up first is (of equal ranks the left one goes first)."""
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        if not (self.reachable(a) and self.reachable(b)):
            return False
        u, v, before = a, b, 1 << 62
        while True:
            if ranks.get(tokens[u] + tokens[v], before) < before:
                return False
            hu, hv = halves(u), halves(v)
            if hu is None and hv is None:
                return True
            if hu and hu[1] >= u or hv and hv[0] >= v:  # a part of higher rank than the whole: the order of merges is not that of ranks
                return self.merge(tokens[a] + tokens[b]) == [a, b]
            if hv is None or hu is not None and u > v:
                before, u = u, hu[1]
            else:
                before, v = v + 1, hv[0]


class _Pairs(dict):
    """Whether two tokens can stand side by side; key: ``left << 32 | right``."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, key: int) -> bool:
        if len(self) >= CACHED_PAIRS:
            self.clear()
        ok = self[key] = self.vocab.stand(key >> 32, key & 0xFFFFFFFF)
        return ok


def fill(vocab: Vocabulary, data: bytes, last: list[int]) -> None:
    """Extend ``last`` (known for the first ``len(last) - 1`` bytes) to all of ``data``."""
    pairs, known = vocab.pairs, len(last)
    start = max(0, known - vocab.longest)  # no token that ends later begins before
    last += [-1] * (len(data) + 1 - known)
    for at, (t, size) in vocab.ends.iter(data[start:].decode("latin-1") if start else data.decode("latin-1")):
        i = start + at + 1
        if last[i] < 0 and i >= known:
            k = i - size
            if pairs[last[k] << 32 | t] if k else vocab.reachable(t):
                last[i] = t
    if min(last[known:], default=0) < 0:
        bad = data[last.index(-1, known) - 1]
        raise ValueError(f"byte {bad:#x} is not a token")


def walk_back(vocab: Vocabulary, last: list[int]) -> list[int]:
    out, i = [], len(last) - 1
    while i:
        t = last[i]
        out.append(t)
        i -= len(vocab.tokens[t])
    return out[::-1]


class PrefixTable:
    """The last token of every prefix of one byte string."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        fill(self.vocab, self.data, self.last)

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace ``removed`` bytes at ``at``; returns how many prefixes were filled anew."""
        tail, old = self.data[at + removed:], self.last[at + removed:]  # old[j]: after j bytes of the tail
        self.data, self.last = self.data[:at], self.last[:at + 1]
        self.append(inserted)
        start, step, done, same = len(self.data), self.vocab.longest, 0, 0
        while done < len(tail):
            self.append(tail[done:done + step])
            while done < len(self.data) - start:
                done += 1
                same = same + 1 if self.last[start + done] == old[done] else 0
            if same >= step:  # from here on the old table holds: equal bytes and equal last tokens before
                self.data += tail[done:]
                self.last += old[done + 1:]
                break
        return len(inserted) + done

    def ids(self) -> list[int]:
        return walk_back(self.vocab, self.last)


class PieceEncoder(dict):
    """Ids (as little-endian int32 bytes) of each match of the split pattern."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        import regex

        super().__init__()
        self.vocab, self.pieces = vocab, regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}  # the generation before: what is used again comes back from it
        self.seen = bytearray(SEEN_BITS // 8)  # by hash, emptied with every generation

    def __missing__(self, piece: str) -> bytes:
        import array

        out, again = self.old.get(piece), True
        if out is None:
            at = hash(piece) % SEEN_BITS
            again = self.seen[at >> 3] >> (at & 7) & 1
            self.seen[at >> 3] |= 1 << (at & 7)
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.vocab.ranks.get(data)
            if whole is None:
                last = [-1]
                fill(self.vocab, data, last)
                ids = walk_back(self.vocab, last)
            else:
                ids = [whole]
            out = array.array("i", ids).tobytes()
        if again and len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
                self.seen = bytearray(SEEN_BITS // 8)
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(key: str, shared) -> PieceEncoder:
    """One encoder per worker and vocabulary; the key is a digest of its content."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(Vocabulary(shared.value), key.partition(":")[2])
    return _ENCODERS[key]


def _shared(spark: SparkSession, path: str, pattern: str):
    """Key and ranks, read once by the driver: their size is that of the file."""
    ranks = read_ranks(path)
    digest = hashlib.sha256(b"".join(b"%d %b " % (i, t) for t, i in ranks.items())).hexdigest()
    return f"{digest}:{pattern}", spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = (), check: bool = False) -> DataFrame:
    """``(id, *keep, ids array<int>)``, one row per row of ``docs`` in one narrow pass
    over whole texts; with ``check`` also ``decoded_ok``: the ids decode to the text.
    ``keep``: string columns that are handed through.

    A null or empty text gives an empty array; an empty table an empty result;
    repeated ids and rows are kept; other columns are not read."""
    ship_texts(docs.sparkSession)
    vocab_key, vocab = _shared(docs.sparkSession, path, pattern)
    more = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = _encoder(vocab_key, vocab)

        def flush(rows, parts, fine):
            ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                             pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))
            return pa.RecordBatch.from_arrays([*rows.columns[:-1], lists, *([pa.array(fine, pa.bool_())] if check else [])],
                                              names=["id", *more, "ids", *(["decoded_ok"] if check else [])])

        for b in batches:
            start, parts, fine, size = 0, [], [], 0
            for i, value in enumerate(b.column(b.num_columns - 1)):
                text = value.as_py() or ""
                parts.append(enc.encode(text))
                if check:
                    fine.append(b"".join(map(enc.vocab.tokens.__getitem__, memoryview(parts[-1]).cast("i"))) == text.encode())
                size += len(parts[-1])
                if size >= 4 * BATCH_TOKENS or i == b.num_rows - 1:
                    yield flush(b.slice(start, i + 1 - start), parts, fine)
                    start, parts, fine, size = i + 1, [], [], 0

    schema = ", ".join(["id long", *[f"{m} string" for m in more], "ids array<int>", *(["decoded_ok boolean"] if check else [])])
    out = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(m) for c, m in zip(keep, more)],
                      F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnsRenamed(dict(zip(more, keep)))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` as ``(id, ids, decoded binary)``. Null ids decode to
    null, as do rows that hold an id outside the vocabulary."""
    ship_texts(encoded.sparkSession)
    _, vocab = _shared(encoded.sparkSession, path, "")

    def run(batches):
        import pyarrow as pa

        tokens = {i: t for t, i in vocab.value.items()}
        get = tokens.__getitem__

        def text(ids):
            try:
                return None if ids is None else b"".join(map(get, ids))
            except KeyError:
                return None

        for b in batches:
            step = max(1, BATCH_TOKENS * b.num_rows // max(1, len(b.column(1).values)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                lists = part.column(1)
                if lists.null_count or lists.values.null_count:
                    rows = lists.to_pylist()
                else:  # slices of the flat ids: far cheaper than a list scalar each
                    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                    rows = (flat[i:j].tolist() for i, j in zip(ends, ends[1:]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(map(text, rows), pa.binary())],
                                                 names=["id", "ids", "decoded"])

    return encoded.select("id", F.col(ids_col).cast("array<int>").alias("ids")) \
        .mapInArrow(run, "id long, ids array<int>, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """Token count and SHA-256 of the comma-joined ids and of the decoded bytes."""
    joined: Column = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
