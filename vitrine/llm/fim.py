"""**Fill-in-the-middle** by an indexable skip list.

A text is a sequence of units (a word with the blanks before it). The skip list over
its units has a ground lane with one link per unit and express lanes above, each with
about one in ``2 ** BITS`` nodes of the lane below; every link carries two widths, the
units and the code points that it spans. Descending from the highest lane, as long as
the accumulated units do not pass the rank, reaches a cut rank with its exact place in
code points, so both cuts fall on unit borders and the text is sliced, never rejoined
from its units.

Node i's height depends on i alone (leading zero bits of i times a fixed odd number),
so the lanes' places are computed once per worker and only the widths per text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import ship

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A lane keeps one in 2 ** BITS nodes of the lane below.
BITS = 3
#: The odd multiplier whose products are spread evenly over 64 bits (2 ** 64 over the golden ratio).
MIX = 0x9E3779B97F4A7C15

#: Of each express lane, from the lowest: its nodes (unit ranks) and their places in the lane below, for ranks under _SPAN.
_LANES: list[tuple[np.ndarray, np.ndarray]] = []
_SPAN = 0


def _lanes(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    global _SPAN
    if n > _SPAN:
        _SPAN = max(1 << 12, 1 << (n - 1).bit_length())
        mixed = np.arange(_SPAN, dtype=np.uint64) * np.uint64(MIX)
        _LANES.clear()
        below = np.arange(_SPAN)
        while len(below) > 1:
            keep = mixed[below] >> np.uint64(64 - BITS * (len(_LANES) + 1)) == 0
            keep[0] = True
            down = np.flatnonzero(keep)
            _LANES.append((below[down], down))
            if len(down) == len(below):
                break
            below = below[down]
            if BITS * (len(_LANES) + 1) > 60:
                break
    return _LANES


class SkipList:
    """Of units with the given widths in code points."""

    def __init__(self, widths: np.ndarray):
        self.n = len(widths)
        self.ground = widths
        #: per express lane, from the lowest: widths of its links in units and in code points, and the places below
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        chars = widths
        for nodes, down in _lanes(self.n):
            m = int(np.searchsorted(nodes, self.n))
            if m < 2:
                break
            chars = np.add.reduceat(chars, down[:m])
            self.lanes.append((np.diff(nodes[:m], append=self.n), chars, down))

    def locate(self, rank: int) -> int:
        """Code points before the unit of this rank; ``n`` gives the whole length."""
        at = place = units = 0
        for unit_widths, char_widths, down in reversed(self.lanes):
            while at < len(unit_widths) and units + unit_widths[at] <= rank:
                units += int(unit_widths[at])
                place += int(char_widths[at])
                at += 1
            if at == len(unit_widths):
                return place  # the last link of a lane ends behind the last unit
            at = int(down[at])
        while units < rank:
            place += int(self.ground[units])
            units += 1
        return place


def unit_widths(text: str) -> np.ndarray:
    return np.fromiter((b - a for a, b in map(re.Match.span, UNIT.finditer(text))), np.int64)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def transform_text(text: str, doc_id: int | None, seed: int = 42, percent: int = 50, spm_percent: int = 80) \
        -> tuple[int, str, str, int | None, int | None]:
    """``(units, form, output, code points of the prefix, of the middle)``."""
    widths = unit_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= percent:
        return n, "plain", text, None, None
    units = SkipList(widths)
    a, b = sorted((units.locate(h1 % (n + 1)), units.locate(h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50,
              spm_percent: int = 80) -> DataFrame:
    """``(id, n, form, output, prefix_chars, middle_chars)``, one row per row of ``docs``.

    ``percent`` of the documents are cut, ``spm_percent`` of those in the order suffix,
    prefix, middle. Null and empty texts, and texts that hold a marker, stay plain (null
    counts as empty, so its output is empty); a null id draws with the empty string in
    its place; equal rows get equal outputs; a text of any length is cut whole; an empty
    table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        names = ["id", "n", "form", "output", "prefix_chars", "middle_chars"]
        for b in batches:
            rows = [transform_text(t.as_py() or "", i, seed, percent, spm_percent)
                    for i, t in zip(b.column(0).to_pylist(), b.column(1))]
            columns = zip(*rows) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, n long, form string, output string, prefix_chars long, middle_chars long")


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from: a cut text holds no marker of its own,
    so its first markers part it."""
    return (F.when(form == "psm", F.regexp_replace(output, "(?s)^<P>(.*?)<S>(.*?)<M>(.*)$", "$1$3$2"))
            .when(form == "spm", F.regexp_replace(output, "(?s)^<S>(.*?)<P>(.*?)<M>(.*)$", "$2$3$1")).otherwise(output))


def digest(cut: DataFrame) -> DataFrame:
    """SHA-256 of the outputs and of the texts rebuilt from them."""
    return cut.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
