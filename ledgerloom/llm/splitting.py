"""Splitting oversized texts at natural boundaries.

Method: every position gets the strength of the boundary before it; a sparse table
answers range-maximum queries over the strengths.  The cut of a piece is the
strongest boundary in the permissible window, the rightmost on a tie; the next piece
begins up to `overlap` characters before the cut, at a boundary if one is near.

Defined results: null, empty and short texts are one piece (null and empty give none
in the split query); texts of any length are processed whole; repeated rows give one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 1000
OVERLAP = 100
#: The overlap may start this much later than `overlap` characters back, to begin at a boundary.
SLACK = 40
#: A piece is filled to this share at least before a weaker boundary further right is preferred.
LEAST_FILL = 0.5

# Characters after which a text may be cut, by strength (line end, sentence end, clause end, space).
SENTENCE_ENDS = "。！？．｡!?؟।"
CLAUSE_ENDS = "；;，,、：:…|"
CLOSERS = "”’」』》）】〉\")]'"


def strengths(text: str) -> np.ndarray:
    """strength[i] of cutting before character i: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 space, 0 none."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(codes)
    after = np.zeros(n + 1, dtype=np.int8)
    isin = lambda chars: np.isin(codes, np.array([ord(c) for c in chars], dtype=np.uint32))
    digit = (codes >= 48) & (codes <= 57)
    space = isin(" \t　 ")
    next_digit = np.append(digit[1:], False)
    next_space = np.append(space[1:] | isin("\n")[1:], True)
    prev_digit = np.insert(digit[:-1], 0, False)
    clause = isin(CLAUSE_ENDS) & ~(prev_digit & next_digit)
    sentence = isin(SENTENCE_ENDS) & ~(prev_digit & next_digit) | (codes == 46) & next_space
    after[1:][space] = 1
    after[1:][clause] = 2
    after[1:][sentence] = 3
    closer = isin(CLOSERS)
    # closing quotes and brackets belong to the sentence before them
    for i in np.flatnonzero(closer):
        if after[i] == 3:
            after[i + 1] = max(after[i + 1], 3)
            after[i] = 0
    line = codes == 10
    after[1:][line] = 4
    double = line & np.insert(line[:-1], 0, False)
    after[1:][double] = 5
    after[0] = 0
    return after


class RangeMax:
    """Sparse table: the rightmost position of the maximum over any range of up to `widest` in O(1)."""

    def __init__(self, values: np.ndarray, widest: int | None = None):
        n = len(values)
        # the position breaks ties: of equal strengths the rightmost is the maximum
        level = values.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.levels = n, [level]
        width = 1
        while 2 * width <= min(n, widest or n):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def query(self, lo: int, hi: int) -> tuple[int, int]:
        """(position, value) of the rightmost maximum in [lo, hi]."""
        k = (hi - lo + 1).bit_length() - 1
        best = int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]))
        return best % (self.n + 1), best // (self.n + 1)


def split_spans(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece; the pieces cover the text, each at most max_chars long."""
    if not 0 <= overlap < max_chars // 2:
        raise ValueError("overlap must be less than half of max_chars")
    n = len(text)
    if n <= max_chars:
        return [(0, n)] if n else []
    index = RangeMax(strengths(text), max_chars + 1)
    spans, start, covered = [], 0, 0
    while True:
        if n - start <= max_chars:
            spans.append((start, n))
            return spans
        lo, hi = max(covered + 1, start + int(max_chars * LEAST_FILL)), start + max_chars
        cut, strength = index.query(lo, hi)
        if strength < 2:
            # no natural boundary in the fuller part: look in the whole window before cutting hard
            wide, wide_strength = index.query(min(covered + 1, hi), hi)
            cut = wide if wide_strength >= 2 else cut if strength else hi
        spans.append((start, cut))
        covered = cut
        back = max(start + 1, cut - overlap)
        at, strength = index.query(back, min(cut - 1, back + SLACK)) if overlap and back < cut else (cut, 1)
        start = at if strength else back


def oversized(texts: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """texts(field_name, row_key, text) longer than max_chars, measured on the text itself."""
    return texts.filter(F.char_length("text") > max_chars)


def split_pieces(texts: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """field_name, row_key, piece, start, end, text of every oversized text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (field, key, piece, a, b, text[a:b])
                for field, key, text in zip(pdf["field_name"], pdf["row_key"], pdf["text"])
                for piece, (a, b) in enumerate(split_spans(text, max_chars, overlap))
            ]
            yield pd.DataFrame(rows, columns=["field_name", "row_key", "piece", "start", "end", "text"])

    found = oversized(texts.select("field_name", "row_key", "text"), max_chars).distinct()
    return found.mapInPandas(cut, "field_name string, row_key string, piece int, start int, end int, text string")


def find_oversized(texts: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """field_name, row_key of the texts that the splitter cuts into two pieces or more."""
    return split_pieces(texts, max_chars, overlap).filter("piece = 1").select("field_name", "row_key").distinct()


def long_texts(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    return chunks.select(F.lit("chunks.text").alias("field_name"), F.col("chunk_id").alias("row_key"), "text").unionByName(
        blocks.select(F.lit("blocks.text").alias("field_name"), F.concat_ws("#", "doc_id", F.col("seq").cast("string")).alias("row_key"), "text")
    )
