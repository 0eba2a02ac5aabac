"""Evaluation texts that leaked into training text.

Method: one Aho-Corasick automaton over anchors of the normalised test items scans
each document once; a hit is extended in both directions and counts if the common
run has the required length.  Offsets are mapped back to the original text.

The anchors lie so close that every window of min_run characters of an item holds
one of them whole (length + stride - 1 <= min_run), so no leak is missed.

A run that was followed once isn't followed again: the end of the run on each diagonal
(item, text offset minus item offset) is remembered, and an item found whole is passed over.

The items are sent to the tasks in blocks of bounded size, one scan of the documents for
each; the driver holds one block at a time.  Sets of up to BLOCK_CHARS take one scan.

Defined results: null and empty texts and items shorter than min_run leak nothing;
texts are read whole; repeated rows give one row; with no items the result is empty.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of test items for which one automaton is built; larger item sets run in hash blocks of about this size.
BLOCK_CHARS = 4_000_000

_KEEP = {}


def _kept(c: str) -> bool:
    known = _KEEP.get(c)
    if known is None:
        known = _KEEP[c] = unicodedata.category(c)[0] in "LN"
    return known


def normalise(text: str) -> str:
    """Letters and digits only, NFKC, then lower case."""
    return "".join(filter(_kept, unicodedata.normalize("NFKC", text).lower()))


def normalise_with_offsets(text: str) -> tuple[str, np.ndarray]:
    """normalise(), and for each kept character the offset of its source in the text.
    Characters that compose across a boundary are attributed to the cluster's start."""
    out, offsets = [], []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        for c in normalise(text[i:j]):
            out.append(c)
            offsets.append(i)
        i = j
    return "".join(out), np.array(offsets, dtype=np.int64)


def build_automaton(items: list[tuple[int, str]], min_run: int):
    """The automaton over anchors, with the places (item index, offsets in item) of each; and the normalised items."""
    import ahocorasick

    length = (min_run + 1) // 2
    stride = min_run - length + 1
    texts = [(key, normalise(text or "")) for key, text in items]
    places: dict[str, dict[int, list[int]]] = {}
    for k, (_, text) in enumerate(texts):
        if len(text) >= min_run:
            for at in range(0, len(text) - length + 1, stride):
                places.setdefault(text[at : at + length], {}).setdefault(k, []).append(at)
    automaton = ahocorasick.Automaton()
    for anchor, where in places.items():
        automaton.add_word(anchor, (length, list(where.items())))
    if places:
        automaton.make_automaton()
    return (automaton if places else None), texts


_BUILT: dict = {}


def _automaton_of(token: str, items: list[tuple[int, str]], min_run: int):
    """The automaton of the latest block, kept by the worker from task to task."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = build_automaton(items, min_run)
    return _BUILT[token]


def _common_prefix(a: str, i: int, b: str, j: int) -> int:
    """Length of the common prefix of a[i:] and b[j:], by slices that double."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 32
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, 2 * step
        elif step == 1:
            break
        else:
            step = max(1, step // 8)
            most = min(most, n + 8 * step + 8)
    return n


def _common_suffix(a: str, i: int, b: str, j: int) -> int:
    """Length of the common suffix of a[:i] and b[:j]."""
    n = 0
    while n < i and n < j and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def scan_text(text: str, automaton, texts, min_run: int) -> dict[int, tuple[int, int]]:
    """item index -> (start, end) of its longest common run in the normalised text, the first of equal ones."""
    best: dict[int, tuple[int, int]] = {}
    whole: set[int] = set()
    followed: dict[tuple[int, int], int] = {}
    for end, (length, where) in automaton.iter(text):
        start = end - length + 1
        for k, offsets in where:
            if k in whole:
                continue
            item = texts[k][1]
            for at in offsets:
                diagonal = (k, start - at)
                if followed.get(diagonal, -1) > start:
                    continue
                # the places before the anchor are less than a stride away, unless an anchor there was met before
                back = _common_suffix(text, start, item, at)
                stop = end + 1 + _common_prefix(text, end + 1, item, at + length)
                followed[diagonal] = stop
                run = stop - start + back
                if run >= min_run and (k not in best or run > best[k][1] - best[k][0]):
                    best[k] = (start - back, stop)
                    if run == len(item):
                        whole.add(k)
                        break
    return best


_FOUND = "doc_id bigint, item_id bigint, start_offset int, end_offset int, run int"


def leaks(documents: DataFrame, test_items: DataFrame, min_run: int = 40, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start_offset, end_offset, run: the longest leaked run of each item in each document.

    documents(doc_id, text), test_items(item_id, text).
    """
    spark = documents.sparkSession
    items = test_items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    readable = documents.select("doc_id", "text").filter("doc_id is not null and length(text) >= %d" % ((min_run + 17) // 18))
    result = None
    for n in range(blocks):
        block = sorted((r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).collect())
        part = readable.mapInPandas(_finder(spark.sparkContext.broadcast(block), uuid.uuid4().hex, min_run), _FOUND)
        result = part if result is None else result.unionByName(part)
    return result.groupBy("doc_id", "item_id").agg(
        F.max_by("start_offset", "run").alias("start_offset"), F.max_by("end_offset", "run").alias("end_offset"), F.max("run").alias("run")
    )


def _finder(shared, token: str, min_run: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, texts = _automaton_of(token, shared.value, min_run)
        for pdf in batches:
            rows = []
            if automaton is not None:
                for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                    best = scan_text(normalise(text), automaton, texts, min_run)
                    if best:
                        own, offsets = normalise_with_offsets(text)
                        for k, (a, b) in best.items():
                            exact = b <= len(own)
                            rows.append((doc_id, texts[k][0], int(offsets[a]) if exact else None, int(offsets[b - 1]) + 1 if exact else None, b - a))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_offset", "end_offset", "run"])

    return find
