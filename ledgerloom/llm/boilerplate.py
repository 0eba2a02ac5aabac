"""Lines repeated across the documents of one source.

Method: each document becomes a sequence of line identifiers; the suffixes of all
sequences, sorted by source, form a suffix array that is range-partitioned over the
cluster.  Neighbouring suffixes with a common prefix are the repeated blocks of one or
more lines; the lines of blocks that span enough documents are deleted.

A hot source or line is split over many partitions, as the range partitioning includes
the document; blocks cut by a partition border are put together afterwards.

The suffixes are kept short; longer blocks are counted in rounds that double the length,
only where a block of the length before is repeated (blocks_of_any_length).

Defined results: null and empty texts have no lines but count as documents of their
source; lines shorter than min_chars end a block; rows without source or key give no
cases; repeated rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import broadcast_if_small, materialize

#: Lines of the suffixes, and so of the longest block that the suffix array counts as one.
MAX_BLOCK = 8
#: Repeated blocks are broadcast up to this many, else joined by shuffle.
BROADCAST_BLOCKS = 200_000

_DROP = regex.compile(r"[\s\p{Cf}\x1c-\x1f]+")
_DIGITS = regex.compile(r"\d+")


def line_form(line: str) -> str:
    """What equal lines share: NFKC, no white space or invisible characters, every digit run as one 0."""
    return _DIGITS.sub("0", _DROP.sub("", unicodedata.normalize("NFKC", line)))


def line_ids(text: str | None, min_chars: int) -> list[int]:
    """A positive identifier per line; 0 for lines too short to count."""
    return [
        (xxhash.xxh64_intdigest(line_form(line).encode()) >> 1) or 1 if len(line.strip()) >= min_chars else 0
        for line in (text.split("\n") if text else ())
    ]


def document_suffixes(versions: list, max_block: int) -> list[tuple[bytes, int, int]]:
    """(suffix, line number, known) of each counting line: the suffix runs to the next line that
    doesn't count; the document has its prefixes of up to `known` lines already at an earlier line."""
    out, seen = [], set()
    for ids in versions:
        packed = np.asarray(ids, dtype=">i8").tobytes()
        end = 0
        for i, x in enumerate(ids):
            if not x:
                continue
            if end <= i:
                end = next((j for j in range(i, len(ids)) if not ids[j]), len(ids))
            suffix = packed[8 * i : 8 * min(end, i + max_block)]
            known = 0
            for level in range(1, len(suffix) // 8 + 1):
                prefix = suffix[: 8 * level]
                if prefix in seen:
                    known = level
                else:
                    seen.add(prefix)
            out.append((suffix, i, known))
    return out


def line_sequences(docs: DataFrame, min_chars: int) -> DataFrame:
    """source, key, versions: the line identifiers of each document; one version unless rows of one key differ."""

    def identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"source": pdf["source"], "key": pdf["key"], "ids": [line_ids(t, min_chars) for t in pdf["text"]]})

    rows = docs.select("source", "key", "text").filter("source is not null and key is not null")
    return rows.mapInPandas(identify, "source string, key string, ids array<bigint>").groupBy("source", "key").agg(F.collect_set("ids").alias("versions"))


def suffix_array(sequences: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """source, suffix, known, in suffix order within and across partitions."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, suffix, key, known) for s, key, versions in zip(pdf["source"], pdf["key"], pdf["versions"]) for suffix, _, known in document_suffixes(versions, max_block)]
            yield pd.DataFrame(rows, columns=["source", "suffix", "key", "known"])

    return (
        sequences.mapInPandas(emit, "source string, suffix binary, key string, known int")
        .repartitionByRange("source", "suffix", "key")
        .sortWithinPartitions("source", "suffix")
        .select("source", "suffix", "known")
    )


def prefix_groups(batches: Iterator[pd.DataFrame], min_docs: int) -> Iterator[pd.DataFrame]:
    """(source, prefix, docs) over one stretch of the suffix array.

    A stack holds the prefixes of the current suffix; those longer than the prefix it
    shares with the next suffix are complete.  Complete groups of fewer than min_docs
    documents are left out unless they touch a border of the stretch.
    """
    source, previous, counts, border, out = None, b"", [], 0, []

    def close(depth: int) -> None:
        nonlocal border
        while len(counts) > depth:
            level, n = len(counts), counts.pop()
            if n >= min_docs or level <= border:
                out.append((source, previous[: 8 * level], n))
        border = min(border, depth)

    for pdf in batches:
        for s, suffix, known in zip(pdf["source"], pdf["suffix"], pdf["known"]):
            suffix = bytes(suffix)
            levels, common = len(suffix) // 8, 0
            if s == source:
                most = min(len(counts), levels)
                while common < most and suffix[8 * common : 8 * common + 8] == previous[8 * common : 8 * common + 8]:
                    common += 1
            first = source is None
            close(common)
            source, previous = s, suffix
            counts += [0] * (levels - len(counts))
            if first:
                border = levels
            for level in range(known, levels):
                counts[level] += 1
        yield pd.DataFrame(out, columns=["source", "prefix", "docs"])
        out = []
    border = len(counts)
    close(0)
    yield pd.DataFrame(out, columns=["source", "prefix", "docs"])


def repeated_blocks(sequences: DataFrame, min_docs: int = 5, min_share: float = 0.02, max_block: int = MAX_BLOCK) -> DataFrame:
    """source, block, lines, docs: blocks in at least min_docs documents and min_share of the source's documents."""
    totals = sequences.groupBy("source").agg(F.count("*").alias("total"))
    groups = suffix_array(sequences, max_block).mapInPandas(lambda it: prefix_groups(it, min_docs), "source string, prefix binary, docs bigint")
    return (
        groups.groupBy("source", "prefix").agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs)
        .join(totals, "source")
        .filter(F.col("docs") >= F.col("total") * F.lit(min_share))
        .select("source", F.col("prefix").alias("block"), (F.length("prefix") / 8).cast("int").alias("lines"), "docs")
    )


def document_prefixes(versions: list, starts: list[tuple[int, int]], least: int, most: int) -> Iterator[tuple[int, int, int, str, str | None, str | None]]:
    """(version, start, lines, MD5 of the line identifiers, MD5 without the last line, without the first) of the blocks of
    least to most lines that begin at the starts; the last two are null for blocks of `least` lines."""
    packed = [np.asarray(ids, dtype=">i8") for ids in versions]
    gaps = [np.append(np.flatnonzero(ids == 0), len(ids)) for ids in packed]
    held = [ids.tobytes() for ids in packed]
    for v, i in starts:
        end = int(gaps[v][np.searchsorted(gaps[v], i)])
        if end - i < least:
            continue
        digest = hashlib.md5(held[v][8 * i : 8 * (i + least)])
        now = digest.hexdigest()
        yield v, i, least, now, None, None
        for stop in range(i + least + 1, min(end, i + most) + 1):
            before = now
            digest.update(held[v][8 * (stop - 1) : 8 * stop])
            now = digest.hexdigest()
            yield v, i, stop - i, now, before, hashlib.md5(held[v][8 * (i + 1) : 8 * stop]).hexdigest()


def blocks_of_any_length(sequences: DataFrame, min_docs: int = 5, min_share: float = 0.02, max_block: int = MAX_BLOCK) -> DataFrame:
    """source, block (MD5 of its line identifiers), lines, docs, head, tail (the block without its last and first line):
    as repeated_blocks, without a longest block.

    A block is in no more documents than its own beginning, so only the places where a
    block of n lines is repeated are looked at for n + 1 to 2n lines.
    """
    totals = materialize(sequences.groupBy("source").agg(F.count("*").alias("total")))
    inner = lambda start: F.when(F.col("lines") > 1, F.md5(F.substring("block", start, 8 * (max_block - 1)) if start > 1 else F.expr("substring(block, 1, 8 * (lines - 1))")))
    short = repeated_blocks(sequences, min_docs, min_share, max_block).withColumns({"head": inner(1), "tail": inner(9)}).withColumn("block", F.md5("block"))
    found = [materialize(short.select("source", "block", "lines", "docs", "head", "tail"))]
    docs, n = None, max_block
    while found[-1].filter(F.col("lines") == n).limit(1).count():

        def beginnings(batches: Iterator[pd.DataFrame], n: int = n, first: bool = docs is None) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for source, key, versions, *starts in pdf.itertuples(index=False):
                    places = [(v, i) for v, ids in enumerate(versions) for i, x in enumerate(ids) if x] if first else [(p["v"], p["i"]) for p in starts[0]]
                    rows += [(source, key, v, i, d) for v, i, lines, d, *_ in document_prefixes(versions, places, n, n + 1) if lines == n]
                yield pd.DataFrame(rows, columns=["source", "key", "v", "i", "block"])

        def longer(batches: Iterator[pd.DataFrame], n: int = n) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for source, versions, starts in zip(pdf["source"], pdf["versions"], pdf["starts"]):
                    places = [(p["v"], p["i"]) for p in starts]
                    rows += [(source, *b) for b in {(lines, *d) for _, _, lines, *d in document_prefixes(versions, places, n, 2 * n) if lines > n}]
                yield pd.DataFrame(rows, columns=["source", "lines", "block", "head", "tail"])

        repeated = broadcast_if_small(found[-1].filter(F.col("lines") == n).select("source", "block"), BROADCAST_BLOCKS)
        places = (sequences if docs is None else docs).mapInPandas(beginnings, "source string, key string, v int, i int, block string")
        starts = places.join(repeated, ["source", "block"], "left_semi").groupBy("source", "key").agg(F.collect_list(F.struct("v", "i")).alias("starts"))
        docs = materialize(sequences.join(starts, ["source", "key"]).select("source", "key", "versions", "starts"))
        counted = docs.mapInPandas(longer, "source string, lines int, block string, head string, tail string").groupBy("source", "block", "lines", "head", "tail").agg(F.count("*").alias("docs"))
        kept = counted.filter(F.col("docs") >= min_docs).join(totals, "source").filter(F.col("docs") >= F.col("total") * F.lit(min_share))
        found.append(materialize(kept.select("source", "block", "lines", "docs", "head", "tail")))
        n *= 2
    out = found[0]
    for blocks in found[1:]:
        out = out.unionByName(blocks)
    return out


def maximal_blocks(sequences: DataFrame, min_docs: int = 5, min_share: float = 0.02) -> DataFrame:
    """source, block, lines, docs of the repeated blocks that aren't part of a longer one in just as many documents."""
    found = blocks_of_any_length(sequences, min_docs, min_share)
    longer = found.filter("lines > 1").select("source", "docs", F.explode(F.array("head", "tail")).alias("block")).distinct()
    return found.join(longer, ["source", "block", "docs"], "left_anti").select("source", "block", "lines", "docs")


def lines_of_blocks(ids: list[int], blocks: set[bytes], longest: int) -> set[int]:
    """The line numbers that the longest blocks beginning at each line cover."""
    packed = np.asarray(ids, dtype=">i8").tobytes()
    covered: set[int] = set()
    for i, x in enumerate(ids):
        n = 0
        while x and n < longest and i + n < len(ids) and packed[8 * i : 8 * (i + n + 1)] in blocks:
            n += 1
        covered.update(range(i, i + n))
    return covered


def _shared_blocks(sequences: DataFrame, min_docs: int, min_share: float, max_block: int):
    """(broadcast of source -> blocks, or null if there are too many; the blocks)."""
    blocks = materialize(repeated_blocks(sequences, min_docs, min_share, max_block))
    if blocks.count() > BROADCAST_BLOCKS:
        return None, blocks
    held: dict[str, set[bytes]] = {}
    for r in blocks.select("source", "block").collect():
        held.setdefault(r["source"], set()).add(bytes(r["block"]))
    return sequences.sparkSession.sparkContext.broadcast(held), blocks


def _lines_of(sequences: DataFrame) -> DataFrame:
    """source, key, line_no, id (as bytes) of every counting line."""
    version = sequences.select("source", "key", F.explode("versions").alias("ids"))
    return (
        version.select("source", "key", F.posexplode("ids").alias("line_no", "id")).filter("id <> 0")
    )


def _lines_by_join(sequences: DataFrame, blocks: DataFrame) -> DataFrame:
    """The lines of more blocks than can be broadcast: every line of a repeated block is itself one of one line."""
    heads = blocks.filter("lines = 1").select("source", F.conv(F.hex("block"), 16, 10).cast("bigint").alias("id"))
    return _lines_of(sequences).join(heads, ["source", "id"], "left_semi").select("source", "key", "line_no").distinct()


def boilerplate_lines(docs: DataFrame, min_chars: int = 12, min_docs: int = 5, min_share: float = 0.02, max_block: int = MAX_BLOCK) -> DataFrame:
    """source, key, line_no of every line that belongs to a block repeated across the source's documents.

    docs(source, key, text).  A line of a longer block than max_block is in a shorter one too.
    """
    sequences = materialize(line_sequences(docs, min_chars))
    shared, blocks = _shared_blocks(sequences, min_docs, min_share, max_block)
    if shared is None:
        return _lines_by_join(sequences, blocks)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, key, versions in zip(pdf["source"], pdf["key"], pdf["versions"]):
                held = shared.value.get(source)
                if held:
                    rows += [(source, key, i) for i in set().union(*(lines_of_blocks(list(ids), held, max_block) for ids in versions))]
            yield pd.DataFrame(rows, columns=["source", "key", "line_no"])

    return sequences.mapInPandas(mark, "source string, key string, line_no int")


def without_boilerplate(docs: DataFrame, min_chars: int = 12, min_docs: int = 5, min_share: float = 0.02, max_block: int = MAX_BLOCK) -> DataFrame:
    """source, key, text (without the repeated lines), removed (how many); repeated rows give one row.

    The texts are cleaned where they are read; only with more blocks than can be broadcast are they joined with their lines.
    """
    sequences = materialize(line_sequences(docs, min_chars))
    shared, blocks = _shared_blocks(sequences, min_docs, min_share, max_block)
    if shared is None:
        return _cleaned_by_join(docs, _lines_by_join(sequences, blocks))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, removed = [], []
            for source, key, text in zip(pdf["source"], pdf["key"], pdf["text"]):
                held = shared.value.get(source) if text and key is not None else None
                drop = lines_of_blocks(line_ids(text, min_chars), held, max_block) if held else ()
                texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text)
                removed.append(len(drop))
            yield pdf[["source", "key"]].assign(text=texts, removed=removed)

    return docs.select("source", "key", "text").mapInPandas(clean, "source string, key string, text string, removed int").distinct()


def _cleaned_by_join(docs: DataFrame, found: DataFrame) -> DataFrame:
    dropped = found.groupBy("source", "key").agg(F.collect_set("line_no").alias("drop"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains("drop", i))
    return (
        docs.select("source", "key", "text").join(dropped, ["source", "key"], "left")
        .select("source", "key", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed"))
        .distinct()
    )


def text_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter("type = 'text'").select(F.col("company").alias("source"), F.col("chunk_id").alias("key"), "text")
