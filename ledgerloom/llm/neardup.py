"""Near-duplicate records with small edits.

Method: parity-sketch join.  A text's tokens (substrings of five characters) are spread
over bands by their hash, and each band's word is the XOR of the tokens in it; every
token that two texts don't share alters one band at most.  Texts of like size (bands per
size level) that agree in a band's word are candidates.  Each text also has a bit sketch,
the parities of its tokens by their hash: the Hamming distance of two bit sketches is a
lower bound of the symmetric difference, so candidates beyond the largest difference that
the similarity allows are dropped before any text moves.  The exact similarity decides.

Bands.  A pair at the similarity limit shares a known part of its tokens, so the number of
bands that stay equal can be computed.  The bands of a size level are so many that a pair
at the limit shares EQUAL_BANDS of them on average, be it among the smallest or largest
of the level.  Words of a few tokens, which unlike texts share by chance, aren't used;
both texts of a pair agree on that, as an equal word has equal tokens.  With
guaranteed=True there are more bands than tokens that may differ and every word is used,
so by the pigeonhole principle no pair is missed; a text that leaves too many bands empty
gives its first tokens (below) as well.  That costs about one word per token and level.

Texts of few distinct tokens (short ones, and long ones that repeat themselves) leave
bands empty, so no number of words is certain to be shared.  Pairs of them share at least
one of their first tokens in hash order (prefix filter), and those are their words.

Copies (equal but for white space) have one sketch, so they are one record in the join
and come apart only in the result.  All words are sorted in hash buckets whose number
follows the words counted; a word that very many contents have is passed on as soon as a
bucket has seen it often, and its pairs are spread over blocks of contents.

Defined results: null texts and texts below min_chars have no pairs; repeated rows count
once; texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import broadcast_if_small, buckets_for, materialize

WIDTH = 5
SIMILARITY = 0.7
MIN_CHARS = 60
#: Words that a pair at the limit is expected to share, where a level allows so many (7 at least from 64 tokens on);
#: the chance to share none is about the exponential of minus that, and falls fast above the limit.
EQUAL_BANDS = 9.0
#: Ratio of the sizes at the ends of a level.
LEVEL = 2.0
#: Pairs of texts of fewer distinct tokens are found by their first tokens, without exception; the levels begin here.
FEW_TOKENS = 64
#: Words of one hash bucket, on average; beyond twice as many, a bucket passes on its frequent words.
BUCKET_WORDS = 800_000
#: A word held by more contents than this is joined in blocks of about so many.
HOT_WORD = 2_000
#: Bits of the smallest bit sketch; larger texts have about one bit per token.
LEAST_BITS = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)


def squeeze(text: str) -> str:
    return "".join(text.split())


def content_id(squeezed: str) -> int:
    """Identity of a text without white space (64 bits, signed)."""
    return xxhash.xxh3_64_intdigest(squeezed.encode()) - (1 << 63)


def shingles(squeezed: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all substrings of `width` characters."""
    codes = np.frombuffer(squeezed.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = codes[:n].copy()
    for i in range(1, width):
        h *= _MIX
        h ^= h >> np.uint64(29)
        h += codes[i : n + i]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def level_of(size: int) -> int:
    return int(math.log(size, LEVEL) + 1e-9)


def least_tokens(level: int) -> int:
    """Tokens that a word must have to be used, by the largest size of the level."""
    top = LEVEL ** (level + 1)
    return 4 if top >= 400 else 3 if top >= 200 else 2


def expected_equal(size: int, bands: int, least: int, similarity: float) -> float:
    """Words of at least `least` tokens that two texts of `size` tokens at the limit have in common, on average.

    The tokens of a band are Poisson distributed; each is shared with probability s, and
    the other text must have no further ones.
    """
    mean, shared = size / bands, 2 * similarity / (1 + similarity)
    m = mean * shared
    tail = 1 - sum(math.exp(-m) * m**k / math.factorial(k) for k in range(least))
    return bands * math.exp(-2 * mean * (1 - shared)) * tail


@lru_cache(None)
def bands_at(level: int, similarity: float = SIMILARITY, equal: float = EQUAL_BANDS) -> int:
    """Fewest bands with which pairs of the level's least and largest size at the limit share `equal` words
    on average; if none suffice, those with which they share most."""
    bottom, top, least = LEVEL**level, LEVEL ** (level + 1), least_tokens(level)
    shared = [(min(expected_equal(top, g, least, similarity), expected_equal(bottom, g, least, similarity)), g) for g in range(4, int(top))]
    return next((g for e, g in shared if e >= equal), max(shared)[1])


def levels_for(size: int, similarity: float = SIMILARITY) -> list[int]:
    """The levels of the larger text of any pair that this text may be in, as far as it has FEW_TOKENS or more."""
    return list(range(max(level_of(size), level_of(FEW_TOKENS)), level_of(int(size / similarity)) + 1))


def first_tokens(tokens: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """So many of the tokens, in hash order, that any text similar enough has one of them among its own first."""
    return tokens[: len(tokens) - math.ceil(similarity * len(tokens) - 1e-9) + 1]


def largest_difference(a: int, b: int, similarity: float = SIMILARITY) -> int:
    """Tokens that two texts of so many may differ in at the similarity limit."""
    return math.floor((1 - similarity) / (1 + similarity) * (a + b) + 1e-9)


@lru_cache(None)
def guaranteed_bands(level: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(bands, nonempty bands that a text needs): one of the latter is untouched in any pair of the level."""
    least = largest_difference(int(LEVEL ** (level + 1)), int(LEVEL ** (level + 1)), similarity) + 1
    return 2 * least, least


def text_words(tokens: np.ndarray, similarity: float = SIMILARITY, guaranteed: bool = False) -> Iterator[np.ndarray]:
    """All words of a text."""
    first = len(tokens) < FEW_TOKENS
    for level in levels_for(len(tokens), similarity):
        if guaranteed:
            bands, needed = guaranteed_bands(level, similarity)
            words = parity_words(tokens, bands, 1, level)
            first |= len(words) < needed
            yield words
        else:
            yield parity_words(tokens, bands_at(level, similarity), least_tokens(level), level)
    if first:
        yield first_tokens(tokens, similarity)


@lru_cache(1 << 16)
def most_words(chars: int, similarity: float = SIMILARITY, width: int = WIDTH, guaranteed: bool = False) -> int:
    """Words that a text of so many characters may have."""
    tokens = chars - width + 1
    first = len(first_tokens(np.arange(tokens), similarity)) if tokens < FEW_TOKENS or guaranteed else 0
    return first + sum(min(tokens, guaranteed_bands(k, similarity)[0] if guaranteed else bands_at(k, similarity)) for k in levels_for(tokens, similarity))


def bit_sketch(tokens: np.ndarray) -> bytes:
    """The parity of the tokens in each of 2 ** k slots, at least one slot per token."""
    bits = max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length())
    slots = (tokens >> np.uint64(17)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(slots.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two bit sketches, the longer one folded; a lower bound of the tokens that the texts don't share."""
    x, y = (int.from_bytes(s, "little") for s in ((a, b) if len(a) >= len(b) else (b, a)))
    bits = 8 * max(len(a), len(b))
    while bits > 8 * min(len(a), len(b)):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def parity_words(tokens: np.ndarray, bands: int, least: int, salt: int) -> np.ndarray:
    """XOR of the tokens of each band that has `least`, mixed with band and level."""
    band = (tokens >> np.uint64(33)) % np.uint64(bands)
    order = np.argsort(band, kind="stable")
    band, tokens = band[order], tokens[order]
    starts = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
    words = np.bitwise_xor.reduceat(tokens, starts) + band[starts] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt * 0xA0761D6478BD642F % (1 << 64))
    words ^= words >> np.uint64(32)
    words *= _MIX
    words ^= words >> np.uint64(29)
    return words[np.diff(np.append(starts, len(tokens))) >= least]


def sketch(docs: DataFrame, buckets: int, similarity: float = SIMILARITY, width: int = WIDTH, min_chars: int = MIN_CHARS, guaranteed: bool = False) -> DataFrame:
    """bucket, packed: the words of all records, packed as (word, content) pairs of 16 bytes, equal pairs once per batch."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: set[int] = set()
            words, owners = [], []
            for text in pdf["text"]:
                squeezed = squeeze(text)
                if len(squeezed) < min_chars:
                    continue
                content = content_id(squeezed)
                if content in known:
                    continue
                known.add(content)
                for w in text_words(shingles(squeezed, width), similarity, guaranteed):
                    words.append(w)
                    owners.append(np.full(len(w), content, dtype=np.int64))
            if not words:
                continue
            w, o = np.concatenate(words), np.concatenate(owners)
            bucket = (w % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            packed = np.empty((len(w), 2), dtype=np.int64)
            packed[:, 0], packed[:, 1] = w[order].view(np.int64), o[order]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(starts[1:], len(bucket))
            yield pd.DataFrame({"bucket": bucket[starts], "packed": [packed[a:b].tobytes() for a, b in zip(starts, ends)]})

    return docs.select("text").mapInPandas(emit, "bucket bigint, packed binary")


def _settled(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (word, content) pairs in order, and how many contents the word of each has."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))]
    new = np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0]))
    return pairs, np.diff(np.append(np.flatnonzero(new), len(pairs)))[np.cumsum(new) - 1]


def equal_words(sketches: DataFrame, buckets: int, most: int = 2 * BUCKET_WORDS, hot: int = HOT_WORD) -> DataFrame:
    """word, content of all words that at least two different contents have; some rows may come twice.

    A partition is one bucket.  When it holds more than `most` words, those of more than
    `hot` contents are passed on but for one content, by which later ones are recognised.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, limit = [], 0, most
        for pdf in batches:
            for packed in pdf["packed"]:
                held.append(np.frombuffer(packed, dtype=np.int64).reshape(-1, 2))
                size += len(held[-1])
            if size > limit:
                pairs, n = _settled(np.concatenate(held))
                frequent = n > hot
                yield pd.DataFrame({"word": pairs[frequent, 0], "content": pairs[frequent, 1]})
                first = np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0]))
                held = [pairs[~frequent | first]]
                size = len(held[0])
                limit = max(most, 2 * size)
        if held:
            pairs, n = _settled(np.concatenate(held))
            yield pd.DataFrame({"word": pairs[n > 1, 0], "content": pairs[n > 1, 1]})

    return sketches.repartitionById(buckets, F.col("bucket").cast("int")).mapInPandas(match, "word bigint, content bigint")


def candidates(matches: DataFrame, hot: int = HOT_WORD) -> DataFrame:
    """a, b: different contents that share a word, each pair once.

    The contents of a hot word fall into blocks; each pair of blocks is a join key of its
    own, so that no key has more than about twice `hot` rows.
    """
    frequent = matches.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("word", F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
    blocked = (
        matches.join(broadcast_if_small(materialize(frequent), 500_000), "word", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    )
    left = blocked.select("word", F.col("block").alias("lo"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi"), F.col("content").alias("x"))
    right = blocked.select("word", F.explode(F.sequence(F.lit(0), "block")).alias("lo"), F.col("block").alias("hi"), F.col("content").alias("y"))
    met = left.join(right, ["word", "lo", "hi"]).filter("lo < hi or x < y").filter("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def contents(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, min_chars: int = MIN_CHARS, guaranteed: bool = False) -> DataFrame:
    """key, content, words (at most) of every record long enough."""

    def identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, content_id(s), most_words(len(s), similarity, width, guaranteed)) for key, s in zip(pdf["key"], map(squeeze, pdf["text"])) if len(s) >= min_chars]
            yield pd.DataFrame(rows, columns=["key", "content", "words"])

    return docs.select("key", "text").mapInPandas(identify, "key string, content bigint, words bigint").distinct()


def with_bits(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds size (distinct tokens) and bits (the bit sketch) to texts(content, text)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [shingles(squeeze(t), width) for t in pdf["text"]]
            yield pdf.assign(size=[len(t) for t in tokens], bits=[bit_sketch(t) for t in tokens])

    return texts.select("content", "text").mapInPandas(measure, "content bigint, text string, size int, bits binary")


def within_reach(pairs: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The candidate pairs whose sizes and sketch distance allow the similarity; sketches(content, size, bits)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m, n = pdf["size_a"].to_numpy(), pdf["size_b"].to_numpy()
            fits = np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-9
            for i in np.flatnonzero(fits):
                fits[i] = sketch_distance(pdf["bits_a"].iat[i], pdf["bits_b"].iat[i]) <= largest_difference(int(m[i]), int(n[i]), similarity)
            yield pdf.loc[fits, ["a", "b"]]

    side = lambda x: sketches.select(F.col("content").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(judge, "a bigint, b bigint")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 0.0


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """a, b, similarity of the candidate pairs at or above the limit; texts(content, text)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cache: dict[int, np.ndarray] = {}
            rows = []
            for a, b, text_a, text_b in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
                for key, text in ((a, text_a), (b, text_b)):
                    if key not in cache:
                        cache[key] = shingles(squeeze(text), width)
                x, y = cache[a], cache[b]
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                value = jaccard(x, y)
                if value >= similarity:
                    rows.append((a, b, value))
            yield pd.DataFrame(rows, columns=["a", "b", "similarity"])

    joined = (
        pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return joined.mapInPandas(judge, "a bigint, b bigint, similarity double")


def similar_contents(
    docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, min_chars: int = MIN_CHARS, guaranteed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(links a, b, similarity between different contents; members key, content); docs(key, text)."""
    docs = docs.select("key", "text").filter(f"key is not null and length(text) >= {min_chars}")
    members = materialize(contents(docs, similarity, width, min_chars, guaranteed))
    total = members.groupBy("content").agg(F.max("words").alias("words")).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    buckets = buckets_for(total, BUCKET_WORDS)
    pairs = materialize(candidates(materialize(equal_words(sketch(docs, buckets, similarity, width, min_chars, guaranteed), buckets))))
    wanted = pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct()
    # one record stands for each content
    chosen = members.join(wanted, "content").groupBy("content").agg(F.min("key").alias("key"))
    texts = materialize(with_bits(docs.join(chosen, "key").groupBy("content").agg(F.min("text").alias("text")), width))
    near = materialize(within_reach(pairs, texts.select("content", "size", "bits"), similarity))
    return materialize(verify(near, texts, similarity, width)), members.select("key", "content")


def similar_pairs(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, min_chars: int = MIN_CHARS, guaranteed: bool = False) -> DataFrame:
    """key_a, key_b (key_a < key_b), similarity: every pair of records at or above the limit, copies included."""
    links, members = similar_contents(docs, similarity, width, min_chars, guaranteed)
    a = members.select(F.col("content").alias("a"), F.col("key").alias("x"))
    b = members.select(F.col("content").alias("b"), F.col("key").alias("y"))
    apart = links.join(a, "a").join(b, "b").filter("x <> y")
    several = members.groupBy("content").agg(F.count("*").alias("n")).filter("n > 1").select("content")
    copies = members.join(several, "content", "left_semi")
    same = (
        copies.select("content", F.col("key").alias("x")).join(copies.select("content", F.col("key").alias("y")), "content")
        .filter("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    )
    pairs = apart.select("x", "y", "similarity").unionByName(same)
    return pairs.groupBy(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).agg(F.max("similarity").alias("similarity"))


def connected(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root: the least node of each component, by alternating large-star and small-star steps.

    links(a, b).  A step replaces links by links to the least neighbour; it needs
    about log(n) rounds.  A hot node's neighbours are spread by pre-aggregated minima.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        up = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = up.groupBy("u").agg(F.min("v").alias("m"))
        joined = up.join(root, "u")
        small = joined.select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()


def groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, min_chars: int = MIN_CHARS, guaranteed: bool = False) -> DataFrame:
    """key, group, links: every record long enough with the least key of its group and the number of different contents it is linked to."""
    found, members = similar_contents(docs, similarity, width, min_chars, guaranteed)
    roots = connected(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("content")).groupBy("content").agg(F.count("*").alias("links"))
    labelled = (
        members.join(roots.select(F.col("node").alias("content"), "root"), "content", "left").join(degree, "content", "left")
        .select("key", F.coalesce("root", "content").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    names = labelled.groupBy("root").agg(F.min("key").alias("group"))
    return labelled.join(names, "root").select("key", "group", "links")
