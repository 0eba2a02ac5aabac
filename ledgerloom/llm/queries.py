"""Queries of the training-data operators; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import boilerplate, glyphs, leakage, neardup, packing, pairs, quality, sentences, splitting
from ledgerloom.session import materialize, table


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.stored_values(table(spark, d, "blocks"), table(spark, d, "chunks"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(table(spark, d, "eval_raw"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pairs.tagged(table(spark, d, "eval_raw"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.find_disguised(_stored(spark, d))


def p2_normalised(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.normalise(_stored(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    lines = boilerplate.boilerplate_lines(boilerplate.text_chunks(table(spark, d, "chunks")))
    return lines.select(F.col("key").alias("chunk_id"), "line_no")


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    cleaned = boilerplate.without_boilerplate(boilerplate.text_chunks(table(spark, d, "chunks")))
    return cleaned.select(F.col("key").alias("chunk_id"), "text", "removed")


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The maximal repeated blocks of one or more lines, by a digest of their line identifiers."""
    sequences = boilerplate.line_sequences(boilerplate.text_chunks(table(spark, d, "chunks")), 12)
    blocks = boilerplate.maximal_blocks(materialize(sequences))
    return blocks.select(F.col("source").alias("company"), "block", "lines", "docs")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.find_oversized(splitting.long_texts(table(spark, d, "chunks"), table(spark, d, "blocks")))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_pieces(splitting.long_texts(table(spark, d, "chunks"), table(spark, d, "blocks")))


def _keyed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("chunk_id").alias("key"), "type", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.mislabelled(_keyed_chunks(spark, d)).select(F.col("key").alias("chunk_id"), "kind")


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_statistics(_keyed_chunks(spark, d)).withColumnRenamed("key", "chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.similar_pairs(_keyed_chunks(spark, d).filter("type = 'text'"))
    return found.select(F.col("key_a").alias("chunk_a"), F.col("key_b").alias("chunk_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """The similarity and the tokens that the problem states: 0.7 on five characters."""
    return neardup.groups(_keyed_chunks(spark, d).filter("type = 'text'")).select(F.col("key").alias("chunk_id"), F.col("group").alias("group_id"), "links")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_tokens").alias("size"))
    return packing.pack(items).select(F.col("key").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_bounds(table(spark, d, "documents")).select("doc_id", "sent_end").distinct()


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "test_items"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_coverage, p2_found, p2_normalised, p3_found, p3_cleaned, p3_blocks, p4_found, p4_pieces, p5_found, p5_statistics,
        p6_found, p6_groups, p7_containers, p8_found, p8_spans, p9_found, p9_sentences,
    )
}
