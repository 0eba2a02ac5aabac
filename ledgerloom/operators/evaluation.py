"""Retrieval quality and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X


def hit_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 8)) -> DataFrame:
    """questions, mrr and hit rates over ranked(qid, doc_id, idx) against relevant(qid, doc_id); unanswered questions count."""
    first = ranked.join(relevant.distinct(), ["qid", "doc_id"]).groupBy("qid").agg(F.min("idx").alias("first"))
    per = relevant.select("qid").distinct().join(first, "qid", "left")
    rates = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_{k}") for k in ks]
    return per.agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), *rates)


def expected_documents(questions: DataFrame) -> DataFrame:
    """qid, doc_id: the ids that an expectation names; free text names none."""
    found = F.regexp_extract_all(F.coalesce("expected_doc", F.lit("")), F.lit(r"(\d{6}_\d{4}_(?:annual|semi)(?:_\w+)?)"), F.lit(1))
    return questions.select("qid", F.explode(F.array_distinct(found)).alias("doc_id"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """chunks, chars, mean_chars (whole), tables, no_section ratio; repeated rows count once."""
    n = F.count("*")
    bare = F.when(F.coalesce("section", F.lit("")).isin("", X.DEFAULT_PATH), 1.0).otherwise(0.0)
    chars = F.char_length(F.coalesce("text", F.lit("")))
    unique = chunks.select("chunk_id", "type", "section", "text").distinct()
    return unique.agg(
        n.alias("chunks"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"), F.floor(F.coalesce(F.sum(chars), F.lit(0)) / F.greatest(n, F.lit(1))).alias("mean_chars"),
        F.count_if(F.col("type") == "table").alias("tables"), F.round(F.coalesce(F.avg(bare), F.lit(0.0)), 6).alias("no_section"),
    )


def keyword_report(chunks: DataFrame, word: str, limit: int = 20, company: str | None = None, report: str | None = None) -> DataFrame:
    """The first `limit` hits by chunk_id (a report's feature), each with the true number of hits."""
    hits = keyword_hits(chunks, word, company, report)
    return hits.orderBy("chunk_id", "snippet").limit(limit).withColumn("hits", hits.agg(F.count("*")).scalar())


def keyword_hits(chunks: DataFrame, word: str, company: str | None = None, report: str | None = None) -> DataFrame:
    """chunk_id, snippet of the chunks that contain the word; optional substring filters."""
    rows = chunks.filter(F.col("text").contains(word))
    if company:
        rows = rows.filter(F.col("company").contains(company))
    if report:
        rows = rows.filter(F.col("report_label").contains(report))
    return rows.select("chunk_id", X.keyword_context(F.col("text"), word).alias("snippet")).distinct()


def status(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: n_docs, n_pages, n_companies, n_chunks."""
    reports = manifest.groupBy("doc_id").agg(F.max("pages").alias("pages"), F.min("code").alias("code"))
    docs = reports.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("pages"), F.lit(0)).alias("n_pages"), F.count_distinct("code").alias("n_companies"))
    return docs.select("*", chunks.agg(F.count_distinct("chunk_id")).scalar().alias("n_chunks"))


def random_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)
