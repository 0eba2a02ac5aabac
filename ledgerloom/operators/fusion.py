"""Hybrid retrieval: reciprocal-rank fusion of two lists, metadata boosts, balanced retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import vectors as V
from ledgerloom.session import broadcast_if_small

RRF_K = 60
#: Names, and candidate chunks, that are broadcast; more are joined by shuffle.
MOST_NAMES, MOST_CANDIDATES = 200_000, 500_000

# The boosts, in units of 1 / (RRF_K + 1).
MENTIONED, NOT_MENTIONED, PERIOD_TYPE, EXACT_PERIOD, NARRATIVE, ATTRIBUTION = 0.30, -0.20, 0.50, 0.50, 0.20, 0.35


def mentioned_names(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """qid, question, name of the names that a question contains: an equi join on the first two
    characters of the names, then the whole name."""
    names = companies.select("name").filter("name <> ''").distinct().withColumn("start", F.substring("name", 1, 2))
    places = F.sequence(F.lit(1), F.char_length("question"))
    # a name of one character meets the last character of a question too
    starts = F.array_distinct(F.concat(F.transform(places, lambda i: F.substring("question", i, F.lit(2))), F.transform(places, lambda i: F.substring("question", i, F.lit(1)))))
    asked = questions.select("qid", "question").filter("question <> ''").select("qid", "question", F.explode(starts).alias("start"))
    met = asked.join(broadcast_if_small(names, MOST_NAMES), "start").filter(F.contains("question", "name"))
    return met.select("qid", "question", "name").distinct()


def question_intent(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds k (0 and null are 8), mentioned (names, sorted), prefer, years, attribution, panorama."""
    q = F.col("question")
    found = mentioned_names(questions, companies).groupBy("qid", "question").agg(F.array_sort(F.collect_set("name")).alias("mentioned"))
    return questions.join(found, ["qid", "question"], "left").withColumns({
        "k": F.coalesce(F.nullif(F.col("k"), F.lit(0)), F.lit(8)),
        "mentioned": F.coalesce("mentioned", F.array().cast("array<string>")),
        "prefer": F.when(q.rlike(X.SEMI_WORDS), "semi").otherwise("annual"),
        "years": F.array_sort(F.array_distinct(F.regexp_extract_all(q, F.lit(r"(20\d{2})"), F.lit(1)))),
        "attribution": q.rlike(X.ATTRIBUTION_WORDS),
    }).withColumn("panorama", (F.size("mentioned") == 0) & q.rlike(X.PANORAMA_WORDS))


def chunk_flags(chunks: DataFrame) -> DataFrame:
    """What ranking needs of a chunk, without its text: narrative and attribution as flags; one row per chunk."""
    t = F.coalesce("text", F.lit(""))
    narrative = t.rlike("营业收入|净利润") & t.rlike("同比|较上年")
    flags = chunks.select("chunk_id", "company", "code", "doc_id", "report_type", "report_label", "section", "page", "type", "n_chars", narrative.alias("narrative"), t.contains(X.ATTRIBUTION_TEXT).alias("attribution_text"))
    return flags.dropDuplicates(["chunk_id"])


def candidate_flags(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The flags of the candidate chunks only, so that no other text is looked at; candidates(chunk_id, ...), written."""
    wanted = broadcast_if_small(candidates.select("chunk_id").distinct(), MOST_CANDIDATES)
    return chunk_flags(chunks.join(wanted, "chunk_id", "left_semi"))


def with_similarity(ranked: DataFrame, embeddings: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds vec_sim, the similarity of question and chunk to four places, also of chunks that only the words found;
    embeddings(key, embedding), questions(qid, embedding); null where either has no vector."""
    wanted = broadcast_if_small(ranked.select("chunk_id").distinct(), MOST_CANDIDATES)
    near = embeddings.select(F.col("key").alias("chunk_id"), F.col("embedding").alias("chunk_vector")).join(wanted, "chunk_id", "left_semi")
    both = ranked.join(near, "chunk_id", "left").join(questions.select("qid", F.col("embedding").alias("question_vector")), "qid", "left")
    return both.withColumn("vec_sim", F.round(F.round(V.dot(F.col("chunk_vector"), F.col("question_vector")), 6), 4)).drop("chunk_vector", "question_vector")


def rrf(dense: DataFrame, lexical: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """qid, chunk_id, fused, vec_rank, bm25_rank, vec_sim from two lists (qid, chunk_id, rank), in one shuffle."""
    both = dense.select("qid", "chunk_id", F.col("rank").alias("vec_rank"), F.lit(None).cast("int").alias("bm25_rank")).unionByName(
        lexical.select("qid", "chunk_id", F.lit(None).cast("int").alias("vec_rank"), F.col("rank").alias("bm25_rank"))
    )
    part = lambda c: F.coalesce(1 / (F.lit(rrf_k + 1) + F.col(c)), F.lit(0.0))
    return both.groupBy("qid", "chunk_id").agg(F.max("vec_rank").alias("vec_rank"), F.max("bm25_rank").alias("bm25_rank")).withColumn("fused", part("vec_rank") + part("bm25_rank"))


def boosts(rrf_k: int = RRF_K) -> Column:
    """The boost of a candidate row that has the intent of its question and the flags of its chunk."""
    unit = 1.0 / (rrf_k + 1)
    company = F.when(F.size("mentioned") > 0, F.when(F.array_contains("mentioned", F.coalesce("company", F.lit(""))), MENTIONED).otherwise(NOT_MENTIONED)).otherwise(0.0)
    period = F.when(F.col("report_type") == F.col("prefer"), PERIOD_TYPE).otherwise(0.0)
    narrative = F.when(F.col("narrative"), NARRATIVE).otherwise(0.0)
    attribution = F.when(F.col("attribution") & F.col("attribution_text"), ATTRIBUTION).otherwise(0.0)
    tag = F.when(F.col("prefer") == "semi", "年半年度报告").otherwise("年年度报告")
    label = F.coalesce("report_label", F.lit(""))
    # the label names the report, "2024年年度报告"; the question's year and kind must both be in it
    exact = F.when(F.exists("years", lambda y: F.contains(label, F.concat(y, tag))), EXACT_PERIOD).otherwise(0.0)
    return (company + period + narrative + attribution + exact) * F.lit(unit)


def rank_fused(fused: DataFrame, intents: DataFrame, flags: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """qid, chunk_id, score, vec_rank, bm25_rank, idx: the k best of each question, idx from 1.

    Ties go to the dense list's members in their order, then to the lexical list's.
    """
    rows = fused.join(flags, "chunk_id").join(intents.select("qid", "k", "mentioned", "prefer", "years", "attribution"), "qid")
    scored = rows.withColumn("score", F.round(F.col("fused") + boosts(rrf_k), 6))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("bm25_rank"), "chunk_id")
    return scored.withColumn("idx", F.row_number().over(order)).filter(F.col("idx") <= F.col("k")).select("qid", "idx", "chunk_id", "score", "vec_rank", "bm25_rank")


def balanced(per_company: DataFrame, intents: DataFrame) -> DataFrame:
    """qid, chunk_id, score, idx: the best of every company by similarity, then the second best, k in all.

    per_company(qid, chunk_id, sim, rank) has each company's two best rows per question.
    """
    order = Window.partitionBy("qid").orderBy("rank", F.desc("sim"), "chunk_id")
    rows = per_company.join(intents.select("qid", "k"), "qid").withColumn("idx", F.row_number().over(order)).filter(F.col("idx") <= F.col("k"))
    return rows.select("qid", "idx", "chunk_id", F.col("sim").alias("score"))


def with_chunks(ranked: DataFrame, chunks: DataFrame, intents: DataFrame) -> DataFrame:
    """The ranked rows, written, with the chunk's fields and texts, which take no part in ranking."""
    fields = ["company", "code", "doc_id", "report_label", "section", "page", "type", "text", "html", "n_chars"]
    wanted = broadcast_if_small(ranked.select("chunk_id").distinct(), MOST_CANDIDATES)
    texts = chunks.select("chunk_id", *fields).join(wanted, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    named = F.array_contains("mentioned", F.coalesce("company", F.lit("")))
    return ranked.join(texts, "chunk_id").join(intents.select("qid", "question", "mentioned"), "qid").withColumn("mentioned_company", named).drop("mentioned")
