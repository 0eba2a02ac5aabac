"""The knowledge base as one object: build its tables once, ask it batches of questions.

    kb = KnowledgeBase.build(chunks, companies, path)
    kb.search(questions).show()
    kb.answer(questions).show()
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import answering, dense, fusion, lexical
from ledgerloom.session import materialize, spread

K_EACH = 80
TABLES = ("chunks", "companies", "postings", "lengths", "embeddings")


def chunk_embeddings(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """key, company, embedding of every chunk, by the embedder that needs no model; a limit is for embedders that have one."""
    body = X.document_text(F.col("company"), F.col("report_label"), F.col("section"), F.col("text"), limit)
    texts = spread(chunks.select(F.col("chunk_id").alias("key"), "company", body.alias("body")), "key").dropDuplicates(["key"])
    return dense.hashed_embeddings(texts, "key", "company")


def question_embeddings(questions: DataFrame) -> DataFrame:
    return dense.hashed_embeddings(questions.select("qid", F.col("question").alias("body")), "qid")


@dataclass(frozen=True)
class KnowledgeBase:
    """Tables of a built knowledge base; embed_questions must belong to the embedder of the chunks."""

    tables: dict[str, DataFrame]
    embed_questions: Callable[[DataFrame], DataFrame] = question_embeddings

    @classmethod
    def build(cls, chunks: DataFrame, companies: DataFrame, path: str, embed_chunks=chunk_embeddings, embed_questions=question_embeddings) -> KnowledgeBase:
        """Write the tables under path and open them; an existing knowledge base is replaced."""
        spark = chunks.sparkSession
        save = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
        save(chunks.dropDuplicates(["chunk_id"]), "chunks")
        save(companies, "companies")
        stored = spark.read.parquet(f"{path}/chunks")
        save(lexical.term_counts(stored), "postings")
        save(lexical.build_index(stored, postings=spark.read.parquet(f"{path}/postings"))["lengths"], "lengths")
        save(embed_chunks(stored), "embeddings")
        return cls.open(spark, path, embed_questions)

    @classmethod
    def open(cls, spark: SparkSession, path: str, embed_questions=question_embeddings) -> KnowledgeBase:
        return cls({name: spark.read.parquet(f"{path}/{name}") for name in TABLES}, embed_questions)

    def intents(self, questions: DataFrame) -> DataFrame:
        return fusion.question_intent(questions, self.tables["companies"])

    def search(self, questions: DataFrame, k_each: int = K_EACH) -> DataFrame:
        """Evidence for questions(qid, question, k): qid, idx, chunk_id, score, vec_rank, bm25_rank, vec_sim and the chunk's fields."""
        t = self.tables
        intents, vectors = materialize(self.intents(questions)), materialize(self.embed_questions(questions))
        index = {"postings": t["postings"], "lengths": t["lengths"], "meta": lexical.corpus_meta(t["lengths"])}
        near = dense.cosine_topk(t["embeddings"], vectors, k_each).withColumnRenamed("key", "chunk_id")
        fused = materialize(fusion.rrf(near, lexical.bm25_topk(index, questions, k_each)))
        ranked = fusion.rank_fused(fused, intents, fusion.candidate_flags(t["chunks"], fused))
        plain = ranked.join(intents.filter("not panorama").select("qid"), "qid", "left_semi").select("qid", "idx", "chunk_id", "score")
        comparing = intents.filter("panorama")
        two = dense.cosine_topk(t["embeddings"], vectors.join(comparing.select("qid"), "qid", "left_semi"), 2, group="company")
        balanced = fusion.balanced(two.withColumnRenamed("key", "chunk_id"), comparing).select("qid", "idx", "chunk_id", "score")
        # k rows a question; written, as ranking and texts read them
        picked = materialize(plain.unionByName(balanced))
        scored = materialize(fusion.with_similarity(picked.join(fused.select("qid", "chunk_id", "vec_rank", "bm25_rank"), ["qid", "chunk_id"], "left"), t["embeddings"], vectors))
        return fusion.with_chunks(scored, t["chunks"], intents)

    def answer(self, questions: DataFrame, generator: Callable[[str], str] = answering.extractive) -> DataFrame:
        """qid, question, k, answer, evidence, citations."""
        intents = self.intents(questions)
        evidence = materialize(self.search(questions))  # prompts, envelopes and citations read it
        return answering.envelopes(intents, evidence, answering.generate(answering.prompts(evidence, intents), generator))

    def ask(self, question: str, k: int = 8) -> DataFrame:
        """One question, as a batch of one; a blank question is refused."""
        if not question or not question.strip():
            raise ValueError("the question is blank")
        one = self.tables["chunks"].sparkSession.createDataFrame([("q", question, k)], "qid string, question string, k int")
        return self.answer(one)
