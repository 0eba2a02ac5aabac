"""The stages from the command line: python -m ledgerloom STAGE ... (submit it with spark-submit on a cluster).

    blocks LAYOUTS OUT            layout archives to blocks
    chunk BLOCKS MANIFEST OUT     blocks to chunks with the fields of their report (--docs)
    index CHUNKS COMPANIES KB     a knowledge base
    ask KB QUESTION               one question (--k, --retrieve-only)
    evaluate KB QUESTIONS OUT     a file of questions (--only, --k-override, --retrieve-only)
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.engine import KnowledgeBase
from ledgerloom.operators import blocks, chunking
from ledgerloom.session import ship
from ledgerloom.sources import readers, sinks


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def evaluate(kb: KnowledgeBase, questions: DataFrame, k_override: int = 0, retrieve_only: bool = False) -> DataFrame:
    """The evidence of every question, or its answer with evidence and citations; questions(id, question, k)."""
    k = F.lit(k_override) if k_override else F.col("k")
    asked = questions.select(F.col("id").alias("qid"), "question", k.cast("int").alias("k"))
    return kb.search(asked) if retrieve_only else kb.answer(asked)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    stages = parser.add_subparsers(dest="stage", required=True)
    for stage, paths in (("blocks", ("layouts", "out")), ("chunk", ("blocks", "manifest", "out")), ("index", ("chunks", "companies", "kb")), ("ask", ("kb", "question")), ("evaluate", ("kb", "questions", "out"))):
        p = stages.add_parser(stage)
        for name in paths:
            p.add_argument(name)
        if stage == "chunk":
            p.add_argument("--docs", default="", help="ids of the documents, by commas; all if empty")
        if stage == "ask":
            p.add_argument("--k", type=int, default=8)
        if stage == "evaluate":
            p.add_argument("--only", default="", help="ids of the questions, by commas; all if empty")
            p.add_argument("--k-override", type=int, default=0)
        if stage in ("ask", "evaluate"):
            p.add_argument("--retrieve-only", action="store_true")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("ledgerloom").getOrCreate()
    ship(spark)
    if a.stage == "blocks":
        blocks.flatten_layouts(readers.read_layout_archives(spark, a.layouts)).write.mode("overwrite").parquet(a.out)
    elif a.stage == "chunk":
        rows, manifest = spark.read.parquet(a.blocks), spark.read.parquet(a.manifest)
        if a.docs:
            rows = chunking.selected(rows, manifest, F.col("doc_id").isin(_names(a.docs)))
        chunking.with_report(chunking.chunk_blocks(rows), manifest).write.mode("overwrite").parquet(a.out)
    elif a.stage == "index":
        KnowledgeBase.build(spark.read.parquet(a.chunks), spark.read.parquet(a.companies), a.kb)
    elif a.stage == "ask":
        kb = KnowledgeBase.open(spark, a.kb)
        one = spark.createDataFrame([("q", a.question, a.k)], "id string, question string, k int")
        evaluate(kb, one, 0, a.retrieve_only).show(truncate=False, vertical=True)
    else:
        questions = readers.read_questions(spark, a.questions, _names(a.only) or None)
        sinks.write_jsonl(evaluate(KnowledgeBase.open(spark, a.kb), questions, a.k_override, a.retrieve_only), a.out)


if __name__ == "__main__":
    main()
