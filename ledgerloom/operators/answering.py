"""From evidence to answers: prompt budget, generation, citations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The budget of a prompt, the rules that stand before it, and the answer where nothing is found.
MAX_CHUNKS, TOTAL_CHARS, LEAST_CHARS, SNIPPET = 16, 12_000, 400, 180
NOT_FOUND = "提供的资料中未找到相关信息"
RULES = (
    "你是一名严谨的金融财报问答助手。请严格依据用户提供的【资料】回答问题：\n"
    "1. 只使用【资料】中明确出现的信息，禁止编造数字、名称或引入资料之外的知识；\n"
    "2. 引用数字时保持与资料一致（含单位与口径），不要换算或推测；\n"
    "3. 在每处引用的事实后标注来源编号，如 [1]、[2]（编号对应【资料】中各条目）；\n"
    f"4. 若【资料】不足以回答，请直接说明“{NOT_FOUND}”，不要强行作答；\n"
    "5. 涉及公司整体层面的财务数据（营收、净利润等）时，优先采用管理层讨论与分析中的表述口径（通常为合并口径）并注明；若仅有母公司口径数据，必须明确说明“（母公司口径）”；\n"
    "6. 回答简洁：先给结论，再补充必要细节；如涉及多家公司对比，分条列出。"
)


def budgeted(evidence: DataFrame, max_chunks: int = MAX_CHUNKS, total: int = TOTAL_CHARS) -> DataFrame:
    """qid, idx, line: the first max_chunks pieces of evidence, each cut to its share of the budget.

    evidence(qid, idx, company, report_label, section, page, text); idx from 1.
    """
    shown = evidence.filter(F.col("idx") <= max_chunks)
    shares = shown.groupBy("qid").agg(F.greatest(F.lit(LEAST_CHARS), F.floor(F.lit(total) / F.count("*"))).cast("int").alias("share"))
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] 《"), e("company"), F.lit("》"), e("report_label"), F.lit("｜"), e("section"), F.lit("｜第"), e("page"), F.lit("页\n"), F.substring(e("text"), F.lit(1), F.col("share")))
    return shown.join(shares, "qid").select("qid", "idx", line.alias("line"))


def prompts(evidence: DataFrame, questions: DataFrame, max_chunks: int = MAX_CHUNKS, total: int = TOTAL_CHARS, rules: str = RULES) -> DataFrame:
    """qid, question, rules (the system's part) and prompt (the user's)."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "line")))
    bodies = budgeted(evidence, max_chunks, total).groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("body"))
    return questions.select("qid", "question").join(bodies, "qid", "left").select("qid", "question", F.concat(F.lit("【问题】"), "question", F.lit("\n\n【资料】\n"), F.coalesce("body", F.lit(""))).alias("prompt"), F.lit(rules).alias("rules"))


def extractive(prompt: str) -> str:
    """A generator for hosts without a model: quotes the first line of each of the first two sources."""
    parts = prompt.split("\n\n【资料】\n", 1)[-1].split("\n\n[")
    quotes = [p.split("\n")[1][:80] for p in parts[:2] if "\n" in p]
    return "".join(f"{q} [{i}]" for i, q in enumerate(quotes, 1)) or NOT_FOUND


def generate(prompted: DataFrame, generator: Callable[[str], str] = extractive) -> DataFrame:
    """Adds answer; the generator runs on batches in the executors."""

    @F.pandas_udf("string")
    def answer(p: pd.Series) -> pd.Series:
        return p.map(generator)

    return prompted.withColumn("answer", answer("prompt"))


def cited_numbers(answer: Column) -> Column:
    """Distinct citation marks of one or two digits, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))))


def citations(answers: DataFrame, evidence: DataFrame, shown_only: bool = False, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """qid, idx, chunk_id, ..., snippet of the evidence that an answer cites; numbers without evidence are dropped.

    With shown_only, evidence beyond the prompt can't be cited.
    """
    numbers = answers.select("qid", F.explode(cited_numbers(F.col("answer"))).alias("idx"))
    pool = evidence.filter(F.col("idx") <= max_chunks) if shown_only else evidence
    return numbers.join(pool, ["qid", "idx"]).select("qid", "idx", "chunk_id", "company", "report_label", "section", "page", "type", F.substring(F.coalesce("text", F.lit("")), 1, SNIPPET).alias("snippet"))


def envelopes(questions: DataFrame, evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, question, k, answer, evidence and citations as arrays."""
    fields = ["idx", "chunk_id", "score", "company", "report_label", "section", "page", "type"]
    ev = evidence.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("evidence"))
    cites = citations(answers, evidence).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("idx", "chunk_id", "snippet"))).alias("citations"))
    return questions.select("qid", "question", "k").join(answers.select("qid", "answer"), "qid", "left").join(ev, "qid", "left").join(cites, "qid", "left")
