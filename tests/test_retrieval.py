import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.engine import KnowledgeBase
from ledgerloom.functions import text as X
from ledgerloom.operators import answering as AN
from ledgerloom.operators import dense, evaluation, fusion, lexical
from ledgerloom.operators.best import Best
from ledgerloom.plans import retrieval
from ledgerloom.schemas import CHUNKS
from ledgerloom.session import materialize

DATA = "/root/testdata/sf0.001"

COMPANIES = [("1", "甲公司", None, None, None), ("2", "乙公司", None, None, None)]


def chunk(i, text, company="甲公司", label="2025年年度报告", kind="annual", section="第一节"):
    return (f"c{i}", f"d{i % 3}", company, "1", kind, label, section, 1, "text", text, "", "", 1)


def questions(spark, *rows):
    return spark.createDataFrame([(f"q{i}", *r) for i, r in enumerate(rows)], "qid string, question string, k int")


def test_bm25_equals_a_plain_loop(spark):
    texts = ["alpha beta beta", "beta gamma", "营业收入 增长", None, "alpha"]
    rows = [chunk(i, t, section=None if i == 1 else "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:1], CHUNKS)
    got = {(r["qid"], r["chunk_id"]): r["score"] for r in lexical.bm25_scores(lexical.build_index(df), questions(spark, ("alpha beta nothing", 3))).collect()}
    bags = {f"c{i}": Counter(r["w"]) for i in range(5) for r in [df.filter(f"chunk_id = 'c{i}'").select(X.tokens(lexical.indexed_text()).alias("w")).first()]}
    n, mean = 5, sum(sum(b.values()) for b in bags.values()) / 5
    want = {}
    for c, bag in bags.items():
        score = 0
        for t in ("alpha", "beta", "nothing"):
            df_t = sum(t in b for b in bags.values())
            if bag[t]:
                score += math.log(1 + (n - df_t + 0.5) / (df_t + 0.5)) * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / mean))
        if score:
            want["q0", c] = round(score, 6)
    assert got == pytest.approx(want)


def test_golden_fusion_scores(spark):
    """Recorded ranks and scores; the boosts follow from the flags."""
    golden = [
        (10, 2, True, True, True, True, False, 0.054548), (None, 4, True, True, True, True, False, 0.039975), (0, None, True, True, True, False, False, 0.037705), (1, None, True, True, True, False, True, 0.043178),
        (41, None, True, True, True, True, True, 0.040132), (69, 36, True, True, True, False, False, 0.039313), (0, 35, True, False, False, False, True, 0.037466), (None, 0, False, True, True, True, True, 0.038525), (2, 31, True, False, False, False, True, 0.037398),
    ]
    for v, b, mentioned, kind, exact, narrative, attribution, score in golden:
        fused = (1 / (61 + v) if v is not None else 0) + (1 / (61 + b) if b is not None else 0)
        row = [("q", "c", fused, v, b, ["甲公司"], "甲公司" if mentioned else "乙公司", "annual" if kind else "semi", "annual", ["2025"], "2025年年度报告" if exact else "2024年年度报告", narrative, attribution, attribution)]
        df = spark.createDataFrame(row, "qid string, chunk_id string, fused double, vec_rank int, bm25_rank int, mentioned array<string>, company string, report_type string, prefer string, years array<string>, report_label string, narrative boolean, attribution boolean, attribution_text boolean")
        assert df.select(F.round(F.col("fused") + fusion.boosts(), 6)).first()[0] == pytest.approx(score, abs=1.5e-6)


def test_rrf_and_ties(spark):
    d = spark.createDataFrame([("q0", "a", 0), ("q0", "b", 1)], "qid string, chunk_id string, rank int")
    b = spark.createDataFrame([("q0", "c", 0), ("q0", "b", 1)], "qid string, chunk_id string, rank int")
    got = {r["chunk_id"]: r["fused"] for r in fusion.rrf(d, b).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 2 / 62, "c": 1 / 61})
    chunks = spark.createDataFrame([(x, "d", "丙", "1", "none", "", "", 1, "text", "", "", "", 1) for x in "abc"], CHUNKS)
    intents = fusion.question_intent(questions(spark, ("问题", 0)), spark.createDataFrame(COMPANIES, "code string, name string, a string, b string, c string"))
    ranked = fusion.rank_fused(fusion.rrf(d, b), intents, fusion.chunk_flags(chunks)).orderBy("idx").collect()
    assert [r["chunk_id"] for r in ranked] == ["b", "a", "c"]


def test_intent(spark):
    rows = [("甲公司2025年与2024年，2025年度营业收入？", None), ("甲公司上半年归母净利润？", 5), ("哪家公司最高？", 0), ("甲公司和乙公司对比", 24), (None, 3)]
    got = {r["qid"]: r for r in fusion.question_intent(questions(spark, *rows), spark.createDataFrame(COMPANIES, "code string, name string, a string, b string, c string")).collect()}
    assert got["q0"]["years"] == ["2024", "2025"] and got["q0"]["k"] == 8 and got["q0"]["prefer"] == "annual"
    assert got["q1"]["prefer"] == "semi" and got["q1"]["attribution"] and got["q1"]["k"] == 5
    assert got["q2"]["panorama"] and got["q2"]["k"] == 8 and not got["q3"]["panorama"] and got["q3"]["mentioned"] == ["乙公司", "甲公司"]


def test_cosine_blocks_and_groups(spark):
    rows = [(i, [math.cos(i), math.sin(i)], "x" if i % 3 else None) for i in range(60)] + [(99, None, "x")]
    vectors = spark.createDataFrame(rows, "key bigint, embedding array<double>, company string").repartition(5)
    asked = vectors.filter("key % 20 = 0").select(F.col("key").alias("qid"), "embedding")
    want = {(q, i, round(math.cos(q - i), 6)) for q in (0, 20, 40) for i in sorted(range(60), key=lambda i: (-round(math.cos(q - i), 6), i))[:4]}
    for block in (1, 2, 100):
        assert {(r["qid"], r["key"], r["sim"]) for r in dense.cosine_topk(vectors, asked, 4, block=block).collect()} == want
    assert dense.cosine_topk(vectors, asked, 2, group="company").count() == 12
    assert dense.cosine_topk(vectors, asked.limit(0), 2).count() == 0


def test_balanced_order(spark):
    rows = [("q0", "a1", 0.9, 0), ("q0", "a2", 0.8, 1), ("q0", "b1", 0.5, 0), ("q0", "b2", 0.4, 1), ("q0", "c1", 0.7, 0)]
    df = spark.createDataFrame(rows, "qid string, chunk_id string, sim double, rank int")
    got = fusion.balanced(df, questions(spark, ("?", 4))).orderBy("idx").collect()
    assert [r["chunk_id"] for r in got] == ["a1", "c1", "b1", "a2"]


EVIDENCE = "qid string, idx int, company string, report_label string, section string, page int, text string, chunk_id string, type string"


@pytest.mark.parametrize("n,share", [(8, 1500), (16, 750), (24, 750), (1, 12000)])
def test_budget(spark, n, share):
    rows = [("q", i, "甲", "L", "S", 3, "字" * 20000, f"c{i}", "text") for i in range(1, n + 1)]
    got = AN.budgeted(spark.createDataFrame(rows, EVIDENCE)).orderBy("idx").collect()
    assert len(got) == min(n, 16) and all(len(r["line"].split("\n")[1]) == share for r in got) and got[0]["line"].startswith("[1] 《甲》L｜S｜第3页\n")


def test_citations(spark):
    ev = spark.createDataFrame([("q", i, "甲", "L", "S", 3, "x" * 300, f"c{i}", "text") for i in range(1, 9)], EVIDENCE)
    ans = spark.createDataFrame([("q", "x [2][9] y [2] [123] [08]"), ("p", None), ("r", "[1]")], "qid string, answer string")
    got = AN.citations(ans, ev).orderBy("idx").collect()
    assert [(r["idx"], len(r["snippet"])) for r in got] == [(2, 180), (8, 180)]


def test_answers_end_to_end(spark):
    qs = questions(spark, ("甲公司收入？", 2), ("乙？", 2))
    ev = spark.createDataFrame([("q0", 1, "甲", "L", "S", 3, "收入上升。", "c1", "text", 0.5), ("q0", 2, "甲", "L", "S", 3, "成本下降。", "c2", "text", 0.4)], EVIDENCE + ", score double")
    answers = AN.generate(AN.prompts(ev, qs))
    got = {r["qid"]: r for r in AN.envelopes(qs, ev, answers).collect()}
    assert got["q0"]["answer"] == "收入上升。 [1]成本下降。 [2]" and [c["chunk_id"] for c in got["q0"]["citations"]] == ["c1", "c2"]
    assert got["q1"]["evidence"] is None and "未找到" in got["q1"]["answer"]


def test_metrics(spark):
    ranked = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 1)], "qid string, doc_id string, idx int")
    relevant = spark.createDataFrame([("a", "x"), ("b", "w"), ("c", "z"), ("a", "x")], "qid string, doc_id string")
    r = evaluation.hit_metrics(ranked, relevant).first()
    assert (r["questions"], r["mrr"], r["hit_1"], r["hit_5"]) == (3, round(0.5 / 3, 6), 0.0, round(1 / 3, 6))
    named = evaluation.expected_documents(spark.createDataFrame([("a", "960000_2012_semi_v00005 / 960003_2013_annual"), ("b", "各公司"), ("c", None)], "qid string, expected_doc string"))
    assert {(r["qid"], r["doc_id"]) for r in named.collect()} == {("a", "960000_2012_semi_v00005"), ("a", "960003_2013_annual")}


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], CHUNKS)
    index = lexical.build_index(empty)
    assert index["meta"].first().asDict() == {"n_docs": 0, "avg_len": 0.0, "k1": 1.5, "b": 0.75}
    assert lexical.bm25_topk(index, questions(spark, ("x", 1))).count() == 0 and evaluation.corpus_statistics(empty).first()["chunks"] == 0


def test_knowledge_base(spark, tmp_path):
    rows = [chunk(i, f"第{i}项 营业收入 同比 增长 {w}", company=c) for i, (w, c) in enumerate([("alpha", "甲公司"), ("beta", "乙公司"), ("alpha beta", "丙公司"), ("gamma", "甲公司")])]
    companies = spark.createDataFrame(COMPANIES, "code string, name string, a string, b string, c string")
    KnowledgeBase.build(spark.createDataFrame(rows + rows[:1], CHUNKS), companies, str(tmp_path / "kb"))
    kb = KnowledgeBase.open(spark, str(tmp_path / "kb"))
    qs = questions(spark, ("甲公司 alpha 营业收入？", 2), ("哪家公司 beta 最高？", 5), ("没有", 1))
    found = {(r["qid"], r["idx"]): r["chunk_id"] for r in kb.search(qs).collect()}
    assert found["q0", 1] == "c0" and {k[0] for k in found} >= {"q0", "q1"} and len([k for k in found if k[0] == "q1"]) == 4
    got = kb.ask("甲公司 alpha？", 2).first()
    assert got["answer"] and len(got["evidence"]) == 2 and got["citations"][0]["idx"] == 1
    with pytest.raises(ValueError):
        kb.ask("  ")


def shuffled_bytes(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def shuffled_rows(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_shuffles_the_best_of_each_task_only(spark, tmp_path):
    """400 questions share a term with all of 500 chunks; one row for each pair would be 200,000."""
    rows = [chunk(1000 + i, f"gemeinsam wort{i % 50} " + "x " * (i % 7)) for i in range(500)]
    spark.createDataFrame(rows, CHUNKS).write.parquet(str(tmp_path / "chunks"))
    index = lexical.build_index(spark.read.parquet(str(tmp_path / "chunks")))
    asked = questions(spark, *((f"gemeinsam wort{i % 60} frage{i}", 3) for i in range(400)))
    scores = {}
    for r in lexical.bm25_scores(index, asked).collect():
        scores.setdefault(r["qid"], []).append((-r["score"], r["chunk_id"]))
    before = shuffled_bytes(spark)
    got = lexical.bm25_topk(index, asked, 3).collect()
    assert shuffled_bytes(spark) - before < 500_000
    assert {(r["qid"], r["rank"], r["chunk_id"], r["score"]) for r in got} == {(q, i, c, -s) for q, all_ in scores.items() for i, (s, c) in enumerate(sorted(all_)[:3])}


def test_counted_chunks_take_every_body_of_a_chunk_once(spark):
    rows = [chunk(1, "alpha beta 甲公司 beta"), chunk(1, "alpha gamma"), chunk(2, None), chunk(3, "beta\n营业收入")]
    df = spark.createDataFrame(rows + rows[:2], CHUNKS).repartition(3)
    asked = lexical.asked_terms(questions(spark, ("alpha beta 营业", 1), ("nothing", 1), ("公司 beta", 2), (None, 1)))
    index = lexical.build_index(df)
    both = [{r["chunk_id"]: r for r in t.collect()} for t in (lexical.counted_chunks(df, asked, dim=64), lexical.counted_postings(index, asked))]
    for c in ("c1", "c2", "c3"):
        tfs = []
        for t in both:
            tfs.append({n: 0 for n in t[c]["terms"]})
            for n, tf in zip(t[c]["terms"], t[c]["tfs"], strict=True):
                tfs[-1][n] += tf
        assert tfs[0] == tfs[1] and both[0][c]["dl"] == both[1][c]["dl"]
    want = {(r["qid"], r["chunk_id"]): r["score"] for r in lexical.bm25_scores(index, questions(spark, ("alpha beta 营业", 1), ("nothing", 1), ("公司 beta", 2))).collect()}
    got = {(r["qid"], r["chunk_id"]): r["score"] for r in lexical.counted_topk(lexical.counted_chunks(df, asked), asked, 9).collect()}
    assert got == pytest.approx(want) and len(got) == 5


SEARCHES = [
    "answer_questions",
    "evidence_budget",
    "hit_at_k_mrr",
    "evidence_scores",
    "hybrid_search",
    "citation_join",
    "fused_boosts",
    "rrf_fuse",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", SEARCHES)
def test_searches_write_neither_all_postings_nor_all_vectors(spark, monkeypatch, name):
    written = []
    monkeypatch.setattr(retrieval, "materialize", lambda df: written.append(df.columns) or materialize(df))
    assert retrieval.QUERIES[name](spark, DATA).columns
    assert written and not any({"term", "embedding"} & set(columns) for columns in written)


def test_best_equals_a_plain_sort():
    rng = np.random.default_rng(1)
    for _ in range(200):
        k, n, positive = int(rng.integers(1, 6)), int(rng.integers(1, 5)), bool(rng.integers(2))
        top, rows, given = Best(k, n, positive=positive, pending=int(rng.integers(1, 60))), [[] for _ in range(n)], 0
        for _ in range(int(rng.integers(0, 8))):
            m = int(rng.integers(1, 20))
            scores = rng.integers(-2, 4, (n, m)) / 4 + rng.integers(0, 2, (n, m)) * 3e-7
            if not positive:
                scores[rng.random((n, m)) < 0.05] = np.nan
            keys = np.array([f"c{rng.integers(1000)}_{given + i}" for i in range(m)], dtype=object)
            given += m
            top.add(scores, keys)
            for row, mine in zip(rows, scores, strict=True):
                row += [(-np.inf if np.isnan(s) else -np.round(s, 6), key) for s, key in zip(mine, keys, strict=True) if not positive or s > 0]
        got = [[] for _ in range(n)]
        for row, score, key in zip(*top.result(), strict=True):
            got[row].append((-np.inf if np.isnan(score) else -score, key))
        assert got == [sorted(row)[:k] for row in rows]


def test_cosine_groups_equal_a_plain_sort_when_tasks_begin_anew(spark, monkeypatch):
    monkeypatch.setattr(dense, "MOST_KEPT", 20)
    monkeypatch.setattr(dense, "AT_ONCE", 1)
    rows = [(f"k{i:03}", [math.cos(i), math.sin(i)], [None, "x", "y", "z"][i % 4]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "key string, embedding array<double>, company string").repartition(3)
    asked = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(5)], "qid int, embedding array<double>")
    want = set()
    for q in range(5):
        for c in (None, "x", "y", "z"):
            mine = sorted((-round(math.cos(i) * math.cos(q) + math.sin(i) * math.sin(q), 6), key) for i, (key, _, company) in enumerate(rows) if company == c)
            want |= {(q, key, c, -sim, rank) for rank, (sim, key) in enumerate(mine[:2])}
    assert {tuple(r[c] for c in ("qid", "key", "company", "sim", "rank")) for r in dense.cosine_topk(vectors, asked, 2, group="company").collect()} == want


SHUFFLING = [
    "evidence_budget",
    "hit_at_k_mrr",
    "evidence_scores",
    "hybrid_search",
    "citation_join",
    "fused_boosts",
    "rrf_fuse",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", SHUFFLING)
def test_searches_shuffle_the_best_of_each_task_only(spark, name):
    """80 rows of each of 6 questions for each of 4 tasks and list; for each batch of 50 chunks it would be 18,000 of vectors."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        before = shuffled_rows(spark)
        assert retrieval.QUERIES[name](spark, "/root/testdata/sf0.01").count()
        assert shuffled_rows(spark) - before < 15_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


@pytest.mark.parametrize("most", [500_000, 1])
def test_counted_chunks_do_not_depend_on_what_is_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "MOST_REPEATED", most)
    rows = [chunk(i, f"alpha beta{i % 3} " * (i % 4)) for i in range(20)] + [chunk(3, "alpha other"), chunk(4, "beta1"), (None, *chunk(0, "alpha")[1:]), (None, *chunk(0, "beta0")[1:])]
    asked = lexical.asked_terms(questions(spark, ("alpha beta0 beta1 other", 1)))
    for some in (rows, rows[:-1], rows[:20]):
        df = spark.createDataFrame(some + some[:1], CHUNKS).repartition(3)
        lengths = {r["chunk_id"]: r["dl"] for r in lexical.build_index(df)["lengths"].collect()}
        got = lexical.counted_chunks(df, asked, dim=64).collect()
        assert len(got) == len(lengths) and {r["chunk_id"]: r["dl"] for r in got} == lengths
        bodies = dict(df.filter("chunk_id is not null").select("chunk_id", X.document_text(F.col("company"), F.col("report_label"), F.col("section"), F.col("text"), None).alias("body")).distinct().groupBy("chunk_id").agg(F.sum(F.size(X.tokens(F.col("body"))))).collect())
        assert {r["chunk_id"]: sum(r["slots"]) for r in got if r["chunk_id"]} == bodies


UNSHUFFLED = [
    "hit_at_k_mrr",
    "evidence_scores",
    "hybrid_search",
    "citation_join",
    "fused_boosts",
    "rrf_fuse",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", UNSHUFFLED)
def test_searches_shuffle_no_counts_of_chunks_that_occur_once(spark, name):
    """3,000 chunks, whose counts would be 1.0 MB of 1.1; what is left is mostly the best of each task."""
    before = shuffled_bytes(spark)
    assert retrieval.QUERIES[name](spark, "/root/testdata/sf0.01").count()
    assert shuffled_bytes(spark) - before < 500_000


def test_split_words_equals_tokens(spark):
    """Every code point next to others, and runs of odd ones."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["", " ", "营业收入 HBM-3，乙 Ab", "乙", "甲\n乙丙\n", *("".join(c + "中" + c for c in points[i : i + 2000]) + " ".join(points[i : i + 2000]) for i in range(0, len(points), 2000))]
    rng = np.random.default_rng(2)
    odd = [*"中文aZ9é，\n 々〇㐀豈İß٣", *map(chr, (0x20000, 0x2F800, 0x16FF0, 0x1D400))]
    texts += ["\U00020000中", "中\U00020000", "a\U00020000\U00020001"]
    texts += ["".join(rng.choice(odd, int(rng.integers(30)))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.lowered(F.col("t")).alias("low"), X.tokens(F.col("t")).alias("words")).collect()
    for some in (rows[:1], rows[:4], rows):
        got = [[] for _ in some]
        at, places, distinct = lexical.split_words(pa.array([r["low"] for r in some]), lexical.character_kinds(spark))
        for i, place in zip(at, places, strict=True):
            got[i].append(distinct[place])
        assert [sorted(g) for g in got] == [sorted(r["words"]) for r in some]


def test_counted_chunks_take_other_tokens(spark):
    letters = lambda c: F.filter(F.split(F.lower(c), ""), lambda x: x.rlike("[a-z]"))
    asked = lexical.asked_terms(questions(spark, ("ab", 1)), letters)
    df = spark.createDataFrame([chunk(1, "abba", "", "", section=""), chunk(2, None, "x", "", section="")], CHUNKS)
    got = {r["chunk_id"]: r for r in lexical.counted_chunks(df, asked, letters, dim=8).collect()}
    assert (got["c1"]["dl"], got["c1"]["tfs"], sum(got["c1"]["slots"])) == (4, [2, 2], 4) and (got["c2"]["dl"], got["c2"]["tfs"], sum(got["c2"]["slots"])) == (2, [], 1)


SPLITTING = [
    "evidence_scores",
    "hybrid_search",
    "citation_join",
    "fused_boosts",
    "rrf_fuse",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", SPLITTING)
def test_searches_make_no_lists_of_all_words(spark, monkeypatch, name):
    """Regular expressions on every text, and lists of their finds sent to Python, took most of the CPU time."""
    plans = []
    monkeypatch.setattr(retrieval, "materialize", lambda df: plans.append((df.columns, df._jdf.queryExecution().toString())) or materialize(df))
    assert retrieval.QUERIES[name](spark, DATA).columns
    counted = [plan for columns, plan in plans if "tfs" in columns]
    assert counted and not any("regexp_extract_all" in plan for plan in counted)
