import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import blocks as BL
from ledgerloom.operators import evaluation, fusion
from ledgerloom.schemas import CHUNKS, COMPANIES, MANIFEST
from ledgerloom.sources import readers


def plain_blocks(layout):
    """The rule, one block after the other."""
    out = []
    for page in layout.get("pages") or []:
        for b in page.get("blocks") or []:
            kind, content = b.get("type") or "unknown", b.get("content")
            parts = [p for p in content if isinstance(p, dict)] if isinstance(content, list) else []
            join = lambda x: "\n".join(BL.leaves(x))
            captions = [join(p.get("content")) for p in parts if p.get("type") == "caption"]
            if kind == "image":
                row = ("text", "image_caption", "\n".join(captions).strip(), "", None, "")
            elif kind == "table":
                body = [p.get("content") for p in parts if p.get("type") == "table_body"]
                row = ("table", "table", "", join(body[-1]) if body else "", None, " ".join(filter(None, captions)).strip())
            elif kind in BL.TEXT:
                level = b.get("level")
                row = ("text", kind, join(content).strip(), "", level if type(level) is int and level > 0 else None, "")
            else:
                continue
            if row[0] == "table" or row[2]:
                out.append(((page.get("page_idx") or 0) + 1, len(out), *row))
    return out


def test_layouts_equal_a_plain_loop(spark):
    rng = random.Random(2)

    def content(depth=0):
        u = rng.random()
        if u < 0.4 or depth > 4:
            return rng.choice(["甲", " 乙\n", "", "[3]", '{"a": 1}', "3", "true"])
        if u < 0.7:
            return [content(depth + 1) for _ in range(rng.randrange(3))]
        return rng.choice([{"content": content(depth + 1), "type": "x"}, 7, None, True])

    layouts = []
    for i in range(150):
        pages = []
        for p in range(rng.randrange(4)):
            found = []
            for _ in range(rng.randrange(6)):
                b = {"type": rng.choice([*BL.KINDS, "header", "page_number", "", None]), "level": rng.choice([None, 0, 2, -1, True, "2"]), "content": content()}
                if b["type"] in ("table", "image"):
                    b["content"] = [rng.choice([{"type": "caption", "content": content()}, {"type": "table_body", "content": "<tr></tr>"}, "x", {"type": "image_body"}]) for _ in range(rng.randrange(4))]
                found.append({k: v for k, v in b.items() if v is not None or rng.random() < 0.5})
            pages.append({"page_idx": p, "blocks": found} if rng.random() < 0.9 else {"blocks": found})
        layouts.append((f"D{i}", {"pages": pages}))
    df = spark.createDataFrame([(d, json.dumps(x, ensure_ascii=False)) for d, x in layouts] + [("bad", "{"), ("none", None), ("list", "[1]"), ("odd", '{"pages": 3}')], "doc_id string, layout string")
    got = [tuple(r) for r in BL.flatten_layouts(df).collect()]
    assert sorted(got, key=repr) == sorted(((d, *row) for d, x in layouts for row in plain_blocks(x)), key=repr) and len(got) > 100


def test_newest_layouts(spark):
    rows = [("a", "p1", 1), ("a", "p2", 3), ("a", "p0", 3), ("b", "p9", None)]
    got = BL.newest_layouts(spark.createDataFrame(rows, "doc_id string, path string, modificationTime int")).collect()
    assert {(r["doc_id"], r["path"]) for r in got} == {("a", "p0"), ("b", "p9")}


def test_mentioned_names_equal_a_plain_loop(spark):
    rng = random.Random(6)
    letters = "甲乙丙丁a"
    names = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(40)}
    asked = [(f"q{i}", "".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))), 3) for i in range(80)] + [("n", None, 1)]
    companies = spark.createDataFrame([("c", n, None, None, None) for n in [*names, *names, "", None]], COMPANIES)
    got = {r["qid"]: r["mentioned"] for r in fusion.question_intent(spark.createDataFrame(asked, "qid string, question string, k int"), companies).collect()}
    assert got == {q: sorted(n for n in names if n in (text or "")) for q, text, _ in asked}


def test_keyword_report_counts_all_hits(spark):
    rows = [(f"c{i:02d}", "d", "甲", "1", "annual", "L", "S", 1, "text", "毛利上升" if i % 2 else "x", "", "", 1) for i in range(60)]
    got = evaluation.keyword_report(spark.createDataFrame(rows, CHUNKS), "毛利", limit=5).collect()
    assert [r["chunk_id"] for r in got] == ["c01", "c03", "c05", "c07", "c09"] and {r["hits"] for r in got} == {30}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "a"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_a_bad_archive_has_no_layout(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("x/middle_json.json", "{}")
    got = {r["doc_id"]: r["layout"] for r in readers.read_layout_archives(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {"bad": None, "good": "{}"}


def test_stages_from_archives_to_answers(spark, tmp_path, capsys):
    from ledgerloom.__main__ import main

    for d, word in (("960001_2024_annual", "alpha"), ("960002_2024_annual", "beta")):
        layout = {"pages": [{"page_idx": 0, "blocks": [{"type": "paragraph_title", "level": 1, "content": "一、经营"}, {"type": "text", "content": f"营业收入 同比 增长 {word}，" * 6}]}]}
        with zipfile.ZipFile(tmp_path / f"{d}.zip", "w") as z:
            z.writestr("middle_json.json", json.dumps(layout, ensure_ascii=False))
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    manifest = spark.createDataFrame([(d, d[:6], n) for d, n in (("960001_2024_annual", "甲公司"), ("960002_2024_annual", "乙公司"))], "doc_id string, code string, name string")
    manifest = manifest.withColumns({"report_type": F.lit("annual"), "period_label": F.lit("2024年年度报告"), "downloaded_at": F.lit("1")})
    assert set(manifest.columns) <= set(columns)
    p = lambda name: str(tmp_path / name)
    manifest.write.parquet(p("manifest"))
    spark.createDataFrame([("960001", "甲公司", None, None, None), ("960002", "乙公司", None, None, None)], COMPANIES).write.parquet(p("companies"))
    main(["blocks", p("*.zip"), p("blocks")], spark)
    main(["chunk", p("blocks"), p("manifest"), p("chunks")], spark)
    main(["chunk", p("blocks"), p("manifest"), p("one"), "--docs", "960002_2024_annual"], spark)
    assert spark.read.parquet(p("chunks")).count() == 2 and [r["company"] for r in spark.read.parquet(p("one")).collect()] == ["乙公司"]
    main(["index", p("chunks"), p("companies"), p("kb")], spark)
    (tmp_path / "q.yml").write_text("questions:\n- {id: q1, question: 甲公司 alpha 营业收入？, k: 2}\n- {id: q2, question: 乙公司 beta？, k: 2}\n", encoding="utf-8")
    main(["evaluate", p("kb"), p("q.yml"), p("out"), "--only", "q2", "--k-override", "1", "--retrieve-only"], spark)
    (found,) = spark.read.json(p("out")).collect()
    assert found["qid"] == "q2" and found["company"] == "乙公司" and found["vec_sim"] is not None
    capsys.readouterr()
    main(["ask", p("kb"), "甲公司 alpha？", "--k", "1"], spark)
    assert "[1]" in capsys.readouterr().out
