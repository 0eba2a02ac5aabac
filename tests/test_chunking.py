import random

from ledgerloom.operators import blocks as BL
from ledgerloom.operators import chunking as C
from ledgerloom.schemas import BLOCKS


def block(page, seq, text="", type_="text", level=None, html="", caption="", doc="D"):
    return (doc, page, seq, type_, None, text, html, level, caption)


def chunks(spark, rows, **limits):
    return [r.asDict() for r in C.chunk_blocks(spark.createDataFrame(rows, BLOCKS), **limits).orderBy("chunk_id").collect()]


def by_order(got):
    return sorted(got, key=lambda c: c["chunk_id"].rsplit("_", 1)[1][1:])


def test_packing_and_dropping(spark):
    rows = [block(1, i, "字" * n) for i, n in enumerate((500, 400, 100, 900, 20))]
    got = by_order(chunks(spark, rows))
    assert [c["n_chars"] for c in got] == [901, 1001] and [c["chunk_id"] for c in got] == ["D_p0001_c0000", "D_p0001_c0001"]


def test_pages_headings_and_paths(spark):
    rows = [block(1, 0, "开头的正文" * 8), block(1, 1, "第一节 甲"), block(1, 2, "一、乙"), block(1, 3, "正文内容" * 10), block(2, 4, "（一）丙"), block(2, 5, "1、丁"), block(2, 6, "文字" * 20), block(3, 7, "短标题", level=1), block(4, 8, "正文" * 20)]
    got = by_order(chunks(spark, rows))
    assert [c["section"] for c in got] == ["（正文前部）", "第一节 甲 / 一、乙", "一、乙 / （一）丙 / 1、丁", "一、乙 / （一）丙 / 短标题"]
    assert [c["page"] for c in got] == [1, 1, 2, 4] and got[1]["text"].startswith("一、乙\n")


def test_unmatched_titles_nest(spark):
    rows = [block(1, 0, "三、节")] + [block(1, i, f"标题{i}", level=1) for i in (1, 2, 3)] + [block(1, 4, "2、标题", level=1), block(1, 5, "重复", level=1)]
    got = C.with_levels(spark.createDataFrame(rows, BLOCKS)).orderBy("seq").collect()
    assert [r["heading"] for r in got] == [3, 4, 5, 5, 4, 5]


def test_tables(spark):
    html = "<tr><td>A</td><td>1</td></tr>"
    rows = [block(7, 0, "正文" * 20), block(7, 1, type_="table", html=html, caption="表"), block(7, 2, type_="table"), block(7, 3, type_="image", text="x" * 50), block(7, 1, type_="table", html=html, caption="表")]
    got = by_order(chunks(spark, rows))
    assert [c["chunk_id"] for c in got] == ["D_p0007_c0000", "D_p0007_t0001"] and got[1]["text"] == "A | 1" and got[1]["caption"] == "表"


def fold(rows, target=800, least=30):
    """The rule, one row after the other."""
    out, buffer, page, stack, previous = [], [], None, [], None
    import re

    def clean(t):
        return re.sub(r"\n{2,}", "\n", re.sub("[ \t\xa0]+", " ", t or "")).strip()

    def flush():
        nonlocal buffer
        text = clean("\n".join(buffer))
        if buffer and len(text) >= least:
            out.append((page, " / ".join(t for _, t in stack[-3:]) or "（正文前部）", text))
        buffer = []

    for _, p, _, _, _, text, _, level, _ in rows:
        t = clean(text)
        if page is not None and p != page:
            flush()
        page = p
        kind = 2 if re.match("第[一二三]+[节章]", t) else 3 if re.match("[一二三]+、", t) else (4 if level else 5) if re.match(r"\d{1,2}[、.]", t) and len(t) <= 30 else min(5, (previous or 3) + 1) if level else None
        if kind and t and "。" not in t:
            flush()
            stack[:] = [s for s in stack if s[0] < kind] + [(kind, t)]
            previous = kind
            buffer.append(t)
            continue
        buffer.append(t)
        if sum(map(len, buffer)) >= target:
            flush()
    flush()
    return out


def test_equals_a_sequential_fold(spark):
    rng = random.Random(8)
    rows, want = [], []
    for d in range(12):
        own, page = [], 1
        for i in range(60):
            page += rng.random() < 0.1
            text, level = rng.choice([("第" + rng.choice("一二三") + "节 标题", None), (rng.choice("一二三") + "、小节", None), (f"{rng.randrange(1, 20)}、条目", rng.choice([None, 1])), (f"无号标题{i}", 1), ("句子。" * rng.randrange(1, 120), None), ("句子。" * rng.randrange(1, 120), None), ("", None)])
            own.append(block(page, i, text, level=level, doc=f"D{d:02d}"))
        rows += own
        want += [(f"D{d:02d}", *w) for w in fold(own)]
    got = [(c["doc_id"], c["page"], c["section"], c["text"]) for c in chunks(spark, rows)]
    assert sorted(got) == sorted(want)


def test_edges(spark):
    assert chunks(spark, []) == []
    assert chunks(spark, [block(1, 0, None), block(None, 1, "无页码的正文" * 10), block(2, 2, "长" * 50_000)])[-1]["n_chars"] == 50_000
    clash = spark.createDataFrame([(*block(1, 0, "正文" * 30), "x", 1)], BLOCKS + ", section string, pos int")
    assert C.chunk_blocks(clash).count() == 1


def test_layouts(spark):
    layout = """{"pages": [{"page_idx": 0, "blocks": [{"type": "header", "content": "页眉"}, {"type": "text", "level": 0, "content": ["甲", {"content": [{"content": "乙"}]}]},
      {"type": "image", "content": [{"type": "caption", "content": " 图一 "}, {"type": "image_body"}]}, {"type": "image", "content": []},
      {"type": "table", "content": [{"type": "table_body", "content": "<tr></tr>"}, {"type": "caption", "content": "表一"}]}, {"type": "equation", "content": "x"}, {"content": "无类型"}, {"type": "paragraph_title", "level": 2, "content": "标题"}]}]}"""
    rows = BL.flatten_layouts(spark.createDataFrame([("D", layout), ("E", None), ("F", "{"), ("G", "[]")], "doc_id string, layout string")).orderBy("seq").collect()
    assert [(r["page"], r["seq"], r["src_type"], r["text"], r["level"]) for r in rows] == [(1, 0, "text", "甲\n乙", None), (1, 1, "image_caption", "图一", None), (1, 2, "table", "", None), (1, 3, "unknown", "无类型", None), (1, 4, "paragraph_title", "标题", 2)]
    stats = BL.document_statistics(spark.createDataFrame(rows, BLOCKS)).first()
    assert (stats["pages"], stats["blocks"], stats["tables"]) == (1, 5, 1)
