import random
from collections import defaultdict

import pandas as pd

from ledgerloom.llm import boilerplate as B

SCHEMA = "source string, key string, text string"


def brute(rows, min_chars=12, min_docs=5, share=0.02):
    keys, docs, where = defaultdict(set), defaultdict(set), []
    for source, key, text in set(rows):
        if source is None or key is None:
            continue
        keys[source].add(key)
        for i, line in enumerate((text or "").split("\n")):
            if len(line.strip()) >= min_chars:
                form = (source, B.line_form(line))
                docs[form].add(key)
                where.append((form, source, key, i))
    return {(s, k, i) for form, s, k, i in where if len(docs[form]) >= max(min_docs, share * len(keys[s]))}


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    notices = ["免责声明：本资料仅供内部参考之用", "分享到朋友圈并关注我们的公众号", "第 12 页 共 345 页 公开披露文件"]
    rows = []
    for i in range(n):
        lines = [f"正文内容第{'甲乙丙丁戊己庚辛'[rng.randrange(8)] * rng.randrange(3, 9)}段落说明文字其他{rng.choice('天地玄黄')}" for _ in range(rng.randrange(5))]
        if rng.random() < 0.3:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = [x.replace("12", str(rng.randrange(500))).replace("声明", "声 明" if rng.random() < 0.5 else "声​明") for x in notices[: rng.randrange(1, 4)]]
        rows.append(("大公司" if rng.random() < 0.6 else f"公司{rng.randrange(4)}", f"k{i}", "\n".join(lines) if lines else None))
    return rows + rows[:20]


def test_lines_equal_brute_force(spark):
    rows = corpus()
    got = {(r["source"], r["key"], r["line_no"]) for r in B.boilerplate_lines(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert got == brute(rows) and got


def test_blocks_are_common_prefixes(spark):
    text = "这是重复出现的第一行文字内容\n这是重复出现的第二行文字内容\n"
    rows = [("s", f"k{i}", text + f"独有的一行内容编号为{chr(0x4E00 + i)}的文字") for i in range(30)]
    rows.append(("s", "k99", "这是重复出现的第二行文字内容"))
    sequences = B.line_sequences(spark.createDataFrame(rows, SCHEMA), 12)
    blocks = {(r["lines"], r["docs"]) for r in B.repeated_blocks(sequences).collect()}
    assert blocks == {(1, 30), (1, 31), (2, 30)}


def test_blocks_of_any_length_equal_brute_force(spark):
    rng = random.Random(3)
    notice = [f"这是重复出现的很长声明里的一行文字{chr(0x4E00 + i)}" for i in range(37)]
    rows = []
    for i in range(24):
        own = [f"独有的一行正文内容写在这里{chr(0x5E00 + 40 * i + j)}" for j in range(12)]
        a = rng.randrange(4)
        b = rng.choice([9, 16, 17, 31, 37])
        lines = own[:2] + notice[a:b] + (["短"] if i % 5 == 0 else []) + (own[2:] if i % 2 else notice[3:14])
        rows.append(("s" if i % 4 else "t", f"k{i}", "\n".join(lines)))
    rows += [rows[0], ("s", "k1", "\n".join(notice[5:30]))]  # two versions of one key
    want, total = defaultdict(set), defaultdict(set)
    for source, key, text in rows:
        total[source].add(key)
        ids = B.line_ids(text, 12)
        for i in range(len(ids)):
            for j in range(i + 1, len(ids) + 1):
                if not ids[j - 1]:
                    break
                want[source, tuple(ids[i:j])].add(key)
    want = {(s, B.hashlib.md5(B.np.asarray(block, dtype=">i8").tobytes()).hexdigest(), len(block), len(keys)) for (s, block), keys in want.items() if len(keys) >= max(5, 0.02 * len(total[s]))}
    sequences = B.line_sequences(spark.createDataFrame(rows, SCHEMA).repartition(5), 12)
    got = [tuple(r) for r in B.blocks_of_any_length(sequences).select("source", "block", "lines", "docs").collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(r[2] for r in got) > 16


def test_a_query_has_the_whole_long_block(spark, tmp_path):
    from ledgerloom.llm.queries import p3_blocks

    text = "\n".join(f"这是重复出现的很长声明里的一行文字{chr(0x4E00 + i)}" for i in range(20))
    rows = [("c", "text", f"k{i}", text) for i in range(6)]
    spark.createDataFrame(rows, "company string, type string, chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = p3_blocks(spark, str(tmp_path)).collect()
    assert [(r["lines"], r["docs"]) for r in got] == [(20, 6)]


def test_maximal_blocks_are_not_part_of_others(spark):
    line = lambda i: f"这是重复出现的很长声明里的一行文字{chr(0x4E00 + i)}"
    rows = [("s", f"k{i}", "\n".join(map(line, range(12)))) for i in range(6)] + [("s", f"m{i}", "\n".join(map(line, range(3, 9)))) for i in range(5)]
    got = {(r["lines"], r["docs"]) for r in B.maximal_blocks(B.line_sequences(spark.createDataFrame(rows, SCHEMA), 12)).collect()}
    assert got == {(12, 6), (6, 11)}


def test_a_join_gives_the_same_as_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(5, 150), SCHEMA)
    want = [set(map(tuple, df.collect())) for df in (B.boilerplate_lines(docs), B.without_boilerplate(docs))]
    monkeypatch.setattr(B, "BROADCAST_BLOCKS", 0)
    assert want == [set(map(tuple, df.collect())) for df in (B.boilerplate_lines(docs), B.without_boilerplate(docs))] and want[0]


def test_groups_cut_by_partition_borders_add_up():
    a, b = b"\0" * 7 + b"\1", b"\0" * 7 + b"\2"
    stretch = lambda n: pd.DataFrame({"source": ["s"] * n, "suffix": [a + b] * n, "known": [0] * n})
    total = 0
    for n in (2, 3, 1):
        out = pd.concat(B.prefix_groups(iter([stretch(n)]), 5))
        total += out[out["prefix"] == a]["docs"].sum()
    assert total == 6


def test_a_line_twice_in_a_document_counts_once(spark):
    rows = [("s", f"k{i}", "同一行文字在一个文档里出现两次\n同一行文字在一个文档里出现两次") for i in range(4)]
    assert B.boilerplate_lines(spark.createDataFrame(rows, SCHEMA)).count() == 0
    rows.append(("s", "k4", "同一行文字在一个文档里出现两次"))
    assert B.boilerplate_lines(spark.createDataFrame(rows, SCHEMA)).count() == 9


def test_cleaned_text(spark):
    rows = [("s", f"k{i}", f"本公司所有的版权声明文字内容\n正文{i}") for i in range(6)] + [("s", "n", None), (None, "x", "本公司所有的版权声明文字内容"), ("s", None, "x"), ("s", "e", "")]
    got = {r["key"]: (r["text"], r["removed"]) for r in B.without_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["k3"] == ("正文3", 1) and got["n"] == (None, 0) and got["x"][1] == 0 and got["e"] == ("", 0)


def test_empty_long_and_clashing(spark):
    assert B.boilerplate_lines(spark.createDataFrame([], SCHEMA + ", suffix string, ids string")).count() == 0
    rows = [("s", f"k{i}", ("很长的文本" * 20_000) + "\n重复出现的页脚文字一二三四五") for i in range(5)]
    assert B.boilerplate_lines(spark.createDataFrame(rows, SCHEMA)).count() == 10
