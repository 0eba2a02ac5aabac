import pytest

from ledgerloom.llm import quality as Q

PROSE = "受汇率波动影响，专用推理卡的毛利下降至57,832,091.87件；高端备件则略超计划。董事会认为这属于短期扰动。"
LIST = "\n".join(f"{i}. 低功耗{x}（石桥）" for i, x in enumerate(["驱动程序包", "时钟芯片", "信号调理板", "机柜方案"], 1)) + "\nlow-power fixture 878"
TABLE = "\n".join(f"项目{x} | {n}.50 | 1,0{n} | 77" for x, n in zip("甲乙丙丁", (12, 23, 34, 45)))


@pytest.mark.parametrize(
    "type_,text,kind",
    [
        ("text", PROSE, None), ("text", LIST, "list"), ("text", TABLE, "table"), ("table", PROSE, "prose"), ("table", TABLE, None), ("text", None, None), ("text", " \n", None),
        ("text", TABLE.replace(" | ", "\t"), "table"), ("text", TABLE.replace(" | ", "   "), "table"), ("text", TABLE.replace(" | ", ",  "), "table"),
        ("text", "\n".join(f"<tr><td>项目{i}</td><td>{i}1.5</td><td>9</td></tr>" for i in range(4)), "table"),
        ("text", "目录东港..........................132913讠9968\n附录桂坪.......................1012冫6990", "junk"),
        ("text", "QejUF+RSgsefUkeZc9A3cMkpjF4aQip4smfqnX6HVwp9TQz5neCVrGyT3VuwM9ZDUC6MbGahfADtDR8nbNxHExi", "junk"),
        ("text", "¬™ïé‚„ã•åŠÃé®Š¬Ã€ªªµåœ„°€ä®ª¨›¸ç€¢³ç•µœå¡œææœ„š¡½ï¡æå¨‚Ãª€¢", "junk"),
        ("text", "●3053 □是7715 √否9236 □不适用81 №9115 √否646\n√适用1788 □不适用5709 №7424", "junk"),
        ("text", "The board moved 40 lines to the\nsecure site after weaker demand\nin month 5, and costs rose.", None), ("text", PROSE + "\n" + TABLE.split("\n")[0], None), ("figure", LIST, None), (None, LIST, None),
    ],
)
def test_contradiction(type_, text, kind):
    assert Q.contradiction(type_, text) == kind


ROWS = [("甲公司", "北京", "良好"), ("乙股份", "上海浦东", "一般"), ("丙集团", "广州", "良好"), ("丁实业", "成都", "较差")]


@pytest.mark.parametrize("delimiter", ["  ", "    ", "\u3000", "\u3000\u3000", " / ", "；", "; ", ";", ",", ", ", " ", "\t"])
def test_aligned_cells_of_words_are_a_table(delimiter):
    text = "\n".join(delimiter.join(row) for row in ROWS)
    assert Q.contradiction("text", text) == "table" and Q.contradiction("table", text) is None
    assert Q.delimiter_alignment(text.split("\n")) == 1
    assert Q.contradiction("text", text + "\n" + PROSE * 3) is None


def test_a_gap_where_a_cell_is_missing():
    text = "Subsidiary          Seat        Rating\nNorth Works Ltd.    Kiel        good\nSouth Works                     fair\nWest Works          Bremen      good"
    assert Q.contradiction("text", text) == "table"


@pytest.mark.parametrize(
    "text,kind",
    [
        ("\n".join(f"{i}. {a} / {b}" for i, (a, b, _) in enumerate(ROWS, 1)), "list"), ("\n".join(f"第{n}节\u3000{x}" for n, x in zip("一二三四", ("重要提示", "公司简介", "业务概要", "公司治理"))), "list"), ("\n".join(f"low power {x}" for x in ("fixture", "antenna", "module")), "list"),
        ("The board moved lines to the site, which\nwas secure after weaker demand, and said\nthat costs rose in the month, while sales\nfell.", None),
        ("受汇率波动影响，毛利下降；高端备件略超计划，\n董事会认为这属于短期扰动；公司将继续投入，\n并扩大产能；管理层对前景表示乐观，预计\n明年恢复增长。", None),
        ("甲公司  北京\n乙公司  上海", None),
    ],
)
def test_lists_and_wrapped_prose_are_no_aligned_tables(text, kind):
    assert Q.contradiction("text", text) == kind


RECORDS = "\n".join(f"{label}\n{a}\n{b}" for label, a, b in (("营业收入", "12,345.60", "8.1%"), ("净利润", "2,310.07", "-3.2%"), ("研发支出", "1,871.50", "11.4%"), ("存货余额", "9,002.33", "0.7%")))


def test_one_cell_per_line_is_a_table():
    assert Q.record_length(RECORDS.split("\n")) == 3
    assert Q.contradiction("text", RECORDS) == "table" and Q.contradiction("table", RECORDS) is None
    assert Q.contradiction("text", "\n".join(f"低功耗{x}" for x in ("夹具", "驱动程序包", "时钟芯片", "机柜", "天线模组", "设计外包"))) == "list"
    assert Q.record_length(["甲", "1", "乙", "丙", "2", "丁"]) == 0 and Q.record_length(["1", "2", "3"] * 3) == 0


@pytest.mark.parametrize("measure", ["aligned", "marker_periodicity", "record_length", "length_autocorrelation"])
def test_every_layout_measure_decides(monkeypatch, measure):
    texts = [RECORDS, "\n".join("  ".join(row) for row in ROWS), "\n".join(f"{i}. {a} / {b}" for i, (a, b, _) in enumerate(ROWS, 1))]
    before = [Q.contradiction("text", t) for t in texts]
    nothing = {"aligned": lambda a, b: frozenset(), "marker_periodicity": lambda x: 0.0, "record_length": lambda x: 0, "length_autocorrelation": lambda x, lag=1: -1.0}
    monkeypatch.setattr(Q, measure, nothing[measure])
    assert before == ["table", "table", "list"] != [Q.contradiction("text", t) for t in texts]


def test_a_glance_never_changes_the_answer():
    for type_ in ("text", "table"):
        for text in (PROSE, LIST, TABLE, PROSE + "\n" + LIST, TABLE + "\n" + PROSE):
            if Q.agrees_at_a_glance(type_, text, 0.6):
                share = Q.shares(text)
                assert share["prose"] > 0.4 if type_ == "text" else share["prose"] < 0.6


def test_layout_measures():
    assert Q.delimiter_alignment(TABLE.split("\n")) == 1 and Q.delimiter_alignment([PROSE]) == 0
    assert Q.marker_periodicity(["- a", "- b", "c"]) == pytest.approx(2 / 3)
    assert Q.length_autocorrelation(["ab", "cd", "ef"]) == 1 and Q.length_autocorrelation(["a"]) == 0


def test_statistics(spark):
    rows = [("a", "text", "The cost of it.\nNo end"), ("a", "text", "The cost of it.\nNo end"), ("b", "text", None), ("c", "text", ""), ("d", "table", PROSE * 3000)]
    got = {r["key"]: r for r in Q.quality_statistics(spark.createDataFrame([(*r, 1) for r in rows], "key string, type string, text string, chars int")).collect()}
    a = got["a"]
    assert (a["words"], a["n_lines"], a["punctuated_lines"], a["kind"]) == (6, 2, 0.5, "prose") and a["common_words"] == pytest.approx(2 / 6)
    assert got["b"]["kind"] is None and got["c"]["chars"] == 0 and len(got) == 4
    found = Q.mislabelled(spark.createDataFrame(rows, "key string, type string, text string")).collect()
    assert [(r["key"], r["kind"]) for r in found] == [("d", "prose")]
    assert Q.mislabelled(spark.createDataFrame([], "key string, type string, text string")).count() == 0
