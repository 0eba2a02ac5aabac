import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import vectors as V


def value(spark, text, expression, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(expression(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("a \t b\n\n\nc ", "a b\nc"), ("\n \n", ""), ("　x ", "x"), (None, None), ("", "")])
def test_clean_text(spark, text, want):
    assert value(spark, text, X.clean_text) == want


@pytest.mark.parametrize(
    "text,want",
    [("第三节 X", 2), ("二、X", 3), ("（一）X", 4), ("1、X", 5), ("１２、标题", 5), ("X。", None), ("一、" + "长" * 60, None), ("（一）" + "长" * 40, None), ("1、甲，乙", None), ("3.5亿元", 5), ("", None), (None, None)],
)
def test_detect_level(spark, text, want):
    assert value(spark, text, X.detect_level) == want


@pytest.mark.parametrize("text,want", [("1、X", 4), ("（二）X", 4), ("三、X", 3), ("第一章", 2), ("X", None), (None, None)])
def test_remap_level(spark, text, want):
    assert value(spark, text, X.remap_level) == want


@pytest.mark.parametrize("text,want", [("标题", True), ("有句号。", False), ("，起头", False), ("逗号，" + "长" * 14, False), ("短，逗号", True), ("√适用 □不适用", False), ("", False), (None, False)])
def test_heading_sane(spark, text, want):
    assert value(spark, text, X.heading_sane) is want


@pytest.mark.parametrize(
    "html,want",
    [("<tr><TH a=1>A&nbsp;</TH><td>\nb</td></tr><tr></tr><tr><td></td><td>2</td></tr>", "A | b\n | 2"), (None, ""), ("", ""), ("<p>x</p>", ""), ("<table><TR class='x'><td><b>1</b></td></TR></table>", "1")],
)
def test_table_text(spark, html, want):
    assert value(spark, html, X.table_text) == want


@pytest.mark.parametrize("n,want", [(1023, "1023.0B"), (1024, "1.0KB"), (1536, "1.5KB"), (5 * 1024**3, "5.0GB"), (None, None), (0, "0.0B")])
def test_human_size(spark, n, want):
    assert value(spark, n, X.human_size, "bigint") == want


def test_tokens(spark):
    assert sorted(value(spark, "营业收入 HBM-3，乙 Ab", X.tokens)) == sorted(["营业", "业收", "收入", "乙", "hbm", "3", "ab"])
    assert value(spark, None, X.tokens) == []


def test_other_scalars(spark):
    assert value(spark, " <em>年报</em>全文 ", X.strip_emphasis) == "年报全文" and value(spark, None, X.strip_emphasis) == ""
    assert value(spark, 0, X.epoch_date, "bigint") == "1970-01-01" and value(spark, None, X.epoch_date, "bigint") == ""
    assert value(spark, "//a/b.PDF", lambda c: X.full_url("https://h/", c)) == "https://h/a/b.PDF"
    long = "前" * 200 + "利润\n" + "后" * 400
    got = value(spark, long, lambda c: X.keyword_context(c, "利润"))
    assert got == "前" * 120 + "利润 ⏎ " + "后" * 217 and value(spark, "无", lambda c: X.keyword_context(c, "利润")) is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(V.l2_normalize(F.col("a")).alias("n"), V.l2_normalize(F.col("z")).alias("z"), V.dot(F.col("a"), F.col("a")).alias("d")).first()
    assert r["n"] == [0.6, 0.8] and r["z"] == [0.0, 0.0] and r["d"] == 25
