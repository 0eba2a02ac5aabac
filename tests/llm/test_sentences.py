import time

import pytest

from ledgerloom.llm import sentences as S


def split(text):
    out, begin = [], 0
    for end in S.sentence_ends(text):
        out.append(text[begin:end].strip())
        begin = end
    return out


@pytest.mark.parametrize(
    "text,count",
    [
        ("Goods arrived at 9 a.m. on site, incl. 240 samples, etc., and testing began at 4 p.m. Sales rose. eDrive fell in month 12. eDrive y.", 4),
        ("The order went to Orrin Foundry Inc. The desk moved. Orrin Co., Ltd. shipped approx. 44 units, vs. 1,388. The U.S. Treasury rate moved, e.g. for Note No. 20. A b.", 5),
        ("The chair answered, “Is it over? Not yet.” Margin was 3.2%.[11] The x (i.e. 49.7% of plan. See the annex.). Because y.", 4),
        ("“We expect growth. Costs may fall by 12.01%,” the board said. Prices, costs ... and more.", 2),
        ("Am 28. Mai 2020 kamen 719 Sensoren. „Sie werden teurer. Wir prüfen das“, sagte er laut Nr. 40. Der Umsatz betrug ca. 7,1 Mio. Euro um 33,8 %. Posten, z. B. Netzteile, d. h. alle. Warum?", 5),
        ("“公司认为。”这一表述后来被更正。本集团表示：“虽然A。其中B。”期末C。（数据D。）E为F（G。）。H项目竟然延期？！产品包括A……等27类．I为37．3%。", 8),
        ("当社は「A。Bです。」と説明しました。在庫は3個（Cを含む。）でした。受注は回復したのでしょうか？D。", 4),
        ("ฝ่ายวิจัยตรวจ39,448,026.86พันชิ้นในปี2557 บริษัทย่อย18817ชุดในปี2559\n\nศูนย์ออก", 3),
        ("9. 液冷软件订阅行业格局\n\n明细见附件 note_2020.v7.pdf，网址 www.disclosure87.example，采用 v5.0.3 固件；A。合作方 Dunmere Co., Ltd. 提供了1套。B。[3][4] C", 5),
        ("《关于X的说明（第7版。修订）》于5月生效。A note (“acklog 8811. A reply 5347”) was quoted by the desk.\n \nX", 3),
        ("第一句\n换行继续。第二句", 2),
        ("未闭合的引号“在这里。后面一句。", 2),
    ],
)
def test_rules(text, count):
    assert len(split(text)) == count, split(text)


@pytest.mark.parametrize(
    "text,count",
    [
        ("Le chiffre d'affaires est de 3 M€ env. par an, selon M. Durand et Mme. Roy. Les ventes de la société Dupont S.A. sont en hausse. Une note suit.", 3),
        ("El Sr. Gómez y la Dra. Ruiz dijeron que las ventas, p. ej. de chips, subieron. Los costes etc. bajaron por la demanda.", 2),
        ("Il Sig. Rossi e il Dott. Bianchi sono della società Alfa S.p.A. Gli ordini sono in crescita, ecc. per il mercato.", 2),
        ("O Sr. Silva e a Dra. Costa não foram ao evento. Os custos, p. ex. da obra, são da empresa Beta Ltda. Uma nota segue.", 3),
        ("Выручка в 2020 г. выросла, т. е. на 5 % за год. По данным на стр. 12 это рекорд для компании.", 2),
        ("Die Kosten betragen rund 5 Mio. Die Erlöse und der Umsatz stiegen auf 3 Mrd. Euro für das Jahr.", 2),
        ("The report came in Oct. The board met on Nov. 5 to vote.", 2),
        ("بلغت الإيرادات ٥ ملايين؟ نعم. ارتفعت.", 3), ("राजस्व बढ़ा। लागत घटी।", 2),
        ("He joined Foo Inc." + " " * 45 + "The next one.", 2), ("He joined Foo Inc. The next one.", 2),
    ],
)
def test_further_languages(text, count):
    assert len(split(text)) == count, split(text)


def test_many_marks_take_linear_time():
    for text in ("(" * 100_000, "（甲。" * 30_000, "“甲。”乙" * 30_000, "a.b" * 30_000, "((“" * 30_000 + "”))" * 10_000, "甲。[1]" * 30_000):
        began = time.process_time()
        S.sentence_ends(text)
        assert time.process_time() - began < 8, text[:9]


def test_more_stops_than_a_few_inside():
    quote = "“" + "甲乙。" * 12 + "”"
    assert len(split(f"他说：{quote}后来更正。")) == 2 and len(split(f"他的{quote}后来更正。")) == 1
    assert len(split(f"他说：“{'甲乙' * 12}”后来更正。" + "丙。" * 9)) == 10


def test_ends_are_after_the_last_character():
    text = "  第一句。 \n\n 第二句 \n"
    assert S.sentence_ends(text) == [6, 13] and text[5] == "。" and text[12] == "句"


@pytest.mark.parametrize("text", [None, "", "  \n\n 　"])
def test_blank(text):
    assert S.sentence_ends(text) == []


def test_table(spark):
    rows = [(1, "一。二。"), (1, "一。二。"), (2, None), (3, ""), (None, "x。"), (4, "长句。" * 30_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, sent_end int")
    got = S.sentence_bounds(df)
    assert {(r["doc_id"], r["sent_end"]) for r in got.filter("doc_id = 1").collect()} == {(1, 2), (1, 4)}
    assert got.filter("doc_id = 4").count() == 30_000 and got.filter("doc_id is null").count() == 0
    assert [r["text"] for r in S.sentences(df).filter("doc_id = 1").orderBy("sentence").collect()] == ["一。", "二。"]
    assert S.sentence_bounds(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
