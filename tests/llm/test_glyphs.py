import unicodedata

import pytest

from ledgerloom.llm import glyphs

SCHEMA = "field_name string, row_key string, text string"


def case(text):
    """The definition, character by character."""
    name = lambda c: unicodedata.name(c, "")
    foreign = lambda c: name(c).startswith(("GREEK", "CYRILLIC")) and c.isalpha()
    for i, c in enumerate(text):
        before = text[i - 1] if i else " "
        if name(c).startswith(("FULLWIDTH LATIN", "FULLWIDTH DIGIT")) or unicodedata.category(c) == "Cf":
            return True
        if unicodedata.category(c)[0] == "M" and "LATIN" in name(before) or c.isspace() and c not in " \t\n":
            return True
        if c in glyphs.HAN_STANDINS or foreign(c) and name(before).startswith("LATIN") or foreign(before) and name(c).startswith("LATIN"):
            return True
    return False


VALUES = {
    "plain": "第一节 经营概览，（测试）！", "wide": "6、 ＨBM", "digit": "１、租赁", "mark": "Café Node", "precomposed": "Café Node", "zero width": "经​营", "bom": "﻿第",
    "nbsp": "第一节\xa0概览", "ideographic": "来源　校对", "radical": "⼀、金融", "compat": "六六", "cyrillic": "СXL 报告", "greek": "Ρérez Grid", "alone": "β系数 и ООО Вектор",
    "micro": "5 µm", "tab": "a\tb\nc", "empty": "", "null": None, "unified": "﨎﨑",
}


def test_found_equals_the_definition(spark):
    rows = [("f", k, v) for k, v in VALUES.items()] * 2
    got = {r["row_key"] for r in glyphs.find_disguised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k for k, v in VALUES.items() if v and case(v)}


def test_normalise_uses_the_vocabulary(spark):
    rows = [("f", "1", "HBM CXL 报告"), ("f", "2", "НBM 报告"), ("f", "3", "ZΡQ 报告"), ("f", "4", "第​⼀节\xa0ＣXL"), ("f", "5", None), ("f", "1", "HBM CXL 报告"), ("f", "6", "Café")]
    got = {r["row_key"]: (r["text"], r["disguised"]) for r in glyphs.normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        "1": ("HBM CXL 报告", False), "2": ("HBM 报告", True), "3": ("ZΡQ 报告", True), "4": ("第一节 CXL", True), "5": (None, False), "6": ("Café", True),
    }


def test_whole_tokens_and_whole_words(spark):
    rows = [("f", "1", "see Аpp and xАppy here"), ("f", "2", "App"), ("f", "3", "pyxАp"), ("f", None, "НBM"), ("f", None, "HBM"), ("f", "4", "BM only")]
    got = {(r["row_key"], r["text"]) for r in glyphs.normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    # Ap of pyxАp is no word of its own; xАppy isn't touched by the reading of Аpp; a null key keeps its substitution
    assert got == {("1", "see App and xАppy here"), ("2", "App"), ("3", "pyxАp"), (None, "HBM"), ("4", "BM only")}


def test_marks_of_every_script_are_composed(spark):
    values = ["か\u3099く", "и\u0306", "각".encode("utf-8").decode(), "\u1100\u1161\u11a8", "e\u0301", "ἀ", "α\u0313", "กำ", "\u212b"]
    rows = [("f", str(i), v) for i, v in enumerate(values)]
    got = {int(r["row_key"]): r["text"] for r in glyphs.normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(values))] == [unicodedata.normalize("NFC", v) for v in values]
    found = {r["row_key"] for r in glyphs.find_disguised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {str(i) for i, v in enumerate(values) if case(v)} == {"4"}


def test_normalise_equals_brute_force(spark):
    import random

    rng = random.Random(9)
    words = ["HBM", "CXL", "Вектор", "Ωμέγα", "App", "xAppy", "ROE"]
    back = {latin: foreign for foreign, latin in glyphs.LOOKALIKES.items() if "CYRILLIC" in unicodedata.name(foreign)}
    rows = []
    for i in range(300):
        picked = [rng.choice(words[: 5 + i % 3]) for _ in range(3)]
        picked = ["".join(back.get(c, c) if rng.random() < 0.15 else c for c in w) for w in picked]
        rows.append((f"f{i % 2}", f"k{i}", rng.choice([" ", "　", "、"]).join(picked)))
    vocabulary = {w for _, _, t in rows for w in glyphs._LATIN_RUN.findall(t) if len(w) > 1 and len({unicodedata.name(c).split()[0] for c in w}) == 1}

    def fix(token):
        return next((r for r in glyphs.proposals(token) if r in vocabulary), token) if glyphs._MIXED.search(token) else token

    want = {(f, k): glyphs._LATIN_RUN.sub(lambda m: fix(m[0]), glyphs.direct_repair(t)[0]) for f, k, t in rows}
    got = {(r["field_name"], r["row_key"]): r["text"] for r in glyphs.normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and sum(want[f, k] != t for f, k, t in rows) > 50


@pytest.mark.parametrize("token,script", [("СXL", "LATIN"), ("ВектоP", "CYRILLIC"), ("Ωx", "LATIN")])
def test_dominant_script(token, script):
    assert glyphs.dominant_script(token) == script


def test_proposals_stay_in_one_script():
    assert glyphs.proposals("ВектоP")[0] == "ВектоР"
    assert "AI" in glyphs.proposals("AΙ")


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", kinds string, word string")
    assert glyphs.find_disguised(empty).count() == 0 and glyphs.normalise(empty).count() == 0
    one = spark.createDataFrame([("f", "k", "a​b" * 50_000, "x", "y")], SCHEMA + ", kinds string, mixed string")
    assert glyphs.find_disguised(one).count() == 1


def test_standins_follow_a_rule():
    assert glyphs.HAN_STANDINS["⼀"] == "一" and glyphs.HAN_STANDINS["六"] == "六"
    assert all(unicodedata.name(v).startswith("CJK UNIFIED") or "LATIN" not in unicodedata.name(v) for v in glyphs.HAN_STANDINS.values())
