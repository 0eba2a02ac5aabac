import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import splitting as S

SCHEMA = "field_name string, row_key string, text string"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=120), st.data())
def test_range_maximum_is_the_rightmost(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    top = max(values[lo : hi + 1])
    assert S.RangeMax(np.array(values)).query(lo, hi) == (max(i for i in range(lo, hi + 1) if values[i] == top), top)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="字a1 。，\n.", max_size=900))
def test_pieces_cover_the_text(text):
    spans = S.split_spans(text, 100, 20)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= 100 for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c < b < d and b - c <= 20
    joined = text[: spans[0][1]] + "".join(text[b:d] for (_, b), (_, d) in zip(spans, spans[1:]))
    assert joined == text


def test_cuts_at_the_strongest_boundary():
    text = "一" * 700 + "。" + "二" * 200 + "，" + "三" * 900
    assert S.split_spans(text)[0] == (0, 701)
    assert S.split_spans("字" * 2500) == [(0, 1000), (900, 1900), (1800, 2500)]


def test_found_and_pieces(spark):
    rows = [("chunks.text", "a", "字" * 1000), ("chunks.text", "b", "字" * 1001), ("chunks.text", "b", "字" * 1001), ("blocks.text", "c", None), ("blocks.text", "d", ""), ("blocks.text", "e", "很长。\n" * 40_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", piece int, start int")
    assert {r["row_key"] for r in S.find_oversized(df).collect()} == {"b", "e"}
    pieces = S.split_pieces(df).filter("row_key = 'b'").orderBy("piece").collect()
    assert [len(p["text"]) for p in pieces] == [1000, 101]
    assert S.find_oversized(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digits_are_not_split_at_points():
    assert S.strengths("增长3.5亿，1,200")[4:6].max() == 0
