import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import leakage as L

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def brute(docs, items, n=40):
    found = set()
    for d, text in docs:
        doc = L.normalise(text or "")
        for k, item in items:
            item = L.normalise(item or "")
            if any(item[i : i + n] in doc for i in range(len(item) - n + 1)):
                found.add((d, k))
    return found


def test_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, "".join(rng.choice("甲乙丙丁戊abcdef０1２3，。 ") for _ in range(rng.randrange(30, 160)))) for i in range(30)] + [(99, None), (98, ""), (97, "短")]
    docs = []
    for d in range(150):
        _, item = items[rng.randrange(30)]
        a = rng.randrange(max(1, len(item) - 50))
        part = item[a : a + rng.randrange(30, 90)]
        noisy = "".join(c.upper() + rng.choice(["", " ", "，", "\n"]) for c in part)
        docs.append((d, "前文内容" + noisy + "后文" * 5))
    docs += [(1000, None), (1001, ""), docs[0]]
    got = L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items) and got
    small = L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_chars=500).collect()
    assert {(r["doc_id"], r["item_id"]) for r in small} == brute(docs, items)


def test_offsets_map_to_the_original(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank today"
    text = "Intro! " + item.replace(" ", "  ") + " -- end"
    (r,) = L.leaks(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(5, item)], ITEMS)).collect()
    assert text[r["start_offset"] : r["end_offset"]] == item.replace(" ", "  ") and r["run"] == len(L.normalise(item))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 。", max_size=80), st.text(alphabet="ab1 。", max_size=80))
def test_scan_finds_every_run(text, item):
    automaton, texts = L.build_automaton([(1, item)], 8)
    found = bool(automaton and L.scan_text(L.normalise(text), automaton, texts, 8))
    assert found == bool(brute([(0, text)], [(1, item)], 8))


def longest(text, item):
    """Length of the longest common substring."""
    best, row = 0, [0] * (len(item) + 1)
    for c in text:
        row = [0] + [row[j] + 1 if c == item[j] else 0 for j in range(len(item))]
        best = max(best, *row)
    return best


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab", max_size=90), st.text(alphabet="ab", max_size=90))
def test_the_run_is_the_longest(text, item):
    automaton, texts = L.build_automaton([(1, item)], 8)
    found = L.scan_text(text, automaton, texts, 8) if automaton else {}
    n = longest(text, item)
    assert [b - a for a, b in found.values()] == ([n] if n >= 8 else [])
    assert all(text[a:b] in item for a, b in found.values())


def test_repeated_text_takes_linear_time():
    for item, run in (("a" * 4000, 4000), ("a" * 4000 + "b", 4000), ("ab" * 2000, 40_000)):
        text = "a" * 100_000 if "ab" != item[:2] else "ab" * 50_000
        automaton, texts = L.build_automaton([(1, item)], 40)
        began = time.process_time()
        (found,) = L.scan_text(text, automaton, texts, 40).values()
        assert found[1] - found[0] == min(run, len(item)) and time.process_time() - began < 10


def test_no_items_and_long_text(spark):
    docs = spark.createDataFrame([(1, "长" * 300_000)], DOCS)
    assert L.leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert L.leaks(docs, spark.createDataFrame([(1, "长" * 40)], ITEMS)).count() == 1
    assert L.leaks(spark.createDataFrame([], DOCS + ", run int"), spark.createDataFrame([(1, "长" * 40)], ITEMS)).count() == 0
