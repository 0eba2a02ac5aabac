import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import packing as P


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20))
def test_plan_uses_the_histogram_up(counts):
    used = Counter()
    for combo, repeats in P.plan(counts, 64, 2, 3):
        assert sum(combo) <= 64 and repeats > 0
        for x in combo:
            used[x] += repeats
    assert used == Counter({x: n for x, n in counts.items() if n})


def test_nnls_fits_an_exact_mixture():
    patterns = [(32, 32), (40, 24), (16, 16, 32)]
    x = P.solve_nnls(patterns, {32: 2 * 10 + 5, 40: 7, 24: 7, 16: 10}, 3000)
    assert [round(v) for v in x] == [10, 7, 5]


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([17, 400, 512, 900, 1500, rng.randrange(1, 2049), rng.randrange(2049, 9000)])) for i in range(3000)]
    rows += rows[:50] + [(5000, 0), (5001, None), (5002, 2048), (None, 7)] + [(6000 + i, 683) for i in range(1500)]
    packed = P.pack(spark.createDataFrame([(*r, 1) for r in rows], "key bigint, size int, container int")).cache()
    sizes = dict(r for r in rows if r[0] is not None)
    totals = {r["key"]: r["s"] for r in packed.groupBy("key").agg(F.sum("size").alias("s")).collect()}
    assert totals == {k: v or 0 for k, v in sizes.items()}
    used = packed.filter("size > 0").groupBy("container").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    stats = used.agg(F.max("s"), F.count("*"), F.sum("s")).first()
    assert stats[0] <= 2048 and stats[1] <= 1.12 * stats[2] / 2048 and packed.filter("container is null").count() == 0
    assert packed.count() == packed.select("key", "piece").distinct().count()
    cut = packed.filter("key in (select key from values (0) as t(key))")
    assert cut.count() >= 1


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "key bigint, size int")).count() == 0
