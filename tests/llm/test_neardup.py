import random

import pytest

from ledgerloom.llm import neardup as N

SCHEMA = "key string, text string"


def variants(seed=4, n=60):
    rng = random.Random(seed)
    alphabet = [chr(0x4E00 + i) for i in range(800)]
    rows = []
    for i in range(n):
        base = "".join(rng.choice(alphabet) for _ in range(rng.choice([62, 90, 150, 400, 900])))
        for j in range(rng.randrange(1, 5)):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25))):
                at = rng.randrange(len(text))
                text[at] = rng.choice(alphabet) if rng.random() < 0.6 else ""
            rows.append((f"d{i}_{j}", "".join(text)))
            if rng.random() < 0.2:
                rows.append((f"c{i}_{j}", " ".join(text)))
    return rows


def brute(rows, limit=0.7):
    sets = {}
    for key, text in rows:
        s = N.squeeze(text or "")
        if key is not None and len(s) >= 60:
            sets[key] = {s[i : i + 5] for i in range(len(s) - 4)}
    keys = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b])}


def test_pairs_equal_brute_force(spark):
    rows = variants() + [("n", None), ("e", ""), ("s", "短"), (None, "字" * 100)]
    rows += rows[:10]
    got = {(r["key_a"], r["key_b"]): r["similarity"] for r in N.similar_pairs(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", word int")).collect()}
    want = brute(rows)
    assert set(got) == set(want) and len(got) > 60
    assert all(got[p] == pytest.approx(want[p]) for p in got)


def test_texts_of_few_distinct_substrings(spark):
    rng = random.Random(8)
    rows = [("d60", "-" * 60), ("d75", "-" * 75), ("z", "0" * 70), ("p2", "ab" * 35), ("p2b", "ab" * 40), ("p3", "abc" * 30), ("lead", "目录" + "." * 70), ("lead2", "附录" + "." * 71)]
    for period in range(1, 61):
        for i in range(4):
            unit = [chr(0x4E00 + period * 300 + i * 60 + j) for j in range(period)]
            for j, n in enumerate((62, 71, 90, 120)):
                text = list((unit * 120)[: max(n, period + 4)])
                for _ in range(rng.randrange(3) if j else 0):
                    text[-1 - rng.randrange(4)] = chr(0x9000 + rng.randrange(500))
                rows.append((f"r{period}_{i}_{j}", "".join(text)))
    got = {(r["key_a"], r["key_b"]): r["similarity"] for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert set(got) == set(want) and ("d60", "d75") in got and ("p2", "p2b") in got and len(got) > 500
    assert all(got[p] == pytest.approx(want[p]) for p in got)


def test_guaranteed_bands_miss_no_pair(spark):
    rng = random.Random(12)
    rows = variants(6, 50)
    for i in range(150):  # at the limit: as many changes as the similarity just allows
        n = rng.choice([60, 64, 75, 100, 127, 140, 300, 520])
        base = [chr(0x4E00 + rng.randrange(9000)) for _ in range(n)]
        other = list(base)
        for at in range(0, n - 2, max(6, 5 * n // max(1, round(0.17 * n)))):
            other[at] = chr(0x4E00 + rng.randrange(9000))
        rows += [(f"l{i}a", "".join(base)), (f"l{i}b", "".join(other))]
    got = {(r["key_a"], r["key_b"]) for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA), guaranteed=True).collect()}
    assert got == set(brute(rows))


def test_a_guaranteed_pair_shares_a_word():
    rng = random.Random(2)
    for n in (64, 90, 127, 128, 200, 500):
        for _ in range(60):
            smaller = rng.randrange(-(-7 * n // 10), n + 1)
            shared = next(k for k in range(smaller + 1) if 10 * k >= 7 * (n + smaller - k))
            pool = [rng.getrandbits(64) for _ in range(n + smaller - shared)]
            a, b = (N.np.sort(N.np.array(x, dtype=N.np.uint64)) for x in (pool[:n], pool[n - shared :]))
            x, y = (set(N.np.concatenate(list(N.text_words(t, guaranteed=True))).tolist()) for t in (a, b))
            assert x & y


def test_sketch_distance_is_a_lower_bound():
    rng = random.Random(3)
    for n, m in ((80, 60), (300, 290), (1000, 700), (5000, 3600)):
        pool = [rng.getrandbits(64) for _ in range(n + m)]
        for shared in (0, m // 2, m):
            a, b = (N.np.sort(N.np.array(x, dtype=N.np.uint64)) for x in (pool[:n], pool[n - shared : n - shared + m]))
            assert N.sketch_distance(N.bit_sketch(a), N.bit_sketch(b)) <= len(N.np.setxor1d(a, b))
    assert N.sketch_distance(N.bit_sketch(a), N.bit_sketch(a)) == 0


def test_hot_words_are_split_and_lose_no_pair(spark):
    matches = spark.createDataFrame([(1, i) for i in range(90)] + [(2, i) for i in range(80, 95)] + [(1, 3)], "word bigint, content bigint")
    got = {(r["a"], r["b"]) for r in N.candidates(matches, hot=7).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90)} | {(i, j) for i in range(80, 95) for j in range(i + 1, 95)}


def test_full_buckets_pass_on_frequent_words(spark):
    rng = random.Random(5)
    rows = [(7, c) for c in range(400)] + [(w, rng.randrange(1000)) for w in range(100, 300) for _ in range(rng.randrange(1, 4))]
    rng.shuffle(rows)
    packed = [(0, N.np.array(rows[i : i + 25], dtype=N.np.int64).tobytes()) for i in range(0, len(rows), 25)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = N.equal_words(spark.createDataFrame([(b, bytearray(x)) for b, x in packed], "bucket bigint, packed binary"), 1, most=120, hot=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    holders = {}
    for w, c in rows:
        holders.setdefault(w, set()).add(c)
    assert {(r["word"], r["content"]) for r in got} == {(w, c) for w, cs in holders.items() if len(cs) > 1 for c in cs}


@pytest.mark.parametrize("size", range(1, N.FEW_TOKENS))
def test_first_tokens_meet_at_the_limit(size):
    rng = random.Random(size)
    for smaller in range(1, size + 1):
        shared = next((k for k in range(smaller + 1) if 10 * k >= 7 * (size + smaller - k)), None)
        if shared is None:
            continue
        for _ in range(20):
            pool = rng.sample(range(10**6), size + smaller - shared)
            a, b = (N.np.sort(N.np.array(x, dtype=N.np.uint64)) for x in (pool[:size], pool[size - shared :]))
            assert len(N.np.intersect1d(a, b)) == shared and len(N.np.intersect1d(N.first_tokens(a), N.first_tokens(b)))


def test_groups_are_the_components(spark):
    rows = variants(5, 40)
    got = {r["key"]: r["group"] for r in N.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {k: find(k) for k, t in rows if len(N.squeeze(t)) >= 60}


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in N.connected(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_words_bound_the_difference():
    rng = random.Random(1)
    a = N.shingles("".join(chr(0x4E00 + rng.randrange(500)) for _ in range(300)))
    b = a[5:]
    x, y = (N.parity_words(t, 40, 1, 3) for t in (a, b))
    assert len(set(x) ^ set(y)) / 2 <= 5


@pytest.mark.parametrize("level", range(6, 13))
def test_bands_suffice_at_both_ends(level):
    g = N.bands_at(level)
    assert min(N.expected_equal(n, g, N.least_tokens(level), 0.7) for n in (2**level, 2 ** (level + 1))) >= 7


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.similar_pairs(empty).count() == 0 and N.groups(empty).count() == 0
