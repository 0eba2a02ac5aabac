import random

import pytest

from ledgerloom.llm import pairs as P

SENTENCES = ["公司推进了量产订单，并在南栈增设{n}个网点以应对渠道去库存。", "受下游需求回暖影响，毛利下降至{n},781.93万美元。", "存货余额变动{n}.5%，主要系认证通过所致。", "研发支出已连续多期改善，客户数上升了{n}%。", "管理层同时声明，不能排除汇率波动的影响。"]
QUESTIONS = ["昱绮算研20{n}年的毛利是多少？同比变化多少？", "哪些因素使昱绮算研无法按期交付{n}号加速引擎？", "请概括20{n}年度在赤岩的业务进展。"]


def sample(n=400, seed=1):
    rng = random.Random(seed)
    fill = lambda s: s.replace("{n}", str(rng.randrange(11, 99)))
    rows = []
    for i in range(n):
        q = fill(rng.choice(QUESTIONS))
        a = "".join(fill(s) for s in rng.sample(SENTENCES, rng.randrange(1, 4))) + rng.choice(["", "[3]", "[12][4]"])
        u = rng.random()
        if u < 0.06:
            a = rng.choice(["抱歉，我无法回答这个问题。", "提供的资料里没有找到相关内容，建议查阅原始公告。", "对不起，资料不足，不能作答。"])
        elif u < 0.12:
            a = rng.choice([q, "问题：" + q, q + q, f"“{q}”"])
        elif u < 0.18:
            a = "Because of weaker demand, the output fell to 594 units while the costs rose by 9.1%."
        rows.append((f"q{i}", q, a))
    return rows


CASES = [
    ("毛利是多少？", None, "empty"), ("毛利是多少？", "[1][2]。", "empty"), ("毛利是多少？", "****", "empty"), ("毛利是多少？", "86.79%", None), ("是否披露了毛利？", "否", None),
    ("哪些因素使公司无法按期交付？", "抱歉，我无法回答这个问题，建议查阅原始公告。", "refusal"), ("毛利是多少？", "毛利下降至12,781.93万美元。管理层同时声明，不能排除汇率波动的影响。", None),
    ("请概括2019年度在赤岩的业务进展。", "问题：请概括２０１９年度在赤岩的业务进展。", "copies_question"), ("请概括2019年度在赤岩的业务进展。", "“请概括2019年度在赤岩的业务进展”", "copies_question"),
    ("毛利是多少？", "Because of weaker demand, the output fell to 594 units while the costs rose.", "other_language"), ("毛利是多少？（answer in English）", "The margin was 4.1% in 2019, up from the year before.", None),
    ("毛利是多少？", "公司推进了量产订单，税费为2,53", "truncated"), ("毛利是多少？", "公司推进了量产订单。加速引擎（含封装基板、东港", "truncated"), ("毛利是多少？", "公司推进了量产订单，费用低于内部目标[4", "truncated"), ("毛利是多少？", "报告期内，毛利有所上升，但", "truncated"),
    ("毛利是多少？", "公司推进了量产订单。\n\n补充：\n- 封装基板：70674台", None), (None, "公司推进了量产订单。", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = sample() + [(f"c{i}", q, a) for i, (q, a, _) in enumerate(CASES)] + [("c0", *CASES[0][:2]), (None, "x", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id string, question string, answer string, defect string")
    got = P.find_defects(df).collect()
    assert len(got) == len({r["id"] for r in got})
    return {r["id"]: r["defect"] for r in got}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_defects(found, i):
    assert found.get(f"c{i}") == CASES[i][2], CASES[i]


def test_held_out_accuracy():
    """Fitted on one sample, the field finds the defects made in another, also of refusals without a seed phrase."""
    field = P.train_field([(q, a) for _, q, a in sample(500, 2)])
    rng = random.Random(4)
    want, pairs = [], []
    for _, q, a in sample(300, 9):
        if P.plain(q) in P.plain(a):
            kind = "copies_question"
        elif a.startswith("Because"):
            kind = "other_language"
        elif any(x in a for x in ("抱歉", "没有找到", "对不起")):
            kind = "refusal"
        elif rng.random() < 0.3:
            a, kind = P.strip_citations(a), "truncated"
            a = a[: rng.randrange(len(a) - 12, len(a) - 3)] + rng.choice(("", "（", "《关于"))
        else:
            kind = None
        want.append(kind)
        pairs.append((q, a))
    pairs += [("毛利是多少？", "资料不足，不能作答，建议查阅原始公告。")] * 3
    want += ["refusal"] * 3
    got = [kind for kind, _ in P.judge_pairs(pairs, field)]
    assert sum(x == y for x, y in zip(got, want)) / len(want) > 0.97


def test_the_seeds_alone_find_less():
    """What the field adds to the phrases that label its sample."""
    made = P.training_data([(q, a) for _, q, a in sample(500, 2)], {})
    kinds = {t for _, tags in made.data for t in tags}
    assert kinds == set(range(len(P.TAGS)))
    names = {n for seq, _ in made.data for x in seq for n in x}
    assert not any("cue" in n or "seed" in n or "cut" in n for n in names)


def test_gradient_raises_the_likelihood():
    data = [([["a"], ["b"], ["c"]], [0, 1, 0]), ([["a"], ["c"]], [0, 0]), ([["b"], ["b"]], [1, 1]), ([["c"]], [0])] * 20
    field = P.Field().train(data, steps=100)
    assert field.decode([x for x, _ in data] + [[], [["new"]]])[:80] == [y for _, y in data]


def test_batches_give_the_gradient_of_the_likelihood():
    """Against the sum over all tag sequences."""
    import itertools

    rng = P.np.random.default_rng(3)
    seqs = [[["a"], ["b", "c"], ["a", "d"]], [["d"]], [["b"], ["d"]]]
    data = [(x, [int(rng.integers(5)) for _ in x]) for x in seqs]
    field = P.Field({n: i for i, n in enumerate("abcd")}, rng.normal(size=(4, 5)), rng.normal(size=(5, 5)))
    error, grad = P._Batch(field, data).errors(field)
    want_error, want_grad = [], P.np.zeros((5, 5))
    for x, y in data:
        s = P.np.array([field.weights[[field.known[n] for n in names]].sum(axis=0) for names in x])
        paths = list(itertools.product(range(5), repeat=len(x)))
        weight = P.np.exp([sum(s[i, t] for i, t in enumerate(p)) + sum(field.transitions[u, v] for u, v in zip(p, p[1:])) for p in paths])
        weight /= weight.sum()
        e = P.np.zeros(s.shape)
        for w, p in [*zip(-weight, paths), (1.0, y)]:
            for i, t in enumerate(p):
                e[i, t] += w
            for u, v in zip(p, p[1:]):
                want_grad[u, v] += w
        want_error.append(e)
    assert error == pytest.approx(P.np.concatenate(want_error)) and grad == pytest.approx(want_grad)
    best = field.decode(seqs)
    for x, got in zip(seqs, best):
        s = P.np.array([field.weights[[field.known[n] for n in names]].sum(axis=0) for names in x])
        value = lambda p: sum(s[i, t] for i, t in enumerate(p)) + sum(field.transitions[u, v] for u, v in zip(p, p[1:]))  # noqa: E731, B023
        assert value(got) == pytest.approx(max(map(value, itertools.product(range(5), repeat=len(x)))))


def test_empty_and_long(spark):
    schema = "id string, question string, answer string"
    assert P.find_defects(spark.createDataFrame([], schema)).count() == 0
    long = "公司推进了量产订单。" * 5000
    got = P.tagged(spark.createDataFrame([("a", "毛利是多少？", long), ("b", None, None)], schema)).collect()
    assert {r["id"]: r["defect"] for r in got} == {"a": None, "b": "empty"}


@pytest.mark.parametrize("mark", ["“”", "（）", "《》", "[]"])
def test_a_mark_left_open_long_before_the_end_is_seen(mark):
    said = "公司推进了量产订单，并增设网点以应对渠道去库存。" * 40
    assert P.open_marks(f"董事会表示{mark[0]}{said}") == mark[0] and P.open_marks(f"董事会表示{mark[0]}{said}{mark[1]}{said}") == ""


def test_a_mark_left_open_long_before_the_end_is_a_cut(spark):
    said = "公司推进了量产订单，并增设网点以应对渠道去库存。" * 20
    rows = sample() + [("open", "毛利是多少？", f"董事会表示（{said}"), ("shut", "毛利是多少？", f"董事会表示（{said}）{said}")]
    got = {r["id"]: r["defect"] for r in P.find_defects(spark.createDataFrame(rows, "id string, question string, answer string")).collect()}
    assert got.get("open") == "truncated" and "shut" not in got
