"""Broken prompt and response pairs.

Method: the clauses of a response are tagged answer, refusal, echo, foreign or unfinished
by a linear-chain conditional random field, and the coverage of the tags gives the defect
of the pair.

Training.  The field is fitted here on a bounded sample of pairs.  What a clause is called
in training is known from how its text was made, not from what the features see: answers
are taken as they are, cut off within their last sentence or after a mark that they open,
shortened to the bare value, given to questions of another language, or replaced by the
question with a label, quotes, other widths or other marks.  Only refusals can't be made:
an answer with one of a few seed phrases and without figures is one as a whole, so that
its other clauses teach what refusals look like; the seeds are no features.  The field
then tags the short answers left out so far, and is fitted again with the refusals among
them.  Answers in a language in which nobody asks are foreign as a whole.

Features: position, length, figures, words or pairs of characters, the share of the clause
that is in the question, its language against the expected one; at the end of the answer
its last characters, open marks, and how often such an end is a sentence's in the corpus.

Defined results: a null answer is empty; a null or blank question has no echo and no
language of its own; rows with a null id are left out; texts are read whole; repeated
rows give one row; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
DEFECTS = ("empty", "truncated", "refusal", "copies_question", "other_language")

#: Pairs of the training sample, at most, taken by the hash of their ids; and how many of the ordinary answers among them are used of each language.
SAMPLE, ORDINARY = 6000, 1500
#: Clauses of a sequence in training; longer ones are fitted in stretches of so many, none is left out.
STRETCH = 64
#: An answer of fewer Han characters (or two and a half times as many letters) may be a refusal without a seed phrase; in training it is of unknown kind.
SHORT = 60

# Phrases that mark an answer of the sample as a refusal; labels of a repeated question; words for languages.
REFUSAL_SEEDS = regex.compile(
    r"抱歉|对不起|无法回答|不能作答|没有涉及|(?:没有|未能?)(?:检索|查询|查|找)到|\b(?:sorry|(?:unable|not able) to|can ?not answer|no relevant|did not find|not (?:found|mentioned))\b|申し訳|回答できません|leider|ขออภัย", regex.I
)
ECHO_LABELS = regex.compile(r"^[\s“”\"'*#>《》【】\-—:：]*(?:您的?|你的?|用户的?)?(?:原)?(?:问题|提问|题目|问|question|query|q|prompt)(?:是|为|如下|\d+)?[\s:：*】\])）.、]*", regex.I)
LANGUAGE_REQUESTS = (
    ("en", regex.compile(r"英文|英语|英譯|译成英|\bin english\b|\benglish\b", regex.I)), ("zh", regex.compile(r"用中文|中文回答|汉语|译成中文|\bin chinese\b", regex.I)),
    ("ja", regex.compile(r"日文|日语|日本語|\bin japanese\b", regex.I)), ("de", regex.compile(r"德文|德语|\bin german\b|auf deutsch", regex.I)), ("th", regex.compile(r"泰文|泰语|\bin thai\b", regex.I)),
)
REQUESTS = {"en": "（请用英文回答。）", "zh": " (please answer in Chinese)", "ja": "（请用日文回答。）", "de": "（请用德文回答。）", "th": "（请用泰文回答。）"}
FUNCTION_WORDS = {
    "en": frozenset("the of and to in a is was were for that with by from on at as are be it this which while because may our their not has have had its an or but against before after".split()),
    "de": frozenset("der die das und in von zu mit den im für ist auf ein eine wurden wurde wegen unter sagte laut des dem nicht sich auch um bei am einige wir".split()),
}

_CITATION = regex.compile(r"\s*\[\s*\d{1,3}(?:\s*[,，、\-–]\s*\d{1,3})*\s*\]")
_CLAUSE = regex.compile(r"(?:[^。！？!?；;，\n,.]|(?<=\d)[,.](?=\d)|\.(?!\s|$|\[)|,(?!\s|$))*(?:[。！？!?；;，,.…]+[”’」』）)》\"]*(?:\[\d{1,3}\])*|\n+|$)")
_STOP = regex.compile(r"[。．.！!？?…][”’」』）)》\"'*]*$")
_ENTRY = regex.compile(r"^\s*(?:[-•·*●]|\d+[.)、]|[（(]\w+[)）])\s*\S")
_GROUPED = re.compile(r"\d{1,3}(?:,\d{3})+")
_VALUE = regex.compile(r"(?<=为|至|达到|了|was |to |of )[+-]?\d[\d,]*(?:\.\d+)?(?:%|\p{Han}{1,3}(?=[，。；、])| ?[A-Za-z]{2,9}\b)")
_BRACKETS = {"）": "（", ")": "(", "》": "《", "”": "“", "」": "「", "】": "【", "]": "[", "』": "『"}
_MARK = re.compile("[" + re.escape("".join(_BRACKETS) + "".join(_BRACKETS.values())) + "]")
_NOT_PLAIN = re.compile(r"[\W_]+")
_FIGURE = re.compile(r"\d")
_LETTERS = regex.compile(r"\p{L}+")


class Clause(NamedTuple):
    text: str  # without citations and outer space
    raw: str


def strip_citations(text: str) -> str:
    return _CITATION.sub("", text) if "[" in text else text


def has_content(text: str | None) -> bool:
    """A letter or digit besides citation marks."""
    return bool(text) and bool(plain(strip_citations(text)))


def plain(text: str) -> str:
    """For comparisons: NFKC, lower case, letters and digits only."""
    kept = _NOT_PLAIN.sub("", text)
    return (kept if unicodedata.is_normalized("NFKC", kept) else _NOT_PLAIN.sub("", unicodedata.normalize("NFKC", kept))).lower()


def clauses(answer: str) -> list[Clause]:
    out = []
    for m in _CLAUSE.finditer(answer):
        raw = m[0]
        text = strip_citations(raw).strip()
        if text and (not out or _NOT_PLAIN.sub("", text)):
            out.append(Clause(text, raw))
    return out


_SCRIPTS = {
    "han": re.compile("[\u3400-\u4dbf\u4e00-\u9fff]"), "kana": re.compile("[\u3041-\u30ff]"), "thai": re.compile("[\u0e00-\u0e7f]"), "latin": regex.compile(r"\p{Latin}"),
    "hangul": re.compile("[\uac00-\ud7af]"), "cyrillic": re.compile("[\u0400-\u04ff]"),
}
#: What no text in Chinese has but for names.
_OTHER_SCRIPT = re.compile("[A-Za-z\u00c0-\u052f\u0e00-\u0e7f\u1e00-\u1eff\u3041-\u30ff\uac00-\ud7af]")
_TWO_HAN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff].*?[\u3400-\u4dbf\u4e00-\u9fff]", re.S)


def language_of(text: str) -> str | None:
    """zh, ja, th, ko, ru, en, de; null where there is too little to tell, such as names and figures."""
    if not _OTHER_SCRIPT.search(text):
        return "zh" if _TWO_HAN.search(text) else None
    n = {name: len(pattern.findall(text)) for name, pattern in _SCRIPTS.items()}
    if n["kana"] >= 2 and n["kana"] >= 0.15 * (n["han"] + n["kana"]):
        return "ja"
    for script, language in (("thai", "th"), ("hangul", "ko"), ("cyrillic", "ru")):
        if n[script] >= 3 and n[script] >= n["latin"] + n["han"]:
            return language
    if n["han"] >= 2 and n["han"] * 6 >= n["latin"] or n["han"] >= 4 and n["han"] * 10 >= n["latin"]:
        return "zh"
    if n["latin"] >= 6:
        words = [w.lower() for w in _LETTERS.findall(text)]
        hits = {k: sum(w in v for w in words) for k, v in FUNCTION_WORDS.items()}
        if any(c in "äöüß" for c in text.lower()) and hits["de"] >= hits["en"]:
            return "de"
        if max(hits.values()) and len(words) >= 3:
            return max(hits, key=lambda k: hits[k])
        if len(words) >= 8 and n["han"] == 0:
            return "en"
    return "zh" if n["han"] >= 2 else None


def expected_language(question: str | None) -> str | None:
    for language, pattern in LANGUAGE_REQUESTS:
        if question and pattern.search(question):
            return language
    return language_of(question or "")


def _trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)} or {text}


def open_marks(text: str) -> str:
    """Brackets, quotes, titles or citation marks that are opened and not closed, in order."""
    stack = []
    for c in _MARK.findall(text):
        if c in _BRACKETS:
            if stack and stack[-1] == _BRACKETS[c]:
                stack.pop()
        else:
            stack.append(c)
    return "".join(stack)


class Context(NamedTuple):
    expected: str | None
    question: str
    grams: set[str]
    ends: dict[str, int]  # forms that end sentences in the corpus, with how often (as a power of 4)

    @classmethod
    def of(cls, question: str | None, ends: dict[str, int] | None = None) -> Context:
        q = plain(question or "")
        return cls(expected_language(question), q, _trigrams(q) if q else set(), ends or {})


def echo_share(clause: str, context: Context) -> float:
    """Share of the clause, but for a label, that is in the question; 0 for clauses of up to three letters."""
    p = plain(clause)
    if not context.question or len(p) < 4:
        return 0.0
    if p in context.question:
        return 1.0
    if context.question in p:
        return len(context.question) / len(p)
    grams = _trigrams(p)
    share = len(grams & context.grams) / len(grams)
    if share < 0.5 or share > 0.95:
        return share
    bare = plain(ECHO_LABELS.sub("", clause))
    return echo_share(bare, context) if 0 < len(bare) < len(p) else share


_END_WORD = re.compile(r"[A-Za-zÀ-ÿ'-]+$")


def end_form(text: str) -> str:
    """The last word, or the last two characters, figures as 0."""
    text = _FIGURE.sub("0", _STOP.sub("", text)).rstrip()
    m = _END_WORD.search(text)
    return m[0].lower() if m else text[-2:]


_GROUP = re.compile(r"\d,(\d*)[.。．]?$")


def _shape(c: str) -> str:
    return "figure" if c.isdigit() else "Latin" if c.isascii() and c.isalpha() else "letter" if c.isalpha() else c


def end_features(last: Clause, answer: str, context: Context) -> list[str]:
    """What the end of the answer looks like: its last characters, open marks, and the corpus' use of such an end."""
    body = last.text.rstrip("*")
    marks = open_marks(strip_citations(answer))
    stopped = bool(_STOP.search(body))
    form = end_form(body)
    entry = bool(_ENTRY.match(answer.rstrip().rsplit("\n", 1)[-1]))
    seen = context.ends.get(form, 0)
    short = min(3, len(plain(answer)) // 6)
    shape = "".join(_shape(c)[0] for c in body[-3:])
    group = _GROUP.search(body)
    return [
        f"open {marks[-1:]}", f"opened {bool(marks)}", f"stop {stopped}", f"ends {body[-1:]}" if not body[-1:].isalnum() else f"ends {_shape(body[-1:])}", f"form {form}, stop {stopped}",
        f"seen {seen}, stop {stopped}", f"entry {entry}, stop {stopped}", f"short {short}, stop {stopped}, {_shape(body[-1:])}", f"short {short}, seen {seen}", f"shape {shape}", f"figures after the comma {len(group[1]) if group else None}",
    ]


def features(parts: list[Clause], answer: str, context: Context) -> list[list[str]]:
    """The features of each clause."""
    out = []
    for i, c in enumerate(parts):
        share = echo_share(c.text, context)
        n = len(c.text)
        language = language_of(c.text)
        foreign = context.expected is not None and language is not None and language != context.expected
        figure = _FIGURE.search(c.text) is not None
        names = ["bias", f"first {i == 0}", f"length {min(6, n // 6)}", f"echo {int(share * 10)}", f"whole {share > 0.85 and n >= 6}", f"echo {int(share * 4)}, figure {figure}", f"foreign {foreign}", f"foreign {foreign}, {language}", f"no language {language is None}", f"figure {figure}"]
        if i == len(parts) - 1:
            names += ["last", *end_features(c, answer, context)]
        if language in ("en", "de") or c.text.isascii():
            # words of another language than expected say other things
            names += {f"{'~' if foreign else ''}{w}" for w in _LETTERS.findall(c.text.lower())}
        else:
            names += {c.text[k : k + 2] for k in range(n - 1)}
        out.append(names)
    return out


class Field:
    """Linear-chain conditional random field over binary features; features that it doesn't know weigh nothing."""

    def __init__(self, known: dict[str, int] | None = None, weights: np.ndarray | None = None, transitions: np.ndarray | None = None):
        k = len(TAGS)
        self.known = known or {}
        self.weights = np.zeros((len(self.known), k)) if weights is None else weights
        self.transitions = np.zeros((k, k)) if transitions is None else transitions

    def ids(self, seqs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """The known features of all clauses one after another, and where those of each clause begin."""
        get, flat, starts = self.known.get, [], []
        for seq in seqs:
            for names in seq:
                starts.append(len(flat))
                flat += [i for i in map(get, names) if i is not None]
        return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)

    def scores(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of tag scores per clause."""
        sums = np.zeros((len(starts), len(TAGS)))
        full = np.diff(np.append(starts, len(flat))) > 0
        if full.any():
            sums[full] = np.add.reduceat(self.weights[flat], starts[full], axis=0)
        return sums

    def decode(self, seqs: list[list[list[str]]]) -> list[list[int]]:
        """The best tags of each sequence, all sequences step by step together."""
        rows, (order, lengths, first) = self.scores(*self.ids(seqs)), _arranged(seqs)
        if not len(order):
            return [[] for _ in seqs]
        live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # sequences of more than t clauses
        best, back = rows[first], []
        for t in range(1, lengths[0]):
            n = live[t]
            step = best[:n, :, None] + self.transitions
            back.append(step.argmax(axis=1).astype(np.int8))
            best[:n] = step.max(axis=1) + rows[first[:n] + t]
        tags = np.zeros((lengths[0], len(order)), dtype=np.int64)
        at = best.argmax(axis=1)
        for t in range(lengths[0] - 1, -1, -1):
            n = live[t]
            tags[t, :n] = at[:n]
            if t:
                at[:n] = back[t - 1][np.arange(n), at[:n]]
        out: list[list[int]] = [[] for _ in seqs]
        for k, i in enumerate(order):
            out[i] = tags[: lengths[k], k].tolist()
        return out

    def train(self, data: list[tuple[list[list[str]], list[int]]], steps: int = 600, rate: float = 0.3, decay: float = 3e-5, batch: int = 256, seed: int = 7) -> Field:
        """Stochastic gradient (AdaGrad) on the conditional likelihood, at least `steps` times; forward and backward sums run over whole batches."""
        # very long sequences are fitted in stretches
        data = [(x[i : i + STRETCH], y[i : i + STRETCH]) for x, y in data for i in range(0, len(x), STRETCH)]
        count = Counter(name for seq, _ in data for names in seq for name in names)
        self.known = {name: i for i, name in enumerate(sorted(n for n, c in count.items() if c > 1))}
        k = len(TAGS)
        self.weights, self.transitions = np.zeros((len(self.known), k)), np.zeros((k, k))
        gw, gt = np.full_like(self.weights, 1e-2), np.full_like(self.transitions, 1e-2)
        rng = random.Random(seed)
        # sequences of like length form a batch
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]), rng.random()))
        batches = [_Batch(self, [data[i] for i in order[j : j + batch]]) for j in range(0, len(order), batch)]
        for _ in range(-(-steps // max(1, len(batches)))):
            rng.shuffle(batches)
            for b in batches:
                error, grad_t = b.errors(self)
                per_feature = np.repeat(error, b.sizes, axis=0)
                grad = np.stack([np.bincount(b.flat, weights=per_feature[:, t], minlength=len(self.known)) for t in range(k)], axis=1) / len(b.lengths)
                grad -= decay * self.weights
                grad_t = grad_t / len(b.lengths) - decay * self.transitions
                gw += grad * grad
                gt += grad_t * grad_t
                self.weights += rate * grad / np.sqrt(gw)
                self.transitions += rate * grad_t / np.sqrt(gt)
        return self


def _arranged(seqs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lengths, first clause) of the sequences that aren't empty, the longest first."""
    lengths = np.array([len(s) for s in seqs], dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    return order, lengths[order], first[order]


class _Batch:
    """Sequences of a training step, padded to the longest."""

    def __init__(self, field: Field, data: list[tuple[list[list[str]], list[int]]]):
        seqs = [x for x, _ in data]
        self.flat, self.starts = field.ids(seqs)
        self.sizes = np.diff(np.append(self.starts, len(self.flat)))
        self.lengths = np.array([len(x) for x in seqs])
        steps = np.arange(self.lengths.max())
        self.there = steps[None, :] < self.lengths[:, None]
        self.gold = np.zeros(self.there.shape, dtype=np.int64)
        self.gold[self.there] = [t for _, y in data for t in y]

    def errors(self, field: Field) -> tuple[np.ndarray, np.ndarray]:
        """Gold minus expected tags per clause, and the same for the transitions."""
        there, k = self.there, len(TAGS)
        s = np.zeros((*there.shape, k))
        s[there] = field.scores(self.flat, self.starts)
        move = np.exp(field.transitions)
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, s.shape[1]):
            m = alpha[:, t - 1].max(axis=1, keepdims=True)
            new = np.log(np.exp(alpha[:, t - 1] - m) @ move) + m + s[:, t]
            alpha[:, t] = np.where(there[:, t, None], new, alpha[:, t - 1])
        for t in range(s.shape[1] - 2, -1, -1):
            x = beta[:, t + 1] + s[:, t + 1]
            m = x.max(axis=1, keepdims=True)
            new = np.log(np.exp(x - m) @ move.T) + m
            beta[:, t] = np.where(there[:, t + 1, None], new, beta[:, t + 1])
        top = alpha[:, -1].max(axis=1, keepdims=True)
        total = top + np.log(np.exp(alpha[:, -1] - top).sum(axis=1, keepdims=True))
        error = -np.exp(alpha + beta - total[:, :, None])
        rows, cols = np.nonzero(there)
        error[rows, cols, self.gold[there]] += 1
        grad_t = np.zeros((k, k))
        for t in range(1, s.shape[1]):
            on = there[:, t]
            pair = alpha[on, t - 1][:, :, None] + field.transitions + (s[on, t] + beta[on, t])[:, None, :] - total[on][:, :, None]
            grad_t -= np.exp(pair).sum(axis=0)
            np.add.at(grad_t, (self.gold[on, t - 1], self.gold[on, t]), 1)
        return error[there], grad_t


def _whole_sentences(answer: str) -> bool:
    return bool(_STOP.search(strip_citations(answer).rstrip())) and not open_marks(strip_citations(answer))


def _cut_copies(answer: str, rng: random.Random) -> list[tuple[str, int]]:
    """(text, tag of its last clause): the answer cut within its last sentence or after a mark or separator, and without its full stop."""
    body = strip_citations(answer).rstrip()
    bare = body.rstrip("。．.！!？?…")
    start = max(bare.rfind(c) for c in "。！？\n") + 1 if _SCRIPTS["han"].search(bare) else max(bare.rfind(". "), bare.rfind("\n")) + 1
    if len(bare) - start < 12:
        return []
    at = [rng.randrange(start + 4, len(bare) - 1) for _ in range(3)]
    at += [rng.choice(words) for words in [[m.start() for m in re.finditer(r"(?<=[a-z,]) ", bare) if m.start() > start + 4]] if words]
    grouped = [m for m in _GROUPED.finditer(bare)]
    broken = []
    if grouped:
        m = rng.choice(grouped)
        comma = m.end() - 4
        broken = [(bare[: comma + 1 + rng.randrange(3)] + rng.choice(("", ".", "。")), UNFINISHED)]
    opened = rng.choice(("[", "[1", "[12", "（", "（见", "《关于", "“", " (see", ", and", "，", "、", "：", "为2,53", "为14,"))
    pieces = [p for p in regex.split(r"(?<=[。！？\n])|(?<=\. )", bare[:start]) if p.strip()]
    short = rng.choice(pieces)[: rng.randrange(6, 14)] if pieces else bare[start:][:8]
    values = _VALUE.findall(answer)
    single = [(rng.choice(pieces).strip(), ANSWER)] if len(pieces) > 1 else []
    kept = [(bare[:x], UNFINISHED) for x in at] + [(bare + opened, UNFINISHED), (bare[: at[0]] + rng.choice(("（", "《", "“", "(")) + bare[at[0] : at[0] + 5], UNFINISHED), (short, UNFINISHED), (bare, ANSWER)]
    words = [(rng.choice(("是", "否", "有", "没有", "Yes", "No")) + rng.choice(("", "。", "[3]", "。[12][4]")), ANSWER)]
    # a mark opened anywhere and not closed, or closed; entries after the text
    x, y = sorted(rng.sample(range(len(bare)), 2))
    mark = rng.choice(("（）", "“”", "《》", "[]", "()"))
    kept += [(body[:x] + mark[0] + body[x:], UNFINISHED), (body[:x] + mark[0] + body[x:y] + mark[1] + body[y:], ANSWER)]
    entry = rng.choice(("- ", "• ", "1. ", "2) ", "（1）"))
    kept += [(f"{body}\n{rng.choice(('', '补充：' + chr(10)))}{entry}{bare[start:][:6]}：{v}", ANSWER) for v in (values[-1:] or [bare[start + 6 :][:6]])] * 2
    return kept + broken + single + [(v, ANSWER) for v in values[:1]] + words * (rng.random() < 0.3)


def _echoes(question: str, rng: random.Random) -> list[str]:
    """The question as an answer: labelled, quoted, twice, in other width or spaces, with another mark at its end."""
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in question)
    narrow = unicodedata.normalize("NFKC", question)
    bare = question.rstrip("？?。.")
    made = [question, rng.choice(("问题：", "问：", "您的问题是：", "Question: ", "Q: ")) + question, f"“{question}”", question + question, wide, narrow, bare, bare + rng.choice(("……", "。", "...")), " ".join(question) if rng.random() < 0.3 else question]
    return rng.sample(made, 2)


class Training(NamedTuple):
    data: list[tuple[list[list[str]], list[int]]]  # features and tags
    unknown: list[list[list[str]]]  # features of short answers that may be refusals


def training_data(pairs: list[tuple[str | None, str | None]], ends: dict[str, int], ordinary: int = ORDINARY, seed: int = 7) -> Training:
    """The sequences made of the pairs (question, answer), with the tags that follow from how they were made."""
    rng = random.Random(seed)
    made = Training([], [])
    usable = [(q, a, expected_language(q), language_of(a)) for q, a in pairs if has_content(a)]
    asked = {language_of(q or "") for q, _, _, _ in usable}
    by_language: dict[str, list[tuple[str, str]]] = {}
    for q, a, expected, language in usable:
        if language and expected == language and not REFUSAL_SEEDS.search(a):
            by_language.setdefault(language, []).append((q, a))
    # all kinds of copies are made of pairs in languages with few, some kinds of each pair in the others
    often = {x for x, held in by_language.items() if len(held) > ordinary // 2}
    left = dict.fromkeys(by_language, ordinary)

    def add(question: str | None, answer: str, tag) -> None:
        parts = clauses(answer)
        tags = [tag(c, k == len(parts) - 1) for k, c in enumerate(parts)]
        made.data.append((features(parts, answer, Context.of(question, ends)), tags))

    for q, a, expected, language in usable:
        seeded, size = bool(REFUSAL_SEEDS.search(a)), len(plain(a))
        short = size < (SHORT if language in ("zh", "ja", None) else 2.5 * SHORT)
        asks = plain(q or "")
        if seeded and short:
            bare = strip_citations(a).rstrip("。！!. ")
            for text in [a, bare] if expected in often else [a, bare, bare + ".", bare + " [1].", bare + ".[2]"]:
                add(q, text, lambda c, last: REFUSAL)
            continue
        if language and expected and language not in asked and language != expected:
            for text, end in ((a, ANSWER), (a[: rng.randrange(len(a) // 2, max(len(a) - 1, len(a) // 2 + 1))], UNFINISHED)):
                add(q, text, lambda c, last: FOREIGN)
                if language in REQUESTS:
                    add((q or "") + REQUESTS[language], text, lambda c, last, end=end: end if last else ANSWER)
            continue
        if asks and asks in plain(strip_citations(a)) and size < 1.3 * len(asks) or language and expected and language != expected:
            continue  # hardly more than the question, or of another language: these are made below
        if short:
            made.unknown.append(features(clauses(a), a, Context.of(q, ends)))
            continue
        if not _whole_sentences(a) and not _ENTRY.match(a.rstrip().rsplit("\n", 1)[-1]):
            continue  # unknown whether it was cut
        if left.get(language, 0) <= 0:
            continue
        left[language] -= 1
        told = lambda c, last: REFUSAL if seeded and REFUSAL_SEEDS.search(c.text) else ECHO if asks and asks in plain(c.text) else ANSWER
        add(q, a, told)
        if not seeded:
            copies = _cut_copies(a, rng)
            for text, end in rng.sample(copies, min(4, len(copies)) if language in often else len(copies)):
                add(q, text, lambda c, last, end=end: end if last else told(c, last))
        echo, swap = (rng.random() < 0.25 for _ in range(2)) if language in often else (True, True)
        if asks and echo:
            for text in _echoes(q, rng):
                add(q, text, lambda c, last: ECHO)
            add(q, f"关于“{q}”：{a}" if expected == "zh" else f"“{q}” {a}", lambda c, last: ECHO if plain(c.text) and plain(c.text) in asks else ANSWER)
        if swap:
            others = [x for x in by_language if x != expected]
            if others and expected:
                asked_there, said_there = rng.choice(by_language[rng.choice(others)])
                add(q, said_there, lambda c, last: FOREIGN)
                add(q, f"{plain(q)[:6]}: {said_there}", lambda c, last: FOREIGN)
                add(asked_there, a, lambda c, last: FOREIGN)
                if expected in REQUESTS:
                    add((asked_there or "") + REQUESTS[expected], a, lambda c, last: ANSWER)
    return made


def train_field(pairs: list[tuple[str | None, str | None]], ends: dict[str, int] | None = None, ordinary: int = ORDINARY, seed: int = 7) -> Field:
    """Fit the field on a sample of pairs (question, answer), twice: the second time with the refusals that it finds among the short answers."""
    made = training_data(pairs, ends or {}, ordinary, seed)
    field = Field().train(made.data, seed=seed)
    found = [(x, [REFUSAL] * len(x)) for x, tags in zip(made.unknown, field.decode(made.unknown)) if tags.count(REFUSAL) * 2 > len(tags)]
    return field.train(made.data + found, seed=seed)


def coverage(parts: list[Clause], tags: list[int]) -> list[float]:
    """Share of the letters and digits under each tag."""
    sizes = np.array([max(1, len(_NOT_PLAIN.sub("", c.text))) for c in parts], dtype=float)
    return (np.bincount(tags, weights=sizes, minlength=len(TAGS)) / sizes.sum()).tolist()


#: Shares of the tags from which a pair has the defect.
MOSTLY = {"refusal": 0.9, "copies_question": 0.9, "other_language": 0.5}


def verdict(tags: list[int], share: list[float]) -> str | None:
    """The defect of a pair from the coverage of the tags and the last of them."""
    if share[REFUSAL] >= MOSTLY["refusal"]:
        return "refusal"
    if share[ECHO] >= MOSTLY["copies_question"]:
        return "copies_question"
    if share[FOREIGN] >= MOSTLY["other_language"]:
        return "other_language"
    return "truncated" if tags[-1] == UNFINISHED else None


def judge_pairs(pairs: list[tuple[str | None, str | None]], field: Field, ends: dict[str, int] | None = None) -> list[tuple[str | None, list[float]]]:
    """(the one defect or null, coverage of each tag) of all pairs (question, answer)."""
    out: list = [("empty", [0.0] * len(TAGS))] * len(pairs)
    full = [(i, q, a, clauses(a)) for i, (q, a) in enumerate(pairs) if has_content(a)]
    tagged_ = field.decode([features(parts, a, Context.of(q, ends)) for _, q, a, parts in full])
    for (i, _, _, parts), tags in zip(full, tagged_):
        share = coverage(parts, tags)
        out[i] = (verdict(tags, share), share)
    return out


#: A form counts if it ends at least this share of the sentences, so there are a million at most.
LEAST_SHARE = 1e-6


def sentence_end_forms(pairs: DataFrame) -> dict[str, int]:
    """Words and pairs of characters that end sentences in the answers, with 1 + the power of 4 of their share above LEAST_SHARE."""
    found = F.regexp_extract_all("answer", F.lit(r"([A-Za-zÀ-ÿ'-]+|[^\s。！？!?.,，；;]{2})(?:\s?\[\d+\])*(?:[。！？!?]|\.(?:\s|$|\[))"), F.lit(1))
    counted = pairs.select(F.explode(found).alias("end")).groupBy(F.lower(F.regexp_replace("end", r"[0-9０-９]", "0")).alias("end")).agg(F.count("*").alias("n"))
    counted = materialize(counted)
    share = F.col("n") / counted.agg(F.sum("n")).scalar()
    level = 1 + F.floor(F.log(4.0, share / F.lit(LEAST_SHARE))).cast("int")
    return {r["end"]: r["level"] for r in counted.filter(share >= LEAST_SHARE).select("end", level.alias("level")).collect()}


def fit(pairs: DataFrame, ends: dict[str, int], sample: int = SAMPLE) -> Field:
    """Train on at most `sample` pairs, chosen by the hash of their ids."""
    rows = pairs.select("id", "question", "answer").filter("id is not null and answer is not null").distinct().orderBy(F.xxhash64("id"), "id", "question", "answer").limit(sample)
    return train_field([(r["question"], r["answer"]) for r in rows.collect()], ends)


_FITTED: dict[tuple, tuple[Field, dict[str, int]]] = {}


def fitted(pairs: DataFrame, sample: int = SAMPLE) -> tuple[Field, dict[str, int]]:
    """The field and the ends of sentences of these pairs, made once in a session."""
    key = (pairs.sparkSession.sparkContext.applicationId, pairs.semanticHash(), sample)
    if key not in _FITTED:
        _FITTED.clear()
        ends = sentence_end_forms(pairs)
        _FITTED[key] = fit(pairs, ends, sample), ends
    return _FITTED[key]


def tagged(pairs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """id, defect and the coverage of each tag, for every pair; pairs(id, question, answer)."""
    pairs = pairs.select("id", "question", "answer")
    field, ends = fitted(pairs, sample)
    shared = pairs.sparkSession.sparkContext.broadcast((field.known, field.weights.astype(np.float32), field.transitions, ends))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, weights, transitions, ends = shared.value
        own = Field(known, weights, transitions)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                judged = judge_pairs(list(zip(part["question"], part["answer"])), own, ends)
                rows = [(key, kind, *share) for key, (kind, share) in zip(part["id"], judged)]
                yield pd.DataFrame(rows, columns=["id", "defect", *TAGS])

    return pairs.filter("id is not null").mapInPandas(judge, "id string, defect string, " + ", ".join(f"{t} double" for t in TAGS)).distinct()


def find_defects(pairs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """id, defect of the defective pairs; pairs(id, question, answer)."""
    return tagged(pairs, sample).filter(F.col("defect").isNotNull()).select("id", "defect").distinct()
