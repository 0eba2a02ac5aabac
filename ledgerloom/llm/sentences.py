"""Sentence boundaries across languages and scripts.

Method: cascading segmentation rule tables.  A rule is a pair of regular expressions,
for the text before and after a position, and says break or no break; at each candidate
position the rules of a cascade are tried in order and the first that matches decides.
Full stops take the cascade of the paragraph's language (CASCADES, which a caller may
extend, as LANGUAGES for telling it); other marks, closed quotes, closed brackets and the
spaces of Thai have tables of their own.  Text inside paired quotes, brackets and title
marks has no candidates.

Defined results: null, empty and blank texts have no sentences; texts are read whole;
repeated rows give one; the language column isn't trusted, languages are told by script
and function words, per paragraph.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame

# Marks that end sentences; marks that may follow them; paired marks.
STOPS = "。｡．.！!？?؟։।॥።︒﹒﹗﹖⁈⁉‼⁇"
ELLIPSIS = "…⋯"
PAIRS = {"“": "”", "„": "“”", "‟": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "〈": "〉", "【": "】", "〔": "〕", "〖": "〗", "[": "]", "{": "}", "｛": "｝", "［": "］", "‘": "’"}
QUOTES = "“„‟«‹「『‘\""
TITLES = "《〈"
CLOSERS = "”’」』）)》〉】〕〗］]}｝»›\"'"

# Abbreviations that never end a sentence, that may end one, and months with ordinal days.
NEVER_FINAL_EN = "e\\.g|i\\.e|cf|No|Nos|Fig|Figs|Sec|Eq|Ch|Vol|vs|approx|incl|excl|est|Mr|Mrs|Ms|Dr|Prof|St|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec|pp|al|Art|Ref|Rev|Gen|Gov|dept|avg|max|min"
MAY_BE_FINAL_EN = "Inc|Ltd|Corp|Co|LLC|Plc|a\\.m|p\\.m|etc|Jr|Sr|Bros|Ave|Ph\\.D"
COUNTRIES = "U\\.S|U\\.K|E\\.U|U\\.N|D\\.C|U\\.S\\.A"
NEVER_FINAL_DE = "z\\.\\s*B|d\\.\\s*h|u\\.\\s*a|o\\.\\s*ä|i\\.\\s*d\\.\\s*R|z\\.\\s*T|v\\.\\s*a|ca|Mio|Mrd|Nr|Nrn|Abs|Art|bzw|vgl|inkl|exkl|ggf|evtl|sog|bspw|Dr|Prof|Hr|Fr|Tsd|zzgl|max|min|S|Abb|Kap|Bd"
MAY_BE_FINAL_DE = "usw|etc|Co|GmbH"
# Abbreviations of further languages, never final and perhaps final; units and months end a sentence before words that begin one.
NEVER_FINAL = {
    "french": r"M|MM|Mme|Mlle|Dr|Me|Pr|St|Ste|av|apr|env|p|pp|art|chap|cf|ex|fig|no|vol|éd|tél|janv|févr|avr|juil|sept|oct|nov|déc|max|min",
    "spanish": r"Sr|Sra|Srta|Dr|Dra|D|Dña|Ud|Uds|pág|págs|art|arts|núm|núms|aprox|av|avda|cap|ej|p\.\s*ej|fig|vol|ed|prof|ing|lic|tel|máx|mín",
    "italian": r"Sig|Sig\.ra|Sigg|Dott|Dott\.ssa|Ing|Avv|Prof|Geom|art|artt|cap|pag|pagg|es|p\.\s*es|ca|n|nn|fig|vol|tel|max|min",
    "portuguese": r"Sr|Sra|Dr|Dra|Eng|Prof|pág|págs|art|arts|n|aprox|av|cap|ex|p\.\s*ex|fig|vol|tel|máx|mín",
    "russian": r"т\.\s*е|т|стр|рис|табл|см|им|ул|д|кв|обл|проф|акад|ср|напр|тыс|млн|млрд",
}
MAY_BE_FINAL = {
    "french": r"etc|S\.A|Cie|Ltée|pers", "spanish": r"etc|S\.A|Cía|Ltda|EE\.\s*UU", "italian": r"ecc|S\.p\.A|S\.r\.l", "portuguese": r"etc|Ltda|S\.A|Cia", "russian": r"г|гг|руб|др|т\.\s*д|т\.\s*п",
}
UNITS_DE = "Mio|Mrd|Tsd|max|min|Jan|Feb|Mrz|Apr|Aug|Sept|Okt|Nov|Dez"
UNITS_EN = "max|min|avg|est|approx|incl|excl|Jan|Feb|Mar|Apr|Aug|Sept|Sep|Oct|Nov|Dec|al"
OPENERS_DE = "Der|Die|Das|Ein|Eine|Im|In|Am|Wir|Es|Sie|Er|Bei|Mit|Nach|Für|Auf|Zu|Dies|Diese|Dieser|Damit|Auch"
OPENERS_EN = "The|A|An|In|It|This|That|These|Our|We|He|She|They|But|And|On|At|For|Because"
MONTHS_DE = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Mrz|Apr|Jun|Jul|Aug|Sep|Sept|Okt|Nov|Dez"


class Rule(NamedTuple):
    name: str
    breaks: bool
    before: regex.Pattern  # matched against the sentence so far, up to the position
    after: regex.Pattern  # matched at the position


def _rule(name: str, breaks: bool, before: str, after: str) -> Rule:
    # matched backwards from the position, so that the sentence isn't searched from its start
    return Rule(name, breaks, regex.compile(before, regex.V1 | regex.REVERSE), regex.compile(after, regex.V1))


_END = r"(?:\s*$)"
_STARTS = r"\s+(?:[“„\"(（「]*\p{Lu}|\p{Ll}{1,2}\p{Lu}|[“„]|\d)"

COMMON = [
    _rule("paragraph end", True, "", _END),
    _rule("ellipsis", False, rf"(?<![！!？?。])(?:\.{{2,}}|[{ELLIPSIS}]+)", ""),
    _rule("number", False, r"\d[.．]", r"\d"),
    _rule("inside a name, file or address", False, r"[\p{L}\d]\.", r"[\p{Latin}\d/@_-]"),
    _rule("clause goes on", False, r"[.．]", r"[,，、;；:：]"),
    _rule("leading number", False, r"^\s*[(（]?(?:\d+|[A-Za-z]|[IVX]+)(?:[.．]\d+)*[.．]", r"\s"),
]
ENGLISH = [
    _rule("unit or month that ends", True, rf"(?<![\p{{L}}\d])(?:{UNITS_EN})\.", rf"\s+(?:{OPENERS_EN})\b"),
    _rule("abbreviation", False, rf"(?<![\p{{L}}\d])(?:{NEVER_FINAL_EN})\.", r"\s"),
    _rule("country before a name", False, rf"(?<!\p{{L}})(?:{COUNTRIES})\.", r"\s+(?!(?:The|A|An|In|It|This|That|These|Our|We|He|She|They|But|And|On|At|For|Because|Sales|Management|Margin)\b)"),
    _rule("abbreviation that ends", True, rf"(?<![\p{{L}}\d])(?:{MAY_BE_FINAL_EN}|{COUNTRIES})\.", r"\s+(?:[“(]*\p{Lu}|\p{Ll}{1,2}\p{Lu}|“)"),
    _rule("name before another script", True, rf"^[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]+(?<![\p{{L}}\d])(?:{MAY_BE_FINAL_EN})\.", r"\s+\p{Han}|\s+\d"),
    _rule("abbreviation within", False, rf"(?<![\p{{L}}\d])(?:{MAY_BE_FINAL_EN})\.", r"\s"),
    _rule("initial", False, r"(?<![\p{L}\d])\p{Lu}\.", r"\s+\p{Lu}"),
]
GERMAN = [
    _rule("unit or month that ends", True, rf"(?<![\p{{L}}\d])(?:{UNITS_DE})\.", rf"\s+(?:{OPENERS_DE})\b"),
    _rule("abbreviation", False, rf"(?<![\p{{L}}\d])(?:{NEVER_FINAL_DE})\.", r"\s"),
    _rule("first part of an abbreviation", False, r"(?<![\p{L}\d])(?:z|d|u|o|i|v|a)\.", r"\s*\p{L}\.|\s*(?:d|T|R|a)\b"),
    _rule("ordinal day", False, r"(?<!\d)(?:[12]?\d|3[01])\.", rf"\s+(?:{MONTHS_DE})\b"),
    _rule("ordinal", False, r"(?<![\d.,])\d{1,2}\.", r"\s+(?:Quartal|Jahrhundert|Halbjahr|Platz|Mal)\b"),
    _rule("abbreviation that ends", True, rf"(?<![\p{{L}}\d])(?:{MAY_BE_FINAL_DE})\.", _STARTS),
    _rule("abbreviation within", False, rf"(?<![\p{{L}}\d])(?:{MAY_BE_FINAL_DE})\.", r"\s"),
]
DEFAULT = [
    _rule("stop before space, closer or another script", True, r"\.", r"[\s“„「『《（(\[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"),
    _rule("full stop elsewhere", False, r"\.", ""),
    _rule("other marks", True, "", ""),
]


def cascade(never: str, may: str) -> list[Rule]:
    """The cascade of a language with these abbreviations (alternatives of a regular expression)."""
    word = r"(?<![\p{L}\d])"
    return [
        *COMMON,
        _rule("first part of an abbreviation", False, rf"{word}\p{{Ll}}\.", r"\s*\p{Ll}{1,3}\."),
        _rule("abbreviation", False, rf"{word}(?:{never})\.", r"\s"),
        _rule("abbreviation that ends", True, rf"{word}(?:{may})\.", r"\s+[“«„\"(]*\p{Lu}"),
        _rule("abbreviation within", False, rf"{word}(?:{may})\.", r"\s"),
        _rule("initial", False, rf"{word}\p{{Lu}}\.", r"\s+\p{Lu}"),
        *DEFAULT,
    ]


CASCADES = {
    "german": [*COMMON, *GERMAN, *ENGLISH, *DEFAULT],
    "other": [*COMMON, *ENGLISH, *DEFAULT],
    **{language: cascade(NEVER_FINAL[language], MAY_BE_FINAL[language]) for language in NEVER_FINAL},
}
#: The rules for marks other than a full stop of either width.
OTHER_MARKS = [COMMON[1], DEFAULT[-1]]
_GOES_ON = _rule("sentence goes on", False, "", rf"\s*[{regex.escape(STOPS)}，,、；;：:]")
#: The rules after a quotation and a bracket that end with a mark: before them stands the sentence so far, without what they hold.
CLOSED_QUOTE = [_GOES_ON, _rule("introduced quotation", True, r"[：:，,]\s*", ""), _rule("quotation within", False, "", "")]
CLOSED_BRACKET = [_GOES_ON, _rule("bracket that is a sentence", True, r"^\s*", ""), _rule("bracket within", False, "", "")]
#: The rules at the spaces beside Thai letters.
THAI_SPACE = [_rule("after Thai", True, r"\p{Thai}[^\p{Thai}]*", ""), _rule("before Thai only", False, "", "")]

_PARAGRAPH_GAP = regex.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
#: Every run of stops; the number rule, which decides most positions, is applied on the way.
_CANDIDATE = regex.compile(rf"(?:(?!(?<=\d)[.．]\d)[{regex.escape(STOPS + ELLIPSIS)}])+", regex.V1)
_TAIL = regex.compile(rf"[{regex.escape(CLOSERS)}]*(?:\[\d{{1,4}}(?:\s*[,，\-–]\s*\d{{1,4}})*\])*", regex.V1)
_MARKS = regex.compile("[" + regex.escape("".join(PAIRS) + "".join(PAIRS.values()) + '"') + "]", regex.V1)
_CITATION = regex.compile(r"\[\d{1,4}(?:\s*[,，\-–]\s*\d{1,4})*\]")
_THAI = regex.compile(r"\p{Thai}")
_THAI_SPACE = regex.compile(r"(?<=\p{Thai}[^\s\p{L}]*)[^\S\n]+(?=\S)|[^\S\n]+(?=\p{Thai})")
# Words (and letters) by which a paragraph's language is told.
_ENGLISH = regex.compile(r"\b(?:the|of|and|to|in|is|was|for|on|The|A|by|said|with)\b")
LANGUAGES = {
    "german": regex.compile(r"[äöüßÄÖÜ]\w*|\b(?:der|die|das|und|wurden?|für|laut|nicht|mit|von|ein|eine|ist|Der|Die|Das|Am|Einige|Wir)\b"),
    "french": regex.compile(r"\b(?:les|des|est|une|dans|pour|qui|que|sur|avec|sont|été|aux|du|Les|Le|La|Une|et)\b"),
    "spanish": regex.compile(r"\b(?:los|las|una|por|con|para|del|que|más|fue|se|El|Los|Las|Una|y)\b"),
    "italian": regex.compile(r"\b(?:gli|della|delle|dei|degli|che|per|con|sono|una|nel|nella|è|Il|Gli|La|di)\b"),
    "portuguese": regex.compile(r"\b(?:os|uma|dos|das|não|com|para|foi|pelo|pela|são|ao|O|Os|Uma|em|do|da)\b"),
    "russian": regex.compile(r"\b(?:и|в|на|не|что|с|по|для|из|от|за|к|был|была|это)\b"),
}
_ENDED = regex.compile(rf"[{regex.escape(STOPS)}][{regex.escape(CLOSERS)}]*(?:\[\d{{1,4}}\])*\s*$", regex.V1)


def language(paragraph: str, languages: dict[str, regex.Pattern] | None = None) -> str:
    """Which cascade a paragraph takes: the language with most of its words, if more than English has; German wins ties."""
    known = LANGUAGES if languages is None else languages
    words = {name: sum(1 for _ in pattern.finditer(paragraph)) for name, pattern in known.items()} if _WESTERN.search(paragraph) else {}
    best = max(words, key=lambda x: words[x], default="other")
    # a word or two of a Romance language may be names
    return best if words and words[best] > (0 if best == "german" else 2) and words[best] > len(_ENGLISH.findall(paragraph)) else "other"


_WESTERN = regex.compile(r"\p{Latin}{2}|\p{Cyrillic}")
_CLOSES: dict[str, list[str]] = {}
for _opener, _closers in PAIRS.items():
    for _closer in _closers:
        _CLOSES.setdefault(_closer, []).append(_opener)
_CLOSES['"'] = ['"']


def protected_spans(text: str) -> list[tuple[int, int]]:
    """Outermost (start, end) of paired marks; unpaired marks protect nothing."""
    stack: list[tuple[str, int]] = []
    depths: dict[str, list[int]] = {}  # where in the stack each opener stands
    spans: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text):
        c, i = m[0], m.start()
        if c == "[" and _CITATION.match(text, i):
            continue
        if c in "‘’" and i and text[i - 1].isalpha() and i + 1 < len(text) and text[i + 1].isalpha():
            continue  # an apostrophe
        depth = max((depths[o][-1] for o in _CLOSES.get(c, ()) if depths.get(o)), default=-1)
        if depth >= 0:
            start = stack[depth][1]
            while len(stack) > depth:
                depths[stack.pop()[0]].pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, i + 1))
        elif c in PAIRS or c == '"':
            depths.setdefault(c, []).append(len(stack))
            stack.append((c, i))
    return spans


def _decide(rules: list[Rule], sentence: str, text: str, at: int) -> bool:
    """The first rule that matches the sentence so far, backwards from its end, and the text from the offset on."""
    for rule in rules:
        if rule.before.match(sentence) and rule.after.match(text, at):
            return rule.breaks
    return False


#: How much of what follows a citation without a space the rules see, as if a space came first; no rule looks further than a word.
BEYOND = 200


def _paragraph_ends(text: str) -> list[int]:
    """Offsets after each sentence of one paragraph; the last is the paragraph's end."""
    rules = CASCADES[language(text)]
    spans = protected_spans(text)
    candidates: list[tuple[int, str]] = [(m.start(), "stop") for m in _CANDIDATE.finditer(text)]
    if _THAI.search(text):
        candidates += [(m.start(), "space") for m in _THAI_SPACE.finditer(text)]
    inside, k = [], 0
    kept = []
    candidates.sort()
    for at, kind in candidates:
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        (inside if k < len(spans) and spans[k][0] < at else kept).append((at, kind))
    # a paired mark whose content ends with a stop is a candidate of its own
    stops_inside = [at for at, kind in inside if kind == "stop"]
    for opened, shut in spans:
        if text[opened] in TITLES:
            continue
        k = bisect_left(stops_inside, opened)
        if k < len(stops_inside) and stops_inside[k] < shut and _ENDED.search(text, opened + 1, shut - 1):
            kept.append((shut, f"closed {opened}"))
    begins = [a for a, _ in spans]
    ends, start = [], 0
    for at, kind in sorted(kept):
        if at < start:
            continue
        if kind == "space":
            if _decide(THAI_SPACE, text[start:at], text, at):
                ends.append(at)
                start = at
            continue
        if kind == "stop":
            run = _CANDIDATE.match(text, at)
            if run is None:
                continue
            mark_end = run.end()
            if run[0].strip(ELLIPSIS + ".") == "" and len(run[0]) > 1 and (run[0].count(".") != 1 or run[0][0] in ELLIPSIS):
                continue
            end = _TAIL.match(text, mark_end).end()
            k = bisect_left(begins, mark_end)
            if k < len(begins) and begins[k] < end:
                end = mark_end
            tried = rules if run[0][-1] in ".．" else OTHER_MARKS
            sentence = text[start:mark_end]
            breaks = _decide(tried, sentence, text, end)
            if not breaks and end > mark_end and run[0] == ".":
                # marks that follow a stop stand for the space after it
                space = end < len(text) and text[end].isspace()
                breaks = _decide(tried, sentence, text, end) if space else _decide(tried, sentence, " " + text[end : end + BEYOND], 0)
            if breaks:
                ends.append(end)
                start = end
            continue
        opened = int(kind.split(" ")[1])
        end = _TAIL.match(text, at).end()
        if _decide(CLOSED_QUOTE if text[opened] in QUOTES else CLOSED_BRACKET, text[start:opened], text, end):
            ends.append(end)
            start = end
    if text[start:].strip():
        ends.append(len(text))
    return ends


def sentence_ends(text: str | None) -> list[int]:
    """Offset just after the last non-space character of each sentence, in order."""
    if not text:
        return []
    out, at = [], 0
    gaps = [(m.start(), m.end()) for m in _PARAGRAPH_GAP.finditer(text)] + [(len(text), len(text))]
    for gap_start, gap_end in gaps:
        paragraph, begin = text[at:gap_start], 0
        if paragraph.strip():
            for end in _paragraph_ends(paragraph):
                body = paragraph[begin:end].rstrip()
                if body.strip():
                    out.append(at + begin + len(body))
                begin = end
        at = gap_end
    return out


def _segmented(documents: DataFrame, with_text: bool) -> DataFrame:
    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                begin = 0
                for n, end in enumerate(sentence_ends(text)):
                    piece = text[begin:end].lstrip()
                    rows.append((doc_id, n, end - len(piece), end, piece if with_text else None))
                    begin = end
            yield pd.DataFrame(rows, columns=["doc_id", "sentence", "sent_start", "sent_end", "text"])

    return documents.mapInPandas(segment, "doc_id bigint, sentence int, sent_start int, sent_end int, text string")


def sentence_bounds(documents: DataFrame) -> DataFrame:
    """doc_id, sentence, sent_start, sent_end of every sentence; documents(doc_id, text).
    Repeated rows are told by their bounds, so that no text is shuffled."""
    rows = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return _segmented(rows, False).drop("text").distinct()


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, sentence, sent_start, sent_end, text: each sentence in order, line wraps as they are."""
    return _segmented(documents.select("doc_id", "text").filter("doc_id is not null and text is not null").distinct(), True)
