"""Per-document text quality statistics, and what kind of text a document is.

Method: tables and lists show in the layout: delimiters that line up from line to line,
markers and indents that repeat, line lengths that resemble their neighbours'
(autocorrelation).  Lines that end like sentences and lines of odd symbols are settled by
their own ratios of words, symbols and punctuation.  The runs of lines between them are
settled by the layout: delimiters that align over neighbouring lines make rows of a table,
unless a repeated marker shows two-part entries of a list; lengths and figures that repeat
every few lines make the records of a table with one cell per line; other short lines are
the entries of a list if enough of them stand together or share a marker.  The kinds are
weighed by their characters.

Defined results: null and blank texts have zero counts, null ratios and kind null; texts
are read whole; repeated rows give one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the characters that must not be what the type says.
CONTRADICTION = 0.6
#: A list entry has at most this many characters, and a list at least so many entries in a row.
ENTRY_CHARS, LIST_ENTRIES = 48, 3
#: Lines without figures are rows if at least so many in a row have aligned cells.
ALIGNED_ROWS = 3
#: Lines of a record with one cell per line, at most; as many records show a table; least autocorrelation at that lag.
MOST_CELLS, RECORDS, PERIODIC = 8, 3, 0.3

# Frequent words of running text; parts of characters that don't occur as words; Windows-1252 characters of wrongly decoded bytes.
COMMON_WORDS = {
    "zh": "的 了 在 和 与 为 是 对 将 其中 以 并 但 随之 分别 较 受 因 及 或 等 有 中 上 下 已",
    "en": "the of and to in a is was for on that with by from as at said may while because which are were",
    "de": "der die das und in von zu mit den im für ist auf ein eine wurden wegen unter sagte laut",
    "ja": "は の に を が で と も です ます した により",
}
COMPONENTS = "丨丿乚亠亍冂凵冫匚卩厶囗彐丬犭疒癶罒虍艹讠钅飠龸⺮⺷⺼宀廾彡攵爫礻糹纟罓耂衤覀辶阝忄扌氵灬牜"
MISDECODED = "€‚ƒ„†‡ˆ‰Š‹ŒŽ‘’•–—˜™š›œžŸ\ufffd"

_WORD = regex.compile(r"\p{Han}|[\p{L}\p{N}]+")
_STOP_END = regex.compile(r"[。．.！!？?；;：:…][”’」』）)》\"'\]】]*(?:\[\d+\])*\s*$")
_STOP_IN = regex.compile(r"[。！？]|[.!?．](?=\s|$)")
_CLAUSE = regex.compile(r"[，；]|(?<=\p{L}),\s(?=\p{L})")
_NUMERIC_CELL = regex.compile(r"^[\s(（+-]*[¥$€￥]?\s*[\d０-９][\d０-９,，.．\s]*\s*[%％‰)）]?$|^[-—–/]+$|^(?:19|20)\d\d\s*年?(?:度|末|上半年)?$")
_MARKER = regex.compile(
    r"^\s*(?:[-–—•·*●○■□▪◆◇►‣⁃+>✓√]|[（(]\s*(?:\d{1,3}|[a-zA-Z]|[ivxIVX]+|[一二三四五六七八九十]+)\s*[)）]|\d{1,3}\s*[.)、．）]|[一二三四五六七八九十]{1,3}\s*[、.]|[a-zA-Z][.)]|[①-⑳㈠-㈩⑴-⒇❶-❿➀-➉])\s*"
)
_LEADER = regex.compile(r"(?:[.．·…_\-]\s?){6,}")
_BLOB = regex.compile(r"[A-Za-z0-9+/=_-]{40,}")
_TAG = regex.compile(r"</?[a-zA-Z][^<>]*>")
_BARS = re.compile(r"\S\s*\|\s*\S")
_NOT_WORD, _DIGIT = re.compile(r"[\W_]"), re.compile(r"\d")
_BOX = re.compile("[□■☐☑☒√✓●○※№]")
#: Characters that running text rarely has, for a quick look at lines that end like sentences.
_ODD = re.compile(rf"[^\w\s，。、；：？！“”‘’（）《》「」『』…—,.;:?!'\"()%％·$€¥&/\-\[\]]|[À-ÿ{MISDECODED}{COMPONENTS}]")
_CELL_TAG = regex.compile(r"</?t[drh][^<>]*>", regex.I)
_SPLITTERS = [("\t", regex.compile(r"\t+")), ("|", regex.compile(r"\s*[|｜│¦]\s*")), ("gap", regex.compile(r"\s{2,}|\u3000+")), (";", regex.compile(r"\s*[;；]\s*")), ("/", regex.compile(r"\s+/\s+")), (",", regex.compile(r",\s+|，\s*|,(?!\d{3}(?!\d))")), ("、", regex.compile("、")), ("space", regex.compile(r"\s+")), (":", regex.compile(r"\s*[:：=]\s*"))]


@lru_cache(4096)  # a line is looked at as a row, for its kind and for the alignment
def cells(line: str) -> tuple[str, list[str]]:
    """The delimiter that gives the line most cells of figures, and the cells; ('', [line]) if none does."""
    if _CELL_TAG.search(line):
        return "html", [c.strip() for c in _TAG.split(line) if c.strip()]
    best = ("", [line.strip()])
    score = 0.0
    for name, splitter in _SPLITTERS:
        parts = [p.strip() for p in splitter.split(line.strip()) if p.strip()]
        if len(parts) < 2:
            continue
        figures = sum(bool(_NUMERIC_CELL.match(p)) for p in parts)
        value = figures / len(parts) * min(figures, 3)
        if value > score or name in "\t|" and not score:
            best, score = (name, parts), max(value, score)
    return best


#: What holds cells of words apart: name, pattern, least cells of a row, most characters of a cell.  A single space does so between Han words only.
_COLUMNS = [
    ("gap", regex.compile(r"\s{2,}|\u3000+|\t+"), 2, ENTRY_CHARS), ("/", regex.compile(r"\s+[/／]\s+|／"), 2, ENTRY_CHARS), (";", regex.compile(r"\s*[;；]\s*"), 2, ENTRY_CHARS),
    (",", regex.compile(r",(?!\s|\d{3}(?!\d))"), 3, ENTRY_CHARS), (", ", regex.compile(r",\s+"), 3, 16), ("space", regex.compile(r" (?=\p{Han})(?<=\p{Han} )"), 3, 16),
]
_ORDINAL = regex.compile(r"^(?:第\s*[\d一二三四五六七八九十百]+\s*[章节条部篇]|(?i:chapter|section|article|part|kapitel|abschnitt)\s+[\dIVX]+)")
_SENTENCE_MARK = regex.compile(r"[。！？]")


@lru_cache(4096)
def columns(line: str) -> dict[str, tuple[int, ...]]:
    """The delimiters that divide the line into cells of words or figures, each with the offsets (full-width characters count twice) where its cells begin."""
    body = line.strip().rstrip(";；")
    if _SENTENCE_MARK.search(body):
        return {}
    found = {}
    for name, splitter, least, most in _COLUMNS:
        cuts = [m.span() for m in splitter.finditer(body)]
        if len(cuts) + 1 < least:
            continue
        begins, ends = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(body)]
        parts = [body[a:b] for a, b in zip(begins, ends)]
        if any(len(x) > most or _CLAUSE.search(x) for x in parts) or sum(map(bool, parts)) < 2 or (body[-1] in ".!?．" and parts[-1].count(" ") > 2):
            continue
        wide = [0]
        for c in line[: len(line) - len(line.lstrip())] + body:
            wide.append(wide[-1] + 1 + (unicodedata.east_asian_width(c) in "WF"))
        indent = len(line) - len(line.lstrip())
        found[name] = tuple(wide[indent + a] for a in begins)
    return found


def aligned(a: str, b: str) -> frozenset[str]:
    """The delimiters by which two lines have as many cells, or cells at the same offsets where one lacks some."""
    x, y = columns(a), columns(b)
    return frozenset(d for d in x.keys() & y.keys() if len(x[d]) == len(y[d]) or d == "gap" and (set(x[d]) <= set(y[d]) or set(y[d]) <= set(x[d])))


def is_row(line: str) -> bool:
    """A label and figures, or figures alone, or cells between bars or tags."""
    delimiter, parts = cells(line)
    if delimiter in ("|", "\t", "html") and len(parts) >= 2 and (delimiter != "|" or line.count("|") + line.count("｜") + line.count("│") < len(line) / 3):
        return True
    figures = sum(bool(_NUMERIC_CELL.match(p)) for p in parts)
    words = sum(1 for p in parts if not _NUMERIC_CELL.match(p))
    if delimiter == "space":
        return figures >= 2 and figures >= words and not _STOP_END.search(line.rstrip("%％"))
    return figures >= 1 and len(parts) >= 2 and figures >= words and not regex.search(r"[。！？]", line)


def is_junk(line: str) -> bool:
    """Unreadable or without content: leaders, encoded blobs, wrongly decoded bytes, loose symbols."""
    dense = "".join(line.split())
    n = len(dense)
    boxes = len(_BOX.findall(dense))
    if boxes >= 3 and boxes >= 0.08 * n:
        return True
    if n < 4:
        return n > 0 and not any(c.isalnum() for c in dense)
    leader = sum(len(m[0]) for m in _LEADER.finditer(line))
    if leader >= 0.3 * len(line):
        return True
    blob = 0
    for m in _BLOB.finditer(line):
        t = m[0]
        kinds = any(c.islower() for c in t) + any(c.isupper() for c in t) + any(c.isdigit() for c in t)
        if kinds >= 3 or (kinds == 2 and len(t) >= 60):
            blob += len(t)
    if blob >= 0.5 * n:
        return True
    odd = symbols = loose = 0
    for c in dense:
        o = ord(c)
        if 0x80 <= o <= 0xFF and c not in "©®°·×÷±§éèêëàâäáãåçïîíìñóòôöõøúùûüýßÉÈÊÀÂÄÁÅÇÎÍÑÓÔÖÜÚØæÆ«»²³µ¥£" or c in MISDECODED:
            odd += 1
        elif 0xC0 <= o <= 0xFF:
            loose += 1
        if c in COMPONENTS:
            symbols += 1
        elif not c.isalnum() and unicodedata.category(c) in ("Sm", "Sk", "So", "Sc", "Pc") or c in "\\#*`^~/_=+<>@&{}§¤¬¦":
            symbols += 1
    if (odd >= 0.1 * n and odd + loose >= 0.25 * n) or odd + loose >= 0.5 * n:
        return True
    if symbols >= 0.3 * n and not _CELL_TAG.search(line):
        return True
    letters = sum(c.isalnum() for c in dense)
    return letters < 0.35 * n and not is_row(line)


def plainly_prose(line: str) -> bool:
    """Ends like a sentence, has words or clauses enough and hardly an odd character."""
    s = line.rstrip()
    if s[-1:] == "]":
        s = regex.sub(r"(?:\[\d+\])+$", "", s)
    if s[-1:] not in "。．.！!？?" or "\t" in s or "|" in s or "<" in s or ".." in s:
        return False
    return ("，" in s or "、" in s or s.count(" ") >= 4) and len(_ODD.findall(s)) <= 0.05 * len(s) and not _BLOB.search(s)


def line_kinds(text: str) -> list[tuple[str, int]]:
    """(kind, characters without white space) of each line that isn't blank; kinds prose, list, table, junk."""
    lines = [line for line in text.split("\n") if line.strip()]
    kinds: list[str] = []
    sentence: list[bool] = []
    for line in lines:
        sentence.append(plainly_prose(line))
        if sentence[-1]:
            kinds.append("prose")
            continue
        body = _MARKER.sub("", line).strip()
        if is_junk(line):
            kinds.append("junk")
        elif is_row(body):
            kinds.append("table")
        else:
            short = len(body) <= ENTRY_CHARS and not _STOP_IN.search(body) and not _CLAUSE.search(body) and not body.endswith(("；", ";"))
            kinds.append("entry" if short else "prose")
    # lines whose cells are aligned are rows, unless they are entries of two parts behind a shared marker
    i = 0
    while i < len(kinds):
        j, shared = i + 1, None
        while kinds[i] != "junk" and j < len(kinds) and kinds[j] != "junk" and not sentence[i] and not sentence[j]:
            both = aligned(lines[j - 1], lines[j])
            if not (both if shared is None else both & shared):
                break
            shared, j = both if shared is None else both & shared, j + 1
        heads = ["- " if _ORDINAL.match(x.strip()) else x.strip() for x in lines[i:j]]
        if j - i >= ALIGNED_ROWS and (any(len(columns(lines[i])[d]) > 2 for d in shared) or marker_periodicity(heads) < 0.5):
            kinds[i:j] = ["table"] * (j - i)
            i = j
        else:
            i = max(i + 1, j - 1)
    # entries are the cells of records, or make a list if enough of them stand in a row, or if they share a marker
    i = 0
    while i < len(kinds):
        if kinds[i] != "entry":
            i += 1
            continue
        j = i
        while j < len(kinds) and kinds[j] == "entry":
            j += 1
        listed = j - i >= LIST_ENTRIES or marker_periodicity(lines[i:j]) * (j - i) >= 2
        kinds[i:j] = ["table" if listed and record_length(lines[i:j]) else "list" if listed else "prose"] * (j - i)
        i = j
    return [(kind, len("".join(line.split()))) for kind, line in zip(kinds, lines)]


def delimiter_alignment(lines: list[str]) -> float:
    """Share of neighbouring lines that have the same delimiter and nearly as many cells, or aligned cells of words."""
    if len(lines) < 2:
        return 0.0
    shape = []
    for line in lines:
        prose = plainly_prose(line)
        delimiter, parts = ("", [line]) if prose else cells(line)
        shape.append((delimiter, len(parts), prose, line))
    return sum((a[0] == b[0] != "" and abs(a[1] - b[1]) <= 2) or (not a[2] and not b[2] and bool(aligned(a[3], b[3]))) for a, b in zip(shape, shape[1:])) / (len(lines) - 1)


def marker_periodicity(lines: list[str]) -> float:
    """Share of lines that begin with the most frequent kind of indent or marker, if that is one."""
    heads = Counter()
    for line in lines:
        m = _MARKER.match(line)
        indent = len(line) - len(line.lstrip())
        if m or indent:
            heads[regex.sub(r"[\p{N}\p{L}]+", "1", m[0].strip()) if m else f"indent {indent}"] += 1
    return max(heads.values()) / len(lines) if heads else 0.0


def length_autocorrelation(lines: list[str], lag: int = 1) -> float:
    """Autocorrelation of the line lengths at a lag; 1 for equal lengths, 0 for fewer than lag + 2 lines."""
    if len(lines) < lag + 2:
        return 0.0
    x = np.array([len(line) for line in lines], dtype=float)
    x -= x.mean()
    return float((x[lag:] * x[:-lag]).sum() / (x * x).sum()) if (x * x).sum() else 1.0


def record_length(lines: list[str]) -> int:
    """The number of lines after which a record of cells begins anew, each cell on its own line; 0 if there are no records.

    Cells of figures stand at the same places of every record, others at the rest, and the
    lengths correlate at that lag (records of equal lengths throughout do so trivially).
    """
    figures = [bool(_NUMERIC_CELL.match(line.strip())) for line in lines]
    if not any(figures) or all(figures):
        return 0
    for lag in range(2, min(MOST_CELLS, len(lines) // RECORDS) + 1):
        if all(a == b for a, b in zip(figures, figures[lag:])) and length_autocorrelation(lines, lag) >= PERIODIC * (1 - lag / len(lines)):
            return lag
    return 0


_COMMON = {w for words in COMMON_WORDS.values() for w in words.split()}

STATS = {
    "chars": "int", "n_lines": "int", "words": "int", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double",
    "punctuated_lines": "double", "common_words": "double", "delimiter_alignment": "double", "marker_periodicity": "double",
    "length_autocorrelation": "double", "prose_share": "double", "list_share": "double", "table_share": "double", "junk_share": "double", "kind": "string",
}


def shares(text: str | None) -> dict[str, float]:
    """Share of the characters in lines of each kind; aligned lines are rows of a table, none is a list."""
    weights = dict.fromkeys(("prose", "list", "table", "junk"), 0)
    if text:
        for kind, n in line_kinds(text):
            weights[kind] += n
    total = sum(weights.values())
    return {k: n / total for k, n in weights.items()} if total else {}


def statistics(text: str | None) -> tuple:
    """The values of STATS for one text."""
    lines = [line for line in (text or "").split("\n") if line.strip()]
    if not lines:
        return (len(text or ""), 0, 0, *[None] * (len(STATS) - 3))
    dense = "".join(text.split())
    words = _WORD.findall(text)
    n = len(dense)
    share = shares(text)
    return (
        len(text), len(lines), len(words), sum(map(len, words)) / len(words) if words else 0.0,
        len(_NOT_WORD.findall(dense)) / n, len(_DIGIT.findall(dense)) / n,
        sum(bool(_STOP_END.search(line)) for line in lines) / len(lines), sum(w.lower() in _COMMON for w in words) / len(words) if words else 0.0,
        delimiter_alignment(lines), marker_periodicity(lines), length_autocorrelation(lines),
        share["prose"], share["list"], share["table"], share["junk"], max(share, key=lambda k: share[k]),
    )


def agrees_at_a_glance(type_: str | None, text: str | None, limit: float) -> bool:
    """True if lines that need no closer look already settle that the type is right."""
    total = agreeing = 0
    for line in (text or "").split("\n"):
        n = len("".join(line.split()))
        total += n
        if n and (plainly_prose(line) if type_ == "text" else type_ == "table" and _BARS.search(line) and len(_ODD.findall(line)) <= 0.2 * n):
            agreeing += n
    return agreeing > (1 - limit) * total


def contradiction(type_: str | None, text: str | None, limit: float = CONTRADICTION) -> str | None:
    """What the text is, if at least `limit` of it isn't what the type says; else null."""
    if agrees_at_a_glance(type_, text, limit):
        return None
    share = shares(text)
    if not share:
        return None
    if type_ == "table":
        return "prose" if share["prose"] >= limit else None
    if type_ == "text" and 1 - share["prose"] >= limit:
        return max(("list", "table", "junk"), key=lambda k: share[k])
    return None


def quality_statistics(docs: DataFrame) -> DataFrame:
    """docs(key, text) -> key and STATS."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([statistics(t) for t in pdf["text"]], columns=list(STATS))
            out.insert(0, "key", pdf["key"].to_numpy())
            yield out.astype({c: "Int32" for c, t in STATS.items() if t == "int"})

    return docs.select("key", "text").mapInPandas(measure, "key string, " + ", ".join(f"{c} {t}" for c, t in STATS.items())).distinct()


def mislabelled(docs: DataFrame, limit: float = CONTRADICTION) -> DataFrame:
    """docs(key, type, text) -> key, kind of those whose type contradicts their text."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [contradiction(t, x, limit) for t, x in zip(pdf["type"], pdf["text"])]
            yield pdf[["key"]].assign(kind=kinds)[[k is not None for k in kinds]]

    rows = docs.select("key", "type", "text").filter("key is not null and text is not null and type in ('text', 'table')")
    return rows.mapInPandas(judge, "key string, kind string").filter(F.col("kind").isNotNull()).distinct()
