"""Scalar text functions as column expressions; all stay inside generated code.

Null in, null out, unless stated otherwise.  Lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelled out, since the default classes of regular expressions differ between engines.
WS = r"[\t-\r\x1C-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Title and heading patterns, and the words of the retrieval rules.
PART = r"^第[一二三四五六七八九十百]+[节章部分]"
HAN_NUMBER = r"^[一二三四五六七八九十]+、"
BRACKET_NUMBER = r"^[（(][一二三四五六七八九十]+[)）]"
DIGIT_NUMBER = rf"^\p{{Nd}}{{1,2}}{WS}*[、.．]"
NO_HEADING_END = r"[。；，：,;]$"
NO_HEADING_START = r"^[，。、；：）」』】,;)]"
CHECK_BOXES = r"^[√□适用不 \x{3000}]*$"
DEFAULT_PATH = "（正文前部）"
BAD_TITLE_WORDS = "摘要|英文|取消|延期|暂停"
SEMI_WORDS = "半年|中期|中报|上半|H1|半期"
PANORAMA_WORDS = "样本公司|各公司|哪家|哪些|排名|最高|最低|对比|比较"
ATTRIBUTION_WORDS = "归母|归属于上市公司|归属于母公司"
ATTRIBUTION_TEXT = "归属于上市公司股东的净利润"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_text(c: Column) -> Column:
    """Runs of spaces become one, runs of line feeds become one, ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t\x{a0}]+", " "), r"\n{2,}", "\n"))


def detect_level(c: Column) -> Column:
    """Heading level 2 to 5 of an untagged block, or null."""
    t = strip(c)
    n = F.char_length(t)
    return (
        F.when((n == 0) | (n > 60) | t.rlike(NO_HEADING_END), None)
        .when(t.rlike(PART), 2)
        .when(t.rlike(HAN_NUMBER), 3)
        .when(t.rlike(BRACKET_NUMBER) & (n <= 40), 4)
        .when(t.rlike(DIGIT_NUMBER) & (n <= 30) & ~t.rlike("[。，]"), 5)
        .cast("int")
    )


def remap_level(c: Column) -> Column:
    """Level 2 to 4 of a tagged title by its pattern, or null."""
    return F.when(c.rlike(PART), 2).when(c.rlike(HAN_NUMBER), 3).when(c.rlike(BRACKET_NUMBER) | c.rlike(DIGIT_NUMBER), 4).cast("int")


def heading_sane(c: Column) -> Column:
    """False for fragments of sentences, long clauses and check boxes; null counts as false."""
    ok = (F.char_length(c) > 0) & ~c.contains("。") & ~c.rlike(NO_HEADING_START) & ~(c.contains("，") & (F.char_length(c) > 16)) & ~c.rlike(CHECK_BOXES)
    return F.coalesce(ok, F.lit(False))


def title_text(c: Column) -> Column:
    """A short title in one line."""
    return F.when(F.char_length(c) <= 40, F.replace(c, F.lit("\n"), F.lit(""))).otherwise(c)


def table_text(html: Column) -> Column:
    """Rows of an HTML table, cells joined by bars; null and tableless give an empty text."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda x: strip(F.replace(F.regexp_replace(x, "<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" ")))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), cell))
    return F.array_join(F.transform(F.filter(cells, lambda r: F.size(r) > 0), lambda r: F.array_join(r, " | ")), "\n")


def strip_tags(html: Column) -> Column:
    return strip(F.regexp_replace(html, "<[^>]+>", ""))


def strip_emphasis(title: Column) -> Column:
    """Without <em> marks; null gives an empty title."""
    return strip(F.regexp_replace(F.coalesce(title, F.lit("")), "</?em>", ""))


def period_label(report_type: Column, year: Column) -> Column:
    return F.concat(year, F.when(report_type == "annual", "年年度报告").otherwise("年半年度报告"))


def doc_key(code: Column, report_type: Column, year: Column) -> Column:
    return F.concat_ws("_", code, year, report_type)


def human_size(n: Column) -> Column:
    """Bytes in steps of 1024 with one decimal place."""
    value, out = n.cast("double"), None
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        scaled = F.format_string(f"%.1f{unit}", value / F.lit(1024.0**i))
        test = value < F.lit(1024.0 ** (i + 1))
        out = F.when(test, scaled) if out is None else out.otherwise(scaled) if unit == "TB" else out.when(test, scaled)
    return F.when(n.isNotNull(), out)


def epoch_date(ms: Column) -> Column:
    """Epoch milliseconds as a date text in the session's time zone; null gives an empty text."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), F.lit(""))


def full_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base), F.regexp_replace(F.coalesce(path, F.lit("")), "^/+", ""))


def document_text(company: Column, label: Column, section: Column, text: Column, limit: int | None = 1600) -> Column:
    """The text given to an embedder, headed by its origin; nulls count as empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    whole = F.concat(e(company), F.lit("《"), e(label), F.lit("》"), e(section), F.lit("\n"), e(text))
    return whole if limit is None else F.substring(whole, 1, limit)


def keyword_context(text: Column, word: str, before: int = 120, after: int = 220) -> Column:
    """The text around the first hit, line feeds shown; null without a hit."""
    at = F.instr(text, word)
    start = F.greatest(at - before, F.lit(1))
    snippet = text.substr(start, at - start + F.lit(after))
    return F.when(at > 0, F.replace(snippet, F.lit("\n"), F.lit(" ⏎ ")))


#: A character of a word, as a class.
WORD = r"[\p{L}\p{N}&&[^\p{IsHan}]]"


def lowered(c: Column) -> Column:
    """What tokens are taken from."""
    return F.lower(F.coalesce(c, F.lit("")))


def tokens(c: Column) -> Column:
    """Words of letters and digits in lower case; runs of Han characters as overlapping pairs."""
    low = lowered(c)
    words = F.regexp_extract_all(low, F.lit(f"({WORD}+)"), F.lit(1))
    # overlapping pairs by looking ahead; a Han character alone is a token of its own
    pairs = F.regexp_extract_all(low, F.lit(r"(?=(\p{IsHan}{2}))"), F.lit(1))
    # no looking behind, which sees half a character beyond U+FFFF only
    alone = F.regexp_extract_all(low, F.lit(r"(?:^|\P{IsHan})(\p{IsHan})(?!\p{IsHan})"), F.lit(1))
    return F.concat(words, pairs, alone)
