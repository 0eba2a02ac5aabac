"""Text that looks alike but is stored with different characters.

Method: script-aware repair.  Every token of a suspicious value is given its
dominant script; look-alike letters are substituted only in tokens that mix
scripts, and only if the result is a word of the corpus.  Full-width letters,
invisible characters, foreign spaces and stand-ins for Han characters are
rewritten directly, and letters and marks of every script are composed.

A value is disguised if the repair finds something of these in it.  A mixed token
whose readings are no corpus words stays as it is, and its value is still disguised.
Composing marks of other scripts than Latin gives the one form, but is no disguise.

Defined results: null and empty texts are no cases and pass unchanged; a value
of any length is read whole; a null key is a key like others; repeated rows give one row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import broadcast_if_small, materialize

# Greek and Cyrillic letters and the Latin letters they look like.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "υ": "u", "χ": "x", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "в": "b", "е": "e",
    "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s",
    "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "γ": "y", "ε": "e", "η": "n", "τ": "t",
}
TO_LATIN = str.maketrans(LOOKALIKES)
#: Of several foreign letters for one Latin letter the first listed in each script is used.
TO_FOREIGN = {
    script: {latin: foreign for foreign, latin in reversed(LOOKALIKES.items()) if script in unicodedata.name(foreign)}
    for script in ("GREEK", "CYRILLIC")
}

# Radical signs without a decomposition of their own and the Han characters they stand for.
RADICAL_SUPPLEMENT = dict(zip(
    "⺀⺁⺂⺃⺄⺅⺇⺈⺉⺊⺋⺌⺍⺎⺏⺐⺑⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺨⺩⺫⺬⺭⺮⺯⺰⺱⺲⺳⺹⺺⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
    "冫厂乛乚乙亻几刀刂卜卩小小兀尣尢尣巳幺彑彐忄心扌攵旡日月歺民氵水灬爪爫丬犭王目示礻竹糹纟罓罒网耂肀月臼艹艹艹虎衤覀西见角角讠贝足车辶辶辶阝钅長镸长门阜阝雨青韦页风飞食食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
))


def _han_standins() -> dict[str, str]:
    """Characters whose (canonical or plain compatibility) decomposition is one other Han character."""
    found = dict(RADICAL_SUPPLEMENT)
    for block in ((0x2E80, 0x2FDF), (0x3005, 0x303B), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)):
        for code in range(block[0], block[1] + 1):
            c = chr(code)
            if unicodedata.decomposition(c).split(" ")[0] not in ("", "<compat>") or unicodedata.decomposition(c).startswith("<compat>"):
                plain = unicodedata.normalize("NFKC", c)
                if plain != c and len(plain) == 1 and unicodedata.name(plain, "").startswith("CJK UNIFIED"):
                    found[c] = plain
    return found


HAN_STANDINS = _han_standins()


def _ranges(chars: list[str], show) -> str:
    codes, parts = sorted(map(ord, chars)), []
    start = last = codes[0]
    for c in [*codes[1:], -1]:
        if c != last + 1:
            parts.append(show(start) if start == last else f"{show(start)}-{show(last)}")
            start = c
        last = c
    return "".join(parts)


HAN_CLASS_JAVA = _ranges(list(HAN_STANDINS), lambda c: f"\\x{{{c:x}}}")
SPACES_JAVA = r"[\p{Z}\x0B\f\r\x1C-\x1F\x85&&[^ ]]"
FOREIGN_JAVA = r"[[\p{IsGreek}\p{IsCyrillic}]&&\p{L}]"
#: One linear pattern for the scan inside the JVM; Python only sees the values that match.
SUSPICIOUS = (
    rf"[Ａ-Ｚａ-ｚ０-９\p{{Cf}}{HAN_CLASS_JAVA}]|{SPACES_JAVA}|\p{{IsLatin}}\p{{M}}"
    rf"|{FOREIGN_JAVA}\p{{IsLatin}}|\p{{IsLatin}}{FOREIGN_JAVA}"
)

#: Values that composing may change: marks but those of Thai, conjoining Hangul, letters with a canonical twin.
COMPOSABLE = r"[\p{M}&&[^\x{E31}-\x{E4E}]]|[\x{1100}-\x{11FF}]|[\x{2126}\x{212A}\x{212B}]"
#: Readings, and substitutions, that are broadcast; more are joined by shuffle.
MOST_READINGS = 500_000

_MIXED = regex.compile(r"[\p{Greek}\p{Cyrillic}&&\p{L}]\p{Latin}|\p{Latin}[\p{Greek}\p{Cyrillic}&&\p{L}]", regex.V1)
_LATIN_RUN = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}&&\p{L}][\p{Latin}\p{Greek}\p{Cyrillic}\p{M}]*", regex.V1)
_SPACE = regex.compile(r"[\p{Z}\x0b\f\r\x1c-\x1f\x85--[ ]]", regex.V1)
_CF = regex.compile(r"\p{Cf}")
_FULL = regex.compile("[Ａ-Ｚａ-ｚ０-９]")
_COMBINED = regex.compile(r"\p{Latin}\p{M}+")
_HAN = regex.compile("[" + "".join(map(regex.escape, HAN_STANDINS)) + "]")


def suspicious(text: Column) -> Column:
    """True where the value may hold a disguised character; null texts give false."""
    return F.coalesce(text.rlike(SUSPICIOUS), F.lit(False))


def direct_repair(text: str) -> tuple[str, list[str]]:
    """The text with every disguise that needs no vocabulary undone, composed, and the kinds found."""
    kinds = []
    for kind, pattern, to in (
        ("invisible", _CF, ""),
        ("space", _SPACE, " "),
        ("full_width", _FULL, lambda m: chr(ord(m[0]) - 0xFEE0)),
        ("han_standin", _HAN, lambda m: HAN_STANDINS[m[0]]),
        ("combining", _COMBINED, lambda m: unicodedata.normalize("NFC", m[0])),
    ):
        text, n = pattern.subn(to, text)
        if n:
            kinds.append(kind)
    return unicodedata.normalize("NFC", text), kinds


def dominant_script(token: str) -> str:
    """The script of most letters of the token; on a tie Latin, then Greek."""
    count = {"LATIN": 0, "GREEK": 0, "CYRILLIC": 0}
    for c in token:
        script = unicodedata.name(c, "").split(" ")[0]
        if script in count:
            count[script] += 1
    return max(count, key=lambda s: count[s])


def proposals(token: str) -> list[str]:
    """Single-script readings of a mixed token, that of the dominant script first."""
    first = dominant_script(token)
    readings = []
    for script in [first, *(s for s in ("LATIN", "GREEK", "CYRILLIC") if s != first)]:
        if script == "LATIN":
            reading = token.translate(TO_LATIN)
        else:
            back = TO_FOREIGN[script]
            reading = "".join(back.get(c.translate(TO_LATIN), c) if not unicodedata.name(c, "").startswith(script) else c for c in token)
        if reading not in readings and not _MIXED.search(reading):
            readings.append(reading)
    return readings


_REPAIRED = T.StructType([
    T.StructField("field_name", T.StringType()), T.StructField("row_key", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("mixed", T.ArrayType(T.StringType())),
])


def _repair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, kinds, mixed = [], [], []
        for text in pdf["text"]:
            # a letter pair hidden by an invisible character is no case of its own
            odd = bool(_MIXED.search(text))
            fixed, found = direct_repair(text)
            tokens = [m[0] for m in _LATIN_RUN.finditer(fixed) if _MIXED.search(m[0])]
            texts.append(fixed)
            kinds.append(found + ["mixed_script"] * odd)
            mixed.append(list(dict.fromkeys(tokens)))
        yield pdf.assign(text=texts, kinds=kinds, mixed=mixed)[["field_name", "row_key", "text", "kinds", "mixed"]]


def scan(values: DataFrame) -> DataFrame:
    """values(field_name, row_key, text) -> those that the repair may change, directly repaired,
    with the kinds of disguise and the tokens that mix scripts."""
    odd = suspicious(F.col("text")) | F.col("text").rlike(COMPOSABLE)
    return values.select("field_name", "row_key", "text").filter(odd).mapInPandas(_repair_batches, _REPAIRED)


_WORD = r"(?<![{all}\p{{M}}])(?:[\p{{IsLatin}}]{{2,}}|[\p{{IsGreek}}]{{2,}}|[\p{{IsCyrillic}}]{{2,}})(?![{all}\p{{M}}])".format(all=r"\p{IsLatin}\p{IsGreek}\p{IsCyrillic}")


def corpus_words(values: DataFrame) -> DataFrame:
    """word: the whole words of one script in the values, once per place."""
    return values.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("word"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _readings(tokens: pd.Series) -> pd.Series:
    return tokens.map(proposals)


def substitutions(scanned: DataFrame, values: DataFrame) -> DataFrame:
    """token, reading: for each mixed token the first reading that is a corpus word.

    The corpus is cut to the words that are readings before anything is shuffled.
    """
    tokens = scanned.select(F.explode("mixed").alias("token")).distinct()
    readings = materialize(tokens.select("token", F.posexplode(_readings("token")).alias("rank", "word")))
    wanted = broadcast_if_small(readings.select("word").distinct(), MOST_READINGS)
    known = corpus_words(values).join(wanted, "word", "left_semi").distinct()
    return readings.join(known, "word").groupBy("token").agg(F.min_by("word", "rank").alias("reading"))


@F.pandas_udf(T.StringType())
def _substituted(texts: pd.Series, tokens: pd.Series, readings: pd.Series) -> pd.Series:
    swap = lambda text, table: _LATIN_RUN.sub(lambda m: table.get(m[0], m[0]), text)
    return pd.Series([swap(t, dict(zip(a, b))) for t, a, b in zip(texts, tokens, readings)], dtype=object)


def repaired(values: DataFrame) -> DataFrame:
    """field_name, row_key, text, disguised of the values that the repair looked into; values(field_name, row_key, text).

    Whole tokens are replaced, so that a longer token that holds another stays as it is.
    """
    scanned = materialize(scan(values).distinct())
    row = ["field_name", "row_key", "text", "kinds"]
    direct = scanned.filter(F.size("mixed") == 0).select(*row)
    swaps = broadcast_if_small(materialize(substitutions(scanned, values)), MOST_READINGS)
    mixed = (
        scanned.filter(F.size("mixed") > 0).select(*row, F.explode("mixed").alias("token"))
        .join(swaps, "token", "left")
        .groupBy(*row).agg(F.collect_list(F.when(F.col("reading").isNotNull(), F.struct("token", "reading"))).alias("swaps"))
        .withColumn("text", _substituted("text", F.col("swaps.token"), F.col("swaps.reading")))
        .select(*row)
    )
    return direct.unionByName(mixed).select("field_name", "row_key", "text", (F.size("kinds") > 0).alias("disguised"))


def normalise(values: DataFrame) -> DataFrame:
    """All values in one form: field_name, row_key, text, disguised.

    Values without a disguise pass unchanged but for composed marks; of a disguised one the
    direct repairs are applied, and each mixed token is replaced where the corpus has the reading.
    """
    values = values.select("field_name", "row_key", "text")
    plain = values.filter(~suspicious(F.col("text")) & ~F.coalesce(F.col("text").rlike(COMPOSABLE), F.lit(False)))
    return repaired(values).unionByName(plain.withColumn("disguised", F.lit(False))).distinct()


def find_disguised(values: DataFrame) -> DataFrame:
    """field_name, row_key of every value that the repair finds disguised."""
    return repaired(values).filter("disguised").select("field_name", "row_key").distinct()


def stored_values(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """blocks.text and chunks.section as field_name, row_key, text."""
    return blocks.select(
        F.lit("blocks.text").alias("field_name"), F.concat_ws("#", "doc_id", F.col("seq").cast("string")).alias("row_key"), "text"
    ).unionByName(chunks.select(F.lit("chunks.section").alias("field_name"), F.col("chunk_id").alias("row_key"), F.col("section").alias("text")))
