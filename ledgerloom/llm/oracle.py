"""The same results in DuckDB's SQL, where SQL can express them over whole tables."""

from __future__ import annotations

import unicodedata

from ledgerloom.llm.glyphs import HAN_STANDINS, _ranges

_HAN = _ranges(list(HAN_STANDINS), lambda c: rf"\x{{{c:x}}}")
_FOREIGN = r"\p{Greek}\p{Cyrillic}"
_DISGUISED = (
    rf"[Ａ-Ｚａ-ｚ０-９\p{{Cf}}{_HAN}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x0B\f\r\x1C-\x1F\x{{85}}]"
    rf"|\p{{Latin}}\p{{M}}|[{_FOREIGN}]\p{{Latin}}|\p{{Latin}}[{_FOREIGN}]"
)

_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _compatibility() -> str:
    """Rows (c, plain) of all characters that NFKC changes beyond NFC."""
    codes = [*range(0xA0, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x1F100, 0x1F300)]
    rows = [(c, unicodedata.normalize("NFKC", chr(c))) for c in codes]
    return ", ".join("(%d, '%s')" % (c, to.replace("'", "''")) for c, to in rows if to != unicodedata.normalize("NFC", chr(c)))


def _nfkc(source: str, column: str) -> str:
    """A query for column and plain: the distinct values of the column in NFKC, character by character."""
    return f"""(SELECT {column}, nfc_normalize(string_agg(coalesce(m.plain, c), '' ORDER BY pos)) AS plain FROM (
        SELECT {column}, unnest(string_split({column}, '')) AS c, generate_subscripts(string_split({column}, ''), 1) AS pos FROM (SELECT DISTINCT {column} FROM {source}))
        LEFT JOIN (SELECT chr(code::INT) AS c, plain FROM (VALUES {_compatibility()}) v(code, plain)) m USING (c) GROUP BY {column})"""


_REPEATED = rf"""
    t AS (SELECT DISTINCT company, chunk_id, text FROM chunks WHERE type = 'text' AND company IS NOT NULL AND chunk_id IS NOT NULL),
    totals AS (SELECT company, count(DISTINCT chunk_id) AS total FROM t GROUP BY company),
    lines AS (SELECT company, chunk_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT *, string_split(text, chr(10)) AS l FROM t WHERE text IS NOT NULL)),
    counting AS (SELECT * FROM lines WHERE length(regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) >= 12),
    forms AS (SELECT line, regexp_replace(regexp_replace(plain, '[{_SPACE}\p{{Cf}}]+', '', 'g'), '\p{{Nd}}+', '0', 'g') AS form FROM {_nfkc("counting", "line")}),
    formed AS (SELECT DISTINCT company, chunk_id, line_no, form FROM counting JOIN forms USING (line)),
    often AS (SELECT company, form FROM formed JOIN totals USING (company) GROUP BY company, form HAVING count(DISTINCT chunk_id) >= greatest(5, 0.02::DOUBLE * any_value(total))),
    repeated AS (SELECT DISTINCT company, chunk_id, line_no::INT AS line_no FROM formed JOIN often USING (company, form))"""
#: Pairs by a prefix filter on the rarest substrings, counted exactly.
_SIMILAR = rf"""
    squeezed AS (SELECT DISTINCT chunk_id, regexp_replace(text, '[{_SPACE}]+', '', 'g') AS s FROM chunks WHERE type = 'text' AND chunk_id IS NOT NULL),
    contents AS (SELECT s, row_number() OVER (ORDER BY s) AS c FROM (SELECT DISTINCT s FROM squeezed WHERE length(s) >= 60)),
    grams AS (SELECT DISTINCT c, substring(s, i::INT, 5) AS g FROM (SELECT c, s, unnest(range(1, length(s) - 3)) AS i FROM contents)),
    ranked AS (SELECT c, g, row_number() OVER (PARTITION BY c ORDER BY df, g) AS place, count(*) OVER (PARTITION BY c) AS size FROM grams JOIN (SELECT g, count(*) AS df FROM grams GROUP BY g) USING (g)),
    heads AS (SELECT c, g, size FROM ranked WHERE place <= size - ceil(0.7::DOUBLE * size - 1e-9) + 1),
    near AS (SELECT DISTINCT a.c AS a, b.c AS b, a.size AS m, b.size AS n FROM heads a JOIN heads b USING (g) WHERE a.c < b.c AND least(a.size, b.size) >= 0.7::DOUBLE * greatest(a.size, b.size) - 1e-9),
    links AS (SELECT a, b FROM near JOIN grams x ON x.c = a JOIN grams y ON y.c = b AND y.g = x.g GROUP BY a, b, m, n HAVING count(*) >= 0.7::DOUBLE * (m + n - count(*)) - 1e-9),
    members AS (SELECT chunk_id, c FROM squeezed JOIN contents USING (s)),
    pairs AS (SELECT x.chunk_id AS p, y.chunk_id AS q FROM links JOIN members x ON x.c = a JOIN members y ON y.c = b UNION SELECT x.chunk_id, y.chunk_id FROM members x JOIN members y USING (c) WHERE x.chunk_id <> y.chunk_id)"""
_LETTERS = r"regexp_replace(lower(plain), '[^\p{L}\p{N}]+', '', 'g')"

ORACLE = {
    "p3_found": f"WITH {_REPEATED} SELECT DISTINCT chunk_id, line_no FROM repeated",
    "p3_cleaned": f"""WITH {_REPEATED}, gone AS (SELECT company, chunk_id, list(line_no) AS gone FROM repeated GROUP BY ALL)
        SELECT DISTINCT chunk_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text, coalesce(len(gone), 0)::INT AS removed
        FROM (SELECT DISTINCT company, chunk_id, text FROM chunks WHERE type = 'text') LEFT JOIN gone USING (company, chunk_id)""",
    "p6_found": f"WITH {_SIMILAR} SELECT DISTINCT least(p, q) AS chunk_a, greatest(p, q) AS chunk_b FROM pairs WHERE p <> q",
    "p6_groups": f"""WITH RECURSIVE {_SIMILAR},
        joined AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT c, c AS met FROM contents UNION SELECT r.c, j.b FROM reach r JOIN joined j ON j.a = r.met),
        names AS (SELECT r.c, min(chunk_id) AS group_id FROM reach r JOIN members m ON m.c = r.met GROUP BY r.c)
        SELECT chunk_id, group_id, (SELECT count(*) FROM joined WHERE a = m.c) AS links FROM members m JOIN names USING (c)""",
    "p8_found": f"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
        docs AS (SELECT doc_id, {_LETTERS} AS s FROM d JOIN {_nfkc("d", "text")} USING (text)),
        i AS (SELECT DISTINCT item_id, text FROM test_items WHERE text <> ''),
        items AS (SELECT item_id, {_LETTERS} AS s FROM i JOIN {_nfkc("i", "text")} USING (text)),
        wanted AS (SELECT DISTINCT item_id, substring(s, k::INT, 40) AS run FROM (SELECT item_id, s, unnest(range(1, length(s) - 38)) AS k FROM items))
        SELECT DISTINCT doc_id, item_id FROM (SELECT DISTINCT doc_id, substring(s, k::INT, 40) AS run FROM (SELECT doc_id, s, unnest(range(1, length(s) - 38)) AS k FROM docs)) JOIN wanted USING (run)""",
    "p2_found": f"""
        SELECT DISTINCT field_name, row_key FROM (
            SELECT 'blocks.text' AS field_name, doc_id || '#' || seq AS row_key, text FROM blocks
            UNION ALL SELECT 'chunks.section', chunk_id, section FROM chunks)
        WHERE regexp_matches(text, '{_DISGUISED}')""",
    "p4_found": """
        SELECT DISTINCT field_name, row_key FROM (
            SELECT 'chunks.text' AS field_name, chunk_id AS row_key, text FROM chunks
            UNION ALL SELECT 'blocks.text', doc_id || '#' || seq, text FROM blocks)
        WHERE length(text) > 1000""",
}
