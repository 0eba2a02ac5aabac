"""Queries on blocks: cleaning, headings, sections, packing, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import blocks as B
from ledgerloom.operators import chunking as C
from ledgerloom.session import table


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks")


def _layouts(spark: SparkSession, d: str) -> DataFrame:
    """The blocks as an extractor would write them: a layout of each document, with page numbers, captions of
    images (from the references) and blocks without a type."""
    rows = _blocks(spark, d).select("doc_id", "page", "seq", "type", "src_type", "text", "html", "level", "caption").distinct()
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).alias("content"))
    content = F.when(F.col("type") == "table", F.to_json(F.array(part("caption", "caption"), part("table_body", "html"))))
    content = content.when(F.col("src_type") == "reference", F.to_json(F.array(part("caption", "text")))).otherwise(F.to_json(F.array("text")))
    kind = F.when(F.col("src_type") == "reference", "image").otherwise(F.col("src_type"))
    block = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"type":"'), kind, F.lit('",')), F.lit("")), F.lit('"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"content":'), content, F.lit("}"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["json"]), ",")
    pages = rows.groupBy("doc_id", "page").agg(joined(F.collect_list(F.struct("seq", block.alias("json")))).alias("blocks"))
    page = F.concat(F.lit('{"page_idx":'), F.col("page") - 1, F.lit(',"blocks":[{"type":"page_number","content":"'), F.col("page"), F.lit('"},'), F.col("blocks"), F.lit("]}"))
    documents = pages.groupBy("doc_id").agg(joined(F.collect_list(F.struct("page", page.alias("json")))).alias("pages"))
    return documents.select("doc_id", F.concat(F.lit('{"pages":['), "pages", F.lit("]}")).alias("layout"))


def flatten_layouts(spark: SparkSession, d: str) -> DataFrame:
    return B.flatten_layouts(_layouts(spark, d)).select("doc_id", "page", "seq", "type", "src_type", F.md5("text").alias("text_md5"), F.md5("html").alias("html_md5"), "level", "caption")


def block_filters(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of each kind of block; page numbers and empty texts are dropped."""
    return B.flatten_layouts(_layouts(spark, d)).groupBy("type", "src_type").agg(F.count("*").alias("n"), F.count("level").alias("levels"))


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Pages count from 1, blocks from 0 within their document."""
    return B.flatten_layouts(_layouts(spark, d)).groupBy("doc_id", "page").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def newest_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Of the downloads of each report, the newest."""
    rows = table(spark, d, "manifest").select(F.regexp_extract("doc_id", r"^(\d+_\d+_[a-z]+)", 1).alias("doc_id"), F.col("doc_id").alias("path"), F.coalesce("downloaded_at", F.lit("")).alias("modificationTime")).distinct()
    return B.newest_layouts(rows)


def selected_documents(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the selected codes, counted by document: the half-yearly reports."""
    return C.selected(table(spark, d, "blocks"), table(spark, d, "manifest"), F.col("report_type") == "semi").groupBy("doc_id").agg(F.count("*").alias("n"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).filter("type = 'text'").select("doc_id", "seq", X.clean_text(F.col("text")).alias("clean")).distinct()


def heading_detect(spark: SparkSession, d: str) -> DataFrame:
    level = X.detect_level(F.col("text"))
    return _blocks(spark, d).filter("type = 'text'").select("doc_id", "seq", level.alias("level")).filter("level is not null").distinct()


def heading_remap(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).filter("level > 0").select("doc_id", "seq", X.remap_level(X.clean_text(F.col("text"))).alias("level")).distinct()


def heading_sane(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).filter("type = 'text'").select("doc_id", "seq", X.heading_sane(X.clean_text(F.col("text"))).alias("sane")).distinct()


def section_levels(spark: SparkSession, d: str) -> DataFrame:
    return C.with_levels(_blocks(spark, d)).filter("heading is not null").select("doc_id", "seq", "heading", "body")


def section_path(spark: SparkSession, d: str) -> DataFrame:
    return C.with_paths(C.with_levels(_blocks(spark, d))).select("doc_id", "seq", "section")


def segments(spark: SparkSession, d: str) -> DataFrame:
    s = C.with_segments(C.with_paths(C.with_levels(_blocks(spark, d))))
    return s.groupBy("doc_id", "segment").agg(F.count("*").alias("blocks"), F.sum(F.char_length("body")).alias("chars"), F.min("seq").alias("first_seq"))


def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    pieces = C.pack_segments(C.with_segments(C.with_paths(C.with_levels(_blocks(spark, d)))))
    return pieces.filter(F.char_length("text") >= 30).select("doc_id", "page", "section", "pos", "piece", "text")


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_blocks(_blocks(spark, d)).select("chunk_id", "section", "page", "type", F.md5("text").alias("text_md5"), "n_chars")


def report_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the fields of their report."""
    chunks = C.with_report(C.chunk_blocks(_blocks(spark, d)), table(spark, d, "manifest"))
    return chunks.groupBy("code", "report_type", "type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = C.table_chunks(C.with_segments(C.with_paths(C.with_levels(_blocks(spark, d)))))
    return t.select("doc_id", "page", "section", "text", "caption")


def html_table_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("html <> ''").select("chunk_id", X.table_text(F.col("html")).alias("rows")).distinct()


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("html <> ''").select("chunk_id", X.strip_tags(F.col("html")).alias("plain")).distinct()


def doc_text_header(spark: SparkSession, d: str) -> DataFrame:
    text = X.document_text(F.col("company"), F.col("report_label"), F.col("section"), F.col("text"))
    return table(spark, d, "chunks").select("chunk_id", F.md5(text).alias("text_md5"), F.char_length(text).alias("n")).distinct()


def sha256_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", F.sha2("text", 256).alias("sha256")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        flatten_layouts, block_filters, page_numbers, newest_layouts, selected_documents, clean_text, heading_detect, heading_remap, heading_sane, section_levels, section_path, segments, greedy_chunks, chunk_ids, report_chunks,
        table_chunks, html_table_to_text, html_strip, doc_text_header, sha256_text,
    )
}

_W = X.WS


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _clean(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({x}, '[ \t\x{{a0}}]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g')")


def _detect(x: str) -> str:
    t = _strip(x)
    return f"""(CASE WHEN length({t}) = 0 OR length({t}) > 60 OR regexp_matches({t}, '{X.NO_HEADING_END}') THEN NULL
        WHEN regexp_matches({t}, '{X.PART}') THEN 2 WHEN regexp_matches({t}, '{X.HAN_NUMBER}') THEN 3
        WHEN regexp_matches({t}, '{X.BRACKET_NUMBER}') AND length({t}) <= 40 THEN 4
        WHEN regexp_matches({t}, '{X.DIGIT_NUMBER}') AND length({t}) <= 30 AND NOT regexp_matches({t}, '[。，]') THEN 5 END)"""


def _remap(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{X.PART}') THEN 2 WHEN regexp_matches({x}, '{X.HAN_NUMBER}') THEN 3 WHEN regexp_matches({x}, '{X.BRACKET_NUMBER}|{X.DIGIT_NUMBER}') THEN 4 END)"


def _sane(x: str) -> str:
    return f"coalesce(length({x}) > 0 AND NOT contains({x}, '。') AND NOT regexp_matches({x}, '{X.NO_HEADING_START}') AND NOT (contains({x}, '，') AND length({x}) > 16) AND NOT regexp_matches({x}, '{X.CHECK_BOXES}'), false)"


_TABLE = r"""array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(coalesce({h}, ''), '(?is)<tr[^>]*>(.*?)</tr>', 1),
    lambda r: list_transform(regexp_extract_all(r, '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1), lambda c: {strip})),
    lambda r: len(r) > 0), lambda r: array_to_string(r, ' | ')), chr(10))"""


def _table(h: str) -> str:
    return _TABLE.replace("{h}", h).replace("{strip}", _strip("replace(regexp_replace(c, '<[^>]+>', '', 'g'), '&nbsp;', ' ')"))


LEVELLED = f"""
    b AS (SELECT DISTINCT doc_id, page, seq, type, text, html, level, caption FROM blocks WHERE type NOT IN ('image', 'equation', 'chart')),
    c AS (SELECT *, {_clean("coalesce(text, '')")} AS clean, coalesce(level > 0, false) AS tagged FROM b),
    s AS (SELECT *, {_sane("clean")} AND type <> 'table' AS sane FROM c),
    k AS (SELECT *, CASE WHEN sane THEN CASE WHEN tagged THEN {_remap("clean")} ELSE {_detect("clean")} END END AS known FROM s),
    o AS (SELECT *, sane AND tagged AND known IS NULL AS loose, last_value(known IGNORE NULLS) OVER w AS last_known, count(known) OVER w AS run FROM k
        WINDOW w AS (PARTITION BY doc_id ORDER BY page, seq ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT *, CASE WHEN loose THEN least(5, coalesce(last_known, 3) + sum(loose::INT) OVER (PARTITION BY doc_id, run ORDER BY page, seq ROWS UNBOUNDED PRECEDING)) ELSE known END::INT AS heading FROM o),
    levelled AS (SELECT doc_id, page, seq, type, CASE WHEN heading IS NOT NULL AND length(clean) <= 40 THEN replace(clean, chr(10), '') ELSE clean END AS body, html, caption, heading FROM n)"""
PATHED = (
    LEVELLED
    + """,
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq) AS pos FROM levelled),
    marks AS (SELECT *, """
    + ", ".join(
        f"last_value(CASE WHEN heading = {lv} THEN pos END IGNORE NULLS) OVER w AS p{lv}, last_value(CASE WHEN heading = {lv} THEN body END IGNORE NULLS) OVER w AS t{lv}, max(CASE WHEN heading < {lv} THEN pos END) OVER w AS a{lv}"
        for lv in C.LEVELS
    )
    + """ FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY page, seq ROWS UNBOUNDED PRECEDING)),
    stacks AS (SELECT *, list_filter(["""
    + ", ".join(f"CASE WHEN coalesce(p{lv} > a{lv}, true) THEN t{lv} END" for lv in C.LEVELS)
    + f"""], lambda x: x IS NOT NULL) AS stack FROM marks),
    pathed AS (SELECT doc_id, page, seq, type, body, html, caption, heading, pos, CASE WHEN len(stack) = 0 THEN '{X.DEFAULT_PATH}' ELSE array_to_string(stack[-3:], ' / ') END AS section FROM stacks)"""
)
SEGMENTED = (
    PATHED
    + """,
    cuts AS (SELECT *, (coalesce(page <> lag(page) OVER w, true) OR type = 'table' OR heading IS NOT NULL OR coalesce(lag(type) OVER w = 'table', false))::INT AS starts FROM pathed WINDOW w AS (PARTITION BY doc_id ORDER BY page, seq)),
    segmented AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY page, seq ROWS UNBOUNDED PRECEDING) AS segment FROM cuts)"""
)
PACKED = (
    SEGMENTED
    + f""",
    segs AS (SELECT doc_id, segment, min(page) AS page, min_by(section, pos) AS section, min(pos) AS pos, list({{'body': body, 'title': heading IS NOT NULL}} ORDER BY pos) AS rows FROM segmented WHERE type <> 'table' GROUP BY doc_id, segment),
    folded AS (SELECT *, list_reduce(list_transform(rows, lambda r: {{'size': 0, 'group': 0, 'ids': []::INT[], 'body': r.body, 'title': r.title}}),
        lambda s, x: {{'size': CASE WHEN NOT x.title AND s.size + length(x.body) >= 800 THEN 0 ELSE s.size + length(x.body) END::INT,
            'group': CASE WHEN NOT x.title AND s.size + length(x.body) >= 800 THEN s."group" + 1 ELSE s."group" END::INT, 'ids': list_append(s.ids, s."group"), 'body': '', 'title': false}},
        {{'size': 0, 'group': 0, 'ids': []::INT[], 'body': '', 'title': false}}).ids AS ids FROM segs),
    parts AS (SELECT doc_id, segment, page, section, pos, unnest(rows) AS r, unnest(ids) AS piece, generate_subscripts(rows, 1) AS i FROM folded),
    packed AS (SELECT doc_id, page, section, pos, piece, {_clean("string_agg(r.body, chr(10) ORDER BY i)")} AS text FROM parts GROUP BY doc_id, segment, page, section, pos, piece)"""
)
CHUNKED = (
    PACKED
    + f""",
    tabled AS (SELECT doc_id, page, section, pos, 0 AS piece, CASE WHEN body <> '' THEN body ELSE {_table("html")} END AS text, coalesce(html, '') AS html, coalesce(caption, '') AS caption FROM segmented WHERE type = 'table'),
    emitted AS (SELECT doc_id, page, section, pos, piece, 'text' AS type, text FROM packed WHERE length(text) >= 30
        UNION ALL SELECT doc_id, page, section, pos, piece, 'table', text FROM tabled WHERE text <> '' OR html <> ''),
    chunked AS (SELECT doc_id || '_p' || lpad(coalesce(page, 0)::VARCHAR, 4, '0') || '_' || CASE type WHEN 'table' THEN 't' ELSE 'c' END || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY pos, piece) - 1)::VARCHAR, 4, '0') AS chunk_id, * FROM emitted)"""
)

_FLAT = f"""
    given AS (SELECT DISTINCT doc_id, page, seq, type, src_type, text, html, level, caption FROM blocks),
    named AS (SELECT doc_id, page, seq, type, CASE WHEN type = 'table' THEN 'table' WHEN src_type = 'reference' THEN 'image_caption' ELSE coalesce(src_type, 'unknown') END AS src_type,
        CASE WHEN type = 'table' THEN '' ELSE {_strip("coalesce(text, '')")} END AS text, CASE WHEN type = 'table' THEN coalesce(html, '') ELSE '' END AS html,
        CASE WHEN type <> 'table' AND src_type IS DISTINCT FROM 'reference' AND level > 0 THEN level END AS level, CASE WHEN type = 'table' THEN {_strip("coalesce(caption, '')")} ELSE '' END AS caption FROM given),
    flat AS (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY page, seq) - 1)::INT AS seq, type, src_type, text, html, level, caption FROM named WHERE type = 'table' OR text <> '')"""

ORACLE = {
    "flatten_layouts": f"WITH {_FLAT} SELECT doc_id, page, seq, type, src_type, md5(text) AS text_md5, md5(html) AS html_md5, level, caption FROM flat",
    "block_filters": f"WITH {_FLAT} SELECT type, src_type, count(*) AS n, count(level) AS levels FROM flat GROUP BY ALL",
    "page_numbers": f"WITH {_FLAT} SELECT doc_id, page, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM flat GROUP BY ALL",
    "newest_layouts": """SELECT doc_id, path, "modificationTime" FROM (SELECT DISTINCT regexp_extract(doc_id, '^(\\d+_\\d+_[a-z]+)', 1) AS doc_id, doc_id AS path, coalesce(downloaded_at, '') AS "modificationTime" FROM manifest) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "modificationTime" DESC, path) = 1""",
    "selected_documents": "SELECT doc_id, count(*) AS n FROM blocks WHERE doc_id IN (SELECT doc_id FROM manifest WHERE report_type = 'semi') GROUP BY doc_id",
    "clean_text": f"SELECT DISTINCT doc_id, seq, {_clean('text')} AS clean FROM blocks WHERE type = 'text'",
    "heading_detect": f"SELECT DISTINCT doc_id, seq, {_detect('text')} AS level FROM blocks WHERE type = 'text' AND {_detect('text')} IS NOT NULL",
    "heading_remap": f"SELECT DISTINCT doc_id, seq, {_remap(_clean('text'))} AS level FROM blocks WHERE level > 0",
    "heading_sane": f"SELECT DISTINCT doc_id, seq, {_sane(_clean('text'))} AS sane FROM blocks WHERE type = 'text'",
    "section_levels": f"WITH {LEVELLED} SELECT doc_id, seq, heading, body FROM levelled WHERE heading IS NOT NULL",
    "section_path": f"WITH {PATHED} SELECT doc_id, seq, section FROM pathed",
    "segments": f"WITH {SEGMENTED} SELECT doc_id, segment::BIGINT AS segment, count(*) AS blocks, sum(length(body))::BIGINT AS chars, min(seq) AS first_seq FROM segmented GROUP BY doc_id, segment",
    "greedy_chunks": f"WITH {PACKED} SELECT doc_id, page, section, pos, piece, text FROM packed WHERE length(text) >= 30",
    "chunk_ids": f"WITH {CHUNKED} SELECT chunk_id, section, page, type, md5(text) AS text_md5, length(text) AS n_chars FROM chunked",
    "report_chunks": f"WITH {CHUNKED}, m AS (SELECT doc_id, min_by({{'code': code, 'report_type': report_type}}, coalesce(downloaded_at, '')) AS r FROM manifest GROUP BY doc_id) SELECT r.code AS code, r.report_type AS report_type, type, count(*) AS n, sum(length(text))::BIGINT AS chars FROM chunked JOIN m USING (doc_id) GROUP BY ALL",
    "table_chunks": f"WITH {CHUNKED} SELECT doc_id, page, section, text, caption FROM tabled WHERE text <> '' OR html <> ''",
    "html_table_to_text": f"SELECT DISTINCT chunk_id, {_table('html')} AS rows FROM chunks WHERE html <> ''",
    "html_strip": f"""SELECT DISTINCT chunk_id, {_strip("regexp_replace(html, '<[^>]+>', '', 'g')")} AS plain FROM chunks WHERE html <> ''""",
    "doc_text_header": "SELECT DISTINCT chunk_id, md5(t) AS text_md5, length(t) AS n FROM (SELECT chunk_id, substring(coalesce(company, '') || '《' || coalesce(report_label, '') || '》' || coalesce(section, '') || chr(10) || coalesce(text, ''), 1, 1600) AS t FROM chunks)",
    "sha256_text": "SELECT DISTINCT chunk_id, sha256(text) AS sha256 FROM chunks",
}
