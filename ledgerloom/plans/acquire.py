"""Queries on listings, targets and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import acquisition as A
from ledgerloom.session import table
from ledgerloom.sources.sinks import merge_by_key

#: The periods of the test tables.
YEARS = [str(y) for y in range(2010, 2027)]
KEYS = ["code", "report_type", "report_year"]


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return A.targets(table(spark, d, "companies"), YEARS, YEARS)


def iter_targets_cross(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d).select(*KEYS, X.period_label(F.col("report_type"), F.col("report_year")).alias("label"), X.doc_key(F.col("code"), F.col("report_type"), F.col("report_year")).alias("doc_key"))


def period_window_range_join(spark: SparkSession, d: str) -> DataFrame:
    return A.in_window(_targets(spark, d), table(spark, d, "announcements")).groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def title_filter(spark: SparkSession, d: str) -> DataFrame:
    return A.report_titles(A.parsed(table(spark, d, "announcements"))).select("code", "title", "ms", "position", "report_type", "report_year", "url").distinct()


def _picked(spark: SparkSession, d: str) -> DataFrame:
    return A.pick_reports(_targets(spark, d), table(spark, d, "announcements"))


def pick_latest(spark: SparkSession, d: str) -> DataFrame:
    return _picked(spark, d).select(*KEYS, "title", "date", "url", "wide")


def candidates_array(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array_join(F.transform("candidates", lambda c: F.concat(c["date"], F.lit(" "), c["url"])), "\n")
    return _picked(spark, d).select(*KEYS, F.size("candidates").alias("n"), listed.alias("listed"))


def wide_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _picked(spark, d).filter("wide").select(*KEYS, "date")


def missing_targets(spark: SparkSession, d: str) -> DataFrame:
    return A.missing_targets(_targets(spark, d), _picked(spark, d))


def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Reports of 2019 and later, seen again with a page more, into the manifest."""
    rows = table(spark, d, "manifest").select("doc_id", "report_year", "pages", "size").distinct()
    new = rows.filter("report_year >= '2019'").withColumn("pages", F.col("pages") + 1)
    return merge_by_key(rows, new, "doc_id")


def epoch_to_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "announcements").groupBy(X.epoch_date(F.col("announcement_ms")).alias("date")).agg(F.count("*").alias("n"))


def human_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").select("doc_id", X.human_size(F.col("size")).alias("readable")).distinct()


def status_summary(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.operators.evaluation import status

    return status(table(spark, d, "manifest"), table(spark, d, "chunks"))


QUERIES = {
    f.__name__: f
    for f in (iter_targets_cross, period_window_range_join, title_filter, pick_latest, candidates_array, wide_fallback, missing_targets, manifest_upsert, epoch_to_date, human_size, status_summary)
}

_TARGETS = f"""
    targets AS (SELECT DISTINCT c.code, t.report_type, y.report_year FROM companies c, (VALUES ('annual'), ('semi')) t(report_type), (SELECT unnest({YEARS!r}) AS report_year) y WHERE c.code IS NOT NULL)"""
_PARSED = rf"""
    parsed AS (SELECT unnest(list_distinct(regexp_extract_all(sec_code, '(\d{{6}})', 1))) AS code,
        regexp_replace(replace(replace(coalesce(title, ''), '<em>', ''), '</em>', ''), '^{X.WS}+|{X.WS}+$', '', 'g') AS title,
        coalesce(announcement_ms, 0) AS ms, epoch_ms(announcement_ms)::DATE AS date,
        '{A.BASE_URL}' || regexp_replace(coalesce(adjunct_url, ''), '^/+', '') AS url, position
      FROM (SELECT DISTINCT * FROM announcements))"""
_TAIL = rf"(?:（[^）]*）|全文|{X.WS})*$"
_TITLED = rf"""
    titled AS (SELECT *, regexp_extract(title, '(\d{{4}})年(?:半年度|年度)报告{_TAIL}', 1) AS report_year,
        CASE WHEN regexp_matches(title, '\d{{4}}年半年度报告{_TAIL}') THEN 'semi' WHEN regexp_matches(title, '\d{{4}}年年度报告{_TAIL}') THEN 'annual' END AS report_type
      FROM parsed WHERE NOT regexp_matches(title, '{X.BAD_TITLE_WORDS}')),
    reports AS (SELECT * FROM titled WHERE report_type IS NOT NULL)"""
_BOUNDS = """
    bounds AS (SELECT *, CASE report_type WHEN 'annual' THEN make_date(y + 1, 2, 1) ELSE make_date(y, 7, 1) END AS lo, CASE report_type WHEN 'annual' THEN make_date(y + 1, 7, 31) ELSE make_date(y + 1, 1, 31) END AS hi,
        CASE report_type WHEN 'annual' THEN make_date(y + 1, 1, 1) ELSE make_date(y, 1, 1) END AS wlo, CASE report_type WHEN 'annual' THEN make_date(y + 1, 12, 31) ELSE make_date(y + 1, 3, 31) END AS whi
      FROM (SELECT *, report_year::INT AS y FROM targets))"""
_PICK = f"""WITH {_TARGETS}, {_PARSED}, {_TITLED}, {_BOUNDS},
    hits AS (SELECT DISTINCT b.code, b.report_type, b.report_year, r.title, r.ms, r.date, r.url, r.position, r.date BETWEEN b.lo AND b.hi AS narrow
      FROM bounds b JOIN reports r USING (code, report_type, report_year) WHERE r.date BETWEEN b.wlo AND b.whi),
    kept AS (SELECT *, NOT any_narrow AS wide, row_number() OVER (PARTITION BY code, report_type, report_year ORDER BY ms DESC, position, url, title) AS rn
      FROM (SELECT *, bool_or(narrow) OVER (PARTITION BY code, report_type, report_year) AS any_narrow FROM hits) WHERE narrow OR NOT any_narrow)"""

ORACLE = {
    "iter_targets_cross": f"WITH {_TARGETS} SELECT code, report_type, report_year, report_year || CASE report_type WHEN 'annual' THEN '年年度报告' ELSE '年半年度报告' END AS label, code || '_' || report_year || '_' || report_type AS doc_key FROM targets",
    "period_window_range_join": f"WITH {_TARGETS}, {_PARSED}, {_BOUNDS} SELECT code, report_type, report_year, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM bounds JOIN parsed USING (code) WHERE date BETWEEN lo AND hi GROUP BY ALL",
    "title_filter": f"WITH {_PARSED}, {_TITLED} SELECT DISTINCT code, title, ms, position, report_type, report_year, url FROM reports",
    "pick_latest": f"{_PICK} SELECT code, report_type, report_year, title, strftime(date, '%Y-%m-%d') AS date, url, wide FROM kept WHERE rn = 1",
    "candidates_array": f"{_PICK} SELECT code, report_type, report_year, count(*) AS n, string_agg(strftime(date, '%Y-%m-%d') || ' ' || url, chr(10) ORDER BY rn) AS listed FROM kept GROUP BY ALL",
    "wide_fallback": f"{_PICK} SELECT code, report_type, report_year, strftime(date, '%Y-%m-%d') AS date FROM kept WHERE rn = 1 AND wide",
    "missing_targets": f"{_PICK} SELECT code, report_type, report_year FROM targets ANTI JOIN kept USING (code, report_type, report_year)",
    "manifest_upsert": "WITH m AS (SELECT DISTINCT doc_id, report_year, pages, size FROM manifest), n AS (SELECT doc_id, report_year, pages + 1 AS pages, size FROM m WHERE report_year >= '2019') SELECT * FROM n UNION ALL SELECT * FROM m WHERE doc_id NOT IN (SELECT doc_id FROM n)",
    "epoch_to_date": "SELECT coalesce(strftime(epoch_ms(announcement_ms), '%Y-%m-%d'), '') AS date, count(*) AS n FROM announcements GROUP BY ALL",
    "human_size": "SELECT DISTINCT doc_id, CASE WHEN size < 1024 THEN printf('%.1fB', size::DOUBLE) WHEN size < 1048576 THEN printf('%.1fKB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN printf('%.1fMB', size / 1048576.0::DOUBLE) WHEN size < 1099511627776 THEN printf('%.1fGB', size / 1073741824.0::DOUBLE) WHEN size IS NOT NULL THEN printf('%.1fTB', size / 1099511627776.0::DOUBLE) END AS readable FROM manifest",
    "status_summary": "SELECT (SELECT count(DISTINCT doc_id) FROM manifest) AS n_docs, (SELECT coalesce(sum(p), 0)::BIGINT FROM (SELECT max(pages) AS p FROM manifest GROUP BY doc_id)) AS n_pages, (SELECT count(DISTINCT code) FROM manifest) AS n_companies, (SELECT count(DISTINCT chunk_id) FROM chunks) AS n_chunks",
}
