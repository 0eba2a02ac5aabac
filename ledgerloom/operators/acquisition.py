"""Choosing document versions from listings: targets, windows, the newest matching version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

BASE_URL = "https://static.disclosure.example/"


def targets(companies: DataFrame, annual: list[str], semi: list[str]) -> DataFrame:
    """code, report_type, report_year: every company with every period of the configuration."""
    periods = [F.struct(F.lit(kind).alias("report_type"), F.lit(str(y)).alias("report_year")) for kind, years in (("annual", annual), ("semi", semi)) for y in years]
    return companies.select("code").filter("code is not null").distinct().select("code", F.explode(F.array(*periods)).alias("p")).select("code", "p.*")


def window_bounds(report_type: Column, year: Column, wide: bool) -> tuple[Column, Column]:
    """First and last disclosure date of a period."""
    y = year.cast("int")
    day = lambda offset, month, dom: F.make_date(y + offset, F.lit(month), F.lit(dom))
    annual = report_type == "annual"
    if wide:
        return F.when(annual, day(1, 1, 1)).otherwise(day(0, 1, 1)), F.when(annual, day(1, 12, 31)).otherwise(day(1, 3, 31))
    return F.when(annual, day(1, 2, 1)).otherwise(day(0, 7, 1)), F.when(annual, day(1, 7, 31)).otherwise(day(1, 1, 31))


def parsed(announcements: DataFrame) -> DataFrame:
    """One row per announcement and code (joint codes apart), with a plain title and a date; repeated rows once."""
    codes = F.array_distinct(F.regexp_extract_all("sec_code", F.lit(r"(\d{6})"), F.lit(1)))
    return announcements.select("sec_code", "title", "adjunct_url", "announcement_ms", "position").distinct().select(
        F.explode(codes).alias("code"), X.strip_emphasis(F.col("title")).alias("title"), F.coalesce("announcement_ms", F.lit(0)).alias("ms"),
        F.to_date(F.timestamp_millis("announcement_ms")).alias("date"), X.full_url(BASE_URL, F.col("adjunct_url")).alias("url"), "position",
    )


def report_titles(rows: DataFrame) -> DataFrame:
    """Rows whose title ends as a report's does, without the stop words; adds report_type and report_year."""
    tail = rf"(?:（[^）]*）|全文|{X.WS})*$"
    year = F.regexp_extract("title", rf"(\d{{4}})年(?:半年度|年度)报告{tail}", 1)
    kind = F.when(F.col("title").rlike(rf"\d{{4}}年半年度报告{tail}"), "semi").when(F.col("title").rlike(rf"\d{{4}}年年度报告{tail}"), "annual")
    return rows.withColumns({"report_year": year, "report_type": kind}).filter(F.col("report_type").isNotNull() & ~F.col("title").rlike(X.BAD_TITLE_WORDS))


def in_window(wanted: DataFrame, announcements: DataFrame, wide: bool = False) -> DataFrame:
    """Announcements of each target's company within its window: an equi join on the code with the dates as residual."""
    lo, hi = window_bounds(F.col("report_type"), F.col("report_year"), wide)
    return wanted.join(parsed(announcements), "code").filter(F.col("date").between(lo, hi))


def pick_reports(wanted: DataFrame, announcements: DataFrame) -> DataFrame:
    """code, report_type, report_year, title, date, url, wide, candidates: the newest matching version.

    The narrow window is preferred; the wide one counts where it holds none.  Candidates
    come newest first, on a tie in the order of the listing.
    """
    keys = ["code", "report_type", "report_year"]
    matching = wanted.join(report_titles(parsed(announcements)), keys)
    narrow, wide = window_bounds(F.col("report_type"), F.col("report_year"), False), window_bounds(F.col("report_type"), F.col("report_year"), True)
    found = matching.filter(F.col("date").between(*wide)).withColumn("narrow", F.col("date").between(*narrow))
    item = F.struct((-F.col("ms")).alias("age"), "position", "url", "title", F.date_format("date", "yyyy-MM-dd").alias("date"))
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("narrow"), item))).alias("n"), F.array_sort(F.collect_set(item)).alias("w"))
    chosen = F.when(F.size("n") > 0, F.col("n")).otherwise(F.col("w"))
    out = lists.select(*keys, (F.size("n") == 0).alias("wide"), chosen.alias("c"))
    return out.select(
        *keys, F.col("c")[0]["title"].alias("title"), F.col("c")[0]["date"].alias("date"), F.col("c")[0]["url"].alias("url"), "wide",
        F.transform("c", lambda x: F.struct(x["title"].alias("title"), x["date"].alias("date"), x["url"].alias("url"))).alias("candidates"),
    )


def missing_targets(wanted: DataFrame, picked: DataFrame) -> DataFrame:
    return wanted.join(picked, ["code", "report_type", "report_year"], "left_anti")
