"""Blocks to chunks: section paths, segments, greedy packing, identifiers.

Windows run within one document; reports are bounded, so no window grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

LEVELS = (2, 3, 4, 5)


def _order():
    return Window.partitionBy("doc_id").orderBy("page", "seq")


def with_levels(blocks: DataFrame) -> DataFrame:
    """Adds body (clean text, titles in one line) and heading (level 2 to 5, or null).

    A tagged title that matches no pattern nests one level below the heading before it;
    of a run of such titles each goes one deeper, to 5 at most.  Repeated rows count once.
    """
    w = _order().rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.select("doc_id", "page", "seq", "type", "text", "html", "level", "caption").filter(~F.col("type").isin("image", "equation", "chart")).distinct()
    t = X.clean_text(F.coalesce("text", F.lit("")))
    tagged = F.coalesce(F.col("level") > 0, F.lit(False))
    rows = rows.withColumn("clean", t).withColumn("sane", X.heading_sane(F.col("clean")) & (F.col("type") != "table"))
    rows = rows.withColumn("known", F.when(F.col("sane"), F.when(tagged, X.remap_level(F.col("clean"))).otherwise(X.detect_level(F.col("clean")))))
    rows = rows.withColumn("loose", F.col("sane") & tagged & F.col("known").isNull())
    rows = rows.withColumn("last_known", F.last("known", ignorenulls=True).over(w)).withColumn("run", F.count("known").over(w))
    depth = F.sum(F.col("loose").cast("int")).over(Window.partitionBy("doc_id", "run").orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, 0))
    nested = F.least(F.lit(5), F.coalesce("last_known", F.lit(3)) + depth)
    rows = rows.withColumn("heading", F.when(F.col("loose"), nested).otherwise(F.col("known")).cast("int"))
    body = F.when(F.col("heading").isNotNull(), X.title_text(F.col("clean"))).otherwise(F.col("clean"))
    return rows.withColumn("body", body).select("doc_id", "page", "seq", "type", "body", "html", "caption", "heading")


def with_paths(levelled: DataFrame) -> DataFrame:
    """Adds section: the last three titles that are open at the row."""
    w = _order().rowsBetween(Window.unboundedPreceding, 0)
    df = levelled.withColumn("pos", F.row_number().over(_order()))
    for lv in LEVELS:
        df = df.withColumn(f"t{lv}", F.last(F.when(F.col("heading") == lv, F.struct("pos", F.col("body").alias("title"))), ignorenulls=True).over(w))
        if lv > 2:
            df = df.withColumn(f"above{lv}", F.max(F.when(F.col("heading") < lv, F.col("pos"))).over(w))
    open_titles = [F.when(F.coalesce(F.col(f"t{lv}.pos") > F.col(f"above{lv}"), F.lit(True)) if lv > 2 else F.lit(True), F.col(f"t{lv}.title")) for lv in LEVELS]
    stack = F.array_compact(F.array(*open_titles))
    path = F.array_join(F.when(F.size(stack) > 3, F.slice(stack, -3, 3)).otherwise(stack), " / ")
    return df.withColumn("section", F.when(F.size(stack) > 0, path).otherwise(F.lit(X.DEFAULT_PATH))).select(*levelled.columns, "pos", "section")


def with_segments(pathed: DataFrame) -> DataFrame:
    """Adds segment: a number that grows at a new page, a heading, and before and after a table."""
    o = _order()
    new_page = F.coalesce(F.col("page") != F.lag("page").over(o), F.lit(True))
    table = F.col("type") == "table"
    starts = new_page | table | F.col("heading").isNotNull() | F.coalesce(F.lag("type").over(o) == "table", F.lit(False))
    return pathed.withColumn("starts", starts.cast("int")).withColumn("segment", F.sum("starts").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def pack_segments(segmented: DataFrame, target: int = 800) -> DataFrame:
    """doc_id, page, section, pos, piece, text of the pieces: rows are joined until their
    lengths reach the target; a heading adds its length but doesn't complete a piece."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "body", F.col("heading").isNotNull().alias("title"))))
    grouped = segmented.filter("type <> 'table'").groupBy("doc_id", "segment").agg(F.first("page").alias("page"), F.first("section").alias("section"), F.min("pos").alias("pos"), rows.alias("rows"))
    step = f"""aggregate(rows,
        named_struct('open', cast(array() as array<string>), 'size', 0, 'done', cast(array() as array<string>)),
        (s, x) -> if(not x.title and s.size + char_length(x.body) >= {int(target)},
            named_struct('open', cast(array() as array<string>), 'size', 0, 'done', concat(s.done, array(array_join(concat(s.open, array(x.body)), '\\n')))),
            named_struct('open', concat(s.open, array(x.body)), 'size', s.size + char_length(x.body), 'done', s.done)),
        s -> if(size(s.open) > 0, concat(s.done, array(array_join(s.open, '\\n'))), s.done))"""
    return grouped.select("doc_id", "page", "section", "pos", F.posexplode(F.expr(step)).alias("piece", "raw")).select("doc_id", "page", "section", "pos", "piece", X.clean_text(F.col("raw")).alias("text"))


def table_chunks(segmented: DataFrame) -> DataFrame:
    """Tables as chunks of their own; dropped if text and HTML are both empty."""
    html = F.coalesce("html", F.lit(""))
    text = F.when(F.col("body") != "", F.col("body")).otherwise(X.table_text(html))
    return segmented.filter("type = 'table'").select("doc_id", "page", "section", "pos", F.lit(0).alias("piece"), text.alias("text"), html.alias("html"), F.coalesce("caption", F.lit("")).alias("caption")).filter("text <> '' or html <> ''")


def chunk_blocks(blocks: DataFrame, target: int = 800, min_chunk: int = 80, min_emit: int = 30) -> DataFrame:
    """chunk_id, doc_id, section, page, type, text, html, caption, n_chars.

    Pieces shorter than min_emit are dropped; chunks are numbered in source order.
    """
    if target < min_chunk:
        raise ValueError("target must not be below min_chunk")
    segmented = with_segments(with_paths(with_levels(blocks)))
    texts = pack_segments(segmented, target).filter(F.char_length("text") >= min_emit)
    empty = F.lit("")
    both = texts.select("doc_id", "page", "section", "pos", "piece", F.lit("text").alias("type"), "text", empty.alias("html"), empty.alias("caption")).unionByName(
        table_chunks(segmented).withColumn("type", F.lit("table"))
    )
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "piece")) - 1
    mark = F.when(F.col("type") == "table", "t").otherwise("c")
    name = F.format_string("%s_p%04d_%s%04d", "doc_id", F.coalesce("page", F.lit(0)), mark, ordinal)
    return both.select(name.alias("chunk_id"), "doc_id", "section", "page", "type", "text", "html", "caption", F.char_length("text").alias("n_chars"))


def with_report(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds company, code, report_type and report_label; documents that the manifest lacks are left out."""
    reports = manifest.groupBy("doc_id").agg(F.min_by(F.struct(F.col("name").alias("company"), "code", "report_type", F.col("period_label").alias("report_label")), F.coalesce("downloaded_at", F.lit(""))).alias("r"))
    return chunks.join(reports, "doc_id").select("chunk_id", "doc_id", "r.company", "r.code", "r.report_type", "r.report_label", *[c for c in chunks.columns if c not in ("chunk_id", "doc_id")])


def selected(rows: DataFrame, manifest: DataFrame, condition: Column) -> DataFrame:
    """The rows of the reports that meet a condition on the manifest (codes, years, single documents)."""
    return rows.join(manifest.filter(condition).select("doc_id").distinct(), "doc_id", "left_semi")
