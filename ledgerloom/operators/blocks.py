"""Layout files to content blocks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

# Block types that hold text; all types besides these, tables and images are noise.
TEXT = ("text", "paragraph_title", "doc_title", "caption", "list", "code", "reference", "unknown")
KINDS = (*TEXT, "table", "image")


def leaves(value) -> Iterator[str]:
    """Text leaves of a recursive content value, in order."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from leaves(x)
    elif isinstance(value, dict):
        yield from leaves(value.get("content"))


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content values (JSON) of bodies and captions as texts, their leaves joined by line feeds."""
    for batch in batches:
        for name in ("bodies", "captions"):
            column = batch.column(name)
            texts = ["\n".join(leaves(json.loads(v))) if v else "" for v in column.flatten().to_pylist()]
            ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int32)
            at = batch.schema.get_field_index(name)
            batch = batch.set_column(at, name, pa.ListArray.from_arrays(pa.array(ends), pa.array(texts, pa.string())))
        yield batch


def flatten_layouts(layouts: DataFrame) -> DataFrame:
    """layouts(doc_id, layout as JSON text) -> blocks, numbered from 0 within each document.

    Pages and blocks are taken apart and filtered as variants; only the recursive content
    values pass through Python.  Null and unreadable layouts give no blocks.
    """
    get = F.try_variant_get
    items = lambda v, path: F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    of_type = lambda parts, kind: F.filter(parts, lambda p: get(p, "$.type", "string") == kind)
    json_of = lambda v: F.to_json(get(v, "$.content", "variant"))

    def block(page, b):
        named = get(b, "$.type", "string")
        kind = F.when(named != "", named).otherwise("unknown")
        parts = items(b, "$.content")
        whole = F.when(F.schema_of_variant(get(b, "$.level", "variant")) == "BIGINT", get(b, "$.level", "int"))
        return F.struct(
            (F.coalesce(get(page, "$.page_idx", "int"), F.lit(0)) + 1).alias("page"), kind.alias("kind"), F.when(whole > 0, whole).alias("level"),
            F.when(kind == "table", json_of(F.try_element_at(of_type(parts, "table_body"), F.lit(-1)))).when(kind != "image", json_of(b)).alias("body"),
            F.when(kind.isin("table", "image"), F.transform(of_type(parts, "caption"), json_of)).alias("captions"),
        )

    pages = items(F.try_parse_json("layout"), "$.pages")
    found = F.flatten(F.transform(pages, lambda page: F.transform(items(page, "$.blocks"), lambda b: block(page, b))))
    kept = layouts.select("doc_id", F.filter(found, lambda b: b["kind"].isin(*KINDS)).alias("b")).filter(F.size("b") > 0)
    # all captions of a document in one array, and where those of each block begin
    none = F.array().cast("array<string>")
    listed = kept.select("doc_id", "b", F.transform("b", lambda b: b["body"]).alias("bodies"), F.flatten(F.transform("b", lambda b: F.coalesce(b["captions"], none))).alias("captions"))
    read = listed.mapInArrow(_with_texts, listed.schema)
    sizes = F.transform("b", lambda b: F.coalesce(F.size(b["captions"]), F.lit(0)))
    row = F.transform("b", lambda b, i: _row(b, F.element_at("bodies", i + 1), F.slice("captions", F.aggregate(F.slice(sizes, 1, i), F.lit(1), lambda s, n: s + n), F.element_at(sizes, i + 1))))
    full = read.select("doc_id", F.filter(row, lambda r: (r["type"] == "table") | (r["text"] != "")).alias("rows"))
    return full.select("doc_id", F.posexplode("rows").alias("seq", "r")).select("doc_id", "r.page", "seq", "r.type", "r.src_type", "r.text", "r.html", "r.level", "r.caption")


def _row(b, body, captions):
    """The fields of a block of one of KINDS, from its text and the texts of its captions."""
    strip = lambda c: F.regexp_replace(c, f"^{X.WS}+|{X.WS}+$", "")
    table, image = b["kind"] == "table", b["kind"] == "image"
    return F.struct(
        b["page"].alias("page"), F.when(table, "table").otherwise("text").alias("type"), F.when(image, "image_caption").otherwise(b["kind"]).alias("src_type"),
        F.when(table, "").when(image, strip(F.array_join(captions, "\n"))).otherwise(strip(body)).alias("text"), F.when(table, body).otherwise("").alias("html"),
        F.when(~table & ~image, b["level"]).alias("level"), F.when(table, strip(F.array_join(F.filter(captions, lambda c: c != ""), " "))).otherwise("").alias("caption"),
    )


def newest_layouts(files: DataFrame) -> DataFrame:
    """The newest file of each document by modification time, ties by path; files(doc_id, path, modificationTime, ...)."""
    newest = Window.partitionBy("doc_id").orderBy(F.desc("modificationTime"), "path")
    return files.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth")


def document_statistics(blocks: DataFrame) -> DataFrame:
    """doc_id, pages, blocks, tables."""
    return blocks.groupBy("doc_id").agg(F.max("page").alias("pages"), F.count("*").alias("blocks"), F.count_if(F.col("type") == "table").alias("tables"))
