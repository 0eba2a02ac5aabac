"""Sinks: JSON lines, keyed upserts, index tables, evaluation reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have; columns of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str) -> None:
    """Replace or insert by key in a parquet table: a staged write, then a swap of the folders,
    so that a failed job leaves the old table as it was."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    staged, aside = (jvm.org.apache.hadoop.fs.Path(f"{path}.{x}-{uuid.uuid4().hex[:8]}") for x in ("new", "old"))
    merged = merge_by_key(spark.read.parquet(path), new, key) if fs.exists(target) else new
    merged.orderBy(key).write.parquet(staged.toString())
    if fs.exists(target):
        fs.rename(target, aside)
    fs.rename(staged, target)
    fs.delete(aside, True)


def csv_with_bom(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV whose header starts with a byte order mark, as spreadsheet programs expect it.

    One file, for reports of a bounded number of rows; with single=False every part file has its own header.
    """
    first = df.columns[0]
    marked = df.withColumnRenamed(first, BOM + first)
    (marked.coalesce(1) if single else marked).write.mode("overwrite").option("header", True).csv(path)


def markdown(evidence: DataFrame) -> DataFrame:
    """qid, page: one readable section per question, from evidence(qid, question, idx, company, report_label, section, page, score)."""
    line = F.format_string("%d. %s %s | %s | p%d | %.6f", "idx", "company", "report_label", "section", "page", "score")
    ordered = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    body = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return evidence.groupBy("qid").agg(F.concat(F.lit("## "), F.col("qid"), F.lit(" "), F.first("question"), F.lit("\n\n"), body).alias("page"))
