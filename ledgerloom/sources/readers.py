"""Sources: configuration, JSON lines, layouts, page listings, binary files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom import schemas


# Fixed value: the name of an extractor's layout file.
LAYOUT_NAME = "middle_json.json"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped, a missing path is an empty table."""
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_companies(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The company list and the report years of a YAML configuration."""
    import yaml

    config = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    columns = [c.split()[0] for c in schemas.COMPANIES.split(", ")]
    rows = [tuple(None if c.get(k) is None else str(c[k]) for k in columns) for c in config["companies"]]
    periods = {kind: [str(y) for y in config.get("periods", {}).get(kind, [])] for kind in ("annual", "semi")}
    return spark.createDataFrame(rows, schemas.COMPANIES), periods


def read_questions(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """The question list of a YAML file, optionally those of given ids."""
    import yaml

    loaded = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    items = loaded.get("questions", loaded) if isinstance(loaded, dict) else loaded
    rows = [(str(q["id"]), q.get("type"), q.get("question"), q.get("k"), q.get("expected_doc"), q.get("ground_truth")) for q in items]
    df = spark.createDataFrame(rows, schemas.QUESTIONS)
    return df.filter(F.col("id").isin(only)) if only else df


def read_doc_stats(spark: SparkSession, pattern: str) -> DataFrame:
    """One JSON object per file, under a glob pattern."""
    if not _exists(spark, pattern):
        return spark.createDataFrame([], schemas.DOC_STATS)
    return spark.read.schema(schemas.DOC_STATS).option("multiLine", True).json(pattern)


def read_layouts(spark: SparkSession, pattern: str) -> DataFrame:
    """doc_id (the folder's name), layout: one layout file per document, as text."""
    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("layout"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("doc_id"), "layout")


def read_layout_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """doc_id (the archive's name), layout: the first layout file of each zip archive; null if it has none or can't be read."""

    @F.pandas_udf("string")
    def unzip(contents: pd.Series) -> pd.Series:
        out = []
        for content in contents:
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if n.endswith(LAYOUT_NAME))
                    out.append(z.read(names[0]).decode("utf-8") if names else None)
            except (zipfile.BadZipFile, UnicodeDecodeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    files = spark.read.format("binaryFile").load(pattern)
    name = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    return files.select(name.alias("doc_id"), unzip("content").alias("layout"))


@F.pandas_udf(T.IntegerType())
def pdf_pages(contents: pd.Series) -> pd.Series:
    """Page objects of a PDF without object streams; null if none is seen."""
    found = contents.map(lambda c: len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", c or b"")) or None)
    return found.astype("Int32")


def read_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """path, size, sha256, pages and whether the file is a PDF of more than 1,024 bytes."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(
        "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), pdf_pages("content").alias("pages"),
        ((F.col("length") > 1024) & (F.substring("content", 1, 4) == F.lit(b"%PDF"))).alias("valid"),
    )


class PageListing(DataSource):
    """Announcements in pages of {totalAnnouncement, announcements}, one folder per target.

    Options: path (a folder of folders of numbered JSON pages) and maxPages.  Each folder
    is a partition; reading it stops at an empty page or when the stated total is reached.
    """

    @classmethod
    def name(cls) -> str:
        return "page_listing"

    def schema(self) -> str:
        return "target string, " + schemas.ANNOUNCEMENTS

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["path"], int(self.options.get("maxPages", 10)))


class _PageReader(DataSourceReader):
    def __init__(self, path: str, max_pages: int):
        self.path, self.max_pages = path, max_pages

    def partitions(self):
        return [InputPartition(str(p)) for p in sorted(Path(self.path).iterdir()) if p.is_dir()] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        folder, position = Path(partition.value), 0
        for page in sorted(folder.glob("*.json"), key=lambda p: (len(p.stem), p.stem))[: self.max_pages]:
            envelope = json.loads(page.read_text(encoding="utf-8"))
            rows = envelope.get("announcements") or []
            for r in rows:
                ms = r.get("announcementTime")
                yield folder.name, r.get("secCode"), r.get("announcementTitle"), r.get("adjunctUrl"), None if ms is None else int(ms), position
                position += 1
            if not rows or position >= (envelope.get("totalAnnouncement") or 0):
                return
