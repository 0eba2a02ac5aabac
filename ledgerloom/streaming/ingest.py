"""Incremental ingestion and windowed statistics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import schemas
from ledgerloom.operators.blocks import flatten_layouts
from ledgerloom.sources.sinks import upsert


def layout_stream(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, layout of the layout files (doc_id/name.json) that arrive in a folder; each is read once."""
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(f"{folder}/*/*.json")
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("doc_id"), F.col("value").alias("layout"))


def ingest_layouts(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Flatten new layout files into the blocks table; finished files are skipped after a restart."""
    return (
        flatten_layouts(layout_stream(spark, folder)).writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_manifest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Upsert arriving manifest rows (JSON lines) by doc_id; within a batch the latest download wins.
    A batch that is run again after a failure gives the same table."""

    def apply(batch: DataFrame, _: int) -> None:
        row = F.struct(*[c.split()[0] for c in schemas.MANIFEST.split(", ")])
        latest = batch.filter("doc_id is not null").groupBy("doc_id").agg(F.max_by(row, F.coalesce("downloaded_at", F.lit(""))).alias("r")).select("r.*")
        upsert(batch.sparkSession, target, latest, "doc_id")

    rows = spark.readStream.schema(schemas.MANIFEST).json(folder)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total over a stream or table of events; late rows beyond the watermark are dropped by a stream."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    source = events.withWatermark("ts", late) if events.isStreaming else events
    counted = source.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end, n."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
