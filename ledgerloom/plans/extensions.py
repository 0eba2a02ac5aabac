"""Plain analytics on the star schema and the event table: windows, sessions, rollups, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialize, shared_dir, table
from ledgerloom.streaming import ingest


def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.event_windows(table(spark, d, "events"))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.event_windows(table(spark, d, "events"), "1 hour", "30 minutes").select("window_start", "event_type", "n")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.user_sessions(table(spark, d, "events"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The event table read as a stream to its end; the last state of the hourly windows."""
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    state: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        state[:] = [materialize(batch)]

    folder = f"{shared_dir(spark)}/ledgerloom/stream-{uuid.uuid4().hex}"
    counted = ingest.event_windows(source).writeStream.outputMode("complete").foreachBatch(keep)
    counted.option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    return state[0].withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"))


def star_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by region and nation with totals; the dimensions are joined before the facts are aggregated."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "n_name")
    revenue = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    facts = revenue.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return facts.rollup("r_name", "n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("orders"))


def star_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    ordered = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    rich = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("custkey"))
    both = rich.intersect(ordered).withColumn("side", F.lit("ordered"))
    return both.unionByName(rich.subtract(ordered).withColumn("side", F.lit("idle")))


def latest_order(spark: SparkSession, d: str) -> DataFrame:
    """The newest order of each customer; on a tie the one with the greatest key."""
    newest = F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")
    return table(spark, d, "orders").groupBy("o_custkey").agg(newest, F.count("*").alias("n")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), "n")


def running_quantity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("so_far"))


QUERIES = {
    f.__name__: f
    for f in (tumbling_windows, sliding_windows, session_windows, stream_windows, event_properties, star_rollup, star_cube, set_operations, latest_order, running_quantity)
}

ORACLE = {
    "tumbling_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_windows": "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL",
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "session_windows": "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce((ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE)::INT, 1) AS fresh FROM events)) GROUP BY user_id, s",
    "event_properties": "SELECT event_type, (json_extract(props, '$.k')::INT % 10) AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "star_rollup": "SELECT r_name, n_name, round(sum(revenue), 2) AS revenue, count(*) AS orders FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "star_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "set_operations": "SELECT custkey, 'ordered' AS side FROM (SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT custkey, 'idle' FROM (SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT o_custkey FROM orders)",
    "latest_order": "SELECT o_custkey, max(o_orderkey) FILTER (rn = 1) AS o_orderkey, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) GROUP BY o_custkey",
    "running_quantity": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM lineitem",
}
