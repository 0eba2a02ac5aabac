"""Session helpers: opening tables, cutting lineage, sizing shuffles."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one bucket of a grouped Python task may hold on average.
BUCKET_ROWS = 400_000
_OWN: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    shared = shared_dir(spark)
    folder = Path(shared.removeprefix("file://")) if shared.startswith(("file://", "/")) else Path(tempfile.mkdtemp(prefix="ledgerloom-"))
    folder.mkdir(parents=True, exist_ok=True)
    archive = folder / f"ledgerloom-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._ledgerloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and
    all executors run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"ledgerloom-{spark.sparkContext.applicationId}")
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and the
    file outlives any executor.  Compressed and columnar, unlike checkpoint()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    """Delete what this application materialized, if its session still runs."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session has ended
            return


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partitioned by the columns into as many partitions as the session's shuffles have; not
    coalesced by their size, as the rows are about to be exploded."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has at most so many rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def buckets_for(rows: int, per_bucket: int = BUCKET_ROWS, least: int = 1) -> int:
    """Number of hash buckets so that each holds about per_bucket rows."""
    return max(least, -(-rows // per_bucket))
