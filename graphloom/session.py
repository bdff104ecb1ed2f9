"""Session helpers: settings, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller owns the session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("graphloom")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = b.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, a local session gets a temporary one and any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder; on a cluster it must be one that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom_')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write df as parquet into the shared folder and read it back: cuts lineage and survives the loss of any executor.

    The files go when the driver ends, or with clear()."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(clear)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df to be broadcast, after a check that it has at most `most` rows; more are an error, not a cut."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}: too many to broadcast")
    return broadcast(df)


def clear() -> None:
    """Drops the tables that were written so far; for long sessions, between queries whose results are no longer read."""
    while _written:
        _drop(*_written.pop())


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a function that makes paths of it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _drop(spark: SparkSession, path: str) -> None:
    try:
        fs, at = file_system(spark, path)
        fs.delete(at(path), True)
    except Exception:  # noqa: BLE001 - the session may already be gone
        pass
