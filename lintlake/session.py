"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on (UTC) and the Arrow batch size that suits whole source files."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Of a key that a JSON object repeats the last value counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Files may be 500 KB each: a batch of 10 000 of them would not fit a Python worker.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    own = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, own) if own else spark.conf.unset(key)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Python gets batches of at most ``most`` rows in the jobs that run meanwhile; the session's own setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key, None)
    with _setting(spark, key, str(min(most, int(own)) if own and int(own) > 0 else most)):
        yield


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lintlake-")
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used to cut lineage where later steps must all see the same physical order, and to let two
    consumers share one expensive result. The table survives the loss of any executor. What was exchanged
    to make it goes with the write; else it would lie on the executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/lintlake/{name}-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, name: str, *columns: str, buckets: int = 0) -> DataFrame:
    """As ``written``, in buckets by ``columns``: whatever groups or joins by them later needs no exchange. The files lie in the shared
    folder; the catalogue knows the table by a name of its own, for the buckets' sake."""
    spark = df.sparkSession
    table = f"lintlake_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", f"{work_dir(spark)}/lintlake/{table}").bucketBy(buckets, *columns).saveAsTable(table)
    return spark.table(table)
