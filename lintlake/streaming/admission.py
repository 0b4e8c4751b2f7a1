"""Admission of scan requests: at most one per repository and commit within the life of a result.

Exact form: each micro-batch is decided by the batch replay, which cuts a repository's requests into bounded chunks however
hot it is. What is kept between batches is one number per repository, until when its result is valid; requests before that are hits and
leave first. Admissions and new validities are stored under the batch's number, and a batch reads only what earlier ones stored, so
a batch that is run again gives the same rows in the same place.

Approximate form: Spark's own deduplication within the watermark, with state in the JVM that expires by itself. It passes the first request
to *arrive* and forgets it when the watermark has passed its time by the TTL, so it may pass fewer requests than the exact form, never more at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.replay import replay
from lintlake.session import work_dir

REPO_KEY = ("repo_url", "commit_sha")
ADMITTED_SCHEMA = "repo_url STRING, commit_sha STRING, request_id BIGINT, ts TIMESTAMP"
STATE_SCHEMA = "repo_url STRING, commit_sha STRING, valid BIGINT, batch_id BIGINT"


def _store(df: DataFrame, batch_id: int, path: str) -> None:
    # A folder of its own for each batch, also for one that admits nothing.
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def validity(spark: SparkSession, path: str, before_batch: int) -> DataFrame:
    """Until when a result is valid (microseconds), per repository, after the batches before ``before_batch``. Validities only grow."""
    rows = spark.read.schema(STATE_SCHEMA).parquet(f"{path}/state").filter(F.col("batch_id") < before_batch)
    return rows.groupBy(*REPO_KEY).agg(F.max("valid").alias("_valid"))


def admit_batch(batch: DataFrame, batch_id: int, path: str, ttl_seconds: int) -> None:
    """Decide one micro-batch of (repo_url, commit_sha, ts, request_id) and store what it admits and leaves behind."""
    spark = batch.sparkSession
    if batch_id == 0:
        _store(spark.createDataFrame([], "repo_url STRING, commit_sha STRING, valid BIGINT"), -1, f"{path}/state")
    open_ = batch.join(validity(spark, path, batch_id), list(REPO_KEY), "left").filter(F.col("_valid").isNull() | (F.unix_micros("ts") >= F.col("_valid")))
    passed = replay(open_.drop("_valid"), ttl_seconds).filter(~F.col("cached")).select(*REPO_KEY, "request_id", "ts")
    _store(passed, batch_id, f"{path}/admitted")
    stored = spark.read.schema(ADMITTED_SCHEMA).parquet(f"{path}/admitted/batch_id={batch_id}")
    _store(stored.groupBy(*REPO_KEY).agg((F.max(F.unix_micros("ts")) + ttl_seconds * 1_000_000).alias("valid")), batch_id, f"{path}/state")


def forget(spark: SparkSession, path: str, upto_batch: int, before_micros: int) -> None:
    """Put the validities of the batches up to ``upto_batch`` that reach beyond ``before_micros`` into the last one's folder, so that state doesn't
    grow with the repositories ever seen. The folders before it may then be removed. For requests that are never older than ``before_micros``."""
    left = validity(spark, path, upto_batch + 1).filter(F.col("_valid") > before_micros).withColumnRenamed("_valid", "valid")
    kept = f"{path}/compacted-{uuid.uuid4().hex}"
    left.write.parquet(kept)
    _store(spark.read.schema("repo_url STRING, commit_sha STRING, valid BIGINT").parquet(kept), upto_batch, f"{path}/state")


def follow_requests(requests: DataFrame, ttl_seconds: int, path: str, progress: str):
    """Start to decide a stream of requests, batch by batch, into a table of admitted ones."""
    return (
        requests.writeStream.foreachBatch(lambda batch, batch_id: admit_batch(batch, batch_id, path, ttl_seconds))
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def admitted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ADMITTED_SCHEMA}, batch_id BIGINT").parquet(f"{path}/admitted").drop("batch_id")


def admit_requests(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Decide what is available of a stream, into a table in the shared folder, and return the admitted requests."""
    spark = requests.sparkSession
    base = f"{work_dir(spark)}/lintlake/stream-admission-{uuid.uuid4().hex}"
    follow_requests(requests, ttl_seconds, base, f"{base}/progress").awaitTermination()
    return admitted(spark, base)


def admit_approximately(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """The stream of requests that are the first of their repository to arrive, until the watermark is ``ttl_seconds`` past them."""
    return requests.withWatermark("ts", f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(list(REPO_KEY))
