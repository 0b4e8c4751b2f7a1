"""Job-status tail: a stream of status records into a status table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.jobs import STATUS_FIELDS, latest_status
from lintlake.session import work_dir

STATUS_SCHEMA = "job_id STRING, ts TIMESTAMP, seq BIGINT, status STRING, current_node STRING, message STRING, files_scanned INT, total_files INT"


def newest(events: DataFrame) -> DataFrame:
    """The newest record of each job, with its place in the order."""
    r = F.max_by(F.struct("ts", "seq", *STATUS_FIELDS), F.struct("ts", "seq"))
    return events.groupBy("job_id").agg(r.alias("r")).select("job_id", "r.*")


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Reduce one micro-batch to the newest record of each job and store it under the batch's number. A batch that is run
    again replaces what it wrote before, so replays change nothing."""
    newest(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each job over all batches, whatever their order."""
    return latest_status(spark.read.schema(f"{STATUS_SCHEMA}, batch_id BIGINT").parquet(path))


def tail_status(events: DataFrame, path: str, progress: str):
    """Start to follow a stream of status records; the newest record of each job is found in the JVM, batch by batch."""
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, path))
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def followed(events: DataFrame) -> DataFrame:
    """Follow what is available into a table in the shared folder and return the current status."""
    spark = events.sparkSession
    base = f"{work_dir(spark)}/lintlake/stream-status-{uuid.uuid4().hex}"
    tail_status(events, f"{base}/table", f"{base}/progress").awaitTermination()
    return current_status(spark, f"{base}/table")
