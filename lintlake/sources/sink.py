"""The findings store: attempts and a commit manifest.

``attempts/attempt_id=…`` holds the findings of one attempt to scan some jobs, written once and never touched again. ``manifest``
has one row for each job that an attempt has finished: which attempt, its number in order, how many findings it wrote and when. A job's
findings are those of its manifest row with the highest number. So an attempt that died half-way shows nowhere, a job in which
nothing is found any more has no findings, and publishing is one small append.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.session import written
from lintlake.sources.files import surely_not_in

JOB = "scan_job_id"
FINDING_SCHEMA = (
    "id STRING, scan_job_id STRING, file_path STRING, line_start INT, line_end INT, category STRING, severity STRING, confidence DOUBLE, "
    "title STRING, description STRING, masked_evidence STRING, fix_suggestion STRING, code_snippet STRING, detected_by STRING, created_at TIMESTAMP"
)
MANIFEST_SCHEMA = "scan_job_id STRING, attempt_id STRING, number BIGINT, n_findings BIGINT, created_at TIMESTAMP"


def finding_id(*columns: str):
    """A stable id from what identifies a finding, so that writing again gives the same ids."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def _columns(spark: SparkSession) -> list[tuple[str, str]]:
    return spark.createDataFrame([], FINDING_SCHEMA).dtypes


def write_findings(findings: DataFrame, jobs: DataFrame, path: str, number: int, created_at: datetime.datetime, attempt: str | None = None) -> str:
    """Store and publish the final findings of the ``jobs`` scanned in one attempt; returns the attempt's id.

    ``number`` orders the attempts of a job. Publishing the same number again (a repeated run) replaces the earlier attempt of that number: of equal numbers
    the later ``created_at`` counts, then the greater id. Columns that ``findings`` lacks are NULL, others than the store's are left out. Rows are written
    as they are spread, so a job of any size has many writers.
    """
    spark, attempt = findings.sparkSession, attempt or f"{number:012d}-{uuid.uuid4().hex}"
    stamp = F.lit(created_at).cast("timestamp")
    known = findings if "id" in findings.columns else findings.withColumn("id", finding_id(JOB, "file_path", "category", "line_start", "rule_id"))
    out = known.withColumn("created_at", stamp).select(
        *[(F.col(c) if c in known.columns or c == "created_at" else F.lit(None)).cast(t).alias(c) for c, t in _columns(spark)])
    out.write.mode("errorifexists").parquet(f"{path}/attempts/attempt_id={attempt}")
    # Counted from what is stored, so that a reader can tell whether all of it is still there.
    counts = spark.read.schema(FINDING_SCHEMA).parquet(f"{path}/attempts/attempt_id={attempt}").groupBy(JOB).agg(F.count("*").alias("n"))
    rows = jobs.select(JOB).distinct().join(counts, JOB, "left").select(
        JOB, F.lit(attempt).alias("attempt_id"), F.lit(number).cast("bigint").alias("number"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_findings"), stamp.alias("created_at"))
    rows.write.mode("append").parquet(f"{path}/manifest")
    return attempt


def published(spark: SparkSession, path: str) -> DataFrame:
    """The manifest row that counts, for each job."""
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest")
    return rows.groupBy(JOB).agg(F.max_by(F.struct("attempt_id", "number", "n_findings", "created_at"), F.struct("number", "created_at", "attempt_id")).alias("m")).select(JOB, "m.*")


def _attempts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{FINDING_SCHEMA}, attempt_id STRING").parquet(f"{path}/attempts")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Current findings of all jobs. The manifest is joined, never collected; partitions of attempts that no job needs are pruned at run time.

    Only (job, attempt) pairs are exchanged to find those that do not count. Findings whose pair is surely none of them are read as they lie; the
    others (in a store with few repeated attempts, few) meet the manifest.
    """
    stored, current, pair = _attempts(spark, path), published(spark, path).select(JOB, "attempt_id"), [JOB, "attempt_id"]
    stored = stored.join(F.broadcast(spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").select("attempt_id").distinct()), "attempt_id", "left_semi")
    dead = written(stored.select(*pair).distinct().join(current, pair, "left_anti"), "dead-attempts")
    sure, others = surely_not_in(stored, dead, pair)
    return sure.unionByName(others.join(current, pair, "left_semi")).drop("attempt_id")


def incomplete(spark: SparkSession, path: str) -> DataFrame:
    """Published (job, attempt) pairs whose stored rows are not as many as were published."""
    held = _attempts(spark, path).groupBy(JOB, "attempt_id").agg(F.count("*").alias("n_stored"))
    both = published(spark, path).join(held, [JOB, "attempt_id"], "left").withColumn("n_stored", F.coalesce("n_stored", F.lit(0)))
    return both.filter("n_stored <> n_findings").select(JOB, "attempt_id", "n_findings", "n_stored")


def superseded(spark: SparkSession, path: str) -> DataFrame:
    """Attempts that no job needs any more, for the cluster's retention to remove."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").select("attempt_id").distinct()
    return manifest.join(published(spark, path), "attempt_id", "left_anti")
