"""Users, scan jobs, stored findings, the result cache and job status, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.ordered import carry_last, sorted_chunks

# --- Fixed values: life of a cached result, and of a status record (scan timeout plus a minute) --
CACHE_TTL_SECONDS = 3600
STATUS_TTL_SECONDS = 300 + 60

REPO_KEY = ("repo_url", "commit_sha")
RESULT_COLUMNS = (
    "id", "file_path", "line_start", "line_end", "category", "severity", "confidence", "title", "description",
    "masked_evidence", "fix_suggestion", "detected_by",
)


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup of a user or a job."""
    return df.filter(F.col(column) == value)


def owned_jobs(jobs: DataFrame, callers: DataFrame) -> DataFrame:
    """Jobs asked for in (job_id, caller_id) by their owner; other people's requests give nothing."""
    asked = callers.select(F.col("job_id").alias("_job"), F.col("caller_id").alias("_caller")).distinct()
    return jobs.join(asked, (F.col("id") == F.col("_job")) & (F.col("user_id") == F.col("_caller")), "left_semi")


def job_results(jobs: DataFrame, findings: DataFrame, columns: tuple[str, ...] = RESULT_COLUMNS) -> DataFrame:
    """Each job with its stored findings, one row per finding (both sides keyed by the job).

    A job with a great many findings is a skewed key of this join: AQE splits it, repeating one job row.
    """
    job = jobs.select(F.col("id").alias("scan_job_id"), "repo_name", "commit_sha", "status", "total_files", "scanned_files")
    found = findings.select("scan_job_id", *[F.col(c).alias(f"finding_{c}" if c == "id" else c) for c in columns])
    if "id" not in columns:
        return job.join(found, "scan_job_id")
    # An id that is lower-case hexadecimal, as ``sink.finding_id`` makes them, travels as its bytes.
    id_, raw = F.col("finding_id"), F.unhex("finding_id")
    lean = found.withColumn("_bytes", F.when(F.lower(F.hex(raw)) == id_, raw)).withColumn("finding_id", F.when(F.col("_bytes").isNull(), id_))
    return job.join(lean, "scan_job_id").withColumn("finding_id", F.coalesce("finding_id", F.lower(F.hex("_bytes")))).drop("_bytes")


def user_findings(users: DataFrame, jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """Jobs and findings per user. Findings are counted per job before any join."""
    per_job = findings.groupBy("scan_job_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("severity") == "critical").alias("_critical"))
    per_user = (
        jobs.select("id", "user_id").join(per_job, F.col("id") == F.col("scan_job_id"), "left")
        .groupBy("user_id").agg(
            F.count("*").alias("_jobs"), F.count("_n").alias("_with"), F.sum("_n").alias("_n"), F.sum("_critical").alias("_critical"))
    )
    zero = F.lit(0)
    return users.select("id", "username").join(per_user, F.col("id") == F.col("user_id"), "left").select(
        "id", "username",
        F.coalesce("_jobs", zero).alias("n_jobs"),
        F.coalesce("_with", zero).alias("n_jobs_with_findings"),
        F.coalesce("_n", zero).alias("n_findings"),
        F.coalesce("_critical", zero).alias("n_critical"),
    )


def upsert_users(users: DataFrame, updates: DataFrame) -> DataFrame:
    """The next snapshot of ``users``: a known ``github_id`` takes only the new picture, an unknown one
    becomes a user with the name and e-mail of its first log-in and the picture of its last.

    ``updates`` has (github_id, username, email, avatar_url, seen_at, seq); access tokens are not kept.
    """
    when = F.struct("seen_at", "seq")
    batch = updates.groupBy("github_id").agg(
        F.min_by(F.struct("username", "email"), when).alias("_first"),
        F.max_by(F.struct("avatar_url"), when).alias("_last"),
    )
    known = users.select("github_id", "id", "username", "email", F.col("avatar_url").alias("_old_avatar"))
    return known.join(batch, "github_id", "full_outer").select(
        F.coalesce("id", F.concat(F.lit("gh-"), F.left(F.sha2("github_id", 256), F.lit(32)))).alias("id"),
        "github_id",
        F.when(F.col("id").isNull(), F.col("_first.username")).otherwise(F.col("username")).alias("username"),
        F.when(F.col("id").isNull(), F.col("_first.email")).otherwise(F.col("email")).alias("email"),
        F.when(F.col("_last").isNull(), F.col("_old_avatar")).otherwise(F.col("_last.avatar_url")).alias("avatar_url"),
    )


USER_BUCKETS = 256


def _bucketed(users: DataFrame, buckets: int) -> DataFrame:
    return users.withColumn("bucket", F.pmod(F.xxhash64("github_id"), F.lit(buckets)).cast("int"))


def write_users(users: DataFrame, path: str, buckets: int = USER_BUCKETS) -> None:
    """A snapshot of users in hash buckets of ``github_id``, one folder each."""
    _bucketed(users, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def merge_users(spark: SparkSession, updates: DataFrame, path: str, buckets: int = USER_BUCKETS) -> list[int]:
    """``upsert_users`` on a stored snapshot: only the buckets that the updates touch are read, and only those folders are replaced. Returns
    them (at most ``buckets`` numbers). ``buckets`` must be what the snapshot was written with."""
    touched = sorted(r["bucket"] for r in _bucketed(updates.select("github_id"), buckets).select("bucket").distinct().collect())
    if touched:
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
        new = _bucketed(upsert_users(old, updates), buckets)
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def job_states(events: DataFrame) -> DataFrame:
    """The current row of each job from its transitions (job_id, ts, seq, status, files_scanned, message).

    Every column keeps its own last write, as successive updates of one row would.
    """
    when = F.struct("ts", "seq")
    status = F.col("status")

    def last(value: Column, condition: Column) -> Column:
        return F.max_by(value, F.when(condition, when))

    ended = status.isin("completed", "failed")
    return events.groupBy("job_id").agg(
        F.max_by("status", when).alias("status"),
        F.min(F.when(status == "pending", F.col("ts"))).alias("created_at"),
        last(F.col("ts"), status == "running").alias("started_at"),
        last(F.col("ts"), ended).alias("completed_at"),
        F.coalesce(last(F.col("files_scanned"), status == "completed"), F.lit(0)).alias("scanned_files"),
        last(F.col("message"), status == "failed").alias("error_message"),
        F.lit(0).alias("total_files"),
    )


STATUS_FIELDS = ("status", "current_node", "message", "files_scanned", "total_files")


def latest_status(events: DataFrame) -> DataFrame:
    """The last status record of each job, taken as a whole: fields of older records do not show through."""
    when = F.struct("ts", "seq")
    return (
        events.groupBy("job_id").agg(F.max_by(F.struct("ts", *STATUS_FIELDS), when).alias("r"))
        .select("job_id", "r.*")
    )


def visible_status(events: DataFrame, as_of: Column, ttl_seconds: int = STATUS_TTL_SECONDS) -> DataFrame:
    """``latest_status`` of the records there were at ``as_of``, with ``visible``: false once the record has outlived its time."""
    return latest_status(events.filter(F.col("ts") <= as_of)).withColumn("visible", (F.unix_micros(as_of) - F.unix_micros("ts")) < ttl_seconds * 1_000_000)


def delete_status(statuses: DataFrame, deleted: DataFrame) -> DataFrame:
    return statuses.join(deleted.select("job_id").distinct(), "job_id", "left_anti")


def status_after_deletes(events: DataFrame, deletes: DataFrame) -> DataFrame:
    """``latest_status`` of records and deletes (job_id, ts, seq) in one order: a delete removes what came before it, and a
    record after it lives again. A delete of the same (ts, seq) as a record comes after it."""
    record = F.struct("ts", *STATUS_FIELDS)
    both = events.select("job_id", "ts", "seq", F.lit(0).alias("_kind"), record.alias("_r")).unionByName(
        deletes.select("job_id", "ts", "seq", F.lit(1).alias("_kind"), F.lit(None).cast(events.select(record.alias("r")).schema["r"].dataType).alias("_r")))
    last = both.groupBy("job_id").agg(F.max_by(F.struct("_kind", "_r"), F.struct("ts", "seq", "_kind")).alias("l"))
    return last.filter("l._kind = 0").select("job_id", "l._r.*")


def _slot(ts: Column, ttl_seconds: int) -> Column:
    return F.call_function("div", F.unix_micros(ts), F.lit(ttl_seconds * 1_000_000))


def cached_flags(requests: DataFrame, results: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """``requests`` with ``cached``: is a result valid at ``ts`` (completed_at <= ts < completed_at + ttl)?

    Time is cut into slots as long as a result lives. A result completed in the request's own slot is
    valid exactly when it is not later than the request, so only the earliest one of the slot matters;
    one from the slot before is valid until it expires, so only the latest one matters. That leaves one
    row per (repository, slot) and an equality join, however many results and requests a repository has.
    """
    done = F.col("completed_at")
    spread = F.explode(F.array(
        F.struct(_slot(done, ttl_seconds).alias("slot"), done.alias("same"), F.lit(None).cast("timestamp").alias("prior")),
        F.struct((_slot(done, ttl_seconds) + 1).alias("slot"), F.lit(None).cast("timestamp").alias("same"), done.alias("prior")),
    ))
    slots = (
        results.select(*REPO_KEY, spread.alias("s")).select(*REPO_KEY, "s.*")
        .groupBy(*REPO_KEY, "slot").agg(F.min("same").alias("_same"), F.max("prior").alias("_prior"))
    )
    valid_prior = F.unix_micros("ts") < F.unix_micros("_prior") + ttl_seconds * 1_000_000
    return (
        requests.withColumn("slot", _slot(F.col("ts"), ttl_seconds))
        .join(slots, [*REPO_KEY, "slot"], "left")
        .withColumn("cached", F.coalesce(F.col("ts") >= F.col("_same"), F.lit(False)) | F.coalesce(valid_prior, F.lit(False)))
        .drop("slot", "_same", "_prior")
    )


def requests_to_scan(requests: DataFrame, results: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """The incremental scan list: requests no valid result answers."""
    return cached_flags(requests, results, ttl_seconds).filter(~F.col("cached")).drop("cached")


def cache_hits(requests: DataFrame, results: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Requests answered from the cache, with the job whose result is returned: the latest one
    completed at or before the request, while it is valid."""
    asked = requests.select(*REPO_KEY, "ts", F.lit(1).alias("_kind"), "request_id", F.lit(None).cast("string").alias("_job"))
    done = results.select(*REPO_KEY, F.col("completed_at").alias("ts"), F.lit(0).alias("_kind"),
                          F.lit(None).cast("bigint").alias("request_id"), F.col("job_id").alias("_job"))
    both = asked.unionByName(done).withColumn("_result", F.when(F.col("_kind") == 0, F.struct(F.col("ts").alias("at"), "_job")))
    chunks = sorted_chunks(both, REPO_KEY, [F.asc("ts"), F.asc("_kind"), F.asc("_job"), F.asc("request_id")], "cache")
    seen = carry_last(chunks, REPO_KEY, "_result", "_seen").filter(F.col("_kind") == 1)
    return seen.filter(F.unix_micros("ts") < F.unix_micros("_seen.at") + ttl_seconds * 1_000_000).select(
        *REPO_KEY, "ts", "request_id", F.col("_seen._job").alias("job_id"), F.col("_seen.at").alias("completed_at"))
