"""The store of scan results: whole reports by cache key, valid for a time, with compaction of what has expired.

A put appends rows; nothing is rewritten. The report is a VARIANT, so any field of it can be asked for without a schema. A probe meets, for
each request, the last report stored at or before it, while that is valid: which one is found along the time order on keys and times
alone, and the report is fetched by its row's name afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import cache_key
from lintlake.operators.jobs import CACHE_TTL_SECONDS
from lintlake.operators.ordered import carry_last, sorted_chunks

SCHEMA = "cache_key STRING, entry STRING, job_id STRING, stored_at TIMESTAMP, expires_at TIMESTAMP, report VARIANT"


def put(reports: DataFrame, path: str, ttl_seconds: int = CACHE_TTL_SECONDS) -> None:
    """Store (repo_url, commit_sha, job_id, stored_at, report) rows; ``report`` is JSON text or a VARIANT. Text that is no JSON is an error."""
    is_text = reports.schema["report"].dataType.simpleString() == "string"
    expires = F.timestamp_micros(F.unix_micros("stored_at") + ttl_seconds * 1_000_000)
    key = cache_key(F.col("repo_url"), F.col("commit_sha"))
    # The same job stored again at the same time is the same entry.
    entry = F.sha2(F.concat_ws("\x1f", key, "job_id", F.unix_micros("stored_at").cast("string")), 256)
    reports.select(key.alias("cache_key"), entry.alias("entry"), "job_id", "stored_at", expires.alias("expires_at"),
                   (F.parse_json("report") if is_text else F.col("report")).alias("report")).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def probe(requests: DataFrame, path: str) -> DataFrame:
    """``requests`` (repo_url, commit_sha, ts, request_id) that a stored report answers, with its job_id, stored_at and report."""
    entries = stored(requests.sparkSession, path)
    none = lambda t: F.lit(None).cast(t)
    asked = requests.select(cache_key(F.col("repo_url"), F.col("commit_sha")).alias("cache_key"), "ts", F.lit(1).alias("_kind"), none("string").alias("_entry"),
                            none("timestamp").alias("_expires"), F.struct("repo_url", "commit_sha", "request_id").alias("_asked"))
    held = entries.select("cache_key", F.col("stored_at").alias("ts"), F.lit(0).alias("_kind"), F.col("entry").alias("_entry"), F.col("expires_at").alias("_expires"),
                          none(asked.schema["_asked"].dataType.simpleString()).alias("_asked"))
    both = asked.unionByName(held).withColumn("_last", F.when(F.col("_kind") == 0, F.struct("_entry", "_expires")))
    chunks = sorted_chunks(both, ("cache_key",), [F.asc("ts"), F.asc("_kind"), F.asc("_entry"), F.asc("_asked.request_id")], "result-probe")
    seen = carry_last(chunks.drop("_entry", "_expires"), ("cache_key",), "_last", "_seen").filter((F.col("_kind") == 1) & (F.col("ts") < F.col("_seen._expires")))
    found = seen.select("cache_key", "_asked.*", "ts", F.col("_seen._entry").alias("entry"))
    # An entry that a retried put stored twice is one report.
    reports = entries.groupBy("entry").agg(F.first("job_id").alias("job_id"), F.first("stored_at").alias("stored_at"), F.first("report").alias("report"))
    return found.join(reports, "entry").drop("entry")


def field(report: Column, path: str, kind: str) -> Column:
    """A field of a report, NULL where it is missing or of another kind."""
    return F.try_variant_get(report, path, kind)


def compact(spark: SparkSession, path: str, as_of: Column) -> str:
    """Write what can still answer a request at or after ``as_of`` to a folder beside ``path`` and return that. Of a key's entries
    stored by then only the last one counts, if it hasn't expired; later ones all stay."""
    rows = stored(spark, path).dropDuplicates(["entry"])
    last = rows.filter(F.col("stored_at") <= as_of).groupBy("cache_key").agg(F.max_by("entry", F.struct("stored_at", "entry")).alias("_entry"))
    kept = rows.join(last, "cache_key", "left").filter((F.col("stored_at") > as_of) | ((F.col("entry") == F.col("_entry")) & (F.col("expires_at") > as_of)))
    out = f"{path.rstrip('/')}-compacted-{uuid.uuid4().hex}"
    kept.drop("_entry").write.parquet(out)
    return out
