"""Cases from the review of the third round."""

import datetime
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lintlake.operators import findings as FI
from lintlake.operators import ordered

JOB = ("scan_job_id",)


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def stored(spark):
    """A hot job, NULL jobs, places and categories, many copies."""
    n = F.col("id")
    job = F.when(n % 3 == 0, F.lit("hot")).when(n % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("j"), (n % 97).cast("string")))
    return spark.range(3000).select(
        job.alias("scan_job_id"), F.concat(F.lit("f"), (n % 7).cast("string")).alias("file_path"), F.when(n % 5 > 0, (n % 5).cast("int")).alias("line_start"),
        F.when(n % 11 > 0, F.concat(F.lit("c"), (n % 11).cast("string"))).alias("category"), F.element_at(F.array(*[F.lit(s) for s in ("low", "high", "critical")]), (n % 3 + 1).cast("int")).alias("severity"),
        (n % 4 / 4).alias("confidence"), (n % 13).alias("det_ordinal"), F.sha2(n.cast("string"), 256).alias("id"))


@pytest.mark.parametrize("bits", [4, 18])
def test_stored_findings_are_sorted_after_one_exchange(spark, monkeypatch, bits):
    monkeypatch.setattr(ordered, "CHUNK_BITS", bits)
    monkeypatch.setattr(ordered, "TASK_BITS", bits)
    df = stored(spark)
    rows = lambda x: sorted(map(str, x.select(sorted(x.columns)).collect()))
    kept = FI.deduplicate(df, JOB, ("id",))
    assert rows(FI.deduplicate_stored(df, JOB, ("id",))) == rows(kept)
    both = FI.deduplicated_and_ranked_stored(df, JOB, ("id",))
    assert rows(both) == rows(FI.ranked(kept, JOB, ("id",)))
    if bits == 18:
        assert "Exchange" not in plan(both)
        assert plan(FI.deduplicate_stored(df, JOB, ("id",))).count("Exchange hashpartitioning") == 1
        assert FI.deduplicated_and_ranked_stored(df.limit(0), JOB, ("id",)).count() == 0


def test_replay_hands_bounded_groups_to_python(spark):
    from lintlake.operators import replay as RP

    n = F.col("id")
    log = spark.range(60_000).coalesce(1).select(F.lit("r").alias("repo_url"), F.lit("c").alias("commit_sha"), n.alias("request_id"), F.timestamp_seconds(n * 7).alias("ts"))
    chunks = ordered.sorted_chunks(log.withColumn("us", F.unix_micros("ts")), RP.REPO_KEY, [F.asc("ts"), F.asc("request_id")], "t", RP.PYTHON_BITS)
    assert chunks.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 1 << 15
    got = {r["request_id"]: r["cached"] for r in RP.replay(log, 1000).collect()}
    last, want = None, {}
    for i in range(60_000):
        want[i] = last is not None and i * 7 < last + 1000
        last = last if want[i] else i * 7
    assert got == want


def test_stored_findings_that_surely_count_are_not_exchanged(spark, tmp_path):
    from lintlake.sources import sink

    day = lambda n: datetime.datetime(2024, 1, n, tzinfo=datetime.UTC)
    names = [f"j{i}" for i in range(300)]
    jobs = spark.createDataFrame([(j,) for j in names], "scan_job_id string")
    # Findings of a job that the attempt does not publish, and of no job at all.
    found = spark.createDataFrame([(f"{j}-{i}", j, "a.py") for j in [*names, "stray", None] for i in range(3)], "id string, scan_job_id string, file_path string")
    path = str(tmp_path / "store")
    sink.write_findings(found, jobs, path, 1, day(1))
    sink.write_findings(found.filter("scan_job_id = 'j7'").limit(1), jobs.filter("scan_job_id IN ('j7', 'j8')"), path, 2, day(2))
    found.limit(9).selectExpr("*", "now() AS created_at").write.parquet(f"{path}/attempts/attempt_id=died")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = sink.read_findings(spark, path)
        assert "Union" in plan(read) and plan(read).count("SortMergeJoin") == 1
        got = [(r["scan_job_id"], r["created_at"].day) for r in read.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got) == sorted([(j, 1) for j in names if j not in ("j7", "j8") for _ in range(3)] + [("j7", 2)])


def test_ids_travel_as_bytes(spark):
    from lintlake.operators import jobs as J

    ids = ["ab" * 32, "AB" * 32, "abc", "0", "", "zz", "0a", None, "é"]
    others = [F.lit(None).cast("string").alias(c) for c in J.RESULT_COLUMNS if c != "id"]
    found = spark.createDataFrame([("a", i) for i in ids], "scan_job_id string, id string").select("scan_job_id", "id", *others)
    jobs = spark.createDataFrame([("a", "n", "c", "s", 1, 1)], "id string, repo_name string, commit_sha string, status string, total_files int, scanned_files int")
    got = J.job_results(jobs, found)
    assert sorted(map(str, ids)) == sorted(str(r["finding_id"]) for r in got.collect())
    assert "unhex" in plan(got)


def test_start_weights_come_from_all_training_texts(spark, monkeypatch):
    from lintlake.llm import lm_mixing as lm

    seen = []

    def fitted(texts, tables, *others):
        seen.extend(bytes(r["text"]) for t in (texts, *[o[0] for o in others]) for r in t.collect())
        return lm._start()

    monkeypatch.setattr(lm, "_fitted", fitted)
    rows = [(i, f"text {i}") for i in range(60)]
    lm.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(seen) == sorted(t.encode() for _, t in rows)
