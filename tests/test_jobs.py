import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lintlake.operators import jobs as J
from lintlake.operators import ordered
from lintlake.operators import replay as RP
from lintlake.operators.ordered import carry_last, sorted_chunks
from lintlake.streaming import admission, status
from lintlake.streaming import scan as stream_scan
from lintlake.operators.rulescan import scan_rules
from lintlake import rules as R

T0 = datetime(2024, 1, 1)
REQ = "repo_url string, commit_sha string, ts timestamp, request_id bigint"
RES = "repo_url string, commit_sha string, completed_at timestamp, job_id string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def log(n=4000, seed=5):
    """Requests of which one repository has most, some at the same moment."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.7 else f"r{rnd.randint(0, 9)}", "c", at(rnd.randint(0, 40_000)), i) for i in range(n)]


def decide(rows, ttl):
    valid, hits = {}, {}
    for repo, _, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        hit = repo in valid and ts < valid[repo]
        if not hit:
            valid[repo] = ts + timedelta(seconds=ttl)
        hits[i] = hit
    return hits


@pytest.mark.parametrize("ttl", [1, 7, 600, 3600, 100_000])
def test_replay_like_a_loop(spark, monkeypatch, ttl):
    monkeypatch.setattr(ordered, "CHUNK_BITS", 5)  # many chunks, so that they must be chained
    rows = log(1500) + [("gap", "c", at(t), 10_000 + t) for t in (0, ttl - 1, ttl, 3 * ttl, 3 * ttl + 1)]
    df = spark.createDataFrame(rows, REQ).repartition(5)
    got = {r["request_id"]: r["cached"] for r in RP.replay(df, ttl).collect()}
    assert got == decide(rows, ttl)


def test_chunk_functions_compose():
    """Cut one sorted log anywhere: chaining the pieces gives the decisions of the whole."""
    import pandas as pd

    rnd = random.Random(2)
    for _ in range(300):
        ttl = rnd.randint(1, 30)
        ts = sorted(rnd.randint(0, 120) for _ in range(rnd.randint(2, 30)))
        cuts = sorted({0, len(ts), *(rnd.randint(0, len(ts)) for _ in range(4))})
        chunks = [pd.DataFrame({"repo_url": "r", "commit_sha": "c", "chunk": n, "us": ts[a:b], "request_id": range(a, b), "ts": ts[a:b],
                                "pos": range(b - a)}) for n, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        steps = pd.concat([RP._summary_fn(ttl)(c) for c in chunks])
        # The pointers of the module, followed one by one.
        entry, valid = {}, RP.NONE_YET
        for n in range(len(chunks)):
            entry[chunks[n]["chunk"].iloc[0]] = valid
            own = steps[(steps["chunk"] == chunks[n]["chunk"].iloc[0]) & (steps["until"] >= valid)]
            if len(own):
                valid = int(own.sort_values("until")["leave"].iloc[0])
        got = [v for c in chunks for v in RP._flag_fn(ttl)(c.assign(valid=entry[c["chunk"].iloc[0]]))["cached"]]
        valid, want = None, []
        for t in ts:
            want.append(valid is not None and t < valid)
            if not want[-1]:
                valid = t + ttl
        assert got == want


def test_cache_boundaries_and_brute_force(spark):
    ttl = 3600
    rnd = random.Random(9)
    results = [("hot" if rnd.random() < 0.6 else f"r{rnd.randint(0, 9)}", "c", at(rnd.randint(0, 40_000)), f"job-{i:04d}") for i in range(60)]
    results += [("edge", "c", at(1000), "e1")]
    requests = log(800) + [("edge", "c", at(t), 20_000 + t) for t in (999, 1000, 1000 + ttl - 1, 1000 + ttl)]
    req, res = spark.createDataFrame(requests, REQ).repartition(4), spark.createDataFrame(results, RES)
    want = {}
    for repo, _, ts, i in requests:
        past = [(c, job) for r, _, c, job in results if r == repo and c <= ts]
        if past and ts < max(past)[0] + timedelta(seconds=ttl):
            want[i] = max(past)[1]
    assert {20_000 + 1000, 20_000 + 1000 + ttl - 1} == {i for i in want if i >= 20_000}
    assert {r["request_id"]: r["job_id"] for r in J.cache_hits(req, res, ttl).collect()} == want
    todo = {r["request_id"] for r in J.requests_to_scan(req, res, ttl).collect()}
    assert todo == {r[3] for r in requests} - set(want)


def test_carry_last_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_BITS", 4)
    rnd = random.Random(4)
    rows = [("a" if rnd.random() < 0.8 else "b", i, rnd.choice([None, None, i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(6)
    got = {r["i"]: r["o"] for r in carry_last(sorted_chunks(df, ("k",), [F.asc("i")], "t"), ("k",), "v", "o").collect()}
    last, want = {}, {}
    for k, i, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert got == want


def test_upsert_keeps_names_of_known_users(spark):
    users = spark.createDataFrame([("u1", "1", "ann", None, "old"), ("u2", "2", "bob", "b@x", "old")],
                                  "id string, github_id string, username string, email string, avatar_url string")
    logins = spark.createDataFrame([("1", "ann2", "a@x", "new1", at(1), 1), ("1", "ann3", "a@y", None, at(2), 2),
                                    ("3", "cy", "c@x", "p1", at(1), 3), ("3", "cy2", None, "p2", at(1), 4)],
                                   "github_id string, username string, email string, avatar_url string, seen_at timestamp, seq int")
    got = {r["github_id"]: (r["username"], r["email"], r["avatar_url"]) for r in J.upsert_users(users, logins).collect()}
    assert got == {"1": ("ann", None, None), "2": ("bob", "b@x", "old"), "3": ("cy", "c@x", "p2")}


EVENT = "job_id string, ts timestamp, seq bigint, status string, current_node string, message string, files_scanned int, total_files int"


def test_job_states_and_status_life(spark):
    rows = [("a", at(0), 1, "pending", "queue", "queued", 0, 0), ("a", at(5), 2, "running", "fetcher", "go", 0, 9),
            ("a", at(9), 3, "failed", None, "boom", 0, 9), ("a", at(20), 4, "running", "fetcher", "again", 0, 9),
            ("a", at(30), 5, "completed", "reporter", "done", 7, 9), ("b", at(0), 6, "pending", "queue", "queued", 0, 0)]
    df = spark.createDataFrame(rows, EVENT)
    a = J.job_states(df).filter("job_id = 'a'").first()
    assert (a["status"], a["created_at"], a["started_at"], a["completed_at"], a["scanned_files"], a["error_message"]) == (
        "completed", at(0), at(20), at(30), 7, "boom")
    seen = {r["job_id"]: (r["status"], r["message"], r["visible"]) for r in J.visible_status(df, F.lit(at(360)).cast("timestamp")).collect()}
    assert seen == {"a": ("completed", "done", True), "b": ("pending", "queued", False)}
    left = J.delete_status(J.latest_status(df), spark.createDataFrame([("a",), ("a",)], "job_id string"))
    assert [r["job_id"] for r in left.collect()] == ["b"]


def test_only_owners_see_results(spark):
    jobs = spark.createDataFrame([("j1", "u1", "o/r", "c", "completed", 0, 5), ("j2", "u2", "o/r", "c", "completed", 0, 5)],
                                 "id string, user_id string, repo_name string, commit_sha string, status string, total_files int, scanned_files int")
    callers = spark.createDataFrame([("j1", "u1"), ("j1", "u1"), ("j2", "u1")], "job_id string, caller_id string")
    found = spark.createDataFrame([("j1", "f1"), ("j1", "f2"), ("j2", "f3")], "scan_job_id string, id string")
    got = J.job_results(J.owned_jobs(jobs, callers), found, ("id",)).collect()
    assert sorted(r["finding_id"] for r in got) == ["f1", "f2"]
    assert J.by_key(jobs, "id", "j2").count() == 1


def run_stream(spark, stream, tmp_path, mode="append"):
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def in_batches(spark, rows, schema, folder):
    """A file stream that delivers ``rows`` in time order, one file per micro-batch."""
    folder = str(folder)
    for i in range(0, len(rows), max(1, len(rows) // 4)):
        spark.createDataFrame(rows[i:i + max(1, len(rows) // 4)], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_scan_is_the_batch_scan(spark, tmp_path):
    schema = "repo_url string, commit_sha string, type string, path string, size bigint, content string"
    rows = [("r", "c", "blob", f"f{i}.py", 10, "exec(x)\nDEBUG = True" if i % 3 else "x = 1") for i in range(12)] + [
        ("r", "c", "blob", "big.py", 600_000, "DEBUG = True"), ("r", "c", "tree", "d.py", 1, None)]
    got = run_stream(spark, stream_scan.scan_stream(in_batches(spark, rows, schema, tmp_path / "in")), tmp_path)
    key = lambda d: sorted((r["file_path"], r["rule_id"], r["line_start"]) for r in d.collect())
    want = scan_rules(spark.createDataFrame([r for r in rows if r[3] not in ("big.py", "d.py")], schema), R.ALL_RULES)
    assert key(got) == key(want) != []


@pytest.mark.parametrize("ttl", [600, 20_000])
def test_stream_admission_over_several_batches(spark, tmp_path, monkeypatch, ttl):
    monkeypatch.setattr(ordered, "CHUNK_BITS", 5)  # the hot repository lies in many chunks
    rows = sorted(log(400), key=lambda r: (r[2], r[3]))
    path = str(tmp_path / "table")
    admission.follow_requests(in_batches(spark, rows, REQ, tmp_path / "in"), ttl, path, str(tmp_path / "progress")).awaitTermination()
    ids = lambda: sorted(r["request_id"] for r in admission.admitted(spark, path).collect())
    want = sorted(i for i, hit in decide(rows, ttl).items() if not hit)
    assert ids() == want
    # Batches run again, also an earlier one, change nothing; a late request before the validity is a hit, one after it is admitted.
    quarter = [spark.createDataFrame(rows[i:i + 100], REQ) for i in range(0, 400, 100)]
    for n in (3, 1):
        admission.admit_batch(quarter[n], n, path, ttl)
    spark.catalog.refreshByPath(path)
    assert ids() == want
    end = max(r[2] for r in rows)
    late = [("hot", "c", rows[5][2], 90_001), ("hot", "c", end + timedelta(seconds=ttl), 90_002), ("hot", "c", end + timedelta(seconds=ttl), 90_003)]
    admission.admit_batch(spark.createDataFrame(late, REQ), 4, path, ttl)
    assert ids() == sorted([*want, 90_002])
    state = lambda: {r["repo_url"]: r["_valid"] for r in admission.validity(spark, path, 5).collect()}
    before = state()
    admission.forget(spark, path, 4, 0)
    spark.catalog.refreshByPath(path)
    assert state() == before


def test_approximate_admission(spark, tmp_path):
    rows = sorted(log(400), key=lambda r: (r[2], r[3]))
    stream = admission.admit_approximately(in_batches(spark, rows, REQ, tmp_path / "in"), 3600)
    got = run_stream(spark, stream, tmp_path).collect()
    exact = [i for i, hit in decide(rows, 3600).items() if not hit]
    assert {r["repo_url"] for r in got} == {r[0] for r in rows} and len(got) <= len(exact) and len({r["request_id"] for r in got}) == len(got)


def test_stream_status(spark, tmp_path):
    rows = [(f"j{i % 3}", at(i), i, "running", "fetcher", f"m{i}", i, 9) for i in range(40)]
    table = str(tmp_path / "table")
    status.tail_status(in_batches(spark, rows, EVENT, tmp_path / "in"), table, str(tmp_path / "progress")).awaitTermination()
    said = lambda: {r["job_id"]: r["message"] for r in status.current_status(spark, table).collect()}
    assert said() == {"j0": "m39", "j1": "m37", "j2": "m38"}
    held = lambda: spark.read.parquet(table).count()
    n = held()
    # The same batch again changes nothing, whatever it holds late.
    last = spark.createDataFrame(rows[-10:], EVENT)
    batches = sorted(r["batch_id"] for r in spark.read.parquet(table).select("batch_id").distinct().collect())
    assert len(batches) >= 4
    status.append_batch(last, batches[-1], table)
    status.append_batch(last, batches[-1], table)
    assert held() == n and said() == {"j0": "m39", "j1": "m37", "j2": "m38"}
    status.append_batch(spark.createDataFrame([("j1", at(5), 5, "running", "x", "late", 0, 0), ("new", at(1), 1, "pending", "x", "n", 0, 0)], EVENT), 99, table)
    assert said() == {"j0": "m39", "j1": "m37", "j2": "m38", "new": "n"}
    q = (J.latest_status(in_batches(spark, rows, EVENT, tmp_path / "in2")).writeStream.outputMode("update").format("memory")
         .queryName("tail").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("tail").filter("message = 'm39'").count() == 1


def test_deletes_take_their_place_among_records(spark):
    rows = [("a", at(0), 1, "pending", "q", "1", 0, 0), ("a", at(9), 4, "running", "q", "4", 0, 0), ("b", at(1), 2, "running", "q", "2", 0, 0),
            ("c", at(1), 3, "running", "q", "3", 0, 0), ("d", at(5), 5, "running", "q", "5", 0, 0)]
    gone = [("a", at(5), 2), ("b", at(1), 3), ("c", at(1), 2), ("d", at(5), 5), ("nobody", at(0), 0), ("a", at(5), 2)]
    left = J.status_after_deletes(spark.createDataFrame(rows, EVENT), spark.createDataFrame(gone, "job_id string, ts timestamp, seq bigint"))
    assert {r["job_id"]: r["message"] for r in left.collect()} == {"a": "4", "c": "3"}
    assert left.columns == J.latest_status(spark.createDataFrame(rows, EVENT)).columns


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    import pathlib

    schema = "github_id string, username string, email string, avatar_url string, seen_at timestamp, seq bigint"
    users = spark.createDataFrame([(f"u{i}", f"g{i}", f"n{i}", None, f"a{i}") for i in range(200)], "id string, github_id string, username string, email string, avatar_url string")
    path = str(tmp_path / "users")
    J.write_users(users, path, 32)
    files = lambda: {(int(f.parent.name.split("=")[1]), f.name) for f in pathlib.Path(path).glob("bucket=*/part-*")}
    before = files()
    updates = spark.createDataFrame([("g3", "x", None, "new", at(1), 1), ("g3", "y", None, "newer", at(2), 2), ("fresh", "f", "e", "p", at(1), 3)], schema)
    touched = J.merge_users(spark, updates, path, 32)
    after = files()
    assert 1 <= len(touched) <= 2
    assert {f for f in before if f[0] not in touched} == {f for f in after if f[0] not in touched} and len(before & after) > 20
    assert not {f for f in before if f[0] in touched} & after
    spark.catalog.refreshByPath(path)
    rows = lambda df: sorted(tuple(r) for r in df.select(*users.columns).fillna("").collect())
    assert rows(J.read_users(spark, path)) == rows(J.upsert_users(users, updates))
    assert J.merge_users(spark, updates.limit(0), path, 32) == [] and files() == after


def test_result_store(spark, tmp_path):
    from lintlake.operators import resultstore as RS

    rnd, ttl, path = random.Random(3), 600, str(tmp_path / "results")
    kept = [(f"r{rnd.randint(0, 5)}", "c", f"j{i}", at(rnd.randint(0, 20_000)), '{"risk_score":%d,"n":null,"f":[{"t":"é"}]}' % i) for i in range(200)]
    reports = spark.createDataFrame(kept, "repo_url string, commit_sha string, job_id string, stored_at timestamp, report string")
    RS.put(reports.limit(120), path, ttl)
    RS.put(reports.subtract(reports.limit(120)).unionByName(reports.limit(3)), path, ttl)  # some entries twice
    asked = log(300) + [(f"r{i % 6}", "c", at(i * 60), 50_000 + i) for i in range(300)]
    req = spark.createDataFrame(asked, REQ)

    def want(rows):
        out = {}
        for repo, _, ts, i in asked:
            past = [(t, j) for r, _, j, t, _ in rows if r == repo and t <= ts]
            if past and ts < max(past)[0] + timedelta(seconds=ttl):
                out[i] = {j for t, j in past if t == max(past)[0]}
        return out

    got = RS.probe(req, path).select("request_id", "job_id", RS.field(F.col("report"), "$.risk_score", "int").alias("s"), RS.field(F.col("report"), "$.f[0].t", "string").alias("t"),
                                     RS.field(F.col("report"), "$.missing", "int").alias("m")).collect()
    w = want(kept)
    assert len(got) == len(w) > 100 and all(r["job_id"] in w[r["request_id"]] and f"j{r['s']}" == r["job_id"] and r["t"] == "é" and r["m"] is None for r in got)
    # Compaction keeps whatever can still answer.
    later = RS.compact(spark, path, F.lit(at(10_000)).cast("timestamp"))
    n = RS.stored(spark, later).count()
    assert n < 200
    after = {r["request_id"] for r in RS.probe(req.filter(F.col("ts") >= F.lit(at(10_000)).cast("timestamp")), later).collect()}
    assert after == {i for repo, _, ts, i in asked if i in w and ts >= at(10_000)}
    assert RS.probe(req.limit(0), path).count() == 0
