import datetime
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lintlake.operators import findings as FI
from lintlake.operators import ordered
from lintlake.operators import responses as RE
from lintlake.rules import SEVERITIES
from lintlake.sources import sink

SCHEMA = ("scan_job_id string, file_path string, line_start int, category string, severity string, confidence double, "
          "title string, rule_id string, det_ordinal bigint")
JOB = ("scan_job_id",)


def make(spark, n=3000, seed=3):
    """Findings of which one job has most."""
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.8 else f"j{rnd.randint(0, 5)}", f"f{rnd.randint(0, 400)}", rnd.choice([None, 0, 1, 2]),
             rnd.choice(["ssrf", "redos"]), rnd.choice([*SEVERITIES, "odd"]), rnd.choice([0.5, 0.8]), f"t{i}", "R", i) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(13)


def dedup(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r[8]):
        key = (r[0], r[1], r[3], r[2] or 0)
        if key not in seen:
            seen.add(key)
            out.append(r)
    return out


def test_first_detected_wins_whatever_the_order(spark):
    rows, df = make(spark)
    want = {r[8] for r in dedup(rows)}
    for parts in (1, 7, 40):
        assert {r["det_ordinal"] for r in FI.deduplicate(df.repartition(parts), JOB).collect()} == want


def test_rank_is_a_stable_sort_even_for_a_hot_job(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_BITS", 6)
    rows, df = make(spark)
    got = {(r["scan_job_id"], r["rank_in_job"]): r["det_ordinal"] for r in FI.ranked(df, JOB).collect()}
    order = {s: i for i, s in enumerate(SEVERITIES)}
    want = {}
    for job in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: (order.get(r[4], 99), -r[5], r[1], r[8]))
        want.update({(job, i + 1): r[8] for i, r in enumerate(mine)})
    assert got == want


def test_both_rankings_agree(spark, monkeypatch):
    """A hot group over many chunks, groups that end in the middle of chunks, NULL keys, an empty table."""
    monkeypatch.setattr(ordered, "CHUNK_BITS", 4)
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))).alias("g"),
        F.xxhash64("id").alias("v"), "id")
    want = {r["id"]: r["n"] for r in df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("v")).alias("n")).collect()}
    assert {r["id"]: r["n"] for r in ordered.rank_in_buckets(df, ("g",), [F.asc("v")], "n").collect()} == want
    assert ordered.rank_in_buckets(df.limit(0), ("g",), [F.asc("v")], "n").count() == 0


def test_risk_is_capped_and_jobs_without_findings_score_zero(spark):
    def job(name, **counts):
        return [(name, f"f{i}{s}", 1, "ssrf", s, 0.5, "t", "R", i) for s, n in counts.items() for i in range(n)]

    rows = job("a", critical=9, medium=4, low=1) + job("b", critical=10) + job("c", critical=10, low=1) + job("d", info=3)
    jobs = spark.createDataFrame([(x,) for x in "abcde"], "scan_job_id string")
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["scan_job_id"]: (r["risk_score"], r["n_findings"]) for r in FI.risk_scores(jobs, df, JOB).collect()}
    assert got == {"a": (99, 14), "b": (100, 10), "c": (100, 11), "d": (0, 3), "e": (0, 0)}
    summary = {r["scan_job_id"]: r for r in FI.summary(jobs, df, JOB).collect()}
    assert summary["a"]["severity_counts"] == {"critical": 9, "high": 0, "medium": 4, "low": 1, "info": 0}
    assert summary["e"]["category_counts"] == {} and summary["e"]["risk_score"] == 0
    assert summary["c"]["category_counts"] == {"ssrf": 11} and summary["c"]["critical_count"] == 10


def test_report_pages_hold_everything_in_order(spark):
    rows, df = make(spark, 500)
    jobs = spark.createDataFrame([(j,) for j in {r[0] for r in rows} | {"none"}], "scan_job_id string")
    ranked = FI.ranked(df, JOB)
    pages = FI.report_pages(FI.summary(jobs, df, JOB), ranked, JOB, ("file_path", "det_ordinal"), page_rows=16).collect()
    want = {(r["scan_job_id"], r["rank_in_job"]): r["det_ordinal"] for r in ranked.collect()}
    got = {(p["scan_job_id"], f["rank_in_job"]): f["det_ordinal"] for p in pages for f in p["findings"] or []}
    assert got == want
    for p in pages:
        nos = [f["rank_in_job"] for f in p["findings"] or []]
        assert nos == sorted(nos) and len(nos) <= 16 and all((n - 1) // 16 == p["page"] for n in nos)
    assert [(p["page"], p["pages"], p["findings"]) for p in pages if p["scan_job_id"] == "none"] == [(0, 1, None)]


def test_responses_case_by_case(spark):
    item = '{"findings":[%s]}'
    cases = {
        item % '{"title":"T"}': [("ai_specific", "medium", 0.7, None, "T")],
        "```json\n" + item % '{"severity":"low"}' + "\n```": [("ai_specific", "low", 0.7, None, "Security Issue")],
        "```" + item % "{}" + "```": [],
        "```": [], "": [], "{}": [], "[1]": [], "null": [], '{"findings":null}': [], '{"findings":"ab"}': [], '{"findings":{"a":{"title":"T"}}}': [],
        item % '{"category":"redos","severity":"HIGH","confidence":1}': [("redos", "medium", 1.0, None, "Security Issue")],
        item % '{"category":null,"severity":7}': [("ai_specific", "medium", 0.7, None, "Security Issue")],
        item % '{"confidence":1.5}': [], item % '{"confidence":-0.1}': [], item % '{"confidence":null}': [], item % '{"confidence":"abc"}': [],
        item % '{"confidence":[0.5]}': [], item % '{"confidence":" 0.5 "}': [("ai_specific", "medium", 0.5, None, "Security Issue")],
        item % '{"confidence":false}': [("ai_specific", "medium", 0.0, None, "Security Issue")],
        item % '{"confidence":"0.5d"}': [],
        item % '{"line_start":42.0}': [("ai_specific", "medium", 0.7, 42, "Security Issue")],
        item % '{"line_start":"42"}': [("ai_specific", "medium", 0.7, 42, "Security Issue")],
        item % '{"line_start":42.5}': [], item % '{"line_start":"4x"}': [], item % '{"line_end":[1]}': [],
        item % '{"line_start":null}': [("ai_specific", "medium", 0.7, None, "Security Issue")],
        item % '{"title":null}': [], item % '{"title":7}': [], item % '{"description":null}': [], item % '{"fix_suggestion":1}': [],
        item % '{"masked_evidence":5}': [], item % '{"masked_evidence":null,"title":"E"}': [("ai_specific", "medium", 0.7, None, "E")],
        item % '7,{"title":"A"},{"confidence":2},{"title":"B"}': [("ai_specific", "medium", 0.7, None, "A"), ("ai_specific", "medium", 0.7, None, "B")],
    }
    rows = [("j", f"f{i}", "llm_groq", t) for i, t in enumerate(cases)]
    df = spark.createDataFrame(rows, "job_id string, file_path string, model_used string, response_text string")
    got = {}
    for r in RE.normalised(df).orderBy("det_ordinal").collect():
        got.setdefault(r["file_path"], []).append((r["category"], r["severity"], r["confidence"], r["line_start"], r["title"]))
    assert got == {f"f{i}": v for i, v in enumerate(cases.values()) if v}


T1, T2 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)


def test_store_replaces_what_a_job_found_before(spark, tmp_path):
    _, df = make(spark, 200)
    jobs, path = df.select("scan_job_id").distinct(), str(tmp_path / "store")
    n = df.select("scan_job_id", "file_path", "category", "line_start").count()
    sink.write_findings(df, jobs, path, 1, T1)
    sink.write_findings(df, jobs, path, 1, T2)  # repeated
    assert sink.read_findings(spark, path).count() == n
    assert {r["created_at"] for r in sink.read_findings(spark, path).select("created_at").distinct().collect()} == {T2}
    again = spark.createDataFrame([("hot",)], "scan_job_id string")
    sink.write_findings(df.filter("false"), again, path, 2, T2)
    left = sink.read_findings(spark, path)
    assert left.filter("scan_job_id = 'hot'").count() == 0
    assert left.count() == df.filter("scan_job_id != 'hot'").count()
    assert left.filter(F.col("id").isNull()).count() == 0
    assert sink.incomplete(spark, path).count() == 0 and sink.superseded(spark, path).count() == 1


def test_store_of_empty_and_numbered_attempts(spark, tmp_path):
    _, df = make(spark, 200)
    jobs, path = spark.createDataFrame([("hot",), ("none",)], "scan_job_id string"), str(tmp_path / "store")
    sink.write_findings(df.filter("false"), jobs, path, 9, T1)  # a first attempt without findings
    assert sink.read_findings(spark, path).count() == 0 and sink.published(spark, path).count() == 2
    hot = df.filter("scan_job_id = 'hot'")
    sink.write_findings(hot, jobs, path, 10, T1)  # ten comes after nine
    assert sink.read_findings(spark, path).count() == hot.count()
    sink.write_findings(hot.limit(1), jobs, path, 9, T2)  # an old number published late changes nothing
    assert sink.read_findings(spark, path).count() == hot.count()
    sink.write_findings(hot.filter("false"), jobs, path, 10, T2)  # the repeated run finds nothing
    assert sink.read_findings(spark, path).count() == 0
    # An attempt that was never published shows nowhere.
    hot.withColumn("id", F.lit("x")).write.parquet(f"{path}/attempts/attempt_id=dead")
    assert sink.read_findings(spark, path).count() == 0


def test_store_tells_lost_rows(spark, tmp_path):
    import pathlib

    _, df = make(spark, 200)
    path = str(tmp_path / "store")
    attempt = sink.write_findings(df.repartition(4), df.select("scan_job_id"), path, 1, T1)
    sorted(pathlib.Path(path, "attempts", f"attempt_id={attempt}").glob("part-*"))[0].unlink()
    spark.catalog.refreshByPath(path)
    lost = sink.incomplete(spark, path).collect()
    assert lost and all(r["n_stored"] < r["n_findings"] for r in lost)


def test_audit_end_to_end(spark):
    from lintlake.plans import audit
    from lintlake.sources import files as S

    rows = [("r1", "c", 1, "blob", "a.py", 30, "s", "DEBUG = True\nverify=False"), ("r1", "c", 2, "tree", "src", None, None, None),
            ("r1", "c", 3, "blob", "b.png", 5, "s", "DEBUG = True"), ("r2", "c", 1, "blob", "x.js", 5, "s", "x")]
    tree = spark.createDataFrame(rows, S.REPO_FILES_SCHEMA)
    said = '{"findings":[{"title":"dup","category":"debug_exposure","severity":"critical","line_start":1},{"title":"new","category":"redos","severity":"critical","confidence":0.9}]}'
    responses = spark.createDataFrame([("r1", "c", "a.py", "llm_groq", said)],
                                      "repo_url string, commit_sha string, file_path string, model_used string, response_text string")
    final = audit.final_findings(audit.chosen_files(tree, tree_cap=S.TREE_CAP, scan_cap=S.SCAN_CAP), responses)
    ranked = [(r["rank_in_job"], r["title"], r["detected_by"]) for r in final.orderBy("rank_in_job").collect()]
    assert ranked == [(1, "new", "llm_groq"), (2, "Debug switch is on", "regex"), (3, "TLS certificate check turned off", "regex")]
    pages = {r["repo_url"]: r for r in audit.report(tree, final).collect()}
    assert (pages["r1"]["total_files"], pages["r1"]["files_scanned"], pages["r1"]["risk_score"]) == (3, 1, 20)
    assert (pages["r2"]["total_files"], pages["r2"]["risk_score"], pages["r2"]["findings"]) == (1, 0, None)


def test_summary_counts_categories_of_any_name(spark):
    df = spark.createDataFrame([("a", "f", 1, c, "low", 0.5, "t", "R", i) for i, c in enumerate(["ssrf", "of our own", "of our own", None])], SCHEMA)
    jobs = spark.createDataFrame([("a",), ("b",)], "scan_job_id string")
    got = {r["scan_job_id"]: (r["n_findings"], r["category_counts"]) for r in FI.summary(jobs, df, JOB).collect()}
    assert got == {"a": (4, {"ssrf": 1, "of our own": 2, "": 1}), "b": (0, {})}


def test_merged_findings_keep_the_reviewers_texts(spark, monkeypatch):
    from lintlake.plans import catalogue

    seen, plain = [], FI.deduplicate
    monkeypatch.setattr(FI, "deduplicate", lambda df, *a: seen.append(df.columns) or plain(df, *a))
    catalogue.QUERIES["merged_findings"](spark, "/root/testdata/sf0.001")
    assert {"description", "fix_suggestion"} <= set(seen[0])
