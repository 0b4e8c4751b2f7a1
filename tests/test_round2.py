"""Cases from the review of the first round."""

from pyspark.sql import functions as F

from lintlake import rules as R
from lintlake.operators import jobs as J
from lintlake.operators import rulescan
from lintlake.plans import audit

TREE = "repo_url string, commit_sha string, ordinal long, type string, path string, size long, sha string, content string"


def test_review_texts_stay(spark):
    files = spark.createDataFrame([("r", "c", 1, "blob", "a.py", 10, None, "DEBUG = True")], TREE)
    answer = '{"findings":[{"title":"a","title":"mine","category":"ssrf","severity":"low","line_start":1,"description":"my text","fix_suggestion":"my fix"},{"title":"c"}]}'
    responses = spark.createDataFrame([("r", "c", "a.py", "llm_groq", answer)], "repo_url string, commit_sha string, file_path string, model_used string, response_text string")
    rows = rulescan.with_rule_texts(audit.final_findings(files, responses)).collect()
    assert ("mine", "my text") in {(r["title"], r["description"]) for r in rows}
    assert "c" in {r["title"] for r in rows}
    assert [bool(r["description"]) for r in rows if r["rule_id"] == "DEBUG_TRUE"] == [True]


def test_limits_of_the_caller_hold(spark):
    big = "DEBUG = True\n" + "x" * 600_000
    rows = [("r", "c", i, "blob", f"f{i}.py", len(big) if not i else 12, None, big if not i else "DEBUG = True") for i in range(1200)]
    tree = spark.createDataFrame(rows, TREE)
    final = audit.final_findings(audit.chosen_files(tree, max_kb=1000), rules=R.by_id("DEBUG_TRUE"))
    assert final.count() == 1200
    page = audit.report(tree, final, max_kb=1000).select("files_scanned").first()
    assert page["files_scanned"] == 1200


def test_copies_without_a_digest_are_scanned(spark):
    files = spark.createDataFrame([("r", "c", i, "blob", f"f{i}.py", 10, None, "DEBUG = True") for i in range(3)], TREE)
    assert rulescan.scan_distinct(files).count() == rulescan.scan_rules(files).count() == 3


def test_status_as_it_was(spark):
    rows = [("j", "2024-01-01 00:00:00", 1, "running"), ("j", "2024-01-01 02:00:00", 2, "completed")]
    events = spark.createDataFrame(rows, "job_id string, ts string, seq long, status string").withColumn("ts", F.to_timestamp("ts"))
    events = events.withColumns({c: F.lit(None).cast("string") for c in ("current_node", "message")}).withColumns({c: F.lit(0) for c in ("files_scanned", "total_files")})
    seen = J.visible_status(events, F.to_timestamp(F.lit("2024-01-01 00:01:00"))).collect()
    assert [(r["status"], r["visible"]) for r in seen] == [("running", True)]
