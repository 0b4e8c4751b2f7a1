"""What the plans must and must not contain."""

import re

import pytest
from conftest import SMALL

from lintlake import rules as R
from lintlake.operators import findings as FI
from lintlake.operators.rulescan import scan_rules
from lintlake.operators.score import flagged
from lintlake.plans.catalogue import QUERIES, SQL_RULES
from lintlake.sources import files as S


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "files")
    spark.createDataFrame([("r", "c", 1, "blob", "a.py", 10, "s", "DEBUG = True")], S.REPO_FILES_SCHEMA).write.parquet(path)
    return S.read_repo_files(spark, path)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scan_is_one_pass_without_a_shuffle(stored):
    p = plan(scan_rules(S.scannable(stored)))
    tree = p.split("\n\n")[0]
    assert "Exchange" not in tree and tree.count("Scan parquet") == 1 and tree.count("ArrowEvalPython") == 1
    # The rules are evaluated in one projection only: no filter below repeats them.
    assert p.count("RLIKE") + p.count("rlike") < 3 * len(R.ALL_RULES) + 60
    filters = [block for block in p.split("\n\n") if re.match(r"\(\d+\) Filter", block)]
    assert not any("RLIKE" in f or "regexp" in f for f in filters)


def test_flags_do_not_evaluate_rules_twice(stored):
    filters = [b for b in plan(flagged(S.scannable(stored), SQL_RULES)).split("\n\n") if re.match(r"\(\d+\) Filter", b)]
    assert not any("RLIKE" in f or "contains(lower" in f for f in filters)


def test_selection_reads_metadata_only_and_pushes_filters(stored):
    p = plan(S.scannable(stored).select("path"))
    schema = re.search(r"ReadSchema: (.*)", p).group(1)
    assert "content" not in schema and "sha:" not in schema
    assert "EqualTo(type,blob)" in p


def test_deduplication_limits_groups_before_the_shuffle(stored):
    tree = plan(FI.deduplicate(scan_rules(S.scannable(stored)), S.REPO_KEY)).split("\n\n")[0]
    assert tree.count("Exchange") == 1
    assert tree.count("WindowGroupLimit") == 2


def test_counts_combine_before_the_shuffle(stored):
    tree = plan(FI.category_counts(scan_rules(S.scannable(stored)), S.REPO_KEY)).split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("HashAggregate") == 2


@pytest.mark.parametrize("name", ["scan_report", "job_results", "user_findings", "requests_to_scan", "file_caps", "risk_scores", "users_upsert"])
def test_no_cross_joins(spark, name):
    p = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_snippets_do_not_carry_contents(stored):
    p = plan(scan_rules(S.scannable(stored), SQL_RULES))
    generate = next(b for b in p.split("\n\n") if re.match(r"\(\d+\) Generate", b))
    assert "content#" not in generate.split("Arguments")[1]


def without_broadcasts(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(QUERIES[name](spark, SMALL)).split("\n\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranking_moves_rows_once(spark):
    """Stored in buckets by chunk, the rows are numbered and meet their offsets without an exchange."""
    tree = without_broadcasts(spark, "ranked_findings")[0]
    scan = tree.index("Scan parquet")
    assert "Window" in tree[:scan] and "Exchange" not in tree[:scan]


def test_caps_drop_contents_before_the_exchange(spark):
    blocks = without_broadcasts(spark, "file_caps")
    tree = blocks[0]
    exchange, bits, scan = tree.index("Exchange"), tree.index("BroadcastHashJoin"), tree.index("Scan parquet")
    assert exchange < bits < scan
    scans = [b for b in blocks if re.match(r"\s*\(\d+\) Scan parquet", b)]
    # Two of the stored keys, one of the files; the keys themselves came from one scan of metadata.
    assert len(scans) == 3 and sum("documents" in b for b in scans) == 1
