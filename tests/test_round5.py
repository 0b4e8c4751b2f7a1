"""Review requests and the tests of rules."""

from pyspark.sql import functions as F
from test_plans import plan

from lintlake import rules as R
from lintlake.operators import rulescan
from lintlake.operators.score import flagged, review_requests


def test_requests_search_no_text_for_lines_evidence_and_snippets(files):
    some = files(("a.py", "import os\nos.system(cmd)\nassert user\n"), ("b.py", "DEBUG = True\nq = 'select' + x + 'y'\nexec(a)\nexec(b)\n"), ("c.py", "nothing"))
    asked = review_requests(flagged(some))
    assert "snippet" not in plan(asked) and "regexp_extract_all(content" in plan(asked)
    listed = {r["file_path"]: r["system_text"].split("found:\n")[1] for r in asked.collect()}
    title = {r.rule_id: f"- {r.title}" for r in R.ALL_RULES}
    assert listed == {"a.py": "\n".join([title["OS_SYSTEM_CALL"], title[R.PY_ASSERT.rule_id]]), "b.py": "\n".join([title["SQL_STRING_CONCAT"], title[R.PY_EXEC.rule_id], title[R.PY_EXEC.rule_id]])}


def test_a_rule_is_tested_in_a_branch_below_its_gate():
    # On one level, Spark evaluates what the test names twice for every row.
    rule = R.by_id("SQL_STRING_CONCAT")[0]
    gate, test = rulescan._rule_bit(rule, False).split(" THEN CASE WHEN ")
    assert "regexp_extract" not in gate and test.count("regexp_extract") == 2


def test_letters_are_lowered_between_other_characters(files):
    texts = ["", "ABC xyz", "É", "ÄBC İ K KELVIN \U0001f600Z", "ÀÉ ΣΑΣ ǅ", "a\x7f\x80B\nÜ\r\n", "日本語ABC"]
    rows = files(*[(str(i), t) for i, t in enumerate(texts)]).select("path", F.expr(f"{rulescan.ASCII_LOWERED} AS low"))
    got = {int(r["path"]): r["low"] for r in rows.collect()}
    assert got == {i: "".join(c.lower() if c < "\x80" else c for c in t) for i, t in enumerate(texts)}
    lowered = files(("a", "Ä CLAUDE"), ("b", "KLLM"), ("c", "Ä none")).withColumn("_lowered", F.expr(rulescan.ASCII_LOWERED))
    words = lowered.select("path", F.expr(rulescan.any_word(("claude", "kllm"))).alias("w"))
    assert {r["path"]: r["w"] for r in words.collect()} == {"a": True, "b": True, "c": False}
