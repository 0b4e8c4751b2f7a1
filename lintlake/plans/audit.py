"""A whole audit of many repositories: file table (and review responses) in, final findings and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake import rules as R
from lintlake.operators import findings as FI
from lintlake.operators import responses as RE
from lintlake.operators import rulescan
from lintlake.session import written
from lintlake.sources import files as S
from lintlake.sources.repourl import owner_and_repo, repo_name

REPORT_FIELDS = ("file_path", "line_start", "line_end", "category", "severity", "confidence", "title", "description", "masked_evidence", "fix_suggestion",
                 "code_snippet", "detected_by")


def chosen_files(tree: DataFrame, max_kb: float = S.MAX_FILE_KB, tree_cap: int | None = None, scan_cap: int | None = None) -> DataFrame:
    """Files to read. Without caps every scannable file is read; ``S.TREE_CAP`` and ``S.SCAN_CAP`` give the service's limits."""
    caps = [c for c in (tree_cap, scan_cap) if c is not None]
    kept = S.scannable(tree, max_kb)
    return S.first_files(kept, *caps) if caps else kept


def final_findings(files: DataFrame, responses: DataFrame | None = None, rules: tuple[R.Rule, ...] = R.ALL_RULES,
                   keys: tuple[str, ...] = S.REPO_KEY) -> DataFrame:
    """Ranked final findings of the given files (see ``chosen_files``), stored once so that findings and report share one scan.

    ``responses`` has (keys..., file_path, model_used, response_text).
    """
    found = rulescan.scan_rules(files, rules, keys)
    if responses is not None:
        # What a reviewer wrote stays with the finding; rule findings get their texts from the catalogue last.
        found = FI.merge(found, RE.normalised(responses, keys))
    return written(FI.ranked(FI.deduplicate(found, keys), keys), "final")


def report(tree: DataFrame, final: DataFrame, fields: tuple[str, ...] = REPORT_FIELDS, page_rows: int = FI.PAGE_ROWS,
           max_kb: float = S.MAX_FILE_KB, tree_cap: int | None = None, scan_cap: int | None = None) -> DataFrame:
    """Report pages per repository, with whole findings, counting files under the limits that ``chosen_files`` was given; ``scanned_at`` is for the caller to add, so that a report can be reproduced."""
    counted = S.tree_counts(tree, max_kb, tree_cap, scan_cap)
    place = owner_and_repo(F.col("repo_url"))
    named = counted.withColumn("repo_name", F.when(place.isNotNull(), repo_name(place["owner"], place["repo"])))
    return FI.report_pages(FI.summary(named, final, S.REPO_KEY), rulescan.with_rule_texts(final), S.REPO_KEY, fields, page_rows)
