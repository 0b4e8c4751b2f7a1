"""Scan on arrival: the batch rule scan on a stream of file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lintlake import rules as R
from lintlake.operators.rulescan import FILE_KEY, scan_rules
from lintlake.sources.files import MAX_FILE_KB, scannable


def scan_stream(files: DataFrame, rules: tuple[R.Rule, ...] = R.ALL_RULES, keys: tuple[str, ...] = FILE_KEY,
                max_kb: float = MAX_FILE_KB) -> DataFrame:
    """Stateless: each file row gives its findings once, in append mode."""
    return scan_rules(scannable(files, max_kb), rules, keys)
