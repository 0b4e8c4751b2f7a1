"""Column expressions on paths, contents and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: extension -> language, for rules and for reports (the two lists differ) ------
RULE_LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript",
                  "tsx": "typescript", "rb": "ruby", "php": "php", "go": "go", "java": "java"}
REPORT_LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go",
                    "rb": "ruby", "php": "php"}


def _after_last_dot(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def basename(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def selection_extension(path: Column) -> Column:
    """'.' + text after the last dot of the whole path; the bare name when there is no dot."""
    return F.when(F.contains(path, F.lit(".")), F.concat(F.lit("."), _after_last_dot(path))).otherwise(basename(path))


def rule_extension(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(".")), _after_last_dot(path)).otherwise(F.lit(""))


def syntax_extension(path: Column) -> Column:
    """As the authentication syntax check sees it: no dot test, so a file called ``py`` is Python."""
    return _after_last_dot(path)


def _language(ext: Column, table: dict[str, str], default: str) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(ext == key, value) if out is None else out.when(ext == key, value)
    return out.otherwise(F.lit(default))


def rule_language(path: Column) -> Column:
    return _language(rule_extension(path), RULE_LANGUAGES, "any")


def report_language(path: Column) -> Column:
    return _language(rule_extension(path), REPORT_LANGUAGES, "unknown")


def mask_secret(secret: Column) -> Column:
    return F.when(F.length(secret) <= 8, F.lit("****")).otherwise(
        F.concat(F.left(secret, F.lit(4)), F.lit("****"), F.right(secret, F.lit(4)))
    )


def cache_key(repo_url: Column, commit_sha: Column) -> Column:
    return F.concat(F.lit("scan:"), F.sha2(F.concat(repo_url, F.lit(":"), commit_sha), 256))
