"""Values as SQL literals. Long rule expressions are written as SQL text: one parse instead of
thousands of calls that build columns piece by piece."""

from __future__ import annotations


def quoted(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS STRING)"
    # "${" would be taken for a variable to substitute.
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{") + "'"


def any_contains(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def in_list(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(quoted(v) for v in values)})"
