"""Syntax-tree rules: the one step that needs Python, as an Arrow-batched function on a column.

It receives the text of Python files that can possibly hit and NULL for everything else, so other
files cross to the Python worker as empty cells and no second pass over the contents is needed.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions.text import rule_extension, syntax_extension
from lintlake.rules import PY_ASSERT, PY_BARE_EXCEPT, PY_EXEC, RULE_NO

HITS = "array<struct<rule_no:int,line:int,seq:int>>"


def _tree_hits(exec_no: int, assert_no: int, except_no: int):
    # Self-contained on purpose: shipped by value, so workers need nothing installed.
    # (No postponed annotations in this module: Spark reads the real types of the function below.)
    from collections.abc import Iterator

    import pandas as pd

    def file_hits(text):
        import ast
        import warnings

        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        found = []
        for seq, node in enumerate(ast.walk(tree)):
            if isinstance(node, ast.Call):
                name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
                if name == "exec":
                    found.append({"rule_no": exec_no, "line": node.lineno, "seq": seq})
            elif isinstance(node, ast.Assert):
                found.append({"rule_no": assert_no, "line": node.lineno, "seq": seq})
            elif isinstance(node, ast.ExceptHandler) and node.type is None:
                if len(node.body) == 1 and isinstance(node.body[0], ast.Pass):
                    found.append({"rule_no": except_no, "line": node.lineno, "seq": seq})
        return found

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([None if t is None else file_hits(t) for t in batch], dtype=object)

    return F.pandas_udf(batches, HITS)


def candidate_text(path: Column, content: Column) -> Column:
    """Content of a Python file that mentions one of the words a syntax rule needs; otherwise NULL."""
    return F.when(
        (syntax_extension(path) == "py") & F.rlike(content, F.lit("exec|assert|except")), content
    )


def syntax_hits(candidate: Column, path: Column) -> tuple[Column, Column]:
    """Hits of the three syntax rules, and whether the path is Python for the two call rules as well
    (a file called just ``py`` is Python for the handler rule only)."""
    found = _tree_hits(RULE_NO[PY_EXEC.rule_id], RULE_NO[PY_ASSERT.rule_id], RULE_NO[PY_BARE_EXCEPT.rule_id])(candidate)
    return found, (rule_extension(path) == "py")
