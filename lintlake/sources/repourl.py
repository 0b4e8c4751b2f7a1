"""Repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def owner_and_repo(url: Column) -> Column:
    """STRUCT(owner, repo) of a repository address, or NULL when it has fewer than two parts."""
    rest = F.rtrim(url, F.lit("/"))
    for piece in ("https://", "http://", "github.com/", ".git"):
        rest = F.replace(rest, F.lit(piece), F.lit(""))
    parts = F.split(rest, "/", -1)
    return F.when(
        F.size(parts) >= 2, F.struct(F.element_at(parts, 1).alias("owner"), F.element_at(parts, 2).alias("repo"))
    )


def repo_name(owner: Column, repo: Column) -> Column:
    return F.concat_ws("/", owner, repo)
