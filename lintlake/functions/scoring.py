"""Severity order and weights, and the per-file suspicion scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.rules import SEVERITIES, SEVERITY_WEIGHTS

DEEP_THRESHOLD = 0.6


def severity_rank(severity: Column) -> Column:
    out = None
    for n, name in enumerate(SEVERITIES):
        out = F.when(severity == name, F.lit(n)) if out is None else out.when(severity == name, F.lit(n))
    return out.otherwise(F.lit(99))


def severity_weight(severity: Column) -> Column:
    out = None
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, F.lit(weight)) if out is None else out.when(severity == name, F.lit(weight))
    return out.otherwise(F.lit(0))


def capped_share(hits: Column, full_at: int) -> Column:
    return F.least(hits / F.lit(float(full_at)), F.lit(1.0))


def review_depth(score: Column) -> Column:
    return F.when(score >= DEEP_THRESHOLD, F.lit("deep")).otherwise(F.lit("fast"))


def model_tag(model: Column, depth: Column) -> Column:
    """Origin tag of a review: vendor part of the model name; the fast model has one fixed tag."""
    vendor = F.split_part(model, F.lit("/"), F.lit(1))
    return (
        F.when(depth == "fast", F.lit("llm_groq"))
        .when(depth == "fallback", F.concat(F.lit("llm_fallback_"), vendor))
        .otherwise(F.concat(F.lit("llm_"), vendor))
    )
