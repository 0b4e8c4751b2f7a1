"""From findings to a report: merge, deduplicate, rank, count, assemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.scoring import severity_rank, severity_weight
from lintlake.operators.ordered import by_size, first_per_group, rank_in_buckets
from lintlake.rules import SEVERITIES
from lintlake.session import written_in_buckets

PAGE_ROWS = 500


def merge(rule_findings: DataFrame, review_findings: DataFrame) -> DataFrame:
    """Rule findings and review findings together; nothing is removed. Review rows carry later ordinals."""
    return rule_findings.unionByName(review_findings, allowMissingColumns=True)


def deduplicate(findings: DataFrame, keys: tuple[str, ...], tie_break: tuple[str, ...] = ()) -> DataFrame:
    """One finding per (file, category, line): the one detected first, whatever its severity."""
    placed = findings.withColumn("_line", F.coalesce("line_start", F.lit(0)))
    order = [F.asc("det_ordinal"), *[F.asc(c) for c in tie_break]]
    return first_per_group(placed, (*keys, "file_path", "category", "_line"), order).drop("_line")


def deduplicate_stored(findings: DataFrame, keys: tuple[str, ...], tie_break: tuple[str, ...] = ()) -> DataFrame:
    """As ``deduplicate``, for a table that may be read twice: rows are sorted once, after their exchange, not before it as well."""
    calm, crowded, _ = by_size(findings, keys)
    kept = deduplicate(calm, keys, tie_break)
    return kept if crowded is None else kept.unionByName(deduplicate(crowded, keys, tie_break))


def _rank_order(tie_break: tuple[str, ...]) -> list[Column]:
    return [F.asc("_severity"), F.desc("confidence"), F.asc("file_path"), F.asc("det_ordinal"), *[F.asc(c) for c in tie_break]]


def ranked(findings: DataFrame, keys: tuple[str, ...], tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Number the findings of each job: most severe first, then most certain, then by file and detection."""
    placed = findings.withColumn("_severity", severity_rank(F.col("severity")))
    return rank_in_buckets(placed, keys, _rank_order(tie_break), "rank_in_job").drop("_severity")


def deduplicated_and_ranked_stored(findings: DataFrame, keys: tuple[str, ...], tie_break: tuple[str, ...] = ()) -> DataFrame:
    """``ranked(deduplicate(...))`` for a table that may be read twice. Jobs that a task can hold are exchanged once for both steps
    and stored by job between them; those with more findings are ranked in chunks."""
    calm, crowded, tasks = by_size(findings, keys)
    # As many buckets as there are tasks, so that a bucket is as small as a task's rows.
    stored = written_in_buckets(deduplicate(calm, keys, tie_break), "deduplicated", *keys, buckets=tasks)
    kept = stored.withColumn("_severity", severity_rank(F.col("severity")))
    own = kept.withColumn("rank_in_job", F.row_number().over(Window.partitionBy(*keys).orderBy(*_rank_order(tie_break))).cast("bigint")).drop("_severity")
    return own if crowded is None else own.unionByName(ranked(deduplicate(crowded, keys, tie_break), keys, tie_break))


def _severity_columns() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES]


def severity_counts(findings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return findings.groupBy(*keys).agg(*_severity_columns())


def category_counts(findings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return findings.groupBy(*keys, "category").agg(F.count("*").alias("n_findings"))


def risk_scores(jobs: DataFrame, findings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Weighted sum of severities, at most 100; jobs without findings score 0.

    Findings are summed per job before the join, so a job with very many costs one row there.
    """
    sums = findings.groupBy(*keys).agg(F.sum(severity_weight(F.col("severity"))).alias("_raw"), F.count("*").alias("_n"))
    return jobs.select(*keys).join(sums, list(keys), "left").select(
        *keys,
        F.least(F.coalesce("_raw", F.lit(0)), F.lit(100)).cast("int").alias("risk_score"),
        F.coalesce("_n", F.lit(0)).alias("n_findings"),
    )


def summary(jobs: DataFrame, findings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Everything a report states about a job besides the findings themselves. Findings are counted by (job, category) before
    anything is put together, so any category counts (NULL as the empty name) and a task holds one row per category."""
    named = findings.withColumn("_category", F.coalesce("category", F.lit("")))
    per_category = named.groupBy(*keys, "_category").agg(
        *_severity_columns(), F.sum(severity_weight(F.col("severity"))).alias("_raw"), F.count("*").alias("_n"))
    per_job = per_category.groupBy(*keys).agg(
        *[F.sum(f"{s}_count").alias(f"{s}_count") for s in SEVERITIES],
        F.sum("_raw").alias("_raw"),
        F.sum("_n").alias("n_findings"),
        F.array_sort(F.collect_list(F.struct("_category", "_n"))).alias("_categories"),
    )
    present = F.coalesce(F.map_from_entries("_categories"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    zero = [F.coalesce(f"{s}_count", F.lit(0)) for s in SEVERITIES]
    counts = F.map_from_arrays(F.array(*[F.lit(s) for s in SEVERITIES]), F.array(*zero))
    return jobs.join(per_job, list(keys), "left").select(
        *jobs.columns,
        F.least(F.coalesce("_raw", F.lit(0)), F.lit(100)).cast("int").alias("risk_score"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.coalesce("critical_count", F.lit(0)).alias("critical_count"),
        F.coalesce("high_count", F.lit(0)).alias("high_count"),
        counts.alias("severity_counts"),
        present.alias("category_counts"),
    )


def report_pages(summaries: DataFrame, ranked_findings: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...],
                 page_rows: int = PAGE_ROWS) -> DataFrame:
    """The report of each job, its findings nested in rank order.

    A report is split into pages of ``page_rows`` findings: no row and no task ever holds all findings
    of a job, and the pages in order are the whole report. A job without findings has one empty page.
    """
    page = F.floor((F.col("rank_in_job") - 1) / page_rows).cast("int")
    nested = F.transform(
        F.array_sort(F.collect_list(F.struct("rank_in_job", *fields))), lambda f: F.struct(*[f[c].alias(c) for c in ("rank_in_job", *fields)]))
    pages = ranked_findings.withColumn("page", page).groupBy(*keys, "page").agg(nested.alias("findings"))
    return summaries.join(pages, list(keys), "left").select(
        *summaries.columns,
        F.coalesce("page", F.lit(0)).alias("page"),
        F.greatest(F.ceil(F.col("n_findings") / page_rows), F.lit(1)).cast("int").alias("pages"),
        "findings",
    )
