"""Every query of the engine over the given tables, by name. Each takes (spark, sf_dir)."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import rules as R
from lintlake.functions import text as T
from lintlake.operators import findings as FI
from lintlake.operators import jobs as J
from lintlake.operators import responses as RE
from lintlake.operators import resultstore, rulescan, score
from lintlake.operators.replay import replay
from lintlake.plans import audit
from lintlake.session import prepare, work_dir
from lintlake.sources import checkout, files, repourl, seeded, sink
from lintlake.streaming import admission, runs, status
from lintlake.streaming import scan as stream_scan_op

REPO = files.REPO_KEY
JOB = ("scan_job_id",)

# Limits small enough to bite on the test tables.
SMALL_KB, SMALL_TREE_CAP, SMALL_SCAN_CAP = 2, 30, 10

# All rules but the secret rules and the three that need a syntax tree (used by tests).
SQL_RULES = R.REGEX_RULES + (R.RATE_LIMIT, R.RATE_LIMIT_AUTH)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded.documents_as_files(seeded.spread(seeded.table(spark, sf_dir, "documents")))


def _scannable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scannable(_documents(spark, sf_dir))


# --- selection and scalars ----------------------------------------------------------------------

def _file_columns(df: DataFrame) -> DataFrame:
    return df.select("repo_url", "commit_sha", "ordinal", "path", "size")


@query
def scannable_files(spark, sf_dir):
    return _file_columns(files.scannable(seeded.repo_files(spark, sf_dir)))


@query
def scannable_files_small_limit(spark, sf_dir):
    return _file_columns(files.scannable(seeded.repo_files(spark, sf_dir), SMALL_KB))


@query
def file_caps(spark, sf_dir):
    return _file_columns(files.first_files(files.scannable(seeded.repo_files(spark, sf_dir)), SMALL_TREE_CAP, SMALL_SCAN_CAP))


@query
def tree_counts(spark, sf_dir):
    return files.tree_counts(seeded.repo_files(spark, sf_dir), SMALL_KB, SMALL_TREE_CAP, SMALL_SCAN_CAP)


@query
def parse_repo_urls(spark, sf_dir):
    """Page addresses as they are, and rewritten into the forms repository addresses take."""
    pages = seeded.table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    n = F.col("page_id").cast("string")
    forms = (
        F.col("url"),
        F.concat(F.lit("https://github.com/"), host, F.lit("/r"), n),
        F.concat(F.lit("github.com/"), host, F.lit("/r"), n, F.lit("//")),
        F.concat(F.lit("https://github.com/"), host, F.lit("/r"), n, F.lit(".git")),
        F.concat(host, F.lit("/r"), n),
        F.concat(F.lit("http://github.com/"), host),
        F.concat(F.lit("https://github.com/o"), n, F.lit("/my.github.io")),
        F.concat(F.lit("https://www.github.com/"), host, F.lit("/r"), n),
    )
    urls = pages.select("page_id", F.posexplode(F.array(*forms)).alias("form", "repo_url"))
    found = urls.withColumn("p", repourl.owner_and_repo(F.col("repo_url")))
    return found.select(
        "page_id", "form", "repo_url", F.col("p.owner").alias("owner"), F.col("p.repo").alias("repo"),
        F.when(F.col("p").isNotNull(), repourl.repo_name(F.col("p.owner"), F.col("p.repo"))).alias("repo_name"),
        F.col("p").isNull().alias("rejected"),
    )


@query
def decode_contents(spark, sf_dir):
    stored = seeded.repo_files(spark, sf_dir).select("path", F.base64(F.col("content").cast("binary")).alias("encoded"))
    text = stored.withColumn("content", files.decode_content(F.col("encoded"))).filter(F.col("content").isNotNull())
    return text.select("path", F.length("content").alias("chars"), F.sha2("content", 256).alias("sha"))


@query
def language_tags(spark, sf_dir):
    path = F.col("path")
    return seeded.repo_files(spark, sf_dir).select(
        "path",
        T.basename(path).alias("name"),
        T.selection_extension(path).alias("selection_ext"),
        T.rule_extension(path).alias("rule_ext"),
        T.syntax_extension(path).alias("syntax_ext"),
        T.rule_language(path).alias("rule_lang"),
        T.report_language(path).alias("report_lang"),
        T.cache_key(F.col("repo_url"), F.col("commit_sha")).alias("cache_key"),
    )


# --- rule scan ----------------------------------------------------------------------------------

def _finding_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "repo_url", "file_path", "line_start", "line_end", "category", "severity", "confidence", "title",
        "masked_evidence", "code_snippet", "detected_by", "rule_id")


def _scan(rules: tuple[R.Rule, ...]):
    return lambda spark, sf_dir: _finding_columns(rulescan.scan_rules(_scannable(spark, sf_dir), rules))


@query
def injection_findings(spark, sf_dir):
    return _scan(R.INJECTION_RULES)(spark, sf_dir)


@query
def ssrf_requests_findings(spark, sf_dir):
    return _scan(R.by_id("SSRF_REQUESTS"))(spark, sf_dir)


@query
def auth_findings(spark, sf_dir):
    return _scan(R.AUTH_RULES)(spark, sf_dir)


@query
def ai_findings(spark, sf_dir):
    return _scan(R.AI_RULES)(spark, sf_dir)


@query
def rate_limit_findings(spark, sf_dir):
    return _scan((R.RATE_LIMIT, R.RATE_LIMIT_AUTH))(spark, sf_dir)


@query
def python_syntax_findings(spark, sf_dir):
    return _scan((R.PY_EXEC, R.PY_ASSERT, R.PY_BARE_EXCEPT))(spark, sf_dir)


@query
def secret_findings(spark, sf_dir):
    return _scan(R.SECRET_RULES)(spark, sf_dir)


@query
def rule_hit_counts(spark, sf_dir):
    """All rules together, counted per repository and rule: one pass over the contents, one small shuffle."""
    found = rulescan.scan_rules(_scannable(spark, sf_dir))
    return found.groupBy("repo_url", "rule_id", "category", "severity").agg(
        F.count("*").alias("n_files"), F.min("line_start").alias("first_line"))


@query
def scan_unique_contents(spark, sf_dir):
    """Scan each distinct (content, name suffix) once and give the findings to all its copies."""
    return _finding_columns(rulescan.scan_distinct(_scannable(spark, sf_dir)))


@query
def rule_texts(spark, sf_dir):
    """Descriptions and fixes attached to findings, by rule."""
    found = rulescan.with_rule_texts(rulescan.scan_rules(_scannable(spark, sf_dir)))
    return found.groupBy("rule_id", "description", "fix_suggestion").agg(F.count("*").alias("n_findings"))


# --- scores, flags, requests --------------------------------------------------------------------

@query
def suspicion_scores(spark, sf_dir):
    return score.suspicion_scores(_scannable(spark, sf_dir)).drop("commit_sha")


@query
def flagged_files(spark, sf_dir):
    out = score.ranked_flagged(_scannable(spark, sf_dir))
    return out.select("repo_url", "file_path", "language", "suspicion_score",
                      F.array_join("regex_hits", "|").alias("regex_hits"), F.array_join("ast_hits", "|").alias("ast_hits"),
                      "n_findings", "flag_rank")


@query
def review_requests(spark, sf_dir):
    asked = score.review_requests(score.flagged(_scannable(spark, sf_dir)))
    return asked.select(
        "repo_url", "file_path", "route", "model_used",
        F.substring_index("system_text", "what the scanner found:\n", -1).alias("listed"),
        F.length("user_text").alias("user_chars"), F.sha2("user_text", 256).alias("user_sha"))


# --- review responses ---------------------------------------------------------------------------

def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per document, in 20 good and bad forms; the description is the whole text."""
    quoted = F.to_json(F.array("text"))
    text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)

    def item(fields: str) -> list:
        return [F.lit('{"description":'), text, F.lit("," + fields + "}")]

    base = '"title":"T","category":"ssrf","severity":"high","confidence":0.9,"line_start":3,"line_end":4,"fix_suggestion":"f"'
    plain = item(base)

    def wrap(*parts) -> tuple:
        return (F.lit('{"findings":['), *parts, F.lit("]}"))

    forms = (
        wrap(*plain),
        (F.lit("```json\n"), *wrap(*plain), F.lit("\n```")),
        (F.lit("```"), *wrap(*plain), F.lit("```")),
        (F.lit('{"findings":[]}'),),
        (F.lit("Nothing to report. "), text),
        (F.lit("["), *plain, F.lit("]")),
        (F.lit('{"findings":null}'),),
        wrap(*item('"title":"T","category":"odd","severity":"low","confidence":0.5')),
        wrap(*item('"title":"T","category":"redos","severity":"HIGH","confidence":1')),
        wrap(*item('"title":"T","category":"redos","severity":"info"')),
        wrap(*item('"title":"T","confidence":1.5')),
        wrap(*item('"title":"T","confidence":"abc"')),
        wrap(*item('"title":"T","line_start":"42","confidence":"0.8"')),
        wrap(*item('"title":"T","line_start":42.0,"line_end":null')),
        wrap(*item('"title":"T","line_start":42.5')),
        wrap(*item('"title":null')),
        wrap(*plain, F.lit(",7,"), *item('"title":7'), F.lit(","), *item('"confidence":true')),
        (F.lit('{"findings":{"a":'), *plain, F.lit("}}")),
        (F.lit('{"result":['), *plain, F.lit("]}")),
        (F.lit(" \n\t"), *wrap(*item('"masked_evidence":"sk_l****abcd","title":"E"'), F.lit(","), *item('"masked_evidence":5')), F.lit("\n ")),
    )
    n = F.col("doc_id") % len(forms)
    body = None
    for i, parts in enumerate(forms):
        made = F.concat(*parts)
        body = F.when(n == i, made) if body is None else body.when(n == i, made)
    return seeded.spread(seeded.table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("job-"), F.col("source")).alias("job_id"),
        F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.lit("llm_groq").alias("model_used"),
        body.alias("response_text"),
    )


@query
def normalised_responses(spark, sf_dir):
    return RE.normalised(_responses(spark, sf_dir))


@query
def merged_findings(spark, sf_dir):
    """Rule findings and review findings of the same files together, then deduplicated."""
    found = rulescan.with_rule_texts(rulescan.scan_rules(_scannable(spark, sf_dir)))
    review = RE.normalised(
        _scannable(spark, sf_dir).select(
            *REPO, F.col("path").alias("file_path"), F.lit("llm_groq").alias("model_used"),
            F.concat(F.lit('{"findings":[{"title":"seen","category":"crypto_failure","severity":"low","line_start":1,"description":"d1","fix_suggestion":"f1"},'
                           '{"title":"size","category":"input_validation","severity":"info","line_start":'),
                     F.col("size").cast("string"), F.lit("}]}")).alias("response_text")), REPO)
    both = FI.deduplicate(FI.merge(found, review), REPO)
    return both.select("repo_url", "file_path", "line_start", "category", "severity", "title", "description", "fix_suggestion", "detected_by", "rule_id")


# --- aggregation and report ---------------------------------------------------------------------

@query
def dedup_findings(spark, sf_dir):
    return FI.deduplicate_stored(seeded.findings(spark, sf_dir), JOB, ("id",))


@query
def ranked_findings(spark, sf_dir):
    # Only what is asked for travels.
    columns = (*JOB, "severity", "confidence", "file_path", "category", "line_start", "id")
    found = seeded.findings(spark, sf_dir).select(*columns, "det_ordinal")
    return FI.deduplicated_and_ranked_stored(found, JOB, ("id",)).select(*JOB, "rank_in_job", *columns[1:])


@query
def severity_counts(spark, sf_dir):
    return FI.severity_counts(FI.deduplicate(seeded.findings(spark, sf_dir), JOB, ("id",)), JOB)


@query
def category_counts(spark, sf_dir):
    return FI.category_counts(FI.deduplicate(seeded.findings(spark, sf_dir), JOB, ("id",)), JOB)


def _job_keys(spark, sf_dir):
    return seeded.scan_jobs(spark, sf_dir).select(F.col("id").alias("scan_job_id"), "repo_url", "commit_sha")


@query
def risk_scores(spark, sf_dir):
    kept = FI.deduplicate(seeded.findings(spark, sf_dir), JOB, ("id",))
    return FI.risk_scores(_job_keys(spark, sf_dir), kept, JOB)


@query
def scan_summary(spark, sf_dir):
    kept = FI.deduplicate(seeded.findings(spark, sf_dir), JOB, ("id",))
    s = FI.summary(_job_keys(spark, sf_dir), kept, JOB)
    return s.select(*JOB, "repo_url", "risk_score", "n_findings", "critical_count", "high_count",
                    F.to_json("severity_counts").alias("severity_counts"), F.to_json("category_counts").alias("category_counts"))


@query
def scan_report(spark, sf_dir):
    """Files to report: scan, deduplicate and rank once, store, then assemble the pages of each repository."""
    tree = _documents(spark, sf_dir).unionByName(seeded.folders(spark, sf_dir))
    pages = audit.report(tree, audit.final_findings(audit.chosen_files(tree)))
    return pages.select(
        "repo_url", "repo_name", "commit_sha", "total_files", "files_scanned", "risk_score", "n_findings", "page", "pages",
        F.to_json("severity_counts").alias("severity_counts"), F.to_json("category_counts").alias("category_counts"),
        F.to_json("findings", {"ignoreNullFields": "false"}).alias("findings"))


@query
def repo_risk(spark, sf_dir):
    """Flagship: risk score and severity counts per repository, files in, one pass over the contents."""
    found = rulescan.scan_rules(_scannable(spark, sf_dir))
    kept = FI.deduplicate(found, REPO)
    return FI.summary(files.tree_counts(seeded.repo_files(spark, sf_dir)), kept, REPO).select(
        "repo_url", "commit_sha", "total_files", "files_scanned", "risk_score", "n_findings", "critical_count", "high_count",
        F.to_json("severity_counts").alias("severity_counts"))


# --- relations ----------------------------------------------------------------------------------

def _callers(spark, sf_dir):
    """Every job is asked for by its owner, and every job by the owner of the next key as well."""
    o = seeded.table(spark, sf_dir, "orders")
    job = F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id")
    return o.select(job, F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).alias("c")).select(
        "job_id", F.concat(F.lit("user-"), F.col("c").cast("string")).alias("caller_id"))


@query
def job_results(spark, sf_dir):
    jobs = J.owned_jobs(seeded.scan_jobs(spark, sf_dir), _callers(spark, sf_dir))
    return J.job_results(jobs, seeded.findings(spark, sf_dir))


@query
def user_by_id(spark, sf_dir):
    """The owner of the first job there is."""
    first = seeded.scan_jobs(spark, sf_dir).select(F.min_by("user_id", F.struct("created_at", "id"))).scalar()
    return J.by_key(seeded.users(spark, sf_dir), "id", first)


@query
def job_by_id(spark, sf_dir):
    """The last job there is."""
    jobs = seeded.scan_jobs(spark, sf_dir)
    return J.by_key(jobs, "id", jobs.select(F.max_by("id", F.struct("created_at", "id"))).scalar())


@query
def stored_findings(spark, sf_dir):
    """Three attempts: all jobs; every third job again, in half of which nothing and in the rest only grave findings are found; and every seventh
    job once more, without findings. Read back from the store."""
    jobs = seeded.scan_jobs(spark, sf_dir).select(F.col("id").alias("scan_job_id"), F.substring("id", 5, 20).cast("bigint").alias("k"))
    found = seeded.findings(spark, sf_dir)
    k = F.substring("scan_job_id", 5, 20).cast("bigint")
    path = f"{work_dir(spark)}/lintlake/findings-{uuid.uuid4().hex}"
    day = lambda n: datetime.datetime(2024, 1, n, tzinfo=datetime.UTC)
    sink.write_findings(found, jobs, path, 9, day(1))
    sink.write_findings(found.filter((k % 6 == 3) & F.col("severity").isin("critical", "high")), jobs.filter("k % 3 = 0"), path, 10, day(2))
    sink.write_findings(found.filter("false"), jobs.filter("k % 7 = 0"), path, 11, day(3))
    return sink.read_findings(spark, path)


@query
def checkout_files(spark, sf_dir):
    """Documents written as a tree, a third of it under hidden names, and read back as a checkout."""
    n = F.col("ordinal") % 6
    path = F.concat(F.when(n == 0, ".github/").when(n == 1, "__pkg__/").otherwise(""), F.col("path"))
    root = f"{work_dir(spark)}/lintlake/checkout-{uuid.uuid4().hex}"
    checkout.write_tree(_documents(spark, sf_dir).withColumn("path", path), root)
    return files.read_checkout(spark, root, "u", "c").select("path", "size", "sha", F.length("content").alias("chars"))

@query
def user_findings(spark, sf_dir):
    return J.user_findings(seeded.users(spark, sf_dir), seeded.scan_jobs(spark, sf_dir), seeded.findings(spark, sf_dir))


@query
def users_upsert(spark, sf_dir):
    return J.upsert_users(seeded.users(spark, sf_dir), seeded.user_updates(spark, sf_dir))


@query
def users_merged(spark, sf_dir):
    """The same upsert on a stored snapshot of which only the touched buckets are rewritten, in two batches of log-ins."""
    path = f"{work_dir(spark)}/lintlake/users-{uuid.uuid4().hex}"
    J.write_users(seeded.users(spark, sf_dir), path, 16)
    updates = seeded.user_updates(spark, sf_dir)
    half = updates.select(F.percentile_approx(F.unix_micros(F.col("seen_at").cast("timestamp")), 0.5)).scalar()
    early = F.unix_micros(F.col("seen_at").cast("timestamp")) <= half
    J.merge_users(spark, updates.filter(early), path, 16)
    J.merge_users(spark, updates.filter(~early), path, 16)
    return J.read_users(spark, path)


def _events(spark, sf_dir):
    return seeded.table(spark, sf_dir, "events")


@query
def job_current_state(spark, sf_dir):
    return J.job_states(seeded.job_status_events(_events(spark, sf_dir)))


@query
def job_latest_status(spark, sf_dir):
    events = seeded.job_status_events(_events(spark, sf_dir))
    return J.visible_status(events, events.select(F.max("ts")).scalar())


@query
def job_status_delete(spark, sf_dir):
    events = seeded.job_status_events(_events(spark, sf_dir))
    last = J.latest_status(events)
    return J.delete_status(last, last.filter(F.col("status") == "completed"))


@query
def job_status_tombstones(spark, sf_dir):
    """Every seventh record is followed at once by a delete; what comes later lives."""
    events = seeded.job_status_events(_events(spark, sf_dir))
    return J.status_after_deletes(events, events.filter(F.col("seq") % 7 == 0).select("job_id", "ts", "seq"))


def _requests(spark, sf_dir):
    """Everything but purchases asks for a scan; purchases are finished scans."""
    return seeded.scan_requests(_events(spark, sf_dir).filter(F.col("event_type") != "purchase"))


@query
def requests_to_scan(spark, sf_dir):
    return J.requests_to_scan(_requests(spark, sf_dir), seeded.scan_results(_events(spark, sf_dir)), 86_400)


@query
def cache_hits(spark, sf_dir):
    return J.cache_hits(_requests(spark, sf_dir), seeded.scan_results(_events(spark, sf_dir)), 86_400)


@query
def cached_reports(spark, sf_dir):
    """Reports of finished scans stored by cache key, then fetched for the requests that they answer."""
    bought = _events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    done = seeded.scan_results(bought).withColumnRenamed("completed_at", "stored_at")
    number = F.substring("job_id", 5, 20).cast("bigint")
    report = F.to_json(F.struct("repo_url", "commit_sha", (number % 101).cast("int").alias("risk_score"),
                                F.struct((number % 3).cast("int").alias("critical"), (number % 5).cast("int").alias("high")).alias("severity_counts"),
                                F.array(F.struct(F.concat(F.lit("found by "), "job_id").alias("title"))).alias("findings")))
    path = f"{work_dir(spark)}/lintlake/results-{uuid.uuid4().hex}"
    resultstore.put(done.withColumn("report", report), path, 86_400)
    hit = resultstore.probe(_requests(spark, sf_dir), path)
    of = lambda p, kind: resultstore.field(F.col("report"), p, kind)
    return hit.select("cache_key", "request_id", "ts", "job_id", of("$.repo_url", "string").alias("repo_url"), of("$.risk_score", "int").alias("risk_score"),
                      of("$.severity_counts.critical", "int").alias("critical"), of("$.findings[0].title", "string").alias("first_title"))


@query
def request_replay(spark, sf_dir):
    return replay(seeded.scan_requests(_events(spark, sf_dir)), J.CACHE_TTL_SECONDS)


@query
def request_replay_day(spark, sf_dir):
    return replay(seeded.scan_requests(_events(spark, sf_dir)), 86_400)


# --- streams ------------------------------------------------------------------------------------

@query
def stream_scan(spark, sf_dir):
    arriving = seeded.documents_as_files(runs.table_stream(spark, sf_dir, "documents"))
    found = runs.append_available(stream_scan_op.scan_stream(arriving), "stream-scan")
    return _finding_columns(found)


@query
def stream_admission(spark, sf_dir):
    asked = seeded.scan_requests(runs.table_stream(spark, sf_dir, "events"))
    return admission.admit_requests(asked, 86_400)


@query
def stream_status(spark, sf_dir):
    records = seeded.job_status_events(runs.table_stream(spark, sf_dir, "events"))
    return status.followed(records)
