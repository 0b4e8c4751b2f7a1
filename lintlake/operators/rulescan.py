"""The rule scan: files in, findings out, in one pass over the contents and without a shuffle.

Step 1 tests every rule once and packs the answers into a bit mask. Step 2 computes line, count and
evidence for the bits that are set. Step 3 cuts the snippet from the lines of files with a hit and
turns the array of hits into rows; contents stay behind.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import rules as R
from lintlake.functions.regex import LINE_END, LINEWISE, RARE_LINE_END, folded, java, leading_literal
from lintlake.functions.sqltext import any_contains, in_list, quoted
from lintlake.functions.text import rule_language, syntax_extension
from lintlake.operators.matchers import matcher
from lintlake.operators.pysyntax import candidate_text, syntax_hits

FILE_KEY = ("repo_url", "commit_sha")
SCAN_RULES = R.ALL_RULES
FAMILY_STRIDE = 1_000_000_000  # more than the nodes or rules one file can have

RATE_NO = R.RULE_NO[R.RATE_LIMIT.rule_id]
RATE_AUTH_NO = R.RULE_NO[R.RATE_LIMIT_AUTH.rule_id]


# Patterns fold A-Z only, in the test as in the evidence; ``lower`` would also make a k of the Kelvin sign, and is used where a text has nothing
# but ASCII, as it is much faster: in other texts, for each run of such characters (``translate`` makes objects of every single one). Words that
# open a gate are looked for in text lowered as Unicode says, once for all words.
_IS_ASCII = "octet_length({0}) = length({0})"
_RUNS = f"regexp_extract_all(content, {quoted(r'[\x00-\x7F]+|[^\x00-\x7F]+')}, 0)"
ASCII_LOWERED = f"""CASE WHEN {_IS_ASCII.format('content')} THEN lower(content)
  ELSE array_join(transform({_RUNS}, p -> CASE WHEN {_IS_ASCII.format('p')} THEN lower(p) ELSE p END), '') END"""


def any_word(words: tuple[str, ...]) -> str:
    return f"CASE WHEN {_IS_ASCII.format('content')} THEN {any_contains('_lowered', words)} ELSE exists(array(lower(content)), p -> {any_contains('p', words)}) END"


def bit(rule: R.Rule) -> str:
    return f"{1 << R.RULE_NO[rule.rule_id]}L"


def family_mask(rules: tuple[R.Rule, ...], family: str) -> int:
    return sum(1 << R.RULE_NO[r.rule_id] for r in rules if r.family == family)


def line_after(prefix: str) -> str:
    """Line of the character after ``prefix``; only \\n ends a line."""
    return f"regexp_count({prefix}, '\\n') + 1"


def mask_sql(secret: str) -> str:
    return f"CASE WHEN length({secret}) <= 8 THEN '****' ELSE concat(left({secret}, 4), '****', right({secret}, 4)) END"


def occurs_any(patterns: tuple[str, ...]) -> str:
    """Does one of these case-insensitive patterns occur? Each is tried only where its leading text does:
    that is much faster than one long alternation."""
    tests = []
    for p in patterns:
        start = leading_literal(p).lower()
        found = f"rlike(_lowered, {quoted('(?md)' + folded(p))})"
        tests.append(f"(contains(_lowered, {quoted(start)}) AND {found})" if start else found)
    return "(" + " OR ".join(tests) + ")"


# Routes and no sign of a limiter.
RATE_LIMIT_MISSING = f"{occurs_any(R.ROUTE_PATTERNS)} AND NOT {occurs_any(R.LIMITER_PATTERNS)}"
HAS_LOGIN_ROUTE = occurs_any(R.AUTH_ENDPOINT_PATTERNS)

# Line of the first route *pattern in list order* that occurs, which need not be the earliest line.
FIRST_ROUTE_LINE = "CASE " + " ".join(
    f"WHEN rlike(content, {quoted(LINEWISE + java(p))}) THEN "
    + line_after(f"regexp_extract(content, {quoted(rf'(?imsd)\A(.*?)(?-s:{java(p)})')}, 1)")
    for p in R.ROUTE_PATTERNS
) + " ELSE 1 END"


def _rule_bit(rule: R.Rule, by_language: bool) -> str:
    m = matcher(rule)
    tests = [m.may_hit()]
    if by_language and "any" not in rule.languages:
        tests.insert(0, in_list("_language", rule.languages))
    if rule.family == "ai":
        tests.insert(0, "_ai_gate")
    # A branch of its own: what a test names twice Spark would evaluate first, for every row, if it were on one level with its gate.
    return f"CASE WHEN {' AND '.join(tests)} THEN CASE WHEN {m.hit()} THEN {bit(rule)} ELSE 0L END ELSE 0L END"


def with_rule_mask(files: DataFrame, rules: tuple[R.Rule, ...], by_language: bool) -> DataFrame:
    """Add ``rule_mask``: bit n is set when rule n occurs in the text.

    ``by_language`` skips rules that do not apply to the file; the suspicion scores need them all.
    """
    bits = [_rule_bit(r, by_language) for r in rules if r.pattern]
    if any(r.family == "rate_limit" for r in rules):
        which = f"CASE WHEN {HAS_LOGIN_ROUTE} THEN {bit(R.RATE_LIMIT_AUTH)} ELSE {bit(R.RATE_LIMIT)} END"
        bits.append(f"CASE WHEN {RATE_LIMIT_MISSING} THEN {which} ELSE 0L END")
    base = files.select("*", F.expr(f"{ASCII_LOWERED} AS _lowered"), rule_language(F.col("path")).alias("_language"))
    if any(r.family == "ai" for r in rules):
        base = base.select("*", F.expr(any_word(R.AI_GATE_WORDS) + " AS _ai_gate"))
    return base.select("*", F.expr(" | ".join(bits) if bits else "0L").alias("rule_mask"))


def _hit(rule: R.Rule, places: bool) -> str:
    """SQL of one rule's hit: a struct when its bit is set (and its language fits), otherwise NULL."""
    when = f"(rule_mask & {bit(rule)}) != 0L"
    line, matches, evidence, secret = FIRST_ROUTE_LINE, "1", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"
    if rule.pattern:
        m = matcher(rule)
        line, evidence = line_after(m.before()), m.evidence()
        if "any" not in rule.languages:
            when += " AND " + in_list("_language", rule.languages)
        if rule.family in ("injection", "auth"):
            matches = m.count()
        if rule.family == "secret":
            secret, evidence = m.secret(), mask_sql(m.secret())
    if not places:
        return f"CASE WHEN {when} THEN named_struct('rule_no', {R.RULE_NO[rule.rule_id]}, 'matches', {matches}) END"
    return (
        f"CASE WHEN {when} THEN named_struct('rule_no', {R.RULE_NO[rule.rule_id]}, 'line', {line}, 'seq', 0, "
        f"'matches', {matches}, 'evidence', {evidence}, 'secret', {secret}) END"
    )


# Lines as an editor shows them, as far as the last hit needs them. A plain split does unless a text has one of the
# rarer line ends. A final line end does not open another line.
_UPTO = "CAST(array_max(transform(_found, h -> h.line)) + 3 AS INT)"
_SPLIT = f"""CASE WHEN rlike(content, {quoted(RARE_LINE_END)}) THEN split(content, {quoted(LINE_END)}, {_UPTO})
  ELSE split(content, '\\n', {_UPTO}) END"""
SOURCE_LINES = f"transform(array({_SPLIT}), p -> CASE WHEN element_at(p, -1) = '' THEN slice(p, 1, size(p) - 1) ELSE p END)[0]"
# One line before to two lines after; a secret is masked here as well; file-level findings have none.
WITH_SNIPPET = f"""transform(_found, h -> named_struct('rule_no', h.rule_no, 'line', h.line, 'seq', h.seq, 'matches', h.matches,
  'evidence', h.evidence, 'snippet', CASE WHEN h.rule_no IN ({RATE_NO}, {RATE_AUTH_NO}) THEN NULL
    WHEN h.secret IS NULL THEN array_join(slice(_lines, greatest(h.line - 1, 1), least(4, h.line + 2)), '\n')
    ELSE replace(array_join(slice(_lines, greatest(h.line - 1, 1), least(4, h.line + 2)), '\n'), h.secret, {mask_sql('h.secret')}) END))"""


def with_hits(masked: DataFrame, rules: tuple[R.Rule, ...], places: bool = True) -> DataFrame:
    """Add ``hits``: one struct per rule that fired, with its snippet; regex rules in catalogue order, then tree rules. Without ``places`` a hit
    has its rule and number of matches only, and no text is searched for lines, evidence and snippets."""
    rules = tuple(sorted(rules, key=lambda r: R.RULE_NO[r.rule_id]))
    textual = [_hit(r, places) for r in rules if r.pattern or r.family == "rate_limit"]
    out = masked
    if textual and not places:
        out = out.select("*", F.expr(f"array_compact(array({', '.join(textual)})) AS hits"))
    elif textual:
        out = out.select("*", F.expr(f"array_compact(array({', '.join(textual)})) AS _found"))
        out = out.select("*", F.expr(f"CASE WHEN size(_found) > 0 THEN {SOURCE_LINES} END AS _lines"))
        out = out.select("*", F.expr(f"{WITH_SNIPPET} AS hits"))
    syntax = [R.RULE_NO[r.rule_id] for r in rules if r.family in ("injection_ast", "auth_ast")]
    if syntax:
        out = out.select("*", candidate_text(F.col("path"), F.col("content")).alias("_candidate"))
        found, is_python = syntax_hits(F.col("_candidate"), F.col("path"))
        out = out.select("*", found.alias("_tree"), is_python.alias("_is_python"))
        handler = R.RULE_NO[R.PY_BARE_EXCEPT.rule_id]
        wanted = ", ".join(str(n) for n in syntax)
        evidence = "CASE h.rule_no " + " ".join(
            f"WHEN {R.RULE_NO[k]} THEN concat({quoted(v)}, h.line)" for k, v in R.SYNTAX_EVIDENCE.items()) + " END"

        fields = f"'line', h.line, 'seq', h.seq, 'matches', 1, 'evidence', {evidence}, 'snippet', CAST(NULL AS STRING)" if places else "'matches', 1"

        def part(test: str) -> str:
            return (
                f"transform(filter(coalesce(_tree, array()), h -> h.rule_no IN ({wanted}) AND {test}), h -> named_struct("
                f"'rule_no', h.rule_no, {fields}))"
            )

        # Calls and assertions are reported before handlers, each in walk order.
        tree = f"concat({part(f'_is_python AND h.rule_no != {handler}')}, {part(f'h.rule_no = {handler}')})"
        out = out.withColumn("hits", F.expr(f"concat(hits, {tree})" if textual else tree))
    return out


_FACTS = "array<struct<title:string,layer:bigint,by_walk:boolean,file_level:boolean,category:string,severity:string,\
confidence:double,detected_by:string,rule_id:string,evidence:string,description:string,fix:string>>"


def rule_facts(number: Column) -> Column:
    """What the catalogue says about rule ``number``: one literal table, folded by the optimizer."""
    rows = [
        {
            "title": r.title, "layer": R.FAMILY_ORDER.index(r.family), "by_walk": r.family.endswith("_ast"),
            "file_level": r.family == "rate_limit", "category": r.category, "severity": r.severity,
            "confidence": R.confidence_of(r), "detected_by": R.DETECTED_BY[r.family], "rule_id": r.rule_id,
            "evidence": R.SYNTAX_EVIDENCE.get(r.rule_id), "description": r.description, "fix": r.fix,
        }
        for r in R.ALL_RULES
    ]
    return F.element_at(F.from_json(F.lit(json.dumps(rows)), _FACTS), number + 1)


def hit_title(hit: Column) -> Column:
    base = rule_facts(hit["rule_no"])["title"]
    return F.when(hit["matches"] > 1, F.concat(base, F.lit(" ("), hit["matches"].cast("string"), F.lit(" occurrences)"))).otherwise(base)


def findings_from_hits(with_hits_df: DataFrame, keys: tuple[str, ...] = FILE_KEY) -> DataFrame:
    """One row per hit. ``explode_outer``: for a plain explode Spark would add a filter on the array
    below it and evaluate all rules a second time.

    ``det_ordinal`` is the detection order inside a file: layer, then rule, or position in the tree walk.
    """
    h, fact = F.col("h"), F.col("fact")
    rows = with_hits_df.select(*keys, F.col("path").alias("file_path"), F.explode_outer("hits").alias("h")).filter(h.isNotNull())
    return rows.withColumn("fact", rule_facts(h["rule_no"])).select(
        *keys,
        "file_path",
        h["line"].alias("line_start"),
        F.when(~fact["file_level"], h["line"]).alias("line_end"),
        fact["category"].alias("category"),
        fact["severity"].alias("severity"),
        fact["confidence"].alias("confidence"),
        hit_title(h).alias("title"),
        h["evidence"].alias("masked_evidence"),
        h["snippet"].alias("code_snippet"),
        fact["detected_by"].alias("detected_by"),
        fact["rule_id"].alias("rule_id"),
        (fact["layer"] * F.lit(FAMILY_STRIDE) + F.when(fact["by_walk"], h["seq"]).otherwise(h["rule_no"])).alias("det_ordinal"),
    )


def scan_rules(files: DataFrame, rules: tuple[R.Rule, ...] = SCAN_RULES, keys: tuple[str, ...] = FILE_KEY) -> DataFrame:
    """Findings of ``rules`` in files with (keys..., path, content); content NULL gives none."""
    read = files.select(*keys, "path", "content").filter(F.col("content").isNotNull())
    return findings_from_hits(with_hits(with_rule_mask(read, rules, by_language=True), rules), keys)


def with_rule_texts(findings: DataFrame) -> DataFrame:
    """Attach description and fix of the rule, done last, so that shuffles stay narrow. Texts that a finding has (a reviewer's) stay."""
    numbers = F.from_json(F.lit(json.dumps(R.RULE_NO)), "map<string,int>")
    own = lambda c, of: F.coalesce(c, of) if c in findings.columns else F.col(of)
    return (
        findings.withColumn("_t", rule_facts(F.element_at(numbers, F.col("rule_id"))))
        .withColumn("description", own("description", "_t.description")).withColumn("fix_suggestion", own("fix_suggestion", "_t.fix")).drop("_t")
    )


def scan_distinct(files: DataFrame, rules: tuple[R.Rule, ...] = SCAN_RULES, keys: tuple[str, ...] = FILE_KEY) -> DataFrame:
    """``scan_rules`` for tables with many copies (forks, vendored code): each distinct content is scanned
    once per language, and its findings are given to every file that has it.

    Which copy is scanned is decided on metadata alone (``sha`` and path), by an aggregate that combines before
    the shuffle. A content with very many copies is a skewed key of the last join only, where one side is
    its few findings; AQE splits the other.
    """
    language, extension = rule_language(F.col("path")), syntax_extension(F.col("path"))
    sha = F.coalesce("sha", F.sha2("content", 256)).alias("sha")
    meta = files.filter(F.col("content").isNotNull()).select(*keys, "path", sha, language.alias("_lang"), extension.alias("_ext"))
    # The handler rule looks at another extension than the language; contents differ by both.
    meta = meta.withColumn("_ext", F.when(F.col("_ext") == "py", F.col("_ext")).otherwise(F.lit("")))
    group = ("sha", "_lang", "_ext")
    chosen = meta.groupBy(*group).agg(F.min(F.struct(*keys, "path")).alias("c"))
    picked = chosen.select(*group, *[F.col(f"c.{k}").alias(k) for k in (*keys, "path")])
    found = scan_rules(files.join(picked.select(*keys, "path"), [*keys, "path"], "left_semi"), rules, keys)
    known = found.join(picked.withColumnRenamed("path", "file_path"), [*keys, "file_path"]).drop(*keys, "file_path")
    return meta.withColumnRenamed("path", "file_path").join(known, list(group)).drop(*group)
