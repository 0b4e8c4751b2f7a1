"""The same queries in SQL for another engine (DuckDB), written from the tables up.

Patterns, titles and the seeded snippets are data and come from the catalogue; everything that is done
with them is stated again here.
"""

from __future__ import annotations

from lintlake import rules as R
from lintlake.functions.regex import STRIP_CHARS, re2
from lintlake.plans.catalogue import SMALL_KB, SMALL_SCAN_CAP, SMALL_TREE_CAP, SQL_RULES
from lintlake.sources import files, seeded

NL = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(q(v) for v in values)


# --- tables -------------------------------------------------------------------------------------

SNIPPETS = "snip AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(code)}, {ok})" for i, (code, ok) in enumerate(seeded.SNIPPETS)) + ") v(i, s, py))"

FILES = f"""{SNIPPETS},
doc AS (SELECT doc_id, source, lang, text, ([{words(seeded.SUFFIXES)}])[doc_id % {len(seeded.SUFFIXES)} + 1] AS suffix FROM documents),
file AS (
  SELECT 'https://github.com/org/' || source AS repo_url, substr(sha256(source), 1, 40) AS commit_sha,
         doc_id + 1 AS ordinal, 'blob' AS type, 'src/' || source || '/' || doc_id || suffix AS path,
         a.s || {NL} || CASE WHEN lower(suffix) = '.py' THEN '# ' || replace(text, {NL}, {NL} || '# ') ELSE text END
           || {NL} || b.s AS content,
         a.py AND b.py AS py_ok
  FROM doc JOIN snip a ON a.i = doc_id % {len(seeded.SNIPPETS)} JOIN snip b ON b.i = (doc_id * 7 + 3) % {len(seeded.SNIPPETS)}),
tree AS (
  SELECT repo_url, commit_sha, ordinal, type, path, strlen(content) AS size, sha256(content) AS sha, content, py_ok FROM file
  UNION ALL
  SELECT DISTINCT 'https://github.com/org/' || source, substr(sha256(source), 1, 40), 0, 'tree',
         'src/' || source || '/' || lang || '.py', NULL, NULL, NULL, false FROM documents),
tagged AS (
  SELECT *, lower(split_part(path, '/', -1)) AS name,
         CASE WHEN contains(path, '.') THEN '.' || lower(split_part(path, '.', -1)) ELSE lower(split_part(path, '/', -1)) END AS selection_ext,
         CASE WHEN contains(path, '.') THEN lower(split_part(path, '.', -1)) ELSE '' END AS rule_ext,
         lower(split_part(path, '.', -1)) AS syntax_ext
  FROM tree),
named AS (
  SELECT *, CASE rule_ext WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'typescript'
              WHEN 'tsx' THEN 'typescript' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java'
              ELSE 'any' END AS rule_lang,
         CASE rule_ext WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'rb' THEN 'ruby'
              WHEN 'php' THEN 'php' WHEN 'go' THEN 'go' ELSE 'unknown' END AS report_lang
  FROM tagged)"""


def scannable(name: str = "s", max_kb: int = 500) -> str:
    return f"""{name} AS (
  SELECT * FROM named WHERE type = 'blob' AND name NOT IN ({words(files.SKIPPED_NAMES)}) AND coalesce(size, 0) <= {max_kb} * 1024
    AND (selection_ext IN ({words(files.SCANNABLE)}) OR name IN ({words(files.SCANNABLE)})))"""


SCAN = f"WITH RECURSIVE {FILES},\n{scannable()}"

FINDING_COLUMNS = """repo_url, file_path, line_start, line_end, category, severity, confidence, title, masked_evidence,
  code_snippet, detected_by, rule_id"""


# --- rules --------------------------------------------------------------------------------------

def line_of(prefix: str) -> str:
    return f"CAST(length({prefix}) - length(replace({prefix}, {NL}, '')) + 1 AS INTEGER)"


def allowed(rule: R.Rule) -> str:
    return "true" if "any" in rule.languages else f"rule_lang IN ({words(rule.languages)})"


AI_GATE = "(" + " OR ".join(f"contains(lower(content), {q(w)})" for w in R.AI_GATE_WORDS) + ")"
AI_SCORE_GATE = "(" + " OR ".join(f"contains(lower(content), {q(w)})" for w in R.AI_SCORE_WORDS) + ")"


def pattern_of(rule: R.Rule) -> str:
    return ssrf_pattern() if rule.rule_id == "SSRF_REQUESTS" else re2(rule.pattern)


def occurs(rule: R.Rule) -> str:
    return f"regexp_matches(content, {q('(?s)' + pattern_of(rule))})"


def regex_rows(rule: R.Rule) -> str:
    rx = pattern_of(rule)
    gate = f" AND {AI_GATE}" if rule.family == "ai" else ""
    n = f"len(regexp_extract_all(content, {q('(?s)' + rx)}))" if rule.family in ("injection", "auth") else "1"
    found = f"regexp_extract(content, {q('(?s)' + rx)}, 1)" if rule.family == "secret" else "NULL"
    return f"""SELECT repo_url, commit_sha, path, content, {R.RULE_NO[rule.rule_id]} AS no, {n} AS n,
    regexp_extract(content, {q('(?s)^(.*?)(?:' + rx + ')')}, 1) AS before,
    left(regexp_extract(content, {q('(?s)' + rx)}), 80) AS evidence, {found} AS secret
  FROM s WHERE {allowed(rule)}{gate} AND {occurs(rule)}"""


ROUTES = " OR ".join(f"regexp_matches(content, {q('(?i)' + re2(p))})" for p in R.ROUTE_PATTERNS)
LIMITS = " OR ".join(f"regexp_matches(content, {q('(?i)' + re2(p))})" for p in R.LIMITER_PATTERNS)
LOGINS = " OR ".join(f"regexp_matches(content, {q('(?i)' + re2(p))})" for p in R.AUTH_ENDPOINT_PATTERNS)
FIRST_ROUTE = "CASE " + " ".join(
    f"WHEN regexp_matches(content, {q('(?i)' + re2(p))}) THEN regexp_extract(content, {q('(?s)^(.*?)(?:(?i)(?-s)' + re2(p) + ')')}, 1)"
    for p in R.ROUTE_PATTERNS) + " END"
RATE_ROWS = f"""SELECT repo_url, commit_sha, path, content,
    CASE WHEN {LOGINS} THEN {R.RULE_NO[R.RATE_LIMIT_AUTH.rule_id]} ELSE {R.RULE_NO[R.RATE_LIMIT.rule_id]} END AS no, 1 AS n,
    {FIRST_ROUTE} AS before, NULL AS evidence, NULL AS secret
  FROM s WHERE ({ROUTES}) AND NOT ({LIMITS})"""

FACTS = "fact AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {q(r.rule_id)}, {q(r.family)}, {q(r.category)}, {q(r.severity)}, CAST({R.confidence_of(r)} AS DOUBLE), {q(r.title)}, "
    f"{q(R.DETECTED_BY[r.family])}, {R.FAMILY_ORDER.index(r.family)}, {q(r.description)}, {q(r.fix)})"
    for n, r in enumerate(R.ALL_RULES)) + ") v(no, rule_id, family, category, severity, confidence, title, detected_by, layer, description, fix))"

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def mask(e: str) -> str:
    return f"CASE WHEN length({e}) <= 8 THEN '****' ELSE left({e}, 4) || '****' || right({e}, 4) END"


def found(rules) -> str:
    """CTE ``found``: findings of ``rules`` in ``s``."""
    parts = [regex_rows(r) for r in rules if r.pattern]
    if any(r.family == "rate_limit" for r in rules):
        parts.append(RATE_ROWS)
    return f"""{FACTS},
raw AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, {line_of('before')} AS line, string_split_regex(content, {q(LINE_END)}) AS parts FROM raw),
cut AS (SELECT *, array_to_string((CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END)[greatest(line - 1, 1):line + 2], {NL}) AS snip0 FROM placed),
found AS (
  SELECT repo_url, commit_sha, path AS file_path, line AS line_start, CASE WHEN family <> 'rate_limit' THEN line END AS line_end,
         category, severity, confidence, CASE WHEN n > 1 THEN title || ' (' || n || ' occurrences)' ELSE title END AS title,
         CASE WHEN family = 'secret' THEN {mask('secret')} ELSE evidence END AS masked_evidence,
         CASE WHEN family = 'secret' THEN replace(snip0, secret, {mask('secret')}) WHEN family <> 'rate_limit' THEN snip0 END AS code_snippet,
         detected_by, rule_id, CAST(layer AS BIGINT) * 1000000000 + no AS det_ordinal, family, description, fix
  FROM cut JOIN fact USING (no))"""


TREE_ROWS = f"""tree_line AS (
  SELECT repo_url, commit_sha, path, n, parts[n] AS l, parts[n + 1] AS next
  FROM (SELECT repo_url, commit_sha, path, string_split(content, {NL}) AS parts FROM s WHERE rule_ext = 'py' AND py_ok) t, unnest(range(1, len(parts) + 1)) u(n)),
tree_hit AS (
  SELECT *, 'PY_EXEC_CALL' AS rule_id, 'exec() at line ' AS e, 1000000 AS deep FROM tree_line WHERE regexp_matches(l, '^([a-z]+\\.)?exec\\(')
  UNION ALL SELECT *, 'PY_ASSERT', 'assert at line ', 0 FROM tree_line WHERE l LIKE 'assert %'
  UNION ALL SELECT *, 'PY_BARE_EXCEPT_PASS', 'except: pass at line ', 0 FROM tree_line WHERE l = 'except:' AND next = '    pass'),
tree_found AS (
  SELECT repo_url, commit_sha, path AS file_path, CAST(n AS INTEGER) AS line_start, CAST(n AS INTEGER) AS line_end, category, severity, confidence, title,
    e || n AS masked_evidence, CAST(NULL AS VARCHAR) AS code_snippet, detected_by, rule_id, CAST(layer AS BIGINT) * 1000000000 + deep + n AS det_ordinal, family, description, fix
  FROM tree_hit JOIN fact USING (rule_id))"""


def found_all(name: str = "every") -> str:
    """CTE ``every``: findings of the whole catalogue. Among tree findings of a file, statements come before calls (the walk goes breadth first)."""
    return f"""{found(SQL_RULES + R.SECRET_RULES)}, {TREE_ROWS},
{name} AS (SELECT * FROM found UNION ALL BY NAME SELECT * FROM tree_found)"""


def scan_all(tail: str = f"SELECT {FINDING_COLUMNS} FROM every") -> str:
    return f"{SCAN},\n{found_all()}\n{tail}"


def scan(rules, tail: str = f"SELECT {FINDING_COLUMNS} FROM found") -> str:
    return f"{SCAN},\n{found(rules)}\n{tail}"


SYNTAX = f"""{SCAN}, {FACTS},
line AS (
  SELECT repo_url, path, n, parts[n] AS l, parts[n + 1] AS next
  FROM (SELECT repo_url, path, string_split(content, {NL}) AS parts FROM s WHERE rule_ext = 'py' AND py_ok) t, unnest(range(1, len(parts) + 1)) u(n)),
hit AS (
  SELECT *, 'PY_EXEC_CALL' AS rule_id, 'exec() at line ' AS e FROM line WHERE regexp_matches(l, '^([a-z]+\\.)?exec\\(')
  UNION ALL SELECT *, 'PY_ASSERT', 'assert at line ' FROM line WHERE l LIKE 'assert %'
  UNION ALL SELECT *, 'PY_BARE_EXCEPT_PASS', 'except: pass at line ' FROM line WHERE l = 'except:' AND next = '    pass')
SELECT repo_url, path AS file_path, CAST(n AS INTEGER) AS line_start, CAST(n AS INTEGER) AS line_end, category, severity, confidence, title,
  e || n AS masked_evidence, CAST(NULL AS VARCHAR) AS code_snippet, detected_by, rule_id
FROM hit JOIN fact USING (rule_id)"""


def ssrf_pattern() -> str:
    """The rule with a negative look-ahead, for an engine without one, in the same order of preference.

    With all blanks after "(" skipped, the next text is not a quoted http address: it starts with another
    character, or with a quote and then less of "http" than all. Or else the last blank is left to the free part,
    where the look-ahead sees the blank and passes.
    """
    blank = re2(r"\s")
    word = r"(?:request\.|req\.|params|query|url|endpoint)"
    after_htt = r"(?:request\.|req\.|query|url|endpoint)"
    quoted = "|".join([
        rf"(?:[^,)h][^,)]{{0,78}}{word}|{word})", rf"h(?:[^,)t][^,)]{{0,77}}{word}|{word})", rf"ht(?:[^,)t][^,)]{{0,76}}{word}|{word})",
        rf"htt(?:[^,)p][^,)]{{0,75}}{word}|{after_htt})"])
    plain = rf"""[^,)'"{blank[1:-1]}][^,)]{{0,79}}{word}|{word}"""
    return (rf"requests\.(?:get|post|put|delete|head){blank}*\((?:{blank}*(?:{plain}|['\"](?:{quoted}))|{blank}*{blank}[^,)]{{0,79}}{word})")


# --- scores -------------------------------------------------------------------------------------

SCORED = SQL_RULES + R.SECRET_RULES


def _hits(family: str) -> str:
    return " + ".join(f"CAST({occurs(r)} AS INTEGER)" for r in SCORED if r.family == family)


SCORES = f"""score AS (
  SELECT repo_url, commit_sha, path AS file_path, report_lang, content, least(({_hits('secret')}) / 3e0, 1e0) AS secret_score,
    least(({_hits('injection')}) / 3e0, 1e0) AS injection_score, least(({_hits('auth')}) / 3e0, 1e0) AS auth_score,
    CASE WHEN {AI_SCORE_GATE} THEN least(({_hits('ai')}) / 2e0, 1e0) ELSE 0e0 END AS ai_score,
    CASE WHEN ({ROUTES}) AND NOT ({LIMITS}) THEN 0.5e0 ELSE 0e0 END AS rate_score
  FROM s),
scored AS (SELECT *, greatest(secret_score, injection_score, rate_score, auth_score, ai_score) AS suspicion_score FROM score),
per_file AS (
  SELECT repo_url, file_path, CAST(count(*) AS INTEGER) AS n_findings,
         coalesce(string_agg(title, '|' ORDER BY det_ordinal) FILTER (family IN ('secret', 'injection', 'injection_ast')), '') AS regex_hits,
         coalesce(string_agg(title, '|' ORDER BY det_ordinal) FILTER (detected_by = 'ast'), '') AS ast_hits,
         coalesce(string_agg('- ' || title, {NL} ORDER BY det_ordinal) FILTER (family IN ('secret', 'injection', 'injection_ast')), '(the scanner found nothing)') AS listed
  FROM every GROUP BY ALL),
flagged AS (
  SELECT s.*, coalesce(n_findings, 0) AS n_findings, coalesce(regex_hits, '') AS regex_hits, coalesce(ast_hits, '') AS ast_hits, coalesce(listed, '(the scanner found nothing)') AS listed
  FROM scored s LEFT JOIN per_file p ON s.repo_url = p.repo_url AND s.file_path = p.file_path
  WHERE suspicion_score > 0 OR n_findings > 0)"""


# --- review responses ---------------------------------------------------------------------------

def responses() -> str:
    base = '"title":"T","category":"ssrf","severity":"high","confidence":0.9,"line_start":3,"line_end":4,"fix_suggestion":"f"'

    def item(fields: str) -> str:
        return f"""'{{"description":' || quoted || {q(',' + fields + '}')}"""

    plain = item(base)

    def wrap(body: str) -> str:
        return f"""'{{"findings":[' || {body} || ']}}'"""

    forms = [
        wrap(plain), f"'```json' || {NL} || {wrap(plain)} || {NL} || '```'", f"'```' || {wrap(plain)} || '```'",
        """'{"findings":[]}'""", "'Nothing to report. ' || quoted", f"'[' || {plain} || ']'", """'{"findings":null}'""",
        wrap(item('"title":"T","category":"odd","severity":"low","confidence":0.5')),
        wrap(item('"title":"T","category":"redos","severity":"HIGH","confidence":1')),
        wrap(item('"title":"T","category":"redos","severity":"info"')),
        wrap(item('"title":"T","confidence":1.5')), wrap(item('"title":"T","confidence":"abc"')),
        wrap(item('"title":"T","line_start":"42","confidence":"0.8"')), wrap(item('"title":"T","line_start":42.0,"line_end":null')),
        wrap(item('"title":"T","line_start":42.5')), wrap(item('"title":null')),
        wrap(f"{plain} || ',7,' || {item(chr(34) + 'title' + chr(34) + ':7')} || ',' || {item(chr(34) + 'confidence' + chr(34) + ':true')}"),
        f"""'{{"findings":{{"a":' || {plain} || '}}}}'""", f"""'{{"result":[' || {plain} || ']}}'""",
        f"' ' || {NL} || chr(9) || " + wrap(item('"masked_evidence":"sk_l****abcd","title":"E"') + " || ',' || " + item('"masked_evidence":5')) + f" || {NL} || ' '",
    ]
    cases = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    numeric = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"

    def number(name: str) -> str:
        kind = f"json_type(item, '$.{name}')"
        text = f"json_extract_string(item, '$.{name}')"
        return f"""CASE WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST({text} AS DOUBLE)
          WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1e0 ELSE 0e0 END
          WHEN {kind} = 'VARCHAR' AND regexp_matches({text}, {numeric}) THEN TRY_CAST({text} AS DOUBLE) END"""

    def member(name: str, values, default: str) -> str:
        text = f"json_extract_string(item, '$.{name}')"
        return f"CASE WHEN json_type(item, '$.{name}') = 'VARCHAR' AND {text} IN ({words(values)}) THEN {text} ELSE {q(default)} END"

    def text(name: str, default: str) -> str:
        return (f"CASE WHEN json_type(item, '$.{name}') IS NULL THEN {q(default)} "
                f"WHEN json_type(item, '$.{name}') = 'VARCHAR' THEN json_extract_string(item, '$.{name}') END")

    def absent(name: str) -> str:
        return f"coalesce(json_type(item, '$.{name}') = 'NULL', true)"

    return f"""WITH quoted AS (SELECT doc_id, source, to_json(text)::VARCHAR AS quoted FROM documents),
resp AS (SELECT 'job-' || source AS job_id, 'src/' || doc_id || '.py' AS file_path, CASE doc_id % {len(forms)} {cases} END AS t FROM quoted),
trimmed AS (SELECT *, trim(t, {q(STRIP_CHARS)}) AS c FROM resp),
clean AS (SELECT *, CASE WHEN starts_with(c, '```') THEN array_to_string(string_split(c, {NL})[2:-2], {NL}) ELSE c END AS body FROM trimmed),
listed AS (SELECT *, CASE WHEN json_valid(body) THEN json_extract(body::JSON, '$.findings[*]') END AS items FROM clean),
each AS (SELECT job_id, file_path, pos, items[pos] AS item FROM listed, unnest(range(1, len(items) + 1)) u(pos)),
fields AS (SELECT *, {member('category', R.CATEGORIES, 'ai_specific')} AS category, {member('severity', R.SEVERITIES, 'medium')} AS severity,
  CASE WHEN json_type(item, '$.confidence') IS NULL THEN 0.7e0 ELSE {number('confidence')} END AS confidence,
  {text('title', 'Security Issue')} AS title, {text('description', '')} AS description, {text('fix_suggestion', '')} AS fix_suggestion,
  {number('line_start')} AS a, {number('line_end')} AS b FROM each WHERE json_type(item) = 'OBJECT')
SELECT job_id, file_path, CAST(a AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end, category, severity, confidence, title, description,
  json_extract_string(item, '$.masked_evidence') AS masked_evidence, fix_suggestion, CAST(NULL AS VARCHAR) AS code_snippet,
  'llm_groq' AS detected_by, 'REVIEW' AS rule_id, CAST(7000000000 + pos - 1 AS BIGINT) AS det_ordinal
FROM fields WHERE confidence BETWEEN 0 AND 1 AND title IS NOT NULL AND description IS NOT NULL AND fix_suggestion IS NOT NULL
  AND coalesce(json_type(item, '$.masked_evidence') IN ('VARCHAR', 'NULL'), true)
  AND ({absent('line_start')} OR coalesce(a = floor(a), false)) AND ({absent('line_end')} OR coalesce(b = floor(b), false))"""


# --- stored findings, jobs, users ---------------------------------------------------------------

STORED = f"""WITH finding AS (
  SELECT 'job-' || l_orderkey AS scan_job_id, 'src/m' || (l_partkey % 2) || '.py' AS file_path,
    CAST(CASE WHEN l_linenumber % 4 <> 3 THEN l_linenumber % 4 END AS INTEGER) AS line_start,
    CAST(CASE WHEN l_linenumber % 4 <> 3 THEN l_linenumber % 4 END AS INTEGER) AS line_end,
    ([{words(seeded.FINDING_CATEGORIES)}])[l_partkey % {len(seeded.FINDING_CATEGORIES)} + 1] AS category,
    ([{words(seeded.FINDING_SEVERITIES)}])[l_suppkey % {len(seeded.FINDING_SEVERITIES)} + 1] AS severity,
    (CAST(floor(l_quantity) AS INTEGER) % 5 + 5) / 10e0 AS confidence, 'part ' || l_partkey AS title, 'line ' || l_linenumber || ' of part ' || l_partkey AS description,
    CASE WHEN l_partkey % 3 = 0 THEN 'ab**' || l_linenumber END AS masked_evidence, 'fix ' || (l_partkey % 7) AS fix_suggestion, 'regex' AS detected_by,
    CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000000 AS det_ordinal,
    sha256(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || CAST(floor(l_extendedprice * 100 + 0.5e0) AS BIGINT)
      || '|' || CAST(floor(l_quantity) AS INTEGER)) AS id
  FROM lineitem),
uniq AS (SELECT * FROM finding QUALIFY row_number() OVER (
  PARTITION BY scan_job_id, file_path, category, coalesce(line_start, 0) ORDER BY det_ordinal, id) = 1),
rank5 AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END AS sev,
  CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS weight FROM uniq),
job AS (
  SELECT 'job-' || o_orderkey AS id, 'user-' || o_custkey AS user_id, 'https://github.com/org/r' || (o_orderkey % 50) AS repo_url,
    'org/r' || (o_orderkey % 50) AS repo_name, substr(sha256(o_orderkey::VARCHAR), 1, 40) AS commit_sha,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed'
         WHEN o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS status,
    0 AS total_files, CAST(CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN o_orderkey % 900 ELSE 0 END AS INTEGER) AS scanned_files,
    o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 5 MINUTE END AS completed_at, o_orderkey AS k
  FROM orders)"""

FIVE = ", ".join(f"count_if(severity = '{s}') AS {s}_count" for s in R.SEVERITIES)


def summed(source: str, keys: str) -> str:
    """CTE ``summed``: per-key figures of a report over ``source`` (with a ``weight``)."""
    return f"""per_cat AS (SELECT {keys}, category, count(*) AS n FROM {source} GROUP BY ALL),
cats AS (SELECT {keys}, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS category_counts FROM per_cat GROUP BY ALL),
five AS (SELECT {keys}, sum(weight) AS raw, count(*) AS n_findings, {FIVE} FROM {source} GROUP BY ALL),
summed AS (SELECT * FROM five JOIN cats USING ({keys}))"""


SUMMARY_COLUMNS = """CAST(least(coalesce(raw, 0), 100) AS INTEGER) AS risk_score, coalesce(n_findings, 0) AS n_findings,
  coalesce(critical_count, 0) AS critical_count, coalesce(high_count, 0) AS high_count,
  '{' || """ + " || ',' || ".join(f"'\"{s}\":' || coalesce({s}_count, 0)" for s in R.SEVERITIES) + """ || '}' AS severity_counts"""

COUNTED = f"""{scannable('kept', 500)},
counted AS (SELECT t.repo_url, t.commit_sha, count(*) AS total_files,
    (SELECT least(count(*), 1000) FROM kept k WHERE k.repo_url = t.repo_url) AS files_scanned FROM tree t GROUP BY ALL)"""

WEIGHTED = """weighted AS (SELECT *, CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS weight,
    CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS sev
  FROM (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY repo_url, file_path, category, coalesce(line_start, 0) ORDER BY det_ordinal) = 1))"""

STATUS = """WITH ev AS (
  SELECT 'job-' || user_id AS job_id, ts, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
    CASE event_type WHEN 'signup' THEN 'queue' WHEN 'view' THEN 'fetcher' WHEN 'click' THEN 'prefilter' WHEN 'purchase' THEN 'reporter' WHEN 'error' THEN 'analyzer' END AS current_node,
    'step ' || event_type AS message, CAST(event_id % 50 AS INTEGER) AS files_scanned, 50 AS total_files FROM events),
last AS (SELECT job_id, ts, status, current_node, message, files_scanned, total_files FROM ev
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1)"""

REQUESTS = """req AS (SELECT 'https://github.com/org/u' || user_id AS repo_url, substr(sha256(user_id::VARCHAR), 1, 40) AS commit_sha, ts, event_id AS request_id, event_type FROM events),
done AS (SELECT repo_url, commit_sha, ts AS completed_at, 'job-' || request_id AS job_id FROM req WHERE event_type = 'purchase')"""


def replay(ttl: int, tail: str) -> str:
    return f"""WITH RECURSIVE {REQUESTS},
hop AS (SELECT repo_url, ts, min(ts) OVER (PARTITION BY repo_url ORDER BY ts
  RANGE BETWEEN INTERVAL {ttl} SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM req),
miss AS (SELECT repo_url, min(ts) AS ts FROM req GROUP BY ALL
  UNION ALL SELECT m.repo_url, h.nxt FROM miss m JOIN hop h ON h.repo_url = m.repo_url AND h.ts = m.ts WHERE h.nxt IS NOT NULL)
{tail}"""


REPLAYED = """SELECT r.repo_url, r.commit_sha, r.request_id, r.ts, m.ts IS NULL AS cached FROM req r LEFT JOIN miss m ON r.repo_url = m.repo_url AND r.ts = m.ts"""


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    columns = "repo_url, commit_sha, ordinal, path, size"
    out["scannable_files"] = f"{SCAN} SELECT {columns} FROM s"
    out["scannable_files_small_limit"] = f"WITH {FILES}, {scannable('s', SMALL_KB)} SELECT {columns} FROM s"
    out["file_caps"] = f"""{SCAN}, placed AS (SELECT *, row_number() OVER (PARTITION BY repo_url, commit_sha ORDER BY ordinal, path) AS n FROM s)
SELECT {columns} FROM placed WHERE n <= {min(SMALL_TREE_CAP, SMALL_SCAN_CAP)}"""
    out["tree_counts"] = f"""WITH {FILES}, {scannable('s', SMALL_KB)}, k AS (SELECT repo_url, count(*) AS n FROM s GROUP BY ALL)
SELECT t.repo_url, t.commit_sha, count(*) AS total_files, least(coalesce(any_value(k.n), 0), {SMALL_TREE_CAP}) AS files_scanned,
  least(coalesce(any_value(k.n), 0), {SMALL_SCAN_CAP}) AS files_read FROM tree t LEFT JOIN k USING (repo_url) GROUP BY t.repo_url, t.commit_sha"""
    out["parse_repo_urls"] = """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
u AS (
  SELECT page_id, 0 AS form, url AS repo_url FROM p UNION ALL SELECT page_id, 1, 'https://github.com/' || host || '/r' || page_id FROM p
  UNION ALL SELECT page_id, 2, 'github.com/' || host || '/r' || page_id || '//' FROM p
  UNION ALL SELECT page_id, 3, 'https://github.com/' || host || '/r' || page_id || '.git' FROM p
  UNION ALL SELECT page_id, 4, host || '/r' || page_id FROM p UNION ALL SELECT page_id, 5, 'http://github.com/' || host FROM p
  UNION ALL SELECT page_id, 6, 'https://github.com/o' || page_id || '/my.github.io' FROM p
  UNION ALL SELECT page_id, 7, 'https://www.github.com/' || host || '/r' || page_id FROM p),
b AS (SELECT *, string_split(replace(replace(replace(replace(rtrim(repo_url, '/'), 'https://', ''), 'http://', ''), 'github.com/', ''), '.git', ''), '/') AS parts FROM u)
SELECT page_id, CAST(form AS INTEGER) AS form, repo_url, CASE WHEN len(parts) >= 2 THEN parts[1] END AS owner, CASE WHEN len(parts) >= 2 THEN parts[2] END AS repo,
  CASE WHEN len(parts) >= 2 THEN parts[1] || '/' || parts[2] END AS repo_name, len(parts) < 2 AS rejected FROM b"""
    out["decode_contents"] = f"WITH {FILES} SELECT path, CAST(length(content) AS INTEGER) AS chars, sha256(content) AS sha FROM tree WHERE content IS NOT NULL"
    out["language_tags"] = f"""WITH {FILES} SELECT path, name, selection_ext, rule_ext, syntax_ext, rule_lang, report_lang,
  'scan:' || sha256(repo_url || ':' || commit_sha) AS cache_key FROM named"""
    out["injection_findings"] = scan(R.INJECTION_RULES)
    out["ssrf_requests_findings"] = scan(R.by_id("SSRF_REQUESTS"))
    out["auth_findings"] = scan(R.AUTH_RULES)
    out["ai_findings"] = scan(R.AI_RULES)
    out["rate_limit_findings"] = scan([R.RATE_LIMIT, R.RATE_LIMIT_AUTH])
    out["python_syntax_findings"] = SYNTAX
    out["secret_findings"] = scan(R.SECRET_RULES)
    out["rule_hit_counts"] = scan_all("""SELECT repo_url, rule_id, category, severity, count(*) AS n_files, min(line_start) AS first_line FROM every GROUP BY ALL""")
    out["scan_unique_contents"] = scan_all()
    out["rule_texts"] = scan_all("SELECT rule_id, description, fix AS fix_suggestion, count(*) AS n_findings FROM every GROUP BY ALL")
    out["suspicion_scores"] = f"""{SCAN}, {found_all()}, {SCORES}
SELECT repo_url, file_path, secret_score, injection_score, auth_score, ai_score, rate_score, suspicion_score FROM scored"""
    out["flagged_files"] = f"""{SCAN}, {found_all()}, {SCORES}
SELECT repo_url, file_path, report_lang AS language, suspicion_score, regex_hits, ast_hits, n_findings,
  row_number() OVER (PARTITION BY repo_url, commit_sha ORDER BY suspicion_score DESC, file_path) AS flag_rank FROM flagged"""
    out["review_requests"] = f"""{SCAN}, {found_all()}, {SCORES},
asked AS (SELECT *, 'File under review: ' || file_path || {NL} || '<untrusted_code>' || {NL} || content || {NL} || '</untrusted_code>' AS user_text FROM flagged)
SELECT repo_url, file_path, CASE WHEN suspicion_score >= 0.6e0 THEN 'deep' ELSE 'fast' END AS route,
  CASE WHEN suspicion_score >= 0.6e0 THEN 'llm_deepseek' ELSE 'llm_groq' END AS model_used, listed,
  CAST(length(user_text) AS INTEGER) AS user_chars, sha256(user_text) AS user_sha FROM asked"""
    out["normalised_responses"] = responses()
    out["merged_findings"] = f"""{SCAN}, {found_all()},
both_kinds AS (
  SELECT repo_url, commit_sha, file_path, line_start, category, severity, title, description, fix AS fix_suggestion, detected_by, rule_id, det_ordinal FROM every
  UNION ALL SELECT repo_url, commit_sha, path, 1, 'crypto_failure', 'low', 'seen', 'd1', 'f1', 'llm_groq', 'REVIEW', 7000000000 FROM s
  UNION ALL SELECT repo_url, commit_sha, path, CAST(size AS INTEGER), 'input_validation', 'info', 'size', '', '', 'llm_groq', 'REVIEW', 7000000001 FROM s)
SELECT repo_url, file_path, line_start, category, severity, title, description, fix_suggestion, detected_by, rule_id FROM both_kinds
QUALIFY row_number() OVER (PARTITION BY repo_url, commit_sha, file_path, category, coalesce(line_start, 0) ORDER BY det_ordinal) = 1"""
    out["dedup_findings"] = f"{STORED} SELECT * FROM uniq"
    out["ranked_findings"] = f"""{STORED} SELECT scan_job_id, row_number() OVER (PARTITION BY scan_job_id ORDER BY sev, confidence DESC, file_path, det_ordinal, id) AS rank_in_job,
  severity, confidence, file_path, category, line_start, id FROM rank5"""
    out["severity_counts"] = f"{STORED} SELECT scan_job_id, {FIVE} FROM uniq GROUP BY ALL"
    out["category_counts"] = f"{STORED} SELECT scan_job_id, category, count(*) AS n_findings FROM uniq GROUP BY ALL"
    out["risk_scores"] = f"""{STORED} SELECT j.id AS scan_job_id, CAST(least(coalesce(sum(weight), 0), 100) AS INTEGER) AS risk_score, count(f.id) AS n_findings
FROM job j LEFT JOIN rank5 f ON f.scan_job_id = j.id GROUP BY ALL"""
    out["scan_summary"] = f"""{STORED}, {summed('rank5', 'scan_job_id')}
SELECT j.id AS scan_job_id, repo_url, {SUMMARY_COLUMNS}, coalesce(category_counts, '{{}}') AS category_counts
FROM job j LEFT JOIN summed m ON m.scan_job_id = j.id"""
    out["scan_report"] = f"""{SCAN}, {found_all()}, {WEIGHTED}, {summed('weighted', 'repo_url')}, {COUNTED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY sev, confidence DESC, file_path, det_ordinal) AS r FROM weighted),
nested AS (SELECT repo_url, CAST((r - 1) // 500 AS INTEGER) AS page, to_json(list({{'rank_in_job': r, 'file_path': file_path, 'line_start': line_start, 'line_end': line_end, 'category': category,
  'severity': severity, 'confidence': confidence, 'title': title, 'description': description, 'masked_evidence': masked_evidence, 'fix_suggestion': fix, 'code_snippet': code_snippet, 'detected_by': detected_by}} ORDER BY r))::VARCHAR AS findings FROM ranked GROUP BY ALL)
SELECT c.repo_url, replace(c.repo_url, 'https://github.com/', '') AS repo_name, c.commit_sha, total_files, files_scanned, risk_score, n_findings, coalesce(page, 0) AS page,
  CAST(greatest((n_findings + 499) // 500, 1) AS INTEGER) AS pages, severity_counts, category_counts, findings FROM (
  SELECT c.repo_url, c.commit_sha, total_files, files_scanned, {SUMMARY_COLUMNS}, coalesce(category_counts, '{{}}') AS category_counts
  FROM counted c LEFT JOIN summed USING (repo_url)) c LEFT JOIN nested USING (repo_url)"""
    out["repo_risk"] = f"""{SCAN}, {found_all()}, {WEIGHTED}, {summed('weighted', 'repo_url')}, {COUNTED}
SELECT c.repo_url, c.commit_sha, total_files, files_scanned, {SUMMARY_COLUMNS} FROM counted c LEFT JOIN summed USING (repo_url)"""
    out["job_results"] = f"""{STORED}, caller AS (
  SELECT 'job-' || o_orderkey AS job_id, 'user-' || c AS caller_id FROM (
    SELECT o_orderkey, o_custkey AS c FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders))
SELECT f.scan_job_id, repo_name, commit_sha, status, total_files, scanned_files, f.id AS finding_id, file_path, line_start, line_end, category, severity,
  confidence, title, description, masked_evidence, fix_suggestion, detected_by FROM job j JOIN finding f ON f.scan_job_id = j.id
WHERE EXISTS (SELECT 1 FROM caller c WHERE c.job_id = j.id AND c.caller_id = j.user_id)"""
    out["user_findings"] = f"""{STORED}
SELECT u.id, u.username, count(DISTINCT j.id) AS n_jobs, count(DISTINCT f.scan_job_id) AS n_jobs_with_findings, count(f.id) AS n_findings,
  count(*) FILTER (WHERE f.severity = 'critical') AS n_critical
FROM (SELECT 'user-' || c_custkey AS id, c_name AS username FROM customer) u LEFT JOIN job j ON j.user_id = u.id LEFT JOIN finding f ON f.scan_job_id = j.id GROUP BY ALL"""
    out["users_upsert"] = """WITH u AS (SELECT 'user-' || c_custkey AS id, c_custkey::VARCHAR AS github_id, c_name AS username,
    CASE WHEN c_custkey % 3 <> 0 THEN c_custkey || '@example.org' END AS email, 'https://img.example.org/' || c_custkey AS avatar_url FROM customer),
up AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'n' || o_custkey ELSE o_custkey::VARCHAR END AS github_id, 'renamed-' || o_orderkey AS username,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '@new.example.org' END AS email, 'https://img.example.org/new/' || o_orderkey AS avatar_url, o_orderdate, o_orderkey FROM orders),
head AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY github_id ORDER BY o_orderdate, o_orderkey) = 1),
tail AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY github_id ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT u.id, u.github_id, u.username, u.email, coalesce(t.avatar_url, u.avatar_url) AS avatar_url FROM u LEFT JOIN tail t USING (github_id)
UNION ALL SELECT 'gh-' || left(sha256(h.github_id), 32), h.github_id, h.username, h.email, t.avatar_url FROM head h JOIN tail t USING (github_id)
WHERE h.github_id NOT IN (SELECT github_id FROM u)"""
    out["job_current_state"] = f"""{STATUS}
SELECT job_id, arg_max(status, (ts, seq)) AS status, min(ts) FILTER (status = 'pending') AS created_at, max(ts) FILTER (status = 'running') AS started_at,
  max(ts) FILTER (status IN ('completed', 'failed')) AS completed_at,
  coalesce(arg_max(files_scanned, (ts, seq)) FILTER (status = 'completed'), 0) AS scanned_files,
  arg_max(message, (ts, seq)) FILTER (status = 'failed') AS error_message, 0 AS total_files FROM ev GROUP BY ALL"""
    out["job_latest_status"] = f"{STATUS} SELECT *, ((SELECT max(ts) FROM ev) - ts) < INTERVAL 360 SECOND AS visible FROM last"
    out["job_status_delete"] = f"{STATUS} SELECT * FROM last WHERE status <> 'completed'"
    day = "INTERVAL 86400 SECOND"
    out["requests_to_scan"] = f"""WITH {REQUESTS} SELECT repo_url, commit_sha, ts, request_id FROM req r WHERE event_type <> 'purchase' AND NOT EXISTS (
  SELECT 1 FROM done d WHERE d.repo_url = r.repo_url AND d.commit_sha = r.commit_sha AND d.completed_at <= r.ts AND r.ts < d.completed_at + {day})"""
    out["cache_hits"] = f"""WITH {REQUESTS} SELECT r.repo_url, r.commit_sha, r.ts, r.request_id, d.job_id, d.completed_at FROM req r
ASOF JOIN done d ON r.repo_url = d.repo_url AND r.ts >= d.completed_at WHERE r.event_type <> 'purchase' AND r.ts < d.completed_at + {day}"""
    out["request_replay"] = replay(3600, REPLAYED)
    out["request_replay_day"] = replay(86400, REPLAYED)
    out["user_by_id"] = """SELECT 'user-' || c_custkey AS id, c_custkey::VARCHAR AS github_id, c_name AS username,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey || '@example.org' END AS email, 'https://img.example.org/' || c_custkey AS avatar_url FROM customer
WHERE c_custkey = (SELECT o_custkey FROM orders ORDER BY o_orderdate, 'job-' || o_orderkey LIMIT 1)"""
    out["job_by_id"] = f"""{STORED} SELECT id, user_id, repo_url, repo_name, commit_sha, status, total_files, scanned_files, created_at, completed_at FROM job
ORDER BY created_at DESC, id DESC LIMIT 1"""
    out["stored_findings"] = f"""{STORED}, at_job AS (SELECT id AS scan_job_id, k, CASE WHEN k % 7 = 0 THEN 11 WHEN k % 3 = 0 THEN 10 ELSE 9 END AS attempt FROM job)
SELECT f.id, scan_job_id, file_path, line_start, line_end, category, severity, confidence, title, description, masked_evidence, fix_suggestion,
  CAST(NULL AS VARCHAR) AS code_snippet, detected_by, CASE attempt WHEN 9 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS created_at
FROM finding f JOIN at_job j USING (scan_job_id) WHERE attempt = 9 OR attempt = 10 AND k % 6 = 3 AND severity IN ('critical', 'high')"""
    out["checkout_files"] = f"""WITH {FILES} SELECT CASE ordinal % 6 WHEN 0 THEN '.github/' WHEN 1 THEN '__pkg__/' ELSE '' END || path AS path,
  CAST(size AS BIGINT) AS size, sha, CAST(length(content) AS INTEGER) AS chars FROM tree WHERE content IS NOT NULL"""
    out["users_merged"] = out["users_upsert"]
    out["job_status_tombstones"] = f"""{STATUS}, ends AS (SELECT job_id, ts, seq FROM ev QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1)
SELECT last.* FROM last JOIN ends USING (job_id) WHERE ends.seq % 7 <> 0"""
    out["cached_reports"] = f"""WITH {REQUESTS} SELECT 'scan:' || sha256(r.repo_url || ':' || r.commit_sha) AS cache_key, r.request_id, r.ts, d.job_id, r.repo_url,
  CAST(substr(d.job_id, 5)::BIGINT % 101 AS INTEGER) AS risk_score, CAST(substr(d.job_id, 5)::BIGINT % 3 AS INTEGER) AS critical, 'found by ' || d.job_id AS first_title
FROM req r ASOF JOIN done d ON r.repo_url = d.repo_url AND r.ts >= d.completed_at WHERE r.event_type <> 'purchase' AND r.ts < d.completed_at + {day}"""
    out["stream_scan"] = scan_all()
    out["stream_admission"] = replay(86400, "SELECT repo_url, commit_sha, request_id, ts FROM (" + REPLAYED + ") WHERE NOT cached")
    out["stream_status"] = f"{STATUS} SELECT * FROM last"
    return out
