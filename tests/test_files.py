import base64
import hashlib

from pyspark.sql import functions as F

from lintlake.functions import text as T
from lintlake.operators import score
from lintlake.operators.rulescan import scan_distinct, scan_rules, with_rule_texts
from lintlake import rules as R
from lintlake.sources import checkout
from lintlake.sources import files as S
from lintlake.sources.repourl import owner_and_repo


def tree(spark, rows):
    return spark.createDataFrame(
        [("r", "c", i, t, p, size, "s", "x") for i, (t, p, size) in enumerate(rows)], S.REPO_FILES_SCHEMA)


def test_selection_boundaries(spark):
    rows = [
        ("blob", "a.py", 500 * 1024), ("blob", "b.py", 500 * 1024 + 1), ("blob", "c.py", None), ("tree", "d.py", 1),
        ("blob", "x/Package-Lock.JSON", 1), ("blob", "x/Dockerfile", 1), ("blob", "v1.0/Dockerfile", 1), ("blob", "a.b/noext", 1),
        ("blob", "py", 1), ("blob", ".ENV", 1), ("blob", ".gitignore", 1), ("blob", "m.md", 1), ("blob", "T.TSX", 1),
    ]
    kept = [r["path"] for r in S.scannable(tree(spark, rows)).orderBy("ordinal").collect()]
    assert kept == ["a.py", "c.py", "x/Dockerfile", "v1.0/Dockerfile", ".ENV", "T.TSX"]


def test_caps_keep_tree_order(spark):
    rows = [("r" + str(i % 2), "c", (i * 37) % 101, "blob", f"f{i}.py", 1, "s", "x") for i in range(101)]
    got = S.first_files(spark.createDataFrame(rows, S.REPO_FILES_SCHEMA), 7).collect()
    want = {r: sorted((x[2], x[4]) for x in rows if x[0] == r)[:7] for r in ("r0", "r1")}
    assert {r: sorted((g["ordinal"], g["path"]) for g in got if g["repo_url"] == r) for r in want} == want


def test_caps_with_a_hot_repository_repeated_rows_and_null_places(spark):
    rows = [("hot", "c", i, "blob", f"f{i}.py", 1, "s", f"x{i}") for i in range(5000)]
    rows += [("two", "c", None, "blob", "n.py", 1, "s", "n"), ("two", "c", 1, "blob", None, 1, "s", "p"), ("two", "c", 2, "blob", "b.py", 1, "s", "b")]
    rows += [("same", "c", 1, "blob", "a.py", 1, "s", t) for t in "uvw"] + [(None, "c", 1, "blob", "a.py", 1, "s", "x")]
    df = spark.createDataFrame(rows, S.REPO_FILES_SCHEMA)
    # A map of 2 ** 15 bits lets many wrong rows through; the join behind it drops them.
    for bits in (15, 28):
        got = {(r["repo_url"], r["path"], r["content"]) for r in S.first_files(df, 900, 2, bits=bits).collect()}
        assert got == {("hot", "f0.py", "x0"), ("hot", "f1.py", "x1"), ("two", "n.py", "n"), ("two", None, "p")} | {("same", "a.py", t) for t in "uvw"}
    assert S.first_files(df, 3000, bits=15).filter("repo_url = 'hot'").count() == 3000
    assert S.first_files(df.limit(0), 5).count() == 0


def test_decoding_replaces_bad_bytes(spark):
    raw = [b"abc", b"", b"\xff\xfea", b"\xe2\x82", b"ok \xf0\x9f\x98\x80 \x80"]
    encoded = [base64.encodebytes(b).decode() for b in raw]
    df = spark.createDataFrame(list(enumerate(encoded)), "i int, e string").orderBy("i")
    got = [r["t"] for r in df.select(S.decode_content(F.col("e")).alias("t")).collect()]
    assert got == [b.decode("utf-8", errors="replace") for b in raw]


def test_checkout_source(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    kept = {"src/a.py": b"DEBUG = True \xff", "b.md": b"x", ".env": b"KEY=1", "pkg/__init__.py": b"", ".github/workflows/wf.yml": b"on: push",
            "root/nested/root/c.py": b"c", "_private/d.py": b"d", "sp ace/\u00e9 %20.py": b"e", "big.py": b"z" * 3000}
    for path, content in kept.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (root / "empty").mkdir()
    monkeypatch.chdir(tmp_path)
    for name in (str(root), str(root) + "/", "root", f"file://{root}", f"file:{root}"):
        got = {r["path"]: r for r in S.read_checkout(spark, name, "u", "c").collect()}
        assert {p: r["size"] for p, r in got.items()} == {p: len(c) for p, c in kept.items()}
        assert {p: r["content"] for p, r in got.items()} == {p: c.decode(errors="replace") for p, c in kept.items()}
        assert got["b.md"]["sha"] == hashlib.sha256(b"x").hexdigest()
    small = {r["path"]: r["content"] for r in S.read_checkout(spark, str(root), "u", "c", max_kb=1).collect()}
    assert small["big.py"] is None and small["b.md"] == "x" and set(small) == set(kept)
    many = checkout.load_tree(spark, str(root), partition_files=2)
    assert many.rdd.getNumPartitions() == 5 and many.count() == len(kept)
    assert checkout.load_tree(spark, str(root / "empty")).count() == 0


def test_a_tree_written_and_read(spark, tmp_path):
    rows = [(f"d{i % 3}/.x/{i}.py", None if i == 4 else f"text {i} \u00e9") for i in range(30)]
    checkout.write_tree(spark.createDataFrame(rows, "path string, content string").repartition(4), str(tmp_path / "t"))
    back = {r["path"]: bytes(r["content"]).decode() for r in checkout.load_tree(spark, f"file://{tmp_path}/t").collect()}
    assert back == {p: t for p, t in rows if t is not None}


def test_masking_and_languages(spark):
    df = spark.createDataFrame([("12345678", "py"), ("123456789", "a/b.JSX"), ("x", "a.b/noext")], "s string, p string")
    got = df.select(T.mask_secret(F.col("s")).alias("m"), T.rule_language(F.col("p")).alias("l"), T.report_language(F.col("p")).alias("r"),
                    T.rule_extension(F.col("p")).alias("x"), T.syntax_extension(F.col("p")).alias("y")).collect()
    assert [tuple(r) for r in got] == [
        ("****", "any", "unknown", "", "py"), ("1234****6789", "javascript", "unknown", "jsx", "jsx"), ("****", "any", "unknown", "b/noext", "b/noext")]


def test_repository_urls(spark):
    cases = {
        "https://github.com/o/r": ("o", "r"), "github.com/o/r/": ("o", "r"), "https://github.com/o/r.git": ("o", "r"), "o/r": ("o", "r"),
        "https://github.com/o": None, "https://github.com/o/my.github.io": ("o", "myhub.io"), "https://www.github.com/o/r": ("www.o", "r"),
        "http://github.com/o/r///": ("o", "r"), "/r": ("", "r"), "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r["u"]: tuple(r["p"]) if r["p"] else None for r in df.select("u", owner_and_repo(F.col("u")).alias("p")).collect()}
    assert got == cases


def test_empty_and_missing_contents(spark, files):
    assert scan_rules(files(("a.py", ""), ("b.py", None))).count() == 0


def test_copies_are_scanned_once_and_all_reported(spark):
    rows = [(f"r{i % 3}", "c", i, "blob", f"d{i}/a.py" if i % 2 else f"d{i}/a.js", 1, "sha1" if i % 5 else "sha2",
             "eval(x)\nDEBUG = True" if i % 5 else "pickle.loads(x)\nexec(x)") for i in range(40)]
    df = spark.createDataFrame(rows, S.REPO_FILES_SCHEMA)
    key = lambda d: sorted((r["repo_url"], r["file_path"], r["rule_id"], r["line_start"], r["det_ordinal"]) for r in d.collect())
    assert key(scan_distinct(df)) == key(scan_rules(df)) != []


def test_texts_follow_rules(files):
    rows = with_rule_texts(scan_rules(files(("a.py", "DEBUG = True\nexec(x)")))).collect()
    for r in rows:
        rule = R.ALL_RULES[R.RULE_NO[r["rule_id"]]]
        assert (r["description"], r["fix_suggestion"]) == (rule.description, rule.fix)
    assert {r["rule_id"] for r in rows} == {"DEBUG_TRUE", "PY_EXEC_CALL"}


def test_scores_flags_and_routes(files):
    df = files(
        ("clean.py", "x = 1"), ("tree.py", "assert x"), ("js.go", "os.system(x)"), ("one.py", "DEBUG = True"),
        ("two.py", "DEBUG = True\nverify=False"), ("many.py", "DEBUG=True\nverify=False\nhashlib.md5(x)\njwt.decode(x)"),
        ("route.py", "@app.get('/x')"), ("ai.py", "llm\nprompt = f'x'"), ("gate.py", "gpt\nresponse.innerHTML"),
    )
    got = {r["file_path"]: round(r["suspicion_score"], 3) for r in score.suspicion_scores(df).collect()}
    assert got == {"clean.py": 0.0, "tree.py": 0.0, "js.go": 0.333, "one.py": 0.333, "two.py": 0.667, "many.py": 1.0,
                   "route.py": 0.5, "ai.py": 0.5, "gate.py": 0.0}
    flagged = score.flagged(df)
    assert {r["file_path"]: r["n_findings"] for r in flagged.collect()} == {
        "tree.py": 1, "js.go": 0, "one.py": 1, "two.py": 2, "many.py": 4, "route.py": 1, "ai.py": 1, "gate.py": 1}
    asked = {r["file_path"]: r for r in score.review_requests(flagged).collect()}
    assert {p for p, r in asked.items() if r["route"] == "deep"} == {"two.py", "many.py"}
    assert asked["two.py"]["model_used"] == "llm_deepseek" and asked["one.py"]["model_used"] == "llm_groq"
    assert asked["tree.py"]["system_text"].endswith("- Assert statement")
    assert asked["one.py"]["system_text"].endswith("(the scanner found nothing)")
    assert asked["one.py"]["user_text"].endswith("<untrusted_code>\nDEBUG = True\n</untrusted_code>")
    ranks = {r["file_path"]: r["flag_rank"] for r in score.ranked_flagged(df).collect()}
    assert ranks["many.py"] == 1 and ranks["two.py"] == 2 and sorted(ranks.values()) == list(range(1, 9))
    hits = {r["file_path"]: r["ast_hits"] for r in flagged.collect()}
    assert hits["tree.py"] == ["Assert statement"]


def test_fallback_tag(spark):
    from lintlake.functions.scoring import model_tag

    row = spark.range(1).select(model_tag(F.lit("qwen/q-2"), F.lit("fallback")).alias("t")).first()
    assert row["t"] == "llm_fallback_qwen"
