"""Source divergence, importance resampling and top-k search against plain Python, with every odd row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from conftest import CHECK, TABLES
from pyspark.sql import functions as F
from test_queries import plain

from lintlake.llm import queries, resampling, source_audit, top_k

LONG = "wort " * 30_000
ODD = [(0, None, None, None), (1, "", "de", "a"), (2, " \n\t9", "de", "a"), (3, "Über straße Ab", None, "a"), (4, "ab AB cd", "de", "b"), (5, "ab ef", "de", "b"),
       (6, LONG, "de", "c"), (7, LONG.upper() + "ab", "de", None), (8, "😀 ½ x", "en", "c"), (8, "😀 ½ x", "en", "c"), (None, "no id", "en", "a"), (9, "solo", "fr", "a")]


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in ("id", "n", "p", "row", "rank", "term", "block", "bag", "_row", "_down", "place")})


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_importance_resampling", "op13_top_k_search"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{CHECK}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, CHECK).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) > 0
    assert plain(ours) == plain(theirs)


# --- source divergence --------------------------------------------------------------------------

def audit_by_hand(rows, min_docs):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded(text))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + math.floor(Fraction(10**9 * (c[t] + 2), total + 2 * len(kept))) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < 10}
    return out


@pytest.mark.parametrize("min_docs,cells", [(1, 1 << 20), (1, 4), (2, 1 << 20), (9, 8)])
def test_audit_of_odd_rows(odd, min_docs, cells):
    got = [tuple(r) for r in source_audit.audit(odd, min_docs=min_docs, cells=cells).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(ODD, min_docs)


def test_audit_of_random_tables(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"{rnd.choice('abcdefgh')}{'x' * rnd.randrange(4)}" for _ in range(rnd.randrange(60))), rnd.choice("pq"), rnd.choice("stuv")) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for cells in (16, 1 << 20):
        assert {tuple(r) for r in source_audit.audit(df, min_docs=4, cells=cells).collect()} == audit_by_hand(rows, 4)


def test_runs_and_pieces():
    rnd = random.Random(2)
    import numpy as np
    for _ in range(200):
        a, b = (np.array(sorted(rnd.choices(range(1, 9), k=30))) if rnd.random() < .5 else np.array(rnd.choices([1, 5], k=30)) for _ in "ab")
        assert source_audit.pair_value(source_audit._runs(a), source_audit._runs(b), 30) == sum((x - y) ** 2 // (x + y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    text = ("wort " * 500_000 + "x" * 3_000_000 + " ende").encode()
    pieces = [t for p in source_audit._pieces(text) for t in p]
    assert pieces == re.findall(rb"[a-z]+", text)


def test_audit_of_nothing(odd):
    assert source_audit.audit(odd.limit(0)).count() == 0


# --- importance resampling ----------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def features(text, n=2):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resample_by_hand(rows, target, buckets, min_words, percent):
    s = Counter(x % buckets for r in rows for x in features(r[1]))
    t = Counter(x % buckets for r in target for x in features(r[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text, *_ in rows:
        x = features(text)
        weight = sum(gain[b % buckets] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), len(words(text))])
    may = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(may[:percent * len(may) // 100])}
    return sorted((*r[:4], ranks.get(id(r))) for r in out) if None not in [r[0] for r in out] else Counter((*r[:4], ranks.get(id(r))) for r in out)


TARGET = [(0, "ab cd ef"), (1, None), (2, "no id ½"), (2, "")]


@pytest.mark.parametrize("min_words,percent", [(0, 100), (1, 50), (2, 25), (20, 25), (10**9, 25)])
def test_resampling_of_odd_rows(spark, odd, min_words, percent):
    aim = spark.createDataFrame(TARGET, "item_id long, text string")
    got = Counter(tuple(r) for r in resampling.resample(odd, aim, buckets=50, min_words=min_words, percent=percent, segment_rows=3).collect())
    assert got == resample_by_hand(ODD, TARGET, 50, min_words, percent)


def test_resampling_of_nothing(spark, odd):
    aim = spark.createDataFrame(TARGET, "item_id long, text string")
    assert resampling.resample(odd.limit(0), aim).count() == 0
    got = resampling.resample(odd, aim.limit(0), buckets=50, min_words=1, percent=50)
    assert Counter(tuple(r) for r in got.collect()) == resample_by_hand(ODD, [], 50, 1, 50)
    assert resampling.drawn(odd.filter("doc_id < 8"), aim, buckets=50, min_words=1, percent=100).count() == 6


@pytest.mark.parametrize("segment_rows", [50, 7, 1])
def test_ranks_are_exact_with_ties_and_a_hot_key(spark, segment_rows):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 2, rnd.randrange(10**9)]), rnd.choice([5, 5, 5, -3, rnd.randrange(1000)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, score long, mark long").repartition(7)
    got = resampling.ranked(df, segment_rows=segment_rows).collect()
    order = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(1, 901)) and {r["mark"] for r in order} == set(range(900))
    keys = [(-r["score"], r["id"] is None, r["id"] or 0) for r in order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_of_very_long_texts_and_words(n):
    rnd = random.Random(n)
    for text in ("ab Cd 9é " * 700_000, "x" * 60 + " " + "é" * 40 + " y " + "z" * 49 + " " + "q" * 48, "w" * 9_000_000 + " ab cd", " ".join(rnd.choice(["a", "bb" * 30, "Ü"]) for _ in range(500))):
        raw = text.encode()
        count, found = resampling._long_text(raw, n, 10_000)
        assert count == len(words(text)) and Counter(found.tolist()) == Counter(x % 10_000 for x in features(text, n))
        import numpy as np
        count, found = resampling._features(raw, np.array([len(raw) + 1]), n, 10_000)
        assert count.sum() == len(words(text)) and Counter(found.tolist()) == Counter(x % 10_000 for x in features(text, n))


# --- top-k search -------------------------------------------------------------------------------

def search_by_hand(rows, k, scale=256):
    ok = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x * scale) for x in v):
            ok.append((i, n, [math.floor(x * scale) for x in v]))
    out = []
    for i, n, a in ok:
        if i % 50 == 0:
            scores = sorted((-max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), j) for j, m, b in ok if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def vectors(kind, rnd):
    one = {"small": lambda: rnd.choice([-1.0, 0.5, 0.25, 0.001]), "real": lambda: rnd.gauss(0, 1), "large": lambda: rnd.choice([1e7, -3e8, 2.0 ** 40]),
           "huge": lambda: rnd.choice([1e30, -1e12, 3.0])}[kind]
    rows = [(i, [one() for _ in range(6)]) for i in range(-100, 120)]
    rows += [(50, [1.0] * 6)] * 3 + [(i, [1.0] * 6) for i in range(200, 260)]
    rows += [(300, None), (350, []), (400, [1.0, None]), (450, [float("nan")] * 6), (500, [float("inf")] * 6), (None, [1.0] * 6), (550, [1.0] * 9), (551, [2.0])]
    return rows


@pytest.mark.parametrize("kind", ["small", "real", "large", "huge"])
@pytest.mark.parametrize("block_bytes", [700, 1 << 20])
def test_top_k_equals_brute_force(spark, kind, block_bytes):
    rows = vectors(kind, random.Random(3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "row", "block", "v", "n", "state")})
    for k in (1, 5, 400):
        if k == 5 or block_bytes == 700 and kind != "huge":
            got = sorted(tuple(r) for r in top_k.search(df, F.col("vec_id") % 50 == 0, k=k, block_bytes=block_bytes).collect())
            assert got == search_by_hand(rows, k)


def test_top_k_of_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = F.col("vec_id") % 50 == 0
    assert top_k.search(make([]), asks).count() == 0
    assert top_k.search(make([(0, [1.0])]), asks).count() == 0
    assert top_k.search(make([(1, [1.0]), (2, [1.0])]), asks).count() == 0
    assert [tuple(r) for r in top_k.search(make([(0, [1.0]), (2, [-1.0])]), asks).collect()] == [(0, 1, 2, -65536)]
    assert sorted(tuple(r) for r in top_k.search(make([(0, []), (50, [])]), asks).collect()) == [(0, 1, 50, 0), (50, 1, 0, 0)]
