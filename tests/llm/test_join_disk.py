"""What the near-duplicate join keeps on disk, and that its pages of signatures lose nothing."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lintlake import session
from lintlake.llm import ngram_join


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(1 for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_"))


def test_a_written_table_leaves_no_exchange_behind(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own, before = spark.conf.get(key, None), shuffle_files(spark)
    made = session.written(spark.range(20_000).repartition(8, "id"), "kept")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert made.count() == 20_000 and spark.conf.get(key, None) == own


def test_signatures_are_not_stored(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"{rnd.randrange(1 << 40):x}" for _ in range(400))) for i in range(400)]
    rows += [(1000 + i, t + " and more") for i, t in rows[:20]]
    monkeypatch.setattr(session, "work_dir", lambda spark: str(tmp_path))
    got = {r["id"]: (r["component"], r["n_links"]) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i % 1000, int(i % 1000 < 20)) for i, _ in rows}
    kept = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0 < kept < 0.4 * sum(len(t) for _, t in rows)


def components(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    out = defaultdict(set)
    for x in list(up):
        out[top(x)].add(x)
    return sorted(map(sorted, out.values()))


def test_meetings_of_pages(monkeypatch):
    rnd = random.Random(6)
    filed = defaultdict(set)
    # Two buckets of several signatures each, hot ones among them; one signature runs over many batches.
    sigs = [(b << 48) | (x << 16) for b in (7, 8, 900) for x in range(12)]
    for k, sig in enumerate(sigs):
        for _ in range((1, 2, 5, 23, 24, 25, 40, 300)[k % 8]):
            filed[sig].add((rnd.randrange(500), rnd.random() < 0.4))
    need = {sid: rnd.randrange(1, 9) for sid in range(500)}
    want, hot = Counter(), []
    for entries in filed.values():
        entries = sorted(entries)
        if len(entries) > ngram_join.HOT:
            hot += [(sid, entries[0][0]) for sid, _ in entries]
            continue
        for i, (a, p) in enumerate(entries):
            want.update((a, b, max(need[a], need[b])) for b, q in entries[i + 1:] if a != b and not (p and q))
    assert want and hot
    rows = [(sig, sid << 16 | probe << 15 | need[sid]) for sig, entries in filed.items() for sid, probe in entries]
    # A class that comes again files the same once more.
    rows += rnd.sample(rows, 60)
    rnd.shuffle(rows)
    pages = []
    for k in range(0, len(rows), 40):
        part = rows[k:k + 40]
        for bucket, page in ngram_join._pages(np.array([r[0] for r in part], np.uint64), np.array([r[1] for r in part], np.uint64)):
            pages += zip(bucket.to_pylist(), page.to_pylist(), strict=True)
    pages.sort(key=lambda p: p[0])
    docs = [(None, None, i, 3, bytes([i])) for i in range(5)]
    schema = pa.schema([("bucket", pa.int64()), ("page", pa.binary()), ("id", pa.int64()), ("n_elements", pa.int64()), ("class", pa.binary())])
    for held, gathered, size in ((1 << 21, 1 << 20, 10_000), (30, 20, 1), (200, 100, 3)):
        monkeypatch.setattr(ngram_join, "HELD", held)
        monkeypatch.setattr(ngram_join, "GATHERED", gathered)
        given = [*docs, *((b, p, None, None, None) for b, p in pages)]
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in given[k:k + size]], schema) for k in range(0, len(given), size)]
        got = [r for b in ngram_join._meetings(iter(batches)) for r in b.to_pylist()]
        assert Counter((r["a"], r["b"], r["need"]) for r in got if r["kind"] == 0) == want
        assert components((r["a"], r["b"]) for r in got if r["kind"] == 1) == components(hot)
        assert [(r["id"], r["n_elements"], r["class"]) for r in got if r["kind"] == 2] == [d[2:] for d in docs]
