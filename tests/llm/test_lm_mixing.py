"""The mixing model bit by bit in plain Python, and its start weights."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import lm_mixing as lm
from lintlake.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def random_tables():
    rnd = np.random.default_rng(3)
    return [rnd.integers(-127, 128, n, np.int8) for n in [16 * s for s in lm.SLOTS] + [256 * s for s in lm.ESCAPED]]


def symbols(text, depth):
    """(symbol, slots) per position of the text: codes of all bytes, or numbers of the escaped ones."""
    buf = np.frombuffer(lm.PAD + text, np.uint8)
    slots = lm._contexts(buf)
    for at in range(len(lm.PAD), len(buf)):
        code = lm.COMMON.find(bytes([buf[at]]))
        if depth == 4:
            yield (code if code >= 0 else 15), [int(s[at]) for s in slots]
        elif code < 0:
            escaped = [b for b in range(256) if b not in lm.COMMON]
            yield escaped.index(buf[at]), [int(s[at]) % e for s, e in zip(slots, lm.ESCAPED)]


def plain_score(text, tables, start):
    total = 0.0
    for depth in (4, 8):
        own = tables[:3] if depth == 4 else tables[3:]
        width, all_symbols = 1 << depth, list(symbols(text + b"\n", depth))
        weights = [[start[depth][k][g] for k in range(3)] for g in range(depth)]
        refined = [[1 / (1 + math.exp(-((b + 0.5) * 16 / lm.BUCKETS - 8))) for b in range(lm.BUCKETS)] for _ in range(depth)]
        for a in range(0, len(all_symbols), lm.BLOCK):
            slope, moved = [[0.0] * 3 for _ in range(depth)], [[0.0] * lm.BUCKETS for _ in range(depth)]
            for symbol, slots in all_symbols[a:a + lm.BLOCK]:
                node = 1
                for g in range(depth):
                    bit = symbol >> (depth - 1 - g) & 1
                    odds = [float(t[s * width + node]) / lm.SCALE for t, s in zip(own, slots)]
                    z = min(max(sum(w * o for w, o in zip(weights[g], odds)), -8), 7.99)
                    p, bucket = 1 / (1 + math.exp(-z)), int((z + 8) * lm.BUCKETS / 16)
                    q = min(max((p + refined[g][bucket]) / 2, 1e-4), 1 - 1e-4)
                    if not (depth == 8 and symbol == lm.LAST and g >= 4):
                        total += math.log2(q if bit else 1 - q)
                    for k in range(3):
                        slope[g][k] += (bit - p) * odds[k]
                    moved[g][bucket] += bit - refined[g][bucket]
                    node = 2 * node + bit
            for g in range(depth):
                weights[g] = [w + lm.RATE * s for w, s in zip(weights[g], slope[g])]
                refined[g] = [min(max(r + lm.MAP_RATE * m, 0), 1) for r, m in zip(refined[g], moved[g])]
    return total


def test_scores_bit_by_bit(random_tables):
    start = {d: np.random.default_rng(d).uniform(0, 0.3, (3, d)) for d in (4, 8)}
    texts = [b"", b"a", b"the cat sat on the mat", "über élan 42 xyz €".encode(), b"some words qqq of mixed pm fw " * 30, bytes(range(33, 256)) * 3]
    part = [lm.PAD + t + b"\n" for t in texts]
    got = lm._bit_scores(part, random_tables, start)
    for text, score in zip(texts, got, strict=True):
        assert score == pytest.approx(plain_score(text, random_tables, start), rel=2e-3, abs=1e-3)


def test_contexts_know_earlier_bytes_of_the_same_text_only():
    first, second = lm.PAD + b"one two three\n", lm.PAD + b"and on the two th\n"
    alone, joined = lm._contexts(np.frombuffer(second, np.uint8)), lm._contexts(np.frombuffer(first + second, np.uint8))
    changed = lm._contexts(np.frombuffer(second[:-4] + b"xyz\n", np.uint8))
    for a, j, c in zip(alone, joined, changed, strict=True):
        assert (a[len(lm.PAD):] == j[len(first) + len(lm.PAD):]).all()
        assert (a[:len(second) - 3] == c[:len(second) - 3]).all()


def test_start_weights_are_the_best_ones(spark, random_tables):
    rows = [(i, f"the cat {i} sat on the mat in the house of a dog") for i in range(40)]
    sample = spark.createDataFrame(rows, "id long, text string").select(F.col("text").cast("binary").alias("text"))
    small = [t // 8 for t in random_tables]
    fitted = lm._fitted(sample, small)
    parts = [lm.PAD + t.encode() + b"\n" for _, t in rows]

    def loss(weights, tables=small):
        total = sum(float(((w - lm.START) ** 2).sum()) * lm.RIDGE / 2 for w in weights.values())
        for depth, symbol, slots, known in lm._symbols(parts, tables):
            for g in range(depth):
                node, bit = (symbol + (1 << depth)) >> (depth - g), symbol >> (depth - 1 - g) & 1
                odds = np.stack([t[s * (1 << depth) + node] for s, t in zip(slots, known)]) / lm.SCALE
                z = np.clip(weights[depth][:, g] @ odds, -8, 7.99)
                total += float(np.log1p(np.exp(np.where(bit == 1, -z, z))).sum())
        return total

    best = loss(fitted)
    assert best < loss(lm._start())
    for depth in (4, 8):
        for at in ((0, 0), (1, 2), (2, 3)):
            for step in (-0.1, 0.1):
                other = {d: w.copy() for d, w in fitted.items()}
                other[depth][at] += step
                assert best <= loss(other) + 1e-6
    wild = lm._fitted(sample, random_tables)
    assert loss(wild, random_tables) <= loss(lm._start(), random_tables)
    nothing = lm._fitted(sample.limit(0), random_tables)
    assert all((nothing[d] == lm._start()[d]).all() for d in (4, 8))


def test_sample_is_counted_once_and_held_out_texts_teach_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    kept = docs.filter(~lm.held_out(F.col("doc_id")))
    model = lm.learn(kept)
    texts = [b" ".join(lm.tokens((r["text"] or "").encode())) for r in kept.collect()]
    cells = [np.zeros(s * w, np.int64) for s, w in zip(lm.SLOTS + lm.ESCAPED, (16,) * 3 + (256,) * 3)]
    for _, part in lm._parts(texts):
        for (depth, symbol, slots, own) in lm._symbols(part, cells):
            for s, c in zip(slots, own):
                np.add.at(c, s.astype(np.int64) * (1 << depth) + symbol, 1)
    for order, (c, table) in enumerate(zip(cells, model.tables, strict=True)):
        pages = np.unique(np.flatnonzero(c) // lm.PAGE)
        for page in pages[::97]:
            a = slice(page * lm.PAGE, (page + 1) * lm.PAGE)
            assert lm._odds(order, c[a].astype(float)) == table[a].tobytes()
    changed = docs.withColumn("text", F.when(lm.held_out(F.col("doc_id")), F.lit("zzz")).otherwise(F.col("text")))
    other = lm.learn(changed.filter(~lm.held_out(F.col("doc_id"))))
    assert all((model.weights[d] == pytest.approx(other.weights[d])) for d in (4, 8)) and model.n == other.n


def test_held_out_texts_code_better_than_with_the_weights_by_hand(spark, monkeypatch):
    total = lambda: queries.op3_lm_scoring(spark, SMALL).filter("held_out").agg(F.sum("score")).first()[0]
    fitted = total()
    monkeypatch.setattr(lm, "ROUNDS", 0)
    assert fitted > total()


def test_repeated_and_null_keys_and_clashing_columns(spark):
    rows = [(None, "the cat", 1.0)] * 3 + [(5, "the cat", 1.0)] * 2 + [(6, None, 1.0), (7, "", 1.0), (8, "x" * 300_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lm.scores(df).collect()
    assert len(got) == len(rows) and all(r["score"] < 0 for r in got)
    same = {round(r["score"], 6) for r in got if r["doc_id"] in (None, 5)}
    assert len(same) == 1
    learned = [t for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    assert {r["train_tokens"] for r in got} == {sum(len((t or "").split()) + 1 for t in learned)}


@pytest.mark.parametrize("most", [1, 200, 60_000, 4_000_000_000, 1 << 40])
def test_packed_counts_come_back(most):
    rnd = np.random.default_rng(most)
    counts = rnd.integers(0, most + 1, lm.PAGE) * (rnd.random(lm.PAGE) < 0.1)
    counts[-1] = most
    back = np.ones(lm.PAGE, np.int64)
    lm._add(back, lm._packed(counts))
    assert (back == counts + 1).all() and lm._packed(np.zeros(lm.PAGE, np.int64)) == b""
