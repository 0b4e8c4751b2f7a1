"""What the fit of the start weights sends between tasks."""

import numpy as np
from pyspark.sql import functions as F

from lintlake.llm import lm_mixing as lm


def test_bits_leave_a_task_in_pages(spark):
    rnd = np.random.default_rng(5)
    tables = [rnd.integers(-127, 128, n, np.int8) for n in [16 * s for s in lm.SLOTS] + [256 * s for s in lm.ESCAPED]]
    texts = [f"the cat {i} sat on Ä mat {rnd.integers(1 << 40)}" for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("text")).coalesce(2)
    pages = -(-24 * lm.LEVELS ** 3 // lm.PAGE)
    got = lm._bits(rows, tables).collect()
    assert 0 < len(got) <= 2 * pages
    counts = np.zeros(pages * lm.PAGE, np.int64)
    for r in got:
        lm._add(counts[r["page"] * lm.PAGE:(r["page"] + 1) * lm.PAGE], r["cells"])
    middle = len(lm.EDGES) - 1
    level = lambda o: middle + (o > 0) * int(np.searchsorted(lm.EDGES[:-1], o, side="right")) - (o < 0) * int(np.searchsorted(lm.EDGES[:-1], -o, side="right"))
    plain = np.zeros_like(counts)
    for depth, at in ((4, 0), (8, 4)):
        own = tables[:3] if depth == 4 else tables[3:]
        for _, part in lm._parts([t.lower().encode() if t.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()) for t in texts]):
            _, symbol, slots, _ = list(lm._symbols(part, tables))[depth == 8]
            for i, s in enumerate(symbol):
                for g in range(depth):
                    if depth == 8 and g >= 4 and s == lm.LAST:
                        continue
                    node, cell = (int(s) + (1 << depth)) >> (depth - g), 0
                    for t, k in zip(own, slots, strict=True):
                        cell = cell * lm.LEVELS + level(int(t[(int(k[i]) << depth) + node]))
                    plain[((g + at) * lm.LEVELS ** 3 + cell) * 2 + (int(s) >> (depth - 1 - g) & 1)] += 1
    assert (plain == counts).all()


def test_a_half_takes_half_the_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "Model", lambda halves: seen.extend(h.rdd.getNumPartitions() for h in halves))
    rows = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(40)
    lm.learn(rows)
    assert seen == [20, 20]
