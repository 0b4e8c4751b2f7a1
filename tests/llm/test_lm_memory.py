"""What a task of the scoring keeps in memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lintlake.llm import lm_mixing as lm
from lintlake.session import arrow_rows


def batches(*texts):
    return iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])])


def test_a_task_counts_in_two_bytes_per_cell():
    cells = 16 * sum(lm.SLOTS) + 256 * sum(lm.ESCAPED)
    tracemalloc.start()
    try:
        for _ in lm._count(batches(b"the cat sat on the mat", b"\xc3\xbcber 42")):
            pass
        assert tracemalloc.get_traced_memory()[1] < 3 * cells
    finally:
        tracemalloc.stop()


def test_counts_beyond_two_bytes_are_carried():
    texts = [b"e" * 200_001, b"z" * 70_000, b"e e z" * 30_000]
    got = [np.zeros(n, np.int64) for n in [16 * s for s in lm.SLOTS] + [256 * s for s in lm.ESCAPED]]
    for b in lm._count(batches(*texts)):
        for r in b.to_pylist():
            if r["ord"] >= 0:
                lm._add(got[r["ord"]][r["page"] * lm.PAGE:(r["page"] + 1) * lm.PAGE], r["cells"])
    plain = [np.zeros(len(c), np.int64) for c in got]
    for depth, symbol, slots, own in lm._symbols([lm.PAD + t + b"\n" for t in texts], plain):
        for s, c in zip(slots, own, strict=True):
            np.add.at(c, s.astype(np.int64) * (1 << depth) + symbol, 1)
    assert max(c.max() for c in plain) > 1 << 17
    assert all((a == b).all() for a, b in zip(got, plain, strict=True))


def test_scores_do_not_depend_on_how_documents_are_mixed(monkeypatch):
    rnd = np.random.default_rng(1)
    tables = [rnd.integers(-127, 128, n, np.int8) for n in [16 * s for s in lm.SLOTS] + [256 * s for s in lm.ESCAPED]]
    part = [lm.PAD + b"some words of a text qx " * int(n) + b"\n" for n in rnd.integers(0, 80, 60)]
    whole = lm._bit_scores(part, tables, lm._start())
    monkeypatch.setattr(lm, "BLOCKS", 6)
    monkeypatch.setattr(lm, "PART_BYTES", 1000)
    assert (lm._bit_scores(part, tables, lm._start()) == whole).all()


def test_python_gets_bounded_batches_and_the_session_keeps_its_setting(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = lambda: spark.range(0, 100, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    own = spark.conf.get(key, None)
    with arrow_rows(spark, 7):
        assert max(r["n"] for r in sizes().collect()) == 7
    assert spark.conf.get(key, None) == own
