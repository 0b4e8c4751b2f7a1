"""Language-model scores by logistic mixing of hashed-context bit predictors, next to a unigram base score.

A text is scored as its lower-cased words joined by one space and closed by an end byte, bit by bit. A byte is written in 4
bits where it is one of 15 common letters, else as an escape of 4 bits and the byte's own 8. Each predictor hashes its
context (the last 2 bytes with the last word of up to 3 bytes, which tells languages apart; the last 4 bytes; the word before with the word so far) to a slot,
in which a binary tree over the next symbol holds the chance of a 1 per node, from counts over all training documents.
The predictors' log-odds are combined by weights, gated by the bit's place in the symbol; weights follow the
coding error online, in steps of one block of the document, and an adaptive map refines the result. Every bit is
predicted from earlier bits and the model only, so the probabilities of all texts add up to at most one.

The weights that each document begins with are fitted to all training documents, each under tables that have not seen it: documents are
dealt into two halves by hash of the key, which are counted apart, and each half is coded with the other's counts. One job over all texts counts
the bits by (gate, log-odds of the predictors by level), a bounded number of cells, from which Newton's method finds the best weights. Then both
halves' counts are added. Held-out texts take no part.

Scale: counting is one Arrow pass with sums per task before the shuffle; what is gathered grows with the corpus, but
the model doesn't: one number of 8 bits per cell, ``16 * sum(SLOTS) + 256 * sum(ESCAPED)`` bytes, which is collected in pages
and broadcast; contexts beyond the slots share them. A task counts in 16 bits per cell and carries what is over. The unigram vocabulary is unbounded, so only tokens that make up 1 / ``FREQUENT`` of the training text or
more (thus at most ``FREQUENT`` of them, of 64 bytes at most) are broadcast; occurrences of the others are joined by token.

Edge cases: NULL, empty and blank texts have one token (the end) and one byte. Repeated rows are scored each and count each.
Without training documents all counts are 0 and the predictors know nothing; where one half has none, the weights are ``START``. All rows of a
key are in one half, NULL being a key. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.hashing import hash_slices
from lintlake.session import arrow_rows, written

#: Slots of the predictors: 2 bytes and the last short word, 4 bytes, the word before and the word so far; and those of the escaped bytes.
SLOTS = (1 << 18, 1 << 18, 1 << 20)
ESCAPED = (1 << 14, 1 << 14, 1 << 15)
COMMON = b" etaoinsrhldcug"
#: Cells of the tables travel in pages.
PAGE = 1 << 14
FREQUENT = 1 << 19
FLUSH_TOKENS = 300_000
BLOCK = 256
#: Texts are hashed and counted in parts of this size, and mixed in larger ones, so that a step has many documents.
PART_BYTES, MIX_BYTES = 1 << 17, 1 << 20
#: Cells of a task hold less than this; what is over is carried.
CARRY = 1 << 15
#: Blocks that are mixed at once, of codes; of escaped bytes half as many.
BLOCKS = 128
SCALE = 15.0
RATE, START = 0.004, 0.4
#: The start weights are fitted in this many rounds; ``RIDGE`` draws them to ``START`` where bits are few.
ROUNDS, RIDGE = 6, 1.0
#: For that, stored log-odds are rounded to the middles of levels, which begin at these numbers and their negatives; exact up to 16.
EDGES = np.array([*range(1, 17), 17, 23, 30, 39, 51, 67, 87, 108, 128])
LEVELS = 2 * len(EDGES) - 1
BUCKETS, MAP_RATE = 24, 0.01
PAD = b"\n\n\n\n\n"
END = b""

ESCAPE = len(COMMON)
CODE = np.full(256, ESCAPE, np.uint8)
CODE[np.frombuffer(COMMON, np.uint8)] = np.arange(ESCAPE)
#: The escaped bytes in order; 241 of 256 numbers are in use, so the second half of the last one's bits is certain (0).
RANK = np.cumsum(CODE == ESCAPE).astype(np.int32) - 1
LAST = 256 - ESCAPE - 1
ROWS = 2000


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _contexts(buf: np.ndarray) -> list[np.ndarray]:
    """The slot of each predictor at each byte of a buffer that begins with padding."""
    n, b = len(buf), buf.astype(np.uint32)
    last = lambda k: np.concatenate((np.full(k, 10, np.uint32), b[:n - k]))
    two = last(1) | last(2) << np.uint32(8)
    four = two | last(3) << np.uint32(16) | last(4) << np.uint32(24)
    at = np.arange(n)
    blank = (buf == 32) | (buf == 10)
    begin = np.concatenate(([0], np.maximum.accumulate(np.where(blank, at + 1, 0))[:-1]))
    word = hash_slices(buf, begin, at)
    ends = np.flatnonzero(blank)
    size = ends - begin[ends]
    # A line's end is a text's end: what follows knows no short word.
    marks = ends[(size > 0) & (size <= 3) | (buf[ends] == 10)]
    short = np.where(buf[marks] == 10, 0, word[marks] >> np.uint64(32)).astype(np.uint32)
    gaps = np.diff(np.concatenate(([0], marks + 1, [n])))
    hint = np.repeat(np.concatenate((np.zeros(1, np.uint32), short)), gaps)
    before = np.where(buf[ends] == 10, np.uint64(0), word[ends] * np.uint64(0x9E3779B97F4A7C15))
    word += np.repeat(np.concatenate((np.zeros(1, np.uint64), before)), np.diff(np.concatenate(([0], ends + 1, [n]))))
    word *= np.uint64(0xD6E8FEB86659FD93)
    spread = lambda x, slots: (x * np.uint32(0x9E3779B1) >> np.uint32(33 - slots.bit_length())).astype(np.int32)
    return [spread(two * np.uint32(0x85EBCA6B) ^ hint, SLOTS[0]), spread(four ^ four >> np.uint32(15), SLOTS[1]),
            (word >> np.uint64(65 - SLOTS[2].bit_length())).astype(np.int32)]


def _parts(texts: list[bytes], most: int = PART_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Documents as padded byte strings, in parts of bounded size and like lengths: (their numbers, strings)."""
    part, size, numbers = [], 0, []
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        part.append(PAD + texts[i] + b"\n")
        numbers.append(i)
        size += len(part[-1])
        if size >= most:
            yield numbers, part
            part, size, numbers = [], 0, []
    if part:
        yield numbers, part


def _pieces(part: list[bytes]) -> Iterator[list[bytes]]:
    """A part's documents in runs of bounded size."""
    begin, size = 0, 0
    for i, doc in enumerate(part):
        size += len(doc)
        if size >= PART_BYTES or i + 1 == len(part):
            yield part[begin:i + 1]
            begin, size = i + 1, 0


def _scored(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a part, and the positions that are not padding."""
    buf = np.frombuffer(b"".join(part), np.uint8)
    keep = np.ones(len(buf), bool)
    starts = np.cumsum([0] + [len(p) for p in part[:-1]])
    keep[(starts[:, None] + np.arange(len(PAD))).ravel()] = False
    return buf, np.flatnonzero(keep)


def _in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``ROWS`` at most, so that the words of few texts are in memory at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (text) summed per task: rows (token, n) of tokens with order -1, and rows (order, page, cells) of the cells."""
    cells = [np.zeros(s * 16, np.uint16) for s in SLOTS] + [np.zeros(s * 256, np.uint16) for s in ESCAPED]
    carried: list[Counter] = [Counter() for _ in cells]
    words: Counter = Counter()

    def of_words() -> pa.RecordBatch:
        n = len(words)
        out = pa.RecordBatch.from_arrays([pa.array(list(words.keys()), pa.binary()), pa.array(list(words.values()), pa.int64()), pa.array(np.full(n, -1, np.int8)),
                                          pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["token", "n", "ord", "page", "cells"])
        words.clear()
        return out

    for batch in _in_rows(batches):
        texts = []
        for x in batch.column(0):
            t = tokens(x.as_py())
            words.update(t)
            words[END] += 1
            texts.append(b" ".join(t))
            if len(words) > FLUSH_TOKENS:
                yield of_words()
        for _, part in _parts(texts):
            buf, at = _scored(part)
            byte = buf[at]
            code = CODE[byte]
            rare = np.flatnonzero(code == ESCAPE)
            for i, slot in enumerate(_contexts(buf)):
                slot = slot[at].astype(np.intp)  # add.at is fast for this type, and for a number of the cells' type
                _tally(cells[i], carried[i], slot * 16 + code)
                _tally(cells[len(SLOTS) + i], carried[len(SLOTS) + i], (slot[rare] & (ESCAPED[i] - 1)) * 256 + RANK[byte[rare]])
    yield of_words()
    for i, counts in enumerate(cells):
        for pages in _cut(counts, carried[i]):
            n = len(pages)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(np.full(n, i, np.int8)), pa.array([x[0] for x in pages], pa.int32()),
                                              pa.array([x[1] for x in pages], pa.binary())], names=["token", "n", "ord", "page", "cells"])


def _tally(cells: np.ndarray, carried: Counter, at: np.ndarray) -> None:
    """Add 1 to the cells at ``at``, which may repeat, and move what reaches ``CARRY`` to ``carried``."""
    for a in range(0, len(at), CARRY):
        now = at[a:a + CARRY]
        np.add.at(cells, now, np.uint16(1))
        full = np.unique(now[_at(cells, now) >= CARRY])
        if len(full):
            cells[full] -= np.uint16(CARRY)
            carried.update(dict.fromkeys(full.tolist(), CARRY))


def _cut(counts: np.ndarray, carried: Counter | None = None) -> Iterator[list[tuple[int, bytes]]]:
    """Counts, with what was carried, as (page, packed cells), a few pages at a time, without those that are all 0."""
    more: dict[int, list[tuple[int, int]]] = {}
    for at, n in (carried or {}).items():
        more.setdefault(at // PAGE, []).append((at % PAGE, n))
    for a in range(0, len(counts), PAGE * 64):
        packed = []
        for b in range(a, min(a + PAGE * 64, len(counts)), PAGE):
            page = counts[b:b + PAGE]
            if b // PAGE in more:
                at, n = np.array(more[b // PAGE]).T
                page = page.astype(np.int64)
                page[at] += n
            packed.append((b // PAGE, _packed(page)))
        yield [(k, x) for k, x in packed if x]


def _packed(counts: np.ndarray) -> bytes:
    """A page's counts: how many are not 0, bytes of a number, then the gaps and numbers, byte by byte of their places, compressed. Empty if all are 0."""
    at = np.flatnonzero(counts)
    if not len(at):
        return b""
    there = counts[at]
    width = next(w for w in (1, 2, 4, 8) if there.max() < 1 << 8 * w)
    planes = [x.view(np.uint8).reshape(len(at), -1).T.tobytes() for x in (np.diff(at, prepend=0).astype("<u2"), there.astype(f"<u{width}"))]
    return len(at).to_bytes(4, "little") + bytes([width]) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _add(leaves: np.ndarray, packed: bytes) -> None:
    n, width = int.from_bytes(packed[:4], "little"), packed[4]
    planes = np.frombuffer(pa.decompress(packed[5:], (2 + width) * n, codec="zstd"), np.uint8)
    at = np.cumsum(np.ascontiguousarray(planes[:2 * n].reshape(2, n).T).view("<u2").ravel(), dtype=np.int64)
    leaves[at] += np.ascontiguousarray(planes[2 * n:].reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def _odds(order: int, leaves: np.ndarray) -> bytes:
    """The log-odds of a 1 at each node of a page's trees, in 8 bits."""
    width = 16 if order < len(SLOTS) else 256
    tree = np.concatenate((np.zeros((PAGE // width, width)), leaves.reshape(-1, width)), axis=1)
    for v in range(width - 1, 0, -1):
        tree[:, v] = tree[:, 2 * v] + tree[:, 2 * v + 1]
    ones, both = np.zeros((PAGE // width, width)), tree[:, :width]
    ones[:, 1:] = tree[:, 3::2]
    p = (ones + 0.4) / (both + 0.8)
    return np.clip(np.rint(np.log(p / (1 - p)) * SCALE), -127, 127).astype(np.int8).tobytes()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Rows (ord, page, cells), sorted by page, to pages and their sums, one page at a time."""
    now, leaves = None, np.zeros(PAGE, np.int64)
    for batch in batches:
        for order, page, cells in zip(*batch.columns, strict=True):
            key = order.as_py(), page.as_py()
            if key != now:
                if now:
                    yield now, leaves
                now, leaves = key, np.zeros(PAGE, np.int64)
            _add(leaves, cells.as_py())
    if now:
        yield now, leaves


def _to_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, page, cells), sorted by page, to (ord, page, odds, cells)."""
    for (order, page), leaves in _sums(batches):
        yield pa.RecordBatch.from_arrays([pa.array([order], pa.int8()), pa.array([page], pa.int32()), pa.array([_odds(order, leaves)], pa.binary()),
                                          pa.array([_packed(leaves)], pa.binary())], names=["ord", "page", "odds", "cells"])


def _to_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, page, cells), sorted by page, to the same with one row for each page."""
    for (order, page), leaves in _sums(batches):
        yield pa.RecordBatch.from_arrays([pa.array([order], pa.int8()), pa.array([page], pa.int32()), pa.array([_packed(leaves)], pa.binary())],
                                         names=["ord", "page", "cells"])


def _by_page(counts: DataFrame) -> DataFrame:
    return counts.select("ord", "page", "cells").repartition("ord", "page").sortWithinPartitions("ord", "page")


def _pages(counts: DataFrame) -> DataFrame:
    """(ord, page, odds, cells): each page once, with the sums of its cells."""
    return written(_by_page(counts.filter("ord >= 0")).mapInArrow(_to_nodes, "ord byte, page int, odds binary, cells binary"), "lm-pages")


class Packed:
    """Tables that are compressed where they are sent or stored."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables

    def __getstate__(self) -> list[tuple[int, bytes]]:
        return [(len(t), pa.compress(t, codec="zstd", asbytes=True)) for t in self.tables]

    def __setstate__(self, state: list[tuple[int, bytes]]) -> None:
        self.tables = [np.frombuffer(pa.decompress(x, n, codec="zstd"), np.int8) for n, x in state]


def _tables(pages: DataFrame) -> list[np.ndarray]:
    """The predictors' tables, page by page."""
    tables = [np.zeros(s * 16, np.int8) for s in SLOTS] + [np.zeros(s * 256, np.int8) for s in ESCAPED]
    for r in pages.select("ord", "page", "odds").toLocalIterator():
        tables[r["ord"]][r["page"] * PAGE:(r["page"] + 1) * PAGE] = np.frombuffer(r["odds"], np.int8)
    return tables


def _start() -> dict[int, np.ndarray]:
    """Weights by symbol's bits: (predictor, gate)."""
    return {depth: np.full((len(SLOTS), depth), START) for depth in (4, 8)}


def _trees(tables: list[np.ndarray], slots: list[np.ndarray], depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each predictor an array with the trees of all positions, and where each position's tree begins in it. Trees of 16 nodes are fetched
    whole, once, as each look into a large table waits for memory."""
    if depth > 4:
        return tables, [s << depth for s in slots]
    whole = [_at(t.view(np.complex128), s).ravel().view(t.dtype) for t, s in zip(tables, slots, strict=True)]
    return whole, [np.arange(slots[0].size, dtype=np.int32).reshape(slots[0].shape) << depth] * len(slots)


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``values[places]``; NumPy takes twice as long where it looks for places out of bounds."""
    return np.take(values, places, mode="wrap")


def _places(begins: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    first = (begins[0] + node).astype(np.intp)
    return [first if b is begins[0] else (b + node).astype(np.intp) for b in begins]


def _bits(texts: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """How many bits of ``texts`` fall into each cell, ``(((gate * LEVELS + level) * LEVELS + level) * LEVELS + level) * 2 + bit``, in pages summed per
    task (ord, page, cells); the gates of escaped bytes follow those of codes."""
    odds = np.arange(256).astype(np.uint8).view(np.int8).astype(np.int32)
    level = (len(EDGES) - 1 + np.sign(odds) * np.searchsorted(EDGES[:-1], np.abs(odds), side="right")).astype(np.int8)
    shared = texts.sparkSession.sparkContext.broadcast(Packed([level[t.view(np.uint8)] for t in tables]))
    size = 2 * LEVELS ** len(SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value.tables
        counts = np.zeros((12, size), np.int64)
        for batch in _in_rows(batches):
            for _, part in _parts([b" ".join(tokens(x.as_py())) for x in batch.column(0)]):
                for depth, symbol, slots, known in _symbols(part, levels):
                    for a in range(0, len(symbol), PART_BYTES):
                        now = symbol[a:a + PART_BYTES]
                        trees, begins = _trees(known, [s[a:a + PART_BYTES] for s in slots], depth)
                        for g in range(depth):
                            node, bit = (now + (1 << depth)) >> (depth - g), now >> (depth - 1 - g) & 1
                            cell = np.zeros(len(now), np.int32)
                            for t, place in zip(trees, _places(begins, node), strict=True):
                                cell *= LEVELS
                                cell += _at(t, place)
                            cell += cell
                            cell += bit
                            if depth == 8 and g >= 4:
                                cell = cell[now != LAST]  # the others are certain bits
                            np.add.at(counts[g + (4 if depth == 8 else 0)], cell.astype(np.intp), 1)
        for pages in _cut(counts.ravel()):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pages), np.int8)), pa.array([x[0] for x in pages], pa.int32()),
                                              pa.array([x[1] for x in pages], pa.binary())], names=["ord", "page", "cells"])

    return texts.mapInArrow(run, "ord byte, page int, cells binary")


def _fitted(texts: DataFrame, tables: list[np.ndarray], *others: tuple[DataFrame, list[np.ndarray]]) -> dict[int, np.ndarray]:
    """The weights that code ``texts`` (text) best with ``tables``, which must not have seen them, and any ``others`` with theirs: Newton's method
    per gate, whose step is halved where the loss grew. The best weights met are kept, so they are never worse than ``START``."""
    bits = _bits(texts, tables)
    for more, known in others:
        bits = bits.unionByName(_bits(more, known))
    # 24 * LEVELS ** 3 cells, in pages.
    size = 24 * LEVELS ** len(SLOTS)
    counts = np.zeros(-(-size // PAGE) * PAGE, np.int64)
    for r in _by_page(bits).mapInArrow(_to_sums, "ord byte, page int, cells binary").collect():
        _add(counts[r["page"] * PAGE:(r["page"] + 1) * PAGE], r["cells"])
    counts = counts[:size].astype(float).reshape(12, -1, 2)
    middle = (EDGES[:-1] + EDGES[1:] - 1) / 2
    axis = np.concatenate((-middle[::-1], [0], middle)) / SCALE
    odds = np.stack([x.ravel() for x in np.meshgrid(axis, axis, axis, indexing="ij")])
    best = _start()
    for depth, weights in best.items():
        for g in range(depth):
            seen = counts[g + (4 if depth == 8 else 0)]
            there = np.flatnonzero(seen.sum(axis=1))
            x, zeros, ones = odds[:, there], seen[there, 0], seen[there, 1]
            tried, step, least = weights[:, g].copy(), np.zeros(len(SLOTS)), np.inf
            for _ in range(ROUNDS):
                p = 1 / (1 + np.exp(-np.clip(tried @ x, -8, 7.99)))
                loss = -(ones @ np.log(p) + zeros @ np.log1p(-p)) + RIDGE / 2 * ((tried - START) ** 2).sum()
                if loss < least:
                    least, weights[:, g] = loss, tried
                    slope = x @ (ones - (ones + zeros) * p) - RIDGE * (tried - START)
                    step = np.linalg.solve((x * ((ones + zeros) * p * (1 - p))) @ x.T + RIDGE * np.eye(len(SLOTS)), slope)
                else:
                    step = step / 2
                tried = weights[:, g] + step
    return best


class Model:
    def __init__(self, halves: list[DataFrame]):
        """``halves``: the training texts (text) in two parts."""
        made = [written(h.mapInArrow(_count, "token binary, n long, ord byte, page int, cells binary"), "lm-counts") for h in halves]
        words = made[0].unionByName(made[1]).filter("ord = -1").groupBy("token").agg(F.sum("n").alias("c"))
        self.words = written(words, "lm-words")
        totals = self.words.agg(F.sum("c"), F.count("*")).first()
        self.n, self.v = int(totals[0] or 0), int(totals[1])
        often = self.words.filter((F.col("c") * FREQUENT >= self.n) & (F.length("token") <= 64))
        self.frequent = {bytes(r["token"]): r["c"] for r in often.collect()}
        pages, kinds = [_pages(m) for m in made], ("ord", "page", "cells")
        self.weights = _fitted(halves[0], _tables(pages[1]), (halves[1], _tables(pages[0])))
        # The sums are exchanged again, not what each task counted.
        self.tables = _tables(_pages(pages[0].select(*kinds).unionByName(pages[1].select(*kinds))))


def _mixed(symbol: np.ndarray, slots: list[np.ndarray], sizes: np.ndarray, tables: list[np.ndarray], depth: int, start: np.ndarray) -> np.ndarray:
    """Sum of log2 of the bits' probabilities per document; ``sizes``: symbols of each, one document after the other."""
    after = np.arange(depth - 1, -1, -1, dtype=np.int32)[:, None, None]
    # Blocks of one document each; the last of a document is filled up with symbols that don't count.
    n_blocks = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), n_blocks)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    order = np.lexsort((doc, step))
    begins = ((np.cumsum(sizes) - sizes)[doc] + step * BLOCK)[order]
    left = np.minimum(sizes[doc] - step * BLOCK, BLOCK)[order]
    weights = np.empty((len(tables), depth, len(sizes)), np.float32)
    weights[:] = start.astype(np.float32)[:, :, None] / np.float32(SCALE)  # for log-odds as they are stored
    centre = (np.arange(BUCKETS) + 0.5) * (16 / BUCKETS) - 8
    adaptive = np.tile((1 / (1 + np.exp(-centre))).astype(np.float32), (depth, len(sizes), 1))
    total, ends = np.zeros(len(sizes)), np.searchsorted(step[order], np.arange(step.max(initial=-1) + 2))
    doc, place = doc[order], np.arange(BLOCK)
    # A step's documents know nothing of each other: a bounded number at a time.
    most = BLOCKS * 4 // depth
    for rows in (slice(a, min(a + most, end)) for begin, end in zip(ends, ends[1:]) for a in range(begin, end, most)):
        d = doc[rows]
        live = (place < left[rows, None]).astype(np.float32)
        where = np.minimum(begins[rows, None] + place, len(symbol) - 1)
        now = symbol[where]
        # Arrays run over (gate, row, place in the block), so that the innermost loops are long.
        node, bit = (now + (1 << depth) >> after) >> 1, (now >> after & 1).astype(np.float32)
        w = weights[:, :, d, None]
        trees, starts = _trees(tables, [s[where] for s in slots], depth)
        o = [_at(t, place).astype(np.float32) for t, place in zip(trees, _places(starts, node), strict=True)]
        z = w[0] * o[0]
        for k in range(1, len(o)):
            z += w[k] * o[k]
        np.clip(z, -8, 7.99, out=z)
        p = np.exp(-z)
        p += 1
        np.reciprocal(p, out=p)
        z += 8
        z *= np.float32(BUCKETS / 16)
        bucket = z.astype(np.int32)
        bucket += (np.arange(depth * len(d), dtype=np.int32) * BUCKETS).reshape(depth, len(d), 1)
        bucket = bucket.astype(np.intp)
        refined = _at(adaptive[:, d].ravel(), bucket)
        q = p + refined
        q *= np.float32(0.5)
        np.clip(q, 1e-4, 1 - 1e-4, out=q)
        if depth == 8:
            q[4:, now == LAST] = 0
        got = np.log2(np.prod(np.abs(bit - 1 + q), axis=0)) * live
        total += np.bincount(d, got.sum(axis=1), len(sizes))
        error = (bit - p) * live
        for k in range(len(o)):
            weights[k][:, d] += np.float32(RATE / SCALE ** 2) * np.einsum("grp,grp->gr", error, o[k])
        moved = np.bincount(bucket.ravel(), ((bit - refined) * live).ravel(), depth * len(d) * BUCKETS).reshape(depth, len(d), BUCKETS)
        adaptive[:, d] = np.clip(adaptive[:, d] + np.float32(MAP_RATE) * moved.astype(np.float32), 0, 1)
    return total


def _symbols(part: list[bytes], tables: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(bits, symbols, slots and tables of the predictors) of a part: of its codes, then of the bytes that its escapes stand for."""
    found = []
    for piece in _pieces(part):
        buf, at = _scored(piece)
        found.append([buf[at], *(s[at] for s in _contexts(buf))])
    byte, *slots = (np.concatenate(x) for x in zip(*found, strict=True))
    code = CODE[byte]
    yield 4, code.astype(np.int32), slots, tables[:len(SLOTS)]
    rare = np.flatnonzero(code == ESCAPE)
    yield 8, RANK[byte[rare]], [s[rare] & np.int32(e - 1) for s, e in zip(slots, ESCAPED, strict=True)], tables[len(SLOTS):]


def _bit_scores(part: list[bytes], tables: list[np.ndarray], start: dict[int, np.ndarray]) -> np.ndarray:
    """Log2 of the probability of each document of a part."""
    sizes = np.array([len(p) - len(PAD) for p in part])
    (_, code, slots, known), (_, rare, rare_slots, escaped) = _symbols(part, tables)
    n_rare = np.bincount(np.repeat(np.arange(len(part)), sizes)[code == ESCAPE], minlength=len(part))
    return _mixed(code, slots, sizes, known, 4, start[4]) + _mixed(rare, rare_slots, n_rare, escaped, 8, start[8])


def score(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` with n_tokens, known, base (both of the frequent tokens only), rare tokens with their numbers, n_bytes and
    log2 of the text's probability, in place of ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(({t: math.log10(c + 1) for t, c in model.frequent.items()}, Packed(model.tables), model.weights))
    keep = [c for c in rows.columns if c != text]
    cut = rows.select(*keep, F.col(text).cast("binary").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, packed, start = shared.value
        tables = packed.tables
        for batch in _in_rows(batches):
            texts, n_tokens, known, base, rare, times, ends = [], [], [], [], [], [], [0]
            for x in batch.column(batch.num_columns - 1):
                t = tokens(x.as_py())
                texts.append(b" ".join(t))
                n_tokens.append(len(t) + 1)
                counts = Counter(t)
                counts[END] += 1
                k, b = 0, 0.0
                for w, c in counts.items():
                    x = logs.get(w)
                    if x is None:
                        rare.append(w)
                        times.append(c)
                    else:
                        k += c
                        b += c * x
                known.append(k)
                base.append(b)
                ends.append(len(rare))
            bits, n_bytes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for numbers, part in _parts(texts, MIX_BYTES):
                bits[numbers] = _bit_scores(part, tables, start)
                n_bytes[numbers] = [len(p) - len(PAD) for p in part]
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], names=["token", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns - 1)]
                + [pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                   pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(n_bytes), pa.array(bits)],
                names=[*keep, "n_tokens", "known", "base", "rare", "n_bytes", "log2_p"])

    return cut.mapInArrow(run, f"{types}, n_tokens long, known long, base double, rare array<struct<token:binary,n:int>>, n_bytes long, log2_p double")


def held_out(key: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def learn(rows: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    half = F.pmod(F.xxhash64(key), F.lit(2))
    # Each task has tables of its own to pack and send; a half has half the rows, so two partitions make a task.
    parts = rows.rdd.getNumPartitions()
    tasks = max(1, min(parts, max(-(-parts // 2), rows.sparkSession.sparkContext.defaultParallelism)))
    return Model([rows.filter(half == h).select(F.col(text).cast("binary").alias("text")).coalesce(tasks) for h in (0, 1)])


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    rows = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text))
    # A batch lies in the JVM and in Python at once, for each task.
    with arrow_rows(docs.sparkSession, ROWS):
        model = learn(rows.filter("not held_out"), key, text)
        out = written(score(rows, model, text).withColumn("_row", F.monotonically_increasing_id()), "lm-scores")
    rare = out.select("_row", F.explode("rare").alias("r")).select("_row", "r.token", "r.n")
    found = rare.join(model.words, "token").groupBy("_row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("add"))
    total = out.drop("rare").join(found, "_row", "left")
    return total.select(
        key, "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"), F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(model.n + model.v + 1))).alias("base_score"),
        (F.col("log2_p") * F.lit(math.log10(2))).alias("score"), (-F.col("log2_p") / F.col("n_bytes")).alias("bits_per_byte"))
