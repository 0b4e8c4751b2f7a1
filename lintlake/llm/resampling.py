"""Importance resampling towards a target distribution, with exact ranks by parallel sorting.

Features are runs of one to ``n`` words, hashed to buckets by CRC-32. A bucket's gain is the log ratio of how often the
target and the corpus use it; a text's weight is the mean gain of its features, looked up in one array of gains (its size
is the number of buckets, whatever the input). Gumbel noise from a keyed hash of the id is added, and the highest scores are drawn without
replacement.

Ranks come from parallel sorting by regular sampling: every partition is sorted into a run; each run gives every g-th of its
rows, of which every so-and-so-many-th splits the order into segments; runs are cut at the splitters, segments exchanged
and merged, and the segments' counts, added up, turn places inside a segment into ranks. A segment holds at most twice its even share of rows
whatever the scores, as rows that agree in score and id are told apart by a row number. Segments number at most
``MAX_SEGMENTS``, so at most 2 * MAX_SEGMENTS ** 2 samples go to the driver; a segment grows with the input beyond that, and is sorted and spilled by Spark.

Edge cases: NULL and empty texts have no features and weigh 0. A NULL id counts as the empty string in the noise and comes last
among ties. Rows with one id get the same noise and ranks of their own. An empty table gives no rows; an empty target or corpus leaves
all gains to the smoothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import written

BUCKETS = 10_000
SEGMENT_ROWS = 1 << 16
MAX_SEGMENTS = 512
RUN_BYTES = 1 << 20
SHORT = 48

# Bytes of words: digits, small letters and everything outside ASCII; A-Z are lowered first.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _crc_table() -> np.ndarray:
    """CRC-32 of the reflected polynomial EDB88320, byte by byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _shift_tables() -> np.ndarray:
    """[length, byte of the register, its value]: what that many zero bytes make of the register, which is linear in it."""
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT):
        out[n + 1] = _CRC[out[n] & 255] ^ (out[n] >> 8)
    return out


_SHIFT = _shift_tables()


def _crc_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each buf[start:end], continuing the CRC ``before`` where given (all at once, byte by byte; long ones by zlib)."""
    lengths = ends - starts
    out = np.full(len(starts), _ONES, np.uint32) if before is None else before ^ _ONES
    todo = np.flatnonzero((lengths > 0) & (lengths <= SHORT))
    for at in range(SHORT):
        todo = todo[lengths[todo] > at]
        if not len(todo):
            break
        c = out[todo]
        out[todo] = _CRC[(c ^ buf[starts[todo] + at]) & 255] ^ (c >> 8)
    out ^= _ONES
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = zlib.crc32(buf[starts[i]:ends[i]].tobytes(), 0 if before is None else int(before[i]))
    return out


def _continued(first: np.ndarray, second: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC of "u v", from the CRCs of u and of v, and v itself where it is long."""
    c = first ^ _ONES
    c = _CRC[(c ^ np.uint32(32)) & 255] ^ (c >> 8)
    lengths = ends - starts
    n, x = np.minimum(lengths, SHORT), c ^ _ONES
    out = second ^ _SHIFT[n, 0, x & 255] ^ _SHIFT[n, 1, (x >> 8) & 255] ^ _SHIFT[n, 2, (x >> 16) & 255] ^ _SHIFT[n, 3, x >> 24]
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = zlib.crc32(buf[starts[i]:ends[i]].tobytes(), int(c[i] ^ _ONES))
    return out


def _features(data: bytes, doc_ends: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and the buckets of all features, text by text. Texts end before ``doc_ends``, at a separator byte."""
    buf = np.frombuffer(data.translate(_LOWER), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _IN_WORD[buf], [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    doc = np.searchsorted(doc_ends, starts, "right")
    crc = _crc_words(buf, starts, ends)
    out, ok = np.zeros((len(starts), n), np.uint32), np.zeros((len(starts), n), bool)
    if len(starts):
        out[:, 0], ok[:, 0] = crc, True
        run = crc
        for k in range(1, min(n, len(starts))):
            run = _continued(run[:-1], crc[k:], buf, starts[k:], ends[k:])
            out[:len(run), k], ok[:len(run), k] = run, doc[k:] == doc[:-k]
    return np.bincount(doc, minlength=len(doc_ends)), out[ok] % np.uint32(buckets)


def _pieces(text: bytes, n: int) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces that share n - 1 words, with the number of words that the piece before has counted."""
    size, begin, shared = 4 * RUN_BYTES, 0, 0
    in_word = lambda p: bool(_IN_WORD[_LOWER[text[p]]])
    while True:
        end = begin + size
        while end < len(text) and in_word(end):
            end += 1
        yield text[begin:end], shared
        if end >= len(text):
            return
        back, shared = end, 0
        while shared < n - 1:
            while back > begin and not in_word(back - 1):
                back -= 1
            if back == begin:
                break
            while back > begin and in_word(back - 1):
                back -= 1
            shared += 1
        begin, size = back, max(4 * RUN_BYTES, 2 * (end - back))


def _long_text(text: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    words, parts = 0, []
    for piece, shared in _pieces(text, n):
        count, found = _features(piece, np.array([len(piece) + 1]), n, buckets)
        # What lies within the shared words has been counted.
        inner = _features(b" ".join(_words(piece, shared)), np.array([1 << 62]), n, buckets)[1] if shared else np.zeros(0, np.uint32)
        words += int(count.sum()) - shared
        parts.append(found if not len(inner) else _without(found, inner))
    return words, np.concatenate(parts)


def _words(piece: bytes, first: int) -> list[bytes]:
    buf = np.frombuffer(piece.translate(_LOWER), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _IN_WORD[buf], [False])).astype(np.int8)))
    return [piece[a:b] for a, b in zip(edge[0:2 * first:2].tolist(), edge[1:2 * first:2].tolist(), strict=True)]


def _without(found: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``found`` without one occurrence for each entry of ``gone`` (a bag has no order)."""
    left = np.ones(len(found), bool)
    for b in gone.tolist():
        left[np.flatnonzero(left & (found == b))[0]] = False
    return found[left]


def bags(docs: DataFrame, key: str, text: str = "text", n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, bag): the buckets of a text's features, as 2-byte (or, from 65,537 buckets on, 4-byte) numbers."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, bag binary"

    def emit(ids: pa.Array, words: np.ndarray, found: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate(([0], np.cumsum(counts))) * kind().itemsize
        bag = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(found.astype(kind))])
        return pa.RecordBatch.from_arrays([ids, pa.array(words.astype(np.int64)), bag], names=["id", "n_words", "bag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(1)
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]).astype(np.int64)
            upto = np.cumsum(size + 1)
            while at < len(texts):
                base = int(upto[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(upto, base + RUN_BYTES, "right")))
                ids = batch.column(0).slice(at, end - at)
                if size[at] > 4 * RUN_BYTES:
                    count, found = _long_text(texts[at].as_py(), n, buckets)
                    yield emit(ids, np.array([count]), found, np.array([len(found)]))
                else:
                    words, found = _features(b" ".join(texts.slice(at, end - at).to_pylist()), upto[at:end] - base, n, buckets)
                    yield emit(ids, words, found, sum(np.maximum(words - k, 0) for k in range(n)))
                at = end

    return rows.mapInArrow(run, schema)


def counts(bagged: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs; added up inside a partition first."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bag in batch.column(0):
                total += np.bincount(np.frombuffer(bag.as_buffer(), kind), minlength=buckets) if len(bag.as_buffer()) > 4096 else 0
            small = b"".join(b for b in batch.column(0).to_pylist() if len(b) <= 4096)
            total += np.bincount(np.frombuffer(small, kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    return bagged.select("bag").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * ln of the smoothed ratio of shares) per bucket; ``buckets`` numbers on the driver."""
    all_ = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = all_.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    of = lambda df: float((df.agg(F.sum("n")).first()[0] or 0) + buckets)
    every, wanted = of(corpus), of(target)
    ratio = ((F.col("t") + 1).cast("double") * F.lit(every)) / ((F.col("s") + 1).cast("double") * F.lit(wanted))
    found = {r["bucket"]: r["g"] for r in rows.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("g")).collect()}
    return [found[b] for b in range(buckets)]


def weighed(bagged: DataFrame, gain: list[int]) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each bag, 0 for an empty one."""
    kind, table = np.uint16 if len(gain) <= 1 << 16 else np.uint32, np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bag = batch.column(2)
            size = np.fromiter((len(b.as_buffer()) // kind().itemsize for b in bag), np.int64, len(bag))
            sums = np.fromiter((int(table[np.frombuffer(b.as_buffer(), kind)].sum()) for b in bag), np.int64, len(bag))
            weight = np.where(size > 0, sums // np.maximum(size, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return bagged.mapInArrow(run, f"id {bagged.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, the same for the same id and seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296)))


def _segment_of(splitters: list[tuple[int, int, int]]):
    """Number of splitters at or before each row, in the order (score down, id, row)."""
    down, ids, rows = (np.array([s[i] for s in splitters], np.int64) for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            of = lambda name, more: np.concatenate((more, np.asarray(batch.column(batch.schema.get_field_index(name))).astype(np.int64)))  # noqa: E731, B023
            is_row = np.concatenate((np.zeros(len(down), np.int8), np.ones(n, np.int8)))
            order = np.lexsort((is_row, of("_row", rows), of("_id", ids), of("_down", down)))
            passed = np.empty(len(order), np.int64)
            passed[order] = np.cumsum(is_row[order] == 0)
            yield batch.append_column("_segment", pa.array(passed[len(down):].astype(np.int32)))
    return run


def ranked(rows: DataFrame, score: str = "score", key: str = "id", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``rows`` with ``rank`` (from 1; score down, then key up), by parallel sorting by regular sampling."""
    big = (1 << 63) - 1
    placed = rows.select("*", (-F.col(score)).alias("_down"), F.coalesce(F.col(key), F.lit(big)).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_row"))
    placed = written(placed, "resampling-rows")
    n = placed.count()
    parts = max(1, min(MAX_SEGMENTS, -(-n // segment_rows)))
    by = ["_down", "_id", "_row"]
    runs = written(placed.coalesce(parts).sortWithinPartitions(*by), "resampling-runs")
    step = max(1, n // (parts * parts))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange((step - 1 - seen) % step, batch.num_rows, step)
            seen += batch.num_rows
            yield batch.take(pa.array(at))

    splitters: list[tuple[int, int, int]] = []
    if parts > 1:
        # A partition of the stored runs may hold several of them; sorting it again gives one run.
        regular = sorted(tuple(r) for r in runs.select(*by).coalesce(parts).sortWithinPartitions(*by).mapInArrow(sample, "_down long, _id long, _row long").collect())
        splitters = [regular[len(regular) * i // parts] for i in range(1, parts)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", _segment int"
    cut = written(runs.mapInArrow(_segment_of(splitters), schema), "resampling-segments")
    sizes, before, total = {r["_segment"]: r["n"] for r in cut.groupBy("_segment").agg(F.count("*").alias("n")).collect()}, [], 0
    for i in range(parts):
        before.append(total)
        total += sizes.get(i, 0)
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_segment") + 1)
    inside = F.row_number().over(Window.partitionBy("_segment").orderBy(*by))
    return cut.withColumn("rank", inside + offset).drop(*by, "_segment")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text",
             n: int = 2, buckets: int = BUCKETS, min_words: int = 20, percent: int = 25, seed: str = "7", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; ``rank`` is NULL where it is not drawn. ``percent`` of the documents
    with at least ``min_words`` words are drawn."""
    bagged = written(bags(docs, key, text, n, buckets), "resampling-bags")
    aim = bags(target, target_key, target_text, n, buckets)
    gain = gains(written(counts(bagged, buckets), "resampling-counts"), written(counts(aim, buckets), "resampling-counts"), buckets)
    scored = weighed(bagged, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = written(scored, "resampling-scores")
    may = F.col("n_words") >= min_words
    draw = scored.filter(may).count() * percent // 100
    out = ranked(scored.filter(may), segment_rows=segment_rows)
    out = out.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(~may).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select("id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, with their own columns. ``key`` must tell the rows apart."""
    taken = resample(docs, target, key, **options).filter("rank is not null").select(F.col("id").alias("_drawn"))
    return docs.join(taken, docs[key].eqNullSafe(taken["_drawn"]), "left_semi")
