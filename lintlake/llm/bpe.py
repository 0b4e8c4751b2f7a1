"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens by a JVM regular expression and cross to Python as Arrow buffers. There, for all
pre-tokens of a batch at once:

1. a minimal perfect hash over the vocabulary gives each pre-token the one entry it can be equal to; comparing
   length and bytes decides. Hits are encoded by one id.
2. what misses is merged from its bytes: a linked list of pieces and a heap of candidate merges, lowest rank
   first, leftmost among equals. Each different miss of a batch is merged once, and a bounded memo of
   earlier results is kept in the worker.

The vocabulary (ranks) is a file of fixed size; its tables (about 2 MB) are broadcast. No shuffle; a lost task is
simply run again.

Edge cases: NULL and empty texts have no ids and decode to the empty string. Bytes that are not UTF-8 reach the
encoder as the replacement character, as the JVM reads them. Other columns are kept, whatever their names
(but for the output's names, which must not be taken). Ids outside the vocabulary raise an error on decoding.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.hashing import hash_slices, mix
from lintlake.llm.text import text_or_empty

# Pre-token pattern of the tokenizer family, in Java's spelling (white space as Unicode defines it).
_WS = r"\p{IsWhite_Space}"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?![^{_WS}])|{_WS}+"

# Pre-tokens handled by one round of NumPy calls, and remembered misses per worker: bounds on memory only.
SLICE_TOKENS = 100_000
MEMO_SIZE = 150_000

NO_MATCH = -1


class Vocabulary:
    """Byte strings with ranks, and a minimal perfect hash from the strings to the ranks.

    Hash and displace: keys fall into buckets; a bucket of several keys stores the seed that sends all of them to
    free slots, a bucket of one key stores its slot (as a negative number). As many slots as keys.
    """

    def __init__(self, tokens: dict[bytes, int]):
        self.size = max(tokens.values(), default=-1) + 1
        by_rank: list[bytes] = [b""] * self.size
        for t, r in tokens.items():
            by_rank[r] = t
        self.lengths = np.array([len(t) for t in by_rank], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.blob = np.frombuffer(b"".join(by_rank) + b"\0" * 16, np.uint8)
        ranks = np.array(sorted(tokens.values()), np.int64)
        starts = self.starts[ranks]
        hashes = hash_slices(self.blob, starts, starts + self.lengths[ranks])
        self._build(hashes, ranks)
        self.low, self.high = packed(self.blob, self.starts, self.lengths)

    def _build(self, hashes: np.ndarray, ranks: np.ndarray) -> None:
        n = len(hashes)
        self.n_keys, self.n_buckets = n, max(1, n // 3)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        keys = hashes.tolist()
        for i, h in enumerate(keys):
            buckets[h % self.n_buckets].append(i)
        taken, seeds, slot_rank, of = bytearray(n), [0] * self.n_buckets, [NO_MATCH] * n, ranks.tolist()
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        for b in order:
            own = buckets[b]
            if len(own) < 2:
                break
            seed, slots = 0, {-1}
            while len(slots) < len(own) or any(taken[x] if x >= 0 else True for x in slots):
                slots = {_mix_one(keys[i] + seed) % n for i in own}
                seed += 1
            seeds[b] = seed - 1
            for i in own:
                x = _mix_one(keys[i] + seed - 1) % n
                taken[x], slot_rank[x] = 1, of[i]
        spare = (x for x in range(n) if not taken[x])
        for b in order:
            if len(buckets[b]) == 1:
                x = next(spare)
                seeds[b], slot_rank[x] = -1 - x, of[buckets[b][0]]
        self.seeds, self.slot_rank = np.array(seeds, np.int32), np.array(slot_rank, np.int64)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The rank of each buf[start:end] or NO_MATCH. buf must be readable for 16 bytes behind each start."""
        if not self.n_keys:
            return np.full(len(starts), NO_MATCH, np.int64)
        seed = self.seeds[(hashes % np.uint64(self.n_buckets)).astype(np.int64)].astype(np.int64)
        slots = (mix(hashes + seed.astype(np.uint64)) % np.uint64(self.n_keys)).astype(np.int64)
        rank = self.slot_rank[np.where(seed < 0, -1 - seed, slots)]
        lengths = ends - starts
        low, high = packed(buf, starts, lengths)
        same = (self.lengths[rank] == lengths) & (self.low[rank] == low) & (self.high[rank] == high)
        for i in np.flatnonzero(same & (lengths > 16)):
            at = self.starts[rank[i]]
            same[i] = np.array_equal(self.blob[at:at + lengths[i]], buf[starts[i]:ends[i]])
        return np.where(same, rank, NO_MATCH)


def _mix_one(x: int) -> int:
    """``hashing.mix`` of one number."""
    m = (1 << 64) - 1
    x &= m
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def packed(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each slice as two numbers, zero behind its end."""
    at = np.ndarray(len(buf) - 7, "<u8", np.ascontiguousarray(buf), strides=(1,))
    out = []
    for skip in (0, 8):
        bits = np.clip(lengths - skip, 0, 8).astype(np.uint64) * np.uint64(8)
        keep = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
        out.append(at[starts + skip] & keep)
    return out[0], out[1]


@functools.lru_cache(maxsize=2)
def load(path: str) -> tuple[dict[bytes, int], Vocabulary]:
    """The ranks of a vocabulary file and their tables, built once per driver."""
    ranks = read_ranks(path)
    return ranks, Vocabulary(ranks)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with one base64 string and one number per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: always the pair of lowest rank, leftmost first.

    ``after[i]`` is where the piece that starts at i ends; pieces are linked by it and by ``before``. Heap entries
    whose pieces have changed since are recognised by their bounds and skipped.
    """
    n = len(piece)
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    get = ranks.get
    heap = []
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapify(heap)
    while heap:
        _, i, mid, end = heappop(heap)
        if after[i] != mid or mid >= n or after[mid] != end:
            continue
        after[i], after[mid] = end, -1
        if end < n:
            before[end] = i
            r = get(piece[i:after[end]])
            if r is not None:
                heappush(heap, (r, i, end, after[end]))
        j = before[i]
        if j >= 0:
            r = get(piece[j:end])
            if r is not None:
                heappush(heap, (r, j, i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... (count of them) of all ranges, one behind the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Lives in a worker; keeps the memo between batches."""

    def __init__(self, vocabulary: Vocabulary, ranks: dict[bytes, int]):
        self.vocabulary, self.ranks, self.memo = vocabulary, ranks, {}

    def _misses(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        """Ids of all given slices, one behind the other, and how many each has."""
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = ends - starts
        low, high = packed(buf, starts, lengths)
        rep, raw = first[back], buf.tobytes()
        same = (lengths == lengths[rep]) & (low == low[rep]) & (high == high[rep])
        longer = np.flatnonzero(same & (lengths > 16) & (rep != np.arange(len(rep))))
        if not same.all() or any(raw[starts[i]:ends[i]] != raw[starts[rep[i]]:ends[rep[i]]] for i in longer.tolist()):
            first = back = np.arange(len(starts))  # two strings with one hash: take each by itself
        memo, ranks, found = self.memo, self.ranks, []
        for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            piece = raw[s:e]
            ids = memo.get(piece)
            if ids is None:
                ids = merge_bytes(piece, ranks)
                if len(piece) <= 64:
                    memo[piece] = ids
            found.append(ids)
        if len(memo) > MEMO_SIZE:
            memo.clear()
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.int32, int(counts.sum()))
        begins = np.cumsum(counts) - counts
        return flat[expand(begins[back], counts[back])], counts[back]

    def encode(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that lie between neighbouring bounds, and how many each has."""
        all_ids, all_counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(bounds) - 1, SLICE_TOKENS):
            cut = bounds[at:at + SLICE_TOKENS + 1].astype(np.int64)
            part = np.concatenate((buf[cut[0]:cut[-1]], np.zeros(24, np.uint8)))
            starts, ends = cut[:-1] - cut[0], cut[1:] - cut[0]
            hashes = hash_slices(part, starts, ends)
            rank = self.vocabulary.find(part, starts, ends, hashes)
            miss = np.flatnonzero(rank == NO_MATCH)
            counts = np.ones(len(starts), np.int64)
            if len(miss):
                flat, counts[miss] = self._misses(part, starts[miss], ends[miss], hashes[miss])
                ids = np.empty(int(counts.sum()), np.int32)
                begins = np.cumsum(counts) - counts
                ids[begins[rank != NO_MATCH]] = rank[rank != NO_MATCH]
                ids[expand(begins[miss], counts[miss])] = flat
            else:
                ids = rank.astype(np.int32)
            all_ids.append(ids)
            all_counts.append(counts)
        return np.concatenate(all_ids), np.concatenate(all_counts)


_worker: dict[str, Encoder] = {}


def _replaced(batch: pa.RecordBatch, name: str, new_name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one column dropped and one added at the end."""
    keep = [i for i, f in enumerate(batch.schema) if f.name != name]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in keep] + [values], names=[batch.schema.field(i).name for i in keep] + [new_name])


def _one_run(column: pa.Array) -> np.ndarray:
    """Where the rows of a list column begin and end (n + 1 numbers) in its values."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]


def _few(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists hold some SLICE_TOKENS values, or of one row that holds more."""
    rows = _one_run(batch.column(batch.schema.get_field_index(name)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(rows, rows[begin] + SLICE_TOKENS, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``text`` replaced by ``ids``, an array of vocabulary ids. ``ranks_path`` is read on the driver."""
    shared, key = df.sparkSession.sparkContext.broadcast(load(ranks_path)), uuid.uuid4().hex
    pre = "_pre_tokens"
    cut = df.withColumn(pre, F.regexp_extract_all(text_or_empty(F.col(text)), F.lit(PRE_TOKEN), F.lit(0))).drop(text)
    schema = T.StructType([f for f in cut.schema if f.name != pre] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _worker:
            _worker.clear()
            tokens, vocabulary = shared.value
            _worker[key] = Encoder(vocabulary, tokens)
        encoder = _worker[key]
        for batch in (part for whole in batches for part in _few(whole, pre)):
            lists = batch.column(batch.schema.get_field_index(pre))
            rows, values = _one_run(lists), lists.values
            bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset + rows[0]:values.offset + rows[-1] + 1] \
                if rows[-1] > rows[0] else np.zeros(1, np.int32)
            data = values.buffers()[2]
            buf = np.frombuffer(data, np.uint8) if data is not None and rows[-1] > rows[0] else np.zeros(0, np.uint8)
            flat, counts = encoder.encode(buf, bounds)
            total = np.concatenate(([0], np.cumsum(counts)))
            out = pa.ListArray.from_arrays(pa.array(total[rows - rows[0]].astype(np.int32)), pa.array(flat))
            yield _replaced(batch, pre, ids, out)

    return cut.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` replaced by ``out``, the bytes they stand for (BINARY). NULL: no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(load(ranks_path)[1])
    schema = T.StructType([f for f in df.schema if f.name != ids] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in (part for whole in batches for part in _few(whole, ids)):
            lists = batch.column(batch.schema.get_field_index(ids))
            rows = _one_run(lists)
            flat = lists.values.to_numpy(zero_copy_only=False)[rows[0]:rows[-1]].astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= v.size):
                raise ValueError("id outside the vocabulary")
            lengths = v.lengths[flat]
            ends = np.concatenate(([0], np.cumsum(lengths)))
            parts = [v.blob[expand(v.starts[flat[a:a + SLICE_TOKENS]], lengths[a:a + SLICE_TOKENS])] for a in range(0, len(flat), SLICE_TOKENS)]
            data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            offsets = ends[rows - rows[0]].astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield _replaced(batch, ids, out, values)

    return df.mapInArrow(run, schema)


def ids_digest(ids: Column) -> Column:
    """SHA-256 (lowercase hex) of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
