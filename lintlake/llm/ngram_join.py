"""Exact Jaccard self-join of documents on word n-grams by a partitioned universe.

Two sets r, s with Jaccard at least t differ in at most H = (|r| + |s|) (1 - t) / (1 + t) elements. Sizes fall into bands of
ratio 1 / t. For a band, elements are hashed into m > H segments, so similar sets agree on whole segments.

* *Segment subsets.* What a set has in one segment is hashed to a signature. A set files its signatures under its own
  band and probes the band below with that band's segments; similar sets meet in the smaller one's band.
* *Cost-based allocation.* m is H + 1 plus a slack that grows with H. The slack pays for the segments that would cost
  most: empty ones, which agree by chance, are not filed unless a set has so many that no agreement would be
  guaranteed without them. Two sets with E empty segments or fewer agree on at least m - H - E others, and a pair
  that agrees on fewer is no candidate.
* *One-deletion neighbourhoods.* Where segments would hold too few elements to tell sets apart (small H), a band is
  allotted half the segments, each twice as large, and a set files what remains of each segment without one element
  as well: one of them differs by one element at most.
* *Signatures* are stored nowhere. They go from the task that makes them to the one that compares them in pages, 12 bytes each
  whatever the number of partitions; of a set 48 bits are its name there. Names and signatures that are equal by chance only add candidates.
* *Verification* is exact, on the n-grams themselves. Sets of a candidate group lie together once, in blocks of bounded
  bytes; inverted lists give all overlaps of a block, or of two. One row per linked set leaves the task: its smallest partner of the component, and
  how many documents it is linked with there.

Documents with the same words in the same order are one set (a class, named by a cryptographic digest of the words); equal sets of other
words or another order are found and verified like any pair. A signature shared by more than ``HOT`` classes is not expanded into pairs: its classes
are joined to one of them, and the whole group is verified in blocks. No candidate is dropped either way.

Edge cases: NULL, empty and blank texts have the empty set and link with nothing; with fewer than n words, the whole sequence
is the only element. Repeated rows are equal sets. Very long texts have as many segments as their size asks for.
Threshold and comparison are integers (percent), so ties at the threshold are links.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.components import components
from lintlake.llm.hashing import mix
from lintlake.session import written

#: Classes of a signature that are still compared pair by pair before verification.
HOT = 24
#: Bytes of text in one block of a group; a task holds two.
BLOCK_BYTES = 4 << 20
#: Up to this many differences a band works with one-deletion neighbourhoods.
DELETION_H = 3
SLICE_BYTES = 1 << 20
#: Word hashes kept in a worker, and classes that a task knows to be filed.
MEMO_WORDS, MEMO_NAMES = 500_000, 200_000
#: Bytes of a class's digest that name it in the search, and the largest agreement asked for there.
NAME_BYTES, MOST_NEED = 6, (1 << 15) - 1
#: A signature in a page: its bits behind the bucket's, and the set's name (48 bits), role (1) and need (15).
ENTRY = np.dtype([("low", "<u4"), ("set", "<u8")])
#: Signatures that a task gathers for its pages, and that it gathers of whole buckets before they are compared.
PAGED, GATHERED = 1 << 20, 1 << 19
#: Signatures of one bucket from which on hot ones are let go.
HELD = 1 << 20


class Bands:
    """Size bands and their allotment for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self._plan: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> int:
        """The band of size n: the powers of 100 / percent between which it lies."""
        if self.percent == 100 or n < 1:
            return n
        return int(math.log(n) / math.log(100 / self.percent) + 1e-9)

    def largest(self, band: int) -> int:
        """The largest size of a band or, if it has none, of the bands below."""
        if self.percent == 100:
            return band
        n = int((100 / self.percent) ** (band + 1)) + 1
        while n > 0 and self.of(n) > band:
            n -= 1
        return n

    def plan(self, band: int) -> tuple[int, int]:
        """(m, H) of a band: segments, and the most elements in which a set of the band and a similar larger one differ."""
        if band not in self._plan:
            p, top = self.percent, self.largest(band)
            h = (top + top * 100 // p) * (100 - p) // (100 + p)
            m = (h + 2) // 2 if h <= DELETION_H else h + 1 + max(1, h // 8)
            self._plan[band] = (m, h)
        return self._plan[band]

    def signatures(self, tokens: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        """Signatures of a set under a band, and on how many it agrees at least with each similar set of the band."""
        m, h = self.plan(band)
        own = mix(tokens + np.uint64((band * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        segment = (own % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        value = mix(own ^ np.uint64(0x5851F42D4C957F2D))[order]
        present, begins = np.unique(segment[order], return_index=True)
        sums = np.add.reduceat(value, begins)
        seed = lambda at: mix((at.astype(np.uint64) << np.uint64(20)) + np.uint64(band))
        if h <= DELETION_H:
            counts = np.diff(np.concatenate((begins, [len(value)])))
            whole, base = np.zeros(m, np.uint64), seed(np.arange(m))
            whole[present] = sums
            less = np.repeat(sums, counts) - value
            return np.unique(np.concatenate((mix(whole ^ base), mix(less ^ base[segment[order]])))), 1
        empty = m - len(present)
        need = m - h - empty
        if need >= 1:
            return mix(sums ^ seed(present)), need
        whole = np.zeros(m, np.uint64)
        whole[present] = sums
        return mix(whole ^ seed(np.arange(m))), 1


class _WordHashes(dict):
    """64 bits of BLAKE2b of each word met, so that no family of words is known to collide."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_word_hashes = _WordHashes()


def token_sets(words_of: list[list[bytes]], n: int) -> list[np.ndarray]:
    """The hashed n-grams of each text, given as words, sorted and distinct. Many texts at once share the array operations."""
    first = np.concatenate(([0], np.cumsum([len(w) for w in words_of])))
    words = np.fromiter(map(_word_hashes.__getitem__, itertools.chain.from_iterable(words_of)), np.uint64, int(first[-1]))
    grams = words * np.uint64(0x9FB21C651E98DF25)
    for k in range(1, n):
        grams[:-k] = mix(grams[:-k]) + words[k:] * np.uint64(0x9FB21C651E98DF25 + 2 * k)
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            whole = np.uint64(0)
            for w in words[a:b]:
                whole = mix(np.array([whole + w], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _pages(sig: np.ndarray, beside: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(bucket, page) of signatures and what stands beside each: in order of their first 48 bits, 16 of which are the bucket."""
    for k in range(0, len(sig), PAGED):
        order = np.argsort(sig[k:k + PAGED], kind="stable")
        part = sig[k:k + PAGED][order] >> np.uint64(16)
        entries = np.empty(len(part), ENTRY)
        entries["low"], entries["set"] = part & np.uint64(0xFFFFFFFF), beside[k:k + PAGED][order]
        bucket = (part >> np.uint64(32)).astype(np.int64)
        begins = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1))
        ends = (np.append(begins, len(part)) * ENTRY.itemsize).astype(np.int32)
        yield pa.array(bucket[begins]), pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(entries.tobytes())])


def sketches(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(bucket, page, id, n_elements, class), in rows of two kinds. Without a bucket: per document the size of its set and the digest of its words.
    With a bucket: a page of signatures, each beside the set's name, its role (does it probe the band below?) and the agreement it asks for.
    Signatures are left out where the same set came shortly before."""
    bands = Bands(percent)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    names = ["bucket", "page", "id", "n_elements", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sigs, sets, seen, kind = 0, [], [], set(), None

        def paged() -> Iterator[pa.RecordBatch]:
            given = [np.concatenate(x) if held else np.zeros(0, np.uint64) for x in (sigs, sets)]
            sigs.clear()
            sets.clear()
            for bucket, page in _pages(*given):
                yield pa.RecordBatch.from_arrays([bucket, page, *[pa.nulls(len(bucket), t) for t in (kind, pa.int64(), pa.binary())]], names=names)

        for batch in batches:
            sizes, classes, kind = [], [], batch.column(0).type
            for part in _slices(batch.column(1).to_pylist()):
                words_of, filed, beside = [t.lower().split() for t in part], [np.zeros(0, np.uint64)], []
                for w, s in zip(words_of, token_sets(words_of, n), strict=True):
                    sizes.append(len(s))
                    name = hashlib.blake2b(b" ".join(w), digest_size=16).digest() if len(s) else None
                    classes.append(name)
                    if len(s) and name not in seen:
                        seen.add(name)
                        own = bands.of(len(s))
                        for band in (own, own - 1):
                            # The band below matters only to sets that its largest can be similar to.
                            if band < 0 or band < own and 100 * bands.largest(band) < percent * len(s):
                                continue
                            sig, need = bands.signatures(s, band)
                            filed.append(sig)
                            # A smaller need only adds candidates.
                            beside.append(int.from_bytes(name[:NAME_BYTES], "big") << 16 | (band < own) << 15 | min(need, MOST_NEED))
                sigs.append(np.concatenate(filed))
                sets.append(np.repeat(np.array(beside, np.uint64), [len(x) for x in filed[1:]] or 0))
                held += len(sigs[-1])
                if held >= PAGED:
                    yield from paged()
                    held = 0
                if held == 0 or len(seen) >= MEMO_NAMES:
                    seen = set()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(sizes), pa.int64()), pa.nulls(len(sizes), pa.binary()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary())], names=names)
        yield from paged()

    return rows.mapInArrow(run, f"bucket long, page binary, id {docs.schema[key].dataType.simpleString()}, n_elements long, class binary")


class _Bucket:
    """What the sets of a signature give rise to, from the entries of one or more buckets. kind 0: a pair that meets, kind 1: member of a
    hot signature with one of its sets. Hot signatures are let go as soon as they are known; of any other HOT entries at most are held."""

    def __init__(self):
        self.sig, self.set, self.hot = [], [], {}
        self.held, self.most = 0, HELD

    def add(self, sig: np.ndarray, beside: np.ndarray) -> None:
        self.sig.append(sig)
        self.set.append(beside)
        self.held += len(sig)

    def met(self, last: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, a, b, need). Without ``last`` only what is known of hot signatures; the rest stays."""
        if not self.held:
            return
        sig, beside = np.concatenate(self.sig), np.concatenate(self.set)
        order = np.argsort(sig, kind="stable")
        sig, beside = sig[order], beside[order]
        if last and not self.hot:
            # A signature with one entry gives nothing.
            same = sig[1:] == sig[:-1]
            keep = np.append(same, False) | np.insert(same, 0, False)
            sig, beside = sig[keep], beside[keep]
        order = np.lexsort((beside, sig))
        sig, beside = sig[order], beside[order]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (beside[1:] != beside[:-1])
        sig, beside = sig[keep], beside[keep]
        begins = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[:len(sig)])
        sizes = np.diff(np.append(begins, len(sig)))
        sid = (beside >> np.uint64(16)).astype(np.int64)
        known = np.isin(sig[begins], np.array(list(self.hot), np.uint64))
        hot = known | (sizes > HOT)
        centre = sid[begins]
        for g in np.flatnonzero(hot).tolist():
            centre[g] = self.hot.setdefault(int(sig[begins[g]]), int(centre[g]))
        group = np.repeat(np.arange(len(begins)), sizes)
        member = hot[group]
        once = np.ones(len(sig), bool)
        once[1:] = (group[1:] != group[:-1]) | (sid[1:] != sid[:-1])
        at = np.flatnonzero(member & once)
        if len(at):
            yield 1, sid[at], centre[group[at]], np.zeros(len(at), np.int32)
        sig, beside, sid, group = (x[~member] for x in (sig, beside, sid, group))
        if not last:
            self.sig, self.set, self.held = [sig], [beside], len(sig)
            self.most = max(HELD, 2 * len(sig))
            return
        self.sig, self.set, self.held, self.hot, self.most = [], [], 0, {}, HELD
        probe, need = (beside & np.uint64(1 << 15)) > 0, (beside & np.uint64(MOST_NEED)).astype(np.int32)
        for d in range(1, HOT):
            i = np.flatnonzero(group[d:] == group[:-d])
            if not len(i):
                break
            i = i[(sid[i] != sid[i + d]) & ~(probe[i] & probe[i + d])]
            yield 0, sid[i], sid[i + d], np.maximum(need[i], need[i + d])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``sketches``, those with a bucket in order of it: what the sets of each signature give rise to (kinds 0 and 1), and the documents' rows as they came (kind 2)."""
    bucket, kind, names = _Bucket(), pa.int64(), ["kind", "a", "b", "need", "id", "n_elements", "class"]

    def given(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for k, a, b, need in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), k, np.int8)), pa.array(a), pa.array(b), pa.array(need), pa.nulls(len(a), kind), pa.nulls(len(a), pa.int64()),
                                              pa.nulls(len(a), pa.binary())], names=names)

    now = None
    for batch in batches:
        kind, pages = batch.schema.field("id").type, batch.column("bucket").is_valid()
        of = batch.filter(pc.invert(pages))
        if of.num_rows:
            n = of.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int8)), *[pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32())], *[of.column(c) for c in names[4:]]], names=names)
        batch = batch.filter(pages)
        if not batch.num_rows:
            continue
        data = batch.column("page").to_pylist()
        entries = np.frombuffer(b"".join(data), ENTRY)
        at = np.repeat(batch.column("bucket").to_numpy().astype(np.uint64), [len(x) // ENTRY.itemsize for x in data])
        sig = at << np.uint64(32) | entries["low"]
        # The last bucket may go on in the next batch.
        done = int(np.searchsorted(at, at[-1]))
        if int(at[-1]) != now:
            bucket.add(sig[:done], entries["set"][:done])
            if bucket.held >= GATHERED or bucket.hot:
                yield from given(bucket.met(True))
            now = int(at[-1])
        bucket.add(sig[done:], entries["set"][done:])
        if bucket.held > bucket.most:
            yield from given(bucket.met(False))
    yield from given(bucket.met(True))


def _links(rows: list[tuple], n: int, percent: int) -> list[tuple[int, int, int]]:
    """The linked sets of one block (or with links between two): (id, smallest id of its component there, documents it is linked with).

    rows: (side, id, text, number of documents with this text). With two sides only pairs across are compared; pairs within are another task's.
    """
    ids, weight = [r[1] for r in rows], np.array([r[3] for r in rows])
    side = np.array([r[0] for r in rows])
    known: dict[bytes, int] = {}
    number = lambda g: known.setdefault(g, len(known))
    sets = []
    for r in rows:
        w = r[2].lower().split()
        grams = {b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {b" ".join(w)}
        sets.append(np.fromiter(map(number, grams), np.int64, len(grams)))
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    posted = owner[order]
    begins = np.searchsorted(flat[order], np.arange(len(known) + 1))
    # Components as labels: two that meet are relabelled at once, the smaller part into the larger.
    label, parts = np.arange(len(ids)), {i: [i] for i in range(len(ids))}
    links = np.zeros(len(ids), np.int64)
    two = side.min() != side.max()
    for i, s in enumerate(sets):
        if two and side[i] == 1:
            continue
        counts = begins[s + 1] - begins[s]
        ends = np.cumsum(counts)
        at = np.repeat(begins[s] - (ends - counts), counts) + np.arange(ends[-1])
        both = np.bincount(posted[at], minlength=len(ids))
        hit = 100 * both >= percent * (sizes + sizes[i] - both)
        hit &= (side == 1) if two else np.arange(len(ids)) > i
        met = np.flatnonzero(hit)
        links[i] += weight[met].sum()
        links[met] += weight[i]
        for b in np.unique(label[met]).tolist():
            a = int(label[i])
            if a != b:
                small, large = (a, b) if len(parts[a]) < len(parts[b]) else (b, a)
                label[parts[small]] = large
                parts[large] += parts.pop(small)
    least = {c: min(ids[m] for m in members) for c, members in parts.items()}
    return [(ids[i], least[int(label[i])], int(links[i])) for i in np.flatnonzero(links).tolist()]


def _verify(n: int, percent: int):
    def found(held: list[tuple]) -> pa.RecordBatch:
        rows = _links(held, n, percent) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            for g, i, j, side, id_, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != task:
                    yield found(held)
                    task, held = (g, i, j), []
                held.append((side, id_, text, copies))
        yield found(held)
    return run


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_elements, component, n_links) for each document: the smallest id reachable by links of Jaccard >= percent / 100 on word
    n-grams (A-Z lower-cased), and the number of documents it is linked with. ``key`` must be a BIGINT; rows with a NULL key take no part in links and keep NULL."""
    # Signatures go from the task that makes them to the one that compares them and are stored nowhere else; documents' rows travel along.
    pages = sketches(docs, key, text, n, percent).repartition(F.coalesce("bucket", F.xxhash64("class", "id"))).sortWithinPartitions("bucket")
    kind = docs.schema[key].dataType.simpleString()
    met = written(pages.mapInArrow(_meetings, f"kind byte, a long, b long, need int, id {kind}, n_elements long, class binary"), "ngram-meetings")
    made = met.filter("kind = 2").select("id", "n_elements", "class")
    # One class per set; its first bytes name it in the search (equal names by chance only add candidates).
    named = made.withColumn("sid", F.conv(F.hex(F.substring("class", 1, NAME_BYTES)), 16, 10).cast("long"))
    classes = named.filter("class is not null and id is not null").groupBy("class", "sid").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))

    hot = met.filter("kind = 1")
    n_hot = hot.groupBy(F.col("a").alias("sid")).agg(F.count("*").alias("n_hot"))
    pairs = met.filter("kind = 0").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    of = lambda c: n_hot.select(F.col("sid").alias(c), F.col("n_hot").alias(f"hot_{c}"))
    # A pair may also agree on signatures that were too hot to expand; give it the benefit of them.
    enough = F.col("n") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0))) >= F.col("need")
    near = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(enough).select("a", "b")
    groups = written(components(near.unionByName(hot.filter("a <> b").select("a", "b"))), "ngram-groups")

    members = groups.withColumnRenamed("node", "sid").join(classes, "sid").select(F.col("rep").alias("id"), F.col("component").alias("g"), "copies")
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    own = written(members.join(source, "id"), "ngram-candidates")
    blocks = own.groupBy("g").agg(F.ceil(F.sum(F.length("text")) / BLOCK_BYTES).cast("int").alias("n_blocks"), F.count("*").alias("c")).filter("c > 1")
    dealt = (
        own.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("id"), "n_blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "text", "copies")
    )
    tasks = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    links = written(tasks.mapInArrow(_verify(n, percent), "a long, b long, n long"), "ngram-links")
    linked = components(links.filter("a <> b")).select(F.col("node").alias("rep"), "component")
    others = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    by_class = classes.join(linked, "rep", "left").join(others, "rep", "left").select(
        "class", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return made.join(by_class, "class", "left").select("id", "n_elements", F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), "id").alias("component"),
                                                       F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
