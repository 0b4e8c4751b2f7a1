"""Divergence between the sources of a language, over run-length encoded columns of counts.

Each language keeps the terms that enough of its documents use. Every (language, source) group has a column of smoothed
term shares, as integers; two groups differ by the sum of f = floor((p - q)**2 / (p + q)) over the kept terms.

Columns: the vocabulary is reordered by total count, then by the pattern of its counts over the sources, so terms with equal counts
lie together and a column becomes few runs. For a pair of groups the boundaries of their runs are merged, f is taken
once per piece and multiplied by the piece's length. The order is cut into chunks of at most ``CELLS`` cells (terms
times sources); a task encodes the columns of one chunk and adds up its pairs, and the chunks' sums are added up. So a language that holds
most rows is spread over many tasks, and no task holds a whole vocabulary. All arithmetic is in integers (decimals where they could overflow).

The result has a row for every ordered pair of sources of a language, as asked for; it grows with the sources, not with the documents.

Edge cases: NULL text, language and source are ''. Repeated rows count as often as they occur. A group without terms has only smoothed
shares; a language without kept terms has the value 0 for every pair. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.ordered import rank_within
from lintlake.session import written

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
CELLS = 1 << 20
HELD = 200_000
PIECE = 1 << 20

# Bytes of terms: letters and everything outside ASCII (the bytes of a character all lie there); A-Z are lowered first.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in runs, so that a very long text's are never all in memory."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(at + PIECE, len(text)))
        end = gap.start() + 1 if gap else len(text)
        yield _TERM.findall(text[at:end])
        at = end


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; one row with a NULL term for each group that occurs.
    Counts are added up inside a task, as far as some ``HELD`` entries, before they are shuffled."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(value(lang).alias("lang"), value(source).alias("source"), value(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            group, terms, n, d = ([], []), [], [], []
            for (a, b), (found, docs_) in held.items():
                for side, v in zip(group, (a, b), strict=True):
                    side.extend([v] * (len(found) + 1))
                terms += [None, *found]
                n += [0, *found.values()]
                d += [0, *(docs_[t] for t in found)]
            return pa.RecordBatch.from_arrays([pa.array(group[0], pa.string()), pa.array(group[1], pa.string()), pa.array(terms, pa.binary()),
                                               pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found, in_docs = held.setdefault((a, b), (Counter(), Counter()))
                before, seen = len(found), set()
                for terms in _pieces(t.as_py().translate(_LOWER)):
                    found.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                size += len(found) - before
                if size > HELD:
                    yield flush()
                    held.clear()
                    size = 0
        yield flush()

    counted = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly."""
    whole = lambda c: c.cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), whole(total + 2 * kept))


def f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their values."""
    begin = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1))
    return begin, column[begin]


def pair_value(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """The sum of f over two run-length columns: once per piece between merged boundaries, times the piece's length."""
    at = np.union1d(a[0], b[0])
    p, q = (v[np.searchsorted(s, at, "right") - 1] for s, v in (a, b))
    times = np.diff(np.append(at, length))
    return int((((p - q) * (p - q) // (p + q)) * times).sum())


def _chunk_pairs(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over one chunk of one language's vocabulary, for each unordered pair of its sources."""
    names, base = groups.column("source").to_pylist(), np.asarray(groups.column("p0")).astype(np.int64)
    of = {s: i for i, s in enumerate(names)}
    value = np.zeros(0, np.int64)
    who, other = np.triu_indices(len(names), 1)
    if counts.num_rows:
        places, at = np.unique(np.asarray(counts.column("place")), return_inverse=True)
        rows = np.fromiter((of[s] for s in counts.column("source").to_pylist()), np.int64, counts.num_rows)
        table = np.repeat(base[:, None], len(places), axis=1)
        table[rows, at] = np.asarray(counts.column("p"))
        columns = [_runs(c) for c in table]
        value = np.fromiter((pair_value(columns[i], columns[j], len(places)) for i, j in zip(who.tolist(), other.tolist(), strict=True)), np.int64, len(who))
    else:
        value = np.zeros(len(who), np.int64)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(who), pa.string()), "a": pa.array([names[i] for i in who], pa.string()),
                     "b": pa.array([names[j] for j in other], pa.string()), "value": value})


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the language. Part ``term``: the ``top`` terms that the
    source uses more than its language does."""
    counted = written(term_counts(docs, lang, source, text), "audit-counts")
    terms = counted.filter("term is not null")
    known = terms.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.bit_xor(F.xxhash64("source", "n")).alias("pattern"))
    known = known.filter(F.col("docs") >= min_docs).drop("docs")
    vocabulary = rank_within(known, ("lang",), [F.desc("all"), F.asc("pattern"), F.asc("term")], "place")
    vocabulary = written(vocabulary.select("lang", "term", "all", F.col("place") - 1), "audit-vocabulary").toDF("lang", "term", "all", "place")

    kept = written(terms.drop("docs").join(vocabulary, ["lang", "term"]), "audit-kept")
    per_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n_lang"))
    groups = counted.filter("term is null").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group")), ["lang", "source"], "left")
    groups = groups.join(per_lang, "lang", "left").fillna(0, ["n_group", "v", "n_lang"])
    n_sources = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    groups = written(groups.join(n_sources, "lang").withColumn("chunk_terms", F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("n_sources")))), "audit-groups")

    at_group = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_group"), F.col("v")))
    q = share(F.col("all"), F.col("n_lang"), F.col("v"))
    above = at_group.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    best = above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    cut = at_group.select("lang", F.floor(F.col("place") / F.col("chunk_terms")).alias("chunk"), "place", "source", "p")
    # A language without kept terms has one chunk, without cells. (p0 is not used there.)
    last = F.greatest(F.lit(0), F.floor((F.col("v") - 1) / F.col("chunk_terms")))
    p0 = F.when(F.col("v") > 0, share(F.lit(0), F.col("n_group"), F.col("v"))).otherwise(1)
    columns = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"), "source", p0.alias("p0"))
    parts = cut.groupBy("lang", "chunk").cogroup(columns.groupBy("lang", "chunk")).applyInArrow(_chunk_pairs, "lang string, a string, b string, value long")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", both.alias("s"), "value")
    pairs = pairs.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(best)
