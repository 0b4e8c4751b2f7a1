"""Exact top-k search by inner product: every pair is scored, and histograms of the scores select.

Vectors become integers, floor(scale * x), so scores are exact. Vectors and queries are packed into blocks of some
``BLOCK_BYTES``; a task holds one block of each and multiplies them. No score is stored: each pass computes them again,
which costs less than moving them.

1. A pass counts, per query, the scores of each block in 2**BINS_BITS bins over the range that scores can have. The counts of
   all blocks are added up, and the bin that holds the query's k-th score becomes the next pass's range, until a
   bin is one score wide. A block sends its bins from the top down only as far as its own k-th score, below which the k-th of all
   can't lie, so it sends at most k rows a query.
2. A last pass keeps scores above the k-th, and of those equal to it the smallest ids, at most k a block and query; they
   are ranked by score and id.

What lies in one task is bounded: two blocks and a tile of scores. Each block is met by every block of queries, through a
join on block numbers; nothing is broadcast or collected but the numbers of rows and the largest norm.

Edge cases: a vector that is NULL, holds NULL, NaN or an infinity, or leaves the doubles when scaled takes no part, and so does a row with a
NULL id. Vectors of unlike lengths count as filled up with zeros; an empty vector scores 0. Rows with one id are rows of
their own: each of them is a candidate, and a query if its id is one, and only the query's own row is left out. Ties go to the smaller id.
Fewer than k candidates: all are returned. No query, no vector or a single one: no rows. Scores beyond plus or minus 2**63 - 1 become that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import written

BLOCK_BYTES = 8 << 20
BINS_BITS = 10
TILE = 1 << 20
LONG_MAX = (1 << 63) - 1

_PACKED = "block int, n int, dim int, norm double, kind string, ids binary, rows binary, data binary"


def valid(vector: Column) -> Column:
    x_ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, x_ok), F.lit(False))


def _pack(scale: float):
    """One row for a block: ids, row numbers and the matrix of integers, in the smallest float type that holds them."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten(), np.float64)
        with np.errstate(over="ignore"):
            flat = np.floor(flat * scale)
        dim = int(sizes.max()) if len(sizes) else 0
        m = np.zeros((len(sizes), dim))
        m[np.arange(dim)[None, :] < sizes[:, None]] = flat
        ok = np.isfinite(m).all(axis=1)
        m = m[ok]
        with np.errstate(over="ignore"):
            norm = float(np.einsum("ij,ij->i", m, m).max()) if m.size else 0.0
        kind = "f4" if m.size == 0 or np.abs(m).max() < 1 << 24 else "f8"
        ids, rows = (np.asarray(table.column(c))[ok].astype(np.int64) for c in ("id", "row"))
        return pa.table({
            "block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(m)], pa.int32()), "dim": pa.array([dim], pa.int32()),
            "norm": pa.array([norm]), "kind": [kind], "ids": pa.array([ids.tobytes()], pa.binary()), "rows": pa.array([rows.tobytes()], pa.binary()),
            "data": pa.array([m.astype(kind).tobytes()], pa.binary())})
    return run


class _Block:
    def __init__(self, table: pa.Table):
        row = table.to_pylist()[0]
        self.ids, self.rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
        self.data = np.frombuffer(row["data"], row["kind"]).reshape(row["n"], row["dim"])
        self.state = np.array([(s["lo"], s["need"]) for s in row["state"]], np.int64) if row.get("state") else None


def _matrix_type(norm: float):
    """All partial sums of an inner product are at most the largest squared norm, so floats are exact as far as they hold that."""
    return np.float32 if norm < 1 << 24 else np.float64 if norm < 1 << 53 else object


def _as(m: np.ndarray, dim: int, kind) -> np.ndarray:
    wide = np.zeros((m.shape[0], dim)) if m.shape[1] < dim else m
    if m.shape[1] < dim:
        wide[:, :m.shape[1]] = m
    if kind is object:
        return np.array([[int(x) for x in row] for row in wide.tolist()], object).reshape(wide.shape)
    return wide.astype(kind, copy=False)


def _scores(q: _Block, v: _Block, norm: float):
    """Tiles (first query, scores, which of them count) of the product of two blocks; a query's own row doesn't count."""
    kind, dim = _matrix_type(norm), max(q.data.shape[1], v.data.shape[1])
    right = _as(v.data, dim, kind).T
    by_row = np.argsort(v.rows)
    step = max(1, TILE // max(1, len(v.rows)))
    for a in range(0, len(q.rows), step):
        left = _as(q.data[a:a + step], dim, kind)
        if kind is object:
            s = np.array([[max(-LONG_MAX, min(LONG_MAX, sum(x * y for x, y in zip(r, c, strict=True)))) for c in right.T.tolist()] for r in left.tolist()], object)
            s = s.reshape(len(left), len(v.rows))
        else:
            s = (left @ right).astype(np.int64)
        counts = np.ones(s.shape, bool)
        at = np.minimum(np.searchsorted(v.rows, q.rows[a:a + step], sorter=by_row), len(v.rows) - 1)
        own = np.flatnonzero(v.rows[by_row[at]] == q.rows[a:a + step])
        counts[own, by_row[at[own]]] = False
        yield a, s, counts


def _histogram(norm: float, shift: int, bins: int):
    """Counts per query and bin, from the top bin down to the one with the block's own k-th score."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"pos": [], "bin": [], "n": []}
        if left.num_rows and right.num_rows:
            q, v = _Block(left), _Block(right)
            for a, s, counts in _scores(q, v, norm) if len(v.rows) else ():
                lo, need = q.state[a:a + len(s), 0], q.state[a:a + len(s), 1]
                if s.dtype == object:
                    bin_ = np.array([[(x - int(b)) >> shift for x in r] for r, b in zip(s.tolist(), lo, strict=True)], object).reshape(s.shape)
                    counts &= (bin_ >= 0) & (bin_ < bins)
                    bin_ = np.where(counts, bin_, 0).astype(np.int64)
                else:
                    bin_ = (s - lo[:, None]) >> shift
                    counts &= (bin_ >= 0) & (bin_ < bins)
                where = (bin_ + bins * np.arange(len(s))[:, None])[counts]
                h = np.bincount(where, minlength=bins * len(s)).reshape(len(s), bins)
                above = h[:, ::-1].cumsum(axis=1)[:, ::-1] - h
                i, b = np.nonzero((h > 0) & (above < need[:, None]))
                out["pos"].append(i + a)
                out["bin"].append(b)
                out["n"].append(h[i, b])
        cols = {c: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for c, x in out.items()}
        return pa.table({"qb": pa.array(np.full(len(cols["pos"]), key[0].as_py()), pa.int32()), "pos": pa.array(cols["pos"].astype(np.int32)),
                         "bin": cols["bin"], "n": cols["n"]})
    return run


def _filter(norm: float):
    """Rows above each query's k-th score, and the smallest ids among those at it."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            q, v = _Block(left), _Block(right)
            by_id = np.lexsort((v.rows, v.ids))
            for a, s, counts in _scores(q, v, norm) if len(v.rows) else ():
                t, need = q.state[a:a + len(s), 0], q.state[a:a + len(s), 1]
                i, j = np.nonzero(counts & (s >= t[:, None]).astype(bool))
                tied = np.flatnonzero((s[i, j] == t[i]).astype(bool))
                place = np.empty(len(v.rows), np.int64)
                place[by_id] = np.arange(len(v.rows))
                order = tied[np.lexsort((place[j[tied]], i[tied]))]
                _, first, size = np.unique(i[order], return_index=True, return_counts=True)
                nth = np.arange(len(order)) - np.repeat(first, size)
                keep = np.ones(len(i), bool)
                keep[order[nth >= need[i[order]]]] = False
                i, j = i[keep], j[keep]
                found.append((q.ids[a + i], q.rows[a + i], v.ids[j], v.rows[j], s[i, j].astype(np.int64)))
        cols = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 5)]
        return pa.table(dict(zip(("query_id", "query_row", "id", "row", "score"), cols, strict=True)))
    return run


def _moved(lo: Column, bin_: Column, shift: int) -> Column:
    """lo + bin * 2**shift, whose parts may leave a BIGINT."""
    return (lo.cast("decimal(20,0)") + bin_.cast("decimal(10,0)") * F.lit(1 << shift).cast("decimal(20,0)")).cast("long")


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of every row for which ``is_query`` holds, among all rows of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).alias("v"),
                          F.monotonically_increasing_id().alias("row")).filter(F.col("id").isNotNull() & valid(F.col("v")))
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("d")).first()
    if not size["q"] or size["n"] < 2:
        return empty
    per_block = max(1, block_bytes // (4 * max(1, size["d"])))

    def blocks(of: DataFrame, n: int) -> DataFrame:
        dealt = of.withColumn("block", F.pmod("row", F.lit(-(-n // per_block))).cast("int")).select("block", "id", "row", "v")
        return written(dealt.groupBy("block").applyInArrow(_pack(scale), _PACKED), "topk-blocks")

    v, q = blocks(rows, size["n"]), blocks(rows.filter("asks"), size["q"])
    n_v, n_q = -(-size["n"] // per_block), -(-size["q"] // per_block)
    all_ = v.agg(F.max("norm").alias("norm"), F.sum("n").alias("n")).first()
    norm, most = all_["norm"] * (1 + 1e-9) + 1, min(k, all_["n"] - 1)
    if most < 1:
        return empty
    each_v = v.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.col("block").alias("vb"), "n", "dim", "kind", "ids", "rows", "data")

    def pass_(state: DataFrame, fn, schema: str) -> DataFrame:
        held = q.join(state, q["block"] == state["qb"]).select(
            "qb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"), "n", "dim", "kind", "ids", "rows", "data", "state")
        return held.groupBy("qb", "vb").cogroup(each_v.groupBy("qb", "vb")).applyInArrow(fn, schema)

    # Scores lie between -top and top; norms beyond a BIGINT mean clipped scores.
    top = min(int(norm), LONG_MAX)
    bits = (2 * top).bit_length()
    start = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("pos"), F.lit(-top).cast("long").alias("lo"), F.lit(most).cast("long").alias("need")))
    state = q.filter("n > 0").select(F.col("block").alias("qb"), start.alias("state"))
    while bits > 0:
        shift = max(0, bits - BINS_BITS)
        hist = pass_(state, _histogram(norm, shift, 1 << (bits - shift)), "qb int, pos int, bin long, n long").groupBy("qb", "pos", "bin").agg(F.sum("n").alias("n"))
        old = state.select("qb", F.explode("state").alias("s")).select("qb", "s.pos", "s.lo", "s.need")
        down = Window.partitionBy("qb", "pos").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        at = hist.withColumn("upto", F.sum("n").over(down)).join(old, ["qb", "pos"]).filter("upto >= need and upto - n < need")
        at = at.select("qb", "pos", _moved(F.col("lo"), F.col("bin"), shift).alias("lo"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"))
        # One list per block of queries, as long as the block.
        state = written(at.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "need"))).alias("state")), "topk-state")
        bits = shift
    best = pass_(state, _filter(norm), "query_id long, query_row long, id long, row long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
