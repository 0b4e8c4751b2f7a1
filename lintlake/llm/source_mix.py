"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

The mix is a sequence of slots. A source's shuffled stream (its documents in the order of a keyed hash) is cut into
ceil(size / ``BLOCK``) blocks of nearly equal words, and a source gets as many slots as its target holds of its own blocks, one at least. Slot i
lies at the van der Corput point of i: the 2**m first points are the multiples of 1 / 2**m in another order, so with
as many places as there are slots (the points behind them are skipped) every source gets exactly its slots, and every stretch of the
sequence holds each source nearly in proportion. The k-th slot of a source takes its block k mod (number of blocks). So the words that the
mix takes of a source are within half a block of its target, also for a source of a few words.

Nothing runs in one task per source, nor for all sources: slots meet their source over cells of places, slots, documents and sources are
added up inside chunks of bounded size, and only one row per chunk is summed up. Blocks are counted before the join.

Targets: the shares of the weights, none above ``MAX_EPOCHS`` times its source's size; the excess is shared again by weight.
Only sums over the source table come back to the driver.

Edge cases: documents without words (NULL, empty) belong to no block and take nothing; a NULL source is a source of its own.
Repeated rows count as often as they occur. An empty table, or one without words, gives an empty schedule.
The same table gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.text import n_words
from lintlake.operators.ordered import rank_within, sorted_chunks
from lintlake.session import written

BLOCK = 64
MAX_EPOCHS = 3
CYCLE = (5, 2, 1)
CELLS = 4096
SLOT_CHUNK = 1 << 16
DOC_CHUNK = 1 << 16


def sizes(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(id, source, size, h): words of each document and its place in the shuffle."""
    return docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                       F.xxhash64(F.col(key).cast("string"), F.lit("mix")).alias("h"))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``sources`` (one row each) with ``weight``: by code point, NULL last, the cycle's values in turn."""
    placed = rank_within(sources, (), [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.col("_place") - 1) % len(cycle) + 1).cast("int"))
    return placed.withColumn("weight", weight).drop("_place")


def targets(weighted: DataFrame, most: int = MAX_EPOCHS) -> DataFrame:
    """``weighted`` (source, source_size, weight) with ``target``; the targets add up to all sizes.

    Sources whose share exceeds their limit get the limit, and the rest is shared anew, until none exceeds it.
    """
    limit, level, n = most * F.col("source_size"), None, 0
    while True:
        capped = F.lit(False) if level is None else level * F.col("weight") >= limit
        r = weighted.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, limit)).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("open"),
                         F.count(F.when(capped, 1)).alias("n")).first()
        if not r["all"] or not r["open"] or level is not None and r["n"] == n:
            break
        level, n = (r["all"] - (r["fixed"] or 0)) / r["open"], r["n"]
    share = F.least(F.col("weight") * F.lit(level or 0.0), limit.cast("double"))
    return weighted.withColumn("target", F.coalesce(share, F.lit(0.0)))


def _offsets(rows: DataFrame, chunk: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` before each row in its source along (chunk, order), with windows inside chunks only."""
    by = Window.partitionBy("source", chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("source", chunk).agg(F.sum(value).alias("_n")).select(
        F.col("source").alias("_s"), F.col(chunk).alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_in", F.coalesce(F.sum(value).over(by), F.lit(0)))
    return inside.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col(chunk) == F.col("_c"))).withColumn(out, F.col("_in") + F.col("_before")).drop("_s", "_c", "_in", "_before")


def _intervals(plan: DataFrame, block: int, most: int) -> DataFrame:
    """(source, blocks, slots, lo, hi): how many blocks a source has and which of all slots' places are its own."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.greatest(F.lit(1), F.least(blocks * most, F.round(F.col("target") * blocks / F.col("source_size")))).cast("long")
    own = plan.filter("target > 0").withColumn("blocks", blocks).withColumn("slots", slots).select("source", "blocks", "slots")
    chunks = sorted_chunks(own, (), [F.col("source").asc_nulls_last()], "mix-places")
    inside = Window.partitionBy("chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = chunks.groupBy("chunk").agg(F.sum("slots").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ends = chunks.withColumn("_in", F.sum("slots").over(inside)).join(per, "chunk").withColumn("hi", F.col("_in") + F.col("_before"))
    return ends.select("source", "blocks", "slots", (F.col("hi") - F.col("slots")).alias("lo"), "hi")


def van_der_corput(i: Column, bits: int) -> Column:
    """The place of the i-th point among 2**bits: the bits of i in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(plan: DataFrame, block: int = BLOCK, most: int = MAX_EPOCHS) -> DataFrame:
    """(slot, source, k, epoch, block, blocks): the mix in order. ``plan`` has source, source_size and target."""
    ends = written(_intervals(plan, block, most), "mix-intervals")
    found = ends.agg(F.sum("slots").alias("n"), F.count("*").alias("sources")).first()
    total = found["n"] or 0
    bits, width = max(0, (total - 1).bit_length()), max(1, total // max(CELLS, found["sources"]))
    cells = ends.select("source", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    points = plan.sparkSession.range(1 << bits if total else 0).withColumn("place", van_der_corput(F.col("id"), bits)).filter(F.col("place") < total)
    points = points.withColumn("cell", F.floor(F.col("place") / width))
    placed = points.join(cells, (points["cell"] == cells["cell"]) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).select(
        F.col("id").alias("slot"), "source", "blocks", F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"))
    ranked = _offsets(placed, "chunk", [F.col("slot")], F.lit(1), "k")
    ranked = ranked.withColumn("epoch", F.floor(F.col("k") / F.col("blocks"))).withColumn("block", F.col("k") % F.col("blocks"))
    return ranked.select("slot", "source", "k", "epoch", "block", "blocks")


def streams(measured: DataFrame) -> DataFrame:
    """``measured`` documents with words, each with ``start``: its first word's place in its source's shuffled stream.

    A chunk is a range of the shuffle's hashes; there are so many that one holds some DOC_CHUNK documents, whatever the table's size."""
    bits = max(12, (measured.count() // DOC_CHUNK).bit_length())
    rows = measured.filter("size > 0").withColumn("chunk", F.shiftrightunsigned("h", 64 - bits))
    return _offsets(rows, "chunk", [F.col("h"), F.col("id"), F.col("size")], F.col("size"), "start").drop("chunk")


def taken(measured: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, source, size, h, taken) of the documents with words: how many of their words the mix takes, repeats counted."""
    times = schedule(plan, block).groupBy("source", "block").agg(F.count("*").alias("times"))
    times = times.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "times")
    shape = plan.select(F.col("source").alias("_p"), F.col("source_size").alias("_size"), F.ceil(F.col("source_size") / block).cast("long").alias("_blocks"))
    placed = streams(measured)
    placed = placed.join(shape, F.col("source").eqNullSafe(F.col("_p"))).drop("_p")
    # Block b of n holds the words from ceil(b * size / n) up to the next block's first one.
    n = lambda c: c.cast("decimal(19,0)")
    blocks, size = n(F.col("_blocks")), n(F.col("_size"))
    of = lambda word: F.call_function("div", n(word) * blocks, size)
    first_word = lambda b: F.call_function("div", n(b) * size + blocks - F.lit(1), blocks)
    # A name for each row, so that repeated rows stay apart: no two documents of a source start at one word.
    parts = placed.withColumn("b", F.explode(F.sequence(of(F.col("start")), of(F.col("start") + F.col("size") - 1))))
    words = F.least(F.col("start") + F.col("size"), first_word(F.col("b") + 1)) - F.greatest(F.col("start"), first_word(F.col("b")))
    joined = parts.withColumn("words", words).join(times, F.col("source").eqNullSafe(F.col("_s")) & (F.col("b") == F.col("_b")), "left")
    return joined.groupBy("source", "start", "id", "size", "h").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("bigint").alias("taken")).drop("start")


def plan_for(measured: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    per = measured.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    return written(targets(written(cyclic_weights(per, cycle), "mix-weights")), "mix-targets")


def report(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every document."""
    measured = written(sizes(docs, key, source, text), "mix-sizes")
    plan = plan_for(measured, cycle)
    known = plan.select(F.col("source").alias("_s"), "source_size", "target")
    rows = taken(measured, plan).unionByName(measured.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint")))
    return rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).select("id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """The documents of the mix with their own columns, whole, each as often as the mix takes it (to the nearest whole time:
    only where a source's last round ends, a document is taken in part)."""
    measured = written(sizes(docs, key, source, text), "mix-sizes")
    counts = taken(measured, plan_for(measured, cycle)).select("id", F.col("source").alias("_s"), F.round(F.col("taken") / F.col("size")).cast("int").alias("times"), "size")
    # Rows that agree in id, source and size share their times evenly: the greatest and the least differ by one round.
    per = counts.groupBy("id", "_s", "size").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    per = per.withColumnsRenamed({"id": "_id", "size": "_size"})
    joined = docs.join(per, F.col(key).eqNullSafe(F.col("_id")) & docs[source].eqNullSafe(F.col("_s")) & (n_words(docs[text]) == F.col("_size")))
    each = F.round(F.col("times") / F.col("rows")).cast("int")
    return joined.withColumn("_copy", F.explode(F.when(each > 0, F.sequence(F.lit(1), each)))).select(*[docs[c] for c in docs.columns])
