"""Work along an order without putting a whole group into one task.

A ranking window over a large group runs in one task. Here rows are range-partitioned by
(group, order), so a hot group is spread over many partitions; rows are numbered as they lie, and only
one small row per (group, chunk of rows) is combined to find the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import written, written_in_buckets

# A chunk is a run of at most 2**CHUNK_BITS neighbouring rows of one partition, so that work on one chunk
# is bounded whatever the partitions' sizes. (monotonically_increasing_id: partition above, row number below.)
CHUNK_BITS = 18
# Rows of a task that sorts whole groups: about 2**TASK_BITS.
TASK_BITS = 16


def sorted_chunks(df: DataFrame, keys: tuple[str, ...], order: list[Column], name: str, bits: int = 63) -> DataFrame:
    """``df`` in (keys, order) order, stored, with ``chunk`` and ``pos``, both increasing along the order. Chunks have at most 2 ** ``bits`` rows,
    if that is less than 2 ** ``CHUNK_BITS``."""
    by = [F.asc(k) for k in keys] + order
    placed = (
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    )
    stored = written(placed, name)
    return stored.withColumn("chunk", F.shiftright("_id", min(bits, CHUNK_BITS))).withColumnRenamed("_id", "pos")


def rank_within(df: DataFrame, keys: tuple[str, ...], order: list[Column], out: str) -> DataFrame:
    """``row_number`` of each row in its group, for groups of any size. ``order`` must leave no ties."""
    chunks = sorted_chunks(df, keys, order, "ranked")
    per_chunk = chunks.groupBy(*keys, "chunk").agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        chunks.join(offsets, [*keys, "chunk"])
        .withColumn(out, (F.col("pos") - F.col("_first") + F.col("_before") + 1).cast("bigint"))
        .drop("chunk", "pos", "_first", "_before")
    )


def rank_in_buckets(df: DataFrame, keys: tuple[str, ...], order: list[Column], out: str) -> DataFrame:
    """As ``rank_within``, with one exchange of the rows: the one that puts them in order.

    The rows are stored in buckets by chunk, so that numbering inside chunks and meeting the offsets need no other. As rows lie
    in (keys, order) order, only the first group of a chunk can have begun in an earlier one: offsets are one row per chunk.
    """
    by = [F.asc(k) for k in keys] + order
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id())
    stored = written_in_buckets(placed.withColumn("_chunk", F.shiftright("_pos", CHUNK_BITS)), "ranked", "_chunk")
    group = F.struct(*keys).alias("_group")
    # One row per (chunk, group), then per chunk: its first group, its last group, and how many rows of the last one it holds.
    parts = stored.groupBy("_chunk", *keys).agg(F.min("_pos").alias("_from"), F.count("*").alias("_n"))
    ends = parts.groupBy("_chunk").agg(
        F.min(F.struct("_from", group)).alias("_head"), F.max(F.struct("_from", group, "_n")).alias("_tail"))
    both = F.array(F.struct("_head._group", F.lit(0).cast("bigint").alias("_n")), F.struct("_tail._group", "_tail._n"))
    # A group's earlier chunks all end with it, so the sum of their tails is what precedes a chunk.
    per_end = ends.select("_chunk", F.inline(both)).groupBy("_group", "_chunk").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_end.withColumn("_before", F.sum("_n").over(before)).filter("_before > 0").select(
        F.col("_chunk").alias("_at"), F.col("_group").alias("_cut"), "_before")
    inside = Window.partitionBy("_chunk", *keys).orderBy("_pos")
    ranked = stored.withColumn("_own", F.row_number().over(inside)).join(offsets, F.col("_chunk") == F.col("_at"), "left")
    cut = F.coalesce(F.struct(*keys).eqNullSafe(F.col("_cut")), F.lit(False))
    return ranked.withColumn(out, (F.col("_own") + F.when(cut, F.col("_before")).otherwise(0)).cast("bigint")).drop(
        "_pos", "_chunk", "_own", "_at", "_cut", "_before")


def first_per_group(df: DataFrame, keys: tuple[str, ...], order: list[Column], limit: int = 1,
                    name: str = "_place") -> DataFrame:
    """The first ``limit`` rows of each group.

    Spark plans a group limit before the exchange, so a task sends at most ``limit`` rows of a group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= limit).drop(name)


def by_size(df: DataFrame, keys: tuple[str, ...], bits: int = 18) -> tuple[DataFrame, DataFrame | None, int]:
    """``df`` in two: the groups that one task can hold, put into one task each, and the others (None if there are none); and the number of tasks.

    Rows are counted by hash of the group first, so ``df`` is read twice and should be a stored table. A group of more than
    2 ** ``CHUNK_BITS`` rows is always among the others; so are those that share its hash of ``bits`` bits. There are as many tasks as the rows
    need, so that what a task sorts stays in its memory however large the table is.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    counts = written(df.select(place.alias("_hash")).groupBy("_hash").agg(F.count("*").alias("_n")), "group-sizes")
    rows, most = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(default, min(rows >> TASK_BITS, 100_000))  # Spark's limit for buckets
    placed = lambda x: x.repartition(*keys) if tasks == default else x.repartition(tasks, *keys)
    if most <= 1 << CHUNK_BITS:
        return placed(df), None, tasks
    # At most one row per 2 ** CHUNK_BITS rows.
    crowded, marked = counts.filter(F.col("_n") > 1 << CHUNK_BITS).select("_hash"), df.withColumn("_hash", place)
    calm = marked.join(F.broadcast(crowded), "_hash", "left_anti").drop("_hash")
    return placed(calm), marked.join(F.broadcast(crowded), "_hash", "left_semi").drop("_hash"), tasks


def carry_last(chunks: DataFrame, keys: tuple[str, ...], value: str, out: str) -> DataFrame:
    """Per row, the last non-NULL ``value`` at or before it in its group (an as-of lookup).

    Windows run inside one chunk; what a chunk inherits comes from one row per (group, chunk).
    """
    inside = Window.partitionBy(*keys, "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = chunks.groupBy(*keys, "chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("pos"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.select(*keys, "chunk", F.last("_end", ignorenulls=True).over(before).alias("_inherited"))
    return (
        chunks.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
        .join(inherited, [*keys, "chunk"])
        .withColumn(out, F.coalesce("_own", "_inherited"))
        .drop("_own", "_inherited")
    )
