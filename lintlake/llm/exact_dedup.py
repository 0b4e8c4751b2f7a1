"""Exact deduplication as a stateful stream, in DataFrame operations only.

Each document becomes a record (digest of its normalised text, stable id, content locator). A structured stream folds the
records into keyed state that is kept on disk (RocksDB, snapshots in the shared folder) and never expires: per
digest the row that stays (greatest id) and how many rows were seen. The stream combines records of a digest before the
shuffle, so a digest that holds a third of all rows costs a task no more than any other.
A digest seen twice is only a hit: the full normalised bytes of its rows are fetched by their locators and grouped by
(digest, bytes). Digests under which different texts meet are dealt with by bytes alone.

The locator is (file path, row number in the file), so repeated rows with one id are still told apart: one of them stays.
The whole path counts, as the files of partition folders share their base names.

Edge cases: NULL text counts as empty text; all such rows are equal. A NULL id is the smallest. An empty table gives an
empty result. Of rows that agree in text and id the one with the greatest locator stays. Other columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.text import ascii_lower, text_or_empty
from lintlake.session import work_dir, written

#: Settings of the state: on disk, with one memory bound for all partitions of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Each partition's store would reserve some megabytes of disk for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return ascii_lower(text_or_empty(text))


def digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_locator``. A frame that isn't read from files is written to the shared folder first."""
    def add(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select("*", F.struct(at["file_path"].alias("file"), at["row_index"].alias("row")).alias("_locator"))

    try:
        return add(docs)
    except AnalysisException:
        return add(written(docs, "dedup-input"))


def records(docs: DataFrame, key: str, text: str, digest_of: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col(key).alias("id"), digest_of(normalised(F.col(text))).alias("digest"), "_locator")


def update_state(arriving: DataFrame, path: str) -> None:
    """Fold a stream of records into the state at ``path``, which a later call goes on with."""
    spark = arriving.sparkSession
    seen = arriving.groupBy("digest").agg(F.max(F.struct("id", "_locator")).alias("stay"), F.count("*").alias("n"))
    with _settings(spark, STATE):
        run = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", path).trigger(availableNow=True).start()
        run.awaitTermination()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(digest, stay, n) of all digests seen."""
    with _settings(spark, STATE):
        state = spark.read.format("statestore").load(path)
    stay, n = (f"value.`{f.name}`" for f in state.schema["value"].dataType)
    return state.select("key.digest", F.col(stay).alias("stay"), F.col(n).alias("n"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_of: Callable[[Column], Column] = digest,
          max_bytes_per_trigger: int = 1 << 28) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest, _locator.

    ``max_bytes_per_trigger`` bounds the records (about 100 bytes a document) of one micro-batch.
    """
    spark = docs.sparkSession
    docs = located(docs)
    base = f"{work_dir(spark)}/lintlake/dedup-{uuid.uuid4().hex}"
    made = records(docs, key, text, digest_of)
    made.write.parquet(f"{base}/records")
    rows = spark.read.schema(made.schema).parquet(f"{base}/records")
    arriving = spark.readStream.schema(made.schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(f"{base}/records")
    update_state(arriving, f"{base}/state")

    hit = read_state(spark, f"{base}/state").filter("n > 1").select("digest")
    members = rows.join(hit, "digest", "left_semi")
    contents = docs.select("_locator", normalised(F.col(text)).alias("bytes"))
    by_bytes = (
        members.join(contents, "_locator").groupBy("digest", "bytes")
        .agg(F.max(F.struct("id", "_locator")).alias("stay"), F.count("*").alias("n"))
    )
    checked = written(by_bytes.groupBy("digest").agg(F.count("*").alias("texts"), F.max("stay").alias("stay"), F.sum("n").alias("n")), "dedup-checked")
    mixed = checked.filter("texts > 1").select("digest")
    same = checked.filter("texts = 1").select("digest", "stay", "n")

    def result(df: DataFrame) -> DataFrame:
        return df.select(
            "id", F.coalesce("stay.id", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
            (F.col("stay").isNull() | (F.col("stay._locator") == F.col("_locator"))).alias("kept"), "digest", "_locator")

    if mixed.isEmpty():
        return result(rows.join(same, "digest", "left"))
    apart = members.join(mixed, "digest", "left_semi").join(contents, "_locator")
    groups = apart.groupBy("digest", "bytes").agg(F.max(F.struct("id", "_locator")).alias("stay"), F.count("*").alias("n"))
    return result(rows.join(mixed, "digest", "left_anti").join(same, "digest", "left")).unionByName(
        result(apart.join(groups, ["digest", "bytes"])))


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    docs = located(docs)
    stays = dedup(docs.drop("_locator"), key, text).filter("kept").select("_locator")
    return docs.join(stays, "_locator", "left_semi").drop("_locator")
