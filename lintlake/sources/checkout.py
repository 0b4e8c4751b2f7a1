"""A checked-out tree as a table, and a table as a tree.

Spark's file sources leave out names that begin with a dot or an underscore, which in source code are files like any other. This source
lists the tree itself, on the driver and by metadata only, and deals the files to partitions of bounded bytes and numbers; tasks read
contents in small Arrow batches. Files are reached through Arrow's file systems, so the root is a URI that the driver and all executors can open.
"""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKOUT_SCHEMA = "path STRING, size BIGINT, content BINARY"
PARTITION_BYTES = 128 << 20
PARTITION_FILES = 10_000


def _opener():
    # Returned functions and classes are local on purpose: they are shipped by value, so workers need nothing installed.
    def opened(root: str):
        """The file system of a root and the root's path in it."""
        import os
        import re

        from pyarrow import fs

        if "://" not in root and not root.startswith("file:"):
            return fs.LocalFileSystem(), os.path.abspath(root)
        if root.startswith("file:"):
            return fs.LocalFileSystem(), re.sub("^file:/+", "/", root).rstrip("/") or "/"
        return fs.FileSystem.from_uri(root.rstrip("/"))

    return opened


def _checkout_source(partition_bytes: int, partition_files: int):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    opened = _opener()

    class Files(InputPartition):
        def __init__(self, files):
            self.files = files

    class CheckoutReader(DataSourceReader):
        def __init__(self, root, max_bytes):
            self.root, self.max_bytes = root, max_bytes

        def partitions(self):
            from pyarrow import fs

            store, base = opened(self.root)
            found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File)
            parts, part, size = [], [], 0
            for path, n in found:
                if part and (size + n > partition_bytes or len(part) >= partition_files):
                    parts.append(Files(part))
                    part, size = [], 0
                part.append((path, n))
                size += n
            return [*parts, Files(part)]

        def read(self, partition):
            import pyarrow as pa

            store, base = opened(self.root)
            held, size = ([], [], []), 0

            def batch():
                return pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.binary())], names=["path", "size", "content"])

            for path, n in partition.files:
                content = None
                if self.max_bytes is None or n <= self.max_bytes:
                    with store.open_input_stream(path) as f:
                        content = f.read()
                for column, value in zip(held, (path[len(base):].lstrip("/"), n, content)):
                    column.append(value)
                size += len(content or b"")
                if size > 16 << 20 or len(held[0]) >= 1000:
                    yield batch()
                    held, size = ([], [], []), 0
            yield batch()

    class CheckoutSource(DataSource):
        @classmethod
        def name(cls):
            return "checkout"

        def schema(self):
            return CHECKOUT_SCHEMA

        def reader(self, schema):
            limit = self.options.get("maxBytes")
            return CheckoutReader(self.options["path"], int(limit) if limit else None)

    return CheckoutSource


def load_tree(spark: SparkSession, root: str, max_bytes: int | None = None, partition_bytes: int = PARTITION_BYTES, partition_files: int = PARTITION_FILES) -> DataFrame:
    """(path below the root, size, content) of every file of a tree, hidden names included. A file of more than ``max_bytes`` is listed, not read."""
    if "://" not in root and not root.startswith("file:"):
        root = os.path.abspath(root)  # tasks may run in another folder
    spark.dataSource.register(_checkout_source(partition_bytes, partition_files))
    reader = spark.read.format("checkout")
    return (reader.option("maxBytes", str(max_bytes)) if max_bytes is not None else reader).load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """Write (path, content) rows as files below the root; rows with NULL content are left out. Writing a file again gives the same file, so
    a task that is lost is simply run again."""
    opened = _opener()

    def write(batches):
        import os

        import pyarrow as pa

        store, base = opened(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{base}/{path}"
                folder = os.path.dirname(target)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = files.filter(F.col("content").isNotNull()).select("path", F.col("content").cast("binary").alias("content"))
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
