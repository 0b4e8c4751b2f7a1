"""File-corpus source, content decoding and the choice of files worth scanning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import basename, selection_extension
from lintlake.operators.ordered import first_per_group
from lintlake.session import written
from lintlake.sources.checkout import load_tree

REPO_FILES_SCHEMA = (
    "repo_url STRING, commit_sha STRING, ordinal BIGINT, type STRING, path STRING, size BIGINT, sha STRING, content STRING"
)
REPO_KEY = ("repo_url", "commit_sha")

# --- Fixed values: names that are never scanned, and extensions (or bare names) that are --------
SKIPPED_NAMES = (
    "package-lock.json", "yarn.lock", "poetry.lock", "pipfile.lock", "composer.lock", "gemfile.lock",
    ".gitignore", ".prettierrc", ".eslintrc",
)
SCANNABLE = (
    ".py", ".js", ".ts", ".jsx", ".tsx",
    ".env", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf",
    ".tf", ".hcl", ".dockerfile", "dockerfile",
    ".html", ".jinja", ".jinja2",
    ".sh", ".bash", ".zsh",
    ".go", ".rb", ".php", ".java", ".rs", ".cs",
    ".json",
)
MAX_FILE_KB = 500
TREE_CAP = 1000
SCAN_CAP = 50


def read_repo_files(spark: SparkSession, path: str) -> DataFrame:
    """A stored ``repo_files`` table."""
    return spark.read.schema(REPO_FILES_SCHEMA).parquet(path)


def read_checkout(spark: SparkSession, root: str, repo_url: str, commit_sha: str, max_kb: float | None = None) -> DataFrame:
    """A checked-out tree as ``repo_files``, hidden names included; bytes that are not UTF-8 become replacement characters. Contents above
    ``max_kb`` are not read (NULL)."""
    raw = load_tree(spark, root, None if max_kb is None else int(max_kb * 1024))
    return raw.select(
        F.lit(repo_url).alias("repo_url"),
        F.lit(commit_sha).alias("commit_sha"),
        F.lit(0).cast("bigint").alias("ordinal"),  # a tree lists its entries by path, the second sort key
        F.lit("blob").alias("type"),
        "path",
        "size",
        F.sha2("content", 256).alias("sha"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def decode_content(encoded: Column) -> Column:
    """base64 -> text, malformed bytes replaced."""
    return F.make_valid_utf8(F.unbase64(encoded).cast("string"))


def is_scannable(max_kb: float = MAX_FILE_KB) -> Column:
    """A blob with a wanted extension or name, not too large. Only metadata columns are looked at."""
    path = F.col("path")
    name = basename(path)
    return (
        (F.col("type") == "blob")
        & ~name.isin(*SKIPPED_NAMES)
        & (F.coalesce(F.col("size"), F.lit(0)) / 1024 <= max_kb)
        & (selection_extension(path).isin(*SCANNABLE) | name.isin(*SCANNABLE))
    )


def scannable(tree: DataFrame, max_kb: float = MAX_FILE_KB) -> DataFrame:
    return tree.filter(is_scannable(max_kb))


def _might_hold(rows: DataFrame, kept: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """``rows`` without most of those whose ``columns`` are not in ``kept``; none that is there is lost."""
    marked, bit = marked_by_hash(rows, kept, columns, bits, "inner")
    return marked.filter(bit).drop("_piece", "_bits")


def surely_not_in(rows: DataFrame, kept: DataFrame, columns: list[str], bits: int = 28) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``columns`` are surely not in ``kept``, most of them, and the rest, which may be or not."""
    marked, bit = marked_by_hash(rows, kept, columns, bits, "left")
    found = F.coalesce(bit, F.lit(False))
    return marked.filter(~found).drop("_piece", "_bits"), marked.filter(found).drop("_piece", "_bits")


def marked_by_hash(rows: DataFrame, kept: DataFrame, columns: list[str], bits: int, how: str) -> tuple[DataFrame, Column]:
    """``rows`` with the piece of a bit map that each falls into, and whether its bit is set.

    The hashes of ``kept`` are one bit map of 2 ** ``bits`` bits, cut into pieces of 4 KB. Together the pieces take 2 ** (bits - 3) bytes at
    most, whatever the tables' sizes, so they are broadcast, and rows are dropped before anything is exchanged.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << bits)) + 1
    pieces = kept.groupBy(F.bitmap_bucket_number(place).alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_piece", F.bitmap_bucket_number(place)).join(F.broadcast(pieces), "_piece", how)
    return marked, F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1


def first_files(files: DataFrame, *caps: int, salts: int = 32, bits: int = 28) -> DataFrame:
    """The first files of each repository in tree order; of several ``caps`` the least one binds.

    Only (repository, ordinal, path) travels to find them, in two rounds, so that a repository with very many files is reduced in
    ``salts`` tasks first. They are stored (at most ``caps`` rows per repository). Contents are first reduced to the files
    whose hash is among theirs, where they are read; what is left meets them by repository and path, so a
    repository is no hot key. Files without a repository or a commit are left out.
    """
    cap = min(caps)
    meta = files.select(*REPO_KEY, "ordinal", "path").withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(salts)))
    order = [F.asc("ordinal"), F.asc("path")]
    few = first_per_group(meta, (*REPO_KEY, "_salt"), order, cap)
    columns = [*REPO_KEY, "ordinal", "path"]
    kept = written(first_per_group(few, REPO_KEY, order, cap).select(*columns).distinct(), "first-files")
    theirs = kept.select(*[F.col(c).alias(f"_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(c) == F.col(f"_{c}") if c in REPO_KEY else F.col(c).eqNullSafe(F.col(f"_{c}")))
    # (Spark would push a semi join below the bit map's; an inner one stays above it.)
    return _might_hold(files, kept, columns, bits).join(theirs, same).select(*files.columns)


def tree_counts(tree: DataFrame, max_kb: float = MAX_FILE_KB, tree_cap: int | None = TREE_CAP, scan_cap: int | None = SCAN_CAP) -> DataFrame:
    """Per repository (a cap of None is none): entries in the tree, files reported as scanned (after the first cap only, as
    the service reports it) and files whose contents are really read (after the second cap)."""
    kept = F.count_if(is_scannable(max_kb))
    return tree.groupBy(*REPO_KEY).agg(
        F.count("*").alias("total_files"),
        F.least(kept, F.lit(tree_cap).cast("bigint")).alias("files_scanned"),
        F.least(kept, F.lit(tree_cap).cast("bigint"), F.lit(scan_cap).cast("bigint")).alias("files_read"),
    )
