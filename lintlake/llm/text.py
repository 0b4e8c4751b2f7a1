"""Column expressions on text shared by the operators (JVM-side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also fold other letters)."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for NULL, empty and blank texts."""
    clean = F.trim(F.regexp_replace(text_or_empty(text), f"{SPACE}+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def n_words(text: Column) -> Column:
    """Number of words: what is left of a text when each word becomes one letter and white space goes."""
    marked = F.regexp_replace(text_or_empty(text), f"{NOT_SPACE}+{SPACE}*", "x")
    return F.length(F.regexp_replace(marked, f"^{SPACE}+", "")).cast("bigint")
