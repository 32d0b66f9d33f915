"""What the corpus operators share: table access, words, tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, remove, removed, settled, shared_dir, written

__all__ = ["GAP", "WORD", "ascii_lower", "bounded_batches", "new_folder", "remove", "removed", "settled", "shared_dir", "table", "words", "written"]

#: A word, after A-Z are lower-cased: a run of anything but ASCII characters that are neither letters nor digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A run of characters that stand in no word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The array of words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), GAP), "")


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bytes of text that a Python worker is sent at once: long texts else come by thousands of rows a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
