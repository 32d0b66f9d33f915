"""A corpus pipeline of five stages: language, near duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Stages that join do so by a key of the row's id and text, so that rows of a null id, or of one id and
different texts, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontaminate, jaccard, langid, secrets
from cloakframe.llm.common import bounded_batches, table, written
from cloakframe.llm.hashed import crc_mod
from cloakframe.llm.queries import bpe_digests

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the identifier rejects go."""
    bounded_batches(spark)
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    return docs.select(*COLUMNS, langid.predict(F.col("text"), model).alias("p")).where(~F.col("p.rejected")).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and `row_key`, equal for rows of equal id and text alone; nulls count as values."""
    row = F.struct(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return docs.select(*COLUMNS, F.xxhash64(row).alias("row_key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id, a null one last."""
    rows = keyed(docs).dropDuplicates(["row_key"])
    classes = jaccard.ngram_jaccard(rows, id_col="row_key").select("row_key", "class_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = rows.select("row_key", "doc_id").join(classes, "row_key").groupBy("class_id").agg(F.min(order).alias("first")).select("first.row_key")
    return rows.join(kept, "row_key", "left_semi").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of a benchmark item."""
    rows = keyed(docs)
    leaks = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="row_key").where("contaminated").select("row_key").distinct()
    return rows.join(leaks, "row_key", "left_anti").select(*COLUMNS)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    found = secrets.scan(docs.select(*COLUMNS)).withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each document, and the digest of what they decode to."""
    return bpe_digests(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secret_spans),
    ("token_ids", token_ids),
]

#: Two stages rest on a trained model and on tokenization: SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = written(docs, name)
    return docs
