"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of each window of 10 words the smallest 5-gram hash is kept. A document and an item that share 10 consecutive
words share all hashes of that window and so its smallest one: joining the kept hashes finds every shared span.
Each hit is extended to the windows around it, and these are compared as text, so hash collisions leave no trace.

Defined results: words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased; null and empty
texts have none. An item with fewer words than a window, but not none, is one window. Items of equal id count
once, a null item id counts as an empty string. Rows of equal text get equal results, whatever their ids; repeated
rows stay repeated. Empty tables give no hits. Other columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written

#: Rows of a table of fingerprints or windows (a number, a short string) that may be broadcast: some 100 MB at most.
BROADCAST_ROWS = 500_000


def _grams(w: Column, size: int) -> Column:
    """All runs of `size` words, as arrays."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.slice(w, i, size))).otherwise(F.array().cast("array<array<string>>"))


def _gram_hashes(hashes: Column, size: int) -> Column:
    """A hash of each run of `size` word hashes."""
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*(F.get(hashes, i + n) for n in range(size))))).otherwise(F.array().cast("array<bigint>"))


def _least_hashes(hashes: Column, window: int) -> Column:
    """The smallest hash of each window."""
    return F.when(F.size(hashes) >= window, F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.least(*(F.get(hashes, i + n) for n in range(window))) if window > 1 else F.get(hashes, i))).otherwise(F.array().cast("array<bigint>"))


def _kept(df: DataFrame, kgram: int, window: int) -> DataFrame:
    """Rows of df, which has words w, with the smallest hash of each window of `window` words in `least`.

    Explode it with explode_outer: for explode the optimizer adds a filter on the array's size and pushes it below all of
    these projections, which then are evaluated inside one another, for each element.
    """
    hashed = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    return hashed.drop("w").withColumn("g", _gram_hashes(F.col("h"), kgram)).drop("h").withColumn("least", _least_hashes(F.col("g"), window - kgram + 1)).drop("g")


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows are few; else a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, kgram: int = 5) -> DataFrame:
    """For each document row: id_col, n_words, n_hit, items (ids of the items that occur, sorted as strings), spans
    (hit windows as struct of first word, from 0, and number of words) and contaminated."""
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    windows = written(items.select("item", F.explode(F.when(F.size("w") >= window, _grams(F.col("w"), window)).otherwise(F.array("w"))).alias("w")).select("item", F.size("w").alias("len"), F.array_join("w", " ").alias("win")).distinct(), "windows")
    prints = _kept(items, kgram, window).select(F.explode_outer("least").alias("print")).where(F.col("print").isNotNull()).distinct()

    # one fingerprint for each run of windows with the same smallest hash, and for each `reach + 1`th window at least:
    # a window that shares its fingerprint starts at most `reach` words after one that is kept
    reach = window - kgram
    kept = _kept(texts.select("key", words(F.col("text")).alias("w")), kgram, window)
    first = F.transform("least", lambda x, i: F.when((i % (reach + 1) == 0) | (x != F.get("least", i - 1)), F.struct(x.alias("print"), i.alias("first"))))
    hits = kept.select("key", F.explode_outer(F.array_compact(first)).alias("f")).select("key", "f.*").join(_sized(prints), "print", "left_semi")
    starts = hits.groupBy("key").agg(F.collect_set("first").alias("firsts"))  # bounded by one text's words
    starts = written(starts, "hits")
    near = texts.select("key", "text").join(_sized(starts.select("key", "firsts")), "key").dropDuplicates(["key"]).select("key", words(F.col("text")).alias("w"), "firsts").select("key", "w", F.explode_outer(F.array_distinct(F.flatten(F.transform("firsts", lambda i: F.sequence(i, i + reach))))).alias("start"))
    near = near.where(F.col("start") + window <= F.size("w")).select("key", "start", F.array_join(F.slice("w", F.col("start") + 1, window), " ").alias("win"))
    for short in sorted(row.len for row in windows.where(F.col("len") < window).select("len").distinct().collect()):  # at most window - 1 lengths
        near = near.unionByName(texts.select("key", words(F.col("text")).alias("w")).select("key", F.posexplode(_grams(F.col("w"), short)).alias("start", "gram")).select("key", "start", F.array_join("gram", " ").alias("win")))
    found = near.join(_sized(windows), "win").select("key", "start", "len", "item")
    by_text = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    by_text = by_text.withColumn("n_hit", F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(F.greatest(a.end, s.start + s.len).alias("end"), (a.n + F.greatest(F.lit(0), s.start + s.len - F.greatest(a.end, s.start))).alias("n")), lambda a: a.n))
    counted = texts.select("id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(by_text, "key", "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,len:int>>")).alias("spans"), (n_hit > 0).alias("contaminated"),
    )
