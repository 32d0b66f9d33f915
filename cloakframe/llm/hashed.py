"""Hashed character n-grams of whole texts as count vectors, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_counts(codes: np.ndarray, orders: range, buckets: int, within_words: bool) -> np.ndarray:
    """How often each bucket is hit by the n-grams of the code points; within_words: only by those with no blank inside."""
    counts = np.zeros(buckets, np.int64)
    longest = orders[-1]
    shift = np.uint64(64 - buckets.bit_length() + 1)
    for start in range(0, max(len(codes), 1), _CHUNK):
        part = codes[start : start + _CHUNK + longest - 1].astype(np.uint64)
        fresh = min(_CHUNK, len(codes) - start)
        blank = part == 32
        mixed = np.zeros(len(part), np.uint64)
        for n in range(1, longest + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            mixed = (mixed[:size] ^ part[n - 1 :]) * _MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
            if n in orders:
                own = (mixed * _MULTIPLIER) >> shift
                keep = np.arange(size) < fresh
                if within_words:
                    if n == 1:
                        keep &= ~blank[:size]
                    for inner in range(1, n - 1):
                        keep &= ~blank[inner : inner + size]
                    if n == 2:
                        keep &= ~(blank[:size] & blank[1 : 1 + size])
                counts += np.bincount(own[keep].astype(np.int64), minlength=buckets)
    return counts


def bounded_sample(df: DataFrame, id_col: str, rows: int, text_col: str = "text") -> DataFrame:
    """The rows whose hashed ids, then hashed texts, are the smallest: `rows` of them at most, however often an id repeats.
    Only hashes are sorted; of rows of equal id and text any are taken."""
    mark, second = F.xxhash64(F.col(id_col).cast("string")), F.xxhash64(F.col(text_col))
    edge = df.select(F.struct(mark.alias("a"), second.alias("b")).alias("mark")).orderBy("mark").limit(rows).agg(F.max("mark").alias("edge")).first()
    if edge is None or edge.edge is None:
        return df.where(F.lit(False))
    below = (mark < edge.edge.a) | ((mark == edge.edge.a) & (second <= edge.edge.b))
    return df.where(below).limit(rows)


def crc_mod(id_col: Column, n: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n
