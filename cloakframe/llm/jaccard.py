"""N-gram Jaccard join by chosen paths.

A document is the set of its 5-word shingles. In each of a number of independent runs a set goes into the buckets of
the few shingles whose hash, in that run, falls under 1 / (threshold * size of the set): similar sets choose the same
shingles. A bucket with too many members is split again, by tokens chosen under the path so far, and so on. From the second
step on the tokens are the slots of the set's minhash sketch, of which two sets share as many as they are similar: a path
goes on by the few slots whose hash under it falls under 1 / (threshold * slots), so a split reads a hundred bytes of each
member and no text. Small buckets, and large ones whose members are alike on average (large groups of near copies, which no
split would part), are compared by brute force on the sketches, in blocks of bounded size. The number of runs follows from
the target recall: with branching 1 / threshold a pair at the threshold shares a path of four steps, the most, in a run with
probability 0.31 on average; its share of equal slots is the same in all runs, so the number is of the average over it.

Pairs whose sketches agree far below the threshold already join two documents to one candidate group (linear in the
bucket's rows: only a spanning forest is emitted). Inside the candidate groups every pair is compared exactly, in
blocks, so a link needs no bucket of its own once its two ends are in one group. No pair is emitted: the blocks give
sums of links and a spanning forest of the exact links, from which the classes follow.

Identical shingle sets are one class representative from the start; copies are counted by weight.

Defined results: words as in common.WORD; a text of fewer than 5 words, but not none, is one shingle; texts without
words (null, empty) have no links and are classes of their own. Every row is a document: rows of equal id and equal sets
are copies like any others, rows of one id and different sets have links and classes of their own (a class is named by
its smallest id, so such classes may share the name). A null id is left out. Whole texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, written
from .components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Members above which a bucket is split, and steps of a path after which it is compared as it is.
SPLIT_ROWS, MOST_STEPS = 1024, 4
#: Smallest hashes kept of each set to tell how alike a bucket's members are, random signs of each, and from which mean
#: similarity splitting is idle: a large group of near copies.
MARKS, SIGNS, ALIKE = 4, 8, 0.2
#: Rows of a block in a brute-force comparison of sets, and of sketches.
BLOCK_ROWS, SKETCH_BLOCK_ROWS = 512, 2048
#: Slots of a sketch, and the share of equal slots from which a pair goes to one candidate group: four standard errors
#: below the threshold.
SLOTS, NEAR = 96, 0.6
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Well-mixed 64-bit hashes of 64-bit values under a seed."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _PRIME
    return x ^ (x >> np.uint64(32))


# of each byte of UTF-8: a random number, the same for both cases of A-Z, and whether it stands in a word
_BYTE = np.random.default_rng(6).integers(1, 2**63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IN_WORD = np.array([chr(n).isalnum() if n < 128 else True for n in range(256)])
_BASE = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text: the numbers of its bytes, weighed by powers of a base, summed and mixed."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", np.uint8)
    inside = _IN_WORD[raw]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    word = np.cumsum(np.bincount(starts, minlength=len(raw))) - 1
    place = np.arange(len(raw)) - starts[word.clip(min=0)]
    place[~inside] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE))
    weighed = _BYTE[raw] * powers[place]
    weighed[~inside] = 0
    return mix(np.add.reduceat(weighed, starts), 3)


def rolling(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words in order; of the whole, where there are fewer."""
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for n in range(size):
        out = mix(out * _PRIME + h[n : n + len(out)], 0)
    return out


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(rolling(word_hashes(text), size))


_ODD = (np.random.default_rng(5).integers(1, 2**63, 1024, np.uint64) << np.uint64(1)) | np.uint64(1)


def mixes(x: np.ndarray, numbers: range) -> np.ndarray:
    """A row of hashes of the values, which are hashes themselves, for each numbered hash function."""
    y = x[None, :] * _ODD[numbers.start : numbers.stop, None]
    y ^= y >> np.uint64(31)
    y *= _PRIME
    y ^= y >> np.uint64(29)
    return y


def sketch(own: np.ndarray) -> bytes:
    """One byte a slot: of the smallest of the set's hashes under each of the slots' hash functions."""
    wide = max(1, min(SLOTS, 16_384 // len(own)))
    least = [mixes(own, range(n, min(n + wide, SLOTS))).min(1) for n in range(0, SLOTS, wide)]
    return (np.concatenate(least) >> np.uint64(24) & np.uint64(255)).astype(np.uint8).tobytes()


def runs(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has shared a path of the most steps with probability `recall`."""
    n = 1
    while missed(threshold, n) > 1 - recall:
        n += 1
    return n


def missed(threshold: float, n_runs: int) -> float:
    """Probability that a pair at the threshold shares no path of the most steps in any run."""
    total = 0.0
    for equal in range(SLOTS + 1):
        share = 1.0
        for _ in range(MOST_STEPS - 1):
            share = 1 - (1 - share / (threshold * SLOTS)) ** equal
        total += math.comb(SLOTS, equal) * threshold**equal * (1 - threshold) ** (SLOTS - equal) * math.exp(-share * n_runs)
    return total


def first_keys(own: np.ndarray, n_runs: int, threshold: float) -> np.ndarray:
    """Buckets of the first step of all runs."""
    limit = np.uint64(min(2.0**64 - 2048, 2.0**64 / (threshold * len(own))))
    wide = max(1, min(n_runs, 16_384 // len(own)))
    keys = []
    for at in range(0, n_runs, wide):
        own_runs = range(at, min(at + wide, n_runs))
        run, place = np.nonzero(mixes(own, range(SLOTS + own_runs.start, SLOTS + own_runs.stop)) < limit)
        keys.append(mix(own[place] + (run + at + 1).astype(np.uint64) * _PRIME, 1001))
    return np.unique(np.concatenate(keys)).view(np.int64)


def _read_sets(docs: DataFrame, shingle: int, threshold: float, recall: float) -> DataFrame:
    """id, digest of the text, size, fingerprint of the set, the first step's bucket keys and the sketch, for texts with words."""
    n_runs = runs(threshold, recall)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, digest, text in zip(batch["id"], batch["digest"], batch["text"], strict=True):
                own = shingle_set(text, shingle)
                if len(own):
                    marks = (mixes(own, range(900, 900 + MARKS)).min(1) >> np.uint64(40)).astype(np.int32)
                    rows.append((ident, digest, len(own), xxhash.xxh3_128_digest(own.tobytes()), first_keys(own, n_runs, threshold), marks, sketch(own)))
                else:
                    rows.append((ident, digest, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int32), b""))
            yield pd.DataFrame(rows, columns=["id", "digest", "size", "print", "keys", "marks", "sketch"])

    return docs.mapInPandas(read, "id long, digest binary, size int, print binary, keys array<long>, marks array<int>, sketch binary")


def _split(open_rows: DataFrame, reps: DataFrame, threshold: float, step: int) -> DataFrame:
    """Children (key) of too large buckets, for each member: by the slots of its sketch that are chosen under the path."""
    limit, places = np.uint64(2**64 / (threshold * SLOTS)), np.arange(SLOTS, dtype=np.uint64)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                paths = mix(part["key"].to_numpy(np.int64).view(np.uint64), 8000 + step)[:, None] + places * _PRIME
                tokens = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(part), SLOTS)
                row, slot = np.nonzero(mix(paths, 8100) < limit)
                keys = mix(mix(paths[row, slot], 8200) + tokens[row, slot].astype(np.uint64), 8300)
                yield pd.DataFrame({"node": part["node"].to_numpy()[row], "key": keys.view(np.int64)})

    return open_rows.select("node", "key").join(reps.select("node", "sketch"), "node").select("node", "key", "sketch").mapInPandas(split, "node long, key long")


def _alike(rows: DataFrame, large: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, alike): mean similarity of the members of large buckets (key, n), from how often their marks agree.

    The squared sum of random signs of the marks is, on average, the number of pairs that agree: sums are all it takes."""
    marked = rows.hint("merge").join(large, "key").join(reps.select("node", "marks"), "node").select("key", "n", *(F.xxhash64(F.get("marks", F.lit(k)), F.lit(k)).alias(f"h{k}") for k in range(MARKS)))
    sign = lambda k, r: F.shiftright(F.col(f"h{k}"), r).bitwiseAND(F.lit(1)) * 2 - 1
    sums = [(k, r) for k in range(MARKS) for r in range(SIGNS)]
    added = marked.groupBy("key").agg(F.max("n").alias("n"), *(F.sum(sign(k, r)).cast("double").alias(f"s{k}_{r}") for k, r in sums))
    pairs = reduce(Column.__add__, (F.col(f"s{k}_{r}") * F.col(f"s{k}_{r}") for k, r in sums))
    return added.select("key", (pairs / len(sums) / F.col("n") / F.col("n")).alias("alike"))


def _groups(it: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of equal keys from batches sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in it:
        if not len(batch):
            continue
        changed = np.zeros(len(batch), bool)
        for key in keys:
            v = batch[key].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        if held and any(held[-1][key].iloc[-1] != batch[key].iloc[0] for key in keys):
            changed[0] = True
        cuts = np.flatnonzero(changed)
        if not len(cuts):
            held.append(batch)
            continue
        if cuts[0] > 0 or held:
            whole = pd.concat([*held, batch.iloc[: cuts[0]]]) if held else batch.iloc[: cuts[0]]
            yield whole
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.iloc[a:b]
        held = [batch.iloc[cuts[-1] :]]
    if held:
        yield pd.concat(held)


def _forest(edges_a: np.ndarray, edges_b: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """For the nodes of the edges: (id, smallest id of its tree)."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(edges_a.tolist(), edges_b.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            if ids[a] > ids[b]:
                a, b = b, a
            parent[b] = a
    return [(int(ids[x]), int(ids[r])) for x in range(len(ids)) if (r := root(x)) != x]


def _cells(df: DataFrame, key: str, n: str, block: int) -> DataFrame:
    """Rows dealt to the pairs of blocks of their bucket: cell (key, i, j) and side (0: block i, 1: block j; 0 alone if i = j)."""
    m = F.ceil(F.col(n) / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(17)), m).cast("int")
    other = F.explode(F.sequence(F.lit(0), m - 1))
    return df.withColumn("m", m).withColumn("own", own).withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", "m", n)


def _near_forest(near: float):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for cell in _groups(it, ["key", "i", "j"]):
            if len(cell) < 2:
                continue
            ids, sizes = cell["node"].to_numpy(), cell["size"].to_numpy()
            marks = np.frombuffer(b"".join(cell["sketch"]), np.uint8).reshape(len(cell), SLOTS)
            left = np.arange(len(cell))
            right = left
            if cell["i"].iloc[0] != cell["j"].iloc[0]:
                side = cell["side"].to_numpy()
                left, right = left[side == 0], left[side == 1]
            need = math.ceil(near * SLOTS)
            found_a, found_b = [], []
            for at in range(0, len(left), 64):
                rows = left[at : at + 64]
                same = (marks[rows][:, None, :] == marks[right][None, :, :]).sum(2)
                a, b = np.nonzero(same >= need)
                a, b = rows[a], right[b]
                ok = (a < b) if left is right else (a != b)
                ok &= np.minimum(sizes[a], sizes[b]) >= 0.75 * np.maximum(sizes[a], sizes[b])
                found_a.append(a[ok])
                found_b.append(b[ok])
            if found_a:
                out += _forest(np.concatenate(found_a), np.concatenate(found_b), ids)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _links(threshold: float):
    """Exact comparison inside the cells: how many documents each one is linked to there, and a forest of the links."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, int, int]] = []
        for cell in _groups(it, ["key", "i", "j"]):
            if len(cell) < 2:
                continue
            ids, sizes, weight = cell["node"].to_numpy(), cell["size"].to_numpy(), cell["copies"].to_numpy(np.int64)
            own = [np.frombuffer(s, np.uint64) for s in cell["shingles"]]
            values, place, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(own)), [len(s) for s in own])
            shared = count[place] > 1
            row, place = row[shared], (np.cumsum(count > 1) - 1)[place[shared]]
            columns = int((count > 1).sum())
            common = np.zeros((len(own), len(own)), np.float32)
            order = np.argsort(place, kind="stable")
            row, place = row[order], place[order]
            for at in range(0, columns, 4096):
                low, high = np.searchsorted(place, (at, at + 4096))
                bits = np.zeros((len(own), 4096), np.float32)
                bits[row[low:high], place[low:high] - at] = 1
                common += bits @ bits.T
            linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
            np.fill_diagonal(linked, False)
            if cell["i"].iloc[0] != cell["j"].iloc[0]:
                side = cell["side"].to_numpy()
                linked &= side[:, None] != side[None, :]
            n_texts, n_docs = linked.sum(1), linked @ weight
            a, b = np.nonzero(np.triu(linked))
            trees = dict(_forest(a, b, ids))
            out += [(int(i), int(t), int(d), trees.get(int(i), int(i))) for i, t, d in zip(ids, n_texts, n_docs, strict=True) if t]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["node", "n_texts", "n_docs", "root"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["node", "n_texts", "n_docs", "root"])

    return run


def _sorted_cells(df: DataFrame) -> DataFrame:
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def ngram_jaccard(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For each document: id_col, class_id (smallest id that a chain of links leads to), copy_of (smallest id of the same
    shingle set), n_links (other documents of similarity `threshold` or more) and n_text_links (other shingle sets)."""
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull()).withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    sets = written(_read_sets(texts, shingle, threshold, recall), "sets")
    first = F.min(F.struct("id", "digest", "size", "keys", "marks", "sketch")).alias("r")
    reps = sets.where("size > 0").groupBy("print").agg(first, F.count("*").alias("copies")).select("print", "r.*", "copies")
    # nodes number the different sets: ids may repeat
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")

    def text_of(nodes: DataFrame) -> DataFrame:
        """(node, text) of the nodes (node, distinct): a text that gave their sets."""
        places = reps.select("node", "id", "digest").join(nodes, "node", "left_semi")
        return texts.join(places, ["digest", "id"]).dropDuplicates(["digest", "id"]).select("node", "text")  # one shuffle does for both

    # the recursion: leaves are (key, n, node). Joins of the rows are merge joins by hint: their size is taken for that of the
    # column before explode, thirty times less, so that they else are broadcast through the driver
    rows = reps.select("node", F.explode("keys").alias("key"))
    leaves, children, buckets = None, None, []
    for step in range(MOST_STEPS):
        counted = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        alike = _alike(rows, counted.where(F.col("n") > SPLIT_ROWS), reps)
        leaf = (F.col("n") <= SPLIT_ROWS) | (F.coalesce("alike", F.lit(0.0)) >= ALIKE) | F.lit(step == MOST_STEPS - 1)
        kept = written(rows.hint("merge").join(counted.join(alike, "key", "left").select("key", "n", leaf.alias("leaf")), "key"), "buckets")
        buckets.append(kept)
        if children is not None:
            removed(children)
        done = kept.where("leaf").select("key", "n", "node")
        leaves = done if leaves is None else leaves.unionByName(done)
        open_rows = kept.where("not leaf")
        if open_rows.isEmpty():
            break
        rows = children = written(_split(open_rows, reps, threshold, step + 1), "children")  # they are counted, then joined with the counts

    near = _cells(leaves.join(reps.select("node", "size", "sketch"), "node"), "key", "n", SKETCH_BLOCK_ROWS)
    candidates = components(_sorted_cells(near).mapInPandas(_near_forest(NEAR), "a long, b long"))
    removed(*buckets)
    roots = candidates.select(F.col("component").alias("node"), "component").distinct()
    grouped = written(candidates.unionByName(roots).select("node", F.col("component").alias("key")), "groups")
    sized = grouped.groupBy("key").agg(F.count("*").alias("n"))

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(text, shingle).tobytes() for text in batch["text"]]})

    member = grouped.join(sized, "key").join(reps.select("node", "size", "copies"), "node")
    shingles = text_of(grouped.select("node")).mapInPandas(with_sets, "node long, shingles binary")
    exact = _sorted_cells(_cells(member.join(shingles, "node"), "key", "n", BLOCK_ROWS))
    linked = written(exact.mapInPandas(_links(threshold), "node long, n_texts long, n_docs long, root long"), "links")
    classes = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = written(classes.union(classes.select("component", "component").distinct()), "classes")
    names = classes.join(reps.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("class_id"))
    counts = linked.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    per_print = reps.select("print", F.col("id").alias("copy_of"), "copies", "node").join(counts, "node", "left").join(classes.join(names, "component"), "node", "left")
    per_print = per_print.select("print", "copy_of", "copies", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("n_texts", F.lit(0)).alias("n_text_links"), (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    zero = F.lit(0).cast("long")
    return sets.select("id", "print").join(per_print, "print", "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_of", "id").alias("copy_of"),
        F.coalesce("n_links", zero).cast("long").alias("n_links"), F.coalesce("n_text_links", zero).cast("long").alias("n_text_links"),
    )
