"""Exact top-k search by inner product: ball trees per shard, branch and bound, kth scores shared between shards.

Vectors are dealt into shards of bounded size and each shard builds a ball tree over its integer vectors. Queries go
to the shards in blocks. A first wave descends, in every shard, only into the leaf of the largest upper bound; from
its scores each query's kth score over all shards is known from below. In the second wave each shard starts from that
score and visits its other nodes by falling upper bound (inner product with the centre, plus norm times radius) until
no bound can reach the query's kth score.

Defined results: components become floor(scale * x), x as double. Vectors that are null, or hold a null, NaN or
infinite component, take no part. Vectors of different length never meet. Queries that are a condition on the vectors
are rows of them: a query's own row is no candidate, other rows of its id are. Of queries in a table of their own no
vector of a query's id is a candidate. Candidates of equal id are all listed. Ties go to the smaller id. Components
and scores outside a signed 64-bit integer are cut to its range, before they are ranked. Rows with a null id take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Vectors in a shard and queries in a block, about; vectors in a leaf, at most.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8_192, 2_000, 64
_EXACT = 2.0**52


class BallTree:
    """Balls over rows of integer vectors, split at the median of the widest-spread direction; leaves are contiguous."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS, marks: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        lows, highs, left, right = [], [], [], []
        pending, nodes = [(0, len(ids), -1, 0)], 0
        while pending:
            low, high, parent, side = pending.pop()
            at, nodes = nodes, nodes + 1
            lows.append(low)
            highs.append(high)
            left.append(-1)
            right.append(-1)
            if parent >= 0:
                (right if side else left)[parent] = at
            if high - low > leaf:
                own = vectors[order[low:high]]
                far = own[((own - own[0]) ** 2).sum(1).argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                along = own @ (other - far)
                order[low:high] = order[low:high][np.argsort(along, kind="stable")]
                middle = (low + high) // 2
                pending += [(middle, high, at, 1), (low, middle, at, 0)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.marks = self.ids if marks is None else marks[order]  # what tells a query's own row
        self.low, self.high, self.left, self.right = map(np.array, (lows, highs, left, right))
        self.centre = np.stack([self.vectors[a:b].mean(0) for a, b in zip(lows, highs, strict=True)])
        self.radius = np.array([np.sqrt(((self.vectors[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(lows, highs, self.centre, strict=True)])
        self.first_id = np.array([self.ids[a:b].min() for a, b in zip(lows, highs, strict=True)])

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """No vector in the node scores higher."""
        norm = np.sqrt((queries**2).sum(1, keepdims=True))
        raw = queries @ self.centre[nodes].T + norm * self.radius[nodes]
        return np.floor(raw + 1e-9 * np.abs(raw) + 1e-6)

    def leaf_of(self, queries: np.ndarray) -> np.ndarray:
        """For each query the leaf reached by always taking the child of the larger bound."""
        at = np.zeros(len(queries), np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return at
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                kids = np.array([self.left[node], self.right[node]])
                at[rows] = kids[self.bounds(queries[rows], kids).argmax(1)]

    def scored(self, query_ids: np.ndarray, queries: np.ndarray, node: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k best (score, id) of a node's vectors, without those of its own mark."""
        low, high = self.low[node], self.high[node]
        scores, ids, marks = queries @ self.vectors[low:high].T, self.ids[low:high], self.marks[low:high]
        out = []
        for own, row in zip(query_ids, scores, strict=True):
            keep = np.flatnonzero(marks != own)
            if len(keep) > k:
                edge = -np.partition(-row[keep], k - 1)[k - 1]
                keep = keep[row[keep] >= edge]
                keep = keep[np.lexsort((ids[keep], -row[keep]))][:k]
            out.append((row[keep], ids[keep]))
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """All candidates that can be among the k best, given for each query a score and id that k known candidates reach."""
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in query_ids]
        kth, kth_id = kth.copy(), kth_id.copy()
        alive = lambda bound, first, q: (bound > kth[q]) | ((bound == kth[q]) & (first <= kth_id[q]))
        level, found_q, found_n, found_b = np.zeros(1, np.int64), [], [], []
        open_q = np.arange(len(query_ids))
        pairs_q, pairs_n = open_q, np.repeat(level, len(open_q))
        while len(pairs_q):  # down the tree: only children whose bound reaches the shared kth score
            bound = np.empty(len(pairs_q))
            for node in np.unique(pairs_n):
                at = np.flatnonzero(pairs_n == node)
                bound[at] = self.bounds(queries[pairs_q[at]], np.array([node]))[:, 0]
            keep = alive(bound, self.first_id[pairs_n], pairs_q)
            pairs_q, pairs_n, bound = pairs_q[keep], pairs_n[keep], bound[keep]
            leaf = self.left[pairs_n] < 0
            found_q.append(pairs_q[leaf])
            found_n.append(pairs_n[leaf])
            found_b.append(bound[leaf])
            pairs_q, pairs_n = np.repeat(pairs_q[~leaf], 2), np.stack([self.left[pairs_n[~leaf]], self.right[pairs_n[~leaf]]], 1).ravel()
        q, n, b = (np.concatenate(x) if x else np.zeros(0) for x in (found_q, found_n, found_b))
        order = np.lexsort((-b, q))
        q, n, b = q[order].astype(np.int64), n[order].astype(np.int64), b[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        for step in range(int(turn.max()) + 1 if len(turn) else 0):  # each query's leaves by falling bound
            now = np.flatnonzero(turn == step)
            now = now[alive(b[now], self.first_id[n[now]], q[now])]
            for node in np.unique(n[now]):
                rows = q[now[n[now] == node]]
                for at, (scores, ids) in zip(rows, self.scored(query_ids[rows], queries[rows], node, k), strict=True):
                    s, i = np.concatenate([best[at][0], scores]), np.concatenate([best[at][1], ids])
                    first = np.lexsort((i, -s))[:k]
                    best[at] = s[first], i[first]
                    if len(first) == k and (s[first[-1]], -i[first[-1]]) > (kth[at], -kth_id[at]):
                        kth[at], kth_id[at] = s[first[-1]], i[first[-1]]
        return best


def _matrix(rows: pd.Series) -> np.ndarray:
    """Integer vectors as doubles; as Python integers where a product could leave the doubles' exact range."""
    out = np.stack([np.asarray(v, np.float64) for v in rows])
    most = np.abs(out).max() if out.size else 0
    return out if most * most * out.shape[1] < _EXACT else np.array([[int(x) for x in row] for row in out], dtype=object)


def _clip(score) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def _brute(ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    scores = [_clip(x) for x in vectors @ query]
    keep = sorted((i for i in range(len(ids)) if marks[i] != own), key=lambda i: (-scores[i], ids[i]))[:k]
    return [scores[i] for i in keep], [ids[i] for i in keep]


def _wave(first: bool, k: int, leaf: int):
    """A shard's part of one wave: its vectors on the left, the queries sent to it on the right."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(vectors) and len(queries):
            dense, asked = _matrix(vectors["v"]), _matrix(queries["q"])
            ids, query_ids, rows = vectors["id"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64), queries["row"].to_numpy(np.int64)
            marks, own_marks = vectors["mark"].to_numpy(np.int64), queries["mark"].to_numpy(np.int64)
            small = dense.dtype != object and asked.dtype != object and dense.size and float(np.abs(dense).max()) * float(np.abs(asked).max()) * dense.shape[1] < _EXACT
            if not small:  # numbers beyond the exact doubles: whole shards, in Python's integers
                dense, asked = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(len(m), -1) for m in (dense, asked))
                result = [] if first else [_brute(ids, marks, dense, own, query, k) for own, query in zip(own_marks, asked, strict=True)]
            else:
                tree = BallTree(ids, dense, leaf, marks)
                if first:
                    result, leaves = [None] * len(rows), tree.leaf_of(asked)
                    for node in np.unique(leaves):
                        at = np.flatnonzero(leaves == node)
                        for n, got in zip(at, tree.scored(own_marks[at], asked[at], node, k), strict=True):
                            result[n] = got
                else:
                    result = tree.search(own_marks, asked, k, queries["kth"].to_numpy(np.float64), queries["kth_id"].to_numpy(np.int64))
            found = [(row, own, int(i), _clip(s)) for row, own, (scores, near) in zip(rows, query_ids, result, strict=bool(result)) for s, i in zip(scores, near, strict=True)] if result else []
        return pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score"]).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64"})

    return run


def top_k(vectors: DataFrame, queries: DataFrame | Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query: rows of the vectors for which the
    condition `queries` holds, or of a table of their own."""

    def integers(df: DataFrame, *more: Column) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        whole = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double") if scale < 2**20 else F.floor(x * scale)).alias("v"), *more)

    if isinstance(queries, Column):  # rows are numbered, written and told apart by their numbers
        base = written(integers(vectors, F.coalesce(queries, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("mark")), "vectors")
        found = base.where("asked")
    else:
        base = integers(vectors, F.col(id_col).cast("long").alias("mark"))
        found = integers(queries, F.col(id_col).cast("long").alias("mark"))
    asked = written(found.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "mark", F.monotonically_increasing_id().alias("row"), F.size("v").alias("dim")), "queries")
    shards = max(1, -(-base.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    left = base.select("id", "v", "mark").withColumns({"dim": F.size("v"), "shard": F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")})
    blocked = lambda df: df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    # each block of queries meets each shard: the stated query set against all rows
    to_shards = lambda df: blocked(df).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    to_blocks = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    schema = "row long, query_id long, vec_id long, score long"
    wave = lambda sent, first: to_blocks.groupBy(*keys).cogroup(to_shards(sent).groupBy(*keys)).applyInPandas(_wave(first, k, leaf_rows), schema)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    seeds = ranked(wave(asked, True)).where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("kth"), F.col("vec_id").alias("kth_id"))
    shared = written(asked.join(seeds, "row", "left").withColumns({"kth": F.coalesce("kth", F.lit(float("-inf"))), "kth_id": F.coalesce("kth_id", F.lit(2**63 - 1))}), "kth")
    return ranked(wave(shared, False)).select("query_id", "rank", "vec_id", "score")
