"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a block of rows form a small corpus. All of its bytes lie in one flat array with links to
the neighbours inside the word; an inverted index maps the rank of each adjacent pair to the positions where it
stands. Merges are replayed in rank order over the whole corpus at once, and each merge updates only the pairs
that it touches. (A word in which a merge makes a pair of lower rank is merged anew by itself.) The ids of a word are kept for later blocks of the same task in two generations of bounded size:
when the younger is full it becomes the older, and words of the older that are met again move on to the younger.

Defined results: a null text is an empty text; an empty text has no ids; decoding null ids gives no bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a generation (a task keeps two), and characters of text that form one block.
KEPT_WORDS, BLOCK_CHARS = 100_000, 1_500_000
_SHIFT = 24


class Vocabulary:
    """Ranks of a rank file: lines of a base64 token and its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every pair of tokens that merges: left << _SHIFT | right, sorted, and the rank that it merges into
        pairs = [(left << _SHIFT | right, rank) for token, rank in ranks.items() for at in range(1, len(token)) if (left := ranks.get(token[:at])) is not None and (right := ranks.get(token[at:])) is not None]
        self.pair_keys, self.pair_ranks = map(np.array, zip(*sorted(pairs), strict=True)) if pairs else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64) - 1)
        self.pairs = dict(pairs)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what pairs of neighbouring tokens merge into, -1 for none."""
        key = left << _SHIFT | right
        at = np.searchsorted(self.pair_keys, key).clip(max=len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out, rest = {}, []
        for word in words:
            raw = word.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is None:
                rest.append((word, raw))
            else:
                out[word] = whole.to_bytes(4, "little")
        for (word, _), own in zip(rest, self.replay([raw for _, raw in rest]), strict=True):
            out[word] = own
        return out

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, as bytes, by applying all merges in rank order to all words at once."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        ids, following = self.single[raw], np.arange(1, len(raw) + 1)
        following[ends[lengths > 0] - 1] = -1
        before = np.arange(-1, len(raw) - 1)
        before[(ends - lengths)[lengths > 0]] = -1
        due_at = np.full(len(raw), -1)  # rank of the pair that begins at a position
        inner = np.flatnonzero(following >= 0)
        due_at[inner] = self.merged(ids[inner], ids[inner + 1])
        # the inverted index: rank -> positions
        index: dict[int, list[int]] = {}
        live = np.flatnonzero(due_at >= 0)
        live = live[np.argsort(due_at[live], kind="stable")]
        cuts = np.flatnonzero(np.diff(due_at[live])) + 1
        for part in np.split(live, cuts) if len(live) else []:
            index[int(due_at[part[0]])] = part.tolist()
        due = list(index)
        heapify(due)
        early: list[int] = []  # where a merge made a pair of lower rank
        get, id_of, next_of, prev_of, rank_of = self.pairs.get, *map(memoryview, (ids, following, before, due_at))

        def add(rank: int, at: int) -> None:
            found = index.get(rank)
            if found is None:
                index[rank] = [at]
                heappush(due, rank)
            else:
                found.append(at)

        while due:
            rank = heappop(due)
            places = index.pop(rank)
            if len(places) < 24:
                places.sort()
                for at in places:
                    if rank_of[at] != rank:
                        continue  # an earlier merge took one of the two
                    then = next_of[at]
                    after, left = next_of[then], prev_of[at]
                    id_of[at], id_of[then], next_of[at] = rank, -1, after
                    rank_of[then] = rank_of[at] = -1
                    if after >= 0:
                        prev_of[after] = at
                        new = get(rank << _SHIFT | id_of[after], -1)
                        if new >= 0:
                            rank_of[at] = new
                            add(new, at)
                            if new < rank:
                                early.append(at)
                    if left >= 0:
                        new = get(id_of[left] << _SHIFT | rank, -1)
                        rank_of[left] = new
                        if new >= 0:
                            add(new, left)
                            if new < rank:
                                early.append(at)
                continue
            at = np.unique(np.array(places))
            at = at[due_at[at] == rank]
            then = following[at]
            if len(at) > 1 and (then[:-1] == at[1:]).any():  # runs of one token: from the left, each token once
                keep, taken = [], -1
                for n, (x, y) in enumerate(zip(at.tolist(), then.tolist(), strict=True)):
                    if x != taken:
                        keep.append(n)
                        taken = y
                at, then = at[keep], then[keep]
            after = following[then]
            ids[at], ids[then], following[at] = rank, -1, after
            due_at[then] = due_at[at] = -1
            has = after >= 0
            before[after[has]] = at[has]
            left = before[at]
            has_left = left >= 0
            new_at = np.concatenate([at[has], left[has_left]])
            new = np.concatenate([self.merged(np.full(int(has.sum()), rank), ids[after[has]]), self.merged(ids[left[has_left]], np.full(int(has_left.sum()), rank))])
            due_at[new_at] = new
            some = new >= 0
            for r, x in zip(new[some].tolist(), new_at[some].tolist(), strict=True):
                add(r, x)
            if (new[some] < rank).any():
                early += new_at[some][new[some] < rank].tolist()
        kept = ids >= 0
        counts = np.concatenate([[0], np.cumsum(kept)])
        packed = ids[kept].astype("<u4").tobytes()
        bounds = (counts[ends] * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]
        for word in {int(w) for w in np.searchsorted(ends, early, side="right")}:  # its merges did not come in rank order
            out[word] = self.one_word(words[word])
        return out

    def one_word(self, raw: bytes) -> bytes:
        """Ids of a word, always merging the leftmost pair of least rank."""
        own = [int(self.single[b]) for b in raw]
        while True:
            found = [(r, n) for n in range(len(own) - 1) if (r := self.pairs.get(own[n] << _SHIFT | own[n + 1], -1)) >= 0]
            if not found:
                return array("I", own).tobytes()
            rank, at = min(found)
            own[at : at + 2] = [rank]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def _blocks(texts: pd.Series, most: int) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        block.append(text if isinstance(text, str) else "")
        size += len(block[-1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


class Encoder:
    """Ids of texts, with the words of two generations at hand."""

    def __init__(self, path: str, pattern: str):
        self.vocab, self.split, self.known, self.older = vocabulary(path), regex.compile(pattern).findall, {}, {}

    def __call__(self, texts: pd.Series) -> list[bytes]:
        out = []
        for block in _blocks(texts, BLOCK_CHARS):
            parts = [self.split(text) for text in block]
            met = {word for own in parts for word in own}.difference(self.known)
            again = met.intersection(self.older)
            self.known.update((word, self.older[word]) for word in again)
            self.known.update(self.vocab.encode_words(met - again))
            get = self.known.__getitem__
            out += [b"".join(map(get, own)) for own in parts]
            if len(self.known) > KEPT_WORDS:
                self.known, self.older = {}, self.known
        return out


def _decoded(vocab: Vocabulary, row: bytes | None) -> bytes:
    ids = array("I")
    ids.frombytes(row or b"")
    return b"".join(map(vocab.tokens.__getitem__, ids))


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text column as one binary value a row: little-endian unsigned 32-bit integers, no special tokens."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path, pattern)
        for texts in batches:
            yield pd.Series(encoder(texts), dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Bytes that the ids of a binary column, as encode() gives them, stand for."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for rows in batches:
            yield pd.Series([_decoded(vocab, row) for row in rows], dtype=object)

    return decoded(ids)


def encode_and_decode(text: Column, path: str, pattern: str) -> Column:
    """struct<ids, decoded>: both in one pass, by one worker."""

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, pattern)
        for texts in batches:
            ids = encoder(texts)
            yield pd.DataFrame({"ids": ids, "decoded": [_decoded(encoder.vocab, row) for row in ids]}, dtype=object)

    return both(text)


def n_tokens(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
