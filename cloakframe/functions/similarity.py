"""Jaro-Winkler similarity and the strategies that look a new value up among known ones."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

import numpy as np

from .registry import load


def jaro_winkler(a: str, b: str) -> float:
    """Fractional transpositions, a prefix bonus of at most 4 characters without a lower limit; case counts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free, left, taken = (1 << len(b)) - 1, [], 0
    places: dict[str, int] = {}
    for n, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << n
    for n, c in enumerate(a):
        low, high = max(0, n - reach), min(n + reach + 1, len(b))
        window = places.get(c, 0) & free & ~taken
        if high > low and (window := window >> low & ((1 << high - low) - 1)):
            taken |= (window & -window) << low
            left.append(c)
    common = len(left)
    if not common:
        return 0.0
    right = [c for n, c in enumerate(b) if taken >> n & 1]
    moved = sum(x != y for x, y in zip(left, right, strict=True))
    jaro = (common / len(a) + common / len(b) + (common - moved / 2) / common) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


class Resolution(Protocol):
    """Which of the known values of a type a new value stands for; None: it is new."""

    def __call__(self, kind: str, value: str | None, known: Iterable[str]) -> str | None: ...


def exact(kind: str, value: str | None, known: Iterable[str]) -> str | None:
    return value if value is not None and value in set(known) else None


class JaroWinkler:
    """The most similar known value of at least the threshold; the earliest of equals."""

    def __init__(self, threshold: float = 0.88):
        self.threshold = threshold

    def __call__(self, kind: str, value: str | None, known: Iterable[str]) -> str | None:
        if value is None or not value.strip():
            return None
        best, found = 0.0, None
        for other in known:
            if other and other.strip():
                score = jaro_winkler(value, other)
                if score >= self.threshold and score > best:
                    best, found = score, other
        return found


class _Known:
    """Known values in the order they were added, looked up by any strategy."""

    def __init__(self, resolution: Resolution):
        self.resolution, self.values = resolution, {}

    def add(self, value: str) -> None:
        self.values[value] = None

    def find(self, kind: str, value: str | None) -> str | None:
        return self.resolution(kind, value, self.values)


class _Similar(_Known):
    """The same for Jaro-Winkler: values whose lengths and characters rule the threshold out are never scored.

    Common characters are at most those that both have, counted in 64 classes; the bound of the score follows."""

    def __init__(self, resolution: JaroWinkler):
        super().__init__(resolution)
        self.listed: list[str] = []
        self.bags, self.lengths = np.zeros((64, 64), np.uint8), np.zeros(64, np.int64)

    @staticmethod
    def _bag(value: str) -> np.ndarray:
        return np.bincount([ord(c) & 63 for c in value], minlength=64).clip(max=255).astype(np.uint8)

    def add(self, value: str) -> None:
        if value in self.values or not value or not value.strip():
            return
        n = len(self.listed)
        if n == len(self.bags):
            self.bags, self.lengths = np.concatenate([self.bags, np.zeros_like(self.bags)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.bags[n], self.lengths[n] = self._bag(value), len(value)
        self.values[value] = None
        self.listed.append(value)

    def find(self, kind: str, value: str | None) -> str | None:
        n = len(self.listed)
        if value is None or not value.strip() or not n:
            return None
        if len(value) > 255:  # classes are counted to 255
            return super().find(kind, value)
        common = np.minimum(self.bags[:n], self._bag(value)).sum(1, dtype=np.int64)
        common[self.lengths[:n] > 255] = len(value)
        jaro = np.where(common > 0, (common / len(value) + common / self.lengths[:n] + 1) / 3, 0)
        hopeful = np.flatnonzero(jaro + 0.4 * (1 - jaro).clip(min=0) >= self.resolution.threshold - 1e-9)
        return self.resolution(kind, value, (self.listed[at] for at in hopeful.tolist()))


def similarity_index(resolution: Resolution) -> _Known:
    """Known values to look new ones up in; add() and find()."""
    return _Similar(resolution) if type(resolution) is JaroWinkler else _Known(resolution)


class ByType:
    """Similarity for the listed types, equality for the others."""

    def __init__(self, fuzzy: Resolution, types: Iterable[str]):
        self.fuzzy, self.types = fuzzy, frozenset(types)

    def __call__(self, kind: str, value: str | None, known: Iterable[str]) -> str | None:
        return (self.fuzzy if kind in self.types else exact)(kind, value, known)


def resolution(name: str | None, threshold: float = 0.88, fuzzy_types: Iterable[str] | None = None) -> Resolution:
    """By name: exact (or none), jaro-winkler, or module.Class, made with the threshold or without arguments."""
    name = (name or "").strip()
    if name.lower() in ("", "exact"):
        return exact
    if name.lower() == "jaro-winkler":
        made: Resolution = JaroWinkler(threshold)
    else:
        found = load(name)
        if not isinstance(found, type):
            made = found
        else:
            try:
                made = found(threshold)
            except TypeError:
                made = found()
            if not callable(made):
                raise ValueError(f"{name} makes no resolution strategy")
    types = tuple(fuzzy_types or ())
    return ByType(made, types) if types else made
