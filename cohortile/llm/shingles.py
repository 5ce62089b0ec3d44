"""Word shingles of whole texts as 64-bit numbers, for many texts at a time."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(7_919)
_LETTER = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base & (2**64 - 1), np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def words(texts: list[bytes], beginnings: tuple[int, ...] = ()):
    """Hash, start, end and text number of every word `[^\\x20\\x09-\\x0D]+`; A-Z count as a-z.

    For each length in ``beginnings`` follows an array with the hash of the words' first so many bytes,
    0 for words that are not longer.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    if not len(raw):
        none = np.array([], np.int64)
        return (none.astype(np.uint64), none, none, none, *([none.astype(np.uint64)] * len(beginnings)))
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space.view(np.int8), [1]])))
    start, end = edge[0::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * up[:len(raw)], dtype=np.uint64)])
    value = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)
    owner = np.searchsorted(firsts, start, side="right") - 1
    more = []
    for size in beginnings:
        long = end - start > size
        head = mixed((total[np.where(long, start + size, start)] - total[start]) * down[start] + _LETTER[size % 256])
        more.append(np.where(long, head, np.uint64(0)))
    return (value, start - firsts[owner], end - firsts[owner], owner, *more)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every text, sorted, in one array, and where each text's begin.

    A text of fewer words is one shingle of them all; a text without words has none.
    """
    value, _, _, owner = words(texts)
    n = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    if len(value) >= k:
        h = value[:len(value) - k + 1].copy()
        for i in range(1, k):
            h = mixed(h * _STEP + value[i:len(value) - k + 1 + i])
        inside = owner[:len(h)] == owner[k - 1:]
        h, of = h[inside], owner[:len(h)][inside]
    else:
        h, of = value[:0], owner[:0]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(n)])
        extra = []
        for t in short:
            x = value[first[t]:first[t] + 1]
            for i in range(1, n[t]):
                x = mixed(x * _STEP + value[first[t] + i:first[t] + i + 1])
            extra.append(mixed(x + np.uint64(n[t])))  # apart from a full shingle
        h, of = np.concatenate([h, *extra]), np.concatenate([of, short])
        by = np.argsort(of, kind="stable")
        h, of = h[by], of[by]
    bound = np.searchsorted(of, np.arange(len(texts) + 1))
    for a, b in zip(bound[:-1], bound[1:]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def in_chunks(texts: list[bytes], most: int = 1 << 20):
    """Runs (from, to) of texts with about ``most`` bytes each; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
