"""Texts as NumPy arrays: code points, words and their hashes, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters that are worked on at a time; a longer text is worked on alone.
GROUP_CHARACTERS = 80_000
_ODD = np.random.default_rng(20).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = np.random.default_rng(21).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TWO_TABLES = (_ODD, _OTHER)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def groups(texts, most: int = GROUP_CHARACTERS) -> Iterator[list[str]]:
    """Consecutive texts (null: empty) in lists of at most ``most`` characters, or one text."""
    own, size = [], 0
    for t in texts:
        t = t or ""
        if own and size + len(t) > most:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t) + 1
    if own:
        yield own


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after the other, each behind a line feed and the last before one; and where each text's line feed stands."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return points, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def blanks(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def stretch_hashes(values: np.ndarray, lengths: np.ndarray, *tables: np.ndarray):
    """64-bit hashes of consecutive stretches of ``values``, none of them empty; one array for each table of odd numbers."""
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(len(values)) - np.repeat(firsts, lengths)
    plus, place, far = values.astype(np.uint64) + np.uint64(1), within & 63, (within >> 6).astype(np.uint64) * np.uint64(2) if lengths.max() > 64 else None
    out = []
    for odd in tables or (_ODD,):
        factor = odd[place] if far is None else odd[place] + far
        out.append(mixed(np.add.reduceat(plus * factor, firsts) + lengths.astype(np.uint64) * _MIX))
    return out if tables else out[0]


def word_hashes(points: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word (run outside ``gap``) starts, and a 64-bit hash of it. The first and the last point must be gaps."""
    inside = ~gap
    starts = np.flatnonzero(inside[1:] & gap[:-1]) + 1
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    ends = np.flatnonzero(gap[1:] & inside[:-1]) + 1
    return starts, stretch_hashes(points[inside], ends - starts)


def sums_by(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of stretches of ``values`` that begin at the ascending indices ``firsts``; empty stretches give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[np.append(firsts[1:], len(values))] - total[firsts]
