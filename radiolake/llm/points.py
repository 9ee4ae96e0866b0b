"""Texts as arrays of code points, folded so that only letters (and digits) count."""

from __future__ import annotations

import numpy as np

_TABLES: dict[str, np.ndarray] = {}


def _table(kind: str) -> np.ndarray:
    """For every code point of the first plane: lower-cased if it is of the kind (a str method), else 0. Made once in a task."""
    if kind not in _TABLES:
        chars, counts = [chr(i) for i in range(1 << 16)], getattr(str, kind)
        _TABLES[kind] = np.array([(ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if counts(c) else 0 for c in chars], np.uint32)
    return _TABLES[kind]


def normalised(text: str, kind: str = "isalnum") -> tuple[np.ndarray, np.ndarray]:
    """Code points with letters lower-cased and each run of other characters as one space, and their places in the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < (1 << 16)
    folded = np.where(low, _table(kind)[np.where(low, points, 0)], points)
    word = folded > 0
    keep = word | np.concatenate([[False], word[:-1]])  # a run of other characters after a word is one space
    places = np.flatnonzero(keep)
    out = np.where(word, folded, np.uint32(32))[keep]
    if len(out) and out[-1] == 32:
        out, places = out[:-1], places[:-1]
    return out, places
