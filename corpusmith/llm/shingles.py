"""Hashed runs of words, the elements of the sets that the near-duplicate operators compare."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = 5
_WORD = re.compile(r"[a-z0-9_]+")
_KEPT = 500_000


class Shingler:
    """Distinct runs of ``words`` words of lower-cased texts, as sorted 64-bit hashes."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        rng = np.random.default_rng(20240501)
        self.factors = rng.integers(1, 1 << 63, size=words, dtype=np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}

    def of(self, tokens: list[str]) -> np.ndarray:
        """The sorted distinct hashes of the runs of ``tokens``."""
        count = len(tokens) - self.words + 1
        if count < 1:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > _KEPT:
            known.clear()
        for t in set(tokens):
            if t not in known:
                known[t] = xxhash.xxh64_intdigest(t)
        single = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        total = np.zeros(count, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.words):
                total += single[i : i + count] * self.factors[i]
            total ^= total >> np.uint64(33)
            total *= np.uint64(0xFF51AFD7ED558CCD)
            total ^= total >> np.uint64(33)
            total *= np.uint64(0xC4CEB9FE1A85EC53)
            total ^= total >> np.uint64(33)
        return np.unique(total)

    def text(self, text: str | None) -> np.ndarray:
        """The runs of the words of a text; none if it is null or has too few words."""
        return self.of(_WORD.findall(text.lower())) if text else np.zeros(0, dtype=np.uint64)
