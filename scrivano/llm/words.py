"""Hashes of words, which workers keep as most words are few, and of any stretch of a sequence."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker keeps before it starts anew.
CACHED_WORDS = 300_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_128_digest(word)
        return h


_hashes = _Hashes()
_powers: dict[int, np.ndarray] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 128-bit hash of each word: a row of two unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(map(_hashes.__getitem__, words)), "<u8").reshape(-1, 2)


def forget() -> None:
    """Empties what this worker keeps."""
    _hashes.clear()
    _powers.clear()


def line_hashes(lines: list[str]) -> np.ndarray:
    """The same of lines, which aren't kept."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<u8").reshape(-1, 2)


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n modulo 2 to the 64."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        held = np.full(max(n + 1, 4096), base, np.uint64)
        held[0] = 1
        _powers[base] = held = np.cumprod(held, dtype=np.uint64)
    return held[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence: two polynomials, each of its own half of the items' hashes, from prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums, self.turns = [], []
        for which, base in enumerate(MULTIPLIERS):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(hashes[:, which] * _power(base, n)[:n], out=total[1:])
            self.sums.append(total)
            self.turns.append(_power(pow(base, -1, 1 << 64), n))

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        total = self.sums[which]
        return mix((total[ends] - total[starts]) * self.turns[which][starts] + (ends - starts).astype(np.uint64)).view(np.int64)
