"""Word boundaries and word hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: A-Z become a-z, the ASCII bytes that no word holds become a space, all else stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as longer buffers come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))

        def run(base: int) -> np.ndarray:
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.up, self.down = run(_BASE), run(_UNBASE)


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums by which any substring's hash is had in constant time; see ``span_hashes``."""
    POWERS.to(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * POWERS.down[starts])


class Words:
    """The words of several texts: ``norm`` bytes, word ``starts`` and ``ends`` in it, word ``hashes``, and each text's first word in ``first``."""

    def __init__(self, texts: list[bytes]) -> None:
        self.norm = b" ".join([*texts, b""]).translate(FOLD)
        data = np.frombuffer(self.norm, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = data != 32
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
        self.first = np.searchsorted(self.starts, at)
        self.hashes = span_hashes(prefix_sums(data), self.starts, self.ends)

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b-1, each two with one space between."""
        return b" ".join(self.norm[self.starts[a] : self.ends[b - 1]].split()) if b > a else b""


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + words[j : j + n]
    return mix(out)
