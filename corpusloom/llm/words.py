"""Words of whole buffers of text at once: where they stand and 64-bit digests of them, by numpy."""

from __future__ import annotations

import numpy as np

#: Powers are made for buffers of so many bytes at first, more if a longer one comes.
USUAL = 5 << 19


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in which ``inside`` holds."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a number spread over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digest:
    """Polynomial digests of all words of a buffer at once: differences of running sums, shifted to the word's start."""

    def __init__(self, seed: int, odd: int):
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))
        self.odd, self.powers = odd, np.ones(0, np.uint64)

    def of(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(letters) + 1:
            size = max(len(letters) + 1, USUAL)
            run = lambda by: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, by, np.uint64))])
            self.powers, self.inverse = run(self.odd), run(pow(self.odd, -1, 1 << 64))
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(self.letters[letters] * self.powers[: len(letters)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts])


#: Two independent ones.
ONE, TWO = Digest(0x9E3779B97F4A7C15, 0xD1342543DE82EF95), Digest(0xC2B2AE3D27D4EB4F, 0xAF251AF3B0F025B5)
