"""The binary [23, 12, 7] Golay code as a fuzzy hash: a word's keys are the codewords at most four bits away.

The code is perfect with radius 3, so a word has a nearest codeword; a word three bits from it has five more at
four bits, any other word has none. Two facts make keys of that: words at most two bits apart share a key, and the
nearest codeword of a word is a key of every word at most one bit away. A codeword is named by its 12 leading bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

_GENERATOR = 0xC75


def syndrome(word: int) -> int:
    """The remainder of a 23-bit word, as a polynomial, by the generator."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; for each syndrome the number of keys and what they change in the name."""
    low = np.array([syndrome(x) for x in range(1 << 12)], dtype=np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], dtype=np.int64)
    change = np.zeros((2048, 6), dtype=np.int64)
    count = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        for at in combinations(range(23), weight):
            error = sum(1 << i for i in at)
            s = syndrome(error)
            change[s, count[s]] = error >> 11
            count[s] += 1
    return low, high, count, change


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: the names of their keys (n, 6), the nearest codeword first, and how many of the six hold."""
    low, high, count, change = _tables()
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words >> 11)[:, None] ^ change[s], count[s]
