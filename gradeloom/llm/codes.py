"""Perfect binary codes, whose words are the anchors of near-duplicate search.

A code is given by one syndrome per bit: the words whose bits' syndromes cancel out
are its codewords. Every word is within the covering radius of a codeword; with a
perfect code it is exactly one, the word's home anchor.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np


def golay_bits() -> list[int]:
    """The binary Golay code: 23 bits, 4096 codewords, covering radius 3."""
    generator = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a fixed value
    out = []
    for i in range(23):
        rest = 1 << i
        for b in range(i, 10, -1):
            if rest >> b & 1:
                rest ^= generator << (b - 11)
        out.append(rest)
    return out


def hamming_bits(r: int) -> list[int]:
    """The Hamming code of 2^r - 1 bits, covering radius 1."""
    return list(range(1, 2**r))


def joined(*parts: list[int]) -> list[int]:
    """Codes side by side: each has syndromes of its own."""
    out, shift = [], 0
    for part in parts:
        out += [s << shift for s in part]
        shift += max(part).bit_length()
    return out


class AnchorCode:
    """Anchors of words of `len(bits)` bits within covering radius plus threshold."""

    def __init__(self, bits: list[int], radius: int, threshold: int):
        self.bits = np.array(bits, dtype=np.int64)
        near: dict[int, list[int]] = {}
        for weight in range(radius + threshold + 1):
            for at in combinations(range(len(bits)), weight):
                syndrome = pattern = 0
                for i in at:
                    syndrome ^= bits[i]
                    pattern |= 1 << i
                near.setdefault(syndrome, []).append(pattern)
        size = 1 << int(max(bits)).bit_length()
        # Lightest pattern first: the home anchor. Without a threshold it stands alone.
        keep = max(map(len, near.values())) if threshold else 1
        self.patterns = np.full((size, keep), -1, dtype=np.int64)
        for syndrome, patterns in near.items():
            self.patterns[syndrome, : min(keep, len(patterns))] = patterns[:keep]
        if (self.patterns[:, 0] < 0).any():
            raise ValueError("the code does not cover all words within its radius")

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, anchors and whether the anchor is the row's home."""
        syndrome = np.zeros(len(words), dtype=np.int64)
        for i, s in enumerate(self.bits):
            syndrome ^= np.where((words >> i) & 1, s, 0)
        patterns = self.patterns[syndrome]
        row, nth = np.nonzero(patterns >= 0)
        return row, words[row] ^ patterns[row, nth], nth == 0
