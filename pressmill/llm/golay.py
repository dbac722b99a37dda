"""The perfect binary Golay code of length 23 and its fuzzy index.

Every 23-bit word lies within distance 3 of exactly one of 4,096 codewords. Its
indices are those of all codewords within distance 4: one if the nearest lies
within 2, else six. Two words that differ in at most two bits have an index in
common, which makes the indices keys of a join that finds all such pairs:

* where the nearest codeword c of one word lies within 2, the other is within 4 of c;
* where it lies at 3 with error e, a difference f that meets e, or has one bit,
  leaves the other word within 4 of c; else the one codeword whose difference from
  c has weight 7 and covers e and a bit of f is at distance 4 from both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH = 23
CHECK_BITS = 11
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, fixed by the code
INDICES = 6


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words as polynomials, divided by the generator."""
    rest = words.astype(np.uint32)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(GENERATOR << (bit - CHECK_BITS)), rest)
    return rest


def _patterns() -> np.ndarray:
    """Per syndrome the error words of weight up to 4 that lead to a codeword, -1 where fewer."""
    errors = [
        sum(1 << place for place in places)
        for weight in range(5)
        for places in combinations(range(LENGTH), weight)
    ]
    table = np.full((1 << CHECK_BITS, INDICES), -1, dtype=np.int64)
    filled = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for error, syndrome in zip(errors, _syndromes(np.array(errors)).tolist(), strict=True):
        table[syndrome, filled[syndrome]] = error
        filled[syndrome] += 1
    return table


PATTERNS = _patterns()


def indices(words: np.ndarray) -> np.ndarray:
    """Six columns of codeword indices (12 bits) per word, -1 where there is only one."""
    errors = PATTERNS[_syndromes(words)]
    decoded = (words.astype(np.int64)[:, None] ^ errors) >> CHECK_BITS
    return np.where(errors < 0, -1, decoded)
