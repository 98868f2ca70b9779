"""Word and shingle hashes shared by the set operators."""

from __future__ import annotations

import numpy as np

#: Odd 64-bit multipliers, one a place in the shingle.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Everything that is not a digit, a letter or beyond ASCII becomes a space.
PUNCTUATION = bytes(c if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c > 127 else 32 for c in range(256))


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 150_000:  # some 30 MB
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles in order; of all words if there are fewer."""
    if not len(w):
        return w
    k, short = min(k, len(w)), len(w) < k
    h = np.full(len(w) - k + 1, k if short else 0, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(32))) * ODD[7 - j % 7] + w[j : len(w) - k + 1 + j] * ODD[j % 7]
    h = (h ^ (h >> np.uint64(29))) * ODD[0]
    return h ^ (h >> np.uint64(32))
