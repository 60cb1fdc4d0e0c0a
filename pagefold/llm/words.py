"""Vectorised word hashes: whole batches of texts at once, by numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB, 0xF1357AEA2E62A9C5, 0x2545F4914F6CDD1D)


def byte_table(is_word, lower: bool = True) -> bytes:
    """Translation of bytes: word bytes stay (A-Z in lower case if asked), all others become a blank."""
    return bytes((b + 32 if lower and 65 <= b <= 90 else b) if is_word(b) else 32 for b in range(256))


#: Words are runs of anything but ASCII blanks.
BLANK_WORDS = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
LETTER_WORDS = byte_table(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 64), _BASE), dtype=np.uint64)])
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a translated text, in order."""
    return _words(text)[0]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ``word_hashes`` of a text, and where each word begins."""
    b = np.frombuffer(text, dtype=np.uint8)
    word = b != 32
    if not word.any():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    size = ends - starts
    first = np.cumsum(size) - size
    return run_hashes(b[word], first, size, np.arange(int(size.sum())) - np.repeat(first, size)), starts


def run_hashes(letters: np.ndarray, first: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words whose bytes stand one after the other: where each begins, its size, and each byte's place in its word."""
    total = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place], first)
    return mix(total + size.astype(np.uint64) * np.uint64(_STEP[4]))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = mix(total * np.uint64(_STEP[j % 4]) + words[j:j + n])
    return total


def batch_word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each of several translated texts, computed in one go."""
    if not texts:
        return []
    hashes, starts = _words(b" ".join(texts))
    return np.split(hashes, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])[:-1]))


def batch_gram_hashes(texts: list[bytes], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of each of several translated texts and the hashes of all its runs of ``k`` words, computed in one go."""
    words = batch_word_hashes(texts)
    if not words:
        return []
    size = np.array([len(w) for w in words])
    first = np.cumsum(size) - size
    grams = gram_hashes(np.concatenate(words), k)
    return [(w, grams[a:a + max(n - k + 1, 0)]) for w, a, n in zip(words, first.tolist(), size.tolist())]
