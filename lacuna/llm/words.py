"""Hashes of all words of a batch of texts, computed with numpy.

A word is a run of bytes of one class in the UTF-8 text.  Classes only name
ASCII bytes as separators, so byte runs and code point runs are the same.
"""

from collections.abc import Iterable

import numpy as np

#: Separators: white space of ASCII, or everything of ASCII but letters and digits.
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20260101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse, for i below n, modulo 2 ** 64."""
    size = max(_SLICE + 1, 1 << (n - 1).bit_length())
    if size not in _powers:
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def _hash_slice(raw: np.ndarray, word: np.ndarray, prefix: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word, or of its first bytes, in a slice that cuts no word."""
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if prefix:
        end = np.minimum(end, start + prefix)
    power, inverse = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(texts: Iterable[str | None], word_bytes: np.ndarray, lower: bool, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's begin.

    With `prefix`, of the first so many bytes of each word.  The second array has one entry more than there are texts.
    """
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0, *(len(c) + 1 for c in coded)])
    raw = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    if lower:
        raw = _LOWER[raw]
    word = word_bytes[raw]
    starts, hashes, at = [], [], 0
    while at < len(raw):
        to = min(at + _SLICE, len(raw))
        if to < len(raw):
            gaps = np.flatnonzero(~word[at:to])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # one word longer than a slice
                gaps = np.flatnonzero(~word[to:])
                to = to + int(gaps[0]) + 1 if len(gaps) else len(raw)
        s, h = _hash_slice(raw[at:to], word[at:to], prefix)
        starts.append(s + at)
        hashes.append(h)
        at = to
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, begin)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words of one text; of all its words if they are fewer."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * factors[j]
    return mix(total)


def word_spans(texts: Iterable[str | None], word_bytes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with a separator behind each, where their words start and end, the words' hashes, and where each text's words begin."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0, *(len(c) + 1 for c in coded)])
    raw = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    if lower:
        raw = _LOWER[raw]
    word = word_bytes[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes, at = [], 0
    while at < len(start):
        to = max(int(np.searchsorted(end, start[at] + _SLICE, "right")), at + 1)
        a, b = start[at], end[to - 1]
        hashes.append(_hash_slice(raw[a:b], word[a:b], None)[1])
        at = to
    return raw, start, end, np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.searchsorted(start, begin)
