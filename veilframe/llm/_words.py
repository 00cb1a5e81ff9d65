"""Words of many texts at once as 64-bit hashes, with numpy, for use inside tasks.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is a
polynomial over random byte values, read off prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a buffer of bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a buffer that is lower-cased already."""
    raw = np.frombuffer(buffer, np.uint8)
    starts, ends = word_spans(raw)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * _powers(_BASE, len(raw))[:-1], out=prefix[1:], dtype=np.uint64)
    hashes = (prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(raw))[starts]
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64))


def batches_of_texts(texts: list, limit: int = 1 << 20):
    """Cut a list of texts (null: empty) into runs of about ``limit`` bytes; yields (first index, lower-cased bytes)."""
    run, first, size = [], 0, 0
    for i, text in enumerate(texts):
        b = (text or "").encode("utf-8", "surrogatepass").lower()
        if run and size + len(b) > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def hashed_words(texts: list):
    """For each text in order, the hashes of its words."""
    for _, run in batches_of_texts(texts):
        starts, _, hashes = word_hashes(b"\n".join(run) + b"\n")
        cuts = np.cumsum([len(b) + 1 for b in run])
        yield from np.split(hashes, np.searchsorted(starts, cuts[:-1]))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The distinct runs of ``width`` words, as sorted hashes; of fewer words the whole is one, of none there is none."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = mix(words[: n - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : n - width + 1 + k])
    return np.unique(out)
