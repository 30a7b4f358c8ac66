"""Sets of hashed word shingles, for many texts at once."""

from __future__ import annotations

import numpy as np

SIZE = 5
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
        have += step
    return out[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (bytes other than ASCII white space, A-Z in lower case) of ``data`` and where each starts."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    starts, ends = edge[::2], edge[1::2]
    # two polynomials: sums over a word of (letter + 1) * base ** (place in the word), by differences of running sums
    letters = mix(_FOLD[data].astype(np.uint64) + np.uint64(1))
    inverse = pow(_BASE, -1, 1 << 64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * _powers(len(data), _BASE), dtype=np.uint64)))
    back = _powers(len(data) + 1, inverse)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words has one, of all its words; one without words none."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if not encoded:
        return []
    data = np.frombuffer(b"\n".join(encoded), np.uint8)
    words, starts = word_hashes(data)
    ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)
    last = np.searchsorted(starts, ends)
    first = np.concatenate(([0], last[:-1]))
    base = np.uint64(_BASE)
    full = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for i in range(size):
        full = mix((full + words[i : i + len(full)]) * base)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = mix((h + w) * base)
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
