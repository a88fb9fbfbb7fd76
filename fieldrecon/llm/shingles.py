"""Shingle sets and min-wise signatures of whole texts, vectorised over batches.

Words are runs of anything but ASCII white space, with A-Z lower-cased.  A word's
hash is a polynomial over its bytes, taken for all words at once from running
sums; a shingle's hash mixes the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from fieldrecon.llm.common import SPACES

SIZE = 5
#: bytes looked at in one step: bounds the arrays whatever a text's length
CHUNK = 1 << 18

_rng = np.random.default_rng(20240501)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_rng.integers(1 << 62, 1 << 63)) * 2 + 1
_Q = pow(_P, -1, 1 << 64)
_WEIGHTS = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[list(SPACES.encode())] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _powers[base] = have = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all of the 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(data: bytes, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most about CHUNK bytes that end at a blank."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n and not blank[data[end]]:
            end += 1
        yield at, end
        at = end


def runs(data: bytes, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every run of bytes between blanks."""
    hashes, starts, ends = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo, hi in _chunks(data, blank):
        b = np.frombuffer(data, np.uint8, hi - lo, lo)
        edge = np.flatnonzero(np.diff(blank[b], prepend=True, append=True))
        if not edge.size:
            continue
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * _power(_P, len(b)), out=total[1:])
        hashes.append(mix((total[end] - total[start]) * _power(_Q, len(b))[start]))
        starts.append(start.astype(np.int64) + lo)
        ends.append(end.astype(np.int64) + lo)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word, A-Z taken as a-z."""
    return runs(data.lower(), _BLANK)[:2]  # bytes: A-Z only


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; below SIZE words the whole sequence counts as one."""
    joined = b"\n".join(texts)
    hashes, starts = words(joined)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, ends).tolist()
    n = max(0, len(hashes) - SIZE + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(SIZE):
        grams += hashes[k : k + n] * _WEIGHTS[k]
    grams = mix(grams)
    out, at = [], 0
    for end in upto:
        if end - at >= SIZE:
            out.append(np.unique(grams[at : end - SIZE + 1]))
        elif end > at:
            out.append(mix((hashes[at:end] * _WEIGHTS[: end - at]).sum(keepdims=True) + np.uint64(end - at)))
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


class MinHash:
    """`size` min-wise hashes of a set, `bits` of 16 kept from each."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = rng.integers(0, 1 << 63, size, dtype=np.uint64)[:, None]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(values), 2048):
            np.minimum(low, (self.a * values[i : i + 2048] + self.b).min(axis=1), out=low)
        return (mix(low) >> np.uint64(48)).astype(np.uint16)
