"""Word and shingle hashing over whole Arrow batches with numpy.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  Every word gets a
64-bit polynomial fingerprint computed from one running sum over the batch, so
no Python loop touches single words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLOCK = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.empty(_BLOCK + 1, dtype=np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POW = _powers(_BASE)
_INV = _powers(pow(_BASE, -1, 1 << 64))


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each data[start:end]; equal bytes have equal fingerprints."""
    n = len(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    run = np.empty(n + 1, dtype=np.uint64)
    run[0] = 0
    place = np.arange(n, dtype=np.int64)
    vals = (data.astype(np.uint64) + np.uint64(1)) * _POW[place & (_BLOCK - 1)]
    high = n >> 16
    if high:
        vals *= _powers(pow(_BASE, _BLOCK, 1 << 64))[: high + 1][place >> 16]
    np.cumsum(vals, out=run[1:])
    out = (run[ends] - run[starts]) * _INV[starts & (_BLOCK - 1)]
    if high:
        out *= _powers(pow(pow(_BASE, -1, 1 << 64), _BLOCK, 1 << 64))[: high + 1][starts >> 16]
    return mix64(out ^ (ends - starts).astype(np.uint64))


class Words:
    """Words of a batch of texts: hash, first and last byte, and each text's slice."""

    __slots__ = ("raw", "data", "hashes", "starts", "ends", "first")

    def __init__(self, texts: list, lower: bool = False, space: np.ndarray = _SPACE):
        parts = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join(parts)
        data = np.frombuffer(self.raw, dtype=np.uint8)
        if lower:
            data = _LOWER[data]
        inside = np.empty(len(data) + 2, dtype=bool)
        inside[0] = inside[-1] = False
        np.logical_not(space[data], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.data, self.starts, self.ends = data, edges[0::2], edges[1::2]
        self.hashes = _span_hash(data, self.starts, self.ends)
        bounds = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
        self.first = np.searchsorted(self.starts, bounds)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by one space, and where each begins; one more place ends the last."""
        lengths = self.ends - self.starts + 1
        places = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=places[1:])
        padded = np.append(self.data, np.uint8(0x20))
        source = np.repeat(self.starts - places[:-1], lengths) + np.arange(places[-1])
        out = padded[source]
        out[places[1:] - 1] = 0x20
        return out.tobytes(), places


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of `width` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(_BASE) + hashes[k : k + n]
    return mix64(out)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return hashes
    return np.unique(chain(hashes, min(width, len(hashes))) + np.uint64(len(hashes) < width))
