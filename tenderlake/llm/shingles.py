"""Word shingles of texts as 64-bit hashes, computed over whole byte arrays with numpy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

SHINGLE = 5
CHUNK = 1 << 21
_rng = np.random.Generator(np.random.PCG64(20240117))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
for _b in range(65, 91):  # A-Z as a-z
    BYTE[_b] = BYTE[_b + 32]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64) - 1, BASE, np.uint64))])
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_hashes(data: np.ndarray) -> np.ndarray:
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    kept = np.flatnonzero(~blank)
    place = np.arange(len(kept)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sums = np.add.reduceat(BYTE[data[kept]] * powers(int(sizes.max()))[place], np.cumsum(sizes) - sizes)
    return mixed(sums + sizes.astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word, A-Z taken as a-z; long texts are worked on in pieces cut at blanks."""
    if len(data) <= CHUNK:
        return _chunk_hashes(np.frombuffer(data, np.uint8))
    out, at = [], 0
    while at < len(data):
        to = at + CHUNK
        while to < len(data) and data[to] not in b" \n\t\r\x0b\x0c":
            to += 1
        out.append(_chunk_hashes(np.frombuffer(data, np.uint8, min(to, len(data)) - at, at)))
        at = to
    return np.concatenate(out)


def _windows(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a run of words."""
    x = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    for i in range(k):
        x = (x + w[i : len(x) + i]) * STEP
    return mixed(x)


def _short(w: np.ndarray) -> np.ndarray:
    x = np.full(1, len(w), np.uint64) * BASE
    for v in w:
        x = (x + v) * STEP
    return mixed(x)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: list[bytes], k: int = SHINGLE):
    """For each text, the sorted distinct hashes of its k-word shingles; fewer words are one shingle; none, an empty set.

    Texts are joined and hashed some at a time; windows that reach over a text's end are left out.
    """
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < CHUNK // 4:
            size += len(texts[to]) + 1
            to += 1
        part = texts[at:to]
        at = to
        data = b" ".join(part)
        w = word_hashes(data)
        if len(part) == 1:
            counts = [len(w)]
        else:
            blank = SPACE[np.frombuffer(data, np.uint8)]
            first = np.flatnonzero(np.concatenate([[True], blank[:-1]]) & ~blank)
            ends = np.cumsum([len(t) + 1 for t in part])
            counts = np.diff(np.concatenate([[0], np.searchsorted(first, ends)])).tolist()
        x = _windows(w, k)
        a = 0
        for n in counts:
            yield distinct(x[a : a + n - k + 1]) if n >= k else _short(w[a : a + n]) if n else w[:0]
            a += n


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
