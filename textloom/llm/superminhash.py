"""SuperMinHash signatures of word-shingle sets, vectorised over a batch of documents."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; `x` is uint64 and wraps."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of the text, A-Z lower-cased, in order."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh64_intdigest(w)
    out = np.fromiter((memo[w] for w in words), np.uint64, len(words))
    if len(memo) > 50_000:
        memo.clear()
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words, but not none, make one."""
    if not len(words):
        return words
    n = min(k, len(words))
    h = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        h = mix(h * _GOLD + words[i : len(words) - n + 1 + i])
    return np.unique(h)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash (one row of m uint64 per set): each element walks a permutation of the m slots drawn from its own
    random stream and offers `rank + fraction`, which a slot keeps if it is the least so far. A set stops at the first
    rank above the largest it holds, which cannot change the result. Sets are taken together, rank by rank; the
    elements of long sets come in chunks, so memory stays bounded."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((len(sets), m), full, np.uint64)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for lo in range(0, len(elements), CHUNK):
        e, o = elements[lo : lo + CHUNK], owner[lo : lo + CHUNK]
        perm = None
        for j in range(m):
            if j:
                worst = (sig[first : last + 1].max(axis=1) >> np.uint64(53)).astype(np.int64)
                keep = worst[o - first] >= j
                if not keep.any():
                    break
                if not keep.all():
                    e, o, perm = e[keep], o[keep], perm[keep] if perm is not None else None
                    k0 = k0[keep]
                if perm is None:
                    perm = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
                    rows = np.arange(len(e))
                    perm[rows, k0], perm[:, 0] = perm[:, 0].copy(), k0
            step = np.full(1, 2 * j + 1, np.uint64) * _GOLD
            u = mix(e + step)
            k = j + ((mix(e + step + _GOLD) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            if j == 0:
                slot = k0 = k
                first, last = int(o[0]), int(o[-1])
            else:
                rows = np.arange(len(e))
                slot = perm[rows, k].astype(np.int64)
                perm[rows, k] = perm[:, j]
            value = (np.uint64(j) << np.uint64(53)) | (u >> np.uint64(11))
            np.minimum.at(sig.reshape(-1), o * m + slot, value)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One int64 key per band, which also depends on the band's number."""
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    by_band = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    for i in range(rows):
        h = mix(h * _GOLD + by_band[:, :, i])
    return h.view(np.int64)
