"""Words and XXH64 for many strings at once, in NumPy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SHINGLES_AT_ONCE = 1 << 16
_PAD = b"\n" * 8


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for each pair; data holds at least 8 bytes after the last end."""
    buf = np.ascontiguousarray(data)
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    halves = np.ndarray((len(buf) - 3,), "<u4", buf, 0, (1,))
    s = seed & 0xFFFFFFFFFFFFFFFF
    size, pos = ends - starts, starts.copy()
    with np.errstate(over="ignore"):
        h = np.full(len(starts), U(s) + _P5, dtype=U)
        if len(at := np.flatnonzero(size >= 32)):
            acc = [np.full(len(at), x, dtype=U) for x in (U(s) + _P1 + _P2, U(s) + _P2, U(s), U(s) - _P1)]
            stripes = size[at] // 32
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                p = starts[at[on]] + 32 * k
                for j in range(4):
                    acc[j][on] = _round(acc[j][on], lanes[p + 8 * j])
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _round(U(0), a)) * _P1 + _P4
            h[at] = x
            pos[at] += 32 * stripes
        h += size.astype(U)
        rest = ends - pos
        for _ in range(3):
            on = np.flatnonzero(rest >= 8)
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ _round(U(0), lanes[pos[on]]), 27) * _P1 + _P4
            pos[on] += 8
            rest[on] -= 8
        on = np.flatnonzero(rest >= 4)
        h[on] = _rotl(h[on] ^ (halves[pos[on]].astype(U) * _P1), 23) * _P2 + _P3
        pos[on] += 4
        rest[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(rest >= 1)
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ (buf[pos[on]].astype(U) * _P5), 11) * _P1
            pos[on] += 1
            rest[on] -= 1
        h ^= h >> U(33)
        h *= _P2
        h ^= h >> U(29)
        h *= _P3
        h ^= h >> U(32)
    return h


class Words:
    """The words of many texts in one array, one blank or line end between neighbours.

    data: the bytes; starts, ends: of each word; text: the number of each word's text; first: for each text the
    number of its first word, and the total at the end.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + _PAD, dtype=np.uint8)
        space = IS_SPACE[raw]
        keep = ~space
        keep[1:] |= ~space[:-1]
        where = np.cumsum(keep)  # of a byte once runs of spaces are one byte, plus one
        self.data = np.concatenate([raw[keep], np.frombuffer(_PAD, dtype=np.uint8)])
        blank = IS_SPACE[self.data]
        self.data[blank] = 0x20
        self.starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        self.ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        begin = np.where(bounds > 0, where[np.maximum(bounds, 1) - 1], 0)
        self.first = np.append(np.searchsorted(self.starts, begin), len(self.starts))


def shingle_sets(texts: list[bytes], shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of the lower-cased texts, cut as in simhash_many: all hashes, rising within a text; where each text's begin, and the total."""
    words = Words(texts)
    upper = (words.data >= 65) & (words.data <= 90)
    words.data[upper] += 32
    n_words = np.diff(words.first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    of = np.repeat(np.arange(len(texts)), n_shingles)
    first = words.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    last = np.minimum(first + shingle, words.first[of + 1]) - 1
    h = xxh64_many(words.data, words.starts[first], words.ends[last], seed)
    h = h[np.lexsort((h, of))]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.append(0, np.cumsum(np.bincount(of[new], minlength=len(texts))))


def simhash_many(texts: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """Fingerprints of lower-cased texts: shingles of so many words (a shorter text is one), bits set in over half the hashes; 0 without words."""
    words = Words(texts)
    upper = (words.data >= 65) & (words.data <= 90)
    words.data[upper] += 32
    n_words = np.diff(words.first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    total = int(n_shingles.sum())
    of = np.repeat(np.arange(len(texts)), n_shingles)
    begun = np.cumsum(n_shingles) - n_shingles
    for a in range(0, total, _SHINGLES_AT_ONCE):
        text = of[a : a + _SHINGLES_AT_ONCE]
        first = words.first[text] + (np.arange(a, a + len(text)) - begun[text])
        last = np.minimum(first + shingle, words.first[text + 1]) - 1
        h = xxh64_many(words.data, words.starts[first], words.ends[last], seed)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        counts[text[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    on = np.packbits(counts * 2 > n_shingles[:, None], axis=1)
    return on.view(">u8").ravel().astype(U)
