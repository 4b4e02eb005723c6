"""Windows of a sequence grouped by minimiser: consecutive windows that share one form a super-k-mer.

Equal windows have the same minimiser at the same offset, so all copies of a window lie in super-k-mers with the same
key, and a window whose key occurs once in the corpus occurs once itself.  The operators that look for repeated windows
(bytes or words) build on this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsward.llm.common import checkpoint

U = np.uint64
_LOW = 20  # bits of a packed minimum that hold its place in the chunk
#: Windows worked on at once; the symbols of a chunk must stay below 2**_LOW.
CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
#: Bits of a key table: 16 for each key, within these bounds, so that at most 32 MB are broadcast.
TABLE_BITS = (16, 28)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(base), dtype=U)]), dtype=U)


_UP = _powers(_BASE, 1 << _LOW)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), 1 << _LOW)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(32))
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


#: A 64-bit symbol for each byte.
BYTE_SYMBOLS = mixed(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))


def gram_hashes(symbols: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of each run of q symbols."""
    n = len(symbols)
    if n < q:
        return np.empty(0, dtype=U)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(symbols * _UP[:n], out=sums[1:])
        return mixed((sums[q:] - sums[:-q]) * _DOWN[: n - q + 1])


def _minima(values: np.ndarray, span: int) -> np.ndarray:
    have = 1
    while have * 2 <= span:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (span - have)], values[span - have :]) if have < span else values


def chunks(lengths: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences with a window, long ones in overlapping pieces, a chunk at a time: (sequence, offset, symbols) of each piece."""
    of, offset, size, total = [], [], [], 0
    for i in np.flatnonzero(lengths >= window).tolist():
        n = int(lengths[i])
        for at in range(0, n - window + 1, CHUNK):
            piece = min(n - at, CHUNK + window - 1)
            if total and total + piece > 2 * CHUNK:
                yield np.array(of), np.array(offset), np.array(size)
                of, offset, size, total = [], [], [], 0
            of.append(i)
            offset.append(at)
            size.append(piece)
            total += piece
    if of:
        yield np.array(of), np.array(offset), np.array(size)


def super_kmers(symbols: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces whose symbols stand one after another: piece, first window in the piece, windows, key of each super-k-mer."""
    hashes = gram_hashes(symbols, gram)
    places = np.arange(len(hashes), dtype=U)
    least = _minima((hashes >> U(_LOW) << U(_LOW)) | places, window - gram + 1)
    begin = np.cumsum(sizes) - sizes
    cut = np.empty(len(least) + 1, dtype=bool)
    cut[0] = cut[-1] = True
    np.not_equal(least[1:], least[:-1], out=cut[1:-1])
    cut[begin] = True
    cut[begin + sizes - window + 1] = True
    edges = np.flatnonzero(cut)
    start, count = edges[:-1], np.diff(edges)
    piece = np.searchsorted(begin, start, side="right") - 1
    own = start - begin[piece]
    inside = own <= sizes[piece] - window
    start, count, piece, own = start[inside], count[inside], piece[inside], own[inside]
    return piece, own, count, hashes[(least[start] & U((1 << _LOW) - 1)).astype(np.int64)]


def key_table(keys: DataFrame) -> Broadcast:
    """A bit table of the column `key` (distinct longs), broadcast: at most 2**28 bits, whatever the input.

    Keys share bits when there are very many; what looks one up then finds more than is there, and must be exact
    without it.
    """
    spark = keys.sparkSession
    kept = checkpoint(keys.select("key"))
    bits = min(max((16 * kept.count()).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        kept.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, CAST((key & {63}L) AS INT))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    table = np.zeros(1 << bits - 6, dtype=np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return spark.sparkContext.broadcast(table.view(np.uint8))


def looked_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys & U(len(table) * 8 - 1)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]
