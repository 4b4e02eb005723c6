"""Byte-level BPE with a hierarchical-bitmap queue of merge ranks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StructField, StructType

from obsward.llm.common import map_batches, read, small_parts, utf8

#: Short pre-tokens whose ids a worker keeps, about 150 bytes each.
CACHED_PIECES, CACHED_BYTES = 1_000_000, 48

BIT = [1 << k for k in range(256)]


class Codec:
    """Encodes and decodes by a table of token ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        # the white space of Unicode's property, without the separators 0x1C to 0x1F that \s has here
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.cache = _Pieces(self)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        Pairs of neighbouring parts wait in buckets, one for each merge rank that occurs, as the places of their left
        parts in the linked list (`after`, `before`), leftmost first.  A bitmap in two levels tells which buckets there
        are: find-first-set in the upper word, then in the lower, gives the least rank whatever is queued.  `waiting`
        holds a place's current rank; an entry under another rank is stale and skipped.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        waiting = [-1] * n
        buckets: dict[int, list[int]] = {}
        lower: dict[int, int] = {}
        upper = 0
        pairs = self.pairs
        for at in range(n - 1):
            rank = pairs[piece[at] << 8 | piece[at + 1]]
            if rank >= 0:
                waiting[at] = rank
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
                    word = rank >> 8
                    lower[word] = lower.get(word, 0) | BIT[rank & 255]
                    upper |= 1 << word
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            least = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[least]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[least]
                bits &= bits - 1
                if bits:
                    lower[word] = bits
                else:
                    del lower[word]
                    upper &= upper - 1
            if waiting[at] != least:
                continue
            middle = after[at]
            waiting[middle] = -1
            end = after[at] = after[middle]
            if end < n:
                before[end] = at
            for left, stop in ((at, after[end] if end < n else 0), (before[at], end)):
                if left < 0:
                    continue
                rank = get(piece[left:stop]) if stop else None
                if rank is None:
                    waiting[left] = -1
                    continue
                waiting[left] = rank
                if rank in buckets:
                    heappush(buckets[rank], left)
                else:
                    buckets[rank] = [left]
                    word = rank >> 8
                    lower[word] = lower.get(word, 0) | BIT[rank & 255]
                    upper |= 1 << word
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return ids

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return _unpacked(self.encode_packed(text))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_packed(self, packed: bytes) -> bytes:
        return self.decode(_unpacked(packed))


def _unpacked(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


class _Pieces(dict):
    """Packed ids of the short pre-tokens met so far, emptied when full."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = self.codec.merge(raw)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


_loaded: dict[tuple[str, str], Codec] = {}


def split_pattern() -> str:
    """How the public vocabularies split a text into pre-tokens."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def codec(path: str, pattern: str | None = None) -> Codec:
    """One codec for each vocabulary and worker; by default with the vocabularies' own pattern."""
    pattern = pattern or split_pattern()
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec.load(path, pattern)
    return _loaded[path, pattern]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _added(docs: DataFrame, new: dict[str, DataType], read_from: str, each: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """All columns of docs and the new ones, made from a column in one pass and in small parts.  Columns of docs with the new
    names are replaced, others may have any names."""
    kept = [c for c in docs.columns if c not in new]
    some = docs.select(*[F.col(_quoted(c)) for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_parts(batches, read_from):
            yield pa.RecordBatch.from_arrays([*part.columns, *each(part.column(read_from))], [*kept, *new])

    return some.mapInArrow(run, StructType([*some.schema.fields, *(StructField(k, v) for k, v in new.items())]))


def _packed(own: Codec, texts: pa.Array) -> tuple[list[bytes], list[pa.Array]]:
    packed = [own.encode_packed(t or "") for t in texts.to_pylist()]
    return packed, [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """All columns of docs and `token_ids` (binary, little-endian unsigned 32-bit), `n_tokens`.

    A null or empty text has no tokens; texts of any length are encoded whole.  Rows are independent, repeated ones too:
    nothing is shuffled.  Columns of docs with these two names are replaced, others may have any names.  An empty table
    gives no rows.
    """
    pattern = pattern or split_pattern()
    return _added(docs, {"token_ids": BinaryType(), "n_tokens": LongType()}, "text", lambda texts: _packed(codec(path, pattern), texts)[1])


def decode_documents(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """All columns of encoded and `decoded` (binary) from `token_ids`; null ids decode to nothing."""
    pattern = pattern or split_pattern()

    def each(ids: pa.Array) -> list[pa.Array]:
        own = codec(path, pattern)
        return [pa.array([own.decode_packed(p or b"") for p in ids.to_pylist()], pa.binary())]

    return _added(encoded, {"decoded": BinaryType()}, "token_ids", each)


def encode_and_decode(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """decode_documents of encode_documents, in one pass: a task needs one worker with one codec, and not two in a row."""
    pattern = pattern or split_pattern()

    def each(texts: pa.Array) -> list[pa.Array]:
        own = codec(path, pattern)
        packed, found = _packed(own, texts)
        return [*found, pa.array(map(own.decode_packed, packed), pa.binary())]

    return _added(docs, {"token_ids": BinaryType(), "n_tokens": LongType(), "decoded": BinaryType()}, "text", each)


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: both ways in one pass, so that ids and texts stay in the worker.

    A null text counts as empty and has no tokens.  Texts of any length are encoded whole, as the library would, repeated
    rows each for itself; an empty table gives no rows; other columns are not looked at.
    """
    pattern = pattern or split_pattern()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path, pattern)
        n, ids, texts = [], [], []
        for text in utf8(batch.column("text")):
            packed = own.encode_packed(text.decode())
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            texts.append(hashlib.sha256(own.decode_packed(packed)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the public vocabulary lies; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_trip of documents by the public multilingual vocabulary."""
    return round_trip(read(spark, sf_dir, "documents"), vocabulary())
