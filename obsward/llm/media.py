"""Media payloads in content-defined chunks: stored once each, read back by joins and verified."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsward.llm.common import join_counted, portions, read, scratch, text_key, utf8
from obsward.llm.superkmer import BYTE_SYMBOLS, U, key_table, looked_up

UNIT = 64
#: Chunk sizes in bytes; a cut is where the low bits of the gear hash over the last 32 bytes are zero.
LEAST, MASK, MOST = 256, 1023, 8192
_GEAR = (BYTE_SYMBOLS & U(0xFFFFFFFF)).astype(np.uint32)
_HEAD, _ENTRY, _MAGIC = Struct("<4sIQ"), Struct("<I?32s"), b"CDC2"


def padded(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def cut_points(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload."""
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    gear = _GEAR[data]
    span = 1
    while span < 32:
        longer = gear.copy()
        longer[span:] += gear[:-span] << np.uint32(span)
        gear, span = longer, span * 2
    at = np.flatnonzero((gear & np.uint32(MASK)) == 0) + 1
    begins = np.cumsum([0, *(len(p) for p in payloads)])
    low = np.searchsorted(at, begins)
    out = []
    for i, payload in enumerate(payloads):
        n, last, ends = len(payload), 0, []
        for c in (at[low[i] : low[i + 1]] - begins[i]).tolist():
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST and c < n:
                ends.append(c)
                last = c
        while n - last > MOST:
            last += MOST
            ends.append(last)
        if n > last:
            ends.append(n)
        out.append(ends)
    return out


def _chunked(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """For each text its number, its chunks and their digests."""
    for a, b in portions(texts):
        payloads = [padded(t) for t in texts[a:b]]
        for i, (payload, ends) in enumerate(zip(payloads, cut_points(payloads), strict=True)):
            chunks = [payload[x:y] for x, y in zip([0, *ends], ends)]  # noqa: B905
            yield a + i, chunks, [hashlib.sha256(c).digest() for c in chunks]


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=np.int64)


@dataclass
class MediaStore:
    """packs: doc_id, h1, h2, media, shared, bare; chunks: digest, bytes of the chunks that several rows have, each once.

    media is a row's stored form: header, ordered chunk list (size, whether the chunk table has it, SHA-256), then the
    bytes of the chunks that it alone has.  shared: some of its chunks are in the chunk table; bare: all are.
    """

    packs: DataFrame
    chunks: DataFrame


_PACK = "doc_id bigint, h1 bigint, h2 bigint, media binary, shared boolean, bare boolean"


def store(docs: DataFrame) -> MediaStore:
    """Write the payloads of all rows of docs (null text: empty) to the shared folder.

    Digests are counted first.  Chunks met once stay in their document's pack, written as it is scanned; only chunks
    met again are shuffled, deduplicated by digest and written to the chunk table.  A bit table of bounded size tells
    the two apart; a chunk it takes for repeated by mistake is stored in the chunk table just as well.  Equal texts have
    equal stored forms; which chunks these hold themselves depends on the other rows.  Rows that repeat are stored as often;
    texts may be of any length, an empty table makes an empty store, other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", *text_key(F.col("text")), "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_keys(d) for _, _, d in _chunked(utf8(batch.column("text")))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["key"])

    again = key_table(rows.select("text").mapInArrow(digests, "key bigint").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some: dict[bytes, bytes] = {}
            for _, chunks, names in _chunked(utf8(batch.column("text"))):
                for k in np.flatnonzero(looked_up(again.value, _keys(names).view(U))).tolist():
                    some[names[k]] = chunks[k]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.binary()), pa.array(list(some.values()), pa.binary())], ["digest", "bytes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            media, shared, bare = [], [], []
            for i, chunks, names in _chunked(texts):
                elsewhere = looked_up(again.value, _keys(names).view(U)).tolist()
                media.append(_media(len(texts[i]), chunks, names, elsewhere))
                shared.append(any(elsewhere))
                bare.append(all(elsewhere))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(media, pa.binary()), pa.array(shared), pa.array(bare)], ["doc_id", "h1", "h2", "media", "shared", "bare"])

    chunks = scratch(rows.select("text").mapInArrow(common, "digest binary, bytes binary").distinct())
    return MediaStore(scratch(keyed.mapInArrow(pack, _PACK)), chunks)


def _media(n_bytes: int, chunks: list[bytes], digests: list[bytes], elsewhere: list[bool]) -> bytes:
    """Header, the ordered chunk list, and the chunks that the chunk table doesn't have."""
    entries = (_ENTRY.pack(len(c), e, d) for c, d, e in zip(chunks, digests, elsewhere, strict=True))
    return _HEAD.pack(_MAGIC, len(chunks), n_bytes) + b"".join(entries) + b"".join(c for c, e in zip(chunks, elsewhere, strict=True) if not e)


def _parsed(media: bytes) -> tuple[int, list[tuple[int, bool, bytes]], int]:
    """Bytes before padding, the chunk list, and where the chunks begin."""
    magic, count, n_bytes = _HEAD.unpack_from(media)
    if magic != _MAGIC:
        raise ValueError("not a stored payload")
    end = _HEAD.size + count * _ENTRY.size
    return n_bytes, list(_ENTRY.iter_unpack(media[_HEAD.size : end])), end


def _read(media: bytes, others: dict[int, bytes]) -> tuple[int, bytes, bytes, int]:
    """Bytes before padding, payload, stored form and chunk count; every chunk is held against its digest."""
    n_bytes, entries, at = _parsed(media)
    parts = []
    for k, (size, away, digest) in enumerate(entries):
        if away:
            part = others[k]
        else:
            part = media[at : at + size]
            at += size
        if len(part) != size or hashlib.sha256(part).digest() != digest:
            raise ValueError("a stored chunk doesn't match its digest")
        parts.append(part)
    payload = b"".join(parts)
    if len(payload) < n_bytes or at != len(media):
        raise ValueError("a stored payload is incomplete")
    return n_bytes, payload, media, len(parts)


def features(payload: bytes, n_chunks: int) -> str:
    """Of the payload as unsigned 8-bit samples: chunks, sum, sum of squares, crossings of the middle, least, greatest."""
    x = np.frombuffer(payload, dtype=np.uint8)
    high = x >= 128
    wide = x.astype(np.int64)
    return f"{n_chunks}:{wide.sum()}:{(wide * wide).sum()}:{np.count_nonzero(high[1:] != high[:-1])}:{x.min()}:{x.max()}"


_FOUND = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _described(rows: list[tuple[int, bytes, bytes, int]], lead: list[pa.Array], names: list[str], with_payload: bool) -> pa.RecordBatch:
    """rows: as _read() gives them."""
    n_bytes, payloads, media, n_chunks = zip(*rows, strict=True)
    columns = [
        pa.array(n_bytes, pa.int64()),
        pa.array([len(p) for p in payloads], pa.int64()),
        pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
        pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()),
        pa.array([len(m) for m in media], pa.int64()),
        pa.array([hashlib.sha256(m).hexdigest() for m in media]),
        pa.array([features(p, n) for p, n in zip(payloads, n_chunks, strict=True)]),
    ]
    if with_payload:
        columns.append(pa.array(payloads, pa.binary()))
    return pa.RecordBatch.from_arrays([*lead, *columns], names)


def load(store: MediaStore, with_payload: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload and media digests and features (and the payload) of every stored row.

    Packs that hold all their chunks are read as they stand.  For the rest, the chunk lists of different texts are
    joined to the chunk table by digest, and each text's chunks come together in order, one text at a time.  Chunks and
    texts that very many rows have are broadcast instead (fewer than a thousand chunks, or rows of digests).
    """
    names = [f.split()[0] for f in _FOUND.split(", ")] + ["payload"] * with_payload
    schema = _FOUND + ", payload binary" * with_payload

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [_read(media, {}) for media in part.column("media").to_pylist()]
                yield _described(rows, [part.column("doc_id")], ["doc_id", *names], with_payload)

    alone = store.packs.where("NOT shared").select("doc_id", "media").mapInArrow(whole, "doc_id bigint, " + schema)

    mixed = store.packs.where("shared")
    # equal texts share all their chunks: only packs without bytes of their own can come twice
    lists = mixed.where("NOT bare").select("h1", "h2", "media").unionByName(mixed.where("bare").select("h1", "h2", "media").distinct())

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for h1, h2, media in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "media")), strict=True):
                for k, (_, away, digest) in enumerate(_parsed(media)[1]):
                    if away:
                        for column, x in zip(out, (h1, h2, k, digest), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["h1", "h2", "place", "digest"])

    references = scratch(lists.mapInArrow(refer, "h1 bigint, h2 bigint, place int, digest binary"))
    uses = references.groupBy("digest").agg(F.count("*").alias("uses"))
    fetched = join_counted(references, store.chunks.join(uses, "digest"), ["digest"], "uses").select("h1", "h2", "place", "bytes")
    rows = fetched.unionByName(lists.select("h1", "h2", F.lit(-1).alias("place"), F.col("media").alias("bytes")))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        media = b""
        others: dict[int, bytes] = {}

        def finish() -> Iterator[pa.RecordBatch]:
            if key is not None:
                yield _described([_read(media, others)], [pa.array([k], pa.int64()) for k in key], ["h1", "h2", *names], with_payload)

        for batch in batches:
            for h1, h2, place, part in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "place", "bytes")), strict=True):
                if (h1, h2) != key:
                    yield from finish()
                    key, others = (h1, h2), {}
                if place < 0:
                    media = part
                else:
                    others[place] = part
        yield from finish()

    together = rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "place").mapInArrow(assemble, "h1 bigint, h2 bigint, " + schema)
    own = mixed.select("doc_id", "h1", "h2")
    if with_payload:
        rest = own.join(together, ["h1", "h2"])
    else:
        copies = own.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
        rest = join_counted(own, scratch(together.join(copies, ["h1", "h2"])), ["h1", "h2"], "copies").drop("copies")
    return alone.unionByName(rest.drop("h1", "h2").select("doc_id", *names))


def op6_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of documents stored, read back and described."""
    return load(store(read(spark, sf_dir, "documents")))
