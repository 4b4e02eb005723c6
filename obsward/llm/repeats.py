"""Where windows of a fixed length repeat in a corpus: the part that substring and suffix-array dedup share.

1. Texts: of equal texts one stands for all; what it holds is repeated as a whole.
2. Keys: every text is cut into super-k-mers; the keys that occur twice or more are put into a bit table.
3. Candidates: a second pass packs the super-k-mers whose key is in the table, one string each; where a document says the
   same over and over, equal strings of it are one row with all their places.
4. Buckets: strings travel to their key's bucket, where a judge finds the repeated windows exactly.  A string that
   stands there twice is repeated as a whole and is judged once.
5. A key with too much for one task is dealt over many.  The same judge settles what repeats within a batch, and one
   place of each different window goes on to the next round, cut into super-k-mers anew by longer grams under another
   hash.  Copies so become fewer by the batch, and different windows part, at the latest when the gram is the window.
   Every place is settled in the round that finds it repeated or goes on as its window's only one; the rounds end when
   every key fits a task.  Strings decide throughout, hashes only where they are compared.
6. Spans are gathered by text and joined to the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsward.llm.common import checkpoint, portions, scratch, text_key, utf8
from obsward.llm.hashing import Words, xxh64_many
from obsward.llm.superkmer import BYTE_SYMBOLS, U, chunks, gram_hashes, key_table, looked_up, mixed, runs, super_kmers

#: What the strings of one key may hold at most to be judged in one task: windows and bytes, copies included.
TASK_WINDOWS, TASK_BYTES = 50_000, 1 << 19
#: Bytes of strings judged together, and strings that are at least: a batch must be able to hold copies.
BATCH_BYTES, BATCH_ROWS = 1 << 18, 8

#: For strings (all different), how often each stands, and the window: for each string, which windows stand twice or more, and
#: which places are the only ones picked of their window.
Judge = Callable[[list[bytes], list[int], int], list[tuple[np.ndarray, np.ndarray]]]


class Bytes:
    """Texts as sequences of bytes."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)

    def symbols(self, of: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
        parts = [self.texts[i][a : a + n] for i, a, n in zip(of.tolist(), offset.tolist(), size.tolist(), strict=True)]
        return BYTE_SYMBOLS[np.frombuffer(b"".join(parts), dtype=np.uint8)]

    def packed(self, i: int, a: int, b: int) -> bytes:
        return self.texts[i][a:b]

    @staticmethod
    def cut(packed: bytes, parts: list[tuple[int, int]]) -> list[bytes]:
        return [packed[a:b] for a, b in parts]

    @staticmethod
    def window_hashes(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, window and hash of each window."""
        length = np.array([len(s) for s in strings])
        symbols = BYTE_SYMBOLS[np.frombuffer(b"".join(strings), dtype=np.uint8)]
        begin = np.cumsum(length) - length
        counts = length - window + 1
        string = np.repeat(np.arange(len(strings)), counts)
        own = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begin[string] + own
        return string, own, gram_hashes(symbols, window)[at]


class WordSequences:
    """Texts as sequences of words."""

    def __init__(self, texts: list[bytes]):
        self.words = Words(texts)
        self.lengths = np.diff(self.words.first)
        self.hashes = xxh64_many(self.words.data, self.words.starts, self.words.ends)

    def symbols(self, of: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
        begin = self.words.first[of] + offset
        return np.concatenate([self.hashes[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)])

    def packed(self, i: int, a: int, b: int) -> bytes:
        w = self.words
        return w.data[w.starts[w.first[i] + a] : w.ends[w.first[i] + b - 1]].tobytes()

    @staticmethod
    def cut(packed: bytes, parts: list[tuple[int, int]]) -> list[bytes]:
        words = packed.split(b" ")
        return [b" ".join(words[a:b]) for a, b in parts]


Found = tuple[object, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]


def _found(texts: list[bytes], units: type, window: int, gram: int, turn: int = 0) -> Iterator[Found]:
    """Of portions of the texts: the units; then text, first window, windows, key of each super-k-mer; number of the first text."""
    for a, b in portions(texts):
        own = units(texts[a:b])
        for of, offset, size in chunks(own.lengths, window):
            symbols = own.symbols(of, offset, size)
            piece, start, count, key = super_kmers(mixed(symbols ^ U(turn)) if turn else symbols, size, window, gram)
            yield own, of[piece], start + offset[piece], count, key, a


#: A string and its places: text, first windows, windows, string, and 1, or 2 if the windows are known to be repeated.
#: Without a string (null): repeated windows.
_ROW = "key bigint, h1 bigint, h2 bigint, starts array<int>, n int, packed binary, weight int"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.int32()]
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _different(texts: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """h1, h2, copies of each different text; one row (h1, h2, text, weight) of those that may have copies; and a filter
    of batches that leaves the others.

    A bit table of the copied texts tells them apart: what isn't in it has no copy.
    """
    counts = checkpoint(texts.select("h1", "h2").groupBy("h1", "h2").agg(F.count("*").alias("copies")))
    table = key_table(counts.where("copies > 1").select(F.col("h1").alias("key")).distinct())

    def part(batch: pa.RecordBatch, copied: bool) -> pa.RecordBatch:
        return batch.filter(pa.array(looked_up(table.value, batch.column("h1").to_numpy().view(U)) == copied))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield part(batch, True)

    several = texts.mapInArrow(some, texts.schema).groupBy("h1", "h2").agg(F.first("text").alias("text"), F.least(F.count("*"), F.lit(2)).cast("int").alias("weight"))
    return counts, scratch(several), lambda batch: part(batch, False)


def repeated_spans(texts: DataFrame, units: type, window: int, gram: int, judge: Judge) -> tuple[DataFrame, DataFrame]:
    """h1, h2, spans (array of begins and n: n windows from each of the begins on) of each text with repeated windows;
    and h1, h2, copies of each text.

    texts: h1, h2, text.
    """
    counts, several, singles = _different(texts)

    def keys_of(found: Iterator[Found]) -> Iterator[pa.RecordBatch]:
        for *_, key, _ in found:
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    def single_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from keys_of(_found(utf8(singles(batch).column("text")), units, window, gram))

    def several_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from keys_of(_found(utf8(batch.column("text")), units, window, gram))

    keys = texts.mapInArrow(single_keys, "key bigint").unionByName(several.select("text").mapInArrow(several_keys, "key bigint"))
    repeated = key_table(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))

    def packed(batch: pa.RecordBatch, weights: list[int]) -> Iterator[pa.RecordBatch]:
        """Whole texts that are known to be repeated, and the super-k-mers whose key is in the table."""
        h1, h2 = (batch.column(c).to_pylist() for c in ("h1", "h2"))
        for own, of, start, count, key, base in _found(utf8(batch.column("text")), units, window, gram):
            on = np.flatnonzero(looked_up(repeated.value, key))
            some: dict[tuple[int, bytes], tuple[int, int, list[int]]] = {}
            for i, at, n, k in zip(of[on].tolist(), start[on].tolist(), count[on].tolist(), key[on].view(np.int64).tolist(), strict=True):
                some.setdefault((i, own.packed(i, at, at + n + window - 1)), (k, n, []))[2].append(at)
            if some:
                yield _batch([(k, h1[i + base], h2[i + base], at, n, s, weights[i + base]) for (i, s), (k, n, at) in some.items()])

    def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = singles(batch)
            yield from packed(batch, [1] * batch.num_rows)

    def several_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = batch.column("weight").to_pylist()
            yield from packed(batch, weights)
            lengths = units(utf8(batch.column("text"))).lengths.tolist() if batch.num_rows else []
            whole = [(0, a, b, [0], n - window + 1, None, 2) for a, b, n, w in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2")), lengths, weights, strict=True) if w > 1 and n >= window]
            if whole:
                yield _batch(whole)

    rows = scratch(texts.mapInArrow(single_rows, _ROW).unionByName(several.mapInArrow(several_rows, _ROW)))
    spans = [rows.where("packed IS NULL")]
    found, turn = rows.where("packed IS NOT NULL"), 0
    while True:
        out, again = _round(found, units, judge, window)
        spans.append(out.where("packed IS NULL"))
        if not again:
            break
        turn += 1
        found = scratch(_cut_anew(out.where("packed IS NOT NULL"), units, window, min(window, gram * (turn + 1)), turn))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return every.groupBy("h1", "h2").agg(F.collect_list(F.struct(F.col("starts").alias("begins"), "n")).alias("spans")), counts


def _round(found: DataFrame, units: type, judge: Judge, window: int) -> tuple[DataFrame, bool]:
    """Repeated windows and, of the keys with too much for a task, the places that go on; and whether there are such keys."""
    much = (F.sum(F.col("n").cast("long") * F.size("starts")) > TASK_WINDOWS) | (F.sum(F.length("packed")) > TASK_BYTES)
    keys = checkpoint(found.groupBy("key").agg((much & (F.count("*") > BATCH_ROWS)).alias("much")).where("much").select("key"))
    hot = key_table(keys)

    def parted(is_hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(looked_up(hot.value, batch.column("key").to_numpy().view(U)) == is_hot))

        return run

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches(batches, True):
            if some := _judged(held, units, judge, window, False):
                yield _batch(some)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches(batches, False):
            if some := _judged(held, units, judge, window, True):
                yield _batch(some)

    again = not keys.isEmpty()
    cold = found.mapInArrow(parted(False), _ROW) if again else found
    out = cold.repartition("key").sortWithinPartitions("key").mapInArrow(settled, _ROW)
    if not again:
        return out, False
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.mapInArrow(parted(True), _ROW).withColumn("deal", F.pmod(F.xxhash64("h1", "h2", F.element_at("starts", 1)), F.lit(parts)))
    over = dealt.repartition("key", "deal").sortWithinPartitions("key").drop("deal").mapInArrow(reduced, _ROW)
    return scratch(out.unionByName(over)), True


def _cut_anew(rows: DataFrame, units: type, window: int, gram: int, turn: int) -> DataFrame:
    """The strings of rows in shorter super-k-mers, by grams of another length under another hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, starts, weight = (batch.column(c).to_pylist() for c in ("h1", "h2", "starts", "weight"))
            for own, of, start, count, key, base in _found(utf8(batch.column("packed")), units, window, gram, turn):
                where = zip(of.tolist(), start.tolist(), count.tolist(), key.view(np.int64).tolist(), strict=True)
                yield _batch([(k, h1[i + base], h2[i + base], [starts[i + base][0] + a], n, own.packed(i, a, a + n + window - 1), weight[i + base]) for i, a, n, k in where])

    return rows.mapInArrow(run, _ROW)


def _batches(batches: Iterator[pa.RecordBatch], whole_keys: bool) -> Iterator[list[tuple]]:
    """Rows of about BATCH_BYTES, at least BATCH_ROWS, from batches ordered by key; keys are not cut, or cut anywhere."""
    held: list[tuple] = []
    size, last, begin = 0, None, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            if row[0] != last:
                if whole_keys and len(held) - begin == 1 and len(held[-1][3]) == 1:  # alone: its key was only taken for a repeated one
                    size -= len(held.pop()[5])
                last, begin = row[0], len(held)
            if size >= BATCH_BYTES and (begin == len(held) if whole_keys else len(held) >= BATCH_ROWS):
                yield held
                held, size, begin = [], 0, 0
            held.append(row)
            size += len(row[5])
    if held:
        yield held


def _judged(rows: list[tuple], units: type, judge: Judge, window: int, go_on: bool) -> list[tuple]:
    """Repeated windows of the rows; with go_on also one place of each different window, weight 2 where it's settled."""
    places: dict[bytes, list[tuple]] = {}
    by_key: dict[int, int] = {}
    for row in rows:
        if row[5] in places:
            places[row[5]].append(row)
        else:
            places[row[5]] = [row]
            by_key[row[0]] = by_key.get(row[0], 0) + 1
    copies = {s: sum(max(row[6], len(row[3])) for row in x) for s, x in places.items()}
    single = {x[0][0] for s, x in places.items() if copies[s] == 1}
    strings = [s for s, x in places.items() if go_on or by_key[x[0][0]] > 1 and x[0][0] in single]
    out: list[tuple] = []
    for s, x in places.items():
        if copies[s] > 1:
            out += [(0, row[1], row[2], row[3], row[4], None, 2) for row in x if row[6] == 1]
    for s, (flags, picked) in zip(strings, judge(strings, [copies[s] for s in strings], window), strict=True):
        _, h1, h2, starts, _, _, _ = places[s][0]
        if copies[s] == 1:
            out += [(0, h1, h2, [starts[0] + a], b - a, None, 2) for a, b in zip(*(e.tolist() for e in runs(flags)), strict=True)]
        if go_on:
            for weight, kind in ((2, picked & flags), (1, picked & ~flags)):
                places_ = list(zip(*(e.tolist() for e in runs(kind)), strict=True))
                strings_ = units.cut(s, [(a, b + window - 1) for a, b in places_])
                out += [(0, h1, h2, [starts[0] + a], b - a, part, weight) for (a, b), part in zip(places_, strings_, strict=True)]
    return out


def with_spans(docs: DataFrame, units: type, window: int, gram: int, judge: Judge) -> DataFrame:
    """doc_id, text, spans, whole: one row for each document; spans is null without repeated windows, whole: all are.

    The texts with the most copies, over a thousandth of all documents, are fewer than a thousand; they are broadcast
    instead of joined by shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", "text", *text_key(F.col("text")))
    spans, counts = repeated_spans(keyed.select("h1", "h2", "text"), units, window, gram, judge)
    total = counts.agg(F.sum("copies")).first()[0] or 0
    heavy = F.broadcast(counts.where((F.col("copies") > 1) & (F.col("copies") * 1000 > total)).select("h1", "h2"))
    joined = keyed.join(heavy, ["h1", "h2"], "left_anti").join(spans, ["h1", "h2"], "left").select("doc_id", "text", "spans", F.lit(False).alias("whole"))
    return joined.unionByName(keyed.join(heavy, ["h1", "h2"], "left_semi").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(True).alias("whole")))


def covered(spans: list[dict] | None, whole: bool, n: int, window: int) -> np.ndarray | None:
    """Which of n units lie in a window that begins in one of the spans, or in any window; None: none."""
    if whole:
        return np.ones(n, dtype=bool) if n >= window else None
    if not spans:
        return None
    steps = np.zeros(n + 1, dtype=np.int32)
    for s in spans:
        begins = np.array(s["begins"])
        np.add.at(steps, begins, 1)
        np.add.at(steps, begins + s["n"] + window - 1, -1)
    return np.cumsum(steps)[:n] > 0
