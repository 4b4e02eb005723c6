"""Line dedup: repeated runs of lines by distributed prefix doubling over line ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsward.llm.common import checkpoint, join_counted, portions, read, scratch, text_key, utf8
from obsward.llm.hashing import IS_SPACE, xxh64_many
from obsward.llm.superkmer import U, key_table, looked_up

#: Words that a repeated run must hold to be deleted: fewer occur by chance.
MIN_WORDS = 5
#: A document: whether its id is null, the id, two hashes of its text.  In this order documents come.
_DOC = ["none", "id", "h1", "h2"]
_PLACE = [*_DOC, "pos"]


def _id_columns(doc_id: Column) -> list[Column]:
    return [doc_id.isNull().alias("none"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id")]


def line_rows(texts: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: text, number in it, two hashes; and offsets into the last array, which holds for each
    line the lengths of the least windows that begin with it.

    Least windows are, for each line, the shortest run of at least min_words words that begins with it and the shortest
    that ends with it.  A repeated run of so many words is the union of the least windows inside it: a line that the run
    reaches with enough words ends one, any line before begins one together with the run's first line.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n" * 9, dtype=np.uint8)
    n = sum(map(len, texts)) + len(texts)
    ends = np.flatnonzero(data[:n] == 0x0A)
    starts = np.append(0, ends[:-1] + 1)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    first = np.append(0, np.searchsorted(ends, bounds - 1) + 1)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    begun = ~IS_SPACE[data[:n]]
    begun[1:] &= IS_SPACE[data[: n - 1]]
    words = np.append(0, np.cumsum(begun)[ends])  # before each line, and in all
    line = np.arange(len(ends))
    reach = np.searchsorted(words, words[:-1] + min_words, side="left")
    by_begin = reach <= first[of + 1]
    back = np.searchsorted(words, words[1:] - min_words, side="right") - 1
    by_end = (words[1:] >= min_words) & (back >= first[of])
    windows = np.unique(np.concatenate([
        np.stack([line[by_begin], (reach - line)[by_begin]], axis=1),
        np.stack([back[by_end], (line + 1 - back)[by_end]], axis=1),
    ]), axis=0)
    offsets = np.searchsorted(windows[:, 0], np.arange(len(ends) + 1))
    return of, line - first[of], xxh64_many(data, starts, ends, 1), xxh64_many(data, starts, ends, 2), offsets, windows[:, 1]


def _lines(base: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """_PLACE, r1, r2, lens of the lines of base, but for documents whose text an earlier one has.

    A bit table of the first documents of all texts (o) tells them: what isn't in it is a later copy.  A later copy that
    shares its bit with another is worked on like any document, which costs time only.
    """
    firsts = key_table(texts.select(F.xxhash64("o.none", "o.id", "h1", "h2").alias("key")))
    names = [*_PLACE, "r1", "r2", "lens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(looked_up(firsts.value, batch.column("own").to_numpy().view(U))))
            texts = utf8(batch.column("text"))
            for a, b in portions(texts):
                of, pos, r1, r2, offsets, lens = line_rows(texts[a:b], min_words)
                docs = [batch.column(c).take(pa.array(of + a)) for c in _DOC]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lens, pa.int32()))
                yield pa.RecordBatch.from_arrays([*docs, pa.array(pos, pa.int32()), pa.array(r1.view(np.int64)), pa.array(r2.view(np.int64)), lists], names)

    wide = base.withColumn("own", F.xxhash64(*_DOC)).select(*_DOC, "own", "text")
    return scratch(wide.mapInArrow(run, "none boolean, id bigint, h1 bigint, h2 bigint, pos int, r1 bigint, r2 bigint, lens array<int>"))


def _classes(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns of the rows whose keys others share, and later: an earlier place has them too."""
    classes = checkpoint(rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(F.struct(*_PLACE)).alias("first")).where("n_rows > 1"))
    return join_counted(rows, classes, keys, "n_rows").select(*columns, (F.col("first") != F.struct(*_PLACE)).alias("later"))


def later_runs(lines: DataFrame) -> DataFrame:
    """_PLACE, n: the least windows (begin and lines) that begin at an earlier place too.  lines: as _lines() gives them.

    Suffixes of the line-id sequences are ranked by their first 2^k lines from the ranks by 2^(k-1) at a place and 2^(k-1)
    lines on.  Suffixes that share a rank are an interval of the suffix array with a longest common prefix of at least
    2^k; those alone under theirs are settled and leave.  A run of n lines, 2^k <= n < 2^(k+1), is named by the ranks of
    its first and its last 2^k lines, so that its interval is known exactly and not only up to a power of two.  The
    rounds end when no window is open, at the latest with the logarithm of the longest repeated run.  Ranks are names,
    not places in an order, which nothing here needs: no round sorts.
    """
    ranks, length = lines.select(*_PLACE, "r1", "r2", "lens"), 1
    here = scratch(_classes(ranks, ["r1", "r2"], [*_PLACE, "r1", "r2", "lens"]))
    found = [here.where("later AND ARRAY_CONTAINS(lens, 1)").select(*_PLACE, F.lit(1).alias("n"))]
    open_ = scratch(here.select(*_PLACE, F.explode(F.expr("FILTER(lens, n -> n > 1)")).alias("n")))
    here = here.drop("lens")
    while not open_.isEmpty():
        after = here.select(*_DOC, (F.col("pos") - length).alias("pos"), F.col("r1").alias("q1"), F.col("r2").alias("q2"))
        both = [F.xxhash64("r1", "r2", "q1", "q2").alias("r1"), F.xxhash64(F.lit(length), "q2", "r2", "q1", "r1").alias("r2")]
        ranks = scratch(here.join(after, _PLACE).select(*_PLACE, *both))
        length *= 2
        here = scratch(_classes(ranks, ["r1", "r2"], [*_PLACE, "r1", "r2"]))
        begun = scratch(open_.join(here, _PLACE))
        found.append(begun.where(f"later AND n = {length}").select(*_PLACE, "n"))
        last = here.select(*_DOC, F.col("pos").alias("at"), F.col("r1").alias("q1"), F.col("r2").alias("q2"))
        between = begun.where(f"n > {length} AND n < {2 * length}").withColumn("at", F.col("pos") + F.col("n") - length)
        named = scratch(between.join(last, [*_DOC, "at"]).select(*_PLACE, "n", "r1", "r2", "q1", "q2"))
        found.append(_classes(named, ["n", "r1", "r2", "q1", "q2"], [*_PLACE, "n"]).where("later").select(*_PLACE, "n"))
        open_ = begun.where(f"n >= {2 * length}").select(*_PLACE, "n")
    return reduce(DataFrame.unionByName, found)


def delete_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_row (struct of all columns of docs), _kept (text without the deleted lines), _lines, _removed.

    A line goes if it lies in a run of lines with at least `min_words` words together that also begins at an earlier
    place of the corpus, in the same document too: every later copy of a maximal repeated run goes, whatever its length,
    its short and blank lines with it; the first copy stays.  Documents come in the order of doc_id (null last), then of
    a hash of the text.  Of rows equal in id and text, null ids too, one is the first and the others are later copies.
    A null text stays null and has no lines; an empty one has one empty line.  Texts of any length are worked on whole,
    an empty table gives no rows, and columns of docs may have any names.
    """
    text = F.col("text").cast("string")
    base = docs.select(*_id_columns(F.col("doc_id")), *text_key(text), text.alias("text")).where("text IS NOT NULL")
    own = checkpoint(base.select(*_DOC))
    texts = checkpoint(own.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min(F.struct("none", "id")).alias("o")))
    spans = later_runs(_lines(base, texts, min_words)).groupBy(*_DOC).agg(F.collect_list(F.struct("pos", "n")).alias("_spans"))
    again = join_counted(own, texts.where("copies > 1"), ["h1", "h2"], "copies").where("struct(none, id) <> o").select(*_DOC).distinct()
    known = spans.withColumn("_whole", F.lit(False)).unionByName(again.select(*_DOC, F.lit(None).cast(spans.schema["_spans"].dataType).alias("_spans"), F.lit(True).alias("_whole")))
    known = known.groupBy(*_DOC).agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.max("_whole").alias("_whole"))

    wide = docs.select(F.struct("*").alias("_row"), *_id_columns(F.col("doc_id")), *text_key(text))
    number = F.row_number().over(Window.partitionBy(*_DOC).orderBy(F.lit(0)))
    joined = wide.join(known, _DOC, "left").select("_row", F.col("_row.text").cast("string").alias("_text"), "_spans", (F.coalesce("_whole", F.lit(False)) | (number > 1)).alias("_whole"))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, gone = [], [], []
            for text, spans, whole in zip(*(batch.column(c).to_pylist() for c in ("_text", "_spans", "_whole")), strict=True):
                lines = [] if text is None else text.split("\n")
                steps = np.zeros(len(lines) + 1, dtype=np.int32)
                if whole and text is not None and len(text.encode().split()) >= min_words:
                    steps[0] = 1
                for s in spans or ():
                    steps[s["pos"]] += 1
                    steps[s["pos"] + s["n"]] -= 1
                stay = np.cumsum(steps)[:-1] == 0
                kept.append(None if text is None else text if stay.all() else "\n".join(x for x, on in zip(lines, stay.tolist(), strict=True) if on))
                n.append(len(lines))
                gone.append(int((~stay).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["_row", "_kept", "_lines", "_removed"])

    return joined.mapInArrow(delete, wide.select("_row").schema.add("_kept", "string").add("_lines", "long").add("_removed", "long"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, all columns, with repeated lines deleted from text, and n_chars (if there is one) to match."""
    cleaned = delete_repeated_lines(docs, min_words)
    new = {"text": F.col("_kept"), "n_chars": F.char_length("_kept").cast("long")}
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """delete_repeated_lines of documents: doc_id, n_lines, n_removed, kept_sha256 (null for a null text)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return delete_repeated_lines(docs).select(F.col("_row.doc_id").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


#: Maximal runs by brute force: all pairs of equal lines, joined along their diagonals.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
w AS (SELECT doc_id, pos, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM l),
m AS (SELECT b.doc_id, b.pos, b.words, a.doc_id AS other, b.pos - a.pos AS shift
      FROM w a JOIN w b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.pos < b.pos)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY pos) AS run FROM m),
r AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM g GROUP BY doc_id, other, shift, run HAVING sum(words) >= 5),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM r),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_removed,
        coalesce(string_agg(CASE WHEN x.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
"""
