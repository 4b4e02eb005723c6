"""Quality and toxicity of documents: a classifier's evidence combined with what is known of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsward.llm.common import checkpoint, join_counted, portions, read, scratch, utf8
from obsward.llm.hashing import Words, xxh64_many

U = np.uint64
#: Labelled documents that the classifier is fitted on, the first in the order of their ids' hashes.
FITTED_ON = 8_000
#: Different words and beginnings of a labelled text that the lexicon is drawn from (in fitting only; scoring looks at all).
SAMPLED_WORDS = 20_000
#: Bytes of a word's beginning that are a feature beside the whole word.
PREFIX = 5
#: Documents a word must mark, and how many times more often it must stand in them, to enter the lexicon; its size.
LEAST_DOCS, LEAST_RATIO, LEXICON = 3, 8.0, 4_000
_SYMBOLS = b"|!%&$#*@<>{}=_~^\\/;:()[]\"'-+.,?"
_LETTER_CASE = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"\n", b"\xc3"]
_CLASSES = [bytes([c]) for c in _SYMBOLS] + _LETTER_CASE
_CLASS_OF = np.zeros(256, dtype=np.int64)
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[np.frombuffer(_members, dtype=np.uint8)] = _k + 1


def _words(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Lower-cased words, the hash of each and of its beginning; punctuation at a word's end is not part of it."""
    words = Words([t.lower() for t in texts])
    ends = words.ends.copy()
    for _ in range(4):
        last = words.data[ends - 1]
        ends -= (ends - words.starts > 1) & (last < 128) & ~((last >= 97) & (last <= 122)) & ~((last >= 48) & (last <= 57))
    whole = xxh64_many(words.data, words.starts, ends, 7)
    begun = xxh64_many(words.data, words.starts, np.minimum(ends, words.starts + PREFIX), 8)
    return words, whole, begun


def shapes(texts: list[bytes], words: Words, whole: np.ndarray) -> np.ndarray:
    """A row of features of the writing for each text: shares of symbols and cases, repetition, lengths."""
    n = np.diff(words.first)
    out = np.zeros((len(texts), len(_CLASSES) + 6))
    size = np.array([len(t) for t in texts], dtype=np.int64)
    classes = _CLASS_OF[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    of = np.repeat(np.arange(len(texts)), size)
    width = len(_CLASSES) + 1
    counts = np.bincount(of * width + classes, minlength=len(texts) * width).reshape(len(texts), width)[:, 1:]
    some = np.maximum(n, 1)
    out[:, : len(_CLASSES)] = np.log1p(20 * counts / some[:, None])
    of_word = np.repeat(np.arange(len(texts)), n)
    same = np.zeros(len(whole), dtype=bool)
    same[1:] = (whole[1:] == whole[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((whole, of_word))
    first = np.ones(len(whole), dtype=bool)
    first[1:] = (whole[order][1:] != whole[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    k = len(_CLASSES)
    out[:, k] = np.bincount(of_word, same, len(texts)) / some
    out[:, k + 1] = np.bincount(of_word[order], first, len(texts)) / some
    out[:, k + 2] = np.log1p(n)
    out[:, k + 3] = np.bincount(of_word, words.ends - words.starts, len(texts)) / some
    out[:, k + 4] = np.log1p(counts[:, _CLASSES.index(b"\n")]) - np.log1p(n)
    out[:, k + 5] = n == 0
    return out


@dataclass
class Model:
    """Standardised linear model of good writing, and a lexicon of words that mark toxic documents."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    lexicon: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=U))
    lexicon_weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    slope: float = 0.0
    intercept: float = -4.0

    def evidence(self, words: Words, hashes: list[np.ndarray]) -> np.ndarray:
        """For each text the sum of the weights of the lexicon's words and beginnings in it, each once."""
        n = len(words.first) - 1
        out = np.zeros(n)
        if len(self.lexicon):
            of_word = np.repeat(np.arange(n), np.diff(words.first)).astype(U)
            for h in hashes:
                at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
                on = np.flatnonzero(self.lexicon[at] == h)
                text, place = np.unique(np.stack([of_word[on], at[on].astype(U)]), axis=1).astype(np.int64)
                np.add.at(out, text, self.lexicon_weights[place])
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good writing and of toxicity."""
        words, whole, begun = _words(texts)
        x = (shapes(texts, words, whole) - self.mean) / self.scale
        good = np.clip(x, -10, 10) @ self.weights[1:] + self.weights[0]
        bad = self.slope * self.evidence(words, [whole, begun]) + self.intercept
        return np.clip(good, -12, 12), np.clip(bad, -12, 12)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, intercept first, by Newton steps on the penalised likelihood."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sampled_labels(labels: DataFrame, most: int = FITTED_ON) -> DataFrame:
    """doc_id, quality, toxic of at most so many labelled documents, the first in the order of their ids' hashes.  Labels
    that contradict each other: the worse holds.  Labels with a null in them don't count."""
    sure = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return sure.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on documents with labels (as sampled_labels() gives them, so at most FITTED_ON).  The driver receives their
    features; of the words of one text at most SAMPLED_WORDS different ones, the first in the order of their hashes.

    Without labels, or with labels of one kind only, the part concerned is neutral: nothing is rejected for it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in portions(texts):
                words, whole, begun = _words(texts[a:b])
                shape = shapes(texts[a:b], words, whole)
                cut = words.first.tolist()
                ids = [np.unique(np.concatenate([whole[i:j], begun[i:j]]))[:SAMPLED_WORDS].view(np.int64) for i, j in zip(cut, cut[1:])]  # noqa: B905
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(shape.tolist(), pa.list_(pa.float64())), pa.array([x.tolist() for x in ids], pa.list_(pa.int64())), part.column("quality").cast(pa.int32()), part.column("toxic").cast(pa.int32())], ["shape", "ids", "quality", "toxic"])

    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id").select("text", "quality", "toxic")
    got = known.mapInArrow(rows, "shape array<double>, ids array<bigint>, quality int, toxic int").toArrow()
    width = len(_CLASSES) + 6
    if got.num_rows == 0:
        return Model(np.zeros(width), np.ones(width), np.concatenate([[4.0], np.zeros(width)]))
    x = np.array(got.column("shape").to_pylist())
    good, toxic = got.column("quality").to_numpy() > 0, got.column("toxic").to_numpy() > 0
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    weights = np.concatenate([[4.0 if good.any() else -4.0], np.zeros(width)])
    if good.any() and not good.all():
        weights = _logistic(np.clip((x - mean) / scale, -10, 10), good.astype(float))
    model = Model(mean, scale, weights)
    if toxic.any() and not toxic.all():
        ids = got.column("ids").combine_chunks()
        size = np.diff(ids.offsets.to_numpy())
        mark = np.repeat(toxic, size)
        values = ids.values.to_numpy().view(U)
        names, n = np.unique(values, return_counts=True)
        marked, counts = np.unique(values[mark], return_counts=True)
        a = np.zeros(len(names), dtype=np.int64)
        a[np.searchsorted(names, marked)] = counts
        b = n - a
        n1, n0 = toxic.sum(), (~toxic).sum()
        ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
        # by Chernoff's bound no word gets in by chance: exp(-n KL) against the number of words tried
        share = n1 / (n0 + n1)
        f = np.clip(a / n, 1e-12, 1 - 1e-12)
        surprise = n * (f * np.log(f / share) + (1 - f) * np.log((1 - f) / (1 - share)))
        on = np.flatnonzero((a >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (surprise > np.log((n >= LEAST_DOCS).sum() + 1) + 2))
        on = np.sort(on[np.argsort(-ratio[on], kind="stable")[:LEXICON]])
        model.lexicon, model.lexicon_weights = names[on], np.log(ratio[on])
        have = np.zeros(len(toxic))
        if len(on):
            at = np.minimum(np.searchsorted(model.lexicon, values), len(on) - 1)
            hits = model.lexicon[at] == values
            np.add.at(have, np.repeat(np.arange(len(toxic)), size)[hits], model.lexicon_weights[at[hits]])
        intercept, slope = _logistic(have[:, None], toxic.astype(float), 1e-2)
        model.slope, model.intercept = float(slope), float(intercept)
    return model


def scored(docs: DataFrame, model: Model, host: Column, path: Column, kept: list[str] | None = None) -> DataFrame:
    """_row (struct of the kept columns of docs, all by default), _id, _host, _path, _good, _toxic (log odds from the text alone)."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if kept is None else kept)]).alias("_row")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    wide = docs.select(row, F.col("doc_id").cast("long").alias("_id"), text(F.col("text")).alias("_text"), text(host).alias("_host"), text(path).alias("_path"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("_text"))
            parts = [shared.value.score(texts[a:b]) for a, b in portions(texts, 1 << 19)]
            if parts:
                good, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_id", "_host", "_path")), pa.array(good), pa.array(toxic)], ["_row", "_id", "_host", "_path", "_good", "_toxic"])

    schema = wide.select("_row", "_id", "_host", "_path").schema.add("_good", "double").add("_toxic", "double")
    return wide.mapInArrow(run, schema)


KINDS = ("good", "toxic")


def with_counts(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """scores with count_good, count_toxic, what a document adds to its site's counts: its label where it has one (labels:
    as sampled_labels() gives them, so few), else the classifier's probability."""
    known = labels.select(F.col("doc_id").alias("_id"), (F.col("quality") > 0).cast("double").alias("known_good"), (F.col("toxic") > 0).cast("double").alias("known_toxic"))
    counts = [F.coalesce(f"known_{k}", 1 / (1 + F.exp(-F.col(f"_{k}")))).alias(f"count_{k}") for k in KINDS]
    return scores.join(F.broadcast(known), "_id", "left").select(*scores.columns, *counts)


@dataclass(frozen=True)
class Prior:
    """Shares of all documents, and how many documents a prior is worth at hosts and at paths, by kind."""

    share: dict[str, float]
    at_host: dict[str, float]
    at_path: dict[str, float]


def site_counts(scores: DataFrame) -> tuple[DataFrame, Prior]:
    """_host, _path, n, good, toxic, hn, h_good, h_toxic: expected counts of each path and of its host; and the priors.

    The strength of a prior is the number of documents it is worth, by the method of moments: p(1 - p) within against
    the variance between sites, held between 5 and 1000.
    """
    paths = checkpoint(scores.groupBy("_host", "_path").agg(F.count("*").alias("n"), *[F.sum(f"count_{k}").alias(k) for k in KINDS]))
    hosts = checkpoint(paths.groupBy("_host").agg(F.count("*").alias("n_paths"), F.sum("n").alias("hn"), *[F.sum(k).alias(f"h_{k}") for k in KINDS]))

    def prior(sites: DataFrame, n: str, prefix: str) -> tuple[dict[str, float], dict[str, float]]:
        names = [prefix + k for k in KINDS]
        row = sites.agg(F.sum(n).alias("n"), *[F.sum(x).alias(x) for x in names], *[F.sum(F.col(x) * F.col(x) / F.col(n)).alias(f"s_{x}") for x in names], F.count("*").alias("sites")).first()
        share, worth = dict.fromkeys(KINDS, 0.5), dict.fromkeys(KINDS, 5.0)
        for k, x in zip(KINDS, names, strict=True):
            if row["n"]:
                share[k] = min(max(row[x] / row["n"], 1e-4), 1 - 1e-4)
                within = share[k] * (1 - share[k])
                between = max(row[f"s_{x}"] / row["n"] - share[k] ** 2 - row["sites"] * within / row["n"], 1e-9)
                worth[k] = min(max(within / between - 1, 5.0), 1000.0)
        return share, worth

    share, at_host = prior(hosts, "hn", "h_")
    return checkpoint(join_counted(paths, hosts, ["_host"], "n_paths").drop("n_paths")), Prior(share, at_host, prior(paths, "n", "")[1])


def _posterior(kind: str, prior: Prior) -> Column:
    """Probability from the document's log odds and how far its site's posterior log odds lie from the global share's.

    The document itself is left out of the site's counts, so its text counts once.  A host's share is shrunk toward the
    global share, a path's toward its host's posterior; sites with few other documents keep near their parents.
    """
    own, share = F.col(f"count_{kind}"), prior.share[kind]
    host = (prior.at_host[kind] * share + F.col(f"h_{kind}") - own) / (prior.at_host[kind] + F.col("hn") - 1)
    path = (prior.at_path[kind] * host + F.col(kind) - own) / (prior.at_path[kind] + F.col("n") - 1)
    path = F.least(F.greatest(path, F.lit(1e-4)), F.lit(1 - 1e-4))
    return 1 / (1 + F.exp(-F.col(f"_{kind}") - F.log(path / (1 - path)) + float(np.log(share / (1 - share)))))


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, kept: list[str] | None = None) -> DataFrame:
    """_row (the kept columns, all by default), _host, _path, p_quality, p_toxic of every row of docs: the classifier's
    evidence from the text combined with the odds of its site.

    Null texts count as empty, null hosts and paths as a site of their own, texts of any length whole.  Rows that tie or
    repeat are judged alike and all stay.  Without labels, or without labels of one kind, nothing is rejected for it; an
    empty table gives no rows; columns of docs may have any names.  Sites with over a thousandth of all documents (fewer
    than a thousand) are broadcast, the others joined by shuffle.
    """
    few = checkpoint(sampled_labels(labels))
    model = fit(docs, few)
    scores = scratch(with_counts(scored(docs, model, host, path, kept), few))
    sites, prior = site_counts(scores)
    both = join_counted(scores, sites, ["_host", "_path"], "n")
    return both.select("_row", "_host", "_path", _posterior("good", prior).alias("p_quality"), _posterior("toxic", prior).alias("p_toxic"))


KEPT = "p_quality >= 0.5 AND p_toxic < 0.5"


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """The rows of docs, all columns, that are more likely good than not and less likely toxic than not."""
    return judged(docs, labels, host, path).where(KEPT).select("_row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judged of documents with the labels of labels, the source as host, source and language as path."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = judged(docs, read(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"), ["doc_id"])
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.col("_host").alias("host"), F.col("_path").alias("path"), F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.expr(KEPT).alias("keep"))
