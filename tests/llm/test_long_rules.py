"""Byte and word dedup where one minimiser has more strings than a task judges, and where a text is cut for the search."""

import random
from collections import Counter

import numpy as np

from obsward.llm import substring, suffix_dedup
from obsward.llm.superkmer import BYTE_SYMBOLS, CHUNK, gram_hashes


def test_long_rules_before_different_texts(spark):
    r = random.Random(4)
    rule = min("*-=_#~+.", key=lambda c: int(gram_hashes(np.repeat(BYTE_SYMBOLS[ord(c)], 50), 50)[0]))
    texts = [rule * 199 + "".join(r.choices("abcdefghij", k=300)) for _ in range(250)] + ["q" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    expected = {}
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t) - 199) if count[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        expected[k] = (len(gone), "".join(c for j, c in enumerate(t) if j not in gone))
    got = {x.doc_id: (x.n_removed, bytes(x.kept).decode()) for x in suffix_dedup.remove_repeated_bytes(rows).collect()}
    assert got == expected


def test_repeats_across_the_cut_of_a_long_text(spark):
    words = [f"w{k}" for k in range(CHUNK + 3000)]
    a = CHUNK - 20
    rows = [(0, " ".join(words)), (1, "x y " + " ".join(words[a : a + 60]) + " z"), (2, " ".join(words[CHUNK + 10 : CHUNK + 44]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring.remove_repeated_windows(df).collect()}
    assert got == {0: (len(words), 60, " ".join(words[:a] + words[a + 60 :])), 1: (63, 60, "x y z"), 2: (34, 0, rows[2][1])}
    text = "".join(f"{k:05d}," for k in range(CHUNK // 6 + 500))
    rows = [(0, text), (1, "x" + text[CHUNK - 150 : CHUNK + 150] + "y"), (2, text[CHUNK + 200 : CHUNK + 399])]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (300, 1, text[: CHUNK - 150] + text[CHUNK + 150 :]), 1: (300, 1, "xy"), 2: (0, 0, rows[2][1])}


def test_a_passage_and_copies_that_most_documents_hold(spark):
    """Many rounds: copies of a passage among different words, and a large group of equal texts."""
    r = random.Random(6)
    fresh = lambda n: [f"{r.randrange(10**8)}" for _ in range(n)]
    passage = fresh(80)
    rows = [" ".join(fresh(20) + passage[r.randrange(20) : 80 - r.randrange(20)] + fresh(20)) for _ in range(3000)] + [" ".join(passage)] * 2000 + [" ".join(fresh(50)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    count = Counter(tuple(w[i : i + 35]) for t in rows for w in [t.split()] for i in range(len(w) - 34))
    expected = {}
    for k, t in enumerate(rows):
        w = t.split()
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        expected[k] = " ".join(x for j, x in enumerate(w) if j not in gone)
    assert {x.doc_id: bytes(x.kept).decode() for x in substring.remove_repeated_windows(df).collect()} == expected
