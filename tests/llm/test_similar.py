"""Near-duplicates by shingle similarity against brute force over all pairs."""

import random

import pytest

from obsward.llm import similar
from obsward.llm.simhash import keep_one


def mutated(words, n, r):
    words = list(words)
    for at in r.sample(range(len(words)), n):
        words[at] = f"new{r.randrange(10**9)}"
    return words


def texts():
    r = random.Random(9)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    out = [None, "", "one", "One ", "a b c d e f g h", "a b c d e f g h i", "A b c d e f g  h\ti"]
    for k in range(60):
        base = fresh(r.randrange(60, 300))
        out += [" ".join(base), " ".join(mutated(base, 1 + k % 8, r))]
    centre = fresh(400)
    out += [" ".join(mutated(centre, r.randrange(1, 8), r)) for _ in range(60)]
    chain = fresh(200)
    for _ in range(12):
        chain = chain[15:] + fresh(15)
        out.append(" ".join(chain))
    r.shuffle(out)
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.mark.parametrize("stars", [2, 0])
def test_one_of_each_similar_group_stays(spark, monkeypatch, stars):
    monkeypatch.setattr(similar, "STARS", stars)
    rows = list(enumerate(texts()))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    linked = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) / len(x | y) >= 0.8:
                linked += x != y
                a, b = root[i], root[j]
                root = [min(a, b) if k in (a, b) else k for k in root]
    assert linked > 100
    kept = sorted(r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == sorted({min(i for i, k in enumerate(root) if k == own) for own in set(root)})
