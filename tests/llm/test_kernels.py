"""Parts without Spark against plain versions."""

import random

import numpy as np
import pytest
import tiktoken
import xxhash

from obsward.llm import ann, bpe, gsaca, hashing, media, superkmer
from obsward.llm.repeats import Bytes, covered
from obsward.llm.substring import count_windows
from obsward.llm.suffix_dedup import judge_by_suffixes

R = random.Random(7)


def plain_simhash(text, shingle):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text).split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_xxh64():
    data = bytes(R.randrange(256) for _ in range(500))
    ends = [R.randrange(500) for _ in range(300)]
    starts = [R.randrange(e + 1) for e in ends]
    got = hashing.xxh64_many(np.frombuffer(data + bytes(8), np.uint8), np.array(starts), np.array(ends), 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("shingle", [4, 5])
def test_simhash_of_many(shingle):
    texts = [b"", b" \t\n", b"One", b"a  B\x0bc \r\n d e\xc3\xa9", "É é ß".encode(), b"x " * 3000, b"q" * 900] + [b" ".join(bytes([R.randrange(65, 123)]) * R.randrange(1, 40) for _ in range(R.randrange(12))) for _ in range(60)]
    assert hashing.simhash_many(texts, shingle).tolist() == [plain_simhash(t, shingle) for t in texts]


def test_suffix_array():
    for k in range(400):
        s = [R.randrange(1, R.choice([2, 3, 27])) for _ in range(R.randrange(40))]
        s = (s[:5] * 9 if k % 4 == 0 else s) + [0]
        assert gsaca.suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_super_kmers_cover_each_window_once_and_equal_windows_share_keys():
    texts = [bytes(R.choice(b"abc") for _ in range(R.randrange(0, 400))) for _ in range(20)] + [b"ab" * 300]
    texts += [texts[3][5:200] + b"zz" + texts[4], texts[3]]
    window, gram, keys = 40, 10, {}
    seen = set()
    own = Bytes(texts)
    for of, offset, size in superkmer.chunks(own.lengths, window):
        for p, start, n, key in zip(*(x.tolist() for x in superkmer.super_kmers(own.symbols(of, offset, size), size, window, gram)), strict=True):
            for i in range(start + offset[p], start + offset[p] + n):
                assert (of[p], i) not in seen
                seen.add((of[p], i))
                keys.setdefault(texts[of[p]][i : i + window], set()).add(key)
    assert seen == {(t, i) for t in range(len(texts)) for i in range(len(texts[t]) - window + 1)}
    assert all(len(k) == 1 for k in keys.values())


def plain_flags(strings, weights, window, cut=lambda s, i, w: s[i : i + w], size=len):
    count = {}
    for s, w in zip(strings, weights, strict=True):
        for i in range(size(s) - window + 1):
            count[cut(s, i, window)] = count.get(cut(s, i, window), 0) + w
    return [[count[cut(s, i, window)] > 1 for i in range(size(s) - window + 1)] for s in strings], count


def judged(judge, strings, weights, window, cut=lambda s, i, w: s[i : i + w], size=len):
    expected, count = plain_flags(strings, weights, window, cut, size)
    got = judge(strings, weights, window)
    assert [f.tolist() for f, _ in got] == expected
    picked = [cut(s, i, window) for s, (_, p) in zip(strings, got, strict=True) for i in np.flatnonzero(p).tolist()]
    assert sorted(picked) == sorted(count)


def test_judges():
    strings = [bytes(R.choice(b"ab") for _ in range(R.randrange(12, 60))) for _ in range(40)]
    strings = list(dict.fromkeys([*strings, b"ab" * 20]))
    judged(judge_by_suffixes, strings, [1 if R.random() < 0.7 else 2 for _ in strings], 12)
    words = list(dict.fromkeys(" ".join(R.choice("abc") for _ in range(R.randrange(4, 20))).encode() for _ in range(40)))
    cut = lambda s, i, w: tuple(s.split()[i : i + w])
    judged(count_windows, words, [1 if R.random() < 0.9 else 2 for _ in words], 4, cut, lambda s: len(s.split()))
    assert covered([{"begins": [1, 2], "n": 1}], False, 8, 4).tolist() == [False] + [True] * 5 + [False] * 2
    assert covered(None, True, 8, 4).all() and covered(None, True, 3, 4) is None and covered(None, False, 8, 4) is None


def test_bpe_as_the_library():
    own = bpe.codec(bpe.vocabulary())
    library = tiktoken.Encoding("own", pat_str=bpe.split_pattern(), mergeable_ranks=own.ranks, special_tokens={})
    alphabet = ["a", "b", " ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "　", "1", "²", "é", "é", "漢", "🙂", "'s", "'LL", "'ll", "_", "​", "\x00", "٣", "ǅ"]
    texts = ["".join(R.choice(alphabet) for _ in range(R.randrange(30))) for _ in range(3000)]
    texts += ["a" * 4000, "ab" * 2500, "".join(R.choice("abcdeinrst") for _ in range(15000)), " " * 2000 + "x", "<|endoftext|>", ""]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode() and own.decode_packed(own.encode_packed(t)) == t.encode()


def test_chunks_are_content_defined():
    body = bytes(R.randrange(256) for _ in range(30_000))
    payloads = [media.padded(body), media.padded(b"other beginning " + body), media.padded(b""), media.padded(b"a" * 64), bytes(40_000)]
    cuts = media.cut_points(payloads)
    for p, ends in zip(payloads, cuts, strict=True):
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(p) and (sizes <= media.MOST).all() and (sizes[:-1] >= media.LEAST).all()
    chunks = [{p[a:b] for a, b in zip([0, *c], c)} for p, c in zip(payloads, cuts, strict=True)]  # noqa: B905
    assert len(chunks[0] & chunks[1]) > len(chunks[0]) // 2
    assert [len(media.padded(b"x" * n)) for n in (0, 1, 64, 65)] == [64, 64, 64, 128]


def test_pruning_keeps_diverse_edges():
    r = np.random.default_rng(4)
    points = ann._unit(r.normal(size=(60, 6)))
    candidates = np.concatenate([r.integers(-1, 60, size=(20, 25)), np.full((20, 3), -1)], axis=1)
    nodes = r.permutation(60)[:20]
    got = ann._prune(points, nodes, candidates, 7, 1.2)
    apart = lambda i, j: float(np.sqrt(max(2 - 2 * points[i] @ points[j], 0)))
    for node, some, mine in zip(nodes.tolist(), candidates.tolist(), got.tolist(), strict=True):
        left = sorted({c for c in some if c >= 0 and c != node}, key=lambda c: apart(node, c))
        kept = []
        while left and len(kept) < 7:
            kept.append(left.pop(0))
            left = [c for c in left if 1.2 * apart(kept[-1], c) > apart(node, c)]
        assert [x for x in mine if x >= 0] == kept


def recall(points, queries, beam=None):
    edges, entry = ann.build_graph(points)
    assert edges.shape == (len(points), ann.DEGREE) and (edges < len(points)).all()
    nodes, near, _, met = ann.beam_search(points, edges, entry, queries, beam or ann.BEAM)
    exact = np.argsort(-(queries @ points.T), axis=1)[:, :5]
    assert (np.diff(near, axis=1) <= 0).all()
    return np.mean([len(set(a[:5].tolist()) & set(b.tolist())) / 5 for a, b in zip(nodes, exact, strict=True)]), met / len(queries)


def test_graph_recall():
    r = np.random.default_rng(2)
    assert recall(ann._unit(r.normal(size=(900, 24))), ann._unit(r.normal(size=(100, 24))))[0] > 0.95
