"""Operators on awkward rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsward.llm import ann, bpe, line_dedup, media, mixing, quality, repeats, sharding, simhash, substring, suffix_dedup
from obsward.llm.components import components

R = random.Random(3)
SYLLABLES = ["ta", "ri", "mo", "ken", "ul", "sh", "ver", "io", "an", "pe"]


def words(n, r=R):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 5))) for _ in range(n))


PASSAGE = words(60)
BASE = words(150)
LONG = words(20_000)
TEXTS = [
    None, "", None, " \n\t ", "one", "One", "ein\x0bWort\rund  mehr", BASE, BASE, BASE.replace("ta", "TA"), BASE + " and more", words(40) + "\n" + PASSAGE + "\n" + words(40),
    words(30) + " " + PASSAGE + " " + words(30), PASSAGE, LONG, LONG[: len(LONG) // 2], "For " * 400, "a\nb\nc\na\nb\nc", "é漢字 🙂 " * 50, "x" * 5000, "x" * 199, "x" * 200,
    "first line here is long\nb\nc\nlast", "b\nc\nfirst line here is long\nb\nc", "this is the very same line\nthis is the very same line", words(200), words(200),
]
IDS = [*range(len(TEXTS) - 2), None, 5]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, repeated ids and rows, and columns named like those of the results and inner ones."""
    rows = [(i, t, None if k % 5 == 0 else f"src{k % 3}", None if k % 7 == 0 else ["en", "de", "xx"][k % 3], k) for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    rows.append(rows[7])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n int").repartition(3)
    extra = {c: F.lit(1) for c in ("key", "h1", "h", "fp", "component_id", "shard", "slot", "size", "kept", "spans", "pos", "rank", "topic_", "_text", "node", "label", "payload", "token_ids")}
    return df.withColumns(extra)


def raw(text):
    return (text or "").encode()


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same(got, expected):
    assert Counter(got) == Counter(expected)


def digest(b):
    return hashlib.sha256(b).hexdigest()


def plain_repeats(units, window):
    count = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if count[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [50_000, 20])
def test_substring_and_suffix_dedup(docs, monkeypatch, most):
    """In one round, and in several where a task takes few windows."""
    monkeypatch.setattr(repeats, "TASK_WINDOWS", most)
    rows = rows_of(docs)
    units = [raw(t).split() for _, t in rows]
    expected = [(i, len(u), sum(g), b" ".join(w for w, x in zip(u, g, strict=True) if not x)) for (i, _), u, g in zip(rows, units, plain_repeats(units, 35), strict=True)]
    same([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring.remove_repeated_windows(docs).collect()], expected)
    units = [raw(t) for _, t in rows]
    expected = [(i, len(u), sum(g), sum(g[k] and not (k and g[k - 1]) for k in range(len(g))), bytes(c for c, x in zip(u, g, strict=True) if not x)) for (i, _), u, g in zip(rows, units, plain_repeats(units, 200), strict=True)]
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(docs).collect()], expected)


def grouped(fps, most):
    n = len(fps)
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    fps = [r.fp & (1 << 64) - 1 for r in got]
    root = grouped(fps, 4)
    for r, mine in zip(got, root, strict=True):
        ids = [x.doc_id for x, other in zip(got, root, strict=True) if other == mine and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = simhash.fingerprints(docs, 5).collect()
    assert kept.count() == len(set(grouped([r.fp & (1 << 64) - 1 for r in found], 4)))


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_links_between_many_fingerprints(spark):
    """Groups around centres, chains, and centres that share blocks but lie apart."""
    centre = [R.getrandbits(64) for _ in range(30)]
    centre += [c ^ sum(1 << R.randrange(64) for _ in range(9)) for c in centre[:10]]
    fps = [c ^ sum(1 << R.randrange(64) for _ in range(R.randrange(7))) for c in centre for _ in range(12)]
    chain = [R.getrandbits(64)]
    for _ in range(40):
        chain.append(chain[-1] ^ sum({1 << R.randrange(64) for _ in range(4)}))
    fps = sorted({f % (1 << 64) for f in fps + chain + [0, 1, (1 << 64) - 1]})
    got = {r.node: r.root for r in simhash.linked(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    root = grouped(fps, 4)
    least = {k: min(signed(f) for f, x in zip(fps, root, strict=True) if x == k) for k in set(root)}
    assert len(set(root)) < len(fps)
    assert {signed(f): got.get(signed(f), signed(f)) for f in fps} == {signed(f): least[k] for f, k in zip(fps, root, strict=True)}


def test_only_shared_coordinates_are_joined(spark, monkeypatch):
    """Of many unrelated fingerprints and one large group of near copies, joins read the rows of shared keys only."""
    r = random.Random(11)
    centre = r.getrandbits(64)
    fps = sorted({signed(x) for x in [r.getrandbits(64) for _ in range(3000)] + [centre ^ 1 << i ^ 1 << j for i in range(20) for j in range(i)]})
    joined, join = [], simhash.join_counted

    def counted(rows, *others):
        joined.append(rows.count())
        return join(rows, *others)

    monkeypatch.setattr(simhash, "join_counted", counted)
    got = {x.node: x.root for x in simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    near = {signed(centre ^ 1 << i ^ 1 << j) for i in range(20) for j in range(i)}
    assert {got.get(f) for f in near} == {min(near)} and len(got) < 200
    assert max(joined) < 35 * len(near) + 1000 < 35 * len(fps) // 10


def test_distance_table(spark):
    fps = [R.getrandbits(64) for _ in range(50)]
    for row in simhash.distance_table(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 7).collect():
        for j, p in enumerate(simhash.PIVOTS):
            assert sum(row[f"c{k}"] >> 4 * j & 15 for k in range(7)) == ((row.fp ^ p) & (1 << 64) - 1).bit_count()


@pytest.mark.parametrize("few", [200_000, 5])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("obsward.llm.components.FEW", few)
    chain = [(i, i + 1) for i in range(100)] + [(1000 + i, 1000 + j) for i in range(20) for j in range(i)]
    R.shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(20)}


def test_sharding(spark, docs):
    sized = docs.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    got = sharding.contiguous_shards(sized, "bytes", ["doc_id", "bytes"], 4)
    assert set(got.columns) == set(sized.columns)
    rows = got.select("doc_id", "bytes", "shard", "slot").collect()
    assert len(rows) == docs.count()
    total, most = sum(r.bytes for r in rows), max(r.bytes for r in rows)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    keys = [(-1 if r.doc_id is None else r.doc_id, r.bytes) for r in order]
    assert keys == sorted(keys)
    before = 0
    for r in order:
        assert r.shard == min(3, (2 * before + r.bytes) * 4 // (2 * total))
        before += r.bytes
    for s in range(4):
        own = [r for r in order if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own))) and abs(sum(r.bytes for r in own) - total / 4) <= most
    assert sharding.contiguous_shards(sized.where("false"), "bytes", ["doc_id"], 4).count() == 0


def plain_lines(rows, least):
    """Lines of each row that stay: places in order, all pairs of equal lines, runs along their diagonals."""
    lines = [[] if t is None else t.split("\n") for _, t in rows]
    places = {}
    for k, own in enumerate(lines):
        for p, x in enumerate(own):
            places.setdefault(x, []).append((k, p))
    same = {(a, b) for some in places.values() for i, b in enumerate(some) for a in some[:i]}
    gone = [set() for _ in rows]
    for (j, q), (k, p) in same:
        if ((j, q - 1), (k, p - 1)) in same:
            continue
        n = 0
        while ((j, q + n), (k, p + n)) in same:
            n += 1
        if sum(len(x.encode().split()) for x in lines[k][p : p + n]) >= least:
            gone[k].update(range(p, p + n))
    return [(i, None if t is None else "\n".join(x for p, x in enumerate(own) if p not in g)) for (i, t), own, g in zip(rows, lines, gone, strict=True)]


def ordered(spark, rows):
    """By id, nulls last, then by the hash that the operator orders by."""
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k long, t string")
    key = {r.k: (r.a, r.b) for r in df.select("k", *(c.alias(n) for c, n in zip(line_dedup.text_key(F.col("t")), "ab", strict=True))).collect()}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, key[k]))
    return [rows[k] for k in order]


def line_texts():
    r = random.Random(11)
    short = ["a", "b c", "", "d", "e f g", " ", "h\ti", "a b c d e", "j k l m n o"]
    out = ["\n".join(r.choice(short) for _ in range(r.randrange(1, 12))) for _ in range(25)]
    block = "\n".join(r.choice(short[:5]) for _ in range(40))
    out += [block, "x\n" + block + "\ny", block + "\nz z z z z", "\n".join([""] * 30) + "\nend of blank lines here", "some words begin it all\n" + "\n".join([""] * 30), "u v w\nu v w\nu v w"]
    return out + ["w1 w2\nw3\nw4 w5", "q\nw1 w2\nw3\nw4 w5\nq", "w1 w2\nw3\nw4 w6"]


def test_line_dedup(spark):
    rows = [*enumerate(line_texts()), (100, ""), (101, None), (None, "a b c d e"), (None, "w1 w2\nw3\nw4 w5"), (None, "w1 w2\nw3\nw4 w5"), (None, None), (3, "w1 w2\nw3\nw4 w5\nr"), ((1 << 63) - 1, "w1 w2\nw3\nw4 w5")]
    rows += [rows[25], (110, rows[25][1]), (111, rows[3][1])]
    R.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"n_chars": F.lit(0), "pos": F.lit(1), "h1": F.lit(1), "none": F.lit(1), "_spans": F.lit(1)})
    got = line_dedup.without_repeated_lines(df)
    assert got.columns == df.columns
    found = got.collect()
    expected = plain_lines(ordered(spark, rows), 5)
    same([(x.doc_id, x.text) for x in found], expected)
    assert ("q\nq") in {t for _, t in expected}  # a run of 2, 1 and 2 words
    assert all(x.n_chars == len(x.text) for x in found if x.text is not None)
    assert line_dedup.without_repeated_lines(df.where("false")).count() == 0


def test_line_dedup_on_awkward_rows(docs):
    assert line_dedup.without_repeated_lines(docs).count() == docs.count()


def test_mixing_meets_the_marginals(spark):
    r = random.Random(5)
    rows = [(i, words(r.randrange(5, 40), r), r.choice(["a", "b", "c", None]), r.choice(["en", "en", "de"]), r.choice(["t1", "t2"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = mixing.Targets({"a": 0.5, "b": 0.2, "zz": 0.3}, {"en": 0.5, "de": 0.5}, {"t1": 0.3, "t2": 0.7})
    got = mixing.mixed(df, targets, budget=0.2).select("_row.*", "_tokens", "_probability", "_drawn").collect()
    total = sum(x._tokens for x in got)
    expected = sum(x._tokens * x._probability for x in got)
    assert expected == pytest.approx(0.2 * total, rel=1e-6)
    share = lambda f: sum(x._tokens * x._probability for x in got if f(x)) / expected
    rest = sum(x._tokens for x in got if x.source not in ("a", "b")) / total
    assert share(lambda x: x.source not in ("a", "b")) == pytest.approx(rest, abs=1e-4)
    assert share(lambda x: x.source == "a") == pytest.approx((1 - rest) * 5 / 7, abs=1e-4)
    assert share(lambda x: x.lang == "en") == pytest.approx(0.5, abs=1e-4) and share(lambda x: x.topic == "t1") == pytest.approx(0.3, abs=1e-4)
    report = {(x.dimension, x.value): x for x in mixing.reached(mixing.mixed(df, targets, budget=0.2), targets).collect()}
    assert report["source", "*"].wanted is None and report["source", "a"].wanted == pytest.approx((1 - rest) * 5 / 7)
    assert all(x.expected == pytest.approx(x.wanted, abs=1e-4) for x in report.values() if x.wanted is not None) and ("source", "zz") not in report
    drawn = mixing.sample(df, targets, budget=0.2)
    assert drawn.columns == df.columns and {x.doc_id for x in drawn.collect()} == {x.doc_id for x in got if x._drawn < x._probability}
    assert sum(x._tokens for x in got if x._drawn < x._probability) == pytest.approx(expected, rel=0.15)


def test_the_budget_gives_way_to_the_targets(spark):
    r = random.Random(7)
    rows = [(i, words(20, r), "rare" if i % 50 == 0 else "common", "en") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = mixing.Targets({"rare": 0.4, "common": 0.6}, {"en": 1.0}, {"short": 1.0})
    mixture = mixing.mixed(df, targets, budget=0.7)
    shares = {x.value: x.expected for x in mixing.reached(mixture, targets).collect()}
    assert shares["rare"] == pytest.approx(0.4, abs=mixing.MISSING + 1e-9) and shares["rare"] < 0.4
    total, kept = mixture.selectExpr("SUM(_tokens)", "SUM(_tokens * _probability)").first()
    assert 0.04 < kept / total < 0.06


def test_mixing_on_awkward_rows(docs):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count() and all(0 < r._probability <= 1 and 0 <= r._drawn < 1 for r in got)
    assert all(r._probability == 1 for r in got if not raw(r._row.text).split())
    assert mixing.sample(docs.where("false")).count() == 0


def plain_feature(payload):
    crossings = sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:]))  # noqa: B905
    return f"{sum(payload)}:{sum(x * x for x in payload)}:{crossings}:{min(payload)}:{max(payload)}"


def test_media(spark, docs):
    kept = media.store(docs)
    got = media.load(kept, with_payload=True).collect()
    expected = []
    for i, t in rows_of(docs):
        p = media.padded(raw(t))
        expected.append((i, len(raw(t)), len(p), digest(p), zlib.crc32(p[-64:]), p))
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, bytes(r.payload)) for r in got], expected)
    assert len({(r.payload_sha256, r.n_bytes, r.media_sha256, r.media_bytes, r.feature) for r in got}) == len({raw(t) for _, t in rows_of(docs)})
    written = [(r.doc_id, len(r.media), digest(bytes(r.media))) for r in kept.packs.collect()]
    same([(r.doc_id, r.media_bytes, r.media_sha256) for r in got], written)
    plain = [(i, plain_feature(p)) for i, *_, p in expected]
    same([(r.doc_id, r.feature.split(":", 1)[1]) for r in got], plain)
    same([tuple(r) for r in media.load(kept).collect()], [tuple(r)[:-1] for r in got])
    chunks = {bytes(r.digest): bytes(r.bytes) for r in kept.chunks.collect()}
    assert chunks and all(hashlib.sha256(b).digest() == d for d, b in chunks.items())
    assert {True, False} <= {r.shared for r in kept.packs.collect()}
    turned = F.expr("CASE WHEN shared THEN media ELSE CAST(OVERLAY(media PLACING CAST('?' AS BINARY) FROM LENGTH(media)) AS BINARY) END")
    broken = media.MediaStore(kept.packs.withColumn("media", turned), kept.chunks)
    with pytest.raises(Exception, match="digest"):
        media.load(broken).collect()
    assert media.load(media.store(docs.where("false"))).count() == 0


def test_bpe_on_awkward_rows(docs):
    got = bpe.round_trip(docs, bpe.vocabulary()).collect()
    own = bpe.codec(bpe.vocabulary())
    expected = []
    for i, t in rows_of(docs):
        ids = own.encode(t or "")
        expected.append((i, len(ids), digest(b"".join(x.to_bytes(4, "little") for x in ids)), digest(raw(t))))
    same([tuple(r) for r in got], expected)
    encoded = bpe.encode_documents(docs, bpe.vocabulary())
    assert set(encoded.columns) == {*docs.columns, "n_tokens"}
    same([(r.doc_id, bytes(r.decoded)) for r in bpe.decode_documents(encoded, bpe.vocabulary()).select("doc_id", "decoded").collect()], [(i, raw(t)) for i, t in rows_of(docs)])
    assert bpe.round_trip(docs.where("false"), bpe.vocabulary()).count() == 0


def test_graph_search(spark):
    r = np.random.default_rng(1)
    some = [[float(x) for x in v] for v in r.normal(size=(120, 8))]
    rows = [(i, v) for i, v in enumerate(some)] + [(200 + i, some[0]) for i in range(30)] + [(300 + i, [2 * x for x in some[0]]) for i in range(3)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] + [0.0] * 6), (404, [float("inf")] + [0.0] * 7), (None, some[1]), (405, [1.0, 2.0]), (410, [2.0, 1.0]), (420, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit(1), "e1": F.lit(1), "members": F.lit(1)})
    vectors = ann.usable(df)
    got = sorted(map(tuple, ann.search(ann.build_index(vectors, 6), vectors.where("vec_id % 10 = 0"), 5).collect()))
    use = [(i, np.array(v)) for i, v in rows if i is not None and i not in (400, 401, 402, 403, 404, 420)]
    expected = []
    for q, a in use:
        if q % 10 == 0:
            scored = sorted((-ann._cosines(b[None], a[None])[0], i) for i, b in use if i != q and len(b) == len(a))
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert got == sorted(expected)
    empty = ann.usable(df.where("false"))
    assert ann.search(ann.build_index(empty, 6), empty, 5).count() == 0


def junk(k, r):
    return " | ".join(words(1, r) for _ in range(30)) if k % 2 else " ".join(f"{words(1, r)}%%%" for _ in range(40))


def test_quality(spark, docs):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        good, toxic = int(i % 6 != 0), int(i % 11 == 0)
        text = words(r.randrange(30, 80), r) if good else junk(i, r)
        if toxic:
            text = text.replace(" ", f" {r.choice(['vileword', 'vilething'])} ", 2)
        rows.append((i, text, f"s{i % 4}", "en"))
        if i < 600:
            labels.append((i, good, toxic))
    labels += [(None, 1, 0), (3, None, 1), (10_000, 1, 1), (3, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    kept = {x.doc_id for x in quality.keep_good(df, marks, host, path).collect()}
    right = sum((i in kept) == (i % 6 != 0 and i % 11 != 0) for i in range(600, 900))
    assert right >= 294
    assert quality.keep_good(docs, marks, host, path).columns == docs.columns
    assert quality.judged(docs, marks, host, path).count() == docs.count()
    assert quality.keep_good(df, marks.where("false"), host, path).count() == 900
    assert quality.keep_good(df.where("false"), marks, host, path).count() == 0


def plain_posteriors(rows):
    """rows: host, path, log odds and count (label or probability) of good, the same of toxic.  Returns both probabilities."""
    def prior(sites):
        n = sum(len(x) for x in sites)
        share = min(max(sum(map(sum, sites)) / n, 1e-4), 1 - 1e-4)
        between = max(sum(sum(x) ** 2 / len(x) for x in sites) / n - share**2 - len(sites) * share * (1 - share) / n, 1e-9)
        return share, min(max(share * (1 - share) / between - 1, 5.0), 1000.0)

    out = []
    for z in (2, 4):
        hosts, paths = {}, {}
        for k, r in enumerate(rows):
            hosts.setdefault(r[0], {})[k] = r[z + 1]
            paths.setdefault(r[:2], {})[k] = r[z + 1]
        (share, m0), (_, m1) = (prior([list(x.values()) for x in sites.values()]) for sites in (hosts, paths))
        own = []
        for k, r in enumerate(rows):
            others = [c for j, c in hosts[r[0]].items() if j != k]
            host = (m0 * share + sum(others)) / (m0 + len(others))
            others = [c for j, c in paths[r[:2]].items() if j != k]
            path = min(max((m1 * host + sum(others)) / (m1 + len(others)), 1e-4), 1 - 1e-4)
            own.append(1 / (1 + np.exp(-r[z] - np.log(path / (1 - path)) + np.log(share / (1 - share)))))
        out.append(own)
    return list(zip(*out, strict=True))


def test_judgement_equals_a_plain_version(docs, spark):
    ids = [0, 4, 5, 7, 8, 11, 12, 14, 20, 25]
    marks = spark.createDataFrame([(i, int(k % 3 > 0), int(k % 4 == 0)) for k, i in enumerate(ids)] + [(5, 1, 1), (None, 0, 1), (7, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    labels = {r.doc_id: r for r in quality.sampled_labels(marks).collect()}
    assert labels[5].toxic == 1 and set(labels) == {*ids, 999}
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    model = quality.fit(docs, quality.sampled_labels(marks))
    rows = []
    for r in docs.select("doc_id", "text", F.coalesce(host, F.lit("")).alias("a"), path.alias("b")).collect():
        good, toxic = (float(x[0]) for x in model.score([raw(r.text)]))
        known = labels.get(r.doc_id)
        counts = (float(known.quality), float(known.toxic)) if known else tuple(1 / (1 + np.exp(-x)) for x in (good, toxic))
        rows.append((r.a, r.b, good, counts[0], toxic, counts[1]))
    got = sorted((r._host, r._path, r.p_quality, r.p_toxic) for r in quality.judged(docs, marks, host, path).collect())
    for mine, (r, p) in zip(got, sorted(((r[0], r[1], *p), p) for r, p in zip(rows, plain_posteriors(rows), strict=True)), strict=True):
        assert mine[:2] == r[:2] and mine[2:] == pytest.approx(p, rel=1e-6)


def test_sparse_sites_shrink_to_their_parents():
    rows = [("big", f"big/{i % 2}", 0.0, float(i % 4 == 0), 0.0, 0.0) for i in range(400)] + [("good", "good/0", 0.0, 1.0, 0.0, 0.0)] * 400 + [("tiny", "tiny/0", 0.0, 0.0, 0.0, 0.0)]
    p = {r[1]: x[0] for r, x in zip(rows, plain_posteriors(rows), strict=True)}
    assert p["good/0"] > 0.5 and p["tiny/0"] == pytest.approx(0.5) and p["big/1"] < 0.1


def test_empty_tables(docs):
    none = docs.where("false")
    assert substring.remove_repeated_windows(none).count() == 0 and suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
