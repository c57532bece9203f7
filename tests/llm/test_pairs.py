"""Near-duplicates, nearest neighbours and packing against brute force."""

import random
import zlib

import numpy as np
import pytest

from gleaner.llm import ann, neardup, packing
from gleaner.llm.common import public_tokenizer


def text(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def near_documents():
    r = random.Random(4)
    out = []
    for i in range(40):
        base = text(r, 120).split()
        out.append((i * 10, " ".join(base)))
        if i % 2:
            out.append((i * 10 + 1, " ".join([*base[:60], "changed", *base[61:]])))
        if i % 4 == 1:
            out.append((i * 10 + 2, " ".join([*base[:30], "here", *base[31:]])))
            out.append((i * 10 + 3, " ".join(base).upper()))
        if i % 5 == 0:
            out.append((i * 10 + 4, " ".join([*base[:60], *text(r, 60).split()])))
    return [*out, (9001, None), (9002, None), (9003, ""), (9004, ""), (9005, "!!"), (None, "a b c"), (9006, "a b c"), (0, out[0][1])]


def test_near_duplicates(spark):
    docs = near_documents()
    got = neardup.report(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, class_id int")).collect()
    assert len(got) == len(docs)
    hashes = [(i, neardup.shingles(t or "")[1]) for i, t in docs]
    sets = [(i, neardup.simhash(h).view(np.uint64) if len(h) else (("raw", t) if t is not None else ("null", k))) for k, ((i, h), (_, t)) in enumerate(zip(hashes, docs, strict=True))]
    shared = [frozenset(h.tolist()) for _, h in hashes]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            plain = isinstance(x, tuple) + isinstance(y, tuple)
            alike = x == y if plain == 2 else not plain and bool(neardup.distance(x, y) <= neardup.FAR)
            jaccard = len(shared[a] & shared[b]) / max(1, len(shared[a] | shared[b]))
            assert alike or jaccard < 0.8
            assert not alike or jaccard > 0.5 or not shared[a]
            if alike:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted(((i, least.get(find(k))) for k, (i, _) in enumerate(docs)), key=repr)
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == want
    kept = neardup.keep_one(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, class_key int"))
    assert kept.columns == ["doc_id", "text", "class_key"]
    assert kept.count() == len({find(k) for k in range(len(docs))})


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.report(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def joined(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def turned(r, s, bits):
    """Rows of s with `bits` random places changed."""
    out = s.copy()
    for row in out.view(np.uint8).reshape(len(s), -1):
        for place in r.choice(256, bits, replace=False):
            row[place // 8] ^= np.uint8(1 << place % 8)
    return out


@pytest.mark.parametrize("label", [None, "some"])
def test_bucket_links_connect_what_all_pairs_connect(label):
    r = np.random.default_rng(1)
    seeds = r.integers(0, 2**63, (60, 4)).astype(np.uint64)
    s = np.concatenate([seeds, *(turned(r, seeds, bits) for bits in (3, 20, 40, 51, 52, 70)), np.repeat(seeds[:1], 500, axis=0)])
    s = np.concatenate([s, turned(r, s[:1].repeat(700, axis=0), 12)])
    known = None if label is None else np.where(np.arange(len(s)) >= len(s) - 700, -1, np.arange(len(s)))
    i, j = neardup.bucket_links(s, known)
    every = [(a, b) for a in range(len(s)) for b in np.flatnonzero(neardup.distance(s[a], s) <= neardup.FAR)]
    if label is None:
        assert all(neardup.distance(s[i], s[j]) <= neardup.FAR) and len(i) < len(s)
        assert len(set(joined(len(s), zip(i, j, strict=True)))) == len(set(joined(len(s), every)))
    else:
        chain = [(k, k + 1) for k in range(len(s) - 700, len(s) - 1)]
        assert len(set(joined(len(s), [*zip(i, j, strict=True), *chain]))) == len(set(joined(len(s), every)))


def test_oversized_buckets_find_planted_pairs_at_the_recall_of_their_bits():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, (35_000, 4)).astype(np.uint64)
    s = np.concatenate([a, turned(r, a[:2000], 25)])  # beyond CAP with what follows
    s = np.concatenate([s, r.integers(0, 2**63, (neardup.CAP, 4)).astype(np.uint64)])
    assert len(s) > neardup.CAP
    i, j = neardup.bucket_links(s)
    found = {(k, 35_000 + k) for k in range(2000)} & set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
    assert len(found) >= 1990  # at distance 25, more than RECALL, which is for distance FAR


def test_a_bucket_of_60000_rows_loses_no_planted_pair():
    r = np.random.default_rng(5)
    s = r.integers(0, 2**63, (60_000, 4)).astype(np.uint64)
    s[58_000:] = turned(r, s[:2000], 20)
    s[58_000:, 0] ^= np.uint64(1 << 63)  # far away in any order by the first bits
    i, j = neardup.bucket_links(s, word=1)
    assert len(s) <= neardup.CAP
    assert {(k, 58_000 + k) for k in range(2000)} <= set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))


@pytest.mark.parametrize("word", range(4))
def test_a_pair_that_differs_in_one_word_alone_is_linked(word):
    s = np.random.default_rng(6).integers(0, 2**63, (300, 4)).astype(np.uint64)
    s[299] = s[0]
    s[299, word] ^= np.uint64(2**neardup.FAR - 1)  # all that may differ, in one of the words
    for first in range(4):
        assert [{*map(int, k)} for k in zip(*neardup.bucket_links(s, word=first), strict=True)] == [{0, 299}]


@pytest.mark.parametrize("n", [1, 2, 254, 255, 256, 4080, 4081, 9000])
def test_simhash_is_the_majority_of_each_bit(n):
    sh = np.sort(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    bits = np.unpackbits(neardup.planes(sh), axis=1).astype(int)
    ties = np.unpackbits(neardup.planes(np.bitwise_xor.reduce(sh)[None])[0])
    want = [int(2 * ones > n or 2 * ones == n and tie) for ones, tie in zip(bits.sum(axis=0), ties, strict=True)]
    assert np.unpackbits(neardup.simhash(sh)).tolist() == want


def test_a_hot_group_is_spread_and_keeps_its_outsiders(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CAP", 300)
    monkeypatch.setattr(neardup, "repeats", lambda k: 1)
    monkeypatch.setattr(neardup, "design", lambda n: (1, 1))
    r = np.random.default_rng(3)
    heart = r.integers(0, 2**63, (1, 4)).astype(np.uint64)
    group = turned(r, heart.repeat(3000, axis=0), 20)
    bit = 255 - int(np.random.default_rng(17).choice(256, 1, replace=False)[0])
    outside = turned(r, group[:40], 40)  # near a member, too far from the leader to be in its ball
    rest = r.integers(0, 2**63, (500, 4)).astype(np.uint64)
    s = np.unique(np.concatenate([group, outside, rest]), axis=0)
    nodes = spark.createDataFrame([(bytearray(x.tobytes()),) for x in s], "key binary")
    got = [(bytes(x["a"]), bytes(x["b"])) for x in neardup.links(nodes, len(s)).collect()]
    place = {x.tobytes(): k for k, x in enumerate(s)}
    found = joined(len(s), [(place[a], place[b]) for a, b in got])
    assert all(neardup.distance(s[place[a]], s[place[b]]) <= neardup.FAR for a, b in got) and bit >= 0
    # The one table samples one bit: who shares it must be joined as brute force over its bucket joins.
    sampled = np.unpackbits(s.view(np.uint8).reshape(len(s), -1), axis=1)[:, np.random.default_rng(17).choice(256, 1, replace=False)[0]]
    every = [(a, b) for a in range(len(s)) for b in np.flatnonzero((neardup.distance(s[a], s) <= neardup.FAR) & (sampled == sampled[a]))]
    want = joined(len(s), every)
    for a, b in every:
        assert found[a] == found[b]
    assert len(set(found)) <= len(set(want))


def test_short_and_long_texts_of_no_kinship_stay_apart(spark):
    r = random.Random(8)
    docs = [(i, text(r, 6)) for i in range(300)] + [(1000, text(r, 200_000))]
    got = neardup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len({x["class_id"] for x in got}) == len(docs)


def test_helper_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", "r", 1, "k", 2.0), (1, "a b c", "r", 1, "k", 2.0), (2, None, "x", 2, None, 3.0)], "doc_id long, text string, _raw string, _kid int, _kraw string, _place double")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c", "r", 1, "k", 2.0), (2, None, "x", 2, None, 3.0)]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 70), (200, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 50, 70: 50}


def test_neighbours_recall(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, [float(u) for u in v], "c") for i, v in enumerate(x)] + [(5000, None, ""), (5001, [0.0] * 16, ""), (5002, [float("nan")] * 16, ""), (5003, [1.0], ""), (None, [1.0] * 16, ""), (5020, [None] * 16, ""), (1, [float(u) for u in x[1]], "again")]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")).collect()
    by = {}
    for row in got:
        by.setdefault(row["query_id"], []).append(row)
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda row: row["rank"])
        assert [row["rank"] for row in found] == list(range(1, 21)) and all(row["vec_id"] < 1500 and row["vec_id"] != q for row in found)
        assert all(abs(row["score"] - float(x[q].astype(float) @ x[row["vec_id"]].astype(float))) < 1e-12 for row in found)
        assert [(-row["score"], row["vec_id"]) for row in found] == sorted((-row["score"], row["vec_id"]) for row in found)
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len({row["vec_id"] for row in found} & set(np.argsort(-s)[:20].tolist()))
    assert hits / 20 / len(by) >= 0.9


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_neighbours_where_the_codes_decide(spark, kind):
    r = np.random.default_rng(6)
    x = r.normal(size=(20_000, 24))
    if kind == "clusters":
        x = 4 * r.normal(size=(40, 24))[r.integers(0, 40, 20_000)] + x
    x = x.astype(np.float32).astype(float)
    rows = ann.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).cache()
    model = ann.model_of(rows, len(x))
    assert len(model["centres"]) > 5 and (kind == "spread" or model["probes"] <= 0.5 * len(model["centres"]))
    q = np.arange(0, 20_000, 400)
    codes = ann.encode(x, model["books"])
    share = (ann.rough(x[q], model["books"], codes, ann.norm_ratio(x, codes, model["books"])) >= ann.threshold(x[q], model)[:, None]).mean()
    assert share < 0.1  # of the vectors are scored exactly
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), every=400).collect()
    by = {}
    for row in got:
        by.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = 0
    for k in q.tolist():
        s = x @ x[k]
        s[k] = -np.inf
        hits += len(by[k] & set(np.argsort(-s)[:20].tolist()))
    assert len(by) == len(q) and hits / 20 / len(q) >= 0.9


def test_lookup_scores_are_those_of_the_reconstruction():
    r = np.random.default_rng(2)
    x, q = r.normal(size=(300, 8)), r.normal(size=(5, 8))
    books = ann.train(x, 4)["books"]
    codes = ann.encode(x, books)
    want = np.array([[a @ sum(books[m][c] for m, c in enumerate(row)) for row in codes] for a in q]) * ann.norm_ratio(x, codes, books)
    assert np.allclose(ann.rough(q, books, codes, ann.norm_ratio(x, codes, books)), want, atol=1e-4)


def test_neighbours_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], kind)).count() == 0
    got = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (20, [0.0, 1.0])], kind)).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0)]


def test_beam_search_is_no_worse_than_greedy():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8))
    books = ann.train(x, 4)["books"]
    error = [((ann.decode(ann.encode(x, books, beam), books) - x) ** 2).sum() for beam in (1, 8)]
    assert error[1] <= error[0] < (x**2).sum()


def check_pieces(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    left = [np.array([*t.encode(d or "", add_special_tokens=False).ids, 2], "<u4") for _, d in docs]
    want = sorted((i is None, i or 0, len(a), zlib.crc32(a.tobytes())) for (i, _), a in zip(docs, left, strict=True))
    assert sum(r["length"] for r in rows) == sum(w[2] for w in want)
    seqs = {}
    for r in rows:
        assert r["length"] > 0
        seqs.setdefault(r["sequence_id"], []).append(r)
    padding = total = 0
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        at = 0
        for r in s:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    ids = {}
    for (i, _), a in zip(docs, left, strict=True):
        ids.setdefault(i, []).append(a)
    for r in rows:
        assert any(len(a) == r["doc_tokens"] and zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for a in ids[r["doc_id"]])
    return padding / total


def test_packing(spark):
    r = random.Random(1)
    docs = [(i, text(r, r.randint(1, 700)) + r.choice([".", "", "!?", " 12 É’s <|endoftext|> Σίσυφος ŉ İx y\x1cz", "\n\n's"])) for i in range(300)] + [(900, None), (901, ""), (902, text(r, 20_000)), (None, "abc"), (901, "")]
    rows = packing.pack(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, length int").repartition(5)).collect()
    assert check_pieces(rows, docs) < 0.02


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
