"""Packing, lexical search and hard negatives: against brute force, bounds and identities."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import hard_negatives, lexical, packing, queries

SF = "/root/testdata/sf0.001"


# ---- packing


def fewest(lengths, capacity):
    """The fewest sequences, by trying every place for every piece."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                put(i + 1, [*rest, room - lengths[i]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def counts_of(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1).astype(np.int64)


def used(packed, capacity):
    out = np.zeros(capacity + 1, np.int64)
    for filling, times in packed.items():
        assert sum(x * n for x, n in filling) <= capacity
        for x, n in filling:
            out[x] += n * times
    return out


def test_completion_finds_the_fewest():
    draw = random.Random(5)
    for _ in range(150):
        capacity = draw.choice([10, 17, 30, 100])
        lengths = [draw.randint(max(1, capacity // 8), capacity if draw.random() < 0.3 else capacity * 2 // 3) for _ in range(draw.randint(1, 11))]
        counts = counts_of(lengths, capacity)
        packed, least = packing.complete(counts)
        assert (used(packed, capacity) == counts).all() and (used(packing.best_fit(counts), capacity) == counts).all()
        assert least <= fewest(lengths, capacity) == sum(packed.values())
    counts = counts_of(np.random.default_rng(1).integers(1, 2049, 50), 2048)
    assert sum(packing.best_fit(counts).values()) == 27 and sum(packing.complete(counts)[0].values()) == 26  # the search beats the best fit


def test_completion_on_many_pieces():
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 2049, 50)
    counts = counts_of(np.concatenate([lengths, [1] * 100_000, [700] * 7]), 2048)
    packed, least = packing.complete(counts)
    assert (used(packed, 2048) == counts).all() and sum(packed.values()) == least
    rows = packing.ranges(packed)
    assert sum(len(f) for f in packed) == len(rows) < 1000


def test_no_listed_filling_dominates_another():
    counts = counts_of([9, 8, 7, 6, 5, 5, 4, 3, 3, 2, 1, 1], 20)
    for room in range(1, 20):
        found = packing.fillings(counts, room, 20, 6)
        assert found and found[0][0] == min(room - sum(s) for n in range(1, 8) for s in itertools.combinations([9, 8, 7, 6, 5, 5, 4, 3, 3, 2, 1, 1], n) if sum(s) <= room)
        for (w, a), (_, b) in itertools.permutations(found, 2):
            assert sum(a) == room - w and not packing._dominates(b, a)
    assert packing._dominates((5, 3), (4, 3, 1)) and not packing._dominates((4, 4), (5, 3))


def test_packing_edges(spark):
    texts = [None, "", "hello world", "a" * 50_000, "word " * 5000, "hello world", "x <|endoftext|> y", "ñandú 你好"]
    docs = spark.createDataFrame([(i if i != 5 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack(docs, queries.RANKS, capacity=512).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == (i if i != 5 else None)), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 512 for r in own[1:]) and own[0]["length"] <= 512
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    gapless(rows, 512)
    assert packing.pack(docs.where("false"), queries.RANKS).collect() == []


def gapless(rows, capacity):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark):
    rows = queries.op13_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d["doc_id"]: np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4") for d in docs}
    want = {(d, k, s, n, zlib.crc32(x[s : s + n].tobytes())) for d, x in ids.items() for k, (s, n) in enumerate(packing.cuts(len(x), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    lengths = np.array([r["length"] for r in rows])
    assert gapless(rows, 2048) == sum(packing.complete(counts_of(lengths, 2048))[0].values()) <= packing.lower_bound(counts_of(lengths, 2048)) + 1


# ---- lexical search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    held = [(d, collections.Counter(t), len(t)) for d, t in ((d, terms_of(x)) for d, x in docs) if t]
    total, words = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 50 + 50 * n * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if c[t])
            if s:
                scored.append((-s, math.inf if d is None else d))
        out += [(item, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    words = [[f"{a}{b}" for a in x for b in "abcdefgh"] for x in ("kl", "mn", "opq")]
    docs = [(i, " ".join(draw.choice(words[i % 3]) for _ in range(draw.randint(1, 40)))) for i in range(300)]
    docs += [(1000 + i, "KA la, Ka! ma na") for i in range(150)]  # a third of all rows alike: ties by id
    docs += [(2000, None), (2001, ""), (2002, " ,.;"), (None, "ka la ka ma na"), (2003, "ka " * 30_000), (7, "ka mb"), (2004, "ñandú Ñandú É")]
    items = [(str(i), " ".join(draw.sample(sum(words, []), draw.randint(1, 12)))) for i in range(25)]
    return docs, [*items, ("same", "ka la ka"), ("same", "KA la ka"), (None, "ma"), ("none", None), ("blank", "..."), ("unseen", "zzz"), ("far", "ñandú Ñandú")]


@pytest.mark.parametrize("sizes", [{}, {"cluster": 4, "part": 32, "sample": 64}, {"cluster": 2, "part": 16, "sample": 200, "cells": 300}, {"cluster": 8, "part": 50, "sample": 3, "rules_cells": 10}])
def test_search_equals_brute_force(spark, corpus, sizes):
    docs = spark.createDataFrame([(d, t, "x") for d, t in corpus[0]], "doc_id long, text string, score string")
    items = spark.createDataFrame([(i, t, 1) for i, t in corpus[1]], "item_id string, text string, rank int")
    got = lexical.search(docs, items, k=20, **sizes).collect()
    want = plain_search(*corpus, 20)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert lexical.search(docs.where("false"), items).collect() == lexical.search(docs, items.where("false")).collect() == []
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == plain_search([(1, "a b")], [("x", "a")], 50)


def test_bisection_brings_like_documents_together():
    draw = np.random.default_rng(2)
    topic = draw.permutation(np.repeat(np.arange(8), 32))
    doc, term = np.repeat(np.arange(256), 12), (topic.repeat(12) * 20 + draw.integers(0, 20, 256 * 12)) % 160
    seg = lexical.bisection(doc, term, 256, 32)
    assert np.bincount(seg).max() <= 32
    pure = sum(np.bincount(topic[seg == s]).max() for s in np.unique(seg))
    assert pure > 200, pure  # by chance it would be about 70
    levels = lexical.rules(doc, term, 256, 160, 3)
    leaf = lexical.route(doc, term, 256, levels)
    assert sum(np.bincount(topic[leaf == s]).max() for s in np.unique(leaf)) > 180


def test_clusters_below_the_floor_are_not_visited(monkeypatch):
    sizes = np.full(16, 4, np.int64)
    part = {"ids": np.arange(64).tobytes(), "sizes": sizes.tobytes(), "docs": np.arange(64, dtype=np.int32).tobytes(), "terms": np.zeros(64, np.int32).tobytes(), "impacts": np.arange(64, 0, -1, dtype=np.int32).tobytes()}
    looked = []
    monkeypatch.setattr(lexical.np, "ix_", lambda a, b, real=np.ix_: looked.append(len(a)) or real(a, b))
    found = lexical.Found(np.zeros(1, np.int64), 4)
    lexical.visit(part, np.array([[3]]), found)
    assert found.rows[1].tolist() == [0, 1, 2, 3] and found.rows[2].tolist() == [192, 189, 186, 183] and len(looked) == 1


# ---- hard negatives


def plain_negatives(rows, scale=256, positives=5, negatives=3):
    held = []
    for i, (v, label, x) in enumerate(rows):
        if v is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            held.append((i, v, label, [math.floor(scale * c) for c in x]))
    out = []
    for i, a, la, xa in held:
        if a % 5:
            continue
        scored = [(-sum(p * q for p, q in zip(xa, x)), v, lb == la) for j, v, lb, x in held if j != i]
        for ps, p, _ in sorted((s, v, o) for s, v, o in scored if o)[:positives]:
            fit = sorted((s, v) for s, v, o in scored if not o and 50 * -ps <= 100 * -s <= 95 * -ps)[:negatives]
            out += [(a, p, k + 1, v, -ps, -s) for k, (s, v) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, dim, labels, spread):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    rows = [(i, int(draw.integers(labels)), (centres[draw.integers(6)] + spread * draw.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(n + i, i % 2, [0.5] * dim) for i in range(n // 2)]  # copies: a third of all rows
    rows += [(None, 1, [1.0] * dim), (3 * n, None, [1.0] * dim), (3 * n + 5, 1, None), (3 * n + 10, 1, [1.0, None]), (3 * n + 15, 1, [float("nan")] * dim), (3 * n + 20, 1, [float("inf")] * dim)]
    return rows + [(3 * n + 25, 1, []), (3 * n + 30, 0, [0.25]), (5, 1, [0.5] * dim), (5, 1, [0.5] * dim)]


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"block": 16, "leaf": 4, "sample": 64, "group_bytes": 500}), (3, {"block": 32, "leaf": 8, "buckets": 1}), (4, {"block": 7, "leaf": 1, "buckets": 3, "group_bytes": 2_000})])
def test_negatives_equal_brute_force(spark, seed, sizes):
    rows = vectors(seed, 120, 4, 3, 0.2)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, row string, bucket int")
    got = hard_negatives.mine(table, F.col("vec_id") % 5 == 0, **sizes).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    table = spark.createDataFrame([(5, "a", [1.0, 2.0]), (6, "b", [1.0, 2.0])], "vec_id long, label string, embedding array<double>")
    anchors = F.col("vec_id") % 5 == 0
    for df in (table, table.where("false"), table.where("vec_id = 6")):
        assert hard_negatives.mine(df, anchors).collect() == []
    empty = spark.createDataFrame([(5, "a", []), (6, "b", []), (7, "a", [])], "vec_id long, label string, embedding array<double>")
    assert [tuple(r) for r in hard_negatives.mine(empty, anchors).collect()] == [(5, 7, 1, 6, 0, 0)]
    with pytest.raises(ValueError, match="2\\*\\*53"):
        hard_negatives.mine(table.withColumn("embedding", F.array(F.lit(1e9))), anchors)


def test_node_pairs_prune_and_lose_nothing():
    draw = np.random.default_rng(9)
    centres = 100 * draw.normal(size=(8, 5))
    x = np.floor(centres[draw.integers(0, 8, 600)] + draw.normal(size=(600, 5)))
    a, c = (hard_negatives.build_tree(p, np.zeros(len(p), np.int64), np.arange(len(p)), 16) for p in (x[:200], x[200:]))
    assert sorted(a.order.tolist()) == list(range(200))
    own, other = x[:200][a.order], x[200:][c.order]
    scores = own @ other.T
    floor = np.sort(scores, axis=1)[:, -5]
    top = np.full(200, np.inf)
    i, j, high = hard_negatives.leaf_pairs(a, c, hard_negatives._over(a, floor, np.minimum), hard_negatives._over(a, top, np.maximum), True)
    reached = np.zeros(scores.shape, bool)
    for p, q, h in zip(i, j, high):
        at = (slice(a.first[p], a.last[p]), slice(c.first[q], c.last[q]))
        reached[at] = True
        assert scores[at].max() <= h
    assert reached[scores >= floor[:, None]].all() and reached.mean() < 0.5
    assert (np.diff(high) <= 0).all()
