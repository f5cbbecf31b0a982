"""Near-duplicates, components, language-model and piece sampling against plain versions; the pipeline."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import components, embed_dedup, langid, lm_score, queries, simhash, sp_sampling

SF = "/root/testdata/sf0.001"


def grouped(pairs, nodes):
    up = {n: n for n in nodes}
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = grouped(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    for limit in (3, 1_000_000):
        got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long"), limit).collect()}
        assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), seed=42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(60)]
    texts = [None, "", "a", "A b", "É x\x85y z　w\x1cs", "a " * 50]
    for _ in range(8):
        words = [rng.choice(base) for _ in range(300)]
        texts += [" ".join(words)] * 3
        for _ in range(6):
            other = list(words)
            for _ in range(rng.randrange(1, 4)):
                other[rng.randrange(300)] = "new"
            texts.append(" ".join(other).title())
    rows = list(enumerate(texts)) + [(None, texts[8]), (3, texts[3])]
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = grouped(links, range(len(rows)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[roots[i]] = min(d, least.get(roots[i], d))
    want = sorted((str(rows[i][0]), f"{prints[i]:016x}", least.get(roots[i])) for i in range(len(rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (8192, 2):
        got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, bucket_limit=limit).collect())
        assert got == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    assert simhash.fingerprint(texts[9], piece=7) == simhash.fingerprint(texts[9])


@pytest.mark.parametrize("tile", [2048, 7])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    vectors = [base[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4]) for i in range(80)]
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(vectors)]
    rows += [(80, rows[0][1], 0), (81, rows[0][1], 0), (82, rows[0][1], 1), (83, None, 0), (84, [0.0] * 16, 0), (85, [float("nan")] * 16, 0), (86, [None] * 16, 0), (87, rows[0][1], None), (88, [float("inf")] * 16, 0), (89, [1.0] * 3, 0), (90, [], 0), (91, [1e-30] * 16, 0), (92, [3e38] * 16, 0)]
    good = [(i, np.array(v, float), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    cos = lambda a, b: float((a / np.abs(a).max()) @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()))
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.93]
    roots, n = grouped(links, range(len(rows))), collections.Counter(x for p in links for x in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df, tile=tile).collect()}
    assert got == {i: (n[i], roots[i], roots[i] == i) for i, _, _ in rows}
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_embeddings_in_double_precision(spark):
    rng = np.random.default_rng(9)
    turned = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [[1.0, 0.0], [1e300, 0.0], [1e-60, 0.0], [5e-324, 0.0], turned(0.93 + 1e-12), turned(0.93 - 1e-12), [1.7e308, 1.7e308], [1.0, float("inf")], [0.0, -0.0]]
    rows += [(rng.normal(size=2) * 10.0 ** rng.integers(-200, 200)).tolist() for _ in range(40)]
    with np.errstate(invalid="ignore"):
        unit = [np.array(v) / np.abs(v).max() for v in map(np.array, rows)]
    cos = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    good = [i for i, v in enumerate(rows) if np.isfinite(v).all() and np.any(v)]
    links = [(i, j) for i, j in itertools.combinations(good, 2) if cos(unit[i], unit[j]) >= 0.93]
    roots, n = grouped(links, range(len(rows))), collections.Counter(x for p in links for x in p)
    assert (0, 4) in links and (0, 5) not in links and (0, 1) in links and (0, 3) in links
    df = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, class int, tiles int, id string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {i: (n[i], roots[i], roots[i] == i) for i in range(len(rows))}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(200, 32)) ** 3, rng.normal(size=(200, 32)) ** 3
    (qa, sa, ea), (qb, sb, eb) = embed_dedup.quantise(a), embed_dedup.quantise(b)
    near = (qa.astype(float) @ qb.astype(float).T) * sa[:, None] * sb
    exact = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert (np.abs(near - exact) <= ea[:, None] * (1 + eb) + eb).all()


def plain_scores(texts, learn, prior=100.0, base=1.5):
    """(n_tokens, n_known, base score, model score) of each text from whole counts, quantised but not hashed."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for t in texts]
    one = collections.Counter(w for t, ok in zip(tokens, learn, strict=True) if ok for w in t)
    two = collections.Counter(p for t, ok in zip(tokens, learn, strict=True) if ok for p in itertools.pairwise(t))
    n, v = sum(one.values()), len(one)
    def middle(c):
        if not c:
            return 0.0
        level = next(k for k in itertools.count(1) if base**k > c + 1e-6)
        low, high = math.ceil(base ** (level - 1)), math.ceil(base**level) - 1
        return (low + max(low, high)) / 2
    out = []
    for t in tokens:
        model = 0.0
        for h, w in zip([0, *t], t, strict=False):
            p = (middle(one[w]) + 0.1) / (n + 0.1 * (v + 1))
            if one[h]:
                p = (min(middle(two[h, w]), middle(one[h]), middle(one[w])) + prior * p) / (middle(one[h]) + prior)
            model += math.log10(p)
        out.append((len(t), sum(one[w] > 0 for w in t), sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), model))
    return n, out


@pytest.mark.parametrize(("chunk", "region"), [(2_000_000, 2_000_000), (50, 20)])
def test_language_model(spark, monkeypatch, chunk, region):
    monkeypatch.setattr(lm_score, "CHUNK", chunk)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, range(1, 41), k=rng.randrange(30)))) for i in range(120)] + [(None, "w1 q"), (130, None), (131, ""), (5, "A b\tA"), (20, "é unseen"), (7, "x " * 5000)]
    n, plain = plain_scores([t for _, t in rows], [i is not None and zlib.crc32(str(i).encode()) % 10 > 0 for i, _ in rows])
    want = sorted((str(i), *x[:2], n, round(x[2], 6), round(x[3], 6)) for (i, _), x in zip(rows, plain, strict=True))
    extra = [F.lit(1).alias(c) for c in ("id", "train", "chunk", "words", "score", "n_tokens")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *extra)
    got = lm_score.score(df, langid.remainder("doc_id", 10) != 0, bits_per_entry=200, region_tokens=region).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert lm_score.score(df.limit(0), F.lit(True)).collect() == []
    alone = {r["doc_id"]: (r["n_known"], r["train_tokens"]) for r in lm_score.score(df, F.lit(False)).collect()}
    assert set(alone.values()) == {(0, 0)}


def test_log_frequency_filter():
    rng = np.random.default_rng(6)
    grams, counts = rng.integers(0, 2**63, 4000, dtype=np.uint64), rng.geometric(0.1, 4000)
    counts[:3] = 2**32 + 3, 2**40, 2**55
    levels = lm_score.levels_of(counts, 1.5)
    f = lm_score.Region(int(levels.sum()), 12, 6)
    f.insert(grams, levels)
    got = f.levels(grams)
    assert (got >= levels).all() and (got == levels).mean() > 0.97  # never under, seldom over
    assert (f.levels(rng.integers(0, 2**63, 4000, dtype=np.uint64)) > 0).mean() < 0.05
    assert lm_score.count_of(int(lm_score.levels_of(np.array([2**32 + 3]), 1.5)[0]), 1.5) == pytest.approx(2**32, rel=0.25)
    full = lm_score.Region(1, 12, 6)
    full.data[:] = 255
    full.insert(grams[:1], levels[:1])
    assert (full.levels(grams) == full.top).all()  # ends whatever it holds


def test_counts_of_64_bits_are_summed():
    pack = lambda x: lm_score.packed(np.array(x, np.uint64), "<u8")
    found, n, back, cut = lm_score._summed([pack([5, 4]), pack([5])], [pack([2**32 + 3, 1]), pack([4])])
    assert found.tolist() == [5, 9] and n.tolist() == [2**32 + 7, 1] and back.tolist() == [0, 1, 0] and cut.tolist() == [0, 2, 3]


@pytest.fixture(scope="module")
def pieces():
    return sp_sampling.load_pieces(queries.PIECES)


def every_segmentation(lattice, text):
    out = [((), 0.0)]
    for unit in sp_sampling._UNIT.findall("▁" + text.replace(" ", "▁")):
        edges, beta = lattice.edges(unit)
        def walk(i, edges=edges, n=len(unit)):
            return [((), 0.0)] if i == n else [((p, *s), w + x) for k, p, w in edges[i] for s, x in walk(i + k)]
        out = [(a + s, x + w - beta[0]) for a, x in out for s, w in walk(0)]
    return dict(out)


def test_segmentations_are_distinct_and_exact(pieces):
    rng, lattice = random.Random(7), sp_sampling.Lattice(pieces, 0.5)
    texts = [None, "", "a", " ", "the cat", "Hello  world\n x", "▁b ▁", "日本語 \x00\t", "é" * 60 + " abc", "x" * 100 + " the", "\U0001f600 ok"]
    texts += ["".join(rng.choice("abc theéß日▁\n") for _ in range(rng.randrange(40))) for _ in range(60)]
    for text, rows in zip(texts, sp_sampling.segment([str(i) for i in range(len(texts))], texts, pieces, 4, 0.5, 1, lattice), strict=True):
        assert 1 <= len(rows) <= 4 and len({tuple(r[0]) for r in rows}) == len(rows)
        assert all(b"".join(pieces["text"][i] for i in r[0]).decode() == (" " + text if text else "") for r in rows)
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True) and all(0 <= r[3] <= 1 for r in rows)


def test_as_many_segmentations_as_there_are(pieces):
    rng, lattice = random.Random(8), sp_sampling.Lattice(pieces, 0.5)
    texts = ["\n", "\n\n\n", "Z \n", "a \n b"] + ["".join(rng.choice("ab \n日\t") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    for text, rows in zip(texts, sp_sampling.segment([str(i) for i in range(len(texts))], texts, pieces, 5, 0.5, 2, lattice), strict=True):
        assert len(rows) == min(5, len(every_segmentation(lattice, text))), text
    long = " ".join(rng.choice(["\n", "the", "anst", "Z"]) for _ in range(3000))
    assert [len(rows) for rows in sp_sampling.segment(["1"], [long], pieces, 3, 0.5, 2, lattice)] == [3]


def test_sampling_without_replacement(pieces):
    lattice, n, text = sp_sampling.Lattice(pieces, 0.5), 4000, "the a"
    p = {s: math.exp(x) for s, x in every_segmentation(lattice, text).items()}
    assert sum(p.values()) == pytest.approx(1)
    out = sp_sampling.segment([f"k{i}" for i in range(n)], [text] * n, pieces, 3, 0.5, 3, lattice)
    second = {s: sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s) for s in p}
    for place, q in ((0, p), (1, second)):
        seen = collections.Counter(tuple(rows[place][0].tolist()) for rows in out)
        assert sum((seen[s] - n * q[s]) ** 2 / (n * q[s]) for s in q if n * q[s] > 5) < 25
    # inclusion scores weigh the sample back to the whole
    assert sum(math.exp(r[1]) / r[3] for rows in out for r in rows) / n == pytest.approx(1, abs=0.02)


def test_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (1, "the cat sat"), (None, "ü▁\n")], "doc_id long, text string")
    encoded = sp_sampling.encode(df, queries.PIECES, samples=2)
    got = sp_sampling.decode(encoded, queries.PIECES).collect()
    want = {1: "the cat sat", 2: "", 3: "", None: "ü▁\n"}
    assert all(r["text"] == want[r["doc_id"]] for r in got) and collections.Counter(r["doc_id"] for r in got)[1] == 4
    one = [sorted(tuple(r["ids"]) for r in encoded.where("doc_id = 1 and sample = 1").collect())]
    assert one[0][0] == one[0][1]  # seeded by the key
    assert sp_sampling.encode(df.limit(0), queries.PIECES).collect() == []
    broken = spark.createDataFrame([([3 + 0xE9],), (None,)], "ids array<int>")
    assert sorted(r["text"] for r in sp_sampling.decode(broken, queries.PIECES).collect()) == ["", "�"]


def test_simhash_and_pieces_with_long_texts_and_clashing_columns(spark):
    words = [f"w{i % 700}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, None), (None, "w1 w2"), (4, "w1 w2")]
    extra = ("id", "fp", "root", "component_id", "fingerprint", "u", "v", "bit", "half", "sample", "ids", "key", "least")
    df = spark.createDataFrame([(i, t, *("x",) * len(extra)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert got[2]["component_id"] == got[1]["component_id"] == 1 and got[4]["component_id"] == got[None]["component_id"] == 4
    assert got[1]["fingerprint"] == f"{plain_fingerprint(rows[0][1]):016x}" and got[3]["fingerprint"] == "0" * 16
    pieces = sp_sampling.decode(sp_sampling.encode(df.where("doc_id <= 2"), queries.PIECES, samples=2), queries.PIECES).collect()
    assert {(r["doc_id"], r["text"]) for r in pieces} == set(rows[:2]) and len(pieces) == 4


def test_pipeline_stages(spark):
    clean = [f"the {a} of {b} and that {c} is with this {a}{b} for it to be {c}{a} on" for a, b, c in itertools.product(["anst", "erle", "onwh"], ["inth", "edly"], ["tion", "ouha"])]
    passage = " ".join(f"bench{i}" for i in range(14))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s", 1), (100, clean[0], "en", "s", 1), (101, "x " + passage + " y", "en", "s", 1), (102, "12 34", "en", "s", 1), (103, None, None, None, None), (104, "write to me at a.b@c.de and that is the end of it", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one, two, three, four, five = [f for _, f in corpus_pipeline.STAGES]
    a = one(spark, docs, SF)
    assert a.columns == docs.columns and {r["doc_id"] for r in a.collect()} == {r[0] for r in rows} - {102, 103}
    b = two(spark, docs, SF)
    kept = collections.Counter(r["doc_id"] for r in b.collect())
    assert b.columns == docs.columns and kept[0] == 1 and kept[100] == 0 and kept[101] == kept[104] == 1
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = corpus_pipeline.decontam.contamination(docs, bench)
    assert {r["doc_id"] for r in found.where(F.size("spans") > 0).collect()} == {101}
    assert three(spark, docs, SF).columns == docs.columns
    d = {r["doc_id"]: r for r in four(spark, docs, SF).collect()}
    assert d[104]["text"] == "write to me at <EMAIL> and that is the end of it" and d[104]["n_chars"] == len(d[104]["text"]) and d[1]["text"] == clean[1]
    assert {r["doc_id"] for r in five(spark, docs, SF).collect()} == {r[0] for r in rows}
    assert all(f(spark, docs.limit(0), SF).count() == 0 for f in (one, two, three, four, five))


def plain_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def plain_groups(texts):
    sets = [plain_shingles(t) for t in texts]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return grouped([(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near(sets[i], sets[j])], range(len(texts)))


@pytest.mark.parametrize("small", (2, 16))
def test_near_copies_by_jaccard(spark, small):
    """Near copies on both sides of 0.8, a large cluster, a line in most texts, and short texts."""
    rng = random.Random(7)
    line = " ".join(f"line{i}" for i in range(12))
    texts = [None, "", " ", "a", "A", "a b c d", "a b c d e", line, line + " x", line + " y"]
    for length in (30, 60, 200, 900):
        for _ in range(6):
            words = [f"w{rng.randrange(5000)}" for _ in range(length)]
            for changes in (0, 0, 1, 2, length // 60, length // 45, length // 35):
                other = list(words)
                for at in rng.sample(range(length), changes):
                    other[at] = f"new{rng.randrange(10**6)}"
                texts.append(" ".join(other) + (" " + line if rng.random() < 0.6 else ""))
    words = [f"v{i}" for i in range(80)]
    texts += [" ".join(words[:k] + [f"u{k}x{r}"] + words[k + 1 :]) for k in range(0, 80, 2) for r in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, small=small).collect()}
    want, sets = plain_groups(texts), [plain_shingles(t) for t in texts]
    assert all(want[i] == want[root] for i, root in got.items())  # nothing below 0.8 is linked
    pairs = [(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), got[i] == got[j]) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] | sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(pairs) > 300 and sum(found for _, found in pairs) >= 0.95 * len(pairs) and all(found for similar, found in pairs if similar >= 0.9)
    one = lambda *ids: len({got[i] for i in ids}) == 1
    assert one(0, 1, 2) and one(3, 4) and not one(0, 3)
    named = docs.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"), "text", *[F.lit("x").alias(c) for c in ("id", "key", "cls", "size", "p0", "u", "look")])
    assert simhash.near_copies(named.union(named), small=small).count() == 2 * len(texts) and simhash.near_copies(docs.limit(0)).collect() == []


def test_pipeline_drops_near_copies(spark):
    """The case of the review: similar by 0.8 to 0.95, and far apart by SimHash."""
    rng = random.Random(8)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for c in range(2):
            other = list(words)
            for at in (rng.sample(range(10, 140), 1 + g % 3) if c else ()):
                other[at] = "other"
            rows.append((2 * g + c, " ".join(other), "en", "s", 1))
    want = {i for i, root in plain_groups([r[1] for r in rows]).items() if i == root}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert want == set(range(0, 24, 2))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == want


def test_pipeline_keeps_columns(spark):
    """Columns with the names that stages use inside, nulls, repeated rows and very long texts."""
    text = "the and of that with this is for it to be on the one of them and that is all of it"
    extra = ("row", "_row", "_n", "a", "b", "id", "key", "cls", "component_id", "spans", "items", "score", "lang_pred", "sample")
    rows = [(1, text), (1, text), (2, text + " "), (None, text), (3, None), (4, ""), (5, ("the and of that with this %d " * 3 % (1, 2, 3)) * 20_000), (None, "a quite other text of the one that is with it and for this to be on")]
    docs = spark.createDataFrame([(i, t, None, None, None, *extra) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    train = docs.select("doc_id", "text", F.lit("en").alias("lang"), *docs.columns[3:])
    kept = corpus_pipeline.identify_language(spark, train, SF)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "5", "None", "None"]
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "3", "5", "None"]
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated, corpus_pipeline.redact_personal_data):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(tuple(r)[5:] == extra for r in out.collect())
    assert {r["doc_id"] for r in corpus_pipeline.sample_pieces(spark, docs.where("doc_id < 5"), SF).collect()} == {1, 2, 3, 4}


def test_embedding_tiles_meet_once_in_any_groups(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 6))
    rows = [(i, int(i % 2), (centres[rng.integers(5)] + 0.1 * rng.normal(size=6)).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    unit = {i: np.array(x) / np.linalg.norm(x) for i, _, x in rows}
    assert {i: n for i, n, *_ in want} == {i: sum(j != i and k == label and float(unit[i] @ unit[j]) >= 0.93 for j, k, _ in rows) for i, label, _ in rows}
    for tile, group in ((40, 1), (7, 2_500)):
        assert sorted(map(tuple, embed_dedup.near_duplicates(df, tile=tile, group_bytes=group).collect())) == want


def test_tiles_left_out_cannot_link():
    rng = np.random.default_rng(3)
    left_out = 0
    for _ in range(300):
        a, b = (rng.normal(size=4) * 3 + rng.normal(size=(20, 4)) * rng.choice([0.05, 0.5, 2]) for _ in range(2))
        if not embed_dedup.can_meet(embed_dedup.ball(a), embed_dedup.ball(b), 0.9):
            left_out += 1
            unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)]
            assert (unit[0] @ unit[1].T).max() < 0.9
    assert left_out > 50
