"""The registered queries on the smallest tables: against their SQL, or against plain versions."""

import collections
import functools
import glob
import hashlib
import itertools
import math
import os
import re
import zlib

import duckdb
import pytest
import xxhash

import corpus_pipeline
from cohortlens.llm import langid, pii, queries, sp_sampling
from tests.llm.test_group_operators import plain_groups, plain_scores

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_sharding(spark, docs):
    got = queries.op2_sharding(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {d["doc_id"]: (len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode()), "bytes", None) for d in docs}
    shard = {r["doc_id"]: r["shard"] for r in got}
    groups, sums = collections.defaultdict(set), collections.Counter()
    for d in docs:
        groups[d["text"]].add(shard[d["doc_id"]])
    for r in got:
        sums[r["shard"]] += r["size"]
    largest = collections.Counter()
    for d in docs:
        largest[d["text"]] += len((d["text"] or "").encode()) + 1
    assert all(len(g) == 1 for g in groups.values()) and max(sums.values()) <= sum(sums.values()) / 8 + max(largest.values())
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_language_is_told_on_held_out_documents(spark, docs):
    got = {r["doc_id"]: r for r in queries.op3_langid(spark, SF).collect()}
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert got.keys() == {d["doc_id"] for d in docs} and {i for i, r in got.items() if r["held_out"]} == {d["doc_id"] for d in held}
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.95 * len(held)


def plain_words(text, bits=16):
    """(letters, script, trigram buckets) of each word, a run of letters of one script."""
    script = lambda c: next((i for i, r in enumerate(langid.SCRIPTS.values(), 1) if any(lo <= ord(c) <= hi for lo, hi in r)), 0)
    low = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    for is_word, run in itertools.groupby(text or "", key=lambda c: script(c) + 1 if c.isalpha() else 0):
        if is_word:
            letters, buckets = [low(c) for c in run], []
            for a, b, c in zip([0, *letters], letters, [*letters[1:], 0], strict=False):
                h = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ c * 0x165667B19E3779F9) % 2**64
                buckets.append((h ^ h >> 31) * 0x94D049BB133111EB % 2**64 >> 64 - bits)
            yield len(letters), is_word - 1, buckets


def plain_languages(train, texts, penalty=12.0, bits=16, smoothing=0.5):
    """(language, score, number of spans) of each text, from labelled (text, lang), with a Viterbi table in full."""
    langs = sorted({lang for text, lang in train if text is not None and lang is not None})
    grams, scripts = {g: collections.Counter() for g in langs}, {g: collections.Counter() for g in langs}
    for text, lang in train:
        if text is not None and lang is not None:
            for n, script, buckets in plain_words(text):
                grams[lang].update(buckets)
                scripts[lang][script] += n
    total = {g: sum(grams[g].values()) for g in langs}
    every = sum(total.values())
    @functools.cache
    def weight(bucket):
        rate = [math.log((grams[g][bucket] + smoothing * total[g] / every) / total[g]) for g in langs]
        return [x - sum(rate) / len(rate) for x in rate]
    written = lambda g, script: scripts[g][script] > 0 and scripts[g][script] >= 0.005 * sum(scripts[g].values())
    out = []
    for text in texts:
        words = list(plain_words(text))
        if not words:
            out.append(("und", 0.0, 0))
            continue
        rows = []
        for _, script, buckets in words:
            fits = [written(g, script) for g in langs]
            rows.append([sum(weight(b)[i] for b in buckets) if fit else 0.0 if not any(fits) else -1e6 for i, fit in enumerate(fits)])
        now, back = rows[0], []
        for row in rows[1:]:
            step = [max(range(len(langs)), key=lambda j, i=i: (now[j] - penalty * (j != i), j == i)) for i in range(len(langs))]
            now = [now[j] - penalty * (j != i) + row[i] for i, j in enumerate(step)]
            back.append(step)
        path = [max(range(len(langs)), key=now.__getitem__)]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        share = [sum(w[0] for w, p in zip(words, path, strict=True) if p == i) for i in range(len(langs))]
        best, n = share.index(max(share)), 1 + sum(a != b for a, b in itertools.pairwise(path))
        sums = [sum(r[i] for r in rows) for i in range(len(langs))]
        posterior = 1 / sum(math.exp(min(x - sums[best], 700)) for x in sums)
        out.append((langs[best], share[best] / sum(share) * (posterior if n == 1 else 1), n))
    return out


def test_languages(spark, docs):
    """Fit and prediction of the query against a plain model."""
    want = plain_languages([(d["text"], d["lang"]) for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5], [d["text"] for d in docs])
    got = {r["doc_id"]: r for r in queries.op3_langid(spark, SF).collect()}
    for d, (lang, score, spans) in zip(docs, want, strict=True):
        r = got[d["doc_id"]]
        assert (r["lang_pred"], r["n_spans"]) == (lang, spans) and r["score"] == pytest.approx(score, rel=1e-3), d["doc_id"]


def test_pipeline(spark, docs):
    """All stages over the whole table against plain versions of them."""
    left = []
    for d, (lang, score, _) in zip(docs, plain_languages([(d["text"], d["lang"]) for d in docs], [d["text"] for d in docs]), strict=True):
        if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            left.append(d)
    groups = plain_groups([d["text"] for d in left])
    least = {}
    for i, d in enumerate(left):
        least[groups[i]] = min(least.get(groups[i], d["doc_id"]), d["doc_id"])
    left = [d for d in left if d["doc_id"] in set(least.values())]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = collections.defaultdict(set)
    for (text,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect():
        own = words(text)
        m = min(10, len(own))
        windows[m] |= {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if own else set()
    clean = lambda own: not any(tuple(own[i : i + m]) in found for m, found in windows.items() for i in range(len(own) - m + 1))
    left = [d for d in left if clean(words(d["text"]))]
    automaton = pii.build_automaton()
    want = {d["doc_id"]: pii.redact_text(d["text"], pii.find_spans(d["text"], automaton)) for d in left}
    assert 100 < len(want) < len(docs) and any(want[d["doc_id"]] != d["text"] for d in left)
    got = collections.defaultdict(list)
    for r in sp_sampling.decode(corpus_pipeline.run(spark, SF), queries.PIECES).collect():
        got[r["doc_id"]].append(r)
    assert {i: {r["text"] for r in rows} for i, rows in got.items()} == {i: {t} for i, t in want.items()}
    assert all(1 <= len(rows) <= 3 and len({tuple(r["ids"]) for r in rows}) == len(rows) and [r["sample"] for r in sorted(rows, key=lambda r: r["sample"])] == list(range(1, len(rows) + 1)) for rows in got.values())


def test_language_model(spark, docs):
    tokens = {d["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", low(d["text"])), None] for d in docs}
    out = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0 for d in docs}
    c = collections.Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in queries.op4_lm_score(spark, SF).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    held = [got[i] for i in out if out[i]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    _, plain = plain_scores([d["text"] for d in docs], [not out[d["doc_id"]] for d in docs])
    # 12 bits an entry give some half percent of false probes, each of which changes one token by a level
    off = [abs(got[d["doc_id"]]["score"] - x[3]) / x[0] for d, x in zip(docs, plain, strict=True)]
    assert max(off) < 0.1 and sum(off) / len(off) < 0.01


def test_personal_data(spark, docs):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum(x - 9 * (x > 9) for i, c in enumerate(d[::-1]) for x in [int(c) * (1 + i % 2)]) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, SF).collect()}
    some = 0
    for d in docs:
        spans = [(k, m.start(), m.end()) for k, p in base.items() for m in re.finditer(p, d["text"] or "") if ok(k, m[0])]
        some += len(spans)
        r = got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in base] == [sum(s[0] == k for s in spans) for k in base]
    assert some


def test_pieces_spell_the_texts(spark, docs):
    want = {d["doc_id"]: hashlib.sha256((d["text"] or "").encode()).hexdigest() for d in docs}
    got = queries.op8_sentencepiece(spark, SF).collect()
    assert {r["text_sha256"] == want[r["doc_id"]] for r in got} == {True}
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by.keys() == want.keys()
    for rows in by.values():
        assert sorted(r["sample"] for r in rows) == list(range(1, len(rows) + 1)) and len({r["ids_xxh64"] for r in rows}) == len(rows)
    assert sum(len(rows) == 3 for rows in by.values()) >= 0.95 * len(by)


def test_piece_probabilities(spark, docs):
    """Log probabilities of the query's samples from plain sums over all segmentations, and one threshold behind a text's inclusion scores."""
    pieces = sp_sampling.load_pieces(queries.PIECES)
    normal, first, last = pieces["normal"], min(pieces["normal"].values()), max(pieces["normal"].values())
    of_byte = -0.5 * math.log(last - first + 200)
    weight = lambda i: -0.5 * math.log(i - first + 100) if i in places else of_byte
    places, longest = set(normal.values()), max(map(len, normal))

    @functools.cache
    def mass(unit):
        out = [0.0] * (len(unit) + 1)
        for i in range(len(unit) - 1, -1, -1):
            terms = [weight(normal[unit[i:j]]) + out[j] for j in range(i + 1, min(len(unit), i + longest) + 1) if unit[i:j] in normal]
            if unit[i] not in normal:
                terms.append(of_byte * len(unit[i].encode()) + out[i + 1])
            top = max(terms)
            out[i] = top + math.log(sum(math.exp(t - top) for t in terms))
        return out[0]

    whole = {d["doc_id"]: sum(mass(u) for u in sp_sampling._UNIT.findall("▁" + d["text"].replace(" ", "▁"))) if d["text"] else 0.0 for d in docs}
    rows = collections.defaultdict(list)
    for r in sp_sampling.encode(spark.read.parquet(f"{SF}/documents.parquet"), queries.PIECES).collect():
        rows[r["doc_id"]].append(r)
    for doc, found in rows.items():
        kappas = []
        for r in found:
            assert r["log_prob"] == pytest.approx(sum(weight(i) for i in r["ids"]) - whole[doc], abs=1e-3 + 1e-5 * len(r["ids"]))
            assert 0 <= r["inclusion"] <= 1
            if 1e-6 < r["inclusion"] < 1 - 1e-6:
                kappas.append(r["log_prob"] - math.log(-math.log1p(-r["inclusion"])))
        assert [r["perturbed"] for r in sorted(found, key=lambda r: r["sample"])] == sorted((r["perturbed"] for r in found), reverse=True)
        if len(kappas) > 1:
            assert max(kappas) - min(kappas) < 1e-3 and max(kappas) <= min(r["perturbed"] for r in found) + 1e-3


def test_simhash(spark, docs):
    prints = {}
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", low(d["text"]))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))] if words else []
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0
    up = {i: i for i in prints}
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()} == {(i, f"{f:016x}", root(i)) for i, f in prints.items()}
