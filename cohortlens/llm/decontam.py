"""Benchmark decontamination by winnowing.

Words are hashed in k-grams; of each run of ``window - k + 1`` consecutive k-grams the one
with the smallest hash is kept.  Two texts that share ``window`` consecutive words share such a
run and so a kept hash at the same place in it.  A kept hash that the benchmark has too is
extended to the document's windows around it, each once; their hashes are looked up among all
windows of the benchmark and compared word by word, and items come in only for windows that do
occur.  So a phrase that many items share costs a document no more than one item's phrase.  Items
shorter than ``window`` are one window each, and are kept and looked up by their own length.

A benchmark of at most ``block_bytes`` of text (checked) is broadcast and documents are read
once, without a shuffle.  A larger one stays a table: kept hashes of documents (after a filter of
8 MB) are joined with its kept hashes, the windows around those that it has are joined with its
windows by their words, and those that occur with their items.  Both ways give the same rows, and
no row, item or hit is dropped at any size.

Edge cases: a null or empty text has no words, no hits and ``contaminated`` false; null or
wordless items match nothing; an item without an id marks words but is not listed; repeated
documents give equal rows; items with one id count once; an empty benchmark or an empty
table gives the same columns.  Only the named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import keep, with_id

#: Lower-cases A-Z and turns every byte that is not of a word into a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _coefficients(n: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive ids."""
    if len(ids) < k:
        return np.empty(0, np.uint64)
    n = len(ids) - k + 1
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_coefficients(k)):
        out += ids[j : j + n] * c
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """The places of the first smallest hash of each w consecutive ones, each once."""
    if len(hashes) < w:
        return np.empty(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(hashes, w).argmin(1) + np.arange(len(hashes) - w + 1)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range, its number once for each of its places, and the places."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def fingerprints(ids: np.ndarray, window: int, k: int) -> np.ndarray:
    """The places of the k-grams that are kept."""
    return winnow(_grams(ids, k), window - k + 1)


def build_index(items: list[tuple[str | None, str | None]], window: int, k: int) -> dict:
    """What a worker needs to mark documents against ``items`` (id as text, text)."""
    vocabulary: dict[bytes, int] = {}
    coded, names = [], []
    for name, text in items:
        words = words_of(text)
        if words:
            coded.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.uint64))
            names.append(name)
    # of each length of window (that of short items is their own): kept hashes, and distinct windows by hash with a place and their items
    lengths: dict[int, dict] = {}
    starts = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    words = np.concatenate(coded) if coded else np.empty(0, np.uint64)
    for m in sorted({min(window, len(c)) for c in coded}):
        own = [i for i, c in enumerate(coded) if min(window, len(c)) == m]
        size = min(k, m)
        hashes = np.unique(np.concatenate([_grams(coded[i], size)[fingerprints(coded[i], m, size)] for i in own]))
        grams = [_grams(coded[i], m) for i in own]
        item, place = np.repeat(own, [len(x) for x in grams]), np.concatenate([starts[i] + np.arange(len(x)) for i, x in zip(own, grams, strict=True)])
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        grams, item, place = grams[order], item[order], place[order]
        new = np.append(True, grams[1:] != grams[:-1])
        alike = np.flatnonzero(~new)  # equal hashes are one window only if their words are equal
        for s in range(0, len(alike), 65_536):
            at = alike[s : s + 65_536]
            new[at] = (words[place[at, None] + np.arange(m)] != words[place[at - 1, None] + np.arange(m)]).any(1)
        first = np.flatnonzero(new)
        lengths[m] = {"size": size, "hashes": hashes, "windows": grams[first], "places": place[first], "first": np.append(first, len(item)), "items": item}
    return {"vocabulary": vocabulary, "words": words, "names": names, "lengths": lengths}


def mark(texts: list[str | None], index: dict) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """Of each text the number of words, the hit spans of words (may overlap) and the items that occur."""
    get = index["vocabulary"].get
    flat: list[int] = []
    starts, counts = [], []
    for t in texts:
        starts.append(len(flat))
        words = words_of(t)
        counts.append(len(words))
        flat.extend(map(get, words, repeat(0)))
        flat.append(0)
    ids = np.array(flat, np.uint64)
    out: list[tuple[int, list[tuple[int, int]], set[int]]] = [(n, [], set()) for n in counts]
    bounds, gone = np.array(starts), np.concatenate([[0], np.cumsum(ids == 0)])
    for m, part in index["lengths"].items():
        size, grams = part["size"], _grams(ids, part["size"])
        at = winnow(grams, m - size + 1)
        at = at[gone[at + size] == gone[at]]  # a k-gram with a word that the benchmark lacks cannot match
        near = np.minimum(np.searchsorted(part["hashes"], grams[at]), len(part["hashes"]) - 1)
        at = at[part["hashes"][near] == grams[at]]
        spot = around(at, m - size + 1, len(ids) - m + 1)
        spot = spot[gone[spot + m] == gone[spot]]  # windows of words of the benchmark alone
        if not len(spot):
            continue
        whole = _grams(ids, m)[spot]
        which, place = _spread(np.searchsorted(part["windows"], whole, "left"), np.searchsorted(part["windows"], whole, "right"))
        same = np.zeros(len(which), bool)
        for s in range(0, len(which), 65_536):
            rows, found = spot[which[s : s + 65_536]], part["places"][place[s : s + 65_536]]
            same[s : s + 65_536] = (ids[rows[:, None] + np.arange(m)] == index["words"][found[:, None] + np.arange(m)]).all(1)
        spot, place = spot[which[same]], place[same]
        doc = np.searchsorted(bounds, spot, "right") - 1
        cuts = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            d, places = doc[a], spot[a:b] - starts[doc[a]]
            runs = np.flatnonzero(np.diff(places) > m) + 1  # runs of windows that touch are one span
            out[d][1].extend((int(x[0]), int(x[-1]) + m) for x in np.split(places, runs))
            for w in np.unique(place[a:b]).tolist():
                out[d][2].update(part["items"][part["first"][w] : part["first"][w + 1]].tolist())
    return out


def around(at: np.ndarray, n: int, end: int) -> np.ndarray:
    """The places from n - 1 before each of ``at`` (in order) up to it, each once, from 0 to before ``end``."""
    first = np.maximum(at - n + 1, np.concatenate([[0], at[:-1] + 1])) if len(at) else at
    return _spread(first, np.maximum(first, np.minimum(at + 1, end)))[1]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS = "spans array<struct<start:long,end:long>>, items array<string>"
#: Characters of text that are worked on at once; bits of the filter of an unbounded benchmark's hashes.
_CHUNK, _BITS = 2_000_000, 26


def _results(found: list, index: dict) -> list[pa.Array]:
    spans = [[{"start": s, "end": e} for s, e in _merged(f[1])] for f in found]
    items = [sorted({index["names"][x] for x in f[2] if index["names"][x] is not None}) for f in found]
    return [pa.array(spans, _FOUND), pa.array(items, pa.list_(pa.string()))]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < _CHUNK):
            size += len(texts[last] or "")
            last += 1
        yield first, last
        first = last


def _marked(source: DataFrame, items: list[tuple[str | None, str | None]], window: int, k: int, with_text: bool) -> DataFrame:
    """(``id``, ``text`` if asked for, ``n_words``, spans, items) against a benchmark that is broadcast."""
    shared = source.sparkSession.sparkContext.broadcast(build_index(items, window, k))
    carried = ["id", "text"] if with_text else ["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, last in _chunks(texts):
                found = mark(texts[first:last], index)
                part = [b.column(i).slice(first, last - first) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*part, pa.array([f[0] for f in found], pa.int64()), *_results(found, index)], names=[*carried, "n_words", "spans", "items"])

    return source.mapInArrow(run, with_id(source, "text string, " * with_text + f"n_words long, {_SPANS}"))


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _kept(ids: np.ndarray, m: int, k: int) -> np.ndarray:
    """Kept hashes of one length of window, told apart from those of other lengths."""
    size = min(k, m)
    return _grams(ids, size)[fingerprints(ids, m, size)] + np.uint64(m * 0x9E3779B97F4A7C15 % (1 << 64))


def _joined(source: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """The same against a benchmark of any size, by joins of kept hashes, then of windows, then of windows and items."""
    spark = source.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(1):
                words = _hashes(words_of(text.as_py()))
                m = min(window, len(words))
                found = np.unique(_kept(words, m, k)) if m else words
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), m, np.int32))], names=["hash", "m"])

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                m = min(window, len(words))
                found = sorted({b" ".join(words[i : i + m]) for i in range(len(words) - m + 1)} if m else ())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([name] * len(found), pa.string())], names=["words", "name"])

    prints, _ = keep(items.select("name", "text").mapInArrow(of_items, "hash long, m int").distinct(), "item_prints")
    windows, _ = keep(items.select("name", "text").mapInArrow(windows_of, "words binary, name string").distinct(), "item_windows")
    lengths = sorted(r["m"] for r in prints.select("m").distinct().collect())  # as many as the window has words at most
    bit = F.col("hash").bitwiseAND((1 << _BITS) - 1)
    parts = prints.select(bit.alias("bit")).distinct().groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    held = np.zeros(1 << (_BITS - 3), np.uint8)
    for r in parts.collect():  # 8 MB at most
        held[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(held)  # 8 MB

    # texts are told apart by 128 bits; equal ones are one from here on
    named = source.select("id", "text", F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b"))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for text, x, y in zip(b.column(0), b.column(1), b.column(2), strict=True):
                words = _hashes(words_of(text.as_py()))
                found = np.unique(np.concatenate([_kept(words, m, k) for m in lengths if m <= len(words)] or [words[:0]]))
                at = (found & np.uint64((1 << _BITS) - 1)).astype(np.int64)
                found = found[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([x.as_py()] * len(found), pa.int64()), pa.array([y.as_py()] * len(found), pa.int64())], names=["hash", "a", "b"])

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, text, hits in zip(*(b.column(c) for c in range(4)), strict=True):
                words = words_of(text.as_py())
                ids, hits = _hashes(words), np.sort(hits.values.to_numpy().view(np.uint64))
                start, size = [], []
                for m in lengths:
                    if m <= len(words):
                        n = min(k, m)
                        at = fingerprints(ids, m, n)
                        found = np.isin(_kept(ids, m, k), hits)
                        start.append(around(at[found], m - n + 1, len(ids) - m + 1))
                        size += [m] * len(start[-1])
                start = np.concatenate([*start, np.empty(0, np.int64)]).astype(np.int64)
                columns = [pa.array([x.as_py()] * len(start), pa.int64()), pa.array([y.as_py()] * len(start), pa.int64()), pa.array(start), pa.array(start + np.array(size, np.int64)), pa.array([b" ".join(words[s : s + m]) for s, m in zip(start.tolist(), size, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "start", "end", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [len(words_of(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], names=["id", "text", "a", "b", "n_words"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": s, "end": e} for s, e in _merged([(x["start"], x["end"]) for x in row])] for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _FOUND)], names=["a", "b", "spans"])

    asked = named.select("text", "a", "b").mapInArrow(of_docs, "hash long, a long, b long").distinct()
    hits = asked.join(prints.select("hash").distinct(), "hash", "left_semi").groupBy("a", "b").agg(F.collect_set("hash").alias("hits"))  # of a text's own hashes
    texts = named.select("a", "b", "text").where("text is not null").dropDuplicates(["a", "b"]).join(hits, ["a", "b"])
    near = texts.select("a", "b", "text", "hits").mapInArrow(extended, "a long, b long, start long, end long, words binary")
    found, _ = keep(near.join(windows.select("words").distinct(), "words", "left_semi"), "found")
    spans = found.groupBy("a", "b").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(merged, "a long, b long, spans array<struct<start:long,end:long>>")
    named_items = found.select("a", "b", "words").distinct().join(windows.where("name is not null"), "words").groupBy("a", "b").agg(F.array_sort(F.collect_set("name")).alias("items"))
    rows = named.mapInArrow(count, with_id(source, "text string, a long, b long, n_words long"))
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)"), F.expr("cast(array() as array<string>)")
    rows = rows.join(spans, ["a", "b"], "left").join(named_items, ["a", "b"], "left")
    return rows.select("id", "text", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = 10, k: int = 5, block_bytes: int = 8_000_000, with_text: bool = False) -> DataFrame:
    """Of each document: id, ``n_words``, merged hit ``spans`` of words and the sorted ``items`` (as strings) that occur; the ``text`` too if asked for."""
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = _marked(source, [(r["name"], r["text"]) for r in items.collect()], window, k, with_text) if total <= block_bytes else _joined(source, items, window, k)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items", *["text"] * with_text)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
