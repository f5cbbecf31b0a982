"""Language-model scores from a log-frequency Bloom filter.

The filter holds quantised counts of words and of pairs of adjacent tokens of all training
documents, however rare.  A count ``c`` is quantised to level ``1 + floor(log_base c)``; the
filter has (n-gram, level) for each level up to that, so a count is read back by probing
levels until one is missing.  The filter is cut into regions by hash.  Each region is sized
from the entries it gets (``bits_per_entry`` for each), so its error rate is the same for a
corpus of any size, and no region ever fills up.

A filter that holds all pairs grows with the corpus, so it can't be broadcast whole.
Probes come to the regions instead: texts are coded in chunks of bounded size; a chunk sends
each of its distinct n-grams once to the region of its hash, with its training count there.
The task of a region adds up the counts, fills the region, probes it for every chunk and
answers with levels, and with exact counts of words.  Answers meet their chunk again, which
is scored then.  So frequent words and pairs are hot nowhere (a chunk asks once), a task
holds one chunk or one region, and nothing but sums comes to the driver.

A token's probability after a history ``h`` that the filter knows is
``(c(h, t) + prior * p(t)) / (c(h) + prior)`` with ``p(t) = (c(t) + 0.1) / (N + 0.1 (V + 1))``,
else ``p(t)``, all counts read from the filter.  The base score has exact counts (words are
told apart by 64-bit hashes).

Edge cases: a null or empty text is its end token alone; documents without an id are not
trained on and not held out; repeated rows stay apart; without training documents every
count is 0; an empty table gives no rows; a text is coded whole, however long; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import keep

END = b" "  # no word holds a space
U = np.uint64
#: Tokens of a chunk (or one text, if that has more), its distinct words, and tokens of a region at most.
CHUNK, WORDS, REGION = 750_000, 250_000, 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), U, len(words))


def single(h: np.ndarray) -> np.ndarray:
    return _mix(h + U(0x9E3779B97F4A7C15))


def pair(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    return _mix(h * U(0xC2B2AE3D27D4EB4F) + _mix(t))


def packed(x: np.ndarray, kind: str) -> bytes:
    """Numbers as planes of bytes: of small ones, all but the first planes are zeros and cost nothing once compressed."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).ravel()


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    """The level of each count; 0 of none."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9), 0).astype(np.int64)


def count_of(level: int, base: float) -> float:
    """The middle of the counts of a level."""
    if level == 0:
        return 0.0
    low, high = math.ceil(base ** (level - 1) - 1e-9), math.ceil(base**level - 1e-9) - 1
    return (low + max(low, high)) / 2


class Region:
    """A log-frequency Bloom filter in blocks of 512 bits; all that is asked of a key lies in one line of memory."""

    def __init__(self, entries: int, bits_per_entry: float, probes: int) -> None:
        if not 1 <= probes <= 7:
            raise ValueError("from 1 to 7 probes")
        self.probes, self.blocks, self.top = probes, max(1, math.ceil(entries * bits_per_entry / 512)), 0
        self.data = np.zeros(self.blocks * 64, np.uint8)

    def _starts(self, keys: np.ndarray) -> np.ndarray:
        return (((_mix(keys) >> U(32)) * U(self.blocks)) >> U(32)).astype(np.int64) << 9

    def _bits(self, keys: np.ndarray, level: int) -> np.ndarray:
        return _mix(keys + U(level * 0xD6E8FEB86659FD93 % (1 << 64)))

    def insert(self, keys: np.ndarray, levels: np.ndarray) -> None:
        start, self.top = self._starts(keys), max(self.top, int(levels.max(initial=0)))
        for level in range(1, int(levels.max(initial=0)) + 1):
            some = levels >= level
            keys, start, levels = keys[some], start[some], levels[some]
            bits = self._bits(keys, level)
            for probe in range(self.probes):
                at = start + ((bits >> U(9 * probe)) & U(511)).astype(np.int64)
                np.bitwise_or.at(self.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level that repeated probes find for each key, 0 where the first is missing."""
        out, left, start = np.zeros(len(keys), np.uint8), np.arange(len(keys)), self._starts(keys)
        for level in range(1, self.top + 1):
            bits = self._bits(keys, level)
            for probe in range(self.probes):
                at = start + ((bits >> U(9 * probe)) & U(511)).astype(np.int64)
                hit = np.flatnonzero((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                keys, left, start, bits = keys[hit], left[hit], start[hit], bits[hit]
            if not len(keys):
                break
            out[left] = level
        return out


def _chunk_schema(source: DataFrame) -> T.StructType:
    kind = T.ArrayType(source.schema["id"].dataType)
    return T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", kind), *T.StructType.fromDDL("train binary, sizes binary, flat binary, words binary, n_tokens long").fields])


def coded_chunks(rows: DataFrame) -> DataFrame:
    """Texts of (``id``, ``text`` binary, ``train``) in chunks: ids, training flags, tokens of each text, tokens as places in the chunk's words, hashes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        place: dict[bytes, int] = defaultdict(count().__next__)  # a new word takes the next number
        place[END]
        flat: list[np.ndarray] = []
        starts, ids, train = [0], [], []

        def flush() -> pa.RecordBatch:
            nonlocal at
            blobs = (bytes(train), packed(np.diff(starts), "<u8"), packed(np.concatenate(flat), "<u4"), _word_hashes(list(place)).astype("<u8").tobytes())
            chosen = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), chosen)
            out = [pa.array([at], pa.int64()), listed, *[pa.array([x], pa.binary()) for x in blobs], pa.array([starts[-1]], pa.int64())]
            at += 1
            place.clear()
            place.default_factory = count().__next__
            place[END]
            for held in (flat, ids, train):
                held.clear()
            starts[:] = [0]
            return pa.RecordBatch.from_arrays(out, names=["chunk", "ids", "train", "sizes", "flat", "words", "n_tokens"])

        for b in batches:
            first = 0
            for i, (text, learn) in enumerate(zip(b.column(1), b.column(2).to_pylist(), strict=True)):
                text = text.as_py()
                if len(place) > WORDS or starts[-1] >= CHUNK:
                    if i > first:
                        ids.append(b.column(0).slice(first, i - first))
                    yield flush()
                    first = i
                found = list(map(place.__getitem__, text.lower().split())) if text else []
                found.append(0)
                flat.append(np.array(found, "<u4"))
                starts.append(starts[-1] + len(found))
                train.append(learn)
            if b.num_rows > first:
                ids.append(b.column(0).slice(first))
        if flat:
            yield flush()

    return rows.select("id", "text", "train").mapInArrow(run, _chunk_schema(rows))


class Chunk:
    """A coded chunk; n-grams in the order in which they go to the regions and answers come back."""

    def __init__(self, row: dict) -> None:
        self.train, self.hashes = np.frombuffer(row["train"], np.uint8), np.frombuffer(row["words"], "<u8")
        self.sizes, self.flat = unpacked(row["sizes"], "<u8").astype(np.int64), unpacked(row["flat"], "<u4")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        keys = single(self.hashes)
        self.order = np.argsort(keys, kind="stable")  # sorted keys are sorted by region too
        self.words = keys[self.order]
        inside = np.ones(max(0, len(self.flat) - 1), bool)
        inside[self.starts[1:-1] - 1] = False
        self.second = np.flatnonzero(inside) + 1  # the tokens that follow another one
        self.learnt = np.repeat(self.train, self.sizes).astype(bool)

    def pair_keys(self) -> np.ndarray:
        """Keys of the pairs that end in ``second``; the last bit is 0."""
        h = self.hashes[self.flat]
        return pair(h[self.second - 1], h[self.second]) & ~U(1)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.flat[self.learnt], minlength=len(self.hashes))[self.order]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct pairs and their training counts."""
        keys = np.sort(self.pair_keys() | self.learnt[self.second].astype(U))
        whole = keys & ~U(1)
        first = _firsts(whole)
        return whole[first], np.add.reduceat((keys & U(1)).astype(np.int64), first) if len(first) else np.empty(0, np.int64)


def _firsts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def region_of(keys: np.ndarray, regions: int) -> np.ndarray:
    return (((keys >> U(32)) * U(regions)) >> U(32)).astype(np.int64)


_PARTS = ("words", "word_counts", "pairs", "pair_counts")


def asked(chunks: DataFrame, regions: int) -> DataFrame:
    """Each chunk's distinct words and pairs with their training counts there, by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one at a time: a row is a whole chunk
                row = b.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row)
                parts, cuts = [], []
                for keys, counts in ((chunk.words, chunk.word_counts()), chunk.pairs()):
                    cuts.append(np.searchsorted(region_of(keys, regions), np.arange(regions + 1)))
                    parts += [(keys, cuts[-1], True), (counts, cuts[-1], False)]
                some = np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0))
                columns = [[packed(np.diff(x[cut[r] : cut[r + 1]], prepend=x[:1] * 0) if steps else x[cut[r] : cut[r + 1]], "<u8") for r in some] for x, cut, steps in parts]
                for s in range(0, len(some), 512):
                    part = [pa.array(some[s : s + 512], pa.int32()), pa.array(np.full(len(some[s : s + 512]), row["chunk"])), *[pa.array(c[s : s + 512], pa.binary()) for c in columns]]
                    yield pa.RecordBatch.from_arrays(part, names=["region", "chunk", *_PARTS])

    source = chunks.select("chunk", "train", "sizes", "flat", "words")
    return source.mapInArrow(run, "region int, chunk long, " + ", ".join(f"{c} binary" for c in _PARTS))


def _summed(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From sorted keys as steps, and counts: distinct keys, the sums of their counts (64 bits), each key's place among the distinct ones, and the first key of each chunk."""
    sizes = [len(k) // 8 for k in keys]
    every = np.concatenate([np.cumsum(unpacked(k, "<u8"), dtype=U) for k in keys])
    n = np.concatenate([unpacked(c, "<u8") for c in counts]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = _firsts(every)
    back = np.empty(len(every), np.int64)
    back[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(every)))
    return every[first], np.add.reduceat(n, first) if len(first) else n, back, np.cumsum([0, *sizes])


def answered(asks: DataFrame, base: float, probes: int, bits_per_entry: float) -> DataFrame:
    """The regions' answers to each chunk, and on one row of a region the sums of its words: training tokens and distinct words."""

    def answer(asks: pa.Table) -> pa.Table:
        columns = {c: asks.column(c).to_pylist() for c in _PARTS}
        words, n, word_back, word_cut = _summed(columns["words"], columns["word_counts"])
        pairs, m, pair_back, pair_cut = _summed(columns["pairs"], columns["pair_counts"])
        word_levels, pair_levels = levels_of(n, base), levels_of(m, base)
        region = Region(int(word_levels.sum() + pair_levels.sum()), bits_per_entry, probes)
        for keys, levels in ((words, word_levels), (pairs, pair_levels)):
            some = levels > 0
            region.insert(keys[some], levels[some])
        exact, word_levels, pair_levels = n[word_back], region.levels(words)[word_back], region.levels(pairs)[pair_back]
        rows = range(asks.num_rows)
        cut = lambda x, at, kind: pa.array([packed(x[at[i] : at[i + 1]], kind) for i in rows], pa.binary())
        once = lambda x: pa.array([int(x) if i == 0 else 0 for i in rows], pa.int64())
        parts = {"region": asks.column("region"), "chunk": asks.column("chunk"), "exact": cut(exact, word_cut, "<u8"), "word_levels": cut(word_levels, word_cut, "u1"), "pair_levels": cut(pair_levels, pair_cut, "u1")}
        return pa.table(parts | {"tokens": once(n.sum()), "distinct": once((n > 0).sum())})

    return asks.groupBy("region").applyInArrow(answer, "region int, chunk long, exact binary, word_levels binary, pair_levels binary, tokens long, distinct long")


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", prior: float = 100.0, base: float = 1.5, probes: int = 6, bits_per_entry: float = 12,
          region_tokens: int = REGION) -> DataFrame:
    """(``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``) of each row; ``train`` is the condition for training rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks, _ = keep(coded_chunks(rows), "chunks")
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    answers, _ = keep(answered(asked(chunks, max(64, -(-tokens // region_tokens))), base, probes, bits_per_entry), "answers")
    total, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    divisor = total + 0.1 * (distinct + 1)
    middle = np.array([count_of(level, base) for level in range(256)])

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        row, right = left.drop_columns(["ids"]).to_pylist()[0], right.sort_by("region")
        joined = lambda c, kind: np.concatenate([unpacked(x.as_py(), kind) for x in right.column(c)])
        chunk = Chunk(row)
        exact, known = np.empty(len(chunk.hashes)), np.empty(len(chunk.hashes))
        exact[chunk.order], known[chunk.order] = joined("exact", "<u8"), middle[joined("word_levels", "u1")]
        flat, starts = chunk.flat, chunk.starts[:-1]
        p = (known[flat] + 0.1) / divisor
        keys = chunk.pair_keys()
        distinct_keys, back = np.unique(keys, return_inverse=True)
        assert len(distinct_keys) == len(levels := joined("pair_levels", "u1"))
        h, t = known[flat[chunk.second - 1]], known[flat[chunk.second]]
        both = np.minimum(middle[levels][back], np.minimum(h, t))
        p[chunk.second] = np.where(h > 0, (both + prior * p[chunk.second]) / (h + prior), p[chunk.second])
        sums = lambda x: np.add.reduceat(x, starts)
        out = {"id": left.column("ids").combine_chunks().flatten(), "n_tokens": chunk.sizes, "n_known": sums((exact > 0)[flat].astype(np.int64)),
               "base_score": sums(np.log10((exact + 0.1) / divisor)[flat]), "score": sums(np.log10(p))}
        return pa.table(out)

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])
    asks = answers.select("chunk", "region", "exact", "word_levels", "pair_levels")
    out = chunks.drop("n_tokens").groupBy("chunk").cogroup(asks.groupBy("chunk")).applyInArrow(mark, schema)
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
