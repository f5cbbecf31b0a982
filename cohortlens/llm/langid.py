"""Language identification: script ranges, word scores, and Viterbi over words.

Fit: hashed counts of letter trigrams (with word ends) by language, and the scripts each
language is written in, from a bounded sample of labelled rows: at most ``max_docs`` rows a
language, taken by a hash of the id, whole texts.  The model is ``2**bits`` rows of one float
a language, so its size is bounded and it is broadcast.

Predict: a word is a run of letters of one script.  Its script narrows the candidate
languages to those seen in that script; its score for each is the sum of its trigrams' log
likelihoods.  Viterbi with a switching penalty labels all words of the text, and runs of one
label are the spans.  (A text in which no stretch of words is better off by more than half
the penalty under another language than under the best one keeps one label: then no path
with switches can win, and the path is known without the recursion.)

The prediction is the language with most letters; its score is its share of letters times
its posterior over the whole text.  Edge cases: a null text, or one without letters, is
``und`` with score 0; without labelled rows every text is ``und``; ties go to the language
first in order; texts are read whole; repeated rows give equal rows; columns besides those
named are not looked at, and ``lang`` is read for the fit alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import with_id

# First and last code point of the ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
UNDETERMINED = "und"
#: Characters that are worked on at once; a longer text is a piece of its own.
_CHUNK = 500_000
#: A word's score for a language that isn't written in its script.
_NEVER = -1e6


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its simple lower-case form (0 if it is no letter) and its script (0: other)."""
    lower = np.zeros(sys.maxunicode + 1, np.uint32)
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            small = x.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            script[lo : hi + 1] = i
    return lower, script


def _features(texts: list[str], bits: int):
    """Of the texts laid end to end: trigram bucket of each letter, first letter and text of each word, and so on."""
    lower, scripts = _characters()
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    cp, script = lower[raw], scripts[raw]
    letter = cp > 0
    joined = letter[1:] & letter[:-1] & (script[1:] == script[:-1])
    same_before = np.concatenate([[False], joined])
    same_after = np.concatenate([joined, [False]])
    at = np.flatnonzero(letter)
    here = cp[at].astype(np.uint64)
    before = np.where(same_before[at], cp[at - 1], 0).astype(np.uint64)
    after = np.where(same_after[at], cp[np.minimum(at + 1, len(cp) - 1)], 0).astype(np.uint64)
    h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (here * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    first = np.flatnonzero(~same_before[at])  # letters that begin a word
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]
    return (h >> np.uint64(64 - bits)).astype(np.int64), first, at, script[at[first]], starts, ends


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word (rows) when a change of label costs ``penalty``; ties go to the first label, and to staying."""
    n, k = scores.shape
    if n == 0:
        return np.empty(0, np.int64)
    total = scores.sum(0)
    best = int(total.argmax())
    path = np.concatenate([np.zeros((1, k)), np.cumsum(scores - scores[:, [best]], 0)])
    if (path - np.minimum.accumulate(path, 0)).max() <= penalty / 2:
        return np.full(n, best)
    back: list[list[int]] = []
    now = scores[0].tolist()
    labels = range(k)
    for row in scores[1:].tolist():
        top = max(labels, key=now.__getitem__)
        bar = now[top] - penalty
        come = [i if now[i] >= bar else top for i in labels]
        now = [(now[i] if now[i] >= bar else bar) + row[i] for i in labels]
        back.append(come)
    out = [max(labels, key=now.__getitem__)]
    for come in reversed(back):
        out.append(come[out[-1]])
    return np.array(out[::-1])


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 4000, bits: int = 16, smoothing: float = 0.5) -> dict:
    """The model, from labelled ``rows``; at most about ``max_docs`` of each language are read, chosen by a hash of the id."""
    spark = rows.sparkSession
    rows = rows.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(257).collect()}
    if len(sizes) > 256:
        raise ValueError("more than 256 languages: the model would not be bounded")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "bits": bits}
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_docs / sizes[lang]))])
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")
    order = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), (1 << bits) + 32), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bucket, first, at, script, _, _ = _features([text], bits)
                row = counts[order[lang]]
                row += np.bincount(bucket, minlength=len(row))
                letters = np.diff(first, append=len(at))
                row += np.bincount((1 << bits) + script.astype(np.int64), letters, len(row)).astype(np.int64)
        lang, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(place, pa.int32()), pa.array(counts[lang, place])], names=["lang", "place", "n"])

    # the sample is bounded, so a few tasks do; without this every task of the scan would send a table
    counted = sample.repartition(8).mapInArrow(run, "lang int, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(langs), (1 << bits) + 32))
    got = counted.toPandas()
    counts[got["lang"], got["place"]] = got["n"]
    trigrams, scripts = counts[:, : 1 << bits], counts[:, 1 << bits :]
    total = trigrams.sum(1, keepdims=True) + 1e-9
    # the prior grows with the language's own size, so a trigram that no language has tells nothing
    rate = (trigrams + smoothing * total / total.sum()) / total
    table = np.log(rate)
    table -= table.mean(0)
    return {"langs": langs, "bits": bits, "table": np.ascontiguousarray(table.T.astype(np.float32)), "written": (scripts >= 0.005 * scripts.sum(1, keepdims=True)).T & (scripts.T > 0)}


def label(texts: list[str], model: dict, penalty: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text."""
    langs, nothing = model["langs"], (UNDETERMINED, 0.0, [])
    if not langs:
        return [nothing] * len(texts)
    bucket, first, at, script, starts, _ = _features(texts, model["bits"])
    if not len(at):
        return [nothing] * len(texts)
    scores = np.add.reduceat(model["table"][bucket], first, axis=0).astype(np.float64)
    candidate = model["written"][script]
    known = candidate.any(1)
    scores = np.where(candidate, scores, _NEVER)
    scores[~known] = 0.0
    letters = np.diff(first, append=len(at))
    begin = at[first]
    stop = at[np.append(first[1:], len(at)) - 1] + 1
    cut = np.searchsorted(begin, np.append(starts, len(np.atleast_1d(starts)) and begin[-1] + 1))
    out = []
    for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if lo == hi:
            out.append(nothing)
            continue
        own = scores[lo:hi]
        path = viterbi(own, penalty)
        weight = np.bincount(path, letters[lo:hi], len(langs))
        best = int(weight.argmax())
        total = own.sum(0)
        posterior = 1 / np.exp(np.minimum(total - total[best], 700)).sum()
        change = np.flatnonzero(np.diff(path)) + 1
        spans = [(int(begin[lo + a] - starts[i]), int(stop[lo + b - 1] - starts[i]), langs[path[a]]) for a, b in zip([0, *change], [*change, hi - lo], strict=True)]
        share = weight[best] / weight.sum()
        out.append((langs[best], float(share * (posterior if len(spans) == 1 else 1.0)), spans))
    return out


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0, with_text: bool = False) -> DataFrame:
    """(``id_col``, ``lang_pred``, ``score``, ``spans``, and the ``text`` if asked for) of each row; no shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts, found, first = [t or "" for t in b.column(1).to_pylist()], [], 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) < _CHUNK):
                    size += len(texts[last])
                    last += 1
                found += label(texts[first:last], model, penalty)
                first = last
            spans = pa.array([[{"start": s, "end": e, "lang": g} for s, e, g in f[2]] for f in found], span)
            columns = {"id": b.column(0), "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64()), "spans": spans}
            columns |= {"text": b.column(1)} if with_text else {}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return source.mapInArrow(run, with_id(source, "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>" + ", text string" * with_text)).withColumnRenamed("id", id_col)


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))
