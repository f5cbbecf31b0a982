"""Sets of word shingles and the exact check of candidate pairs by their Jaccard similarity.

Shingles and sets are told apart by 64-bit hashes.  A text without words (or null) has the
empty set; one with fewer words than a shingle is one shingle; texts of any length are read
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import keep

U = np.uint64
#: Bits of the broadcast filter of texts to be verified, and texts that a task remembers.
_WANTED, _HELD = 26, 200_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, U)
    hashes = np.fromiter(map(xxh64_intdigest, words), U, len(words))
    n, size = max(1, len(words) - shingle + 1), min(shingle, len(words))
    out = np.zeros(n, U)
    for i in range(size):
        out = mix(out * U(0xC2B2AE3D27D4EB4F) + hashes[i : i + n])
    return np.unique(out)


def class_of(found: np.ndarray) -> int:
    """The 64-bit name of a set."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def histogram(found: np.ndarray) -> bytes:
    """How many of a set's hashes end in each byte."""
    return np.bincount((found & U(255)).astype(np.int64), minlength=256).astype("<u4").tobytes()


def may_reach(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether a set with this histogram can have a similarity of 4/5 with those: they share no more than the smaller of each count."""
    return 9 * np.minimum(one, others).sum(1, dtype=np.int64) >= 4 * (one.sum(dtype=np.int64) + others.sum(1, dtype=np.int64))


def sets_of(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(``cls``, ``grams``) of each text of (``key``, ``text``) whose key is in ``wanted``; some others may come too.

    A filter of 8 MB says which keys are wanted, at any number of them; no other text is cut into words.
    """
    spark = texts.sparkSession
    bit = F.col("key").bitwiseAND((1 << _WANTED) - 1)
    parts = wanted.select(bit.alias("bit")).distinct().groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    held = np.zeros(1 << (_WANTED - 3), np.uint8)
    for r in parts.collect():  # 8 MB at most
        held[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            at = keys & ((1 << _WANTED) - 1)
            for i in np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                if keys[i] in seen:
                    continue
                seen = set() if len(seen) > _HELD else seen
                seen.add(keys[i])
                found = shingle_set(b.column(1)[i].as_py(), shingle)
                grams = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([class_of(found)], pa.int64()), grams], names=["cls", "grams"])

    return texts.select("key", "text").mapInArrow(run, "cls long, grams array<long>").dropDuplicates(["cls"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``u``, ``v``) of classes whose sets have a Jaccard similarity of 4/5 or more."""
    one, other = (sets.select(F.col("cls").alias(f"cls_{side}"), F.col("grams").alias(side)) for side in ("a", "b"))
    both = pairs.join(one, F.col("u") == F.col("cls_a")).join(other, F.col("v") == F.col("cls_b"))
    # |a n b| / |a u b| >= 4/5, as whole numbers
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")
