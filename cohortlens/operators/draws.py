"""Random subsets of a counted pool, made where they are used: member j of repeat r is an expression.

A keyed permutation of the places 0 to n - 1 sends j to the j-th member.  It is a Feistel network on pairs
(x div b, x mod b) with a * b >= n; a place beyond n goes through it again, until it falls below n.  The round
function squares modulo a prime, so any engine with 64-bit integers gives the same draws.  Nothing but
sizes comes to the driver, however many repeats there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.ranks import numbered
from cohortlens.sources.files import scratch

# Fixed values of the permutation: a prime below 2**31, what is added to squares, factors of the half, the round, the repeat and the seed.
PRIME, ADDED, FACTORS, ROUNDS = 2_147_483_647, 1_013_904_223, (40_503, 7_919_027, 104_729, 1_299_709), 6


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: np.ndarray, key: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where the permutation of each key sends each place."""
    a, b = sides(n)
    left, right = x // b, x % b

    def mixed(half: np.ndarray, i: int, key: np.ndarray) -> np.ndarray:
        v = (half * FACTORS[0] + i * FACTORS[1] + key * FACTORS[2] + seed * FACTORS[3]) % PRIME
        for _ in range(3):
            v = (v * v + ADDED) % PRIME
        return v

    todo = np.arange(len(x))
    while len(todo):
        for i in range(ROUNDS):
            if i % 2 == 0:
                left[todo] = (left[todo] + mixed(right[todo], i, key[todo])) % a
            else:
                right[todo] = (right[todo] + mixed(left[todo], i, key[todo])) % b
        todo = todo[left[todo] * b + right[todo] >= n]
    return left * b + right


def place_of(member: Column, repeat: Column, n: int, seed: int = 42) -> Column:
    """The place of a repeat's member, both counted from 0."""

    @F.pandas_udf("long")
    def drawn(j: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(permuted(j.to_numpy(np.int64).copy(), r.to_numpy(np.int64), n, seed))

    return drawn(member.cast("long"), repeat.cast("long"))


def keyed_draws(spark: SparkSession, n: int, sizes: dict[str, int], repeats: int, seed: int = 42, first: int = 0) -> DataFrame:
    """(``repeat_id``, ``role``, ``place``): disjoint subsets of 0 to n - 1 of the sizes of ``sizes``, in each repeat from ``first`` on."""
    total = sum(sizes.values())
    if total > n:
        raise ValueError(f"a pool of {n} for draws of {total}")
    role, upto = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        role = F.when((F.col("_j") >= upto) & (F.col("_j") < upto + size), F.lit(name)).otherwise(role)
        upto += size
    rows = spark.range(first, first + repeats).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    return rows.select(F.col("id").alias("repeat_id"), role.alias("role"), place_of(F.col("_j"), F.col("id"), n, seed).alias("place"))


def of_pool(drawn: DataFrame, places: DataFrame) -> DataFrame:
    """``drawn`` with the rows of a pool by ``place``.

    Draws are made by an explode, so the planner takes them for as many as repeats and would broadcast
    them; the pool is the side that is held, a partition of it at a time.
    """
    return drawn.join(places.hint("shuffle_hash"), "place")


def subset_at(number: int, n: int, size: int) -> list[int]:
    """The subset of a number in the order of sorted subsets."""
    out, least = [], 0
    for left in range(size, 0, -1):
        while (more := math.comb(n - least - 1, left - 1)) <= number:
            number -= more
            least += 1
        out.append(least)
        least += 1
    return out


def distinct_draws(spark: SparkSession, n: int, size: int, repeats: int, seed: int = 42) -> DataFrame:
    """(``repeat_id``, ``role`` ref, ``place``): distinct random subsets; all subsets, in order, if there are no more than asked for.

    Candidates are told apart by two hashes of their sorted members, and of equal ones the first stays;
    where some fall out, more are drawn, up to 50 times as many, and those that stay are numbered.
    """
    if size > n:
        raise ValueError(f"a pool of {n} for draws of {size}")
    every = math.comb(n, size)
    if every <= repeats:
        def unranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                places = [x for i in ids for x in subset_at(i, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), size)), pa.array(places, pa.int64())], names=["repeat_id", "place"])

        return spark.range(every).mapInArrow(unranked, "repeat_id long, place long").select("repeat_id", F.lit("ref").alias("role"), "place")
    tried = repeats
    while True:
        sets = keyed_draws(spark, n, {"ref": size}, tried, seed).groupBy("repeat_id").agg(F.array_sort(F.collect_list("place")).alias("members"))
        apart = [F.xxhash64("members"), F.xxhash64(F.lit(1), "members")]
        kept = sets.groupBy(apart[0].alias("_a"), apart[1].alias("_b")).agg(F.min_by(F.struct("repeat_id", "members"), "repeat_id").alias("_s")).select("_s.*")
        kept.write.parquet(path := scratch(spark, "sets"))
        kept = spark.read.schema(kept.schema).parquet(path)
        found = kept.count()
        if found >= repeats:
            break
        if tried >= 50 * repeats:
            raise ValueError(f"found only {found} distinct draws of {repeats}")
        tried = min(50 * repeats, 2 * tried)
    if tried > repeats:  # some fell out: the others close up
        kept = numbered(kept, ["repeat_id"], "_n").where(F.col("_n") <= repeats).withColumn("repeat_id", (F.col("_n") - 1).cast("long"))
    return kept.select("repeat_id", F.lit("ref").alias("role"), F.explode("members").alias("place"))
