"""Draws by a keyed permutation: permutations, distinct sets, even shares, no lists on the driver."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import draws


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_every_key_is_a_permutation(n):
    for key in range(5):
        got = draws.permuted(np.arange(n), np.full(n, key), n, 42)
        assert sorted(got.tolist()) == list(range(n))
    a, b = draws.sides(n)
    assert a * b >= n and a * b - n < max(a, b) + 1


def test_members_are_even(spark):
    """Each place as often as any other, and each pair too: chi-squared within five deviations of its mean."""
    n, k, repeats = 12, 4, 20_000
    rows = np.stack([draws.permuted(np.full(repeats, j), np.arange(repeats), n, 1) for j in range(k)], axis=1)
    assert all(len(set(r)) == k for r in rows[:1000].tolist())
    ones = np.bincount(rows.ravel(), minlength=n)
    pairs = np.zeros((n, n))
    for i, j in itertools.permutations(range(k), 2):
        np.add.at(pairs, (rows[:, i], rows[:, j]), 1)
    for seen, free in ((ones, n - 1), (pairs[~np.eye(n, dtype=bool)], n * (n - 1) - 1)):
        chi = ((seen - seen.mean()) ** 2 / seen.mean()).sum()
        assert chi < 2 * (free + 5 * math.sqrt(2 * free)), chi
    assert abs(np.corrcoef(rows[:-1, 0], rows[1:, 0])[0, 1]) < 0.04  # neighbouring repeats have nothing to do with each other


def test_disjoint_roles(spark):
    rows = draws.keyed_draws(spark, 10, {"ref": 4, "ez": 6}, 50, first=7).collect()
    by = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in rows:
        by[r["repeat_id"]][r["role"]].add(r["place"])
    assert sorted(by) == list(range(7, 57)) and all(len(x["ref"]) == 4 and x["ref"] | x["ez"] == set(range(10)) for x in by.values())
    with pytest.raises(ValueError, match="a pool of 10"):
        draws.keyed_draws(spark, 10, {"ref": 5, "ez": 6}, 1)


def test_a_hundred_thousand_repeats(spark):
    """Two references of 40 from a pool of 96: eight million members, none of them on the driver or from a join."""
    df = draws.keyed_draws(spark, 96, {"ref": 40, "ez": 40}, 100_000)
    plan = df._jdf.queryExecution().toString()
    assert "Join" not in plan and "LocalRelation" not in plan and "LogicalRDD" not in plan
    got = df.groupBy("place", "role").agg(F.count("*").alias("n")).collect()
    assert len(got) == 2 * 96 and all(abs(r["n"] - 100_000 * 40 / 96) < 5 * math.sqrt(100_000 * 40 / 96) for r in got)


def test_draws_are_not_broadcast(spark, tmp_path):
    """The planner sees 50 rows where the explode makes 400,000: the pool is what a join holds."""
    spark.range(8_000).select(F.col("id").alias("place"), (F.col("id") * 3).alias("sample")).write.parquet(str(tmp_path / "pool"))
    drawn = draws.keyed_draws(spark, 8_000, {"ref": 4_000, "ez": 4_000}, 50)
    df = draws.of_pool(drawn, spark.read.parquet(str(tmp_path / "pool")))
    assert df.agg(F.count("*"), F.count_distinct("repeat_id", "sample"), F.count_if(F.col("sample") != F.col("place") * 3)).first()[:] == (400_000, 400_000, 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "ShuffledHashJoin" in plan


def test_distinct_sets(spark):
    for n, size, repeats in ((30, 4, 100), (6, 3, 19), (7, 2, 20)):  # the last two ask for nearly all sets, so many fall out
        by = collections.defaultdict(list)
        for r in draws.distinct_draws(spark, n, size, repeats, seed=3).collect():
            by[r["repeat_id"]].append(r["place"])
        assert sorted(by) == list(range(repeats)) and len({frozenset(x) for x in by.values()}) == repeats and {len(set(x)) for x in by.values()} == {size}
    every = collections.defaultdict(list)
    for r in draws.distinct_draws(spark, 6, 3, 20).collect():
        every[r["repeat_id"]].append(r["place"])
    assert [sorted(every[i]) for i in range(20)] == [list(c) for c in itertools.combinations(range(6), 3)]
    with pytest.raises(ValueError, match="a pool of"):
        draws.distinct_draws(spark, 2, 3, 5)
