"""Counts and quantiles by numbers: against brute force and Spark's own exact aggregate."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ranks
from cohortlens.operators import reads as R


def test_points_inside_equals_brute_force(spark):
    draw = random.Random(3)
    points = [(draw.choice(["chr1", "chr2"]), draw.choice([7, 7, draw.randrange(5000)])) for _ in range(300)] + [("chr1", None), ("chr3", -1500)]
    spans = [(i, draw.choice(["chr1", "chr2", "chr3", "chr4", None]), draw.randrange(-2000, 5000), draw.randrange(-2000, 5000)) for i in range(300)]
    spans += [(i, "chr1", 7, 7) for i in range(300, 450)] + [(450, "chr1", None, 7), (451, "chr1", None, None), (452, "chr1", 0, 10**9), (452, "chr1", 0, 10**9)]
    df = spark.createDataFrame(spans, "id long, chr string, start long, end long")
    got = R.points_inside(df, spark.createDataFrame(points, "chr string, pos long"), width=100).collect()

    def inside(c, a, b):
        ends = [x for x in (a, b) if x is not None]
        return sum(p is not None and k == c and min(ends) <= p <= max(ends) for k, p in points) if ends else 0

    assert sorted(map(tuple, got), key=str) == sorted(((*s, inside(*s[1:])) for s in spans), key=str)
    assert df.columns + ["n_points"] == R.points_inside(df, df.select("chr", F.col("start").alias("pos"))).columns


def test_chromosome_long_intervals_cost_no_more(spark):
    """A million intervals of up to 100 million positions: no interval is spread over its bins."""
    points = spark.range(20_000).select(F.lit("chr1").alias("chr"), (F.col("id") * 5_000).alias("pos"))
    spans = spark.range(1_000_000).select("id", F.lit("chr1").alias("chr"), (F.col("id") % 1000).alias("start"), (F.lit(100_000_000) - F.col("id") % 777).alias("end"))
    df = R.points_inside(spans, points)
    assert "Generate explode(sequence" not in df._jdf.queryExecution().toString()
    got = df.groupBy("n_points").agg(F.count("*").alias("n")).collect()
    places = [i * 5_000 for i in range(20_000)]
    want = {}
    for a in range(1000):
        n = len(places) - bisect.bisect_left(places, a)
        want[n] = want.get(n, 0) + 1000
    assert {r["n_points"]: r["n"] for r in got} == want


@pytest.mark.parametrize("accuracy", [2, 7, 100, 10_000])
def test_quantiles_equal_the_exact_aggregate(spark, accuracy):
    draw = random.Random(5)
    rows = [("hot", draw.gauss(0, 1)) for _ in range(4000)] + [("ties", float(draw.randrange(3))) for _ in range(500)] + [("one", 2.5), ("two", 1.0), ("two", 2.0), ("none", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p1": 1.0}
    want = {r["k"]: r.asDict() for r in df.where("k <> 'none'").groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in at.items()]).collect()}
    got = {r["k"]: r.asDict() for r in ranks.exact_quantiles(df, ["k"], "v", at, accuracy).collect()}
    for k in want:
        if k is not None:  # a null key meets no bracket
            assert got[k] == pytest.approx(want[k])
    whole = ranks.exact_quantiles(df, [], "v", {"m": 0.5}, accuracy).first()["m"]
    assert whole == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0])
    assert ranks.exact_quantiles(df.where("false"), ["k"], "v", at).collect() == []


def test_quantiles_gather_no_key(spark):
    """The largest number of rows of one key that meet is bounded by the bracket, not by the key."""
    df = spark.range(200_000).select(F.lit("x").alias("k"), (F.hash("id") / 7.0).alias("v"))
    plan = ranks.exact_quantiles(df, ["k"], "v", {"m": 0.5}, 1_000)
    assert "percentile(" not in plan._jdf.queryExecution().toString()
    held = df.select("k", F.col("v").alias("_v"))
    lo, hi = held.agg(F.percentile("_v", 0.498), F.percentile("_v", 0.502)).first()
    assert held.where((F.col("_v") >= lo) & (F.col("_v") <= hi)).count() < 1_000
    assert plan.first()["m"] == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0])
