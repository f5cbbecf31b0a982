"""Block products of repeats: the same rows as the joins, on made tracks with gaps and ties."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import blocks, draws, evaluate, resample, search


@pytest.fixture(scope="module")
def made(spark):
    rng, rows = random.Random(4), []
    for s in range(70):
        for c in range(1, 6):
            if (s, c) not in ((3, 1), (4, 2)):
                gap = lambda x: None if rng.random() < 0.05 else x
                flat = 1.0 if c == 5 and s < 20 else rng.gauss(0, 1)  # some references have no spread
                rows.append((s, f"chr{c}", gap(rng.gauss(0, 1) + 5 * (s % 9 == 0) * (c == 2)), gap(flat), gap(0.04 + rng.gauss(0, 0.003)), rng.randrange(3), rng.randrange(4)))
    tracks = spark.createDataFrame(rows, "sample long, chr string, hypo_z double, hyper_z double, percentage double, hypo_n long, hyper_n long").cache()
    truth = spark.createDataFrame([(s, s % 9 == 0, s % 13 == 0) for s in range(70)], "sample long, is_true boolean, forced_normal boolean").cache()
    drawn = draws.keyed_draws(spark, 60, {"ref": 4, "ez": 5}, 300, seed=9, first=200).withColumn("sample", F.when(F.col("repeat_id") % 10 == 0, F.col("place") % 20).otherwise(F.col("place"))).select("repeat_id", "role", "sample").distinct().cache()
    return tracks, truth, drawn


def same(a, b, keys):
    """Equal rows, numbers up to rounding."""
    assert sorted(a.columns) == sorted(b.columns)
    x, y = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (a, b))
    assert x.keys() == y.keys() and x
    for k in x:
        for c, v in x[k].items():
            assert v == (pytest.approx(y[k][c], abs=1e-7) if isinstance(v, float) and y[k][c] is not None else y[k][c]), (k, c, v, y[k][c])


@pytest.mark.parametrize("size", [1024, 16])
def test_one_track_equals_the_joins(made, monkeypatch, size):
    monkeypatch.setattr(blocks, "SLICE", size)
    tracks, truth, drawn = made
    ref, ez = drawn.where("role = 'ref'"), drawn.where("role = 'ez'")
    packed = blocks.pack(tracks, ["percentage"], truth)
    assert packed.slices == (1 if size == 1024 else 5)
    first = blocks.parameters(packed, ref)
    second = blocks.second_parameters(packed, first, ez)
    z = search.repeated_scores(tracks, ref, "percentage")
    flags = resample.signal_counts(evaluate.max_chr_flags(z, ["repeat_id"], [1.1, 3.0], "z"), ["cutoff"])
    same(blocks.signal_counts(packed, first, [1.1, 3.0]), flags, ["sample", "cutoff"])
    shares = z.groupBy("sample", "chr").agg((F.count_if(F.col("z") > 2) / F.count("*")).alias("ratio"))
    same(blocks.chromosome_shares(packed, first, 2.0), shares, ["sample", "chr"])
    calls = search.repeated_ez(z, ez, "z").join(truth, "sample")
    same(blocks.confusion(packed, first, 3.0, second), resample.best_repeat(calls, 3.0), ["repeat_id"])


@pytest.mark.parametrize("size", [1024, 16])
def test_combined_tracks_equal_the_joins(made, monkeypatch, size):
    monkeypatch.setattr(blocks, "SLICE", size)
    tracks, _, drawn = made
    ref, ez = drawn.where("role = 'ref'"), drawn.where("role = 'ez'")
    packed = blocks.pack(tracks, search.TRACKS)
    first = blocks.parameters(packed, ref)
    second = blocks.second_parameters(packed, first, ez)
    same(blocks.matrices(packed, first, second), search.reference_matrices(tracks, ref, ez), ["repeat_id", "chr"])
    want = search.signal_variants(tracks, ref, ez, ez_cutoffs=(2.0, 3.0)).select("sample", "chr", F.col("ez_high_ratio").alias("ratio"))
    same(blocks.chromosome_shares(packed, first, 3.0, second), want, ["sample", "chr"])


def test_nothing_gives_nothing(spark, made):
    tracks, truth, drawn = made
    packed = blocks.pack(tracks, ["percentage"], truth)
    none = blocks.parameters(packed, drawn.where("false"))
    assert none.collect() == [] and blocks.signal_counts(packed, none, [3.0]).collect() == []
    empty = blocks.pack(tracks.where("false"), ["percentage"], truth)
    assert blocks.signal_counts(empty, blocks.parameters(empty, drawn), [3.0]).collect() == []
