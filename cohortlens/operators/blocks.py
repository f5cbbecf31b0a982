"""Sweeps over repeated references as products of blocks.

Samples are dealt into slices, each one row: a matrix of samples by chromosome and track.  Members of
repeats are dealt into blocks of repeats by slice, each one row too.  A block's membership is a 0/1 matrix,
so the sums and sums of squares of all its references are two matrix products with the slice; they
are added over slices and become parameters.  Every block of parameters then meets every slice, and scores
are made and reduced in the tile: what is shuffled are members, parameters and counts, never a row for
each repeat, sample and chromosome.  A tile's memory is set by the sizes of slices and blocks alone.

The rules are those of the joins (:mod:`cohortlens.operators.search`): a mean without values is 0, a
spread of zero or without values gives no score, and a missing score is not above a cutoff.  Scores are
equal up to rounding, as spreads come from sums of squares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import mcc

#: Samples of a slice, repeats of a block, and repeats that are scored at once.
SLICE, BLOCK, STEP = 1024, 256, 16
TRACKS, COUNTS = ("hypo_z", "hyper_z", "percentage"), ("hypo_n", "hyper_n")


class Tracks(NamedTuple):
    """Packed samples: (slice, samples, values, there, truth) as rows, the chromosomes and tracks that values have, and the number of slices."""

    rows: DataFrame
    chromosomes: list[str]
    values: list[str]
    slices: int


def _slice(n: int):
    return F.pmod(F.xxhash64("sample"), F.lit(n)).cast("int")


def pack(rows: DataFrame, values: list[str], truth: DataFrame | None = None) -> Tracks:
    """Rows (sample, chr, ``values``) as slices; ``truth`` has (sample, is_true, forced_normal).  Of repeated (sample, chr) the last one counts."""
    names = sorted(r["chr"] for r in rows.select("chr").where("chr is not null").distinct().collect())  # two dozen
    slices = max(1, math.ceil(rows.select("sample").distinct().count() / SLICE))
    columns = [*values, *(COUNTS if len(values) > 1 else ())]
    if truth is not None:
        rows = rows.join(truth.select("sample", "is_true", "forced_normal"), "sample")
    else:
        rows = rows.withColumns({"is_true": F.lit(False), "forced_normal": F.lit(False)})
    rows = rows.where("chr is not null").select(_slice(slices).alias("slice"), F.col("sample").cast("long").alias("sample"), "chr", *[F.col(c).cast("double").alias(c) for c in columns], "is_true", "forced_normal")

    def gather(t: pa.Table) -> pa.Table:
        samples, at = np.unique(t.column("sample").to_numpy(), return_inverse=True)
        chrom = np.searchsorted(names, t.column("chr").to_pylist())
        x, there = np.full((len(samples), len(names), len(columns)), np.nan), np.zeros((len(samples), len(names)), bool)
        there[at, chrom] = True
        for i, c in enumerate(columns):
            x[at, chrom, i] = t.column(c).to_numpy(zero_copy_only=False)
        known = np.zeros((len(samples), 2), bool)
        for i, c in enumerate(("is_true", "forced_normal")):
            known[at, i] = t.column(c).to_numpy(zero_copy_only=False).astype(bool)
        return pa.table({"slice": t.column("slice").slice(0, 1), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in (("samples", samples), ("values", x), ("there", there), ("truth", known))}})

    packed = rows.groupBy("slice").applyInArrow(gather, "slice int, samples binary, values binary, there binary, truth binary")
    return Tracks(packed, names, list(values), slices)


def pack_members(draws: DataFrame, slices: int) -> DataFrame:
    """(block, slice, repeats, samples) of draws (repeat_id, sample)."""
    rows = draws.select(F.floor(F.col("repeat_id") / BLOCK).cast("long").alias("block"), _slice(slices).alias("slice"), F.col("repeat_id").cast("long").alias("r"), F.col("sample").cast("long").alias("s")).distinct()

    def gather(t: pa.Table) -> pa.Table:
        return pa.table({c: t.column(c).slice(0, 1) for c in ("block", "slice")} | {n: pa.array([t.column(c).to_numpy().tobytes()], pa.binary()) for n, c in (("repeats", "r"), ("members", "s"))})

    return rows.groupBy("block", "slice").applyInArrow(gather, "block long, slice int, repeats binary, members binary")


def _matrix(row: dict, tracks: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    samples = np.frombuffer(row["samples"], np.int64)
    return samples, np.frombuffer(row["values"], np.float64).reshape(len(samples), *tracks)


def _sums(member: np.ndarray, at: np.ndarray, x: np.ndarray, number: int) -> list[np.ndarray]:
    """Of each repeat (``member``: place in the block) over its samples (``at``): counts, sums, sums of squares, least and largest of the columns of x."""
    inside = np.zeros((number, len(x)))
    inside[member, at] = 1
    some = ~np.isnan(x)
    zero = np.where(some, x, 0.0)
    least, most = np.full((number, x.shape[1]), np.inf), np.full((number, x.shape[1]), -np.inf)
    order = np.argsort(member, kind="stable")
    first = np.flatnonzero(np.diff(member[order], prepend=-1))
    if len(first):
        own = member[order][first]
        least[own] = np.minimum.reduceat(np.where(some, x, np.inf)[at[order]], first)
        most[own] = np.maximum.reduceat(np.where(some, x, -np.inf)[at[order]], first)
    return [inside @ some, inside @ zero, inside @ (zero * zero), least, most]


_PARTS = ("n", "total", "squares", "least", "most")


def _parameters(parts: DataFrame, columns: int) -> DataFrame:
    """(block, repeats, mean, sd) from the sums of each slice."""

    def add(t: pa.Table) -> pa.Table:
        held = [np.stack([np.frombuffer(b, np.float64).reshape(-1, columns) for b in t.column(c).to_pylist()]) for c in _PARTS]
        n, total, squares, least, most = held[0].sum(0), held[1].sum(0), held[2].sum(0), held[3].min(0), held[4].max(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(n > 0, total / n, 0.0)
            sd = np.sqrt(np.maximum(0.0, squares / n - mean * mean))
        sd = np.where(n == 0, np.nan, np.where(least == most, 0.0, sd))  # equal values have no spread, whatever rounding says
        there = np.frombuffer(b"".join(t.column("seen").to_pylist()), bool).reshape(t.num_rows, -1).any(0)
        return pa.table({"block": t.column("block").slice(0, 1), "seen": pa.array([there.tobytes()], pa.binary()), "mean": pa.array([mean.tobytes()], pa.binary()), "sd": pa.array([sd.tobytes()], pa.binary())})

    return parts.groupBy("block").applyInArrow(add, "block long, seen binary, mean binary, sd binary")


def _partial(tracks: Tracks, members: DataFrame, value) -> DataFrame:
    """Sums of ``value(row, samples' values)`` over each repeat's samples of a slice."""
    shape = (len(tracks.chromosomes), len(tracks.values) + (len(COUNTS) if len(tracks.values) > 1 else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                samples, x = _matrix(row, shape)
                member, who = np.frombuffer(row["repeats"], np.int64) % BLOCK, np.frombuffer(row["members"], np.int64)
                seen = np.zeros(BLOCK, bool)
                seen[member] = True
                at = np.minimum(np.searchsorted(samples, who), len(samples) - 1)
                known = samples[at] == who
                sums = value(row, x, member[known], at[known])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *(pa.array([s.astype(np.float64).tobytes()], pa.binary()) for s in sums), pa.array([seen.tobytes()], pa.binary())], names=["block", *_PARTS, "seen"])

    met = members.join(tracks.rows, "slice")
    return met.mapInArrow(run, "block long, " + ", ".join(f"{p} binary" for p in _PARTS) + ", seen binary")


def parameters(tracks: Tracks, draws: DataFrame) -> DataFrame:
    """Blocks of each repeat's mean and SD of every track by chromosome."""
    v = len(tracks.values)

    def of_tracks(row: dict, x: np.ndarray, member: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        return _sums(member, at, x[:, :, :v].reshape(len(x), -1), BLOCK)

    return _parameters(_partial(tracks, pack_members(draws, tracks.slices), of_tracks), len(tracks.chromosomes) * v)


def scored(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, combined: bool) -> np.ndarray:
    """Scores (repeats by samples by chromosomes) of values (samples by chromosomes by tracks) against parameters (repeats by chromosomes by tracks)."""
    v = mean.shape[2]
    with np.errstate(invalid="ignore", divide="ignore"):
        z = (x[None, :, :, :v] - mean[:, None]) / np.where(sd == 0, np.nan, sd)[:, None]
        if not combined:
            return z[..., 0]
        low, high = x[None, :, :, v], x[None, :, :, v + 1]
        inter = (z[..., 1] * np.sqrt(high) - z[..., 0] * np.sqrt(low)) / np.sqrt(high + low)
    return np.where(np.isnan(inter), 0.0, inter) + z[..., 2]


def second_parameters(tracks: Tracks, first: DataFrame, draws: DataFrame) -> DataFrame:
    """Blocks of the mean and SD of each repeat's score by chromosome over its second reference."""
    c, v = len(tracks.chromosomes), len(tracks.values)

    def of_scores(row: dict, x: np.ndarray, member: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        mean, sd = (np.frombuffer(row[k], np.float64).reshape(BLOCK, c, v) for k in ("mean", "sd"))
        out = [np.zeros((BLOCK, c)) for _ in range(3)] + [np.full((BLOCK, c), np.inf), np.full((BLOCK, c), -np.inf)]
        for r in np.unique(member).tolist():  # a repeat's members alone are scored
            own = at[member == r]
            s = scored(x[own], mean[r : r + 1], sd[r : r + 1], v > 1)[0]
            for to, part in zip(out, _sums(np.zeros(len(own), np.int64), np.arange(len(own)), s, 1), strict=True):
                to[r] = part[0]
        return out

    members = pack_members(draws, tracks.slices).join(first.drop("seen"), "block")
    return _parameters(_partial(tracks, members, of_scores), c)


def _tiles(tracks: Tracks, first: DataFrame, second: DataFrame | None) -> DataFrame:
    """Every block of parameters with every slice of samples, a row each."""
    params = first if second is None else first.join(second.select("block", F.col("mean").alias("ez_mean"), F.col("sd").alias("ez_sd")), "block")
    return params.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(tracks.slices - 1)))).join(tracks.rows, "slice")


def _scores_of(row: dict, shape: tuple[int, int], c: int, v: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(repeat ids, samples, scores) of a tile, some repeats at a time; a place without a row has none."""
    samples, x = _matrix(row, shape)
    mean, sd = (np.frombuffer(row[k], np.float64).reshape(BLOCK, c, v) for k in ("mean", "sd"))
    seen = np.flatnonzero(np.frombuffer(row["seen"], bool))
    for i in range(0, len(seen), STEP):
        own = seen[i : i + STEP]
        s = scored(x, mean[own], sd[own], v > 1)
        if "ez_mean" in row:
            m, d = (np.frombuffer(row[k], np.float64).reshape(BLOCK, c)[own][:, None] for k in ("ez_mean", "ez_sd"))
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (s - m) / np.where(d == 0, np.nan, d)
        yield row["block"] * BLOCK + own, samples, s


def signal_counts(tracks: Tracks, first: DataFrame, cutoffs: list[float], second: DataFrame | None = None) -> DataFrame:
    """(``sample``, ``cutoff``, ``n_abnormal``, ``n_total``): in how many repeats a sample's largest score is above a cutoff."""
    c, v = len(tracks.chromosomes), len(tracks.values)
    shape = (c, v + (len(COUNTS) if v > 1 else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                above, total, samples = 0, 0, np.empty(0, np.int64)
                for own, samples, s in _scores_of(row, shape, c, v):
                    top = np.where(np.isnan(s), -np.inf, s).max(2)
                    above = above + np.stack([(top > cut).sum(0) for cut in cutoffs], axis=1)
                    total += len(own)
                if total:
                    yield pa.RecordBatch.from_arrays([pa.array(samples.repeat(len(cutoffs))), pa.array(list(cutoffs) * len(samples), pa.float64()), pa.array(above.ravel()), pa.array(np.full(above.size, total))], names=["sample", "cutoff", "n_abnormal", "n_total"])

    counts = _tiles(tracks, first, second).mapInArrow(run, "sample long, cutoff double, n_abnormal long, n_total long")
    return counts.groupBy("sample", "cutoff").agg(F.sum("n_abnormal").alias("n_abnormal"), F.sum("n_total").alias("n_total"))


def chromosome_shares(tracks: Tracks, first: DataFrame, cutoff: float, second: DataFrame | None = None) -> DataFrame:
    """(``sample``, ``chr``, ``ratio``): the share of repeats in which a chromosome's score is above the cutoff."""
    c, v = len(tracks.chromosomes), len(tracks.values)
    shape = (c, v + (len(COUNTS) if v > 1 else 0))
    names = np.array(tracks.chromosomes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                above, total, samples = 0, 0, np.empty(0, np.int64)
                for own, samples, s in _scores_of(row, shape, c, v):
                    above, total = above + (np.where(np.isnan(s), -np.inf, s) > cutoff).sum(0), total + len(own)
                if total:
                    i, j = np.nonzero(np.frombuffer(row["there"], bool).reshape(len(samples), c))
                    yield pa.RecordBatch.from_arrays([pa.array(samples[i]), pa.array(names[j].tolist(), pa.string()), pa.array(above[i, j]), pa.array(np.full(len(i), total))], names=["sample", "chr", "n", "total"])

    counts = _tiles(tracks, first, second).mapInArrow(run, "sample long, chr string, n long, total long")
    return counts.groupBy("sample", "chr").agg((F.sum("n") / F.sum("total")).alias("ratio"))


def confusion(tracks: Tracks, first: DataFrame, cutoff: float, second: DataFrame | None = None) -> DataFrame:
    """(``repeat_id``, ``tp``, ``fp``, ``fn``, ``tn``, ``mcc``) of each repeat over all samples; samples held normal are called so."""
    c, v = len(tracks.chromosomes), len(tracks.values)
    shape = (c, v + (len(COUNTS) if v > 1 else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for own, samples, s in _scores_of(row, shape, c, v):
                    true, forced = np.frombuffer(row["truth"], bool).reshape(len(samples), 2).T
                    y = (np.where(np.isnan(s), -np.inf, s).max(2) > cutoff) & ~forced
                    counts = [(y & true).sum(1), (y & ~true).sum(1), (~y & true).sum(1), (~y & ~true).sum(1)]
                    yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, counts)], names=["repeat_id", "tp", "fp", "fn", "tn"])

    counts = _tiles(tracks, first, second).mapInArrow(run, "repeat_id long, tp long, fp long, fn long, tn long")
    names = ("tp", "fp", "fn", "tn")
    return counts.groupBy("repeat_id").agg(*[F.sum(n).alias(n) for n in names]).withColumn("mcc", mcc(*[F.col(n) for n in names]))


def matrices(tracks: Tracks, first: DataFrame, second: DataFrame) -> DataFrame:
    """Each repeat's reference matrices as rows: mean and SD of every track by chromosome, and of the score over the second reference."""
    names, values = tracks.chromosomes, tracks.values
    fields = [f"{t}_{k}" for t in values for k in ("mean", "sd")] + ["ez_mean", "ez_sd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                own = np.flatnonzero(np.frombuffer(row["seen"], bool))
                mean, sd = (np.frombuffer(row[k], np.float64).reshape(BLOCK, len(names), len(values))[own].reshape(-1, len(values)) for k in ("mean", "sd"))
                ez = [np.frombuffer(row[k], np.float64).reshape(BLOCK, len(names))[own].ravel() for k in ("ez_mean", "ez_sd")]
                columns = [a for i in range(len(values)) for a in (mean[:, i], sd[:, i])] + ez
                yield pa.RecordBatch.from_arrays([pa.array((row["block"] * BLOCK + own).repeat(len(names))), pa.array(names * len(own), pa.string()), *(pa.array(a, pa.float64(), mask=np.isnan(a)) for a in columns)], names=["repeat_id", "chr", *fields])

    rows = first.join(second.select("block", F.col("mean").alias("ez_mean"), F.col("sd").alias("ez_sd")), "block")
    return rows.mapInArrow(run, "repeat_id long, chr string, " + ", ".join(f"{f} double" for f in fields))
