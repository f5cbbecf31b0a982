"""Sweeps that are stopped and gone on with, and files matched to quality records."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import meta_etl, sweeps


def test_a_stopped_sweep_goes_on(spark, tmp_path):
    path, made = str(tmp_path / "sweep"), []

    def score(shard, stop=None):
        made.append(shard)
        if shard == stop:
            raise RuntimeError("stopped")
        return spark.range(10).select((F.col("id") % 3).alias("sample"), (F.col("id") + shard).alias("n"))

    with pytest.raises(RuntimeError, match="stopped"):
        sweeps.run_sweep(spark, path, range(5), lambda s: score(s, 2), {"seed": 1})
    assert sweeps.finished(spark, path) == [0, 1]
    # shard 3 was cut off while it wrote: its files are there, its mark isn't
    score(3).write.parquet(f"{path}/shard=3")
    os.remove(f"{path}/shard=3/_SUCCESS")
    made.clear()
    with pytest.raises(ValueError, match="without a result: \\[2, 3, 4\\]"):
        sweeps.summed(spark, path, ["sample"], ["n"], range(5))
    assert sweeps.run_sweep(spark, path, range(5), score, {"seed": 1}) == [2, 3, 4] == made
    assert sweeps.run_sweep(spark, path, range(5), score, {"seed": 1}) == []
    got = {r["sample"]: r["n"] for r in sweeps.summed(spark, path, ["sample"], ["n"], range(5)).collect()}
    assert got == {k: sum(i + s for s in range(5) for i in range(10) if i % 3 == k) for k in range(3)}
    assert {r["sample"]: r["n"] for r in sweeps.summed(spark, path, ["sample"], ["n"], [0]).collect()} == {k: sum(i for i in range(10) if i % 3 == k) for k in range(3)}
    with pytest.raises(ValueError, match="other parameters"):
        sweeps.run_sweep(spark, path, range(5), score, {"seed": 2})
    with pytest.raises(ValueError, match="no finished shard"):
        sweeps.summed(spark, str(tmp_path / "none"), ["sample"], ["n"])


def plain_map(files, qc):
    """File by file, with lists."""
    day = lambda t: datetime.datetime.strptime(t, "%Y%m%d").date() if t else None
    out = []
    for sample, bam, batch in files:
        own = [q for q in qc if q[0] == sample]
        other = sample[:-2] + {"H1": "S1", "S1": "H1"}[sample[-2:]] if sample[-2:] in ("H1", "S1") else None
        match, found = ("exact_sample", own) if own else ("hs_swap", [q for q in qc if q[0] == other])
        sets = {}
        for q in sorted(found, key=lambda q: (q[2] is None, q[2] or datetime.date.max, q[3])):
            sets.setdefault(q[1], q)
        if not sets:
            out.append((sample, bam, None, "missing", 0, "missing", None, None, None))
            continue
        d = day(batch[1:]) if batch[1:].isdigit() else None
        delta = lambda q: abs((q[2] - d).days) if d and q[2] else None  # noqa: E731,B023
        liked = lambda q: 0 if q[1].endswith("-XML") else 1 if "-XML" in q[1] else 2
        q = min(sets.values(), key=lambda q: (10**9 if delta(q) is None else delta(q), liked(q), q[1]))
        bams = len({f[1] for f in files if f[0] == sample})
        rule = "nearest_date" if len(sets) > 1 else "direct_singleton" if bams == 1 else "direct_single_qc"
        out.append((sample, bam, q[0], match, len(sets), rule, q[1], delta(q), q[3]))
    return out


def test_files_are_mapped_as_one_by_one(spark):
    draw = random.Random(12)
    date = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(draw.randrange(40))
    files = [(f"s{draw.randrange(25)}{draw.choice(['H1', 'S1', '', 'H2'])}", i, draw.choice(["none", f"b{date():%Y%m%d}"])) for i in range(200)]
    qc = [(f"s{draw.randrange(25)}{draw.choice(['H1', 'S1', ''])}", f"set{draw.randrange(30)}{draw.choice(['', '-XML', '-XML2'])}", draw.choice([None, date()]), float(i)) for i in range(60)]
    got = meta_etl.map_to_qc(spark.createDataFrame(files, "sample string, clean_bam long, batch string"), spark.createDataFrame([(*q, 1.0) for q in qc], "sample string, dataset string, dataset_date date, puc19 double, lambda double"))
    rows = got.select("sample", "clean_bam", "qc_sample", "sample_match", "n_qc_for_sample", "map_rule", "qc_dataset", "day_delta", "puc19").collect()
    want = plain_map(files, qc)
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert {w[5] for w in want} == {"missing", "nearest_date", "direct_singleton", "direct_single_qc"} and {w[3] for w in want} == {"missing", "exact_sample", "hs_swap"}
