"""Operators on hand-made rows: edges, identities, brute force."""

import datetime
import itertools
import math
import random
import re
import subprocess
import sys
import uuid

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import admission, draws, evaluate, meta_etl, methyl, panel, ranks, resample, scores, search, snp
from cohortlens.operators import reads as R
from cohortlens.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    nan = F.lit(float("nan"))
    assert one(spark, S.absent(nan)) is None
    assert one(spark, S.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, S.z_value(F.lit(1.0), F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, S.number(F.lit("n/a"))) is None and one(spark, S.number(F.lit("1e3"))) == 1000.0
    assert [one(spark, S.chr_name(F.lit(x))) for x in ("1", "chr1", "23", "chr24", "x")] == ["chr1", "chr1", "chrX", "chrY", "chrX"]
    assert [one(spark, S.plain_decimal(F.lit(x))) for x in (0.5, 1.0, 0.05)] == ["0.5", "1", "0.05"]
    assert one(spark, S.fixed6(F.lit(None).cast("double"))) is None and one(spark, S.fixed6(F.lit(1234.5))) == "1234.500000"
    assert one(spark, S.mcc(*[F.lit(x) for x in (0, 0, 5, 5)])) == 0.0 and one(spark, S.mcc(*[F.lit(x) for x in (0, 0, 5, 5)], empty=None)) is None
    assert one(spark, S.logsumexp([F.lit(float("-inf"))] * 3)) == float("-inf")


def test_six_decimals_as_c_prints_them(spark):
    """Ties of the exact value go to the even digit, and what only looks like a tie goes where the double is."""
    import duckdb

    values = [0.0078125, 0.0234375, -0.0078125, 5e-7, 2.5e-6, 0.1234565, 1.0000005, 0.0, 1e15 + 0.3, 1 / 3, 12345678901.1234565, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.fixed6(F.col("x")).alias("t"))
    want = [None if v is None else duckdb.execute("select printf('%.6f', ?::double)", [v]).fetchone()[0] for v in values]
    assert [r["t"] for r in df.collect()] == want and want[:4] == ["0.007812", "0.023438", "-0.007812", "0.000000"]


READS = "sample long, name string, chr string, start long, end long, text string, prob_class_1 double, insert_size long"


def test_split_is_inclusive_and_drops_nulls(spark):
    rows = [(1, "a", "chr1", 0, 5, "t", 0.5, 150), (1, "b", "chr1", 0, 5, "t", 0.49, 150), (1, "c", "chr1", 0, 5, "t", None, 150), (1, "a", "chr1", 9, 9, "t", 0.1, 151)]
    target, background = R.split_reads(spark.createDataFrame(rows, READS), 0.5, 150)
    assert [r["name"] for r in target.collect()] == ["a"]
    assert sorted(r["name"] for r in background.collect()) == ["a", "b"]  # a name can be on both sides
    with pytest.raises(ValueError):
        R.split_reads(target)


def test_replace_probability_of_repeated_names(spark):
    original = spark.createDataFrame([(1, "a", "c", 0, 1, "t", 0.1, 1), (1, "z", "c", 0, 1, "t", 0.2, 1)], READS)
    new = spark.createDataFrame([("a", 0.7), ("a", 0.9), ("q", 0.5), ("z", None)], "name string, prob_class_1 double")
    assert {r["name"]: r["prob_class_1"] for r in R.replace_probability(original, new).collect()} == {"a": 0.9, "z": 0.2}


def test_containing_a_point_with_short_and_long_reads(spark):
    rng = random.Random(0)
    reads = [(i, "n", rng.choice(["chr1", "chr2"]), s := rng.randrange(500), s + rng.choice([0, 3, 40, 300]), "t", 0.5, 1) for i in range(300)]
    points = [(rng.choice(["chr1", "chr2"]), rng.randrange(800)) for _ in range(25)]
    got = {r["sample"] for r in R.containing_a_point(spark.createDataFrame(reads, READS), spark.createDataFrame(points, "chr string, pos long"), 50).collect()}
    assert got == {r[0] for r in reads if any(c == r[2] and r[3] <= p <= r[4] for c, p in points)}


def test_points_inside_all_intervals(spark):
    from cohortlens.plans import cohort, core

    sf = "/root/testdata/sf0.001"
    points = {}
    for r in cohort.cpgs(spark, sf).select("chr", "start").collect():
        points.setdefault(r["chr"], []).append(r["start"])
    want = set()
    for r in cohort.table(spark, sf, "lineitem").selectExpr("l_orderkey as id", "l_linenumber as line", "l_partkey as part", "cast(l_quantity * 40 as bigint) as length").collect():
        start = r["part"] * 10
        end = start + (-r["length"] if r["line"] % 2 == 0 else r["length"])
        n = sum(min(start, end) <= p <= max(start, end) for p in points.get(f"chr{1 + r['part'] % 22}", []))
        want.add((r["id"], r["line"], f"chr{1 + r['part'] % 22}", start, end, r["length"], n, n >= 3))
    got = [tuple(r) for r in core.j9(spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want and any(r[0] % 20 for r in got)


def test_levels_and_z_by_hand(spark):
    sites = [(1, "chr1", 0, 1, 3, 1, -2), (1, "chr2", 0, 1, 1, 3, -1), (1, "chr3", 0, 1, 2, 2, -1), (1, "chr1", 5, 6, 9, 0, 0), (1, "chr1", 7, 8, 1, 1, 4)]
    z = methyl.intra_z(methyl.levels(spark.createDataFrame(sites, "sample long, chr string, start long, end long, meth long, unmeth long, meandiff long"), ["sample"]), ["sample"])
    got = {(r["chr"], r["direction"]): (r["beta"], r["z_intra"]) for r in z.collect()}
    assert got["chr1", "hypo"][0] == 0.75 and got["chr2", "hypo"][0] == 0.25
    sd = math.sqrt((0.25**2 + 0.25**2) / 3)
    assert got["chr1", "hypo"][1] == pytest.approx(0.25 / sd)
    assert got["chr1", "hyper"] == (0.5, None)  # one chromosome: no spread


def test_inter_score_of_absent_values_is_zero(spark):
    null = F.lit(None).cast("double")
    assert one(spark, scores.inter_score(null, F.lit(1.0), F.lit(0), F.lit(4))) == 0.0
    assert one(spark, scores.inter_score(F.lit(1.0), F.lit(2.0), F.lit(4), F.lit(9))) == pytest.approx((2 * 3 - 1 * 2) / math.sqrt(13))


def test_flags_and_alleles(spark):
    flags = lambda a, b: {f for f in (0, 16, 83, 99, 147, 163) if one(spark, snp.usable_flag(F.lit(a), F.lit(b), F.lit(f)))}
    assert flags("C", "T") == {16, 83, 163} and flags("G", "A") == flags("A", "G") == {0, 99, 147} and len(flags("A", "C")) == 6
    allele = lambda a, b, x: one(spark, snp.converted_allele(F.lit(a), F.lit(b), F.lit(x)))
    assert [allele("C", "A", x) for x in "CTAG"] == ["REF", "REF", "ALT", None]
    assert [allele("A", "G", x) for x in "AG"] == ["REF", "ALT"] and allele("T", "G", "A") == "ALT"


def test_decimals_of_steps():
    assert [snp.decimals_of(x) for x in (0.1, 0.01, 0.0001)] == [1, 2, 4]


def test_likelihood_has_its_maximum_where_it_was_made(spark):
    f, rows = 0.1, []
    for i in range(60):
        af = 0.1 + i * 0.01
        for g, own in enumerate((0.0, 0.5, 1.0)):
            fetal = (0.5 * af, 0.25 + 0.5 * af, 0.5 + 0.5 * af)[g]
            alt = round(1000 * ((1 - f) * own + f * fetal))
            rows.append(("chr1", i, af, 1000 - alt, alt))
    snps = spark.createDataFrame(rows, "chr string, pos long, af double, n_ref long, n_alt long")
    best, history = snp.narrowed_fraction(snps, 0.0, 0.5, 1e-3)
    assert best == pytest.approx(0.1, abs=0.005) and [h[0] for h in history] == [0.01, 0.001]


def test_folds_of_one_are_leave_one_out(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(c, s, rng.random() if rng.random() > 0.1 else None) for c in ("chr1", "chr2") for s in range(9)], "chr string, sample long, x double")
    folds = resample.fold_ids(rows.select("sample").distinct(), [], ["sample"], 9)
    a = {(r["chr"], r["sample"]): (r["x_mu"], r["x_sd"]) for r in resample.leave_out(rows, ["chr"], "x").collect()}
    b = {(r["chr"], r["sample"]): (r["x_mu"], r["x_sd"]) for r in resample.leave_out(rows.join(folds, "sample"), ["chr"], "x", "fold").collect()}
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], abs=1e-8) for k in a)


def test_two_folds_are_two_explicit_splits(spark):
    rows = [("chr1", s, float(s * s)) for s in range(7)]
    df = spark.createDataFrame(rows, "chr string, sample long, x double")
    folds = resample.fold_ids(df.select("sample"), [], ["sample"], 2)
    assert sorted((r["sample"], r["fold"]) for r in folds.collect()) == [(s, 0 if s < 4 else 1) for s in range(7)]
    got = {r["sample"]: r["x_mu"] for r in resample.leave_out(df.join(folds, "sample"), ["chr"], "x", "fold").collect()}
    assert got[0] == pytest.approx((16 + 25 + 36) / 3) and got[6] == pytest.approx((0 + 1 + 4 + 9) / 4)


def test_unique_draws(spark):
    rows = resample.unique_draws(spark, list(range(30)), 4, 100, seed=1).collect()
    members = {}
    for r in rows:
        members.setdefault(r["repeat_id"], set()).add(r["sample"])
    assert len(members) == 100 and len({frozenset(m) for m in members.values()}) == 100 and {len(m) for m in members.values()} == {4}
    assert len(resample.unique_draws(spark, [1, 2, 3], 2, 100).collect()) == 6  # all three pairs


def test_unique_draws_query_has_all_normals(spark, monkeypatch):
    from cohortlens.plans import mixture

    rows = spark.range(3000).selectExpr("id * 7 as sample", "if(id % 2 = 0, 'Normal', 'Other') as label")
    want = sorted(map(tuple, resample.unique_draws(spark, [i * 7 for i in range(0, 3000, 2)], 3, 50).collect()))
    assert max(r[2] for r in want) > 14_000
    for parts in (2, 7):
        monkeypatch.setattr(mixture.C, "meta", lambda spark, sf, parts=parts: rows.repartition(parts))
        assert sorted(map(tuple, mixture.x11(spark, "").collect())) == want


def test_auc_and_delta_with_ties(spark):
    rng = random.Random(2)
    rows = [(1, i, float(rng.randrange(6)), rng.random() < 0.4) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, sample long, score double, positive boolean")
    p, n = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    want = sum((x > y) + (x == y) / 2 for x in p for y in n) / (len(p) * len(n))
    assert evaluate.roc_auc(df, ["k"]).first()["auc"] == pytest.approx(want)
    assert evaluate.cliffs_delta(df, ["k"]).first()["cliffs_delta"] == pytest.approx(2 * want - 1)
    assert evaluate.roc_auc(df.where("positive"), ["k"]).first()["auc"] is None


def test_mad_of_equal_values_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0)], "k string, x double")
    assert {r["mad_z"] for r in admission.mad_z(df, ["k"], "x").collect()} == {0.0}


def test_fisher_exact(spark):
    def p(a, b, c, d):
        pmf = lambda x: math.comb(a + b, x) * math.comb(c + d, a + c - x) / math.comb(a + b + c + d, a + c)
        own = pmf(a)
        return sum(q for x in range(max(0, a - d), min(a + b, a + c) + 1) if (q := pmf(x)) <= own * (1 + 1e-7))
    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (8, 2, 1, 5), (0, 0, 3, 4), (10, 10, 10, 10)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i long, in_bad long, in_good long, out_bad long, out_good long")
    got = {r["i"]: r["p_value"] for r in admission.fisher_exact(df).collect()}
    assert all(got[i] == pytest.approx(p(*t), abs=1e-9) for i, t in enumerate(tables))


def test_latest_probe_by_bins_is_that_of_brute_force(spark):
    rng = random.Random(31)
    probes = [(rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(60)) for _ in range(40)]
    sites = [(rng.choice("abc"), s := rng.randrange(600), s + 1, i) for i in range(200)] + [("a", None, None, 900)]
    want = {}
    for c, s, _, i in sites:
        found = [(ps, pe) for pc, ps, pe in probes if s is not None and pc == c and ps <= s]
        want[i] = max(found) if found else (None, None)
    p, q = spark.createDataFrame(probes, "chr string, start long, end long"), spark.createDataFrame(sites, "chr string, start long, end long, i long")
    for width in (10, 100_000):
        assert {r["i"]: (r["probe_start"], r["probe_end"]) for r in panel.latest_probe(q, p, width=width).collect()} == want


def test_nearest_record_is_that_of_brute_force(spark):
    rng, day = random.Random(32), lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    left = [(i, rng.choice("xyz"), day(rng.randrange(60))) for i in range(120)] + [(500, "x", None), (501, "w", day(1))]
    right = [(i, rng.choice("xyz"), day(rng.randrange(60))) for i in range(60)] + [(900, "x", None)]
    want = {}
    for i, k, d in left:
        near = [(abs((d - t).days), e) for e, w, t in right if w == k and t is not None] if d else []
        if near:
            want[i] = min(near)
    a, b = spark.createDataFrame(left, "i long, k string, d date"), spark.createDataFrame(right, "e long, k string, t date")
    got = meta_etl.nearest_record(a, b, ["k"], "d", "t", [F.col("e")]).collect()
    assert {r["i"]: (r["days"], r["e"]) for r in got} == want and len(got) == len(want)


def test_p_values(spark):
    df = spark.createDataFrame([(float(z) / 7,) for z in range(40)], "z double").withColumn("p", admission.two_sided_p(F.col("z")))
    assert all(r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)), abs=6e-7) for r in df.collect())
    fit = admission.uniform_fit(spark.createDataFrame([(40,), (30,), (50,)], "n long"), "n").first()
    assert fit["chi2"] == pytest.approx(5) and fit["p_value"] == pytest.approx(math.exp(-2.5), abs=0.01)
    assert admission.uniform_fit(spark.createDataFrame([(0,), (0,)], "n long"), "n").first()["p_value"] is None


def test_latest_probe_hides_an_overlapping_earlier_one(spark):
    probes = spark.createDataFrame([("chr1", 0, 100), ("chr1", 10, 12), ("chr2", 5, 6)], "chr string, start long, end long")
    sites = spark.createDataFrame([("chr1", 50, 51), ("chr1", 10, 11), ("chr1", 12, 13), ("chr2", 4, 5), ("chr3", 1, 2)], "chr string, start long, end long")
    for width in (100_000, 7, 1):
        again = {(r["chr"], r["start"]): r["probe_start"] for r in panel.latest_probe(sites, probes, width=width).collect()}
        assert again == {("chr1", 50): 10, ("chr1", 10): 10, ("chr1", 12): 10, ("chr2", 4): None, ("chr3", 1): None}
    got = {(r["chr"], r["start"]): r["probe_start"] for r in panel.latest_probe(sites, probes).collect()}
    assert got == {("chr1", 50): 10, ("chr1", 10): 10, ("chr1", 12): 10, ("chr2", 4): None, ("chr3", 1): None}
    assert [tuple(r) for r in panel.probes_over(sites, probes).collect()] == [("chr1", 10, 12)]


def test_greedy_subset_is_the_best_at_each_step(spark):
    rng = random.Random(3)
    values = {(s, p): rng.randrange(3) for s in range(24) for p in "abcd"}
    truth = {s: s % 3 == 0 for s in range(24)}
    def auc(parts):
        t = {s: sum(values[s, p] for p in parts) for s in truth}
        pairs = [(t[a] > t[b]) + (t[a] == t[b]) / 2 for a in truth if truth[a] for b in truth if not truth[b]]
        return sum(pairs) / len(pairs)
    got = search.greedy_subset(spark.createDataFrame([(s, p, v) for (s, p), v in values.items()], "sample long, part string, value int"), spark.createDataFrame(list(truth.items()), "sample long, positive boolean"), 3).orderBy("step").collect()
    have = []
    for row in got:
        best = max((round(auc([*have, p]), 9), -ord(p)) for p in "abcd" if p not in have)
        assert (round(row["auc"], 9), -ord(row["part"])) == best
        have.append(row["part"])


def test_greedy_shrink_keeps_the_mcc(spark):
    rng = random.Random(4)
    combos = [(0.3, 0.2), (0.3, 0.5), (0.5, 0.5), (0.5, 0.8)]
    rows = [(s, s % 4 != 0, c, t, r, rng.random() * 2 + (1.2 if s % 4 == 0 and c == "chr1" else 0)) for s in range(16) for c in ("chr1", "chr2") for t, r in combos]
    df = spark.createDataFrame(rows, "sample long, is_normal boolean, chr string, threshold double, recall double, score double")
    at = {(s, c, t, r): (n, x) for s, n, c, t, r, x in rows}
    def mcc(choice):
        y = {s: any(at[s, c, *choice[c]][1] > 2 for c in choice) for s in range(16)}
        tp, fp = (sum(y[s] and (s % 4 == 0) == want for s in y) for want in (True, False))
        fn, tn = (sum(not y[s] and (s % 4 == 0) == want for s in y) for want in (True, False))
        d = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
        return (tp * tn - fp * fn) / math.sqrt(d) if d else 0.0
    now = {"chr1": (0.3, 0.2), "chr2": (0.3, 0.2)}
    base = mcc(now)
    for _ in range(3):
        before = dict(now)
        for c in sorted(now, key=lambda c: (now[c][1], c)):
            better = [k for k in sorted(combos, key=lambda k: (-k[1], k[0])) if k[1] > now[c][1] and round(mcc({**now, c: k}), 9) >= round(base, 9)]
            now[c] = better[0] if better else now[c]
        if now == before:
            break
    start = spark.createDataFrame([("chr1", 0.3, 0.2), ("chr2", 0.3, 0.2)], "chr string, threshold double, recall double")
    assert {r["chr"]: (r["threshold"], r["recall"]) for r in search.greedy_shrink(df, start, 2.0).collect()} == now


def plain_tracks(rng, samples):
    return [(s, f"chr{c}", rng.gauss(0, 1) + (s % 5 == 0) * 3 * (c == 2), rng.gauss(0, 1), rng.gauss(5, 1) + (s % 7 == 0) * 6 * (c == 1), 4 + c, 9 - c) for s in range(samples) for c in (1, 2, 3)]


def plain_candidate(rows, draw, early, ez_refs):
    """(changed calls, compared samples, distance) of one reference."""
    at = {(s, c): r for s, c, *r in rows}
    names, samples = sorted({c for _, c in at}), sorted({s for s, _ in at})
    def params(some):
        out = {}
        for c in names:
            for v in range(3):
                x = [at[s, c][v] for s in some]
                m = sum(x) / len(x)
                out[c, v] = m, math.sqrt(sum((y - m) ** 2 for y in x) / len(x))
        return out
    def calls(p):
        z = lambda s, c, v: (at[s, c][v] - p[c, v][0]) / p[c, v][1]
        both = {(s, c): (z(s, c, 1) * math.sqrt(at[s, c][4]) - z(s, c, 0) * math.sqrt(at[s, c][3])) / math.sqrt(at[s, c][3] + at[s, c][4]) + z(s, c, 2) for s, c in at}
        out = {}
        for c in names:
            x = [both[s, c] for s in ez_refs]
            m = sum(x) / len(x)
            sd = math.sqrt(sum((y - m) ** 2 for y in x) / len(x))
            out |= {(s, c): ((e := (both[s, c] - m) / sd) > 4.5, 3 <= e <= 4.5) for s in samples}
        return out
    p, b = params(draw), params(early)
    new, old = calls(p), calls(b)
    compared = [s for s in samples if s not in early and s not in draw]
    scale = {k: x[1] if abs(x[1]) > 1e-8 else 1 for k, x in b.items()}
    return sum(any(new[s, c] != old[s, c] for c in names) for s in compared), len(compared), sum(((p[k][0] - b[k][0]) / scale[k]) ** 2 + ((p[k][1] - b[k][1]) / scale[k]) ** 2 for k in p)


def test_reference_candidates_and_stable_reference(spark):
    rng = random.Random(41)
    rows = plain_tracks(rng, 24)
    tracks = spark.createDataFrame(rows, "sample long, chr string, hypo_z double, hyper_z double, percentage double, hypo_n long, hyper_n long")
    early, ez_refs, pool = [1, 2, 3], [8, 9, 11, 12], [s for s in range(24) if s % 5 and s % 7]
    listed = lambda x: spark.createDataFrame([(s,) for s in x], "sample long")
    draws = [sorted(rng.sample(pool, 4)) for _ in range(12)]
    table = spark.createDataFrame([(i, s) for i, d in enumerate(draws) for s in d], "repeat_id long, sample long")
    got = {r["repeat_id"]: (r["n_changed"], r["n_compared"], r["distance"]) for r in search.reference_candidates(tracks, table, listed(early), listed(ez_refs)).collect()}
    for i, d in enumerate(draws):
        want = plain_candidate(rows, d, early, ez_refs)
        assert got[i][:2] == want[:2] and got[i][2] == pytest.approx(want[2])
    found = search.stable_reference(tracks, listed(early), listed(pool), listed(ez_refs), 4, n_random=30, swaps=30, block=10).collect()
    chosen = sorted(r["sample"] for r in found)
    want = plain_candidate(rows, chosen, early, ez_refs)
    assert len(chosen) == 4 and set(chosen) <= set(pool) and (found[0]["n_changed"], found[0]["distance"]) == (want[0], pytest.approx(want[2]))
    # no worse than the greedy fill, the random draws and what a quarter of all references are
    every = sorted((plain_candidate(rows, d, early, ez_refs)[::2], d) for d in map(list, itertools.combinations(pool, 4)))
    assert want[::2] <= every[len(every) // 20][0]
    fill = list(early)
    while len(fill) < 4:
        fill.append(min((s for s in pool if s not in fill), key=lambda s: (round(plain_candidate(rows, [*fill, s], early, ez_refs)[2], 9), s)))
    places = search.numbered(listed(pool))[0]
    at = {r["sample"]: r["place"] for r in places.collect()}
    assert sorted(search._nearest_fillers(tracks, listed(early), places, [at[s] for s in early], 4)) == sorted(at[s] for s in fill)
    with pytest.raises(ValueError, match="a pool of"):
        search.stable_reference(tracks, listed(early), listed(pool[:2]), listed(ez_refs), 4)


def test_numbers_by_ranges(spark):
    rng = random.Random(51)
    values = [(rng.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(values, "x long, i long").repartition(5)
    got = [(r["x"], r["i"]) for r in ranks.numbered(df, [F.col("x").desc(), "i"], "n").orderBy("n").collect()]
    assert got == sorted(values, key=lambda v: (-v[0], v[1]))
    assert sorted(r["n"] for r in ranks.numbered(df, ["x", "i"], "n").collect()) == list(range(1, 501)) and ranks.numbered(df.limit(0), ["x"], "n").collect() == []
    for n, k in ((10, 4), (3, 5), (8, 4), (0, 3)):
        folds = [r["fold"] for r in resample.fold_ids(spark.range(n).withColumnRenamed("id", "sample"), [], ["sample"], k).orderBy("sample").collect()]
        assert folds == [f for f in range(k) for _ in range(n // k + (f < n % k))]


def test_cohort_plans_read_each_table_once(spark):
    """Scores of a cohort: one scan of the reads by sites and one by chromosomes, and no statistics joined back."""
    from cohortlens.plans import cohort

    sf = "/root/testdata/sf0.001"
    for df, most in ((cohort.cohort_scores(spark, sf), 11), (cohort.cohort_ezscores(spark, sf), 13)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = re.findall(r"FileScan parquet \[(.*?)\]", plan)
        assert sum("l_suppkey" in s for s in scans) == 2 and plan.count("Exchange hashpartitioning") <= most, plan


def test_ez_reference_search_is_the_first_best(spark):
    rng = random.Random(42)
    rows = [(s, c, rng.gauss(0, 1) + 4 * (s % 4 == 0) * (c == "chr1")) for s in range(20) for c in ("chr1", "chr2")]
    normals = [s for s in range(20) if s % 4]
    truth = spark.createDataFrame([(s, s % 4 == 0, s == 8) for s in range(20)], "sample long, is_true boolean, forced_normal boolean")
    got = search.ez_reference_search(spark.createDataFrame(rows, "sample long, chr string, score double"), spark.createDataFrame([(s,) for s in normals], "sample long"), truth, 4, repeats=60).collect()
    at = {(s, c): x for s, c, x in rows}
    best = None
    for r in range(60):
        some = [normals[i] for i in draws.permuted(np.arange(4), np.full(4, r), len(normals), 42)]
        stat = {c: (np.mean([at[s, c] for s in some]), np.std([at[s, c] for s in some])) for c in ("chr1", "chr2")}
        y = [any((at[s, c] - stat[c][0]) / stat[c][1] > 3 for c in stat) and s != 8 for s in range(20)]
        t = [s % 4 == 0 for s in range(20)]
        n = {(a, b): sum(p == a and q == b for p, q in zip(y, t, strict=True)) for a in (True, False) for b in (True, False)}
        tp, fp, fn, tn = n[True, True], n[True, False], n[False, True], n[False, False]
        bottom = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        mcc = (tp * tn - fp * fn) / bottom if bottom else 0.0
        if best is None or round(mcc, 9) > round(best[0], 9):
            best = mcc, r, sorted(some)
    assert sorted(r["sample"] for r in got) == best[2] and got[0]["repeat_id"] == best[1] and got[0]["mcc"] == pytest.approx(best[0])


def test_pick_combo_without_hits_takes_fewest_false_positives(spark):
    rows = [("chr1", 0.3, 0.2, 0, 5, 1.0, 0.0, None), ("chr1", 0.3, 0.5, 0, 2, 3.0, 0.0, None), ("chr1", 0.5, 0.5, 0, 2, 2.0, 0.0, None), ("chr2", 0.3, 0.2, 1, 9, 9.0, 0.4, 1.0), ("chr2", 0.3, 0.5, 1, 0, 0.0, 0.4, 0.5)]
    df = spark.createDataFrame(rows, "chr string, threshold double, recall double, tp long, fp_ext long, normal_var double, mcc double, sep_score double")
    assert {r["chr"]: (r["threshold"], r["recall"]) for r in evaluate.pick_combo(df, ["chr"]).collect()} == {"chr1": (0.5, 0.5), "chr2": (0.3, 0.2)}


def test_sheet_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample,pileup\ns1,\n")
    with pytest.raises(ValueError, match="lacks a value"):
        files.read_sheet(spark, f"file://{tmp_path}/a.csv", "est_ff")
    with pytest.raises(ValueError, match="missing columns: clean_bam"):
        files.read_sheet(spark, f"file://{tmp_path}/a.csv", "split_bam")
    with pytest.raises(ValueError, match="unknown step"):
        files.read_sheet(spark, f"file://{tmp_path}/a.csv", "no")


def test_sniff_by_first_bytes(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"PAR1....")
    (tmp_path / "y").write_bytes(b"\x1f\x8b..")
    (tmp_path / "z").write_bytes(b"chr")
    assert [files.sniff(spark, f"file://{tmp_path}/{n}") for n in "xyz"] == ["parquet", "gzip", "text"]


def test_empty_cpg_list_is_an_error(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("chr\tstart\tend\tfinal_recall\tmeandiff\n")
    with pytest.raises(ValueError, match="no sites"):
        files.read_cpg_list(spark, f"file://{tmp_path}/c.tsv")


def test_database_rows_are_replaced(spark):
    url = "jdbc:derby:memory:cohort;create=true"
    for names in (["a", "b"], ["c"]):
        files.write_database(spark.createDataFrame([(n,) for n in names], "sample string"), url, "sheet", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert [r["sample"] for r in spark.read.jdbc(url, "sheet", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"}).collect()] == ["c"]


def test_catalog_rows_are_replaced(spark, tmp_path):
    name = f"replaced_{uuid.uuid4().hex}"
    files.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "sample string, n long"), name, path=f"file://{tmp_path}/t")
    files.write_table(spark.createDataFrame([(3, "c")], "n int, sample string"), name)
    assert spark.table(name).dtypes == [("sample", "string"), ("n", "bigint")] and spark.table(name).collect() == [("c", 3)]
    files.write_table(spark.createDataFrame([("d",)], "sample string"), name)
    assert spark.table(name).collect() == [("d", None)]
    with pytest.raises(AnalysisException):
        files.write_table(spark.createDataFrame([("e", 1, 2)], "sample string, n long, m long"), name)
    files.write_table(spark.table(name).where("false").localCheckpoint(), name)
    assert spark.table(name).columns == ["sample", "n"] and spark.table(name).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_database_of_several_executors(tmp_path):
    """Driver and executors are processes of their own, as on a cluster."""
    code = f"""
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
rows = __spark_entry__.queries()["K7_database"](spark, "/root/testdata/sf0.001")
print("rows:", sorted(r["sample"] for r in rows.collect()), {{r["set"] for r in rows.collect()}}, [t.name for t in spark.catalog.listTables()])
spark.stop()
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert f"rows: {list(range(1, 11, 2))} {{'test'}} []" in run.stdout, run.stderr[-3000:]


def test_left_out_scores_against_explicit_references(spark):
    rng = random.Random(5)
    rows = [(s, c, rng.gauss(0, 1), rng.gauss(0, 1), 4, 9, rng.random()) for s in range(6) for c in ("chr1", "chr2")]
    df = spark.createDataFrame(rows, "sample long, chr string, hypo_z double, hyper_z double, hypo_n long, hyper_n long, percentage double")
    got = {(r["sample"], r["chr"]): r["score"] for r in resample.left_out_scores(df).collect()}
    for s, c, a, b, na, nb, p in rows:
        ref = [r for r in rows if r[1] == c and r[0] != s]
        def z(x, i, ref=ref):
            v = [r[i] for r in ref]
            mu = sum(v) / len(v)
            return (x - mu) / math.sqrt(sum((y - mu) ** 2 for y in v) / len(v))
        assert got[s, c] == pytest.approx((z(b, 3) * math.sqrt(nb) - z(a, 2) * math.sqrt(na)) / math.sqrt(na + nb) + z(p, 6), abs=1e-8)


def test_files_are_looked_at_whole(spark, tmp_path):
    """Folders and files of all kinds; a path with a broken file is left out whole, and columns in any order are read."""
    import gzip

    names = files.READS.replace(",", "").split()[::2]
    line = ["a", "chr1", "1", "5", "t", "0.5", "3", "150"]
    def text(order, rows):
        return ("\n".join("\t".join(dict(zip(names, r, strict=True))[n] for n in order) for r in [names, *rows]) + "\n").encode()
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "x.tsv").write_bytes(text(names, [line]))
    (tmp_path / "dir" / "y.tsv").write_bytes(text(names[::-1], [["b", "chr2", "NA", "6", "t", "0.1", "9", "1"], ["c", "chr2", "7", "8", "t", "0.1", "2", "1"]]))
    two = gzip.compress(text(names, [line])) + gzip.compress(b"\t".join(x.encode() for x in line) + b"\n")  # two members in one file
    (tmp_path / "two.tsv.gz").write_bytes(two)
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "good.tsv").write_bytes(text(names, [line]))
    (tmp_path / "mixed" / "cut.tsv.gz").write_bytes(gzip.compress(text(names, [line] * 5000))[:-30])
    (tmp_path / "short.tsv").write_bytes(b"name\tchr\nx\ty\n")
    spark.createDataFrame([("p", "chr3", 1, 2, "t", 0.2, 4.0, 7)], files.READS).write.parquet(str(tmp_path / "parquet"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1" + b"x" * 50)
    paths = [str(tmp_path / p) for p in ("dir", "two.tsv.gz", "mixed", "short.tsv", "parquet", "bad.parquet", "none")]
    df, skipped = files.read_deconv(spark, paths, 3)
    assert sorted(tuple(r) for r in df.select("name", "chr", "start", "mTcount").collect()) == sorted([("a", "chr1", 1, 3.0)] * 3 + [("p", "chr3", 1, 4.0)] + [("b", "chr2", None, 9.0)], key=str)
    assert [s.split(":")[0].rsplit("/", 1)[1] for s in skipped] == ["mixed", "short.tsv", "bad.parquet", "none"]
    assert "cut" in skipped[0] and "missing columns: start" in skipped[1] and "no file" in skipped[3]
    none, skipped = files.read_deconv(spark, [paths[-1]])
    assert none.collect() == [] and len(skipped) == 1


def test_workbooks_by_tasks(spark, tmp_path):
    rows = [(i, f"l<{i}>&", None if i % 3 == 0 else "é") for i in range(57)]
    df = spark.createDataFrame(rows, "a long, b string, c string")
    assert files.write_workbooks(df, str(tmp_path / "books"), per_book=10) == 6
    got = files.read_workbooks(spark, str(tmp_path / "books"), ["c", "a"])
    assert sorted((int(r["a"]), r["c"]) for r in got.collect()) == [(r[0], r[2]) for r in rows] and got.select("path").distinct().count() == 6
    with pytest.raises(Exception, match="missing columns: d"):
        files.read_workbooks(spark, str(tmp_path / "books"), ["a", "d"]).collect()


@pytest.mark.parametrize("genotype", [False, True])
def test_likelihood_grid_equals_the_expression(spark, genotype):
    """Vectors over the grid against the formula in columns, with impossible and certain alleles, empty counts and nulls."""
    rng = random.Random(61)
    rows = [(rng.choice(["x", "y"]), rng.choice([0.0, 1.0, 0.5, rng.random(), None]), rng.choice([0, 1, 30, None]), rng.choice([0, 2, 25]), rng.randrange(9), rng.randrange(9)) for _ in range(200)]
    snps = spark.createDataFrame(rows, "k string, af double, n_ref long, n_alt long, m_ref long, m_alt long")
    got = {(r["k"], round(r["f"], 6)): r["log_likelihood"] for r in snp.likelihood_grid(snps, ["k"], 0.0, 1.0, 0.1, genotype).collect()}
    grid = snps.withColumn("f", F.explode(F.array(*[F.lit(0.0 + i * 0.1) for i in range(11)])))
    called = snp.maternal_genotype(F.col("m_ref"), F.col("m_alt")) if genotype else None
    want = grid.groupBy("k", "f").agg(F.sum(snp.snp_log_likelihood(F.col("f"), F.col("af"), F.col("n_ref"), F.col("n_alt"), called)).alias("l")).collect()
    assert len(got) == len(want) == 22
    for r in want:
        assert got[r["k"], round(r["f"], 6)] == pytest.approx(r["l"], rel=1e-9)
    some = snps.where("af between 0.2 and 0.8 and n_ref is not null")
    assert genotype or all(math.isfinite(r["log_likelihood"]) for r in snp.likelihood_grid(some, ["k"], 0.0, 0.5, 0.1).collect())
