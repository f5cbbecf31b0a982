"""Queries of the evaluation, search, resampling, admission, window, set and reshape operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions import scalar as S
from cohortlens.operators import admission, evaluate, meta_etl, panel, resample, scores, snp, sweeps
from cohortlens.plans import cohort as C
from cohortlens.plans.registry import query
from cohortlens.sources.files import scratch

# --- confusion, choice, search -------------------------------------------------------------------------------------


@query("A9_A12_combo_metrics", "SELECT chr, threshold, recall, tp, fp, fn, tn, mcc, sep_score, fp_ext, normal_var FROM metrics", "threshold recall mcc sep_score normal_var")
def a9(spark, sf):
    """Confusion counts, MCC, separation, two-sided false positives and variance by chromosome and combination."""
    return C.grid_metrics(spark, sf)


PICK = """SELECT {keys}chr, threshold, recall, has_target FROM (SELECT *, max(tp > 0) OVER (PARTITION BY {keys}chr) AS has_target FROM {source}) QUALIFY row_number() OVER (PARTITION BY {keys}chr ORDER BY
    CASE WHEN has_target THEN round(mcc, 8) END DESC NULLS LAST, CASE WHEN has_target THEN round(sep_score, 8) END DESC NULLS LAST, CASE WHEN NOT has_target THEN fp_ext END ASC NULLS LAST,
    CASE WHEN NOT has_target THEN round(normal_var, 8) END ASC NULLS LAST, recall DESC, threshold) = 1"""


@query("T4_pick_combo", PICK.format(keys="", source="(SELECT * FROM metrics WHERE recall BETWEEN 0.1 AND 0.99)"), "threshold recall")
def t4(spark, sf):
    """The best combination of each chromosome."""
    return evaluate.pick_combo(C.grid_metrics(spark, sf), ["chr"], 0.1).select("chr", "threshold", "recall", "has_target")


SAMPLES = """SELECT {keys}, count(*) FILTER (y AND NOT is_normal) AS tp, count(*) FILTER (y AND is_normal) AS fp, count(*) FILTER (NOT y AND NOT is_normal) AS fn, count(*) FILTER (NOT y AND is_normal) AS tn FROM
    (SELECT {keys}, sample, is_normal, coalesce(max(score) > 1.5, false) AS y FROM {source} GROUP BY ALL) GROUP BY ALL"""
MCC = "coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"


@query("A13_sample_confusion", f"SELECT *, {MCC} AS mcc FROM ({SAMPLES.format(keys='threshold, recall', source='gridrows')})", "threshold recall mcc")
def a13(spark, sf):
    """A sample is positive if any chromosome is."""
    return evaluate.sample_confusion(C.grid_rows(spark, sf), C.COMBO, C.CUTOFF)


@query("T6_fixed_search", f"SELECT *, {MCC} AS mcc FROM ({SAMPLES.format(keys='threshold, recall', source='gridrows')}) ORDER BY round({MCC}, 8) DESC, recall DESC, threshold LIMIT 1", "threshold recall mcc")
def t6(spark, sf):
    return evaluate.fixed_search(C.grid_rows(spark, sf), C.CUTOFF)


@query("T5_X14_flexible_search", f"""WITH lows AS (SELECT i / 100.0::DOUBLE AS min_recall FROM range(1, 100) t(i)), tried AS (SELECT * FROM metrics JOIN lows ON recall BETWEEN min_recall AND 0.99), picked AS ({PICK.format(keys='min_recall, ', source='tried')}),
    whole AS (SELECT * FROM picked QUALIFY count(*) OVER (PARTITION BY min_recall) = (SELECT count(DISTINCT chr) FROM metrics)), found AS ({SAMPLES.format(keys='min_recall', source='(SELECT w.min_recall, g.* FROM gridrows g JOIN whole w USING (chr, threshold, recall))')})
    SELECT chr, threshold, recall, has_target, min_recall FROM whole WHERE min_recall = (SELECT min_recall FROM found ORDER BY round({MCC}, 8) DESC, min_recall DESC LIMIT 1)""", "threshold recall min_recall")
def t5(spark, sf):
    """All least recalls tried at once."""
    held = C.held_scores(spark, sf)
    return evaluate.flexible_search(C.grid_metrics(spark, sf, held), C.grid_rows(spark, sf, held), C.CUTOFF)


@query("T1_T2_chr_order", "SELECT chr, row_number() OVER (ORDER BY n NULLS LAST, chr) AS place, CASE chr WHEN 'chrX' THEN 23 WHEN 'chrY' THEN 24 WHEN 'chrM' THEN 25 ELSE n END AS code FROM (SELECT chr, TRY_CAST(replace(chr, 'chr', '') AS INT) AS n FROM (SELECT chr FROM chrs UNION ALL SELECT unnest(['chrX', 'chrY', 'chrM'])))")
def t1(spark, sf):
    """Natural order of chromosomes and their codes."""
    names = scores.chromosomes(spark, (*S.AUTOSOMES, "chrX", "chrY", "chrM"))
    return names.select("chr", F.row_number().over(Window.orderBy(*S.chr_order(F.col("chr")))).cast("long").alias("place"), S.chr_code(F.col("chr")).alias("code"))


@query("T7_X26_combo_candidates", """SELECT threshold, recall, z_threshold, min_ez, all_pass FROM (SELECT e.threshold, e.recall, z.threshold AS z_threshold, min(e.episcore + z.zscore) AS min_ez, bool_and(coalesce(e.episcore + z.zscore > -1, false)) AS all_pass
    FROM (SELECT * FROM episcores WHERE chr = 'chr21') e JOIN (SELECT * FROM zscores WHERE chr = 'chr21') z USING (sample) JOIN meta USING (sample) WHERE label <> 'Normal' GROUP BY ALL) ORDER BY all_pass DESC, round(min_ez, 8) DESC NULLS LAST, recall DESC, abs(threshold - z_threshold), threshold, z_threshold LIMIT 10""", "threshold recall z_threshold min_ez")
def t7(spark, sf):
    """Pairs of combinations of one chromosome ranked over the abnormal samples: a top ten."""
    rows = C.cohort_scores(spark, sf).where("chr = 'chr21'")
    e, z = rows.select("sample", "threshold", "recall", "episcore"), rows.where("recall = 0.2D").select("sample", F.col("threshold").alias("z_threshold"), "zscore")
    # z scores don't depend on the recall; of samples without sites at 0.2 they come from the shares
    shares = C.share_rows(spark, sf).where("chr = 'chr21'")
    z = scores.zscore_of(shares, C.reference(spark, sf), ["threshold", "chr"]).select("sample", F.col("threshold").alias("z_threshold"), "zscore")
    epi = C.episcore_rows(spark, sf)
    e = scores.episcore_of(epi, C.reference(spark, sf), [*C.COMBO, "chr"]).where("chr = 'chr21'").select("sample", "threshold", "recall", "episcore")
    abnormal = C.meta(spark, sf).where("label <> 'Normal'").select("sample")
    s = F.col("episcore") + F.col("zscore")
    found = e.join(abnormal, "sample", "left_semi").join(z, "sample").groupBy("threshold", "recall", "z_threshold").agg(F.min(s).alias("min_ez"), F.bool_and(F.coalesce(s > -1, F.lit(False))).alias("all_pass"))
    order = [F.col("all_pass").desc(), F.round("min_ez", 8).desc_nulls_last(), F.col("recall").desc(), F.abs(F.col("threshold") - F.col("z_threshold")), "threshold", "z_threshold"]
    return found.orderBy(*order).limit(10)


@query("T8_top_per_group", "SELECT threshold, chr, sample, zscore FROM zscores QUALIFY row_number() OVER (PARTITION BY threshold, chr ORDER BY round(zscore, 8) DESC NULLS LAST, sample) <= 5", "threshold zscore")
def t8(spark, sf):
    """Five largest by group."""
    shares = C.share_rows(spark, sf)
    z = scores.zscore_of(shares, C.reference(spark, sf), ["threshold", "chr"])
    return snp.ranked(z, ["threshold", "chr"], [F.round("zscore", 8).desc_nulls_last(), F.col("sample")]).where("rank <= 5").select("threshold", "chr", "sample", "zscore")


@query("T10_A14_toxic_top", "SELECT sample, n FROM (SELECT sample, count(*) FILTER (episcore > 1.5) AS n FROM scores GROUP BY 1) ORDER BY n DESC, sample LIMIT 16")
def t10(spark, sf):
    """The sixteen samples with most calls over combinations and chromosomes."""
    return C.cohort_scores(spark, sf).groupBy("sample").agg(F.count_if(F.col("episcore") > C.CUTOFF).alias("n")).orderBy(F.col("n").desc(), "sample").limit(16)


# --- flags ---------------------------------------------------------------------------------------------------------


@query("A14_flag_counts", "SELECT sample, count(*) FILTER (f) AS n_abnormal, count(*) AS n_total FROM (SELECT sample, threshold, recall, coalesce(max(episcore) > 1.5, false) AS f FROM scores GROUP BY ALL) GROUP BY ALL")
def a14(spark, sf):
    flags = evaluate.max_chr_flags(C.cohort_scores(spark, sf), C.COMBO, [C.CUTOFF], "episcore")
    return resample.signal_counts(flags, [])


@query("A15_either_flag", """SELECT sample, count(*) FILTER (coalesce(e.f, false) OR coalesce(z.f, false)) AS n_either, count(*) AS n_combos FROM (SELECT sample, threshold, recall, coalesce(max(episcore) > 1.5, false) AS f FROM episcores GROUP BY ALL) e
    FULL JOIN (SELECT sample, threshold, 0.9::DOUBLE AS recall, coalesce(max(zscore) > 1.5, false) AS f FROM zscores GROUP BY ALL UNION ALL SELECT sample, threshold, 0.2::DOUBLE, coalesce(max(zscore) > 1.5, false) FROM zscores GROUP BY ALL) z USING (sample, threshold, recall) GROUP BY 1""")
def a15(spark, sf):
    """Either score's flag over the union of both combination lists."""
    rows = C.episcore_rows(spark, sf)
    e = scores.episcore_of(rows, C.reference(spark, sf), [*C.COMBO, "chr"])
    shares = C.share_rows(spark, sf).withColumn("recall", F.explode(F.array(F.lit(0.9), F.lit(0.2))))
    z = scores.zscore_of(shares, C.reference(spark, sf), [*C.COMBO, "chr"])
    fe = evaluate.max_chr_flags(e, C.COMBO, [C.CUTOFF], "episcore").select("sample", *C.COMBO, F.col("flag").alias("e"))
    fz = evaluate.max_chr_flags(z, C.COMBO, [C.CUTOFF], "zscore").select("sample", *C.COMBO, F.col("flag").alias("z"))
    either = fe.join(fz, ["sample", *C.COMBO], "outer")
    return either.groupBy("sample").agg(F.count_if(F.coalesce("e", F.lit(False)) | F.coalesce("z", F.lit(False))).alias("n_either"), F.count("*").alias("n_combos"))


@query("A16_cutoff_flags", "SELECT sample, cutoff, count(*) FILTER (top > cutoff) AS n FROM (SELECT sample, threshold, recall, max(ezscore) AS top FROM ez GROUP BY ALL), (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS cutoff) GROUP BY ALL", "cutoff")
def a16(spark, sf):
    """Flags at several cutoffs from one maximum."""
    flags = evaluate.max_chr_flags(C.cohort_ezscores(spark, sf), C.COMBO, [1.0, 2.0, 3.0], "ezscore")
    return flags.groupBy("sample", "cutoff").agg(F.count_if("flag").alias("n"))


@query("A17_ez_pairs", """WITH p AS (SELECT e.sample, e.threshold, e.recall, z.threshold AS zt, e.chr, e.episcore + z.zscore AS c FROM episcores e JOIN zscores z USING (sample, chr) WHERE e.recall = 0.2::DOUBLE), s AS (SELECT threshold, zt, chr, coalesce(avg(c), 0) AS m, stddev_pop(c) AS sd FROM p JOIN ezrefs USING (sample) GROUP BY ALL)
    SELECT sample, count(*) FILTER (top > 2) AS n FROM (SELECT sample, p.threshold, p.zt, max((c - m) / nullif(sd, 0)) AS top FROM p JOIN s ON p.threshold = s.threshold AND p.zt = s.zt AND p.chr = s.chr GROUP BY ALL) GROUP BY ALL""")
def a17(spark, sf):
    """Combined scores of all pairs of combinations, their flags summed."""
    rows = C.episcore_rows(spark, sf).where("recall = 0.2D")
    ref = C.reference(spark, sf)
    e = scores.episcore_of(rows, ref, [*C.COMBO, "chr"])
    shares = C.share_rows(spark, sf)
    z = scores.zscore_of(shares, ref, ["threshold", "chr"]).select("sample", F.col("threshold").alias("zt"), "chr", "zscore")
    pairs = e.select("sample", "threshold", "chr", "episcore").join(z, ["sample", "chr"])
    ez = scores.ezscore(pairs, scores.ez_stats(pairs, C.ez_reference(spark, sf), ["threshold", "zt", "chr"]), ["threshold", "zt", "chr"])
    return evaluate.max_chr_flags(ez, ["threshold", "zt"], [2.0], "ezscore").groupBy("sample").agg(F.count_if("flag").alias("n"))


@query("A20_X31_coverage", """SELECT threshold, recall, count(*) FILTER (n >= 20) AS n_whole, count(*) AS n_samples, count(*) FILTER (n >= 20) >= 0.95 * count(*) AS enough FROM (SELECT threshold, recall, sample, count(DISTINCT chr) AS n FROM eprows GROUP BY ALL) GROUP BY ALL""", "threshold recall")
def a20(spark, sf):
    """Combinations in which enough samples have enough chromosomes."""
    return meta_etl.coverage(C.episcore_rows(spark, sf), 20)


# --- aggregations --------------------------------------------------------------------------------------------------


@query("A19_U7_group_sizes", "SELECT sample, count(DISTINCT chr) AS n_chr, count(*) AS n, count(*) > 1 AS multi FROM reads GROUP BY 1")
def a19(spark, sf):
    return C.reads(spark, sf).groupBy("sample").agg(F.size(F.collect_set("chr")).cast("long").alias("n_chr"), F.count("*").alias("n"), (F.count("*") > 1).alias("multi"))


FF = "SELECT sample, chr, avg(prob_class_1) AS ff FROM reads WHERE insert_size < 160 GROUP BY ALL UNION ALL SELECT sample, 'all', avg(prob_class_1) FROM reads WHERE sample % 2 = 0 GROUP BY ALL"


def fractions(spark, sf):
    rows = C.reads(spark, sf)
    by_chr = rows.where("insert_size < 160").groupBy("sample", "chr").agg(F.avg("prob_class_1").alias("ff"))
    return by_chr.unionByName(rows.where("sample % 2 = 0").groupBy("sample").agg(F.avg("prob_class_1").alias("ff")).withColumn("chr", F.lit("all")))


@query("A21_A22_mean_ff", f"SELECT sample, round(avg(ff), 6) AS ff FROM ({FF}) WHERE chr <> 'all' GROUP BY 1", "ff")
def a22(spark, sf):
    return fractions(spark, sf).where("chr <> 'all'").groupBy("sample").agg(F.round(F.avg("ff"), 6).alias("ff"))


@query("A23_pick_ff", f"SELECT sample, coalesce(max(ff) FILTER (chr = 'all'), avg(ff)) AS ff FROM ({FF}) GROUP BY 1", "ff")
def a23(spark, sf):
    """The fraction of all chromosomes if there is one, else the mean."""
    return snp.ff_of_sample(fractions(spark, sf))


@query("A24_quantiles", "SELECT chr, quantile_cont(zscore, 0.05) AS p05, quantile_cont(zscore, 0.5) AS p50, quantile_cont(zscore, 0.95) AS p95, quantile_cont(zscore, 0.99) AS p99 FROM zscores GROUP BY 1", "p05 p50 p95 p99")
def a24(spark, sf):
    shares = C.share_rows(spark, sf)
    z = scores.zscore_of(shares, C.reference(spark, sf), ["threshold", "chr"])
    return admission.quantiles(z, ["chr"], "zscore", {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})


MAD = """SELECT f.sample, f.chr, f.label, f.set, coalesce(0.6745 * (f.score - med) / nullif(mad, 0), 0) AS mad_z FROM labelled f LEFT JOIN (SELECT chr, any_value(med) AS med, median(abs(score - med)) AS mad FROM
    (SELECT chr, score, median(score) OVER (PARTITION BY chr) AS med FROM labelled WHERE {ref}) GROUP BY 1) USING (chr)"""


def labelled(spark, sf):
    return C.fixed_combo_scores(spark, sf).join(C.meta(spark, sf), "sample").select("sample", "chr", (F.col("episcore") + F.col("zscore")).alias("score"), S.is_trisomy(F.col("label")).alias("positive"), "label", "set", "ff_before_mq")


@query("A25_mad_z", f"SELECT sample, chr, mad_z FROM ({MAD.format(ref='true')})", "mad_z")
def a25(spark, sf):
    """Robust z by chromosome."""
    return admission.mad_z(labelled(spark, sf), ["chr"], "score").select("sample", "chr", "mad_z")


FROZEN = MAD.format(ref="set = 'dev' AND label = 'Normal'")


@query("A26_X28_frozen_fences", f"SELECT sample, count(*) FILTER (abs(mad_z) > 2.5) AS n_fail, max(abs(mad_z)) AS worst, count(*) FILTER (abs(mad_z) > 2.5) = 0 AS admitted FROM ({FROZEN}) GROUP BY 1", "worst")
def a26(spark, sf):
    """Fences frozen on the reference group."""
    z = admission.mad_z(labelled(spark, sf), ["chr"], "score", (F.col("set") == "dev") & (F.col("label") == "Normal"))
    return admission.fences(z, 2.5)


@query("A27_cohens_d", """SELECT chr, CASE WHEN n1 >= 2 AND n0 >= 2 AND p > 0 THEN (m1 - m0) / sqrt(p) END AS cohens_d FROM (SELECT *, ((n1 - 1) * v1 + (n0 - 1) * v0) / nullif(n1 + n0 - 2, 0) AS p FROM (SELECT chr, avg(score) FILTER (positive) AS m1, avg(score) FILTER (NOT positive) AS m0,
    var_samp(score) FILTER (positive) AS v1, var_samp(score) FILTER (NOT positive) AS v0, count(score) FILTER (positive) AS n1, count(score) FILTER (NOT positive) AS n0 FROM labelled GROUP BY 1))""", "cohens_d")
def a27(spark, sf):
    return evaluate.cohens_d(labelled(spark, sf), ["chr"])


PAIRS = "SELECT a.chr, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc, avg(sign(a.score - b.score)) AS delta FROM labelled a JOIN labelled b ON a.chr = b.chr AND a.positive AND NOT b.positive WHERE a.score IS NOT NULL AND b.score IS NOT NULL GROUP BY 1"


@query("A28_cliffs_delta", f"SELECT c.chr, delta AS cliffs_delta FROM (SELECT DISTINCT chr FROM labelled WHERE score IS NOT NULL) c LEFT JOIN ({PAIRS}) p USING (chr)", "cliffs_delta")
def a28(spark, sf):
    """By ranks here, by all pairs in the oracle."""
    return evaluate.cliffs_delta(labelled(spark, sf), ["chr"])


@query("W5_roc_auc", f"SELECT c.chr, auc FROM (SELECT DISTINCT chr FROM labelled WHERE score IS NOT NULL) c LEFT JOIN ({PAIRS}) p USING (chr)", "auc")
def w5(spark, sf):
    return evaluate.roc_auc(labelled(spark, sf), ["chr"])


@query("W5_A30_average_ranks", """SELECT sample, chr, rank() OVER (PARTITION BY chr ORDER BY n_reads) + (count(*) OVER (PARTITION BY chr, n_reads) - 1) / 2.0 AS avg_rank FROM shares WHERE threshold = 0.5::DOUBLE""", "avg_rank")
def w5b(spark, sf):
    return evaluate.average_ranks(C.share_rows(spark, sf).where("threshold = 0.5D"), ["chr"], "n_reads").select("sample", "chr", "avg_rank")


@query("A30_spearman", """SELECT chr, corr(a, b) AS rho FROM (SELECT s.chr, rank() OVER (PARTITION BY s.chr ORDER BY n_reads) + (count(*) OVER (PARTITION BY s.chr, n_reads) - 1) / 2.0 AS a, rank() OVER (PARTITION BY s.chr ORDER BY balance) + (count(*) OVER (PARTITION BY s.chr, balance) - 1) / 2.0 AS b
    FROM shares s JOIN meta USING (sample) WHERE threshold = 0.5::DOUBLE) GROUP BY 1""", "rho")
def a30(spark, sf):
    """Correlation of average ranks."""
    rows = C.share_rows(spark, sf).where("threshold = 0.5D").join(C.meta(spark, sf), "sample")
    a = evaluate.average_ranks(rows, ["chr"], "n_reads").withColumnRenamed("avg_rank", "a")
    return evaluate.average_ranks(a, ["chr"], "balance").groupBy("chr").agg(F.corr("a", "avg_rank").alias("rho"))


@query("W9_X29_youden", """SELECT chr, max(tp / nullif(p, 0) - fp / nullif(n, 0)) AS youden FROM (SELECT chr, sum(positive::INT) OVER w AS tp, sum((NOT positive)::INT) OVER w AS fp, sum(positive::INT) OVER (PARTITION BY chr) AS p, sum((NOT positive)::INT) OVER (PARTITION BY chr) AS n
    FROM labelled WHERE score IS NOT NULL WINDOW w AS (PARTITION BY chr ORDER BY score DESC, sample ROWS UNBOUNDED PRECEDING)) GROUP BY 1""", "youden")
def w9(spark, sf):
    return evaluate.youden(labelled(spark, sf), ["chr"])


@query("X29_separation", f"""WITH l AS (SELECT sample, any_value(positive) AS positive, max(score) AS score FROM labelled WHERE ff_before_mq >= 0.01 GROUP BY 1), p AS (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc FROM l a, l b WHERE a.positive AND NOT b.positive)
    SELECT auc, avg(score) FILTER (positive) - avg(score) FILTER (NOT positive) AS mean_gap, count(*) FILTER (positive) AS n_trisomy, count(*) FILTER (NOT positive) AS n_normal FROM l, p GROUP BY auc""", "auc mean_gap")
def x29(spark, sf):
    """AUC, mean gap and counts of the samples with enough fraction, by their largest score."""
    top = labelled(spark, sf).where("ff_before_mq >= 0.01D").groupBy("sample").agg(F.first("positive").alias("positive"), F.max("score").alias("score")).withColumn("all", F.lit(1))
    auc = evaluate.roc_auc(top, ["all"])
    sums = top.groupBy("all").agg((F.avg(F.when(F.col("positive"), F.col("score"))) - F.avg(F.when(~F.col("positive"), F.col("score")))).alias("mean_gap"), F.count_if("positive").alias("n_trisomy"), F.count_if(~F.col("positive")).alias("n_normal"))
    return auc.join(sums, "all").drop("all")


@query("A29_agreement", """SELECT chr, count(*) AS n, max(abs(d)) AS max_abs, avg(abs(d)) AS mean_abs, sqrt(avg(d * d)) AS rmse, corr(episcore, zscore) AS pearson FROM (SELECT *, episcore - zscore AS d FROM scores WHERE episcore IS NOT NULL AND zscore IS NOT NULL) GROUP BY 1""", "max_abs mean_abs rmse pearson")
def a29(spark, sf):
    """Difference and correlation of two versions of a score."""
    return meta_etl.agreement(C.cohort_scores(spark, sf), ["chr"], "episcore", "zscore")


OUTCOME = "SELECT repeat_id, sum(sample % 7)::BIGINT AS errors, sum(sample % 7) > 9 AS bad FROM draws WHERE role = 'ref' GROUP BY 1"


def outcome(spark, sf):
    return C.draws(spark, sf).where("role = 'ref'").groupBy("repeat_id").agg(F.sum(F.col("sample") % 7).alias("errors")).withColumn("bad", F.col("errors") > 9)


ENRICHED = f"""SELECT sample, in_bad, in_good, n_bad - in_bad AS out_bad, n_good - in_good AS out_good, in_bad / nullif(n_bad, 0) AS p_bad, in_good / nullif(n_good, 0) AS p_good FROM (SELECT sample, count(*) FILTER (bad) AS in_bad, count(*) FILTER (NOT bad) AS in_good FROM draws JOIN ({OUTCOME}) USING (repeat_id) WHERE role = 'ref' GROUP BY 1),
    (SELECT count(*) FILTER (bad) AS n_bad, count(*) FILTER (NOT bad) AS n_good FROM ({OUTCOME}))"""


def enriched(spark, sf):
    return admission.membership_enrichment(C.draws(spark, sf).where("role = 'ref'"), outcome(spark, sf))


@query("A31_enrichment", f"SELECT *, p_bad / nullif(p_good, 0) AS lift FROM ({ENRICHED})", "p_bad p_good lift")
def a31(spark, sf):
    """Membership against bad draws."""
    return enriched(spark, sf)


@query("A32_fisher_exact", f"""SELECT sample, in_bad::DOUBLE * out_good / nullif(in_good::DOUBLE * out_bad, 0) AS odds_ratio, least(1, (SELECT sum(exp(q)) FROM (SELECT lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS q,
    lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS o FROM (SELECT in_bad AS a, in_good AS b, out_bad AS c, out_good AS d, unnest(range(greatest(0, in_bad - out_good), least(in_bad + in_good, in_bad + out_bad) + 1)) AS x)) WHERE q <= o + 1e-7)) AS p_value FROM ({ENRICHED})""", "odds_ratio p_value")
def a32(spark, sf):
    """Two-sided exact test of each sample's table."""
    return admission.fisher_exact(enriched(spark, sf)).select("sample", "odds_ratio", "p_value")


@query("A32_mann_whitney", """WITH v AS (SELECT chr, score, positive FROM labelled WHERE score IS NOT NULL), g AS (SELECT chr, score, count(*) AS t FROM v GROUP BY ALL), u AS (SELECT a.chr, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS u FROM v a JOIN v b ON a.chr = b.chr AND a.positive AND NOT b.positive GROUP BY 1),
    s AS (SELECT chr, count(*) FILTER (positive) AS n1, count(*) FILTER (NOT positive) AS n2 FROM v GROUP BY 1), k AS (SELECT chr, sum(t::DOUBLE * t * t - t) AS k FROM g GROUP BY 1)
    , f AS (SELECT s.chr, coalesce(u.u, 0) AS u, greatest(abs(coalesce(u.u, 0) - n1 * n2 / 2.0) - 0.5, 0) / nullif(sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - k / ((n1 + n2) * (n1 + n2 - 1)::DOUBLE))), 0) AS z, abs(z) / sqrt(2.0) AS x FROM s JOIN k USING (chr) LEFT JOIN u USING (chr))
    SELECT chr, u, z, power(1 / (1 + 0.0705230784 * x + 0.0422820123 * x ** 2 + 0.0092705272 * x ** 3 + 0.0001520143 * x ** 4 + 0.0002765672 * x ** 5 + 0.0000430638 * x ** 6), 16) AS p_value FROM f""", "u z p_value")
def a32b(spark, sf):
    """U and its normal approximation from grouped ranks."""
    return admission.mann_whitney(labelled(spark, sf), ["chr"], "score", "positive")


@query("A33_W8_density", f"SELECT errors, n, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY errors) / sum(n) OVER () AS cum_share FROM (SELECT errors, count(*) AS n FROM ({OUTCOME}) GROUP BY 1)", "share cum_share")
def a33(spark, sf):
    return admission.density(outcome(spark, sf), "errors")


@query("A34_dose_response", f"""SELECT n_failing, count(*) AS n_draws, avg(bad::INT) AS bad_share, avg(errors) AS mean_errors FROM (SELECT repeat_id, count(*) FILTER (sample % 7 >= 5) AS n_failing FROM draws WHERE role = 'ref' GROUP BY 1) JOIN ({OUTCOME}) USING (repeat_id) GROUP BY 1""", "bad_share mean_errors")
def a34(spark, sf):
    """Bad draws by how many failing members they have."""
    failing = C.meta(spark, sf).where("sample % 7 >= 5").select("sample")
    return admission.dose_response(C.draws(spark, sf).where("role = 'ref'"), failing, outcome(spark, sf))


@query("X27_toxic_keep", f"SELECT sample, p_bad - p_good AS toxicity, row_number() OVER (ORDER BY round(p_bad - p_good, 9) DESC NULLS LAST, sample) > 5 AS keep FROM ({ENRICHED})", "toxicity")
def x27(spark, sf):
    """The five most toxic members are dropped."""
    return admission.toxic_scores(enriched(spark, sf), 5)


@query("A35_cross_table", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def a35(spark, sf):
    return meta_etl.cross_table(C.table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("A36_line_fit", """WITH f AS (SELECT chr, regr_slope(price, insert_size) AS slope, regr_intercept(price, insert_size) AS intercept FROM reads GROUP BY 1) SELECT chr, CASE WHEN r > 20000 THEN 'above' WHEN r < -20000 THEN 'below' ELSE 'on' END AS side, count(*) AS n, any_value(slope) AS slope, any_value(intercept) AS intercept
    FROM (SELECT reads.chr, price - (slope * insert_size + intercept) AS r, slope, intercept FROM reads JOIN f USING (chr)) GROUP BY ALL""", "slope intercept")
def a36(spark, sf):
    """A line by chromosome and the classes of residuals."""
    rows = C.reads(spark, sf)
    fit = meta_etl.line_fit(rows, ["chr"], "insert_size", "price")
    return meta_etl.residual_class(rows, fit, ["chr"], "insert_size", "price", 20000.0).groupBy("chr", "side").agg(F.count("*").alias("n"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"))


@query("A38_distance", """SELECT sum(((a.m - b.m) / s) ** 2 + ((a.sd - b.sd) / s) ** 2) AS distance FROM (SELECT chr, avg(percentage) AS m, stddev_pop(percentage) AS sd FROM shares WHERE threshold = 0.5::DOUBLE AND sample IN (SELECT sample FROM ezrefs) GROUP BY 1) a
    JOIN (SELECT chr, avg(percentage) AS m, stddev_pop(percentage) AS sd, CASE WHEN abs(stddev_pop(percentage)) > 1e-8 THEN abs(stddev_pop(percentage)) ELSE 1 END AS s FROM shares WHERE threshold = 0.5::DOUBLE AND sample IN (SELECT sample FROM refs) GROUP BY 1) b USING (chr)""", "distance")
def a38(spark, sf):
    """Distance of one reference's parameters from another's."""
    rows = C.share_rows(spark, sf).where("threshold = 0.5D")
    a, b = (scores.reference_stats(rows, r, ["chr"], ["percentage"]).selectExpr("chr", f"percentage_mean as m{i}", f"percentage_sd as s{i}") for i, r in enumerate((C.ez_reference(spark, sf), C.reference(spark, sf))))
    scale = F.when(F.abs("s1") > 1e-8, F.abs("s1")).otherwise(1.0)
    square = lambda x: x * x
    return a.join(b, "chr").agg(F.sum(square((F.col("m0") - F.col("m1")) / scale) + square((F.col("s0") - F.col("s1")) / scale)).alias("distance"))


@query("A40_rollup", "SELECT sample, min(name) AS first_name, count(*) AS n, bool_or(prob_class_1 >= 1) AS any_full, arg_min(price, (name, insert_size, price)) AS first_price FROM reads GROUP BY 1", "first_price")
def a40(spark, sf):
    return C.reads(spark, sf).groupBy("sample").agg(F.min("name").alias("first_name"), F.count("*").alias("n"), F.bool_or(F.col("prob_class_1") >= 1).alias("any_full"), F.min_by("price", F.struct("name", "insert_size", "price")).alias("first_price"))


@query("A41_chi_square", "SELECT sum((n - e) ** 2 / e) AS chi2, count(*) - 1 AS df FROM (SELECT count(*) AS n, sum(count(*)) OVER () / count(*) OVER () AS e FROM reads GROUP BY chr)", "chi2")
def a41(spark, sf):
    """Uniformity of reads over chromosomes."""
    n = C.reads(spark, sf).groupBy("chr").agg(F.count("*").alias("n"))
    e = n.agg(F.avg("n").alias("e"))
    return n.crossJoin(F.broadcast(e)).agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("chi2"), (F.count("*") - 1).alias("df"))


@query("A41_uniform_fit")
def a41b(spark, sf):
    """The same with a p value from seeded draws; tested against the chi-square distribution."""
    return admission.uniform_fit(C.reads(spark, sf).groupBy("chr").agg(F.count("*").alias("n")), "n")


@query("A18_partial_final", """SELECT sample, sum(n)::BIGINT AS n_abnormal, sum(n) / (3 * 3) AS ratio FROM (SELECT sample, threshold, count(*) FILTER (f) AS n FROM (SELECT sample, threshold, recall, coalesce(max(episcore) > 1.5, false) AS f FROM scores GROUP BY ALL) GROUP BY ALL) GROUP BY 1""", "ratio")
def a18(spark, sf):
    """Counts by slice, then their sum over all slices: additive shards."""
    flags = evaluate.max_chr_flags(C.cohort_scores(spark, sf), C.COMBO, [C.CUTOFF], "episcore")
    shards = resample.signal_counts(flags, ["threshold"])
    return shards.groupBy("sample").agg(F.sum("n_abnormal").alias("n_abnormal"), (F.sum("n_abnormal") / F.lit(9.0)).alias("ratio"))


@query("A18_resumed_sweep", """SELECT sample, sum(n)::BIGINT AS n_abnormal, sum(t)::BIGINT AS n_total FROM (SELECT sample, threshold, count(*) FILTER (f) AS n, count(*) AS t FROM (SELECT sample, threshold, recall, coalesce(max(episcore) > 1.5, false) AS f FROM scores GROUP BY ALL) GROUP BY ALL) GROUP BY 1""")
def a18r(spark, sf):
    """A sweep in shards, one of thresholds each, that is stopped after the first and gone on with."""
    rows, path = C.held_scores(spark, sf), scratch(spark, "sweep")

    def score(shard: int):
        some = rows.where(F.col("threshold") == C.THRESHOLDS[shard])
        return resample.signal_counts(evaluate.max_chr_flags(some, C.COMBO, [C.CUTOFF], "episcore"), ["threshold"])

    made_with = {"thresholds": C.THRESHOLDS, "cutoff": C.CUTOFF}
    sweeps.run_sweep(spark, path, [0], score, made_with)
    sweeps.run_sweep(spark, path, range(len(C.THRESHOLDS)), score, made_with)
    return sweeps.summed(spark, path, ["sample"], ["n_abnormal", "n_total"], range(len(C.THRESHOLDS)))


# --- windows -------------------------------------------------------------------------------------------------------


@query("W4_distinct_over", "SELECT DISTINCT sample, chr, n_text, n_all FROM (SELECT r.sample, r.chr, d.n AS n_text, sum(1) OVER (PARTITION BY r.sample)::BIGINT AS n_all FROM reads r JOIN (SELECT sample, chr, count(DISTINCT text) AS n FROM reads GROUP BY ALL) d USING (sample, chr))")
def w4(spark, sf):
    rows = C.reads(spark, sf).withColumn("n_text", meta_etl.distinct_over("text", ["sample", "chr"])).withColumn("n_all", F.sum(F.lit(1)).over(Window.partitionBy("sample")))
    return rows.select("sample", "chr", "n_text", "n_all").distinct()


@query("W6_W7_order_numbers", "SELECT sample, label, row_number() OVER (PARTITION BY set ORDER BY balance DESC, sample) AS place, row_number() OVER (PARTITION BY label ORDER BY ff_before_mq, sample) - 1 AS cum FROM meta")
def w6(spark, sf):
    m = C.meta(spark, sf)
    return m.select("sample", "label", F.row_number().over(Window.partitionBy("set").orderBy(F.col("balance").desc(), "sample")).cast("long").alias("place"), (F.row_number().over(Window.partitionBy("label").orderBy("ff_before_mq", "sample")) - 1).cast("long").alias("cum"))


OUT = """SELECT sample, chr, {n} AS fold, {s} / nullif({c}, 0) AS mu, sqrt(greatest({q} / nullif({c}, 0) - ({s} / nullif({c}, 0)) ** 2, 0)) AS sd FROM (SELECT s.sample, s.chr, s.percentage AS x, f.fold FROM shares s JOIN (SELECT sample, ntile(4) OVER (ORDER BY sample) - 1 AS fold FROM refs) f USING (sample) WHERE threshold = 0.5::DOUBLE)"""
LOO = OUT.format(n="fold", s="(sum(x) OVER (PARTITION BY chr) - x)", q="(sum(x * x) OVER (PARTITION BY chr) - x * x)", c="(count(x) OVER (PARTITION BY chr) - 1)")
LFO = OUT.format(n="fold", s="(sum(x) OVER (PARTITION BY chr) - sum(x) OVER (PARTITION BY chr, fold))", q="(sum(x * x) OVER (PARTITION BY chr) - sum(x * x) OVER (PARTITION BY chr, fold))", c="(count(x) OVER (PARTITION BY chr) - count(x) OVER (PARTITION BY chr, fold))")


def pooled(spark, sf):
    folds = resample.fold_ids(C.reference(spark, sf), [], ["sample"], 4)
    return C.share_rows(spark, sf).where("threshold = 0.5D").join(folds, "sample").withColumn("x", F.col("percentage"))


@query("W10_X20_leave_one_out", f"SELECT sample, chr, coalesce(mu, 0) AS mu, sd FROM ({LOO})", "mu sd")
def w10(spark, sf):
    """Parameters without the sample itself."""
    return resample.leave_out(pooled(spark, sf), ["chr"], "x").selectExpr("sample", "chr", "x_mu as mu", "x_sd as sd")


@query("W11_W12_leave_fold_out", f"SELECT sample, chr, fold, coalesce(mu, 0) AS mu, sd FROM ({LFO})", "mu sd")
def w11(spark, sf):
    """Parameters without the sample's fold."""
    return resample.leave_out(pooled(spark, sf), ["chr"], "x", "fold").selectExpr("sample", "chr", "fold", "x_mu as mu", "x_sd as sd")


@query("W13_even_split", "SELECT sample, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sample) <= ceil(count(*) OVER (PARTITION BY label) / 2.0) THEN 'dev' ELSE 'test' END AS set FROM meta")
def w13(spark, sf):
    return resample.even_split(C.meta(spark, sf).drop("set")).select("sample", "label", "set")


@query("W14_W15_composite_rank", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, nullif(o_totalprice, 0) DESC NULLS LAST, o_orderdate DESC, o_orderpriority, o_orderkey) = 1")
def w15(spark, sf):
    """The first row by five keys."""
    order = [F.col("o_orderstatus").asc(), F.nullif("o_totalprice", F.lit(0.0)).desc_nulls_last(), F.col("o_orderdate").desc(), F.col("o_orderpriority").asc(), F.col("o_orderkey").asc()]
    return meta_etl.first_by(C.table(spark, sf, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey")


# --- sets and reshaping --------------------------------------------------------------------------------------------


@query("U1_U2_U3_union", "SELECT src, count(*) AS n, sum(v) AS total FROM (SELECT 'reads' AS src, prob_class_1 AS v FROM reads UNION ALL SELECT 'cpgs', meandiff FROM cpgs) GROUP BY 1", "total")
def u1(spark, sf):
    """Relaxed union: both to double."""
    a = C.reads(spark, sf).select(F.lit("reads").alias("src"), F.col("prob_class_1").alias("v"))
    b = C.cpgs(spark, sf).select(F.lit("cpgs").alias("src"), F.col("meandiff").cast("double").alias("v"))
    return a.unionByName(b).groupBy("src").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("U4_set_algebra", """SELECT (SELECT count(*) FROM (SELECT chr, start FROM cpgs WHERE recall > 0.3 INTERSECT SELECT chr, start FROM cpgs WHERE part % 3 = 0)) AS n_both, (SELECT count(*) FROM (SELECT chr, start FROM cpgs WHERE recall > 0.3 EXCEPT SELECT chr, start FROM cpgs WHERE part % 3 = 0)) AS n_only_a,
    (SELECT count(*) FROM (SELECT chr, start FROM cpgs WHERE part % 3 = 0 EXCEPT SELECT chr, start FROM cpgs WHERE recall > 0.3)) AS n_only_b, (SELECT count(*) FROM (SELECT chr, start FROM cpgs WHERE recall > 0.3 EXCEPT SELECT chr, start FROM cpgs WHERE part % 3 = 0)) = 0 AS a_in_b""")
def u4(spark, sf):
    rows = C.cpgs(spark, sf)
    return panel.set_algebra(rows.where("recall > 0.3D"), rows.where("part % 3 = 0"))


@query("U5_common_combos", "SELECT threshold, recall FROM scores WHERE sample = 1 INTERSECT SELECT threshold, recall FROM scores WHERE sample = 2", "threshold recall")
def u5(spark, sf):
    rows = C.cohort_scores(spark, sf)
    return rows.where("sample = 1").select(*C.COMBO).intersect(rows.where("sample = 2").select(*C.COMBO))


@query("U6_nested_lists", "SELECT chr, start FROM cpgs WHERE recall >= 0.6 EXCEPT SELECT chr, start FROM cpgs WHERE recall >= 0.65")
def u6(spark, sf):
    """Sites of one recall list that are not in the next."""
    rows = C.cpgs(spark, sf)
    return panel.without(rows.where("recall >= 0.6D"), rows.where("recall >= 0.65D"), ["chr", "start"]).select("chr", "start")


@query("R1_last_wins", "SELECT sample, chr, arg_max(prob_class_1, (name, insert_size, price, prob_class_1)) AS value FROM reads GROUP BY ALL", "value")
def r1(spark, sf):
    """One value a cell, the last of its order."""
    return C.reads(spark, sf).groupBy("sample", "chr").agg(F.max_by("prob_class_1", F.struct("name", "insert_size", "price", "prob_class_1")).alias("value"))


WIDE = ", ".join(f"max(zscore) FILTER (chr = 'chr{i}') AS chr{i}_zscore" for i in (1, 2, 13, 18, 21))


@query("R2_R4_pivot", f"SELECT sample, {WIDE} FROM fixed GROUP BY 1", " ".join(f"chr{i}_zscore" for i in (1, 2, 13, 18, 21)))
def r2(spark, sf):
    """One row a sample, a column a chromosome."""
    names = [f"chr{i}" for i in (1, 2, 13, 18, 21)]
    wide = C.fixed_combo_scores(spark, sf).groupBy("sample").pivot("chr", names).agg(F.max("zscore"))
    return wide.select("sample", *[F.col(n).alias(f"{n}_zscore") for n in names])


@query("R3_R6_unpivot", """SELECT sample, chr, s.metric, s.value, CASE WHEN label = replace(chr, 'chr', 'T') THEN 'hit' ELSE 'other' END AS point FROM (SELECT sample, chr, unnest(['episcore', 'zscore']) AS metric, unnest([episcore, zscore]) AS value FROM fixed) s JOIN meta USING (sample)""", "value")
def r3(spark, sf):
    """Tidy rows for a plot with the class of each point."""
    long = C.fixed_combo_scores(spark, sf).unpivot(["sample", "chr"], ["episcore", "zscore"], "metric", "value")
    return long.join(C.meta(spark, sf), "sample").select("sample", "chr", "metric", "value", F.when(F.col("label") == F.regexp_replace("chr", "^chr", "T"), "hit").otherwise("other").alias("point"))


@query("R5_vectors", "SELECT vec_id, array_length(v) AS n, list_sum(v) AS total FROM (SELECT vec_id, list_transform(string_split(array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE, 4)), ','), ','), lambda x: x::DOUBLE) AS v FROM embeddings)", "total")
def r5(spark, sf):
    """Score vectors to text and back."""
    text = S.vector_text(F.transform(F.col("embedding"), lambda x: F.round(x.cast("double"), 4)))
    v = S.vector(text)
    rows = C.table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))
