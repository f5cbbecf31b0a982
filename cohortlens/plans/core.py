"""Queries of the read, methylation, score, join, window and evaluation operators over the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions import scalar as S
from cohortlens.operators import admission, evaluate, meta_etl, methyl, panel, resample, scores, snp
from cohortlens.operators import reads as R
from cohortlens.plans import cohort as C
from cohortlens.plans.registry import query

# --- projections and filters ---------------------------------------------------------------------------------------


@query("P1_split_reads", """SELECT CASE WHEN prob_class_1 >= 0.5 AND insert_size <= 160 THEN 'target' ELSE 'background' END AS side, count(*) AS n, count(DISTINCT name) AS n_names FROM reads GROUP BY 1""")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    """Target and background by probability and insert size; a name can be in both."""
    sides = R.split_reads(C.reads(spark, sf), 0.5, 160)
    return sides[0].withColumn("side", F.lit("target")).unionByName(sides[1].withColumn("side", F.lit("background"))).groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


@query("P2_threshold_fanout", "SELECT sample, threshold, count(*) AS n FROM reads JOIN thr ON prob_class_1 >= threshold GROUP BY ALL")
def p2(spark, sf):
    """One pass over the reads for all thresholds."""
    return R.at_thresholds(C.reads(spark, sf), C.THRESHOLDS).groupBy("sample", "threshold").agg(F.count("*").alias("n"))


@query("P3_J1_replace_probability", """SELECT r.name, r.chr, r.start, coalesce(p.prob, r.prob_class_1) AS prob_class_1 FROM reads r
    LEFT JOIN (SELECT name, max(round(1 - prob_class_1, 1)) AS prob FROM reads WHERE insert_size % 4 = 0 GROUP BY name) p ON r.name = p.name""", "prob_class_1")
def p3(spark, sf):
    """Perturbed probabilities replace the original ones, of repeated names the largest."""
    reads = C.reads(spark, sf)
    perturbed = reads.where("insert_size % 4 = 0").select("name", F.round(1 - F.col("prob_class_1"), 1).alias("prob_class_1"))
    return R.replace_probability(reads, perturbed).select("name", "chr", "start", "prob_class_1")


@query("P4_direction", "SELECT chr, CASE WHEN meandiff < 0 THEN 'hypo' ELSE 'hyper' END AS direction, count(*) AS n FROM cpgs WHERE meandiff <> 0 GROUP BY ALL")
def p4(spark, sf):
    """Sites with no difference are in neither direction."""
    return C.cpgs(spark, sf).withColumn("direction", methyl.direction(F.col("meandiff"))).where("direction is not null").groupBy("chr", "direction").agg(F.count("*").alias("n"))


SIDES = """SELECT chr, start, count(*) FILTER (status = 'O' AND prob_class_1 >= 0.5) AS target_meth, count(*) FILTER (status = 'F' AND prob_class_1 >= 0.5) AS target_unmeth,
    count(*) FILTER (status = 'O' AND prob_class_1 < 0.5) AS background_meth, count(*) FILTER (status = 'F' AND prob_class_1 < 0.5) AS background_unmeth FROM reads GROUP BY ALL"""


def merged_sites(spark, sf):
    target, background = R.split_reads(C.reads(spark, sf), 0.5)
    return methyl.merge_sites(*[C.side(d, ["chr", "start"]) for d in (target, background)], ["chr", "start"])


@query("J2_merge_sites", f"""SELECT chr, start, target_meth, target_unmeth, background_meth, background_unmeth, target_meth + background_meth AS raw_meth, target_unmeth + background_unmeth AS raw_unmeth,
    target_meth + background_meth + target_unmeth + background_unmeth AS raw_total, target_meth / nullif(target_meth + target_unmeth, 0) AS target_beta, background_meth / nullif(background_meth + background_unmeth, 0) AS background_beta,
    (target_meth + background_meth) / nullif(target_meth + background_meth + target_unmeth + background_unmeth, 0) AS raw_beta FROM ({SIDES})""", "target_beta background_beta raw_beta")
def j2(spark, sf):
    """Full outer join of both sides' sites, 0 where one lacks it."""
    return merged_sites(spark, sf)


@query("P5_P6_depth_sites", f"SELECT chr, start, target_meth + background_meth + target_unmeth + background_unmeth AS raw_total FROM ({SIDES}) WHERE target_meth + background_meth + target_unmeth + background_unmeth > 30")
def p6(spark, sf):
    """Sites strictly deeper than 30 reads of both sides."""
    return methyl.deep_sites(merged_sites(spark, sf), 30).select("chr", "start", "raw_total")


@query("P7_min_depth", "SELECT chr, pos, n_ref, n_alt FROM snps WHERE n_ref + n_alt >= 30")
def p7(spark, sf):
    """SNP depth is inclusive."""
    return snp.clean_snps(C.snps(spark, sf), 30).select("chr", "pos", "n_ref", "n_alt")


@query("P8_chr_names", """SELECT raw, concat('chr', CASE upper(replace(raw, 'chr', '')) WHEN '23' THEN 'X' WHEN '24' THEN 'Y' ELSE upper(replace(raw, 'chr', '')) END) AS chr, count(*) AS n
    FROM (SELECT CASE WHEN part % 2 = 0 THEN concat('chr', 1 + part % 24) ELSE CAST(1 + part % 24 AS VARCHAR) END AS raw FROM cpgs) GROUP BY ALL""")
def p8(spark, sf):
    """Prefixes and allosome codes made uniform."""
    raw = C.cpgs(spark, sf).selectExpr("case when part % 2 = 0 then concat('chr', 1 + part % 24) else cast(1 + part % 24 as string) end as raw")
    return raw.withColumn("chr", S.chr_name(F.col("raw"))).groupBy("raw", "chr").agg(F.count("*").alias("n"))


CALLS = """SELECT name, chr, part, ['A', 'C', 'G', 'T'][1 + (part % 4)::INT] AS ref, ['A', 'C', 'G', 'T'][1 + ((part + 1 + part % 3) % 4)::INT] AS alt, ['A', 'C', 'G', 'T'][1 + (insert_size // 2 % 4)::INT] AS base,
    [0, 16, 83, 99, 147, 163, 1024, 256][1 + (insert_size // 2 % 8)::INT] AS flag, 10 + mTcount::INT * 5 AS mapq, 10 + (part % 10)::INT AS bq FROM reads"""


def calls(spark, sf):
    pick = lambda names, at: f"element_at(array({names}), cast(1 + {at} as int))"
    bases = "'A', 'C', 'G', 'T'"
    return C.reads(spark, sf).selectExpr(
        "name", "chr", "part as pos", f"{pick(bases, 'part % 4')} as ref", f"{pick(bases, '(part + 1 + part % 3) % 4')} as alt", f"{pick(bases, 'insert_size div 2 % 4')} as base",
        f"{pick('0, 16, 83, 99, 147, 163, 1024, 256', 'insert_size div 2 % 8')} as flag", "10 + cast(mTcount as int) * 5 as mapq", "10 + cast(part % 10 as int) as bq",
    )


@query("P9_usable_flags", f"""SELECT ref, alt, flag, CASE WHEN (ref = 'C' AND alt = 'T') OR (ref = 'T' AND alt = 'C') THEN flag IN (16, 83, 163) WHEN (ref = 'G' AND alt = 'A') OR (ref = 'A' AND alt = 'G') THEN flag IN (0, 99, 147) ELSE true END AS usable,
    count(*) AS n FROM ({CALLS}) GROUP BY ALL""")
def p9(spark, sf):
    """Strands that can tell converted bases from alleles."""
    return calls(spark, sf).withColumn("usable", snp.usable_flag(F.col("ref"), F.col("alt"), F.col("flag"))).groupBy("ref", "alt", "flag", "usable").agg(F.count("*").alias("n"))


ALLELE = """CASE WHEN CASE WHEN ref = 'C' AND alt <> 'T' THEN base IN ('C', 'T') WHEN ref = 'G' AND alt <> 'A' THEN base IN ('G', 'A') ELSE base = ref END THEN 'REF'
    WHEN CASE WHEN alt = 'C' AND ref <> 'T' THEN base IN ('C', 'T') WHEN alt = 'G' AND ref <> 'A' THEN base IN ('G', 'A') ELSE base = alt END THEN 'ALT' END"""


@query("P10_P11_alleles", f"SELECT ref, alt, base, {ALLELE} AS converted, CASE base WHEN ref THEN 'REF' WHEN alt THEN 'ALT' END AS plain, count(*) AS n FROM ({CALLS}) GROUP BY ALL")
def p10(spark, sf):
    """Alleles with and without conversion."""
    args = [F.col(c) for c in ("ref", "alt", "base")]
    return calls(spark, sf).withColumn("converted", snp.converted_allele(*args)).withColumn("plain", snp.plain_allele(*args)).groupBy("ref", "alt", "base", "converted", "plain").agg(F.count("*").alias("n"))


@query("P12_pileup_quality", f"SELECT chr, count(*) AS n FROM ({CALLS}) WHERE mapq >= 20 AND bq >= 13 AND flag & 3332 = 0 GROUP BY ALL")
def p12(spark, sf):
    """Mapping and base quality and flags of a pileup's reads."""
    return R.pileup_quality(calls(spark, sf)).groupBy("chr").agg(F.count("*").alias("n"))


@query("P13_analysis_modes", """SELECT mode, count(*) AS n, sum(n_ref)::BIGINT AS n_ref FROM (SELECT 'all' AS mode, * FROM snps UNION ALL
    SELECT CASE WHEN c.chr = s.chr THEN concat(c.chr, '_only') ELSE concat(c.chr, '_exclude') END, s.* FROM snps s, chrs c) GROUP BY ALL""")
def p13(spark, sf):
    """Each SNP in every subset of chromosomes it belongs to."""
    return snp.analysis_modes(C.snps(spark, sf), scores.chromosomes(spark)).groupBy("mode").agg(F.count("*").alias("n"), F.sum("n_ref").alias("n_ref"))


@query("P14_P16_recall_range", "SELECT chr, count(*) AS n FROM cpgs WHERE recall BETWEEN 0.3 AND 0.99 GROUP BY ALL")
def p14(spark, sf):
    return C.cpgs(spark, sf).where(F.col("recall").between(0.3, evaluate.MAX_RECALL)).groupBy("chr").agg(F.count("*").alias("n"))


@query("P15_eval_masks", """SELECT sample, set = 'dev' AND label = 'Normal' AS in_pool, (set = 'dev' AND regexp_matches(label, '^T\\d')) OR set = 'test' AS in_eval FROM meta""")
def p15(spark, sf):
    """Reference pool and evaluation set."""
    tri = S.is_trisomy(F.col("label"))
    return C.meta(spark, sf).select("sample", ((F.col("set") == "dev") & (F.col("label") == "Normal")).alias("in_pool"), (((F.col("set") == "dev") & tri) | (F.col("set") == "test")).alias("in_eval"))


@query("P17_label_mapping", """SELECT sample, CASE WHEN starts_with(l, 'Gray_') THEN 'Normal' ELSE l END AS label FROM (SELECT sample, CASE WHEN sample % 3 = 0 THEN concat('Gray_', label) ELSE label END AS l FROM meta)""")
def p17(spark, sf):
    label = F.when(F.col("sample") % 3 == 0, F.concat(F.lit("Gray_"), "label")).otherwise(F.col("label"))
    return C.meta(spark, sf).select("sample", F.when(label.startswith("Gray_"), "Normal").otherwise(label).alias("label"))


@query("P18_depth_qc", """SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE), o_orderkey::DOUBLE) >= 500 AS pass FROM orders""")
def p18(spark, sf):
    """A depth with a fallback column, coerced."""
    text = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return C.table(spark, sf, "orders").select("o_orderkey", (F.coalesce(S.number(text), F.col("o_orderkey").cast("double")) >= 500).alias("pass"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query("J3_panel_join", "SELECT c.sample, c.chr, c.start, c.meth, c.unmeth, p.meandiff, p.recall FROM calls c JOIN cpgs p ON c.chr = p.chr AND c.start = p.start WHERE threshold = 0.5::DOUBLE", "recall")
def j3(spark, sf):
    target = R.split_reads(C.reads(spark, sf), 0.5)[0]
    sites = C.side(target, ["sample", "chr", "start"]).withColumn("end", F.col("start") + 1)
    return methyl.at_panel(sites, C.cpgs(spark, sf)).select("sample", "chr", "start", "meth", "unmeth", "meandiff", "recall")


@query("J4_J5_site_lists", f"""SELECT s.chr, s.start, p.meandiff FROM ({SIDES}) s JOIN cpgs p ON s.chr = p.chr AND s.start = p.start WHERE p.recall >= 0.5 AND target_meth + background_meth + target_unmeth + background_unmeth > 25""")
def j5(spark, sf):
    """Sites in a recall list and in the list of deep sites."""
    sites = merged_sites(spark, sf).withColumn("end", F.col("start") + 1)
    return methyl.only_sites(methyl.at_panel(sites, C.cpgs(spark, sf), 0.5), methyl.deep_sites(sites, 25)).select("chr", "start", "meandiff")


@query("J6_merge_pileups", """SELECT coalesce(t.chr, b.chr) AS chr, coalesce(t.pos, b.pos) AS pos, coalesce(t.af, b.af)::DOUBLE AS af, coalesce(t.n_ref, 0) AS target_ref, coalesce(t.n_alt, 0) AS target_alt, coalesce(b.n_ref, 0) AS background_ref, coalesce(b.n_alt, 0) AS background_alt
    FROM (SELECT * FROM snps WHERE pos % 3 <> 0) t FULL JOIN (SELECT * FROM snps WHERE pos % 3 <> 1) b ON t.chr = b.chr AND t.pos = b.pos AND t.af = b.af""", "af")
def j6(spark, sf):
    """Full outer join on five keys, the frequency as a decimal."""
    rows = C.snps(spark, sf).withColumn("ref", F.lit("A")).withColumn("alt", F.lit("C"))
    out = snp.merge_pileups(rows.where("pos % 3 <> 0"), rows.where("pos % 3 <> 1"))
    return out.select("chr", "pos", F.col("af").cast("double").alias("af"), "target_ref", "target_alt", "background_ref", "background_alt")


@query("J7_panel_semi", "SELECT chr, pos, n_ref FROM snps WHERE pos IN (SELECT part FROM cpgs WHERE recall > 0.5)")
def j7(spark, sf):
    keys = C.cpgs(spark, sf).where("recall > 0.5D").select("chr", F.col("part").alias("pos")).distinct()
    return C.snps(spark, sf).join(keys, ["chr", "pos"], "left_semi").select("chr", "pos", "n_ref")


@query("J8_reads_with_site", """SELECT sample, r.chr, count(*) AS n FROM reads r WHERE EXISTS (SELECT 1 FROM cpgs p WHERE p.chr = r.chr AND p.recall > 0.6 AND p.start BETWEEN r.start AND r."end") GROUP BY ALL""")
def j8(spark, sf):
    """Range semi-join on chromosome and bin."""
    points = C.cpgs(spark, sf).where("recall > 0.6D").select("chr", F.col("start").alias("pos"))
    return R.containing_a_point(C.reads(spark, sf), points).groupBy("sample", "chr").agg(F.count("*").alias("n"))


INTERVALS = """SELECT l_orderkey AS id, l_linenumber AS line, concat('chr', 1 + l_partkey % 22) AS chr, l_partkey * 10 AS start, l_partkey * 10 + (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) * (l_quantity * 40)::BIGINT AS "end" FROM lineitem"""


@query("J9_X34_points_inside", f"""SELECT i.id, i.line, i.chr, i.start, i."end", abs(i."end" - i.start) AS length, count(p.start) AS n_points, count(p.start) >= 3 AS keep FROM (SELECT DISTINCT * FROM ({INTERVALS})) i
    LEFT JOIN cpgs p ON p.chr = i.chr AND p.start BETWEEN least(i.start, i."end") AND greatest(i.start, i."end") GROUP BY ALL""")
def j9(spark, sf):
    """Intervals with their length, target sites inside and whether they are kept; ends may be reversed."""
    return with_points(C.table(spark, sf, "lineitem"), C.cpgs(spark, sf))


def with_points(items, sites):
    rows = items.selectExpr("l_orderkey as id", "l_linenumber as line", "concat('chr', 1 + l_partkey % 22) as chr", "l_partkey * 10 as start",
        "l_partkey * 10 + (case when l_linenumber % 2 = 0 then -1 else 1 end) * cast(l_quantity * 40 as bigint) as end").distinct()
    out = R.points_inside(rows, sites.select("chr", F.col("start").alias("pos")))
    return out.select("id", "line", "chr", "start", "end", F.abs(F.col("end") - F.col("start")).alias("length"), "n_points", (F.col("n_points") >= 3).alias("keep"))


ASOF = """SELECT c.chr, c.start, c."end", p.start AS probe_start, p."end" AS probe_end FROM cpgs c ASOF LEFT JOIN (SELECT chr, start, max("end") AS "end" FROM probes GROUP BY ALL) p ON c.chr = p.chr AND c.start >= p.start"""


@query("J10_latest_probe", ASOF)
def j10(spark, sf):
    """As-of join backward by chromosome."""
    return panel.latest_probe(C.cpgs(spark, sf).select("chr", "start", "end"), C.probes(spark, sf))


@query("J10_probes_over_sites", f'SELECT DISTINCT chr, probe_start AS start, probe_end AS "end" FROM ({ASOF}) WHERE start < probe_end AND "end" > probe_start')
def j10b(spark, sf):
    return panel.probes_over(C.cpgs(spark, sf).select("chr", "start", "end"), C.probes(spark, sf))


SNP_POS = "SELECT chr, start + part % 30 AS pos, part FROM cpgs"


@query("J11_snps_in_probes", f"""SELECT chr, pos, part FROM (SELECT s.*, p.start AS ps, p."end" AS pe FROM (SELECT *, pos - 1 AS s0 FROM ({SNP_POS})) s ASOF LEFT JOIN (SELECT chr, start, max("end") AS "end" FROM probes GROUP BY ALL) p ON s.chr = p.chr AND s.s0 >= p.start) WHERE s0 < pe AND pos > ps""")
def j11(spark, sf):
    return panel.snps_in_probes(C.cpgs(spark, sf).selectExpr("chr", "start + part % 30 as pos", "part"), C.probes(spark, sf))


@query("J12_probes_without_site", """SELECT chr, start, "end" FROM probes p WHERE NOT EXISTS (SELECT 1 FROM cpgs c WHERE c.part % 7 = 0 AND c.chr = p.chr AND c.start = p.start)""")
def j12(spark, sf):
    return panel.without(C.probes(spark, sf), C.cpgs(spark, sf).where("part % 7 = 0"), ["chr", "start"])


@query("J13_blacklist", """SELECT chr, start, "end", recall FROM cpgs WHERE part % 5 <> 0""", "recall")
def j13(spark, sf):
    rows = C.cpgs(spark, sf)
    return panel.without(rows, rows.where("part % 5 = 0")).select("chr", "start", "end", "recall")


@query("J14_X8_merge_scores", """SELECT m.sample, chrs.chr, episcore, zscore, (episcore + zscore - s.ez_mean) / nullif(s.ez_sd, 0) AS ezscore FROM meta m CROSS JOIN chrs
    LEFT JOIN fixed f ON f.sample = m.sample AND f.chr = chrs.chr LEFT JOIN (SELECT * FROM ezstats WHERE threshold = 0.5::DOUBLE AND recall = 0.2::DOUBLE) s ON s.chr = chrs.chr""", "episcore zscore ezscore")
def j14(spark, sf):
    """Every sample and chromosome with both scores and their combination."""
    rows = C.fixed_combo_scores(spark, sf)
    stats = scores.ez_stats(rows, C.ez_reference(spark, sf), ["chr"])
    return scores.merged(scores.chromosomes(spark), C.meta(spark, sf), rows.select("sample", "chr", "episcore"), rows.select("sample", "chr", "zscore"), stats)


@query("J15_J17_meta_join", "SELECT sample, label, n FROM meta LEFT JOIN (SELECT sample, count(*) AS n FROM reads WHERE prob_class_1 >= 0.9 GROUP BY 1) USING (sample)")
def j17(spark, sf):
    n = C.reads(spark, sf).where("prob_class_1 >= 0.9D").groupBy("sample").agg(F.count("*").alias("n"))
    return C.meta(spark, sf).join(n, "sample", "left").select("sample", "label", "n")


@query("J16_one_to_many", "SELECT m.sample, m.label, t.threshold, s.chr, s.n_reads FROM meta m JOIN shares s USING (sample) JOIN thr t USING (threshold)", "threshold")
def j16(spark, sf):
    return C.meta(spark, sf).select("sample", "label").join(C.share_rows(spark, sf), "sample").select("sample", "label", "threshold", "chr", "n_reads")


DEPTHS = """SELECT sample, chr, start, start + 1 AS "end", count(*) AS depth FROM reads GROUP BY sample, chr, start"""
NORM = f"""SELECT chr, start, "end", avg(depth / nullif(mean, 0)) AS mean_norm_depth FROM (SELECT *, avg(depth) OVER (PARTITION BY sample) AS mean FROM ({DEPTHS})) GROUP BY ALL"""
PANELS = f"""SELECT w.*, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'weak' THEN round(d, 9) ELSE -round(d, 9) END, chr, start, "end") AS rn FROM (
    SELECT CASE WHEN recall >= 0.6 THEN 'weak' ELSE 'strong' END AS side, c.chr, c.start, c."end", coalesce(n.mean_norm_depth, 0) AS d FROM cpgs c LEFT JOIN ({NORM}) n USING (chr, start, "end") WHERE recall >= 0.5) w"""


def depths(spark, sf):
    return C.reads(spark, sf).groupBy("sample", "chr", "start").agg(F.count("*").alias("depth")).withColumn("end", F.col("start") + 1)


@query("A37_W1_normal_depth", NORM, "mean_norm_depth")
def a37(spark, sf):
    """Depth relative to the sample's mean, by site."""
    return panel.mean_normal_depth(depths(spark, sf))


@query("J18_J19_X32_replace_sites", f"""SELECT coalesce(s.chr_donor, p.chr) AS chr, coalesce(s.start_donor, p.start) AS start, coalesce(s.end_donor, p."end") AS "end", s.chr_donor IS NOT NULL AS replaced FROM (SELECT chr, start, "end" FROM cpgs WHERE recall >= 0.6) p LEFT JOIN (
    SELECT a.chr, a.start, a."end", b.chr AS chr_donor, b.start AS start_donor, b."end" AS end_donor FROM ({PANELS}) a JOIN ({PANELS}) b ON a.rn = b.rn AND a.side = 'weak' AND b.side = 'strong' AND b.d > a.d) s USING (chr, start, "end")""")
def x32(spark, sf):
    """The shallowest sites replaced by the deepest donors, rank by rank."""
    rows = C.cpgs(spark, sf)
    return panel.replace_sites(rows.where("recall >= 0.6D"), rows.where("recall >= 0.5D and recall < 0.6D"), panel.mean_normal_depth(depths(spark, sf)))


@query("J20_J21_combo_pairs", "SELECT a.threshold, a.recall, b.threshold AS z_threshold, count(*) AS n FROM (SELECT DISTINCT threshold, recall FROM scores) a, (SELECT DISTINCT threshold FROM shares) b GROUP BY ALL", "threshold recall z_threshold")
def j20(spark, sf):
    """Both combination lists crossed: a few rows each."""
    a = C.episcore_rows(spark, sf).select("threshold", "recall").distinct()
    b = C.share_rows(spark, sf).select(F.col("threshold").alias("z_threshold")).distinct()
    return a.crossJoin(F.broadcast(b)).groupBy("threshold", "recall", "z_threshold").agg(F.count("*").alias("n"))


@query("J22_nearest_record", """SELECT o_orderkey, event_id, abs(date_diff('day', d, e.t)) AS days FROM (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d FROM orders) o JOIN (SELECT event_id, user_id, ts::DATE AS t FROM events) e ON e.user_id = o.o_custkey
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(date_diff('day', d, e.t)), event_id) = 1""")
def j22(spark, sf):
    """Each order's nearest event of the same customer, in days."""
    left = C.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("who"), F.to_date("o_orderdate").alias("d"))
    right = C.table(spark, sf, "events").select("event_id", F.col("user_id").alias("who"), F.to_date("ts").alias("t"))
    return meta_etl.nearest_record(left, right, ["who"], "d", "t", [F.col("event_id")]).select("o_orderkey", "event_id", "days")


FILES = "SELECT concat('c', o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'H1' WHEN o_orderkey % 3 = 0 THEN 'S1' ELSE '' END) AS sample, o_orderkey AS clean_bam, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE concat('b', {day}(o_orderdate, '{form}')) END AS batch FROM {{orders}}"
RECORDS = """SELECT concat('c', user_id, CASE event_id % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'H1' ELSE '' END) AS sample, concat(CASE WHEN event_id % 10 = 0 THEN 'x' ELSE concat('d', {day}(ts, '{form}')) END, event_type, CASE event_id % 4 WHEN 0 THEN '-XML' WHEN 1 THEN '-XML2' ELSE '' END) AS dataset,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS dataset_date, CAST(event_id % 13 AS DOUBLE) AS lam, value AS puc19 FROM {{events}}"""


def duck(view: str) -> str:
    return view.format(day="strftime", form="%Y%m%d").format(orders="orders", events="events")


def shown(spark, sf, view: str):
    return spark.sql(view.format(day="date_format", form="yyyyMMdd"), orders=C.table(spark, sf, "orders"), events=C.table(spark, sf, "events"))


@query("J22_qc_mapping", f"""WITH f AS (SELECT *, TRY_CAST(strptime(nullif(regexp_extract(batch, '(20\\d{{6}})', 1), ''), '%Y%m%d') AS DATE) AS d, CASE WHEN suffix(sample, 'H1') THEN left(sample, -2) || 'S1' WHEN suffix(sample, 'S1') THEN left(sample, -2) || 'H1' END AS other FROM ({duck(FILES)})),
    q AS (SELECT *, coalesce(dataset_date, TRY_CAST(strptime(nullif(regexp_extract(dataset, '(20\\d{{6}})', 1), ''), '%Y%m%d') AS DATE)) AS qd, CASE WHEN suffix(dataset, '-XML') THEN 0 WHEN contains(dataset, '-XML') THEN 1 ELSE 2 END AS liked FROM ({duck(RECORDS)})),
    u AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n_qc FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY sample, dataset ORDER BY qd NULLS LAST, puc19, lam) = 1)),
    m AS (SELECT *, CASE WHEN sample IN (SELECT sample FROM u) THEN sample WHEN other IN (SELECT sample FROM u) THEN other END AS qc_sample, count(*) OVER (PARTITION BY sample) AS n_bam FROM f),
    j AS (SELECT m.*, u.dataset, u.qd, u.lam, u.puc19, u.n_qc, abs(date_diff('day', m.d, u.qd)) AS delta, u.liked FROM m LEFT JOIN u ON u.sample = m.qc_sample QUALIFY row_number() OVER (PARTITION BY clean_bam ORDER BY coalesce(abs(date_diff('day', m.d, u.qd)), 1000000000), u.liked, u.dataset) = 1)
    SELECT clean_bam, qc_sample, CASE WHEN qc_sample IS NULL THEN 'missing' WHEN qc_sample = sample THEN 'exact_sample' ELSE 'hs_swap' END AS sample_match, CASE WHEN qc_sample IS NULL THEN 'missing' WHEN n_qc > 1 THEN 'nearest_date' WHEN n_bam = 1 THEN 'direct_singleton' ELSE 'direct_single_qc' END AS map_rule,
        coalesce(n_qc, 0) AS n_qc_for_sample, n_bam AS n_bam_for_sample, dataset AS qc_dataset, delta AS day_delta, lam, puc19 FROM j""", "lam puc19")
def j22q(spark, sf):
    """Files with the quality record of their sample, or of its other name, by rules and dates."""
    return meta_etl.map_to_qc(shown(spark, sf, FILES), shown(spark, sf, RECORDS).withColumnRenamed("lam", "lambda")).withColumnRenamed("lambda", "lam").drop("sample", "qc_dataset_date")


@query("J25_sample_universe", "SELECT sample FROM meta WHERE sample IN (SELECT sample FROM reads WHERE prob_class_1 >= 0.7) AND sample IN (SELECT sample FROM shares) AND ff_before_mq > 0.01 UNION SELECT sample FROM refs")
def j25(spark, sf):
    m = C.meta(spark, sf)
    some = m.where("ff_before_mq > 0.01D").select("sample").intersect(C.reads(spark, sf).where("prob_class_1 >= 0.7D").select("sample")).intersect(C.share_rows(spark, sf).select("sample"))
    return some.union(C.reference(spark, sf)).distinct()


@query("J26_missing_rows", """SELECT m.sample, t.threshold, r.recall, c.chr FROM meta m, thr t, rec r, chrs c WHERE NOT EXISTS (SELECT 1 FROM eprows e WHERE e.sample = m.sample AND e.threshold = t.threshold AND e.recall = r.recall AND e.chr = c.chr)""", "threshold recall")
def j26(spark, sf):
    """Expected rows that are absent."""
    combos = spark.createDataFrame([(t, r) for t in C.THRESHOLDS for r in C.RECALLS], "threshold double, recall double")
    return meta_etl.missing_rows(C.episcore_rows(spark, sf), C.meta(spark, sf), combos, scores.chromosomes(spark))


# --- levels and scores ---------------------------------------------------------------------------------------------


@query("A1_levels", "SELECT sample, chr, direction, meth::BIGINT AS meth, unmeth::BIGINT AS unmeth, n_cpgs, beta FROM levels WHERE threshold = 0.5::DOUBLE AND recall = 0.2::DOUBLE", "beta")
def a1(spark, sf):
    target = R.split_reads(C.reads(spark, sf), 0.5)[0]
    sites = C.side(target, ["sample", "chr", "start"]).withColumn("end", F.col("start") + 1)
    return methyl.levels(methyl.at_panel(sites, C.cpgs(spark, sf), 0.2), ["sample"])


@query("A2_total_levels", """SELECT sample, c.chr, CASE WHEN meandiff < 0 THEN 'hypo' ELSE 'hyper' END AS direction, sum(meth) / nullif(sum(total), 0) AS beta FROM (SELECT sample, chr, start, count(*) FILTER (status = 'O') AS meth, count(*) AS total FROM reads GROUP BY ALL) c JOIN cpgs p ON c.chr = p.chr AND c.start = p.start WHERE meandiff <> 0 GROUP BY ALL""", "beta")
def a2(spark, sf):
    """Levels before any split, from totals."""
    sites = C.reads(spark, sf).groupBy("sample", "chr", "start").agg(F.count_if(F.col("status") == "O").alias("meth"), F.count("*").alias("total"))
    rows = sites.join(C.cpgs(spark, sf), ["chr", "start"]).withColumn("direction", methyl.direction(F.col("meandiff"))).where("direction is not null")
    return rows.groupBy("sample", "chr", "direction").agg(S.ratio(F.sum("meth"), F.sum("total")).alias("beta"))


@query("W2_intra_z", "SELECT sample, threshold, recall, chr, direction, z_intra FROM zintra", "threshold recall z_intra")
def w2(spark, sf):
    """Levels of chromosomes standardised within the sample."""
    calls_ = C.side(R.at_thresholds(C.reads(spark, sf), C.THRESHOLDS), ["sample", "threshold", "chr", "start"])
    panel_ = C.cpgs(spark, sf).withColumn("recall", F.explode(F.filter(F.array(*map(F.lit, C.RECALLS)), lambda r: F.col("recall") >= r))).select("chr", "start", "meandiff", "recall")
    level = methyl.levels(calls_.join(panel_, ["chr", "start"]), ["sample", "threshold", "recall"])
    return methyl.intra_z(level, ["sample", "threshold", "recall"]).select("sample", "threshold", "recall", "chr", "direction", "z_intra")


@query("A3_count_alleles", f"""WITH c AS ({CALLS}), s AS (SELECT DISTINCT chr, part AS pos, ref, alt FROM c), o AS (SELECT chr, part, name, min({ALLELE}) AS allele FROM c WHERE CASE WHEN (ref = 'C' AND alt = 'T') OR (ref = 'T' AND alt = 'C') THEN flag IN (16, 83, 163) WHEN (ref = 'G' AND alt = 'A') OR (ref = 'A' AND alt = 'G') THEN flag IN (0, 99, 147) ELSE true END AND {ALLELE} IS NOT NULL GROUP BY ALL)
    SELECT s.chr, s.pos, s.ref, s.alt, count(*) FILTER (allele = 'REF') AS n_ref, count(*) FILTER (allele = 'ALT') AS n_alt FROM s LEFT JOIN o ON s.chr = o.chr AND s.pos = o.part GROUP BY ALL""")
def a3(spark, sf):
    """Alleles by site, one call for each template."""
    rows = calls(spark, sf)
    return snp.count_alleles(rows.select("name", "chr", "pos", "flag", "base"), rows.select("chr", "pos", "ref", "alt").distinct())


@query("A4_W3_read_shares", "SELECT sample, threshold, chr, n_reads, percentage FROM shares", "threshold percentage")
def a4(spark, sf):
    return C.share_rows(spark, sf)


@query("A5_reference_stats", "SELECT threshold, recall, chr, hypo_z_mean, hypo_z_sd, hyper_z_mean, hyper_z_sd FROM epstats", "threshold recall hypo_z_mean hypo_z_sd hyper_z_mean hyper_z_sd")
def a5(spark, sf):
    return scores.reference_stats(C.episcore_rows(spark, sf), C.reference(spark, sf), ["threshold", "recall", "chr"], ["hypo_z", "hyper_z"])


@query("A6_X38_sample_sd", "SELECT threshold, chr, avg(percentage) AS percentage_mean, stddev_samp(percentage) AS percentage_sd FROM shares JOIN refs USING (sample) GROUP BY ALL", "threshold percentage_mean percentage_sd")
def a6(spark, sf):
    """Reference shares with the sample SD."""
    return scores.reference_stats(C.share_rows(spark, sf), C.reference(spark, sf), ["threshold", "chr"], ["percentage"], sample_sd=True)


@query("X9_cohort_scores", "SELECT sample, threshold, recall, chr, episcore, zscore FROM scores", "threshold recall episcore zscore")
def x9(spark, sf):
    """Scores of all samples at all combinations."""
    return C.cohort_scores(spark, sf)


@query("X5_episcore", "SELECT sample, chr, episcore FROM episcores WHERE threshold = 0.5::DOUBLE AND recall = 0.5::DOUBLE", "episcore")
def x5(spark, sf):
    rows = C.episcore_rows(spark, sf).where("threshold = 0.5D and recall = 0.5D")
    return scores.episcore_of(rows, C.reference(spark, sf), ["threshold", "recall", "chr"]).select("sample", "chr", "episcore")


BEST = "SELECT chr, CASE WHEN i % 2 = 0 THEN 0.5 ELSE 0.7 END::DOUBLE AS threshold, CASE WHEN i % 3 = 0 THEN 0.2 ELSE 0.5 END::DOUBLE AS recall FROM (SELECT concat('chr', i) AS chr, i FROM range(1, 23) t(i))"


def best(spark):
    return spark.range(1, 23).selectExpr("concat('chr', id) as chr", "case when id % 2 = 0 then 0.5D else 0.7D end as threshold", "case when id % 3 = 0 then 0.2D else 0.5D end as recall")


@query("X6_flexible_episcore", f"SELECT sample, chr, threshold, recall, episcore FROM episcores JOIN ({BEST}) USING (chr, threshold, recall)", "threshold recall episcore")
def x6(spark, sf):
    """Each chromosome at its own combination; standardised over all chromosomes of the combination before the choice."""
    rows = C.episcore_rows(spark, sf)
    epi = scores.episcore_of(rows, C.reference(spark, sf), [*C.COMBO, "chr"])
    return scores.at_best_combo(epi, best(spark), C.COMBO).select("sample", "chr", *C.COMBO, "episcore")


@query("X7_flexible_zscore", f"""WITH u AS (SELECT * FROM reads QUALIFY row_number() OVER (PARTITION BY sample, chr, start, "end", text ORDER BY prob_class_1 DESC, name) = 1), n AS (SELECT sample, threshold, chr, count(*) AS n FROM u JOIN thr ON prob_class_1 >= threshold WHERE EXISTS (SELECT 1 FROM cpgs p WHERE p.chr = u.chr AND p.recall > 0.3 AND p.start BETWEEN u.start AND u."end") GROUP BY ALL),
    s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY sample, threshold) AS percentage FROM n), r AS (SELECT threshold, chr, coalesce(avg(percentage), 0) AS m, stddev_pop(percentage) AS sd FROM s JOIN refs USING (sample) GROUP BY ALL)
    SELECT sample, chr, threshold, coalesce((percentage - m) / nullif(sd, 0), 0) AS zscore FROM s LEFT JOIN r USING (threshold, chr) JOIN (SELECT chr, threshold FROM ({BEST})) USING (chr, threshold)""", "threshold zscore")
def x7(spark, sf):
    """Unique reads with a site, their shares by chromosome at its threshold, against the reference."""
    points = C.cpgs(spark, sf).where("recall > 0.3D").select("chr", F.col("start").alias("pos"))
    rows = R.containing_a_point(R.unique_reads(C.reads(spark, sf)), points)
    shares = scores.shares_of(R.threshold_counts(rows.where(F.col("chr").isin(*S.AUTOSOMES)), C.THRESHOLDS, ["sample", "chr"], {"n_reads": F.lit(True)}), ["sample", "threshold"])
    z = scores.zscore_of(shares, C.reference(spark, sf), ["threshold", "chr"], fill=True)
    return scores.at_best_combo(z, best(spark), ["threshold"]).select("sample", "chr", "threshold", "zscore")


@query("X10_A8_ezscore", "SELECT sample, threshold, recall, chr, ezscore FROM ez", "threshold recall ezscore")
def x10(spark, sf):
    return C.cohort_ezscores(spark, sf).select("sample", *C.COMBO, "chr", "ezscore")


@query("X35_query_grid", "SELECT threshold, recall, chr, hypo_z, hyper_z, hypo_n, hyper_n FROM eprows WHERE sample = 1", "threshold recall hypo_z hyper_z")
def x35(spark, sf):
    """All combinations of one sample."""
    return C.episcore_rows(spark, sf).where("sample = 1").drop("sample")


@query("A7_reference_matrix", f"""SELECT chr, e.threshold, e.recall, hypo_z_mean, hypo_z_sd, hyper_z_mean, hyper_z_sd, percentage_mean, percentage_sd FROM epstats e JOIN ({BEST}) b USING (chr, threshold, recall) JOIN zstats z USING (chr, threshold)""", "threshold recall hypo_z_mean hypo_z_sd hyper_z_mean hyper_z_sd percentage_mean percentage_sd")
def a7(spark, sf):
    """Reference statistics of each chromosome at its combination."""
    ref = C.reference(spark, sf)
    e = scores.reference_stats(C.episcore_rows(spark, sf), ref, [*C.COMBO, "chr"], ["hypo_z", "hyper_z"])
    z = scores.reference_stats(C.share_rows(spark, sf), ref, ["threshold", "chr"], ["percentage"])
    return e.join(F.broadcast(best(spark)), ["chr", *C.COMBO], "left_semi").join(z, ["threshold", "chr"]).select("chr", *C.COMBO, "hypo_z_mean", "hypo_z_sd", "hyper_z_mean", "hyper_z_sd", "percentage_mean", "percentage_sd")


@query("X33_chrX", """WITH n AS (SELECT sample, CASE WHEN part % 22 = 21 THEN 'chrX' ELSE chr END AS chr, count(*) AS n FROM reads GROUP BY ALL), s AS (SELECT *, n / nullif(sum(n) FILTER (chr <> 'chrX') OVER (PARTITION BY sample), 0) AS p FROM n), r AS (SELECT avg(p) AS m, stddev_samp(p) AS sd FROM s JOIN refs USING (sample) WHERE chr = 'chrX')
    SELECT sample, p AS percentage, (p - m) / nullif(sd, 0) AS zscore FROM s, r WHERE chr = 'chrX'""", "percentage zscore")
def x33(spark, sf):
    """Reads of chrX over those of the autosomes, with the sample SD."""
    rows = C.reads(spark, sf).withColumn("chr", F.when(F.col("part") % 22 == 21, "chrX").otherwise(F.col("chr")))
    shares = scores.read_shares(rows, ["sample"], (*S.AUTOSOMES, "chrX"))
    z = scores.zscore_of(shares, C.reference(spark, sf), ["chr"], sample_sd=True)
    return z.where("chr = 'chrX'").select("sample", "percentage", "zscore")
