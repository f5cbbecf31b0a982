"""Queries of the readers and writers: each writes files from the generated tables and reads them back."""

from __future__ import annotations

import gzip
import random
import uuid

from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import charts, snp
from cohortlens.operators import reads as R
from cohortlens.plans import cohort as C
from cohortlens.plans.core import calls
from cohortlens.plans.registry import query
from cohortlens.sources import files as X

READS = ["name", "chr", "start", "end", "text", "prob_class_1", "mTcount", "insert_size"]


@query("S1_sheet", "SELECT CAST(sample AS VARCHAR) AS sample, concat('s', sample, '.bam') AS clean_bam, concat('s', sample, '.parquet') AS deconv_res FROM meta")
def s1(spark, sf):
    """A sample sheet of the split step."""
    X.write_sheet(C.meta(spark, sf).selectExpr("cast(sample as string) as sample", "concat('s', sample, '.bam') as clean_bam", "concat('s', sample, '.parquet') as deconv_res"), path := X.scratch(spark, "sheet"))
    return X.read_sheet(spark, path, "split_bam")


@query("S2_sheet_steps", "SELECT CAST(sample AS VARCHAR) AS sample, concat('s', sample, '.tsv') AS pileup FROM meta")
def s2(spark, sf):
    """The same reader with another step's columns."""
    X.write_sheet(C.meta(spark, sf).selectExpr("cast(sample as string) as sample", "concat('s', sample, '.tsv') as pileup"), path := X.scratch(spark, "sheet"))
    return X.read_sheet(spark, path, "est_ff")


@query("S3_sniff", "SELECT * FROM (VALUES ('a', 'parquet'), ('b', 'gzip'), ('c', 'text'), ('d.tsv.gz', 'gzip'), ('e.parquet', 'parquet')) t(name, format)")
def s3(spark, sf):
    """Formats by name, and by the first bytes where the name tells nothing."""
    base, rows = X.scratch(spark, "sniff"), C.meta(spark, sf).select("label")
    rows.coalesce(1).write.parquet(f"{base}/a")
    rows.coalesce(1).write.text(f"{base}/b", compression="gzip")
    rows.coalesce(1).write.text(f"{base}/c")
    files = [f"{base}/{n}" for n in "abc"]
    found = [(n, X.sniff(spark, f)) for n, f in zip("abc", files, strict=True)] + [(n, X.sniff(spark, f"{base}/{n}")) for n in ("d.tsv.gz", "e.parquet")]
    return spark.createDataFrame(found, "name string, format string")


@query("S4_table_scan", "SELECT name, CAST(prob_class_1 AS VARCHAR) AS prob_class_1 FROM reads")
def s4(spark, sf):
    """A gzipped TSV with a projection."""
    return scanned(spark, C.reads(spark, sf))


def scanned(spark, rows):
    rows = rows.selectExpr("name", "chr", "cast(prob_class_1 as string) as prob_class_1")
    rows.write.csv(path := X.scratch(spark, "scan"), sep="\t", header=True, compression="gzip")
    return X.read_table(spark, path, ["name", "prob_class_1"])


@query("S5_deconv_files", "SELECT chr, count(*) AS n, sum(insert_size)::BIGINT AS total FROM reads WHERE mTcount >= 3 GROUP BY 1")
def s5(spark, sf):
    """Reads of several files and formats with a filter; a path that isn't there and a file cut off in its body are skipped."""
    rows = C.reads(spark, sf).select("sample", *READS)
    a, b, none, broken = (X.scratch(spark, n) for n in ("deconv", "deconv", "none", "broken.tsv.gz"))
    rows.where("sample % 2 = 0").select(*READS).write.parquet(a)
    rows.where("sample % 2 = 1").select(*READS).write.csv(b, sep="\t", header=True)
    whole = gzip.compress("\t".join([*READS, "\n"]).encode() + random.Random(1).randbytes(200_000).hex().encode())
    X.write_bytes(spark, whole[: len(whole) // 2], broken)
    df, skipped = X.read_deconv(spark, [a, b, none, broken], 3)
    assert len(skipped) == 2
    return df.groupBy("chr").agg(F.count("*").alias("n"), F.sum("insert_size").alias("total"))


@query("S6_bedgraph", """SELECT chr, start, start AS "end", meth, unmeth, meth / nullif(meth + unmeth, 0) AS beta FROM (SELECT chr, start, count(*) FILTER (status = 'O') AS meth, count(*) FILTER (status = 'F') AS unmeth FROM reads GROUP BY ALL)""", "beta")
def s6(spark, sf):
    """A bedGraph with a track line and half-open ends."""
    rows = C.side(C.reads(spark, sf), ["chr", "start"]).withColumn("beta", S.ratio(F.col("meth"), F.col("meth") + F.col("unmeth")))
    text = rows.select(F.concat_ws("\t", "chr", "start", F.col("start") + 1, "beta", "meth", "unmeth").alias("value"))
    text.unionByName(spark.createDataFrame([("track type=bedGraph",)], "value string")).write.text(path := X.scratch(spark, "bedgraph"))
    return X.read_bedgraph(spark, path).select("chr", "start", "end", "meth", "unmeth", "beta")


@query("S7_S8_recall_lists", """SELECT chr, start, "end", meandiff::DOUBLE AS meandiff, recall AS final_recall FROM cpgs WHERE recall >= 0.5""", "meandiff final_recall")
def s7(spark, sf):
    """A site list, and the nested list of one recall."""
    C.cpgs(spark, sf).selectExpr("chr", "start", "end", "recall as final_recall", "meandiff").write.csv(path := X.scratch(spark, "cpgs"), sep="\t", header=True)
    panel = X.read_cpg_list(spark, path).withColumn("recall", F.col("final_recall"))
    return X.recall_list(panel, 0.5).select("chr", "start", "end", "meandiff", "final_recall")


@query("S9_S10_known_sites", "SELECT chr, part AS pos, 'A' AS ref, 'G' AS alt, 0.25::DOUBLE AS af FROM cpgs WHERE part % 4 = 1", "af")
def s9(spark, sf):
    """A VCF-like panel: comments, indels, lower case, and missing or bad frequencies."""
    alt = "case part % 4 when 0 then 'GA' else 'g' end"
    info = "case part % 4 when 1 then 'DP=1;AF=0.25' when 2 then 'DP=1' else 'AF=x;DP=1' end"
    rows = C.cpgs(spark, sf).select(F.expr(f"concat_ws('\t', chr, part, '.', 'a', {alt}, '.', 'PASS', {info})").alias("value"))
    rows.unionByName(spark.createDataFrame([("#CHROM\tPOS",), ("## x",)], "value string")).write.text(path := X.scratch(spark, "sites"))
    sites = X.read_known_sites(spark, path)
    return sites.join(X.site_keys(sites), ["chr", "pos"], "left_semi")


PILEUP = """SELECT chr, pos, af, n_ref, CASE WHEN pos % 9 = 0 THEN 0 ELSE n_alt END AS n_alt FROM snps"""


def pileup(spark, sf):
    rows = C.snps(spark, sf).selectExpr("chr", "pos", "'A' as ref", "'C' as alt", "af", "n_ref as cfDNA_ref_reads", "case when pos % 9 = 0 then 'x' else cast(n_alt as string) end as cfDNA_alt_reads", "n_ref + n_alt as current_depth")
    rows.write.csv(path := X.scratch(spark, "pileup"), sep="\t", header=True)
    return X.read_pileup(spark, path)


@query("S11_pileup", PILEUP, "af")
def s11(spark, sf):
    """Counts that aren't numbers are 0."""
    return pileup(spark, sf).selectExpr("chr", "pos", "af", "cfDNA_ref_reads as n_ref", "cfDNA_alt_reads as n_alt")


@query("S12_S14_ff_input", f"SELECT chr, pos, af, n_ref, n_alt, n_ref AS model_ref, n_alt AS model_alt FROM ({PILEUP}) WHERE n_ref + n_alt >= 25", "af")
def s12(spark, sf):
    """Sites fit for the fraction; without a model its counts are those of all reads."""
    return X.ff_input(pileup(spark, sf), 25)


@query("S13_maternal_counts", "SELECT chr, pos, greatest(n_ref - model_ref, 0) AS m_ref, greatest(n_alt - model_alt, 0) AS m_alt FROM snps WHERE greatest(n_ref - model_ref, 0) + greatest(n_alt - model_alt, 0) > 0")
def s13(spark, sf):
    """The mother's counts as what the model leaves."""
    return snp.maternal_counts(C.snps(spark, sf)).select("chr", "pos", "m_ref", "m_alt")


@query("S15_S16_site_depth", "SELECT c.chr, c.start, count(r.part) AS depth FROM cpgs c LEFT JOIN reads r ON r.chr = c.chr AND r.start = c.start AND r.mTcount >= 4 GROUP BY ALL")
def s16(spark, sf):
    """Depth at sites from a table of reads; alignment files are outside the engine."""
    depth = C.reads(spark, sf).where("mTcount >= 4").groupBy("chr", "start").agg(F.count("*").alias("depth"))
    return C.cpgs(spark, sf).join(depth, ["chr", "start"], "left").select("chr", "start", F.coalesce("depth", F.lit(0)).alias("depth"))


@query("S17_chr_ratio", "SELECT sample, count(*) FILTER (chr = 'chr21') / count(*) AS ratio FROM reads GROUP BY 1", "ratio")
def s17(spark, sf):
    """One chromosome's reads over all."""
    return C.reads(spark, sf).groupBy("sample").agg(S.ratio(F.count_if(F.col("chr") == "chr21"), F.count("*")).alias("ratio"))


@query("S18_directories", "SELECT threshold, 0.5::DOUBLE AS recall, count(*) AS n FROM shares GROUP BY ALL", "threshold recall")
def s18(spark, sf):
    """Threshold and recall from the names of directories."""
    base = X.scratch(spark, "dirs")
    for t in C.THRESHOLDS:
        C.share_rows(spark, sf).where(F.col("threshold") == t).select("sample", "chr", "percentage").write.csv(f"{base}/recall.0.5_cutoff.{t:g}", header=True)
    return X.read_directories(spark, base).groupBy("threshold", "recall").agg(F.count("*").alias("n"))


@query("S19_sample_files", "SELECT concat('s', sample) AS sample FROM meta")
def s19(spark, sf):
    """Samples by the names of their files."""
    return listed(spark, C.meta(spark, sf))


def listed(spark, meta):
    base = X.scratch(spark, "files")
    X.write_files(meta.select(F.format_string("s%s_beta_value.tsv.gz", "sample").alias("name"), F.encode(F.lit("x"), "utf-8").alias("content")), base)
    return X.samples_in(spark, base)


@query("S20_sample_list", "SELECT CASE WHEN sample % 2 = 0 THEN substr(concat('HCPT000', sample), 1, 8) ELSE concat('s', sample) END AS sample FROM meta")
def s20(spark, sf):
    names = C.meta(spark, sf).select(F.when(F.col("sample") % 2 == 0, F.concat(F.lit(" HCPT000"), "sample")).otherwise(F.concat(F.lit("s"), "sample")).alias("value"))
    names.unionByName(spark.createDataFrame([("",), ("# comment",)], "value string")).write.text(path := X.scratch(spark, "names"))
    return X.read_sample_list(spark, path)


@query("S21_bed", """SELECT DISTINCT chr, start, "end" FROM cpgs""")
def s21(spark, sf):
    """Tabs or commas, each site once."""
    rows = C.cpgs(spark, sf).select(F.when(F.col("part") % 2 == 0, F.concat_ws(",", "chr", "start", "end")).otherwise(F.concat_ws("\t", "chr", "start", "end")).alias("value"))
    rows.unionAll(rows).write.text(path := X.scratch(spark, "bed"))
    return X.read_bed(spark, path)


@query("S22_S23_pushed_filter", "SELECT sample, chr, percentage FROM shares WHERE threshold = 0.5::DOUBLE AND sample IN (1, 2, 3)", "percentage")
def s22(spark, sf):
    """A directory of parquet with a pushed list of samples and a projection."""
    C.share_rows(spark, sf).write.parquet(path := X.scratch(spark, "shares"))
    return spark.read.parquet(path).where("threshold = 0.5D").where(F.col("sample").isin(1, 2, 3)).select("sample", "chr", "percentage")


@query("S24_workbook", "SELECT CAST(sample AS VARCHAR) AS sample, label FROM meta")
def s24(spark, sf):
    """The first sheets of workbooks, made and parsed by tasks."""
    return from_book(spark, C.meta(spark, sf))


def from_book(spark, meta):
    X.write_workbooks(meta.select("sample", "label"), path := X.scratch(spark, "books"), per_book=100)
    return X.read_workbooks(spark, path, ["sample", "label"]).select("sample", "label")


@query("S25_K6_shards", "SELECT repeat_id, role, count(*) AS n FROM draws GROUP BY ALL")
def s25(spark, sf):
    """Shards by repeat, one of them written again."""
    path, rows = X.scratch(spark, "shards"), C.draws(spark, sf)
    X.write_shards(rows, path, ("repeat_id",))
    X.write_shards(rows.where("repeat_id = 3"), path, ("repeat_id",))
    return spark.read.parquet(path).groupBy(F.col("repeat_id").cast("long").alias("repeat_id"), "role").agg(F.count("*").alias("n"))


@query("K1_K2_tsv", "SELECT CAST(sample AS VARCHAR) AS sample, chr, printf('%.6f', percentage) AS percentage FROM shares WHERE threshold = 0.7::DOUBLE")
def k2(spark, sf):
    """Six decimals in a gzipped TSV."""
    X.write_tsv(C.share_rows(spark, sf).where("threshold = 0.7D").select("sample", "chr", "percentage"), path := X.scratch(spark, "tsv"))
    return spark.read.csv(path, sep="\t", header=True)


@query("K3_lines", "SELECT DISTINCT name AS value FROM reads WHERE prob_class_1 >= 0.9")
def k3(spark, sf):
    """Sorted names, each once."""
    X.write_lines(R.read_names(C.reads(spark, sf).where("prob_class_1 >= 0.9D")), "name", path := X.scratch(spark, "lines"))
    return spark.read.text(path)


@query("K4_K5_reports", "SELECT CAST(sample AS VARCHAR) AS sample, label FROM meta")
def k5(spark, sf):
    """Reports of both halves read as one."""
    base, m = X.scratch(spark, "reports"), C.meta(spark, sf).select("sample", "label")
    X.write_sheet(m.where("sample % 2 = 0"), f"{base}/a")
    X.write_sheet(m.where("sample % 2 = 1"), f"{base}/b")
    return spark.read.csv([f"{base}/a", f"{base}/b"], header=True)


@query("K7_database", "SELECT sample, label, set FROM meta WHERE set = 'test'")
def k7(spark, sf):
    """A database's table whose rows are replaced; a table of the catalog, which all executors see, stands in."""
    rows, name = C.meta(spark, sf).select("sample", "label", "set"), f"cohortlens_meta_{uuid.uuid4().hex}"
    X.write_table(rows.where("set = 'dev'"), name, path=X.scratch(spark, "database"))
    X.write_table(rows.where("set = 'test'"), name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # a lasting catalog isn't left with it; its files stay as long as the driver
    return table


@query("K8_charts", """SELECT sample, count(*) FILTER (label = replace(chr, 'chr', 'T')) AS n_hit, count(*) AS n_marks FROM (SELECT sample, chr, unnest([episcore, zscore]) AS value FROM fixed) JOIN meta USING (sample) WHERE value IS NOT NULL GROUP BY 1""")
def k8(spark, sf):
    """A chart for each sample, and its marks counted in the written pages."""
    long = C.fixed_combo_scores(spark, sf).unpivot(["sample", "chr"], ["episcore", "zscore"], "metric", "value").join(C.meta(spark, sf).select("sample", "label"), "sample")
    points = long.select("sample", "chr", "metric", "value", F.when(F.col("label") == F.regexp_replace("chr", "^chr", "T"), "hit").otherwise("other").alias("point"))
    charts.write_charts(charts.score_charts(points), path := X.scratch(spark, "charts"))
    marks = lambda kind: F.size(F.regexp_extract_all("value", F.lit(f'<circle class="{kind}"'), F.lit(0))).cast("long")
    return spark.read.text(path).select(F.col("sample").cast("long").alias("sample"), marks("hit").alias("n_hit"), (marks("hit") + marks("other")).alias("n_marks"))


@query("K9_json", "SELECT set, count(*) AS n FROM meta GROUP BY 1")
def k9(spark, sf):
    X.write_json_summary(C.meta(spark, sf).groupBy("set").agg(F.count("*").alias("n")), path := X.scratch(spark, "json"))
    return spark.read.json(path).select("set", "n")


@query("B1_by_names", "SELECT count(*) FILTER (k) AS n_in, count(*) FILTER (NOT k) AS n_out FROM (SELECT name IN (SELECT name FROM reads WHERE prob_class_1 >= 0.9) AS k FROM reads)")
def b1(spark, sf):
    """Reads whose name is listed, and the others."""
    rows = C.reads(spark, sf)
    names = R.read_names(rows.where("prob_class_1 >= 0.9D"))
    inside, outside = (R.by_names(rows, names, keep).agg(F.count("*").alias("n")) for keep in (True, False))
    return inside.crossJoin(outside.withColumnRenamed("n", "n_out")).selectExpr("n as n_in", "n_out")


@query("B2_merge_index", """SELECT chr, start // 16384 AS bin, count(*) AS n_reads, min(start) AS first_start, max("end") AS last_end FROM reads GROUP BY ALL""")
def b2(spark, sf):
    """Two tables of reads merged in order, written, and indexed."""
    rows = C.reads(spark, sf)
    R.merge_alignments([rows.where("status = 'O'"), rows.where("status <> 'O'")]).write.parquet(path := X.scratch(spark, "merged"))
    return R.alignment_index(spark.read.parquet(path))


@query("B3_mark_duplicates", """SELECT chr, count(*) AS n FROM (SELECT * FROM reads QUALIFY row_number() OVER (PARTITION BY chr, start, status, insert_size ORDER BY price DESC, name) = 1) GROUP BY 1""")
def b3(spark, sf):
    """One alignment for each position, strand and mate."""
    rows = C.reads(spark, sf).selectExpr("name", "chr", "start", "status as strand", "insert_size as mate_start", "price as quality")
    return R.without_duplicates(rows).groupBy("chr").agg(F.count("*").alias("n"))


@query("B4_call_counts", "SELECT chr, part AS pos, count(*) FILTER (status = 'O') AS meth, count(*) FILTER (status = 'F') AS unmeth FROM reads GROUP BY ALL")
def b4(spark, sf):
    """Methylation counts from single calls."""
    return C.side(C.reads(spark, sf).withColumn("pos", F.col("part")), ["chr", "pos"])


@query("F_scalar_text", """SELECT event_id, t, CASE WHEN t = 0 THEN '0' WHEN t = 1 THEN '1' ELSE rtrim(rtrim(CAST(t::DECIMAL(18, 6) AS VARCHAR), '0'), '.') END AS plain, regexp_extract(concat('220k_cpg_recall_', t, '.txt'), '([0-9]+\\.[0-9]+)', 1) AS from_name, TRY_CAST(strptime(d, '%Y%m%d') AS DATE) AS day
    FROM (SELECT event_id, round((event_id % 201) / 200.0::DOUBLE, 6) AS t, strftime(ts, '%Y%m%d') AS d FROM events)""", "t")
def f_text(spark, sf):
    """Thresholds as plain decimals, from file names, and dates from text."""
    rows = C.table(spark, sf, "events").select("event_id", F.round((F.col("event_id") % 201) / 200.0, 6).alias("t"), F.date_format("ts", "yyyyMMdd").alias("d"), (F.col("event_id") % 3).alias("k"))
    text = F.when(F.col("k") == 0, F.concat(F.lit("x"), "d")).when(F.col("k") == 1, F.concat("d", F.lit(".0"))).otherwise(F.concat(F.lit("a_"), "d", F.lit("_b")))
    return rows.select("event_id", "t", S.plain_decimal(F.col("t")).alias("plain"), F.regexp_extract(F.concat(F.lit("220k_cpg_recall_"), "t", F.lit(".txt")), r"([0-9]+\.[0-9]+)", 1).alias("from_name"), S.date_of(text).alias("day"))
