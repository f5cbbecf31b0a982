"""Domain views over the generated tables, and the cohort's scores built from them with the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scalar import AUTOSOMES
from cohortlens.operators import methyl, resample, scores
from cohortlens.operators import reads as R
from cohortlens.operators.evaluate import combo_metrics, with_roles
from cohortlens.sources.files import scratch

THRESHOLDS = [0.3, 0.5, 0.7]
RECALLS = [0.2, 0.5, 0.8]
CUTOFF = 1.5
COMBO = ["threshold", "recall"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as sample", "concat(l_orderkey, '-', l_linenumber) as name", "concat('chr', 1 + l_partkey % 22) as chr", "l_partkey * 10 as start",
        "l_partkey * 10 + cast(l_quantity as int) as end", "l_returnflag as text", "round(l_discount * 10, 1) as prob_class_1", "cast(l_linenumber as double) as mTcount",
        "cast(100 + 2 * l_quantity as bigint) as insert_size", "l_linestatus as status", "l_partkey as part", "l_extendedprice as price",
    )


def cpgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('chr', 1 + p_partkey % 22) as chr", "p_partkey * 10 as start", "p_partkey * 10 + 1 as end", "p_size - 25 as meandiff", "(p_partkey * 37 % 100) / 100 as recall", "p_partkey as part", "p_size as size"
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpgs(spark, sf_dir).where("part % 10 = 0").selectExpr("chr", "start", "start + size * 2 as end")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as sample", "case when s_suppkey % 2 = 0 then 'dev' else 'test' end as set", "case when s_suppkey % 5 <> 0 then 'Normal' else concat('T', 1 + s_suppkey % 22) end as label",
        "(s_suppkey % 30) * 0.005D as ff_before_mq", "s_acctbal as balance",
    )


def snps(spark: SparkSession, sf_dir: str, min_prob: float = 0.0) -> DataFrame:
    """Allele counts by site, of all reads and of those of the model."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as part", "round(0.05D + 0.018D * p_size, 3) as af")
    n = reads(spark, sf_dir).groupBy("chr", "part").agg(
        F.count_if(F.col("text").isin("R", "N")).alias("n_ref"), F.count_if(F.col("text") == "A").alias("n_alt"),
        F.count_if(F.col("text").isin("R", "N") & (F.col("prob_class_1") >= 0.5)).alias("model_ref"), F.count_if((F.col("text") == "A") & (F.col("prob_class_1") >= 0.5)).alias("model_alt"),
    )
    return n.join(part, "part").withColumn("pos", F.col("part"))


def side(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Methylation counts of reads by ``keys``."""
    return rows.groupBy(*keys).agg(F.count_if(F.col("status") == "O").alias("meth"), F.count_if(F.col("status") == "F").alias("unmeth"))


def episcore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hypo and hyper z values by sample, combination and chromosome; all combinations in one pass over the reads.

    Reads off the panel go before the first shuffle; recalls multiply a sample's sites after it.
    """
    panel = cpgs(spark, sf_dir).withColumn("recalls", F.filter(F.array(*map(F.lit, RECALLS)), lambda r: F.col("recall") >= r)).select("chr", "start", "meandiff", "recalls").where(F.size("recalls") > 0)
    on_panel = reads(spark, sf_dir).join(panel.select("chr", "start"), ["chr", "start"], "left_semi")
    calls = R.threshold_counts(on_panel, THRESHOLDS, ["sample", "chr", "start"], {"meth": F.col("status") == "O", "unmeth": F.col("status") == "F"})
    sites = calls.join(panel, ["chr", "start"]).withColumn("recall", F.explode("recalls"))
    # of one partitioning for both steps that follow
    level = methyl.levels(sites, ["sample", *COMBO]).repartition("sample", *COMBO)
    return methyl.wide_directions(methyl.intra_z(level, ["sample", *COMBO]), ["sample", *COMBO])


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta(spark, sf_dir).where("set = 'dev' and label = 'Normal'").select("sample")


def ez_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta(spark, sf_dir).where("set = 'test' and label = 'Normal'").select("sample")


def share_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = reads(spark, sf_dir).where(F.col("chr").isin(*AUTOSOMES))
    return scores.shares_of(R.threshold_counts(some, THRESHOLDS, ["sample", "chr"], {"n_reads": F.lit(True)}), ["sample", "threshold"]).select("sample", "threshold", "chr", "n_reads", "percentage")


def cohort_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, threshold, recall, chr, episcore, zscore) of all combinations against the dev normals."""
    ref = reference(spark, sf_dir)
    rows = episcore_rows(spark, sf_dir)
    epi = scores.episcore_of(rows, ref, [*COMBO, "chr"])
    z = scores.zscore_of(share_rows(spark, sf_dir), ref, ["threshold", "chr"])
    return epi.join(z.select("sample", "threshold", "chr", "zscore"), ["sample", "threshold", "chr"]).select("sample", *COMBO, "chr", "episcore", "zscore")


def cohort_ezscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.ezscore_of(cohort_scores(spark, sf_dir), ez_reference(spark, sf_dir), [*COMBO, "chr"])


def held_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort's scores, written once, for what reads them again and again."""
    rows = cohort_scores(spark, sf_dir)
    rows.write.parquet(path := scratch(spark, "scores"))
    return spark.read.schema(rows.schema).parquet(path)


def grid_rows(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """Episcores of the dev samples as ``score``, with the truth."""
    m = meta(spark, sf_dir).where("set = 'dev'").select("sample", "label", (F.col("label") == "Normal").alias("is_normal"))
    return (cohort_scores(spark, sf_dir) if held is None else held).join(m, "sample").withColumn("score", F.col("episcore"))


def grid_metrics(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    dev = (cohort_scores(spark, sf_dir) if held is None else held).withColumn("score", F.col("episcore"))
    return combo_metrics(with_roles(dev, meta(spark, sf_dir).where("set = 'dev'")), ["chr", *COMBO], CUTOFF)


def draws(spark: SparkSession, sf_dir: str, repeats: int = 20) -> DataFrame:
    """Disjoint references of 3 and 3 normals a repeat, so that the smallest data has enough."""
    return resample.hashed_draws(meta(spark, sf_dir).where("label = 'Normal'"), repeats, 3, 3)


def fixed_combo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_scores(spark, sf_dir).where("threshold = 0.5D and recall = 0.2D")
