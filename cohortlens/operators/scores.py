"""Scores of samples against a reference cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.scalar import AUTOSOMES, ratio, z_value


def chromosomes(spark, names: tuple[str, ...] = AUTOSOMES) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("chr"))


def read_shares(reads: DataFrame, keys: list[str], names: tuple[str, ...] = AUTOSOMES) -> DataFrame:
    """Reads by chromosome and their share of all autosomes' reads; other chromosomes are shared by the autosomes' total too."""
    return shares_of(reads.where(F.col("chr").isin(*names)).groupBy(*keys, "chr").agg(F.count("*").alias("n_reads")), keys)


def shares_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by chromosome (``n_reads``) with their share of the autosomes' total."""
    autosomes = F.sum(F.when(F.col("chr").isin(*AUTOSOMES), F.col("n_reads"))).over(Window.partitionBy(*keys))
    return counts.withColumn("percentage", ratio(F.col("n_reads"), autosomes))


def reference_stats(rows: DataFrame, reference: DataFrame, keys: list[str], values: list[str], sample_sd: bool = False) -> DataFrame:
    """Mean and SD of ``values`` over the reference's samples; the SD is NULL without any, the mean 0."""
    sd = F.stddev_samp if sample_sd else F.stddev_pop
    picked = rows.join(reference.select("sample").distinct(), "sample", "left_semi")
    aggs = [a for v in values for a in (F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{v}_mean"), sd(v).alias(f"{v}_sd"))]
    return picked.groupBy(*keys).agg(*aggs)


def with_reference(rows: DataFrame, reference: DataFrame, keys: list[str], values: list[str], sample_sd: bool = False) -> DataFrame:
    """``rows`` with the reference's mean and SD of ``values`` by ``keys`` beside them (:func:`reference_stats`).

    The rows are read once: statistics are windows over them, in which only the reference's samples count.
    """
    flagged = rows.join(reference.select("sample").distinct().withColumn("_in", F.lit(True)), "sample", "left")
    over, sd = Window.partitionBy(*keys), F.stddev_samp if sample_sd else F.stddev_pop
    own = {v: F.when(F.col("_in"), F.col(v)) for v in values}
    return flagged.withColumns({n: c for v in values for n, c in ((f"{v}_mean", F.coalesce(F.avg(own[v]).over(over), F.lit(0.0))), (f"{v}_sd", sd(own[v]).over(over)))}).drop("_in")


def inter_score(hypo: Column, hyper: Column, n_hypo: Column, n_hyper: Column) -> Column:
    """Hyper minus hypo z values, weighted by the roots of their site counts; 0 where it can't be told."""
    weighted = hyper * F.sqrt(n_hyper) - hypo * F.sqrt(n_hypo)
    return F.coalesce(ratio(weighted, F.sqrt(n_hyper + n_hypo)), F.lit(0.0))


def episcore(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (hypo_z, hyper_z, hypo_n, hyper_n) with ``episcore`` against the reference."""
    return _episcored(rows.join(stats, keys, "left")).select(*rows.columns, "episcore")


def episcore_of(rows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`episcore` against samples that are among the rows, in one pass over them."""
    return _episcored(with_reference(rows, reference, keys, ["hypo_z", "hyper_z"])).select(*rows.columns, "episcore")


def _episcored(joined: DataFrame) -> DataFrame:
    z = {d: z_value(F.col(f"{d}_z"), F.col(f"{d}_z_mean"), F.col(f"{d}_z_sd")) for d in ("hypo", "hyper")}
    return joined.withColumn("episcore", inter_score(z["hypo"], z["hyper"], F.col("hypo_n"), F.col("hyper_n")))


def zscore(rows: DataFrame, stats: DataFrame, keys: list[str], fill: bool = False) -> DataFrame:
    """``rows`` (percentage) with ``zscore``; single samples take 0 where it can't be told, cohorts NULL."""
    return _zscored(rows.join(stats, keys, "left"), fill).select(*rows.columns, "zscore")


def zscore_of(rows: DataFrame, reference: DataFrame, keys: list[str], fill: bool = False, sample_sd: bool = False) -> DataFrame:
    """:func:`zscore` against samples that are among the rows, in one pass over them."""
    return _zscored(with_reference(rows, reference, keys, ["percentage"], sample_sd), fill).select(*rows.columns, "zscore")


def _zscored(joined: DataFrame, fill: bool) -> DataFrame:
    z = z_value(F.col("percentage"), F.col("percentage_mean"), F.col("percentage_sd"))
    return joined.withColumn("zscore", F.coalesce(z, F.lit(0.0)) if fill else z)


def at_best_combo(rows: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each chromosome at its own combination; ``keys`` are those of the combination."""
    return rows.join(F.broadcast(best.select("chr", *keys)), ["chr", *keys], "left_semi")


def ezscore(scores: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``scores`` (episcore, zscore) with ``ezscore`` against (``ez_mean``, ``ez_sd``)."""
    joined = scores.join(stats, keys, "left")
    return joined.withColumn("ezscore", z_value(F.col("episcore") + F.col("zscore"), F.col("ez_mean"), F.col("ez_sd"))).select(*scores.columns, "ezscore")


def ezscore_of(scores: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`ezscore` against samples that are among the scores, in one pass over them."""
    joined = with_reference(scores.withColumn("ez", F.col("episcore") + F.col("zscore")), reference, keys, ["ez"])
    return joined.withColumn("ezscore", z_value(F.col("ez"), F.col("ez_mean"), F.col("ez_sd"))).select(*scores.columns, "ezscore")


def ez_stats(scores: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    out = reference_stats(scores.withColumn("ez", F.col("episcore") + F.col("zscore")), reference, keys, ["ez"])
    return out


def merged(names: DataFrame, samples: DataFrame, episcores: DataFrame, zscores: DataFrame, stats: DataFrame) -> DataFrame:
    """Every sample by every chromosome with its scores; what is missing is NULL."""
    base = samples.select("sample").crossJoin(F.broadcast(names))  # at most two dozen chromosomes a sample
    out = base.join(episcores, ["sample", "chr"], "left").join(zscores, ["sample", "chr"], "left")
    return ezscore(out, stats, ["chr"])
