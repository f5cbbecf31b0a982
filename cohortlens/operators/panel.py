"""Panel design: as-of and rank joins, set algebra of sites, replacement by depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.operators.ranks import numbered

SITE = ["chr", "start", "end"]


def latest_probe(sites: DataFrame, probes: DataFrame, at: str = "start", width: int = 100_000) -> DataFrame:
    """``sites`` with the latest-starting probe at or before their position (``probe_start``, ``probe_end``), by chromosome.

    Chromosomes are cut into bins of ``width``.  Both sides of a bin go in one sorted stream and
    the last probe is carried on; a bin's stream begins with the last probe of the bins before
    it, which a table of one row a bin tells.  So a task holds bins, not whole chromosomes.
    """
    bin_of = lambda c: F.floor(F.col(c) / width).alias("_bin")
    probe = F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))
    marks = probes.select("chr", bin_of("start"), F.col("start").cast("long").alias("_at"), probe.alias("_probe")).where("_at is not null")
    own = marks.groupBy("chr", "_bin").agg(F.max("_probe").alias("_own"))  # of probes with one start the longest
    bins = sites.select("chr", bin_of(at)).distinct().join(own, ["chr", "_bin"], "full")
    before = Window.partitionBy("chr").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.withColumn("_probe", F.last("_own", ignorenulls=True).over(before)).where("_probe is not null").select("chr", "_bin", F.lit(None).cast("long").alias("_at"), "_probe")
    rows = sites.select("chr", bin_of(at), F.col(at).cast("long").alias("_at"), F.struct(*sites.columns).alias("_row"))
    both = rows.withColumn("_probe", F.lit(None).cast(marks.schema["_probe"].dataType)).unionByName(marks.unionByName(carried).withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    over = Window.partitionBy("chr", "_bin").orderBy(F.col("_at").asc_nulls_first(), F.col("_row").isNotNull(), F.col("_probe.e")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.when(F.col("_at").isNotNull(), F.last("_probe", ignorenulls=True).over(over))).where("_row is not null")
    return found.select("_row.*", F.col("_last.s").alias("probe_start"), F.col("_last.e").alias("probe_end"))


def probes_over(sites: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes that the latest-starting rule finds over a site, each once."""
    hits = latest_probe(sites, probes).where((F.col("start") < F.col("probe_end")) & (F.col("end") > F.col("probe_start")))
    return hits.select("chr", F.col("probe_start").alias("start"), F.col("probe_end").alias("end")).distinct()


def snps_in_probes(snps: DataFrame, probes: DataFrame) -> DataFrame:
    """SNPs (1-based ``pos``) in the latest-starting probe."""
    sites = snps.select("chr", "pos").distinct().withColumn("start", F.col("pos") - 1)
    hits = latest_probe(sites, probes).where((F.col("start") < F.col("probe_end")) & (F.col("pos") > F.col("probe_start")))
    return snps.join(hits.select("chr", "pos").distinct(), ["chr", "pos"], "left_semi")


def without(rows: DataFrame, others: DataFrame, keys: list[str] = SITE) -> DataFrame:
    return rows.join(others.select(*keys).distinct(), keys, "left_anti")


def set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the intersection, both differences and whether a is inside b, in one pass over the tagged union."""
    tagged = a.select(*SITE).withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(b.select(*SITE).withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    sides = tagged.groupBy(*SITE).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sides.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("n_both"), F.count_if(F.expr("a = 1 and b = 0")).alias("n_only_a"), F.count_if(F.expr("a = 0 and b = 1")).alias("n_only_b"), (F.count_if(F.expr("a = 1 and b = 0")) == 0).alias("a_in_b"))


def mean_normal_depth(depths: DataFrame) -> DataFrame:
    """Mean over samples of each site's depth relative to the sample's mean depth."""
    share = F.try_divide(F.col("depth").cast("double"), F.nullif(F.avg("depth").over(Window.partitionBy("sample")), F.lit(0.0)))
    return depths.withColumn("share", share).groupBy(*SITE).agg(F.avg("share").alias("mean_norm_depth"))


def ranked_pairs(weak: DataFrame, strong: DataFrame, value: str) -> DataFrame:
    """The weakest of one panel with the strongest of the other, by rank."""
    a = numbered(weak, [F.round(value, 9).asc(), *SITE], "_n").select("_n", *SITE, F.col(value).alias("weak_depth"))
    b = numbered(strong, [F.round(value, 9).desc(), *SITE], "_n").select("_n", *[F.col(c).alias(f"{c}_donor") for c in SITE], F.col(value).alias("donor_depth"))
    return a.join(b, "_n").drop("_n")


def replace_sites(panel: DataFrame, donors: DataFrame, depth: DataFrame) -> DataFrame:
    """The panel with its shallowest sites replaced by the deepest donors, rank by rank, where the donor is deeper."""
    deep = lambda d: d.select(*SITE).join(depth, SITE, "left").fillna(0.0, ["mean_norm_depth"])
    swaps = ranked_pairs(deep(panel), deep(donors), "mean_norm_depth").where(F.col("donor_depth") > F.col("weak_depth"))
    out = panel.select(*SITE).join(swaps, SITE, "left")
    return out.select(*[F.coalesce(f"{c}_donor", c).alias(c) for c in SITE], F.col("chr_donor").isNotNull().alias("replaced"))
