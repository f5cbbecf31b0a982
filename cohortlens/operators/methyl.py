"""Methylation levels by chromosome, from counts at sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.scalar import ratio, z_value

SITE = ["chr", "start", "end"]


def direction(meandiff: Column) -> Column:
    """hypo below zero, hyper above; exactly zero is neither."""
    return F.when(meandiff < 0, "hypo").when(meandiff > 0, "hyper")


def merge_sites(target: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of both sides by site, 0 where a side lacks it, with raw totals and levels."""
    sides = [d.select(*keys, *[F.col(c).alias(f"{n}_{c}") for c in ("meth", "unmeth")]) for n, d in (("target", target), ("background", background))]
    both = sides[0].join(sides[1], keys, "outer").fillna(0)
    total = both.withColumns({f"raw_{c}": F.col(f"target_{c}") + F.col(f"background_{c}") for c in ("meth", "unmeth")})
    total = total.withColumn("raw_total", F.col("raw_meth") + F.col("raw_unmeth"))
    level = lambda n: ratio(F.col(f"{n}_meth"), F.col(f"{n}_meth") + F.col(f"{n}_unmeth"))
    return total.withColumns({"target_beta": level("target"), "background_beta": level("background"), "raw_beta": level("raw")})


def at_panel(sites: DataFrame, panel: DataFrame, recall: float | None = None) -> DataFrame:
    """Sites of the panel, with its columns; ``recall`` keeps those of the nested list of that recall."""
    some = panel if recall is None else panel.where(F.col("recall") >= recall)
    return sites.join(some, SITE)


def only_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    return rows.join(sites.select(*SITE).distinct(), SITE, "left_semi")


def deep_sites(sites: DataFrame, depth: int | None, total: str = "raw_total") -> DataFrame:
    """Sites strictly deeper than ``depth``; no depth, no filter."""
    return sites.where(F.col(total) > depth) if depth else sites


def levels(sites: DataFrame, keys: list[str], meth: str = "meth", unmeth: str = "unmeth") -> DataFrame:
    """Sums and level by ``keys``, chromosome and direction, from sites with ``meandiff``."""
    rows = sites.withColumn("direction", direction(F.col("meandiff"))).where("direction is not null")
    out = rows.groupBy(*keys, "chr", "direction").agg(F.sum(meth).alias("meth"), F.sum(unmeth).alias("unmeth"), F.count("*").alias("n_cpgs"))
    return out.withColumn("beta", ratio(F.col("meth"), F.col("meth") + F.col("unmeth")))


def intra_z(rows: DataFrame, keys: list[str], value: str = "beta") -> DataFrame:
    """The level of each chromosome against all chromosomes of its sample."""
    over = Window.partitionBy(*keys, "direction")
    return rows.withColumn("z_intra", z_value(F.col(value), F.avg(value).over(over), F.stddev_pop(value).over(over)))


def wide_directions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row by ``keys`` and chromosome with hypo and hyper columns."""
    pick = lambda d, c: F.max(F.when(F.col("direction") == d, F.col(c)))
    return rows.groupBy(*keys, "chr").agg(
        pick("hypo", "z_intra").alias("hypo_z"), pick("hyper", "z_intra").alias("hyper_z"),
        F.coalesce(pick("hypo", "n_cpgs"), F.lit(0)).alias("hypo_n"), F.coalesce(pick("hyper", "n_cpgs"), F.lit(0)).alias("hyper_n"),
    )
