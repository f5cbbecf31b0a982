"""Operators on sequencing reads: splits by probability, replacement, interval membership, read lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of a read's flag that take it out of a pileup (unmapped, secondary, duplicate, supplementary).
EXCLUDED_FLAGS = 0x4 | 0x100 | 0x400 | 0x800


def target_condition(threshold: float | None = None, max_size: int | None = None) -> Column:
    """At or above the probability, and at or below the insert size, whichever are given."""
    if threshold is None and max_size is None:
        raise ValueError("a probability threshold or an insert size is needed")
    out = F.lit(True)
    if threshold is not None:
        out &= F.col("prob_class_1") >= threshold
    if max_size is not None:
        out &= F.col("insert_size") <= max_size
    return out


def split_reads(reads: DataFrame, threshold: float | None = None, max_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(target, background) reads; reads that lack a value that is asked for are in neither."""
    needed = [c for c, x in (("prob_class_1", threshold), ("insert_size", max_size)) if x is not None]
    known = reads.dropna(subset=needed)
    condition = target_condition(threshold, max_size)
    return known.where(condition), known.where(~condition)


def read_names(reads: DataFrame) -> DataFrame:
    """Distinct read names; a name with rows on both sides of a split is in both lists."""
    return reads.select("name").distinct()


def at_thresholds(reads: DataFrame, thresholds: list[float]) -> DataFrame:
    """Reads once for each threshold that they reach, in one pass; those below all are dropped in the scan."""
    reached = F.filter(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]), lambda t: F.col("prob_class_1") >= t)
    return reads.where(F.col("prob_class_1") >= min(thresholds)).withColumn("threshold", F.explode(reached))


def threshold_counts(reads: DataFrame, thresholds: list[float], keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """Counts by ``keys`` of the reads that reach each threshold and fulfil a condition, where any read reaches it.

    Counts are additive, so a read goes once through one aggregation, with a column for each
    threshold; it is not copied for the thresholds.
    """
    reached = {t: F.col("prob_class_1") >= t for t in map(float, sorted(thresholds))}
    wide = [F.count_if(c if name is None else c & counts[name]).alias(f"_{i}_{name or ''}") for i, c in enumerate(reached.values()) for name in (None, *counts)]
    rows = reads.where(F.col("prob_class_1") >= min(reached)).groupBy(*keys).agg(*wide)
    long = [F.struct(F.lit(t).alias("threshold"), F.col(f"_{i}_").alias("_n"), *[F.col(f"_{i}_{name}").alias(name) for name in counts]) for i, t in enumerate(reached)]
    return rows.select(*keys, F.explode(F.array(*long)).alias("_c")).where("_c._n > 0").select(*keys, "_c.threshold", *[f"_c.{name}" for name in counts])


def replace_probability(original: DataFrame, perturbed: DataFrame) -> DataFrame:
    """``original`` with the perturbed probability where the name has one; of repeated names the largest counts."""
    new = perturbed.groupBy("name").agg(F.max("prob_class_1").alias("perturbed"))
    return original.join(new, "name", "left").withColumn("prob_class_1", F.coalesce("perturbed", "prob_class_1")).drop("perturbed").select(*original.columns)


def unique_reads(reads: DataFrame, keys: tuple[str, ...] = ("sample", "chr", "start", "end", "text")) -> DataFrame:
    """One read of those with equal keys: the one with the largest probability, then the least name."""
    order = [F.col("prob_class_1").desc_nulls_last(), F.col("name").asc()]
    ranked = reads.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def containing_a_point(reads: DataFrame, points: DataFrame, width: int = 1000) -> DataFrame:
    """Reads with a point ``pos`` of their chromosome from ``start`` to ``end``, ends included.

    Chromosomes are cut into bins of ``width``, so a key is a chromosome's bin and not the
    whole chromosome.  A read of up to ``width`` is looked up by the bin of its start alone:
    the points, the smaller side, are entered in their own bin and in the one before.
    Longer reads are spread over their bins and come back once each.
    """
    entered = points.select(F.col("chr"), F.col("pos").alias("_pos"), F.explode(F.array(F.floor(F.col("pos") / width), F.floor(F.col("pos") / width) - 1)).alias("_bin"))
    inside = (F.col("_pos") >= F.col("start")) & (F.col("_pos") <= F.col("end"))

    def looked_up(some: DataFrame, of: DataFrame) -> DataFrame:
        a, b = some.alias("a"), of.alias("b")
        return a.join(b, (F.col("a.chr") == F.col("b.chr")) & (F.col("a._bin") == F.col("b._bin")) & inside, "left_semi")

    short = reads.where(F.col("end") - F.col("start") <= width).withColumn("_bin", F.floor(F.col("start") / width))
    far = reads.where(F.col("end") - F.col("start") > width).withColumn("_read", F.monotonically_increasing_id())
    far = far.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    far = looked_up(far, entered).dropDuplicates(["_read"])
    return looked_up(short, entered).select(*reads.columns).unionByName(far.select(*reads.columns))


def points_inside(intervals: DataFrame, points: DataFrame, width: int = 1000) -> DataFrame:
    """``intervals`` with ``n_points``, the points of their chromosome inside; reversed ends are swapped.

    A count is the number of points up to the end less that up to before the start, so an interval costs
    the same whatever its length.  Both numbers come from one stream of positions: equal ones are
    counted first, so a bin of ``width`` positions has as many rows at most; it is numbered by itself, and
    the points of earlier bins are added from the bins' counts.
    """
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    keyed = intervals.withColumn("_lo", lo - 1).withColumn("_hi", hi)
    asked = keyed.select("chr", F.explode(F.array("_lo", "_hi")).alias("_x")).where("_x is not null")
    stream = points.where("pos is not null").select("chr", F.col("pos").alias("_x"), F.lit(1).cast("long").alias("_n")).unionByName(asked.withColumn("_n", F.lit(0).cast("long")))
    places = stream.groupBy("chr", "_x").agg(F.sum("_n").alias("_n")).withColumn("_bin", F.floor(F.col("_x") / width))
    bins = places.groupBy("chr", "_bin").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy("chr").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin: as many as a chromosome has
    before = bins.select("chr", "_bin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("_n").over(Window.partitionBy("chr", "_bin").orderBy("_x"))
    ranks = places.withColumn("_own", own).join(before, ["chr", "_bin"]).select("chr", "_x", (F.col("_own") + F.col("_before")).alias("_rank"))
    upper, lower = ranks.withColumnsRenamed({"_x": "_hi", "_rank": "_upper"}), ranks.withColumnsRenamed({"_x": "_lo", "_rank": "_lower"})
    met = keyed.join(upper, ["chr", "_hi"], "left").join(lower, ["chr", "_lo"], "left")
    return met.select(*intervals.columns, F.coalesce(F.col("_upper") - F.col("_lower"), F.lit(0)).alias("n_points"))


def by_names(reads: DataFrame, names: DataFrame, keep: bool = True) -> DataFrame:
    """Reads whose name is in the list, or is not."""
    return reads.join(names.select("name").distinct(), "name", "left_semi" if keep else "left_anti")


def merge_alignments(frames: list[DataFrame]) -> DataFrame:
    """Reads of several tables in order of chromosome, start and name, in ranges of positions."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.repartitionByRange("chr", "start", "name").sortWithinPartitions("chr", "start", "name")


def alignment_index(reads: DataFrame, width: int = 16_384) -> DataFrame:
    """(chr, bin, n_reads, first_start, last_end) by bins of positions: which of them have reads and where they begin."""
    return reads.groupBy("chr", F.floor(F.col("start") / width).alias("bin")).agg(F.count("*").alias("n_reads"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


def without_duplicates(alignments: DataFrame, quality: str = "quality") -> DataFrame:
    """One alignment for each 5' start, strand and mate position: that of the largest quality, then the least name."""
    where = Window.partitionBy("chr", "start", "strand", "mate_start").orderBy(F.col(quality).desc(), F.col("name"))
    return alignments.withColumn("_rank", F.row_number().over(where)).where("_rank = 1").drop("_rank")


def pileup_quality(calls: DataFrame, mapq: int = 20, baseq: int = 13) -> DataFrame:
    """Base calls good enough for a pileup."""
    return calls.where((F.col("mapq") >= mapq) & (F.col("bq") >= baseq) & (F.col("flag").bitwiseAND(F.lit(EXCLUDED_FLAGS)) == 0))
