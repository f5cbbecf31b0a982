"""Sample metadata: nearest records, collapsing of batches, fits, cross tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.scalar import date_of


def nearest_record(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, ties: list[Column]) -> DataFrame:
    """Each left row with the right row of its keys of the nearest date, and ``days`` between them; ``ties`` order equally near ones.

    Of right rows with one date the first by ``ties`` stays.  Then both sides of a key go in one
    stream by date, in which the last record up to a row and the first one from it on are
    carried to it: two candidates a row, never a key's pairs.  Rows without a date, and rows
    whose keys have no record, have none.
    """
    rest = [c for c in right.columns if c not in keys]
    days = first_by(right.withColumn("_day", F.to_date(right_date)).where("_day is not null"), [*keys, "_day"], ties)
    records = days.select(*keys, "_day", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_left"), F.struct(*rest).alias("_record"))
    # written by no one: the number is of this row in this plan, and both windows are over the same rows
    asked = left.where(F.col(left_date).isNotNull()).select(*keys, F.to_date(left_date).alias("_day"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_left"), F.struct(*[c for c in left.columns if c not in keys]).alias("_row"))
    both = asked.withColumn("_record", F.lit(None).cast(records.schema["_record"].dataType)).unionByName(records.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)))
    last = lambda *order: F.last("_record", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_near", F.array(last(F.col("_day").asc()), last(F.col("_day").desc()))).where("_side = 1").withColumn("_near", F.explode("_near")).where("_near is not null")
    flat = near.select("_left", *keys, "_row.*", "_near.*", F.abs(F.datediff("_day", F.to_date(f"_near.{right_date}"))).cast("long").alias("days"))
    return first_by(flat, ["_left"], [F.col("days"), *ties]).drop("_left")


#: Endings of sample names that stand for each other.
SWAPPED = {"H1": "S1", "S1": "H1"}


def swapped_name(sample: Column) -> Column:
    """The sample's other name, where it ends with one of :data:`SWAPPED`."""
    out = F.lit(None).cast("string")
    for a, b in SWAPPED.items():
        out = F.when(F.endswith(sample, F.lit(a)), F.concat(F.substring(sample, F.lit(1), F.length(sample) - len(a)), F.lit(b))).otherwise(out)
    return out


def map_to_qc(files: DataFrame, qc: DataFrame) -> DataFrame:
    """Each file (sample, clean_bam, batch) with one quality record (sample, dataset, dataset_date, puc19, lambda) of its sample.

    A sample without records takes those of its other name.  One record is taken whatever its date; of
    several the nearest by date, a data set named ``-XML`` before others on ties, then by name; without
    dates on either side the preferred one.  ``dataset_date`` falls back to the date in the data
    set's name.  ``map_rule`` says which rule held; files without any record have ``missing``.
    """
    dated = F.coalesce(F.to_date("dataset_date"), date_of(F.col("dataset")))
    liked = F.when(F.endswith("dataset", F.lit("-XML")), 0).when(F.contains("dataset", F.lit("-XML")), 1).otherwise(2)
    sets = qc.select(F.col("sample").alias("qc_sample"), F.col("dataset").alias("qc_dataset"), dated.alias("qc_dataset_date"), "lambda", "puc19", liked.alias("_liked")).where("qc_sample is not null")
    sets = first_by(sets, ["qc_sample", "qc_dataset"], [F.asc_nulls_last("qc_dataset_date"), F.col("puc19"), F.col("lambda")])
    order = [F.col("_liked"), F.col("qc_dataset")]
    known = sets.groupBy("qc_sample").agg(F.count("*").alias("n_qc_for_sample"), F.min_by(F.struct("qc_dataset", "qc_dataset_date", "lambda", "puc19"), F.struct("_liked", "qc_dataset")).alias("_first"))
    rows = files.withColumns({"_date": date_of(F.col("batch")), "_other": swapped_name(F.col("sample"))})
    own, other = known.select(F.col("qc_sample").alias("_own")), known.select(F.col("qc_sample").alias("_alias"))
    rows = rows.join(own, rows["sample"] == F.col("_own"), "left").join(other, F.col("_own").isNull() & (F.col("_other") == F.col("_alias")), "left")
    rows = rows.withColumn("qc_sample", F.coalesce("_own", "_alias")).withColumn("sample_match", F.when(F.col("_own").isNotNull(), "exact_sample").when(F.col("_alias").isNotNull(), "hs_swap").otherwise("missing")).drop("_own", "_alias", "_other")
    number = files.groupBy("sample").agg(F.count_distinct("clean_bam").alias("n_bam_for_sample"))
    rows = rows.join(number, "sample", "left")
    near = nearest_record(rows.where("qc_sample is not null").select("clean_bam", "sample", "qc_sample", "_date").distinct(), sets.withColumn("_found", F.struct("qc_dataset", "qc_dataset_date", "lambda", "puc19")).select("qc_sample", "qc_dataset_date", "qc_dataset", "_liked", "_found"), ["qc_sample"], "_date", "qc_dataset_date", order)
    near = near.select("clean_bam", "sample", "_date", "_found", F.col("days").alias("day_delta"))
    rows = rows.join(near, ["clean_bam", "sample", "_date"], "left").join(known, "qc_sample", "left").withColumn("_hit", F.coalesce("_found", "_first"))
    rule = F.when(F.col("qc_sample").isNull(), "missing").when(F.col("n_qc_for_sample") > 1, "nearest_date").when(F.col("n_bam_for_sample") == 1, "direct_singleton").otherwise("direct_single_qc")
    return rows.select("sample", "clean_bam", "qc_sample", "sample_match", "n_bam_for_sample", F.coalesce("n_qc_for_sample", F.lit(0)).alias("n_qc_for_sample"), rule.alias("map_rule"), "_hit.qc_dataset", "_hit.qc_dataset_date", "day_delta", "_hit.lambda", "_hit.puc19")


def distinct_over(value: str, keys: list[str]) -> Column:
    """The distinct values of a partition on each of its rows."""
    return F.size(F.collect_set(value).over(Window.partitionBy(*keys))).cast("long")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row by ``keys``, the first in order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def cross_table(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``values`` by key, one column each, 0 without any."""
    return rows.groupBy(key).pivot(column, values).count().fillna(0, values)


def line_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def residual_class(rows: DataFrame, fit: DataFrame, keys: list[str], x: str, y: str, limit: float) -> DataFrame:
    """above, below or on the line, by more than ``limit``."""
    r = F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))
    return rows.join(F.broadcast(fit), keys).withColumn("residual", r).withColumn("side", F.when(r > limit, "above").when(r < -limit, "below").otherwise("on"))


def agreement(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """How two columns agree: valid pairs, largest and mean difference, root mean square, Pearson correlation."""
    d = F.col(a) - F.col(b)
    some = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return some.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.abs(d)).alias("max_abs"), F.avg(F.abs(d)).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr(a, b).alias("pearson"))


def coverage(rows: DataFrame, n_chr: int = 22, share: float = 0.95) -> DataFrame:
    """Combinations with the samples that have all chromosomes, and whether they are enough."""
    whole = rows.groupBy("threshold", "recall", "sample").agg(F.count_distinct("chr").alias("n")).groupBy("threshold", "recall").agg(F.count_if(F.col("n") >= n_chr).alias("n_whole"), F.count("*").alias("n_samples"))
    return whole.withColumn("enough", F.col("n_whole") >= share * F.col("n_samples"))


def missing_rows(rows: DataFrame, samples: DataFrame, combos: DataFrame, names: DataFrame) -> DataFrame:
    """Expected (sample, combination, chromosome) without a row; the expectation is a product of small dimensions with the samples."""
    expected = samples.select("sample").crossJoin(F.broadcast(combos)).crossJoin(F.broadcast(names))
    return expected.join(rows.select("sample", "threshold", "recall", "chr"), ["sample", "threshold", "recall", "chr"], "left_anti")
