"""Repeated references: draws as a table, leave-one-out and fold statistics, sweeps over repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.scalar import mcc
from cohortlens.operators.draws import distinct_draws
from cohortlens.operators.ranks import numbered


def unique_draws(spark: SparkSession, pool: list, size: int, repeats: int, seed: int = 42) -> DataFrame:
    """(``repeat_id``, ``role`` ref, ``sample``): distinct random subsets of a listed pool; all subsets if there are no more than asked for.

    The pool is sorted first, so a seed gives the same draws wherever it is run.  Members are drawn by
    their places on the executors (:func:`cohortlens.operators.draws.distinct_draws`).
    """
    listed = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(pool))], "place long, sample long")
    return distinct_draws(spark, len(pool), size, repeats, seed).join(listed, "place").select("repeat_id", "role", "sample")


def hashed_draws(pool: DataFrame, repeats: int, n_ref: int, n_ez: int = 0) -> DataFrame:
    """Disjoint reference and ez reference of each repeat by an arithmetic order of samples; the same in any SQL engine."""
    rows = pool.select("sample").join(F.broadcast(pool.sparkSession.range(repeats).withColumnRenamed("id", "repeat_id")), F.lit(True))
    mixed = (F.col("sample") * 7919 + (F.col("repeat_id") + 1) * 104729) % 1000003
    rank = F.row_number().over(Window.partitionBy("repeat_id").orderBy(mixed, "sample"))
    role = F.when(F.col("rank") <= n_ref, "ref").when(F.col("rank") <= n_ref + n_ez, "ez")
    return rows.withColumn("rank", rank).withColumn("role", role).where("role is not null").select("repeat_id", "role", "sample")


def leave_out(rows: DataFrame, keys: list[str], value: str, fold: str | None = None) -> DataFrame:
    """``rows`` with ``<value>_mu`` and ``<value>_sd`` over the other rows of ``keys``, or over other folds: total sums less own ones."""
    over = Window.partitionBy(*keys)
    own = Window.partitionBy(*keys, fold) if fold else None
    x = F.col(value)
    def rest(v: Column) -> Column:
        v = F.coalesce(v, F.lit(0.0))
        return F.sum(v).over(over) - (F.sum(v).over(own) if own else v)
    n = rest(x.isNotNull().cast("double"))
    mu = F.coalesce(F.try_divide(rest(x), F.nullif(n, F.lit(0.0))), F.lit(0.0))
    var = F.try_divide(rest(x * x), F.nullif(n, F.lit(0.0))) - mu * mu
    return rows.withColumn(f"{value}_mu", mu).withColumn(f"{value}_sd", F.sqrt(F.greatest(var, F.lit(0.0))))


def fold_ids(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Contiguous folds from 0; the first ones take the remainder.  Without keys all rows are numbered in ranges."""
    if keys:
        return rows.withColumn("fold", (F.ntile(k).over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    placed = numbered(rows, order, "_n")
    total = placed.agg(F.count("*").alias("_all"))
    at, size, more = F.col("_n") - 1, F.floor(F.col("_all") / k), F.col("_all") % k
    fold = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor(F.try_divide(at - more * (size + 1), size)))
    return placed.crossJoin(F.broadcast(total)).select(*rows.columns, fold.cast("long").alias("fold"))


def even_split(rows: DataFrame) -> DataFrame:
    """Half of each label to dev, rounded up, in order of samples; a single one is dev."""
    by_label = Window.partitionBy("label")
    place = F.row_number().over(by_label.orderBy("sample"))
    return rows.withColumn("set", F.when(place <= F.ceil(F.count("*").over(by_label) / 2.0), "dev").otherwise("test"))


def signal_counts(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of flags by sample over combinations and repeats, with how many there were: additive, so shards can be summed."""
    return flags.groupBy(*keys, "sample").agg(F.count_if("flag").alias("n_abnormal"), F.count("*").alias("n_total"))


def expected_parameters(rows: DataFrame) -> DataFrame:
    """Mean of means, and root of mean variance plus variance of means, by chromosome over repeats of (``mu``, ``sd``)."""
    return rows.groupBy("chr").agg(F.avg("mu").alias("mu"), F.sqrt(F.avg(F.col("sd") * F.col("sd")) + F.var_pop("mu")).alias("sd"))


def best_repeat(calls: DataFrame, cutoff: float) -> DataFrame:
    """Repeats by MCC over samples of (``repeat_id``, ``sample``, ``chr``, ``ez``, ``is_true``, ``forced_normal``), the first on ties."""
    top = calls.groupBy("repeat_id", "sample", "is_true", "forced_normal").agg(F.max("ez").alias("top"))
    called = top.withColumn("y", F.coalesce(F.col("top") > cutoff, F.lit(False)) & ~F.col("forced_normal"))
    counts = called.groupBy("repeat_id").agg(F.count_if(F.expr("y and is_true")).alias("tp"), F.count_if(F.expr("y and not is_true")).alias("fp"), F.count_if(F.expr("not y and is_true")).alias("fn"), F.count_if(F.expr("not y and not is_true")).alias("tn"))
    return counts.withColumn("mcc", mcc(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def left_out_scores(rows: DataFrame, fold: str | None = None) -> DataFrame:
    """(sample, chr, score): both scores' sum of each sample against the other samples, or other folds.

    ``rows`` has hypo_z, hyper_z, their site counts and the percentage; three sets of totals, no repeats.
    """
    from cohortlens.functions.scalar import z_value
    from cohortlens.operators.scores import inter_score

    for v in ("hypo_z", "hyper_z", "percentage"):
        rows = leave_out(rows, ["chr"], v, fold)
    z = {v: z_value(F.col(v), F.col(f"{v}_mu"), F.col(f"{v}_sd")) for v in ("hypo_z", "hyper_z", "percentage")}
    return rows.select("sample", "chr", (inter_score(z["hypo_z"], z["hyper_z"], F.col("hypo_n"), F.col("hyper_n")) + z["percentage"]).alias("score"))
