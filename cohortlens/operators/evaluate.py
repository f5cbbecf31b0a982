"""Evaluation of scores: confusion counts, choice of combinations, separation, call labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.scalar import is_trisomy, mcc, ratio


def combo_metrics(rows: DataFrame, keys: list[str], cutoff: float, score: str = "score") -> DataFrame:
    """Counts, MCC and separation by ``keys`` of rows with ``is_target`` and ``is_normal``; a NULL score is not positive."""
    s = F.col(score)
    positive = F.coalesce(s > cutoff, F.lit(False))
    target, normal = F.col("is_target"), F.col("is_normal")
    out = rows.groupBy(*keys).agg(
        F.count_if(positive & target).alias("tp"), F.count_if(positive & normal).alias("fp"), F.count_if(~positive & target).alias("fn"), F.count_if(~positive & normal).alias("tn"),
        (F.min(F.when(positive & target, s)) - F.max(F.when(~positive & normal, s))).alias("sep_score"),
        F.count_if((F.abs(s) > cutoff) & normal).alias("fp_ext"), F.var_pop(F.when(normal, s)).alias("normal_var"),
    )
    return out.withColumn("mcc", mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def with_roles(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """Scores by chromosome with the sample's role for it: target if its label is that chromosome's trisomy, normal, or neither (dropped)."""
    joined = scores.join(meta.select("sample", "label"), "sample")
    rows = joined.withColumn("is_target", F.col("label") == F.regexp_replace("chr", "^chr", "T")).withColumn("is_normal", F.col("label") == "Normal")
    return rows.where("is_target or is_normal")


#: Fixed value: the largest recall that a combination may have.
MAX_RECALL = 0.99


def pick_combo(metrics: DataFrame, keys: list[str], min_recall: Column | float = 0.0) -> DataFrame:
    """The best combination by ``keys``: with true positives, largest MCC, separation and recall; without any,
    fewest two-sided false positives, smallest variance of normals, largest recall; then least threshold."""
    low = min_recall if isinstance(min_recall, Column) else F.lit(min_recall)
    some = metrics.where((F.col("recall") >= low) & (F.col("recall") <= MAX_RECALL))
    some = some.withColumn("has_target", F.max(F.col("tp") > 0).over(Window.partitionBy(*keys)))
    hit = F.col("has_target")
    order = [
        F.when(hit, F.round("mcc", 8)).desc_nulls_last(), F.when(hit, F.round("sep_score", 8)).desc_nulls_last(),
        F.when(~hit, F.col("fp_ext")).asc_nulls_last(), F.when(~hit, F.round("normal_var", 8)).asc_nulls_last(),
        F.col("recall").desc(), F.col("threshold").asc(),
    ]
    return some.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def sample_confusion(rows: DataFrame, keys: list[str], cutoff: float, score: str = "score") -> DataFrame:
    """Counts by ``keys`` over samples, each positive if any chromosome's score is above the cutoff; ``is_normal`` is the truth."""
    positive = F.coalesce(F.max(score) > cutoff, F.lit(False))
    called = rows.groupBy(*keys, "sample", "is_normal").agg(positive.alias("positive"))
    out = called.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in (
        ("tp", F.col("positive") & ~F.col("is_normal")), ("fp", F.col("positive") & F.col("is_normal")),
        ("fn", ~F.col("positive") & ~F.col("is_normal")), ("tn", ~F.col("positive") & F.col("is_normal")))])
    return out.withColumn("mcc", mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def flexible_search(metrics: DataFrame, scores: DataFrame, cutoff: float, steps: int = 99) -> DataFrame:
    """The choice by chromosome under the least recall (0.01 to 0.99) of best MCC over samples, the largest on ties.

    All least recalls are tried in one job: they are one more key of the choice and of the counts.
    """
    spark = metrics.sparkSession
    lows = spark.range(1, steps + 1).select((F.col("id") / 100.0).alias("min_recall"))
    tried = metrics.join(F.broadcast(lows), (F.col("recall") >= F.col("min_recall")) & (F.col("recall") <= MAX_RECALL))
    picked = pick_combo(tried, ["min_recall", "chr"], F.col("min_recall")).select("min_recall", "chr", "threshold", "recall", "has_target")
    every = metrics.select("chr").distinct().count()
    whole = picked.withColumn("_n", F.count("*").over(Window.partitionBy("min_recall"))).where(F.col("_n") == every).drop("_n")
    # least recalls that lead to the same choices are one: the largest of them, which wins on ties
    choices = whole.groupBy("min_recall").agg(F.array_sort(F.collect_list(F.struct("chr", "threshold", "recall"))).alias("_all"))  # a chromosome each
    whole = whole.join(choices.groupBy("_all").agg(F.max("min_recall").alias("min_recall")).select("min_recall"), "min_recall", "left_semi")
    at = scores.join(whole, ["chr", "threshold", "recall"])
    found = sample_confusion(at, ["min_recall"], cutoff)
    best = found.agg(F.max_by("min_recall", F.struct(F.round("mcc", 8), F.col("min_recall"))).alias("min_recall"))
    return whole.join(F.broadcast(best), "min_recall").select("chr", "threshold", "recall", "has_target", "min_recall")


def fixed_search(scores: DataFrame, cutoff: float) -> DataFrame:
    """Combinations by MCC over samples, larger recall, lower threshold; ``rank`` 1 is the choice."""
    found = sample_confusion(scores, ["threshold", "recall"], cutoff)
    return found.orderBy(F.round("mcc", 8).desc(), F.col("recall").desc(), F.col("threshold")).limit(1)


def average_ranks(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Ranks from 1 by score, tied ones sharing their mean."""
    over = Window.partitionBy(*keys)
    return rows.withColumn("avg_rank", F.rank().over(over.orderBy(score)) + (F.count("*").over(over.orderBy(score).rangeBetween(0, 0)) - 1) / 2.0)


def roc_auc(rows: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """AUC by ``keys`` from rank sums over distinct scores; NULL without both classes.  Equal scores are counted first."""
    n = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    before = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return n.groupBy(*keys).agg(ratio(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)), F.sum("p") * F.sum("n")).alias("auc"))


def youden(rows: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """The largest TPR - FPR by ``keys`` over all rows in falling order of the score, by sample where it ties."""
    over = Window.partitionBy(*keys)
    falling = over.orderBy(F.col(score).desc(), F.col("sample")).rowsBetween(Window.unboundedPreceding, 0)
    y, no = F.col(positive).cast("int"), (~F.col(positive)).cast("int")
    j = ratio(F.sum(y).over(falling), F.sum(y).over(over)) - ratio(F.sum(no).over(falling), F.sum(no).over(over))
    return rows.where(F.col(score).isNotNull()).withColumn("_j", j).groupBy(*keys).agg(F.max("_j").alias("youden"))


def cohens_d(rows: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """Difference of means over the pooled sample SD; NULL with under two of a class or no spread."""
    x = {True: F.when(F.col(positive), F.col(score)), False: F.when(~F.col(positive), F.col(score))}
    got = rows.groupBy(*keys).agg(*[f(x[c]).alias(f"{n}{int(c)}") for c in x for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = ratio((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2)
    return got.select(*keys, F.when((F.col("n1") >= 2) & (F.col("n0") >= 2) & (pooled > 0), (F.col("m1") - F.col("m0")) / F.sqrt(pooled)).alias("cohens_d"))


def cliffs_delta(rows: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """P(x > y) - P(x < y), which is 2 AUC - 1; no pairs are formed."""
    return roc_auc(rows, keys, score, positive).select(*keys, (2 * F.col("auc") - 1).alias("cliffs_delta"))


def max_chr_flags(scores: DataFrame, keys: list[str], cutoffs: list[float], score: str = "score") -> DataFrame:
    """Of each sample by ``keys`` and cutoff, whether its largest score is above it."""
    top = scores.groupBy(*keys, "sample").agg(F.max(score).alias("top"))
    return top.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).withColumn("flag", F.coalesce(F.col("top") > F.col("cutoff"), F.lit(False)))


def pred_label(rows: DataFrame, score: str = "score", strong: float = 4.5, gray: float = 3.0) -> DataFrame:
    """Call labels by sample: ``T<n>`` above ``strong``, then ``Gray_T<n>`` above ``gray``, in order of chromosomes, or ``Normal``."""
    n = F.regexp_replace("chr", "^chr", "").cast("int")
    s = F.col(score)
    call = F.when(s > strong, F.struct(F.lit(0).alias("k"), n.alias("n"), F.concat(F.lit("T"), n).alias("label"))).when(s > gray, F.struct(F.lit(1).alias("k"), n.alias("n"), F.concat(F.lit("Gray_T"), n).alias("label")))
    calls = F.array_join(F.transform(F.sort_array(F.collect_list(call)), lambda c: c["label"]), ",")
    return rows.groupBy("sample").agg(F.coalesce(F.nullif(calls, F.lit("")), F.lit("Normal")).alias("pred_label"))


def match_status(rows: DataFrame, meta: DataFrame, score: str = "score", cutoff: float = 3.0) -> DataFrame:
    """TP, FN, TN, FP or UNK by sample from its label and scores; T15 with a fraction under 0.01 is FN."""
    known = rows.groupBy("sample").agg((F.count_if(F.coalesce(F.col(score) < cutoff, F.lit(False))) == F.count("*")).alias("below"), (F.count_if(F.col(score) > cutoff) > 0).alias("above"))
    j = known.join(meta, "sample")
    t = is_trisomy(F.col("label"))
    n = F.lower("label") == "normal"
    status = (
        F.when((F.col("label") == "T15") & (F.col("ff_before_mq") < 0.01), "FN")
        .when(t & F.col("above"), "TP").when(t & F.col("below"), "FN").when(n & F.col("below"), "TN").when(n & F.col("above"), "FP").otherwise("UNK")
    )
    return j.select("sample", status.alias("match_status"))
