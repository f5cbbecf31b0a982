"""Screening of reference samples: robust z values, enrichment in bad draws, admission rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.scalar import ratio
from cohortlens.operators.ranks import exact_quantiles
from cohortlens.sources.files import scratch

#: Fixed value: makes the MAD of a normal distribution its SD.
MAD_K = 0.6745


def mad_z(rows: DataFrame, keys: list[str], value: str, reference: Column | None = None) -> DataFrame:
    """``rows`` with ``mad_z`` by median and MAD of ``keys``, of reference rows alone if given; 0 where the MAD is 0."""
    spark = rows.sparkSession
    rows.write.parquet(path := scratch(spark, "rows"))  # read four times
    rows = spark.read.schema(rows.schema).parquet(path)
    some = rows if reference is None else rows.where(reference)
    center = exact_quantiles(some, keys, value, {"_median": 0.5})
    away = some.join(center, keys).withColumn("_away", F.abs(F.col(value) - F.col("_median")))
    spread = center.join(exact_quantiles(away, keys, "_away", {"_mad": 0.5}), keys)
    z = F.coalesce(ratio(F.lit(MAD_K) * (F.col(value) - F.col("_median")), F.col("_mad")), F.lit(0.0))
    return rows.join(spread, keys, "left").withColumn("mad_z", z).drop("_median", "_mad")


def fences(rows: DataFrame, limit: float = 3.5) -> DataFrame:
    """Samples with how many chromosomes are outside the fence, the largest value and whether they are admitted."""
    out = F.count_if(F.abs("mad_z") > limit)
    return rows.groupBy("sample").agg(out.alias("n_fail"), F.max(F.abs("mad_z")).alias("worst"), (out == 0).alias("admitted"))


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation; a key without values has nulls."""
    return rows.select(*keys).distinct().join(exact_quantiles(rows, keys, value, at), keys, "left")


def density(rows: DataFrame, value: str) -> DataFrame:
    """Counts, shares and cumulative shares of the values of a whole number."""
    n = rows.groupBy(value).agg(F.count("*").alias("n"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all"))))
    # values of a count are few; the window holds one row for each
    return n.select(value, "n", ratio(F.col("n"), F.col("_all")).alias("share"), ratio(F.sum("n").over(Window.orderBy(value)), F.col("_all")).alias("cum_share"))


def membership_enrichment(draws: DataFrame, outcome: DataFrame) -> DataFrame:
    """By sample the 2 x 2 table of membership against bad draws, shares by class and their ratio."""
    totals = outcome.agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"))
    inside = draws.join(outcome, "repeat_id").groupBy("sample").agg(F.count_if("bad").alias("in_bad"), F.count_if(~F.col("bad")).alias("in_good"))
    out = inside.crossJoin(F.broadcast(totals))
    out = out.withColumn("out_bad", F.col("n_bad") - F.col("in_bad")).withColumn("out_good", F.col("n_good") - F.col("in_good"))
    out = out.withColumn("p_bad", ratio(F.col("in_bad"), F.col("n_bad"))).withColumn("p_good", ratio(F.col("in_good"), F.col("n_good")))
    return out.withColumn("lift", ratio(F.col("p_bad"), F.col("p_good"))).select("sample", "in_bad", "in_good", "out_bad", "out_good", "p_bad", "p_good", "lift")


def fisher_exact(table: DataFrame, a: str = "in_bad", b: str = "in_good", c: str = "out_bad", d: str = "out_good") -> DataFrame:
    """``table`` with ``odds_ratio`` and the two-sided ``p_value``: the sum of all tables' chances that are no larger than the observed one's.

    The chances of a row's tables follow from each other by ratios, so a row costs as many steps as
    its smallest margin has, in Arrow batches, whatever the totals.
    """

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(a: int, b: int, c: int, d: int) -> float:
            low, high = max(0, a - d), min(a + b, a + c)
            x = np.arange(low, high, dtype=np.float64)
            logs = np.concatenate([[0.0], np.cumsum(np.log((a + b - x) * (a + c - x)) - np.log((x + 1) * (d - a + x + 1)))])
            chance = np.exp(logs - logs.max())
            return min(1.0, float(chance[logs <= logs[a - low] + 1e-7].sum() / chance.sum()))
        return pd.Series([None if None in r or any(x != x for x in r) else one(*map(int, r)) for r in zip(a, b, c, d, strict=True)], dtype="float64")

    a_, b_, c_, d_ = (F.col(x) for x in (a, b, c, d))
    odds = ratio(a_.cast("double") * d_, b_.cast("double") * c_)
    return table.withColumn("odds_ratio", odds).withColumn("p_value", p_value(*[x.cast("double") for x in (a_, b_, c_, d_)]))


#: The polynomial under the sixteenth power in a rational form of the complementary error function (error under 3e-7).
ERFC = (0.0705230784, 0.0422820123, 0.0092705272, 0.0001520143, 0.0002765672, 0.0000430638)


def two_sided_p(z: Column) -> Column:
    """The chance of a normal value at least as far from 0 as z."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    below = F.lit(0.0)
    for c in reversed(ERFC):
        below = (below + c) * x
    return F.pow(1 / (1 + below), F.lit(16))


# Fixed values of the simulated fit: draws, what counts as no smaller than the observed statistic, and the observed one that is added to the draws.
DRAWS, TOLERANCE, OBSERVED = 20_000, 1e-12, 1
#: Categories that a fit may have, as each draw holds them all, and draws of a block.
MOST_CATEGORIES, BLOCK = 10_000, 500


def uniform_fit(counts: DataFrame, value: str, n_sim: int = DRAWS, seed: int = 0) -> DataFrame:
    """(``chi2``, ``p_value``): goodness of fit of a few categories' counts to equal shares, p from seeded draws of the same total.

    The statistic is an aggregation.  Draws are made in blocks, each from the seed and its own number, by
    as many tasks as there are, so p doesn't depend on how they are dealt.  More categories than
    ``MOST_CATEGORIES`` are an error; no counts have a statistic of 0 and no p.
    """
    n = F.col(value).cast("double")
    whole = counts.agg(F.count(value).alias("k"), F.coalesce(F.sum(n), F.lit(0.0)).alias("total"), F.coalesce(F.sum(n * n), F.lit(0.0)).alias("squares"))
    found = whole.select("k", "total", F.coalesce(F.try_divide(F.col("squares") * F.col("k"), F.nullif("total", F.lit(0.0))) - F.col("total"), F.lit(0.0)).alias("chi2")).first()
    k, total, chi2 = int(found["k"]), int(found["total"]), float(found["chi2"])
    if k > MOST_CATEGORIES:
        raise ValueError(f"{k} categories: the draws are for {MOST_CATEGORIES} at most")
    spark = counts.sparkSession
    if not total:
        return spark.createDataFrame([(chi2, None)], "chi2 double, p_value double")

    @F.pandas_udf("long")
    def extreme(block: pd.Series) -> pd.Series:
        out = []
        for i in block:
            drawn = np.random.default_rng([seed, i]).multinomial(total, np.full(k, 1 / k), size=min(BLOCK, n_sim - i * BLOCK))
            out.append(int(((drawn.astype(np.float64) ** 2).sum(1) * k / total - total >= chi2 - TOLERANCE * max(1.0, total)).sum()))
        return pd.Series(out, dtype="int64")

    blocks = spark.range(-(-n_sim // BLOCK)).select(extreme("id").alias("above"))
    return blocks.agg(F.lit(chi2).alias("chi2"), ((OBSERVED + F.sum("above")) / (OBSERVED + n_sim)).alias("p_value"))


def mann_whitney(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """U of the positives and its normal approximation with tie and continuity corrections (``z``), with the two-sided ``p_value``."""
    n = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = (F.col("p") + F.col("q")).cast("double")
    got = n.withColumn("u", F.col("p") * (below + F.col("q") / 2.0)).groupBy(*keys).agg(F.sum("u").alias("u"), F.sum("p").cast("double").alias("n1"), F.sum("q").cast("double").alias("n2"), F.sum(t * t * t - t).alias("_ties"))
    m = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (m + 1 - F.try_divide(F.col("_ties"), m * (m - 1))))
    away = F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2.0) - 0.5, F.lit(0.0))
    return got.select(*keys, "u", ratio(away, sd).alias("z")).withColumn("p_value", two_sided_p(F.col("z")))


def toxic_scores(enriched: DataFrame, drop: int) -> DataFrame:
    """Samples by falling toxicity (share in bad draws less that in good ones); ``keep`` is false for the first ``drop``."""
    score = F.col("p_bad") - F.col("p_good")
    worst = enriched.withColumn("toxicity", score).orderBy(F.round("toxicity", 9).desc(), F.col("sample")).limit(drop).select("sample", F.lit(True).alias("_drop"))
    return enriched.withColumn("toxicity", score).join(F.broadcast(worst), "sample", "left").select("sample", "toxicity", F.col("_drop").isNull().alias("keep"))


def dose_response(draws: DataFrame, failing: DataFrame, outcome: DataFrame) -> DataFrame:
    """Draws by how many failing members they have: how many, how often bad, mean errors."""
    n = draws.join(failing.select("sample", F.lit(1).alias("_f")), "sample", "left").groupBy("repeat_id").agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("n_failing"))
    return n.join(outcome, "repeat_id").groupBy("n_failing").agg(F.count("*").alias("n_draws"), F.avg(F.col("bad").cast("double")).alias("bad_share"), F.avg("errors").alias("mean_errors"))
