"""Sweeps over repeats, and searches whose next step needs the last one's result (short driver loops, one aggregation a step)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.scalar import z_value
from cohortlens.operators import blocks, ranks
from cohortlens.operators.draws import keyed_draws, of_pool
from cohortlens.operators.evaluate import roc_auc, sample_confusion
from cohortlens.operators.scores import inter_score
from cohortlens.sources.files import scratch


def _met(rows: DataFrame, stats: DataFrame, values: list[str]) -> DataFrame:
    """Rows (sample, chr, values) with each repeat's parameters of their chromosome (``repeat_id`` and the other columns of ``stats``).

    Chromosomes are few, so samples are dealt into slices and a chromosome's parameters go to
    each of them, some hundred repeats a row: keys are as many as tasks, and repeats multiply
    rows after the join.
    """
    params = [c for c in stats.columns if c != "chr"]
    slices = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    packed = stats.groupBy("chr", F.floor(F.col("repeat_id") / 256).alias("_block")).agg(F.collect_list(F.struct(*params)).alias("_stats"))
    packed = packed.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = rows.select("sample", "chr", *values).withColumn("_slice", F.pmod(F.xxhash64("sample"), F.lit(slices)).cast("int"))
    return dealt.join(packed, ["chr", "_slice"]).select("sample", "chr", *values, F.explode("_stats").alias("_s")).select("sample", "chr", *values, "_s.*")


def _parameters(rows: DataFrame, draws: DataFrame, values: list[str]) -> DataFrame:
    """Mean and SD of ``values`` by repeat and chromosome over the repeat's samples."""
    aggs = [a for v in values for a in (F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_sd"))]
    return rows.join(draws.select("repeat_id", "sample"), "sample").groupBy("repeat_id", "chr").agg(*aggs)


def repeated_scores(rows: DataFrame, draws: DataFrame, value: str) -> DataFrame:
    """(repeat_id, sample, chr, z) of every sample against each repeat's reference; the repeat is one more key."""
    met = _met(rows, _parameters(rows, draws, [value]), [value])
    return met.select("repeat_id", "sample", "chr", z_value(F.col(value), F.col(f"{value}_mean"), F.col(f"{value}_sd")).alias("z"))


TRACKS = ["hypo_z", "hyper_z", "percentage"]


def repeated_tracks(tracks: DataFrame, draws: DataFrame) -> DataFrame:
    """(repeat_id, sample, chr, episcore, zscore) of ``tracks`` (hypo_z, hyper_z, their site counts, percentage) against each repeat's reference."""
    met = _met(tracks, _parameters(tracks, draws, TRACKS), [*TRACKS, "hypo_n", "hyper_n"])
    z = {v: z_value(F.col(v), F.col(f"{v}_mean"), F.col(f"{v}_sd")) for v in TRACKS}
    return met.select("repeat_id", "sample", "chr", inter_score(z["hypo_z"], z["hyper_z"], F.col("hypo_n"), F.col("hyper_n")).alias("episcore"), z["percentage"].alias("zscore"))


def combined(scored: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """``scored`` with ``ez`` of the sum of both scores, and its parameters, by repeat and chromosome over the samples of ``chosen`` (``keys``)."""
    flagged = scored.withColumn("s", F.col("episcore") + F.col("zscore")).join(chosen.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "left")
    over, own = Window.partitionBy("repeat_id", "chr"), F.when(F.col("_in"), F.col("s"))
    with_stats = flagged.withColumn("ez_mean", F.coalesce(F.avg(own).over(over), F.lit(0.0))).withColumn("ez_sd", F.stddev_pop(own).over(over))
    return with_stats.withColumn("ez", z_value(F.col("s"), F.col("ez_mean"), F.col("ez_sd"))).drop("s", "_in")


def repeated_calls(tracks: DataFrame, draws: DataFrame, ez_reference: DataFrame, strong: float = 4.5, gray: float = 3.0) -> DataFrame:
    """(repeat_id, sample, chr, strong, gray): calls of the combined score against each repeat's reference and one list of samples for the combination."""
    ez = combined(repeated_tracks(tracks, draws), ez_reference, ["sample"])
    return ez.select("repeat_id", "sample", "chr", F.coalesce(F.col("ez") > strong, F.lit(False)).alias("strong"), F.coalesce((F.col("ez") >= gray) & (F.col("ez") <= strong), F.lit(False)).alias("gray"))


def reference_matrices(tracks: DataFrame, ref_draws: DataFrame, ez_draws: DataFrame) -> DataFrame:
    """Each repeat's reference matrices: mean and SD of every track by chromosome, and of the combined score over the repeat's second reference."""
    second = combined(repeated_tracks(tracks, ref_draws), ez_draws, ["repeat_id", "sample"]).groupBy("repeat_id", "chr").agg(F.first("ez_mean").alias("ez_mean"), F.first("ez_sd").alias("ez_sd"))
    return _parameters(tracks, ref_draws, TRACKS).join(second, ["repeat_id", "chr"])


def signal_variants(tracks: DataFrame, ref_draws: DataFrame, ez_draws: DataFrame, cutoff: float = 3.0, ez_cutoffs: tuple[float, float] = (3.0, 4.5)) -> DataFrame:
    """By sample and chromosome the share of repeats in which each score, and the combined one at both cutoffs, is above its cutoff."""
    ez = combined(repeated_tracks(tracks, ref_draws), ez_draws, ["repeat_id", "sample"])
    share = lambda c, name: (F.count_if(c) / F.count("*")).alias(name)
    low, high = ez_cutoffs
    return ez.groupBy("sample", "chr").agg(share(F.col("episcore") > cutoff, "episcore_ratio"), share(F.col("zscore") > cutoff, "zscore_ratio"), share(F.col("ez") > low, "ez_low_ratio"), share(F.col("ez") > high, "ez_high_ratio"))


def reference_candidates(tracks: DataFrame, draws: DataFrame, early: DataFrame, ez_reference: DataFrame) -> DataFrame:
    """(repeat_id, n_changed, n_compared, distance) of each draw of a reference, all in one job.

    ``n_changed`` are the samples, other than early ones and the draw's own, with a call on any
    chromosome that differs from that against the early reference; ``distance`` is the sum of the
    squared differences of the draw's parameters from the early ones', relative to the early SDs.
    """
    first = early.select(F.lit(-1).cast("long").alias("repeat_id"), "sample").distinct()
    draws = draws.select(F.col("repeat_id").cast("long"), "sample").distinct()
    calls = repeated_calls(tracks, draws, ez_reference)
    base = repeated_calls(tracks, first, ez_reference).select("sample", "chr", F.col("strong").alias("_strong"), F.col("gray").alias("_gray"))
    others = calls.join(first.select("sample"), "sample", "left_anti").join(draws, ["repeat_id", "sample"], "left_anti")
    differs = (F.col("strong") != F.col("_strong")) | (F.col("gray") != F.col("_gray"))
    changed = others.join(base, ["sample", "chr"]).groupBy("repeat_id", "sample").agg(F.bool_or(differs).alias("_changed"))
    changed = changed.groupBy("repeat_id").agg(F.count_if("_changed").alias("n_changed"), F.count("*").alias("n_compared"))
    away = _parameters(tracks, draws, TRACKS).join(_parameters(tracks, first, TRACKS).drop("repeat_id").withColumnsRenamed({f"{v}_{k}": f"_{v}_{k}" for v in TRACKS for k in ("mean", "sd")}), "chr")
    terms = []
    for v in TRACKS:
        scale = F.when(F.abs(f"_{v}_sd") > 1e-8, F.abs(f"_{v}_sd")).otherwise(1.0)
        terms += [F.coalesce(F.pow((F.col(f"{v}_{k}") - F.col(f"_{v}_{k}")) / scale, 2), F.lit(0.0)) for k in ("mean", "sd")]
    distance = away.groupBy("repeat_id").agg(F.sum(sum(terms, F.lit(0.0))).alias("distance"))
    return distance.join(changed, "repeat_id", "left").select("repeat_id", F.coalesce("n_changed", F.lit(0)).alias("n_changed"), F.coalesce("n_compared", F.lit(0)).alias("n_compared"), "distance")


def repeated_ez(rows: DataFrame, draws: DataFrame, value: str) -> DataFrame:
    """(repeat_id, sample, chr, ez): ``value`` against each repeat's second reference."""
    stats = rows.join(draws.select("repeat_id", "sample"), ["repeat_id", "sample"]).groupBy("repeat_id", "chr").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("_m"), F.stddev_pop(value).alias("_sd"))
    return rows.join(stats, ["repeat_id", "chr"]).select("repeat_id", "sample", "chr", z_value(F.col(value), F.col("_m"), F.col("_sd")).alias("ez"))


def pool_sizes(rows: DataFrame, meta: DataFrame, sizes: list[int]) -> DataFrame:
    """AUC of the largest z by size of nested pools of normals."""
    first = meta.where("label = 'Normal'").select("sample", ((F.col("sample") * 7919) % 1000003).alias("_o")).orderBy("_o", "sample").limit(max(sizes))
    pool = first.withColumn("_n", F.row_number().over(Window.orderBy("_o", "sample")))  # as many rows as the largest pool
    nested = pool.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("_n <= size").select("size", "sample")
    z = repeated_scores(rows, nested.withColumnRenamed("size", "repeat_id"), "percentage")
    top = z.groupBy(F.col("repeat_id").alias("size"), "sample").agg(F.max("z").alias("score"))
    return roc_auc(top.join(meta.select("sample", (F.col("label") != "Normal").alias("positive")), "sample"), ["size"])


def greedy_subset(parts: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """(step, part, auc): parts added one by one, each time the one that gives the summed values the best AUC.

    All candidates of a step are scored in one job; ties go to the first name.
    """
    spark = parts.sparkSession
    names = sorted(r["part"] for r in parts.select("part").distinct().collect())
    every = truth.crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in names], "part string")))
    full = every.join(parts, ["sample", "part"], "left").fillna(0, ["value"]).cache()
    chosen: list[tuple[int, str, float]] = []
    try:
        while len(chosen) < min(most, len(names)):
            have = [c[1] for c in chosen]
            held = full.groupBy("sample").agg(F.coalesce(F.sum(F.when(F.col("part").isin(have), F.col("value"))), F.lit(0)).alias("_held"))
            trial = full.where(~F.col("part").isin(have)).join(held, "sample").select("part", "positive", (F.col("value") + F.col("_held")).alias("score"))
            row = roc_auc(trial, ["part"]).where("auc is not null").orderBy(F.round("auc", 9).desc(), "part").first()
            if row is None:
                break
            chosen.append((len(chosen) + 1, row["part"], float(row["auc"])))
    finally:
        full.unpersist()
    return spark.createDataFrame(chosen, "step long, part string, auc double")


def greedy_shrink(rows: DataFrame, start: DataFrame, cutoff: float, rounds: int = 3, largest: float = 0.99) -> DataFrame:
    """(chr, threshold, recall) after each chromosome, from the least recall up, has taken the largest recall (then the
    least threshold) at which the MCC over samples is no worse than at the start.

    A sample's other chromosomes are one maximum, so all candidates of a chromosome are one job.
    """
    spark = rows.sparkSession
    rows = rows.select("sample", "is_normal", "chr", "threshold", "recall", "score").cache()
    now = {r["chr"]: (r["threshold"], r["recall"]) for r in start.select("chr", "threshold", "recall").collect()}
    table = lambda d: F.broadcast(spark.createDataFrame([(c, *v) for c, v in d.items()], "chr string, threshold double, recall double"))
    try:
        at = rows.join(table(now), ["chr", "threshold", "recall"])
        base = sample_confusion(at.withColumn("k", F.lit(1)), ["k"], cutoff).first()["mcc"]
        for _ in range(rounds):
            changed = False
            for name in sorted(now, key=lambda c: (now[c][1], c)):
                others = rows.join(table({c: v for c, v in now.items() if c != name}), ["chr", "threshold", "recall"]) if len(now) > 1 else rows.limit(0)
                rest = others.groupBy("sample", "is_normal").agg(F.max("score").alias("_rest"))
                own = rows.where((F.col("chr") == name) & (F.col("recall") > now[name][1] + 1e-9) & (F.col("recall") <= largest + 1e-9))
                combos = own.select("threshold", "recall").distinct()
                grid = rest.crossJoin(F.broadcast(combos)).join(own.select("sample", "threshold", "recall", "score"), ["sample", "threshold", "recall"], "left")
                found = sample_confusion(grid.withColumn("score", F.greatest("score", "_rest")), ["threshold", "recall"], cutoff)
                row = found.where(F.round("mcc", 9) >= round(base, 9)).orderBy(F.col("recall").desc(), "threshold").first()
                if row is not None:
                    now[name], changed = (row["threshold"], row["recall"]), True
            if not changed:
                break
    finally:
        rows.unpersist()
    return spark.createDataFrame([(c, *v) for c, v in sorted(now.items())], "chr string, threshold double, recall double")


def numbered(pool: DataFrame) -> tuple[DataFrame, int]:
    """The samples of a pool in order with their ``place`` from 0 (written once), and how many there are."""
    spark = pool.sparkSession
    ranked = ranks.numbered(pool.select("sample").distinct(), ["sample"], "place").withColumn("place", (F.col("place") - 1).cast("long"))
    ranked.write.parquet(path := scratch(spark, "pool"))
    out = spark.read.schema(ranked.schema).parquet(path)
    return out, out.count()


def stable_reference(tracks: DataFrame, early: DataFrame, pool: DataFrame, ez_reference: DataFrame, size: int, n_random: int = 500, swaps: int = 200, block: int = 20, seed: int = 42) -> DataFrame:
    """(``sample``, ``n_changed``, ``distance``): a reference of ``size`` from ``pool`` that changes fewest calls, then is nearest to the early one.

    Candidates are the early samples of the pool with random fillers, and with those that greedily
    bring the parameters nearest; random draws of the whole pool; then random swaps of one
    sample of the best so far, each kept if it is better, to the end of ``swaps``.  Fillers and
    draws are places in the counted pool and are all scored in one job; swaps are scored in blocks,
    from the last one that was kept on.  Only places (``size`` a draw) and a block's figures come
    to the driver.
    """
    spark = tracks.sparkSession
    places, n = numbered(pool)
    if n < size:
        raise ValueError(f"a pool of {n} for a reference of {size}")
    rng = np.random.default_rng(seed)
    held = sorted(r["place"] for r in places.join(early.select("sample").distinct(), "sample", "left_semi").select("place").limit(size + 1).collect())
    draws: list[list[int]] = []
    if len(held) <= size:
        for _ in range(n_random):
            free = [x for x in rng.choice(n, size=min(n, size + len(held)), replace=False).tolist() if x not in held]
            draws.append([*held, *free[: size - len(held)]])
        draws.append(_nearest_fillers(tracks, early, places, held, size))
    draws += [rng.choice(n, size=size, replace=False).tolist() for _ in range(n_random)]
    draws = [list(d) for d in dict.fromkeys(tuple(sorted(d)) for d in draws)]

    def scored(some: list[list[int]]) -> list[tuple[int, float]]:
        table = spark.createDataFrame([(r, int(x)) for r, d in enumerate(some) for x in d], "repeat_id long, place long").join(places, "place")
        found = {r["repeat_id"]: (r["n_changed"], r["distance"]) for r in reference_candidates(tracks, table, early, ez_reference).collect()}
        return [found[i] for i in range(len(some))]

    figures = scored(draws)
    best = min(range(len(draws)), key=lambda i: (figures[i][0], round(figures[i][1], 9), i))
    now, value = draws[best], figures[best]
    done = 0
    while done < swaps and n > size:
        trials = []
        for _ in range(min(block, swaps - done)):
            add = int(rng.integers(n))
            while add in now:
                add = int(rng.integers(n))
            drop = now[int(rng.integers(size))]
            trials.append(sorted([*(x for x in now if x != drop), add]))
        got = scored(trials)
        better = next((i for i, g in enumerate(got) if (g[0], round(g[1], 9)) < (value[0], round(value[1], 9))), None)
        done += len(trials) if better is None else better + 1
        if better is not None:
            now, value = trials[better], got[better]
    chosen = spark.createDataFrame([(int(x),) for x in now], "place long")
    return places.join(F.broadcast(chosen), "place").select("sample", F.lit(value[0]).cast("long").alias("n_changed"), F.lit(float(value[1])).alias("distance"))


def _nearest_fillers(tracks: DataFrame, early: DataFrame, places: DataFrame, held: list[int], size: int) -> list[int]:
    """``held`` filled up one by one with the sample that brings the parameters nearest to the early ones'; one job a step."""
    spark = tracks.sparkSession
    target = _parameters(tracks, early.select(F.lit(0).alias("repeat_id"), "sample"), TRACKS).drop("repeat_id")
    wide = tracks.join(places, "sample").select("place", "chr", *TRACKS)
    chosen = list(held)
    while len(chosen) < size:
        have = spark.createDataFrame([(int(x),) for x in chosen], "place long")
        sums = wide.join(F.broadcast(have), "place", "left_semi").groupBy("chr").agg(*[F.coalesce(a, F.lit(0.0)).alias(n) for v in TRACKS for n, a in ((f"{v}_s", F.sum(v)), (f"{v}_q", F.sum(F.col(v) * F.col(v))), (f"{v}_n", F.count(v).cast("double")))])
        trial = wide.join(F.broadcast(have), "place", "left_anti").join(target, "chr").join(sums, "chr", "left")
        terms = []
        for v in TRACKS:
            x, n = F.coalesce(v, F.lit(0.0)), F.coalesce(f"{v}_n", F.lit(0.0)) + F.col(v).isNotNull().cast("double")
            mu = F.coalesce(F.try_divide(F.coalesce(f"{v}_s", F.lit(0.0)) + x, F.nullif(n, F.lit(0.0))), F.lit(0.0))
            sd = F.sqrt(F.greatest(F.coalesce(F.try_divide(F.coalesce(f"{v}_q", F.lit(0.0)) + x * x, F.nullif(n, F.lit(0.0))), F.lit(0.0)) - mu * mu, F.lit(0.0)))
            scale = F.when(F.abs(f"{v}_sd") > 1e-8, F.abs(f"{v}_sd")).otherwise(1.0)
            terms += [F.pow((mu - F.col(f"{v}_mean")) / scale, 2), F.coalesce(F.pow((sd - F.col(f"{v}_sd")) / scale, 2), F.lit(0.0))]
        near = trial.groupBy("place").agg(F.round(F.sum(sum(terms, F.lit(0.0))), 9).alias("d")).orderBy("d", "place").limit(1).first()
        chosen.append(near["place"])
    return chosen


def called_normal(rows: DataFrame, scores: list[str], cutoff: float = 3.0) -> DataFrame:
    """(``sample``, ``normal``): whether no chromosome is above the cutoff by any of the scores; a sample so called stays normal whatever the combined score says."""
    above = F.lit(False)
    for s in scores:
        above |= F.coalesce(F.col(s) > cutoff, F.lit(False))
    return rows.groupBy("sample").agg((~F.bool_or(above)).alias("normal"))


def ez_reference_search(scores: DataFrame, pool: DataFrame, truth: DataFrame, size: int = 20, repeats: int = 5000, cutoff: float = 3.0, seed: int = 42) -> DataFrame:
    """(``sample``, ``repeat_id``, ``mcc``): the first of ``repeats`` random references from ``pool`` with the largest MCC over all samples.

    ``scores`` has the combined score (``score``) by sample and chromosome, ``truth`` is (sample,
    is_true, forced_normal).  Repeats are drawn on the executors and scored as block products.
    """
    places, n = numbered(pool)
    drawn = of_pool(keyed_draws(scores.sparkSession, n, {"ez": size}, repeats, seed), places).select("repeat_id", "sample")
    tracks = blocks.pack(scores, ["score"], truth)
    tracks.rows.write.parquet(path := scratch(scores.sparkSession, "tracks"))
    tracks = tracks._replace(rows=scores.sparkSession.read.schema(tracks.rows.schema).parquet(path))
    found = blocks.confusion(tracks, blocks.parameters(tracks, drawn), cutoff)
    best = found.orderBy(F.round("mcc", 9).desc(), "repeat_id").limit(1).select("repeat_id", "mcc")
    return drawn.join(F.broadcast(best), "repeat_id").select("sample", "repeat_id", "mcc")
