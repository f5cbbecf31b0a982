"""Queries of the mixture fraction, of resampled references and of searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import blocks, draws, evaluate, methyl, resample, scores, search, snp
from cohortlens.plans import cohort as C
from cohortlens.plans.registry import query
from cohortlens.sources.files import scratch

KERNEL = "CASE WHEN {p} <= 0 THEN CASE WHEN n_alt = 0 THEN 0 ELSE '-Infinity'::DOUBLE END WHEN {p} >= 1 THEN CASE WHEN n_alt = n_ref + n_alt THEN 0 ELSE '-Infinity'::DOUBLE END ELSE n_alt * ln({p}) + n_ref * ln(1 - {p}) END"
MIX = ["((1 - f) * 0.0 + f * (0.5 * af))", "((1 - f) * 0.5 + f * (0.25 + 0.5 * af))", "((1 - f) * 1.0 + f * (0.5 + 0.5 * af))"]
PRIOR = ["ln((1 - af) * (1 - af))", "ln(2 * af * (1 - af))", "ln(af * af)"]
TERMS = [f"{p} + {KERNEL.format(p=m)}" for p, m in zip(PRIOR, MIX, strict=True)]
LIKE = f"(SELECT CASE WHEN m = '-Infinity'::DOUBLE THEN m ELSE m + ln(exp(a - m) + exp(b - m) + exp(c - m)) END FROM (SELECT {TERMS[0]} AS a, {TERMS[1]} AS b, {TERMS[2]} AS c, greatest(a, b, c) AS m))"


def grid_sql(source: str, keys: str, n: int, step: float, like: str = LIKE) -> str:
    return f"SELECT {keys}, f, sum({like}) AS l FROM (SELECT *, i * {step}::DOUBLE AS f FROM {source}, range(0, {n + 1}) t(i)) GROUP BY ALL"


@query("X1_A39_J23_likelihood", f"SELECT chr, f, l AS log_likelihood FROM ({grid_sql('snps', 'chr', 30, 0.01)})", "f log_likelihood")
def x1(spark, sf):
    """Summed log likelihoods over a grid of fractions by chromosome."""
    return snp.likelihood_grid(snp.clean_snps(C.snps(spark, sf)), ["chr"], 0.0, 0.3, 0.01)


@query("T3_X1_best_fraction", f"SELECT chr, f AS ff FROM ({grid_sql('snps', 'chr', 30, 0.01)}) QUALIFY row_number() OVER (PARTITION BY chr ORDER BY l DESC, f) = 1", "ff")
def t3(spark, sf):
    """The fraction of the largest likelihood."""
    grid = snp.likelihood_grid(snp.clean_snps(C.snps(spark, sf)), ["chr"], 0.0, 0.3, 0.01)
    return snp.best_fraction(grid, ["chr"]).select("chr", "ff")


@query("P13_X1_modes", f"""SELECT mode, f AS ff FROM ({grid_sql("(SELECT 'all' AS mode, * FROM snps UNION ALL SELECT CASE WHEN c.chr = s.chr THEN concat(c.chr, '_only') ELSE concat(c.chr, '_exclude') END, s.* FROM snps s, (SELECT chr FROM chrs WHERE chr IN ('chr13', 'chr18', 'chr21')) c)", 'mode', 20, 0.01)}) QUALIFY row_number() OVER (PARTITION BY mode ORDER BY l DESC, f) = 1""", "ff")
def p13(spark, sf):
    """Fractions of all, single and left-out chromosomes in one job."""
    some = scores.chromosomes(spark, ("chr13", "chr18", "chr21"))
    grid = snp.likelihood_grid(snp.analysis_modes(snp.clean_snps(C.snps(spark, sf)), some), ["mode"], 0.0, 0.2, 0.01)
    return snp.best_fraction(grid, ["mode"]).select("mode", "ff")


CALL = "CASE WHEN k0 >= k1 AND k0 >= k2 THEN 0 WHEN k1 >= k2 THEN 1 ELSE 2 END"
OWN = KERNEL.replace("n_alt", "m_alt").replace("n_ref", "m_ref")


@query("X2_genotyped_fraction", f"""WITH m AS (SELECT *, greatest(n_ref - model_ref, 0) AS m_ref, greatest(n_alt - model_alt, 0) AS m_alt FROM snps), k AS (SELECT *, {OWN.format(p='0.0')} AS k0, {OWN.format(p='0.5')} AS k1, {OWN.format(p='1.0')} AS k2 FROM m WHERE m_ref + m_alt > 0), g AS (SELECT *, {CALL} AS gt FROM k)
    SELECT chr, f AS ff FROM ({grid_sql('g', 'chr', 30, 0.01, f"CASE gt WHEN 0 THEN {KERNEL.format(p=MIX[0])} WHEN 1 THEN {KERNEL.format(p=MIX[1])} ELSE {KERNEL.format(p=MIX[2])} END")}) QUALIFY row_number() OVER (PARTITION BY chr ORDER BY l DESC, f) = 1""", "ff")
def x2(spark, sf):
    """With the mother's called genotype in place of the priors."""
    rows = snp.maternal_counts(snp.clean_snps(C.snps(spark, sf)))
    return snp.best_fraction(snp.likelihood_grid(rows, ["chr"], 0.0, 0.3, 0.01, genotype=True), ["chr"]).select("chr", "ff")


@query("X3_X4_narrowed_fraction", f"""WITH a AS ({grid_sql('snps', '1 AS one', 50, 0.01)}), b AS (SELECT round(f, 2) AS f FROM a ORDER BY l DESC, f LIMIT 1),
    c AS (SELECT f, sum({LIKE}) AS l FROM (SELECT snps.*, greatest(0, b.f - 0.01) + i * 0.001::DOUBLE AS f FROM snps, b, range(0, 21) t(i) WHERE greatest(0, b.f - 0.01) + i * 0.001 <= least(0.5, b.f + 0.01) + 1e-9) GROUP BY 1) SELECT round(f, 3)::DOUBLE AS ff FROM c ORDER BY l DESC, f LIMIT 1""", "ff")
def x3(spark, sf):
    """Grids of 0.01, then 0.001 around the best."""
    best, _ = snp.narrowed_fraction(snp.clean_snps(C.snps(spark, sf)))
    return spark.createDataFrame([(best,)], "ff double")


# --- repeated references -------------------------------------------------------------------------------------------


@query("X11_X13_draws", "SELECT repeat_id, role, sample FROM draws")
def x13(spark, sf):
    """Disjoint references by an arithmetic order."""
    return C.draws(spark, sf)


def feistel_sql(members: str, repeats: int, n: str, seed: int = 42) -> str:
    """Views ``walk`` and ``keyed`` (repeat_id, j, place) of the keyed permutation; ``n`` and ``members`` are scalar subqueries."""
    half, i, key, own = draws.FACTORS

    def mixed(side: str) -> str:
        v = f"(({side} * {half} + (i % {draws.ROUNDS}) * {i} + repeat_id * {key} + {seed * own}) % {draws.PRIME})"
        for _ in range(3):
            v = f"(({v} * {v} + {draws.ADDED}) % {draws.PRIME})"
        return v

    done = f"i > 0 AND i % {draws.ROUNDS} = 0 AND l * b + r < n"
    return f"""size AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b, {members} AS k FROM (SELECT n, greatest(1, ceil(sqrt(n))::BIGINT) AS a FROM (SELECT ({n})::BIGINT AS n))),
        walk AS (SELECT t.repeat_id, u.j, 0::BIGINT AS i, u.j // b AS l, u.j % b AS r, n, a, b FROM size, range({repeats}) t(repeat_id), LATERAL (SELECT unnest(range(k)) AS j) u
            UNION ALL SELECT repeat_id, j, i + 1, CASE WHEN i % 2 = 0 THEN (l + {mixed('r')}) % a ELSE l END, CASE WHEN i % 2 = 1 THEN (r + {mixed('l')}) % b ELSE r END, n, a, b FROM walk WHERE NOT ({done})),
        keyed AS (SELECT repeat_id, j, l * b + r AS place FROM walk WHERE {done}),
        places AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS place FROM meta WHERE label = 'Normal')"""


NORMALS = "SELECT count(*) FROM meta WHERE label = 'Normal'"


@query("X11_X12_unique_draws", f"""WITH {feistel_sql('3', 1600, NORMALS)}, sets AS (SELECT repeat_id, list_sort(list(place)) AS s FROM keyed GROUP BY 1), firsts AS (SELECT s, row_number() OVER (ORDER BY min(repeat_id)) - 1 AS repeat_id FROM sets GROUP BY 1)
    SELECT repeat_id, 'ref' AS role, sample FROM (SELECT repeat_id, unnest(s) AS place FROM firsts WHERE repeat_id < 50) JOIN places USING (place)""")
def x11(spark, sf):
    """Distinct random subsets of the normals; tested against their definition."""
    pool = C.meta(spark, sf).where("label = 'Normal'").select("sample")
    places, n = search.numbered(pool)
    return draws.distinct_draws(spark, n, 3, 50).join(places, "place").select("repeat_id", "role", "sample")


@query("X11_X13_keyed_draws", f"""WITH {feistel_sql('(n // 2) * 2', 1000, NORMALS)} SELECT repeat_id, CASE WHEN j < (SELECT k // 2 FROM size) THEN 'ref' ELSE 'ez' END AS role, sample FROM keyed JOIN places USING (place)""")
def x13k(spark, sf):
    """A thousand repeats of two disjoint halves, drawn on the executors by a keyed permutation."""
    places, n = search.numbered(C.meta(spark, sf).where("label = 'Normal'").select("sample"))
    return draws.of_pool(draws.keyed_draws(spark, n, {"ref": n // 2, "ez": n // 2}, 1000), places).select("repeat_id", "role", "sample")


SWEEP = """, rstats AS (SELECT repeat_id, chr, coalesce(avg(percentage), 0) AS m, stddev_pop(percentage) AS sd FROM fixedshares JOIN draws USING (sample) WHERE role = 'ref' GROUP BY ALL), rz AS (SELECT repeat_id, s.sample, s.chr, (s.percentage - m) / nullif(sd, 0) AS z FROM fixedshares s JOIN rstats USING (chr))"""
FIXED = "WITH fixedshares AS (SELECT sample, chr, percentage FROM shares WHERE threshold = 0.5::DOUBLE)"


def sweep(spark, sf):
    """(repeat_id, sample, chr, z) of all samples against each repeat's reference, in one job."""
    return search.repeated_scores(C.share_rows(spark, sf).where("threshold = 0.5D"), C.draws(spark, sf).where("role = 'ref'"), "percentage")


@query("X17_J24_signal_ratio", f"{FIXED}{SWEEP} SELECT sample, count(*) FILTER (f) AS n_abnormal, count(*) AS n_total FROM (SELECT repeat_id, sample, coalesce(max(z) > 3, false) AS f FROM rz GROUP BY ALL) GROUP BY 1")
def x17(spark, sf):
    """How often each sample is abnormal over repeats."""
    flags = evaluate.max_chr_flags(sweep(spark, sf), ["repeat_id"], [3.0], "z")
    return resample.signal_counts(flags, [])


EZSTATS = """, est AS (SELECT repeat_id, chr, coalesce(avg(z), 0) AS m, stddev_pop(z) AS sd FROM rz JOIN (SELECT repeat_id AS r, sample FROM draws WHERE role = 'ez') e ON e.r = rz.repeat_id AND e.sample = rz.sample GROUP BY ALL), rez AS (SELECT rz.repeat_id, rz.sample, rz.chr, (z - m) / nullif(sd, 0) AS ez FROM rz JOIN est ON est.repeat_id = rz.repeat_id AND est.chr = rz.chr)"""


@query("X18_ez_cutoff_grid", f"{FIXED}{SWEEP}{EZSTATS} SELECT sample, cutoff, count(*) FILTER (top > cutoff) AS n FROM (SELECT repeat_id, sample, max(ez) AS top FROM rez GROUP BY ALL), (SELECT unnest([2.0, 3.0, 4.5])::DOUBLE AS cutoff) GROUP BY ALL", "cutoff")
def x18(spark, sf):
    """Two references a repeat, flags at several cutoffs."""
    ez = search.repeated_ez(sweep(spark, sf), C.draws(spark, sf).where("role = 'ez'"), "z")
    return evaluate.max_chr_flags(ez, ["repeat_id"], [2.0, 3.0, 4.5], "ez").groupBy("sample", "cutoff").agg(F.count_if("flag").alias("n"))


@query("X36_per_chr_ratio", f"{FIXED}{SWEEP} SELECT sample, chr, count(*) FILTER (z > 3) / count(*) AS ratio FROM rz GROUP BY ALL", "ratio")
def x36(spark, sf):
    """The share of repeats in which a chromosome is abnormal."""
    return sweep(spark, sf).groupBy("sample", "chr").agg(S.ratio(F.count_if(F.col("z") > 3), F.count("*")).alias("ratio"))


@query("X39_expected_parameters", f"{FIXED}{SWEEP} SELECT chr, avg(m) AS mu, sqrt(avg(sd * sd) + var_pop(m)) AS sd FROM rstats GROUP BY 1", "mu sd")
def x39(spark, sf):
    """Expected reference parameters over repeats."""
    rows = C.share_rows(spark, sf).where("threshold = 0.5D").join(C.draws(spark, sf).where("role = 'ref'"), "sample")
    return resample.expected_parameters(rows.groupBy("repeat_id", "chr").agg(F.avg("percentage").alias("mu"), F.stddev_pop("percentage").alias("sd")))


@query("X21_parameter_bands", f"{FIXED}{SWEEP}{EZSTATS} SELECT chr, quantile_cont(m, 0.05) AS mu_p05, quantile_cont(m, 0.95) AS mu_p95, quantile_cont(sd, 0.5) AS sd_p50 FROM est GROUP BY 1", "mu_p05 mu_p95 sd_p50")
def x21(spark, sf):
    """Bands of the second reference's parameters over repeats."""
    rows = sweep(spark, sf).join(C.draws(spark, sf).where("role = 'ez'").select("repeat_id", "sample"), ["repeat_id", "sample"])
    stats = rows.groupBy("repeat_id", "chr").agg(F.coalesce(F.avg("z"), F.lit(0.0)).alias("mu"), F.stddev_pop("z").alias("sd"))
    return stats.groupBy("chr").agg(F.percentile("mu", 0.05).alias("mu_p05"), F.percentile("mu", 0.95).alias("mu_p95"), F.percentile("sd", 0.5).alias("sd_p50"))


MCC = "coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"


@query("X15_X16_X22_T9_repeat_mcc", f"""{FIXED}{SWEEP}{EZSTATS} SELECT *, {MCC} AS mcc FROM (SELECT repeat_id, count(*) FILTER (y AND t) AS tp, count(*) FILTER (y AND NOT t) AS fp, count(*) FILTER (NOT y AND t) AS fn, count(*) FILTER (NOT y AND NOT t) AS tn FROM (SELECT repeat_id, sample, label <> 'Normal' AS t, coalesce(max(ez) > 3, false) AND sample % 11 <> 0 AS y FROM rez JOIN meta USING (sample) GROUP BY repeat_id, sample, label) GROUP BY 1)""", "mcc")
def x22(spark, sf):
    """Confusion and MCC of every repeat; some samples are held normal."""
    ez = search.repeated_ez(sweep(spark, sf), C.draws(spark, sf).where("role = 'ez'"), "z")
    m = C.meta(spark, sf).select("sample", (F.col("label") != "Normal").alias("is_true"), (F.col("sample") % 11 == 0).alias("forced_normal"))
    return resample.best_repeat(ez.join(m, "sample"), 3.0)


@query("T9_X22_best_repeat", f"""{FIXED}{SWEEP}{EZSTATS} SELECT repeat_id FROM (SELECT repeat_id, count(*) FILTER (y AND t) AS tp, count(*) FILTER (y AND NOT t) AS fp, count(*) FILTER (NOT y AND t) AS fn, count(*) FILTER (NOT y AND NOT t) AS tn FROM (SELECT repeat_id, sample, label <> 'Normal' AS t, coalesce(max(ez) > 3, false) AS y FROM rez JOIN meta USING (sample) GROUP BY repeat_id, sample, label) GROUP BY 1) ORDER BY round({MCC}, 8) DESC, repeat_id LIMIT 1""")
def t9(spark, sf):
    """The first repeat of the largest MCC."""
    ez = search.repeated_ez(sweep(spark, sf), C.draws(spark, sf).where("role = 'ez'"), "z")
    m = C.meta(spark, sf).select("sample", (F.col("label") != "Normal").alias("is_true"), F.lit(False).alias("forced_normal"))
    return resample.best_repeat(ez.join(m, "sample"), 3.0).orderBy(F.round("mcc", 8).desc(), "repeat_id").limit(1).select("repeat_id")


def keyed_sql(repeats: int) -> str:
    """Views of a sweep over repeats of 3 and 3 normals by the keyed permutation: references, z against the first, ez against the second."""
    return f"""{feistel_sql("6", repeats, NORMALS)}, kd AS (SELECT repeat_id, CASE WHEN j < 3 THEN 'ref' ELSE 'ez' END AS role, sample FROM keyed JOIN places USING (place)),
    ks AS (SELECT sample, chr, percentage FROM shares WHERE threshold = 0.5::DOUBLE), kst AS (SELECT repeat_id, chr, coalesce(avg(percentage), 0) AS m, stddev_pop(percentage) AS sd FROM ks JOIN kd USING (sample) WHERE role = 'ref' GROUP BY ALL),
    kz AS (SELECT repeat_id, s.sample, s.chr, (s.percentage - m) / nullif(sd, 0) AS z FROM ks s JOIN kst USING (chr)),
    kest AS (SELECT kz.repeat_id, chr, coalesce(avg(z), 0) AS m, stddev_pop(z) AS sd FROM kz JOIN kd ON kd.repeat_id = kz.repeat_id AND kd.sample = kz.sample AND role = 'ez' GROUP BY ALL),
    kez AS (SELECT kz.repeat_id, kz.sample, kz.chr, (z - m) / nullif(sd, 0) AS ez FROM kz JOIN kest ON kest.repeat_id = kz.repeat_id AND kest.chr = kz.chr)"""


def block_sweep(spark, sf, repeats: int):
    """(packed shares with the truth, parameters of the first references and of the second) of many keyed repeats, written once."""
    m = C.meta(spark, sf).select("sample", (F.col("label") != "Normal").alias("is_true"), (F.col("sample") % 11 == 0).alias("forced_normal"), "label")
    places, n = search.numbered(m.where("label = 'Normal'").select("sample"))
    drawn = draws.of_pool(draws.keyed_draws(spark, n, {"ref": 3, "ez": 3}, repeats), places).select("repeat_id", "role", "sample")
    tracks = blocks.pack(C.share_rows(spark, sf).where("threshold = 0.5D"), ["percentage"], m)
    tracks = tracks._replace(rows=held(tracks.rows, "tracks"))
    first = held(blocks.parameters(tracks, drawn.where("role = 'ref'")), "first")
    return tracks, first, blocks.second_parameters(tracks, first, drawn.where("role = 'ez'"))


def held(rows, name):
    rows.write.parquet(path := scratch(rows.sparkSession, name))
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query("X16_block_repeat_mcc", f"""WITH RECURSIVE {keyed_sql(1000)} SELECT *, {MCC} AS mcc FROM (SELECT repeat_id, count(*) FILTER (y AND t) AS tp, count(*) FILTER (y AND NOT t) AS fp, count(*) FILTER (NOT y AND t) AS fn, count(*) FILTER (NOT y AND NOT t) AS tn FROM (SELECT repeat_id, sample, label <> 'Normal' AS t, coalesce(max(ez) > 3, false) AND sample % 11 <> 0 AS y FROM kez JOIN meta USING (sample) GROUP BY repeat_id, sample, label) GROUP BY 1)""", "mcc")
def x16b(spark, sf):
    """Confusion and MCC of a thousand repeats by block products."""
    tracks, first, second = block_sweep(spark, sf, 1000)
    return blocks.confusion(tracks, first, 3.0, second)


@query("X17_block_signal_ratio", f"""WITH RECURSIVE {keyed_sql(1000)} SELECT sample, cutoff, count(*) FILTER (top > cutoff) AS n_abnormal, count(*) AS n_total FROM (SELECT repeat_id, sample, coalesce(max(z), '-Infinity'::DOUBLE) AS top FROM kz GROUP BY ALL), (SELECT unnest([3.0, 4.5])::DOUBLE AS cutoff) GROUP BY ALL""", "cutoff")
def x17b(spark, sf):
    """How often each sample is abnormal over a thousand repeats, at two cutoffs."""
    tracks, first, _ = block_sweep(spark, sf, 1000)
    return blocks.signal_counts(tracks, first, [3.0, 4.5])


@query("X18_block_ez_cutoffs", f"""WITH RECURSIVE {keyed_sql(1000)} SELECT sample, cutoff, count(*) FILTER (top > cutoff) AS n_abnormal, count(*) AS n_total FROM (SELECT repeat_id, sample, coalesce(max(ez), '-Infinity'::DOUBLE) AS top FROM kez GROUP BY ALL), (SELECT unnest([2.0, 3.0, 4.5])::DOUBLE AS cutoff) GROUP BY ALL""", "cutoff")
def x18b(spark, sf):
    """Two references a repeat, flags at several cutoffs."""
    tracks, first, second = block_sweep(spark, sf, 1000)
    return blocks.signal_counts(tracks, first, [2.0, 3.0, 4.5], second)


@query("X36_block_per_chr_ratio", f"""WITH RECURSIVE {keyed_sql(1000)} SELECT sample, chr, count(*) FILTER (z > 3) / count(*) AS ratio FROM kz GROUP BY ALL""", "ratio")
def x36b(spark, sf):
    """The share of a thousand repeats in which a chromosome is abnormal."""
    tracks, first, _ = block_sweep(spark, sf, 1000)
    return blocks.chromosome_shares(tracks, first, 3.0)


@query("X19_pool_sizes", f"""{FIXED}, p AS (SELECT sample, row_number() OVER (ORDER BY (sample * 7919) % 1000003, sample) AS n FROM meta WHERE label = 'Normal'), st AS (SELECT size, chr, avg(percentage) AS m, stddev_pop(percentage) AS sd FROM fixedshares JOIN p USING (sample), (SELECT unnest([3, 5, 7]) AS size) WHERE n <= size GROUP BY ALL),
    t AS (SELECT size, s.sample, max((percentage - m) / nullif(sd, 0)) AS top FROM fixedshares s JOIN st USING (chr) GROUP BY ALL), l AS (SELECT t.*, label <> 'Normal' AS y FROM t JOIN meta USING (sample) WHERE top IS NOT NULL)
    SELECT size, (SELECT avg(CASE WHEN a.top > b.top THEN 1.0 WHEN a.top = b.top THEN 0.5 ELSE 0 END) FROM l a JOIN l b ON a.size = b.size AND a.y AND NOT b.y WHERE a.size = x.size) AS auc FROM (SELECT unnest([3, 5, 7]) AS size) x""", "auc")
def x19(spark, sf):
    """AUC by the size of nested pools."""
    return search.pool_sizes(C.share_rows(spark, sf).where("threshold = 0.5D"), C.meta(spark, sf), [3, 5, 7])


def greedy_sql(steps: int) -> str:
    """The same steps one after another, each with all pairs of a positive and a negative sample."""
    out = """WITH flags AS (SELECT sample, concat_ws('/', threshold, recall) AS part, (coalesce(max(episcore) > 1.5, false))::INT AS v FROM scores GROUP BY sample, threshold, recall), parts AS (SELECT DISTINCT part FROM flags),
    every AS (SELECT m.sample, m.label <> 'Normal' AS positive, p.part, coalesce(v, 0) AS v FROM meta m CROSS JOIN parts p LEFT JOIN flags f ON f.sample = m.sample AND f.part = p.part)"""
    for k in range(1, steps + 1):
        chosen = " UNION ALL ".join([f"SELECT part FROM pick{i}" for i in range(1, k)] or ["SELECT NULL::VARCHAR AS part WHERE false"])
        out += f""", chosen{k} AS ({chosen}), t{k} AS (SELECT e.sample, e.positive, e.part, e.v + coalesce(h, 0) AS s FROM every e LEFT JOIN (SELECT sample, sum(v) AS h FROM every WHERE part IN (SELECT part FROM chosen{k}) GROUP BY 1) USING (sample) WHERE e.part NOT IN (SELECT part FROM chosen{k})),
    pick{k} AS (SELECT a.part, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auc FROM t{k} a JOIN t{k} b ON a.part = b.part AND a.positive AND NOT b.positive GROUP BY 1 ORDER BY round(auc, 9) DESC, a.part LIMIT 1)"""
    return out + " " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS step, part, auc FROM pick{k}" for k in range(1, steps + 1))


@query("X24_greedy_pairs", greedy_sql(4), "auc")
def x24(spark, sf):
    """Greedy choice of combinations by AUC."""
    flags = evaluate.max_chr_flags(C.held_scores(spark, sf), C.COMBO, [C.CUTOFF], "episcore").withColumn("part", F.concat_ws("/", *C.COMBO))
    truth = C.meta(spark, sf).select("sample", (F.col("label") != "Normal").alias("positive"))
    return search.greedy_subset(flags.select("sample", "part", F.col("flag").cast("int").alias("value")), truth, 4)


@query("X25_greedy_shrink")
def x25(spark, sf):
    """Larger recalls chromosome by chromosome while MCC holds; tested against brute force."""
    held = C.held_scores(spark, sf)
    start = C.grid_metrics(spark, sf, held).groupBy("chr").agg(F.min_by(F.struct("threshold", "recall"), F.struct("recall", "threshold")).alias("c")).select("chr", "c.*")
    return search.greedy_shrink(C.grid_rows(spark, sf, held), start, C.CUTOFF)


def fixed_tracks(spark, sf):
    """Both z values, their site counts and the share of all samples at one combination, written once."""
    rows = C.episcore_rows(spark, sf).where("threshold = 0.5D and recall = 0.2D").join(C.share_rows(spark, sf), ["sample", "threshold", "chr"]).select("sample", "chr", *search.TRACKS, "hypo_n", "hyper_n")
    rows.write.parquet(path := scratch(spark, "tracks"))
    return spark.read.schema(rows.schema).parquet(path)


def _stats(source: str) -> str:
    return ", ".join(f"coalesce(avg({v}), 0) AS {v}_m, stddev_pop({v}) AS {v}_sd" for v in search.TRACKS) + f" FROM tracks JOIN {source} USING (sample)"


def _z(v: str) -> str:
    return f"(t.{v} - p.{v}_m) / nullif(p.{v}_sd, 0)"


AWAY = " + ".join(f"coalesce(((p.{v}_{k} - b.{v}_{k}) / CASE WHEN abs(b.{v}_sd) > 1e-8 THEN abs(b.{v}_sd) ELSE 1 END) ** 2, 0)" for v in search.TRACKS for k in ("m", "sd"))
CANDIDATES = f"""WITH tracks AS (SELECT e.sample, e.chr, hypo_z, hyper_z, hypo_n, hyper_n, percentage FROM eprows e JOIN shares s ON s.sample = e.sample AND s.chr = e.chr AND s.threshold = e.threshold WHERE e.threshold = 0.5::DOUBLE AND e.recall = 0.2::DOUBLE),
    own AS (SELECT repeat_id, sample FROM draws WHERE role = 'ref'), every AS (SELECT repeat_id, sample FROM own UNION ALL SELECT -1, sample FROM refs),
    params AS (SELECT repeat_id, chr, {_stats('every')} GROUP BY ALL),
    both_ AS (SELECT p.repeat_id, t.sample, t.chr, coalesce((({_z('hyper_z')}) * sqrt(hyper_n) - ({_z('hypo_z')}) * sqrt(hypo_n)) / nullif(sqrt(hyper_n + hypo_n), 0), 0) + {_z('percentage')} AS s FROM tracks t JOIN params p USING (chr)),
    ezp AS (SELECT repeat_id, chr, coalesce(avg(s), 0) AS m, stddev_pop(s) AS sd FROM both_ JOIN ezrefs USING (sample) GROUP BY ALL),
    calls_ AS (SELECT b.repeat_id, b.sample, b.chr, coalesce((s - m) / nullif(sd, 0) > 4.5, false) AS strong, coalesce((s - m) / nullif(sd, 0) BETWEEN 3 AND 4.5, false) AS gray FROM both_ b LEFT JOIN ezp USING (repeat_id, chr)),
    changed AS (SELECT c.repeat_id, c.sample, bool_or(c.strong <> b.strong OR c.gray <> b.gray) AS y FROM calls_ c JOIN calls_ b ON b.repeat_id = -1 AND b.sample = c.sample AND b.chr = c.chr
        WHERE c.repeat_id >= 0 AND c.sample NOT IN (SELECT sample FROM refs) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.repeat_id = c.repeat_id AND o.sample = c.sample) GROUP BY ALL),
    away AS (SELECT p.repeat_id, sum({AWAY}) AS distance FROM params p JOIN params b ON b.repeat_id = -1 AND b.chr = p.chr WHERE p.repeat_id >= 0 GROUP BY 1)
    SELECT repeat_id, coalesce(n_changed, 0) AS n_changed, coalesce(n_compared, 0) AS n_compared, distance FROM away LEFT JOIN (SELECT repeat_id, count(*) FILTER (y) AS n_changed, count(*) AS n_compared FROM changed GROUP BY 1) USING (repeat_id)"""


def early_reference(spark, sf):
    """The three dev normals that come first."""
    return C.reference(spark, sf).orderBy("sample").limit(3)


@query("X23_reference_candidates", CANDIDATES, "distance")
def x23c(spark, sf):
    """Changed calls and distance of each draw of a reference, all draws in one job."""
    return search.reference_candidates(fixed_tracks(spark, sf), C.draws(spark, sf).where("role = 'ref'"), C.reference(spark, sf), C.ez_reference(spark, sf))


REPEATED = f"""tracks AS (SELECT e.sample, e.chr, hypo_z, hyper_z, hypo_n, hyper_n, percentage FROM eprows e JOIN shares s ON s.sample = e.sample AND s.chr = e.chr AND s.threshold = e.threshold WHERE e.threshold = 0.5::DOUBLE AND e.recall = 0.2::DOUBLE),
    own AS (SELECT repeat_id, sample FROM draws WHERE role = 'ref'), params AS (SELECT repeat_id, chr, {_stats('own')} GROUP BY ALL),
    scored AS (SELECT p.repeat_id, t.sample, t.chr, coalesce((({_z('hyper_z')}) * sqrt(hyper_n) - ({_z('hypo_z')}) * sqrt(hypo_n)) / nullif(sqrt(hyper_n + hypo_n), 0), 0) AS e, {_z('percentage')} AS z FROM tracks t JOIN params p USING (chr)),
    ezp AS (SELECT s.repeat_id, s.chr, coalesce(avg(e + z) FILTER (d.sample IS NOT NULL), 0) AS ez_mean, stddev_pop(e + z) FILTER (d.sample IS NOT NULL) AS ez_sd FROM scored s LEFT JOIN (SELECT repeat_id, sample FROM draws WHERE role = 'ez') d ON d.repeat_id = s.repeat_id AND d.sample = s.sample GROUP BY ALL)"""
MATRICES = ", ".join(f"{v}_m AS {v}_mean, {v}_sd" for v in search.TRACKS)


@query("X15_reference_matrices", f"WITH {REPEATED} SELECT repeat_id, chr, {MATRICES}, ez_mean, ez_sd FROM params JOIN ezp USING (repeat_id, chr)", "hypo_z_mean hypo_z_sd hyper_z_mean hyper_z_sd percentage_mean percentage_sd ez_mean ez_sd")
def x15(spark, sf):
    """Every repeat's reference matrices."""
    draws = C.draws(spark, sf)
    return search.reference_matrices(fixed_tracks(spark, sf), draws.where("role = 'ref'"), draws.where("role = 'ez'"))


@query("X36_signal_variants", f"WITH {REPEATED} SELECT sample, chr, count(*) FILTER (e > 3) / count(*) AS episcore_ratio, count(*) FILTER (z > 3) / count(*) AS zscore_ratio, count(*) FILTER ((e + z - ez_mean) / nullif(ez_sd, 0) > 3) / count(*) AS ez_low_ratio, count(*) FILTER ((e + z - ez_mean) / nullif(ez_sd, 0) > 4.5) / count(*) AS ez_high_ratio FROM scored LEFT JOIN ezp USING (repeat_id, chr) GROUP BY ALL", "episcore_ratio zscore_ratio ez_low_ratio ez_high_ratio")
def x36v(spark, sf):
    """The share of repeats in which a chromosome is abnormal by each score, at one combination."""
    draws = C.draws(spark, sf)
    return search.signal_variants(fixed_tracks(spark, sf), draws.where("role = 'ref'"), draws.where("role = 'ez'"))


@query("X15_block_matrices", f"WITH {REPEATED} SELECT repeat_id, chr, {MATRICES}, ez_mean, ez_sd FROM params JOIN ezp USING (repeat_id, chr)", "hypo_z_mean hypo_z_sd hyper_z_mean hyper_z_sd percentage_mean percentage_sd ez_mean ez_sd")
def x15b(spark, sf):
    """Every repeat's reference matrices, by block products over all tracks."""
    drawn = C.draws(spark, sf)
    tracks = blocks.pack(fixed_tracks(spark, sf), search.TRACKS)
    tracks = tracks._replace(rows=held(tracks.rows, "tracks"))
    first = held(blocks.parameters(tracks, drawn.where("role = 'ref'")), "first")
    return blocks.matrices(tracks, first, blocks.second_parameters(tracks, first, drawn.where("role = 'ez'")))


@query("X23_stable_reference")
def x23(spark, sf):
    """A reference by seeds, draws and swaps; tested on a small fixture, its figures by the query above."""
    normals = C.meta(spark, sf).where("label = 'Normal'").select("sample")
    return search.stable_reference(fixed_tracks(spark, sf), early_reference(spark, sf), normals, C.ez_reference(spark, sf), 4, n_random=100, swaps=40)


EZ_SIZE = "least(20, greatest(3, n // 4))"


@query("X22_reference_search", f"""WITH RECURSIVE {feistel_sql(EZ_SIZE, 5000, NORMALS)}, own AS (SELECT repeat_id, sample FROM keyed JOIN places USING (place)),
    sums AS (SELECT sample, chr, episcore, zscore, episcore + zscore AS s FROM fixed),
    stats AS (SELECT repeat_id, chr, coalesce(avg(s), 0) AS m, stddev_pop(s) AS sd FROM sums JOIN own USING (sample) GROUP BY ALL),
    truth AS (SELECT sample, regexp_matches(label, '^T\\d') AS t, label = 'T15' AND ff_before_mq < 0.01 OR f AS forced FROM meta JOIN (SELECT sample, NOT bool_or(coalesce(episcore > 3, false) OR coalesce(zscore > 3, false)) AS f FROM fixed GROUP BY 1) USING (sample)),
    called AS (SELECT repeat_id, sample, t, coalesce(max((s - m) / nullif(sd, 0)) > 3, false) AND NOT forced AS y FROM sums JOIN stats USING (chr) JOIN truth USING (sample) GROUP BY repeat_id, sample, t, forced),
    n AS (SELECT repeat_id, count(*) FILTER (y AND t) AS tp, count(*) FILTER (y AND NOT t) AS fp, count(*) FILTER (NOT y AND t) AS fn, count(*) FILTER (NOT y AND NOT t) AS tn FROM called GROUP BY 1),
    best AS (SELECT repeat_id, {MCC} AS mcc FROM n ORDER BY round({MCC}, 9) DESC, repeat_id LIMIT 1)
    SELECT sample, repeat_id, mcc FROM own JOIN best USING (repeat_id)""", "mcc")
def x22s(spark, sf):
    """The best of 5,000 random references of up to 20 for the combined score; samples whose own scores call nothing stay normal."""
    rows = C.held_scores(spark, sf).where("threshold = 0.5D and recall = 0.2D")
    m = C.meta(spark, sf)
    both = search.called_normal(rows, ["episcore", "zscore"])
    weak = (F.col("label") == "T15") & (F.col("ff_before_mq") < 0.01)
    truth = m.join(both, "sample").select("sample", S.is_trisomy(F.col("label")).alias("is_true"), (weak | F.col("normal")).alias("forced_normal"))
    normals = m.where("label = 'Normal'")
    size = min(20, max(3, normals.count() // 4))
    return search.ez_reference_search(rows.select("sample", "chr", (F.col("episcore") + F.col("zscore")).alias("score")), normals, truth, size, repeats=5000)


SUBSETS = "SELECT row_number() OVER (ORDER BY a.r_regionkey, b.r_regionkey, c.r_regionkey) - 1 AS repeat_id, a.r_regionkey AS x, b.r_regionkey AS y, c.r_regionkey AS z FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey JOIN region c ON b.r_regionkey < c.r_regionkey"


@query("X12_all_subsets", f"SELECT repeat_id, 'ref' AS role, unnest([x, y, z])::BIGINT AS sample FROM ({SUBSETS})")
def x12(spark, sf):
    """All subsets, where there are no more than asked for."""
    pool = [r["r_regionkey"] for r in C.table(spark, sf, "region").select("r_regionkey").collect()]  # a dimension of five rows
    return resample.unique_draws(spark, pool, 3, 50)


STATUS = """SELECT sample, CASE WHEN label = 'T15' AND ff_before_mq < 0.01 THEN 'FN' WHEN regexp_matches(label, '^T\\d') AND above THEN 'TP' WHEN regexp_matches(label, '^T\\d') AND below THEN 'FN' WHEN lower(label) = 'normal' AND below THEN 'TN' WHEN lower(label) = 'normal' AND above THEN 'FP' ELSE 'UNK' END AS match_status
    FROM (SELECT sample, bool_and(coalesce(zscore < 3, false)) AS below, bool_or(coalesce(zscore > 3, false)) AS above FROM fixed GROUP BY 1) JOIN meta USING (sample)"""


@query("X30_pred_label", f"""SELECT sample, coalesce(string_agg(CASE WHEN zscore > 4.5 THEN 'T' ELSE 'Gray_T' END || replace(chr, 'chr', ''), ',' ORDER BY zscore <= 4.5, replace(chr, 'chr', '')::INT) FILTER (zscore > 3), 'Normal') AS pred_label, any_value(match_status) AS match_status FROM fixed JOIN ({STATUS}) USING (sample) GROUP BY 1""")
def x30(spark, sf):
    """Call labels, strong before gray, and how they match."""
    rows = C.fixed_combo_scores(spark, sf)
    return evaluate.pred_label(rows, "zscore").join(evaluate.match_status(rows, C.meta(spark, sf), "zscore"), "sample")


@query("X37_batch_collapse", """WITH b AS (SELECT sample, insert_size % 5 AS batch, count(*) AS n, avg(price) AS q FROM reads GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n_batches, n / sum(n) OVER (PARTITION BY sample) AS share FROM b)
    SELECT sample, batch, n_batches, share, q FROM k WHERE q >= 20000 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY n DESC, batch) = 1""", "share q")
def x37(spark, sf):
    """The best batch of each sample after noisy ones are dropped."""
    from pyspark.sql.window import Window

    from cohortlens.operators import meta_etl

    b = C.reads(spark, sf).groupBy("sample", (F.col("insert_size") % 5).alias("batch")).agg(F.count("*").alias("n"), F.avg("price").alias("q"))
    over = Window.partitionBy("sample")
    k = b.withColumn("n_batches", F.count("*").over(over)).withColumn("share", F.col("n") / F.sum("n").over(over)).where("q >= 20000")
    return meta_etl.first_by(k, ["sample"], [F.col("n").desc(), F.col("batch")]).select("sample", "batch", "n_batches", "share", "q")


def left_out_sql(rest: str) -> str:
    """Scores with parameters of what ``rest`` (a template of a value) leaves in."""
    def z(v: str) -> str:
        n, s, q = (rest.format(v=e) for e in (f"({v} IS NOT NULL)::INT", f"coalesce({v}, 0)", f"coalesce({v} * {v}, 0)"))
        return f"({v} - coalesce({s} / nullif({n}, 0), 0)) / nullif(sqrt(greatest({q} / nullif({n}, 0) - ({s} / nullif({n}, 0)) ** 2, 0)), 0)"
    rows = """SELECT e.sample, e.chr, hypo_z, hyper_z, hypo_n, hyper_n, percentage, fold FROM eprows e JOIN shares s ON s.sample = e.sample AND s.chr = e.chr AND s.threshold = e.threshold
        JOIN (SELECT sample, ntile(4) OVER (ORDER BY sample) - 1 AS fold FROM refs) f ON f.sample = e.sample WHERE e.threshold = 0.5::DOUBLE AND e.recall = 0.2::DOUBLE"""
    return f"""SELECT sample, chr, coalesce((b * sqrt(hyper_n) - a * sqrt(hypo_n)) / nullif(sqrt(hyper_n + hypo_n), 0), 0) + c AS score FROM (SELECT sample, chr, hypo_n, hyper_n, {z('hypo_z')} AS a, {z('hyper_z')} AS b, {z('percentage')} AS c FROM ({rows}))"""


def tracks(spark, sf):
    rows = C.episcore_rows(spark, sf).where("threshold = 0.5D and recall = 0.2D").join(C.share_rows(spark, sf), ["sample", "threshold", "chr"])
    return rows.join(resample.fold_ids(C.reference(spark, sf), [], ["sample"], 4), "sample")


@query("X20_loo_scores", left_out_sql("(sum({v}) OVER (PARTITION BY chr) - {v})"), "score")
def x20(spark, sf):
    """Scores of the reference's own samples, each against the others."""
    return resample.left_out_scores(tracks(spark, sf))


@query("X20_fold_scores", left_out_sql("(sum({v}) OVER (PARTITION BY chr) - sum({v}) OVER (PARTITION BY chr, fold))"), "score")
def x20b(spark, sf):
    """Scores of the reference's own samples, each against the other folds."""
    return resample.left_out_scores(tracks(spark, sf), "fold")
