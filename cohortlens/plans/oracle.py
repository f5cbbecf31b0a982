"""The same views and scores as common table expressions of DuckDB, written apart from the operators."""

from __future__ import annotations

import re

VIEWS = {
    "reads": """SELECT l_suppkey AS sample, concat(l_orderkey, '-', l_linenumber) AS name, concat('chr', 1 + l_partkey % 22) AS chr, l_partkey * 10 AS start,
        l_partkey * 10 + CAST(l_quantity AS INT) AS "end", l_returnflag AS text, round(l_discount * 10, 1) AS prob_class_1, CAST(l_linenumber AS DOUBLE) AS mTcount,
        CAST(100 + 2 * l_quantity AS BIGINT) AS insert_size, l_linestatus AS status, l_partkey AS part, l_extendedprice AS price FROM lineitem""",
    "cpgs": """SELECT concat('chr', 1 + p_partkey % 22) AS chr, p_partkey * 10 AS start, p_partkey * 10 + 1 AS "end", p_size - 25 AS meandiff,
        (p_partkey * 37 % 100) / 100 AS recall, p_partkey AS part, p_size AS size FROM part""",
    "probes": """SELECT chr, start, start + size * 2 AS "end" FROM cpgs WHERE part % 10 = 0""",
    "meta": """SELECT s_suppkey AS sample, CASE WHEN s_suppkey % 2 = 0 THEN 'dev' ELSE 'test' END AS set, CASE WHEN s_suppkey % 5 <> 0 THEN 'Normal' ELSE concat('T', 1 + s_suppkey % 22) END AS label,
        (s_suppkey % 30) * 0.005::DOUBLE AS ff_before_mq, s_acctbal AS balance FROM supplier""",
    "snps": """SELECT r.part, chr, n_ref, n_alt, model_ref, model_alt, round(0.05::DOUBLE + 0.018::DOUBLE * p_size, 3) AS af, r.part AS pos FROM (
        SELECT chr, part, count(*) FILTER (text IN ('R', 'N')) AS n_ref, count(*) FILTER (text = 'A') AS n_alt, count(*) FILTER (text IN ('R', 'N') AND prob_class_1 >= 0.5) AS model_ref,
        count(*) FILTER (text = 'A' AND prob_class_1 >= 0.5) AS model_alt FROM reads GROUP BY ALL) r JOIN part ON p_partkey = r.part""",
    "thr": "SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold",
    "rec": "SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS recall",
    "chrs": "SELECT concat('chr', i) AS chr FROM range(1, 23) t(i)",
    "calls": """SELECT sample, threshold, chr, start, count(*) FILTER (status = 'O') AS meth, count(*) FILTER (status = 'F') AS unmeth
        FROM reads JOIN thr ON prob_class_1 >= threshold GROUP BY ALL""",
    "levels": """SELECT sample, threshold, k.recall, c.chr, CASE WHEN meandiff < 0 THEN 'hypo' ELSE 'hyper' END AS direction, sum(meth) AS meth, sum(unmeth) AS unmeth, count(*) AS n_cpgs,
        sum(meth) / nullif(sum(meth) + sum(unmeth), 0) AS beta FROM calls c JOIN cpgs p ON c.chr = p.chr AND c.start = p.start JOIN rec k ON p.recall >= k.recall WHERE meandiff <> 0 GROUP BY ALL""",
    "zintra": """SELECT *, (beta - avg(beta) OVER w) / nullif(stddev_pop(beta) OVER w, 0) AS z_intra FROM levels WINDOW w AS (PARTITION BY sample, threshold, recall, direction)""",
    "eprows": """SELECT sample, threshold, recall, chr, max(z_intra) FILTER (direction = 'hypo') AS hypo_z, max(z_intra) FILTER (direction = 'hyper') AS hyper_z,
        coalesce(max(n_cpgs) FILTER (direction = 'hypo'), 0) AS hypo_n, coalesce(max(n_cpgs) FILTER (direction = 'hyper'), 0) AS hyper_n FROM zintra GROUP BY ALL""",
    "refs": "SELECT sample FROM meta WHERE set = 'dev' AND label = 'Normal'",
    "ezrefs": "SELECT sample FROM meta WHERE set = 'test' AND label = 'Normal'",
    "epstats": """SELECT threshold, recall, chr, coalesce(avg(hypo_z), 0) AS hypo_z_mean, stddev_pop(hypo_z) AS hypo_z_sd, coalesce(avg(hyper_z), 0) AS hyper_z_mean, stddev_pop(hyper_z) AS hyper_z_sd
        FROM eprows JOIN refs USING (sample) GROUP BY ALL""",
    "episcores": """SELECT sample, threshold, recall, chr, coalesce(((hyper_z - hyper_z_mean) / nullif(hyper_z_sd, 0) * sqrt(hyper_n) - (hypo_z - hypo_z_mean) / nullif(hypo_z_sd, 0) * sqrt(hypo_n))
        / nullif(sqrt(hyper_n + hypo_n), 0), 0) AS episcore FROM eprows LEFT JOIN epstats USING (threshold, recall, chr)""",
    "shares": """SELECT sample, threshold, chr, count(*) AS n_reads, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY sample, threshold) AS percentage
        FROM reads JOIN thr ON prob_class_1 >= threshold GROUP BY sample, threshold, chr""",
    "zstats": """SELECT threshold, chr, coalesce(avg(percentage), 0) AS percentage_mean, stddev_pop(percentage) AS percentage_sd FROM shares JOIN refs USING (sample) GROUP BY ALL""",
    "zscores": """SELECT sample, threshold, chr, n_reads, percentage, (percentage - percentage_mean) / nullif(percentage_sd, 0) AS zscore FROM shares LEFT JOIN zstats USING (threshold, chr)""",
    "scores": """SELECT sample, threshold, recall, chr, episcore, zscore FROM episcores JOIN zscores USING (sample, threshold, chr)""",
    "ezstats": """SELECT threshold, recall, chr, coalesce(avg(episcore + zscore), 0) AS ez_mean, stddev_pop(episcore + zscore) AS ez_sd FROM scores JOIN ezrefs USING (sample) GROUP BY ALL""",
    "ez": """SELECT scores.*, (episcore + zscore - ez_mean) / nullif(ez_sd, 0) AS ezscore FROM scores LEFT JOIN ezstats USING (threshold, recall, chr)""",
    "gridrows": """SELECT scores.*, episcore AS score, label, label = 'Normal' AS is_normal FROM scores JOIN meta USING (sample) WHERE set = 'dev'""",
    "roles": """SELECT *, label = replace(chr, 'chr', 'T') AS is_target FROM gridrows WHERE is_normal OR label = replace(chr, 'chr', 'T')""",
    "counts": """SELECT chr, threshold, recall, count(*) FILTER (score > 1.5 AND is_target) AS tp, count(*) FILTER (score > 1.5 AND is_normal) AS fp,
        count(*) FILTER (score <= 1.5 AND is_target) AS fn, count(*) FILTER (score <= 1.5 AND is_normal) AS tn,
        min(score) FILTER (score > 1.5 AND is_target) - max(score) FILTER (score <= 1.5 AND is_normal) AS sep_score,
        count(*) FILTER (abs(score) > 1.5 AND is_normal) AS fp_ext, var_pop(score) FILTER (is_normal) AS normal_var FROM roles GROUP BY ALL""",
    "metrics": """SELECT *, coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM counts""",
    "fixed": "SELECT * FROM scores WHERE threshold = 0.5::DOUBLE AND recall = 0.2::DOUBLE",
    "draws": """SELECT repeat_id, sample, CASE WHEN r <= 3 THEN 'ref' ELSE 'ez' END AS role FROM (SELECT repeat_id, sample,
        row_number() OVER (PARTITION BY repeat_id ORDER BY (sample * 7919 + (repeat_id + 1) * 104729) % 1000003, sample) AS r
        FROM meta, range(20) t(repeat_id) WHERE label = 'Normal') WHERE r <= 6""",
    "labelled": """SELECT sample, chr, episcore + zscore AS score, regexp_matches(label, '^T\\d') AS positive, label, set, ff_before_mq FROM fixed JOIN meta USING (sample)""",
}


def sql(query: str) -> str:
    """``query`` with the views that it needs, and those that they need, before it."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                need(VIEWS[name])
                wanted.append(name)

    need(query)
    views = [f"{n} AS ({VIEWS[n]})" for n in wanted]
    if query.lstrip().upper().startswith("WITH "):  # its own views come after those it needs
        return f"WITH RECURSIVE {', '.join([*views, query.lstrip()[5:]])}"
    return f"WITH RECURSIVE {', '.join(views)} {query}" if views else query
