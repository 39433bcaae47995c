"""DuckDB SQL for the queries of queries.py, from shared common table expressions."""

from __future__ import annotations

from bandgraph.functions.vectors import LOW, high

TAPS = "taps(m, h, g) AS (VALUES " + ", ".join(f"({m}, {h!r}::DOUBLE / sqrt(2), {g!r}::DOUBLE / sqrt(2))" for m, (h, g) in enumerate(zip(LOW["sym2"], high("sym2"), strict=True))) + ")"
HALF = len(LOW["sym2"]) // 2

#: In order; each may use those before it.
CTES = {
    "panel": "panel AS (SELECT l_suppkey AS entity, date_trunc('week', l_shipdate)::TIMESTAMP AS t, sum(l_extendedprice) / sum(l_quantity) AS px FROM lineitem GROUP BY 1, 2)",
    "grid": "grid AS (SELECT e.entity, d.t, p.px FROM (SELECT DISTINCT entity FROM panel) e CROSS JOIN (SELECT DISTINCT t FROM panel) d LEFT JOIN panel p ON p.entity = e.entity AND p.t = d.t)",
    "locf": "locf AS (SELECT entity, t, last_value(px IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM grid)",
    "lr": "lr AS (SELECT entity, t, ln(filled) - lag(ln(filled)) OVER (PARTITION BY entity ORDER BY t) AS r FROM locf)",
    "ret": "ret AS (SELECT entity, t, coalesce(r, 0) AS r FROM lr WHERE t IN (SELECT t FROM lr GROUP BY t HAVING count(r) > 0) AND entity IN (SELECT entity FROM lr GROUP BY entity HAVING count(r) > 0))",
    "low": "low AS (SELECT entity, t, greatest(r, quantile_cont(r, 0.03) OVER (PARTITION BY entity)) AS r FROM ret)",
    "win": "win AS (SELECT entity, t, least(r, quantile_cont(r, 0.97) OVER (PARTITION BY entity)) AS r FROM low)",
    "z": "z AS (SELECT entity, t, (r - avg(r) OVER p) / coalesce(nullif(stddev_samp(r) OVER p, 0), 1e-8) AS r FROM win WINDOW p AS (PARTITION BY entity))",
    "ind": "ind AS (SELECT s_suppkey AS entity, s_nationkey::VARCHAR AS nation, n_regionkey::VARCHAR AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "loo": "loo AS (SELECT entity, t, r, (sum(r) OVER (PARTITION BY t) - r) / (count(*) OVER (PARTITION BY t) - 1) AS f FROM win)",
    "fit": "fit AS (SELECT entity, t, r, f, regr_slope(r, f) OVER p AS beta, regr_intercept(r, f) OVER p AS alpha FROM loo WINDOW p AS (PARTITION BY entity))",
    "res": "res AS (SELECT entity, t, r, f, alpha, beta, r - alpha - beta * f AS e FROM fit)",
    "mz": "mz AS (SELECT entity, t, (e - avg(e) OVER p) / coalesce(nullif(stddev_samp(e) OVER p, 0), 1e-8) AS r FROM res WINDOW p AS (PARTITION BY entity))",
    "taps": TAPS,
    "a0": "a0 AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY entity) AS n, r AS x FROM z)",
    "l1": f"l1 AS (SELECT a.entity, a.k, a.n, sum(h * b.x) AS x, sum(g * b.x) AS d FROM a0 a CROSS JOIN taps JOIN a0 b ON b.entity = a.entity AND b.k = (a.k + {HALF} - m + a.n) % a.n GROUP BY ALL)",
    "l2": f"l2 AS (SELECT a.entity, a.k, a.n, sum(h * b.x) AS x, sum(g * b.x) AS d FROM l1 a CROSS JOIN taps JOIN l1 b ON b.entity = a.entity AND b.k = (a.k + {2 * HALF} - 2 * m + a.n) % a.n GROUP BY ALL)",
    "bands": "bands AS (SELECT entity, 0 AS band, k, x FROM l2 UNION ALL SELECT entity, 1, k, d FROM l2 UNION ALL SELECT entity, 2, k, d FROM l1)",
    "unit": "unit AS (SELECT entity, band, k, x / coalesce(nullif(sqrt(sum(x * x) OVER (PARTITION BY entity, band)), 0), 1) AS v FROM bands)",
    "sim": "sim AS (SELECT a.entity AS i, b.entity AS j, a.band, round(sum(a.v * b.v), 9) AS s FROM unit a JOIN unit b ON a.band = b.band AND a.k = b.k AND a.entity < b.entity GROUP BY 1, 2, 3)",
    "wide": "wide AS (SELECT i, j, max(s) FILTER (band = 0) AS s0, max(s) FILTER (band = 1) AS s1, max(s) FILTER (band = 2) AS s2 FROM sim GROUP BY 1, 2)",
    "tau": "tau AS (SELECT greatest(quantile_cont(s, 0.9), 0) AS tau FROM (SELECT s FROM sim UNION ALL SELECT s FROM sim UNION ALL SELECT 0 FROM (SELECT DISTINCT entity, band FROM bands)))",
    "adj": "adj AS (SELECT i, j, greatest(CASE WHEN s1 > tau THEN 2.5 * sqrt(s0 * s1) END, CASE WHEN s2 > tau THEN 4.0 * sqrt(s0 * s2) END) AS w FROM wide, tau WHERE s0 > tau AND (s1 > tau OR s2 > tau))",
    "dense": "dense AS (SELECT i, j, greatest(2.5 * sqrt(greatest(s0, 0) * greatest(s1, 0)), 4.0 * sqrt(greatest(s0, 0) * greatest(s2, 0))) AS w FROM wide)",
    "terms": "terms AS (SELECT i, j, sqrt(greatest(s0, 0) * greatest(s1, 0)) + 1.25 * sqrt(greatest(-s0, 0) * greatest(-s1, 0)) AS x1, sqrt(greatest(s0, 0) * greatest(s2, 0)) + 1.25 * sqrt(greatest(-s0, 0) * greatest(-s2, 0)) AS x2 FROM wide)",
    "uni": "uni AS (SELECT n_nationkey, n_name, s_suppkey::VARCHAR AS sup FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 10 = 0 THEN [s_nationkey, (s_nationkey + 1) % 25] ELSE [s_nationkey] END) AS k FROM supplier) JOIN nation ON k = n_nationkey)",
    "lab": "lab AS (SELECT lpad(sup, greatest(6, length(sup))::INT, '0') AS entity, count(DISTINCT n_name) > 1 AS is_conflict, list_sort(list(DISTINCT n_name)) AS names, list_sort(list(DISTINCT 'U_SW1_' || n_nationkey)) AS ids FROM uni GROUP BY 1)",
    "asg": "asg AS (SELECT s_suppkey AS entity, ((floor(s_acctbal / 1000)::BIGINT % 5 + 5) % 5)::VARCHAR AS cluster_id FROM supplier)",
    "tab": "tab AS (SELECT region AS label, cluster_id, count(*) AS n FROM asg JOIN ind USING (entity) GROUP BY 1, 2)",
    "pairs": "pairs AS (SELECT n, sum(n) OVER (PARTITION BY label) AS a, sum(n) OVER (PARTITION BY cluster_id) AS b, sum(n) OVER () AS t, label, cluster_id FROM tab)",
    "agree": """agree AS (SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, t::BIGINT AS n, n_labels, n_clusters FROM (
      SELECT max(t)::DOUBLE AS t, sum(n * (n - 1) / 2.0)::DOUBLE AS s, sum(n * (a - 1) / 2.0)::DOUBLE AS sa, sum(n * (b - 1) / 2.0)::DOUBLE AS sb, sum(n::DOUBLE / t * ln(t::DOUBLE * n / (a * b))) AS mi,
        -sum(n::DOUBLE / t * ln(a::DOUBLE / t)) AS ha, -sum(n::DOUBLE / t * ln(b::DOUBLE / t)) AS hb, count(DISTINCT label) AS n_labels, count(DISTINCT cluster_id) AS n_clusters FROM pairs))""",
    "ranked": "ranked AS (SELECT i, j, band, rank() OVER (PARTITION BY band ORDER BY s) + (count(*) OVER (PARTITION BY band, s) - 1) / 2.0 AS rk, floor((row_number() OVER (PARTITION BY band ORDER BY s, i, j) - 1) * 16 / count(*) OVER (PARTITION BY band)) AS bin FROM sim)",
    "two": "two AS (SELECT a.band AS l, b.band AS r, a.rk AS x, b.rk AS y, a.bin AS p, b.bin AS q FROM ranked a JOIN ranked b ON a.i = b.i AND a.j = b.j AND a.band <= b.band)",
    "joint": "joint AS (SELECT l, r, p, q, n::DOUBLE AS n, sum(n) OVER (PARTITION BY l, r)::DOUBLE AS t, sum(n) OVER (PARTITION BY l, r, p)::DOUBLE AS a, sum(n) OVER (PARTITION BY l, r, q)::DOUBLE AS b FROM (SELECT l, r, p, q, count(*) AS n FROM two GROUP BY ALL))",
    "info": "info AS (SELECT l, r, sum(n / t * ln(t * n / (a * b))) AS mi, -sum(n / t * ln(a / t)) AS ha, -sum(n / t * ln(b / t)) AS hb FROM joint GROUP BY 1, 2)",
    "flow": "flow AS (SELECT row, col, p / sum(p) OVER (PARTITION BY col) AS p FROM (SELECT i AS row, j AS col, round(w, 6) AS p FROM adj UNION ALL SELECT j, i, round(w, 6) FROM adj UNION ALL SELECT s_suppkey, s_suppkey, 1.0 FROM supplier))",
    "step": "step AS (SELECT row, col, p / sum(p) OVER (PARTITION BY col) AS p FROM (SELECT a.row, b.col, pow(sum(a.p * b.p), 1.8) AS p FROM flow a JOIN flow b ON a.col = b.row GROUP BY 1, 2))",
    "rband": "rband AS (SELECT entity, band, k, rank() OVER (PARTITION BY entity, band ORDER BY x) + (count(*) OVER (PARTITION BY entity, band, x) - 1) / 2.0 AS x FROM bands)",
    "rcent": "rcent AS (SELECT entity, band, k, x - avg(x) OVER (PARTITION BY entity, band) AS x FROM rband)",
    "runit": "runit AS (SELECT entity, band, k, x / coalesce(nullif(sqrt(sum(x * x) OVER (PARTITION BY entity, band)), 0), 1) AS v FROM rcent)",
    "rsim": "rsim AS (SELECT a.entity AS i, b.entity AS j, a.band, round(sum(a.v * b.v), 9) AS s FROM runit a JOIN runit b ON a.band = b.band AND a.k = b.k AND a.entity < b.entity GROUP BY 1, 2, 3)",
    **{f"m{n}": f"m{n} AS (SELECT row, col, round(p, 9) + 0.0 AS p FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY p DESC, row) AS k FROM (SELECT row, col, p / sum(p) OVER (PARTITION BY col) AS p FROM (SELECT a.row, b.col, pow(sum(a.p * b.p), 1.8) AS p FROM {before} a JOIN {before} b ON a.col = b.row GROUP BY 1, 2))) WHERE p >= 1e-3 OR k = 1)" for n, before in ((1, "flow"), (2, "m1"), (3, "m2"))},
    "emb": "emb AS (SELECT vec_id, label::VARCHAR AS label, k, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS v FROM (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings))",
    "elink": "elink AS (SELECT a.vec_id AS i, b.vec_id AS j FROM emb a JOIN emb b ON a.k = b.k AND a.vec_id < b.vec_id GROUP BY 1, 2 HAVING sum(a.v * b.v) > 0.6)",
    "trend": "trend AS (SELECT l_returnflag AS operator, l_linenumber AS level, round(avg(l_discount), 9) AS ari FROM lineitem WHERE l_linenumber BETWEEN 2 AND 6 GROUP BY 1, 2)",
}
#: What each expression uses.
USES = {
    "grid": "panel", "locf": "grid", "lr": "locf", "ret": "lr", "low": "ret", "win": "low", "z": "win", "loo": "win", "fit": "loo", "res": "fit", "mz": "res", "a0": "z", "l1": "a0 taps", "l2": "l1", "bands": "l2",
    "unit": "bands", "sim": "unit", "wide": "sim", "tau": "sim", "adj": "wide tau", "dense": "wide", "terms": "wide", "lab": "uni", "tab": "asg ind", "pairs": "tab", "agree": "pairs", "ranked": "sim", "two": "ranked",
    "joint": "two", "rband": "bands", "rcent": "rband", "runit": "rcent", "rsim": "runit", "m1": "flow", "m2": "m1", "m3": "m2", "elink": "emb", "info": "joint", "flow": "adj", "step": "flow",
}


def sql(uses: str, final: str, recursive: str = "") -> str:
    """final with every common table expression that it needs, those of several uses stored."""
    need, todo = set(), uses.split()
    while todo:
        c = todo.pop()
        if c not in need:
            need.add(c)
            todo += USES.get(c, "").split()
    parts = [t.replace(" AS (", " AS MATERIALIZED (", 1) if c in ("sim", "z", "win", "l1", "unit", "rsim", "runit", "m1", "m2", "emb", "elink") else t for c, t in CTES.items() if c in need]
    parts += [recursive] if recursive else []
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else "") + final


def _r(columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns.split())


ROWS = "SELECT entity, t, round(r, 6) + 0.0 AS r FROM "
DEMEAN = "(SELECT x.entity, t, r - avg(r) OVER (PARTITION BY t, region) AS r FROM {} x JOIN ind ON ind.entity = x.entity)"
ORACLE = {
    "panel_week": sql("panel", "SELECT entity, t, round(px, 9) + 0.0 AS px FROM panel"),
    "panel_locf": sql("locf", "SELECT entity, t, round(filled, 9) + 0.0 AS filled FROM locf"),
    "log_returns": sql("ret", ROWS + "ret"),
    "winsorize": sql("win", ROWS + "win"),
    "zscore_returns": sql("z", ROWS + "z"),
    "eligibility": sql("grid", """SELECT entity, round(count(px) / count(*)::DOUBLE, 6) + 0.0 AS coverage, round(CASE WHEN count(*) FILTER (px IS NOT NULL AND b IS NOT NULL) = 0 THEN 1.0
      ELSE count(*) FILTER (abs(px - b) <= 1e-12) / count(*) FILTER (px IS NOT NULL AND b IS NOT NULL)::DOUBLE END, 6) + 0.0 AS flat_rate FROM (SELECT *, lag(px) OVER (PARTITION BY entity ORDER BY t) AS b FROM grid) GROUP BY 1"""),
    "eligibility_stats": sql("grid", """SELECT count(*) AS n_entities, count(*) FILTER (ok) AS n_selected, round(median(c), 6) + 0.0 AS median_coverage, round(median(f), 6) + 0.0 AS median_flat_rate, round(min(c) FILTER (ok), 6) + 0.0 AS min_coverage,
      round(max(c) FILTER (ok), 6) + 0.0 AS max_coverage, round(min(f) FILTER (ok), 6) + 0.0 AS min_flat_rate, round(max(f) FILTER (ok), 6) + 0.0 AS max_flat_rate FROM (SELECT *, c >= 0.8 AND f <= 0.05 AS ok FROM (
      SELECT entity, count(px) / count(*)::DOUBLE AS c, CASE WHEN count(*) FILTER (px IS NOT NULL AND b IS NOT NULL) = 0 THEN 1.0 ELSE count(*) FILTER (abs(px - b) <= 1e-12) / count(*) FILTER (px IS NOT NULL AND b IS NOT NULL)::DOUBLE END AS f
      FROM (SELECT *, lag(px) OVER (PARTITION BY entity ORDER BY t) AS b FROM grid) GROUP BY 1))"""),
    "trade_calendar": "SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS t FROM orders",
    "calendar_aligned": sql("panel", """SELECT entity, t, round(px, 9) + 0.0 AS px FROM (SELECT entity, t, last_value(px IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM (
      SELECT e.entity, d.t, p.px FROM (SELECT entity, min(t) AS a, max(t) AS b FROM panel GROUP BY 1) e JOIN (SELECT DISTINCT t FROM panel WHERE day(t) <= 14) d ON d.t BETWEEN e.a AND e.b LEFT JOIN panel p ON p.entity = e.entity AND p.t = d.t)) WHERE px IS NOT NULL"""),
    "sparse_trim": sql("lr", "SELECT entity, t, round(r, 6) + 0.0 AS r FROM lr WHERE t >= (SELECT min(t) FROM (SELECT t, count(r) AS n FROM lr GROUP BY 1) WHERE n >= (SELECT greatest(2, floor(max(n) * 0.9)) FROM (SELECT count(r) AS n FROM lr GROUP BY t)))"),
    "market_demean": sql("ret", ROWS + "(SELECT entity, t, r - avg(r) OVER (PARTITION BY t) AS r FROM ret)"),
    "market_residual": sql("ret", ROWS + """(SELECT entity, t, r - regr_intercept(r, f) OVER p - regr_slope(r, f) OVER p * f AS r FROM (SELECT *, avg(r) OVER (PARTITION BY t) AS f FROM ret) WINDOW p AS (PARTITION BY entity))"""),
    "loo_regression_diag": sql("res", """SELECT entity, round(max(alpha), 6) + 0.0 AS alpha, round(max(beta), 6) + 0.0 AS beta, round(1 - sum(e * e) / (var_pop(r) * count(*)), 6) + 0.0 AS r2, round(1 - var_pop(e) / var_pop(r), 6) + 0.0 AS explained_variance,
      round(avg(e), 6) + 0.0 AS residual_mean, round(sum(e * f), 6) + 0.0 AS residual_factor FROM res GROUP BY 1"""),
    "industry_neutral": sql("win ind", ROWS + DEMEAN.format("win")),
    "factor_universe": sql("panel ind", "SELECT entity, nation AS industry FROM (SELECT *, count(*) OVER (PARTITION BY nation) AS n FROM (SELECT DISTINCT entity FROM panel) JOIN ind USING (entity)) WHERE n >= 2"),
    "factor_exclusions": sql("panel ind", "SELECT entity, nation AS industry, 'industry_size_lt_2' AS reason FROM (SELECT *, count(*) OVER (PARTITION BY nation) AS n FROM (SELECT DISTINCT entity FROM panel) JOIN ind USING (entity)) WHERE n < 2"),
    "factor_branches": sql("z mz ind", "SELECT branch, entity, t, round(r, 6) + 0.0 AS r FROM (SELECT 'raw' AS branch, entity, t, r FROM z UNION ALL SELECT 'market_residual_internal', entity, t, r FROM mz UNION ALL SELECT 'sequential', entity, t, r FROM " + DEMEAN.format("mz") + ")"),
    "legacy_industry_only": sql("win ind", ROWS + "(SELECT entity, t, (r - avg(r) OVER p) / coalesce(nullif(stddev_samp(r) OVER p, 0), 1e-8) AS r FROM " + DEMEAN.format("win") + " WINDOW p AS (PARTITION BY entity))"),
    "modwt_l1": sql("l1", "SELECT entity, band::INT AS band, k::INT AS k, round(x, 6) + 0.0 AS x FROM (SELECT entity, 0 AS band, k, x FROM l1 UNION ALL SELECT entity, 1, k, d FROM l1)"),
    "modwt_l2": sql("bands", "SELECT entity, band::INT AS band, k::INT AS k, round(x, 6) + 0.0 AS x FROM bands"),
    "band_norms": sql("bands", "SELECT entity, band::INT AS band, round(sqrt(sum(x * x)), 6) + 0.0 AS norm FROM bands GROUP BY 1, 2"),
    "sim_cosine": sql("wide", "SELECT i, j, " + _r("s0 s1 s2") + " FROM wide"),
    "matrix_summary": sql("sim", "SELECT round(avg(s), 6) + 0.0 AS mean, round(stddev_pop(s), 6) + 0.0 AS std, round(min(s), 6) + 0.0 AS min, round(max(s), 6) + 0.0 AS max, " + ", ".join(f"round(quantile_cont(s, {q}), 6) + 0.0 AS q{k}" for k, q in enumerate((0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))) + " FROM sim WHERE band = 0"),
    "similarity_threshold": sql("tau", "SELECT round(tau, 6) + 0.0 AS tau FROM tau"),
    "adjacency": sql("adj", "SELECT i, j, round(w, 6) + 0.0 AS w FROM adj"),
    "adjacency_stats": sql("adj", "SELECT count(*) AS n_edges, round(count(*) / ((SELECT count(*) FROM supplier) * ((SELECT count(*) FROM supplier) - 1) / 2), 6) + 0.0 AS edge_density, (SELECT count(*) FROM supplier) AS n_entities FROM adj"),
    "dense_score": sql("dense", "SELECT i, j, round(w, 6) + 0.0 AS w FROM dense"),
    "signed_dual_scores": sql("terms", "SELECT i, j, " + ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in {
        "max_weighted": "greatest(2.5 * x1, 4 * x2)", "mean_weighted": "(2.5 * x1 + 4 * x2) / 2", "median_weighted": "(2.5 * x1 + 4 * x2) / 2", "geometric_weighted": "sqrt(2.5 * x1 * 4 * x2)", "max_unweighted": "greatest(x1, x2)", "mean_unweighted": "(x1 + x2) / 2"}.items()) + " FROM terms"),
    "power_affinity": sql("dense", "SELECT i, j, round(pow(w / (SELECT max(w) FROM dense), 0.35), 6) + 0.0 AS w FROM dense"),
    "topk_affinity": sql("dense", """SELECT least(a, b) AS i, greatest(a, b) AS j, round(max(w), 6) + 0.0 AS w FROM (SELECT a, b, w, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS k FROM (
      SELECT i AS a, j AS b, round(w, 6) / (SELECT max(round(w, 6)) FROM dense) AS w FROM dense UNION ALL SELECT j, i, round(w, 6) / (SELECT max(round(w, 6)) FROM dense) FROM dense)) WHERE k <= 5 GROUP BY 1, 2"""),
    "distance": sql("dense", "SELECT i, j, round(1 - w / (SELECT max(w) FROM dense), 6) + 0.0 AS d FROM dense"),
    "label_table": sql("lab", "SELECT entity, 'SW1' AS level, CASE WHEN NOT is_conflict THEN names[1] END AS label, is_conflict, CASE WHEN is_conflict THEN array_to_string(names, '|') ELSE '' END AS conflict_labels, array_to_string(ids, '|') AS ids, len(ids)::BIGINT AS n_ids FROM lab"),
    "align_labels": sql("lab asg", "SELECT a.entity, a.cluster_id, CASE WHEN NOT l.is_conflict THEN l.names[1] END AS label, coalesce(NOT l.is_conflict, false) AS is_labeled FROM (SELECT lpad(entity::VARCHAR, greatest(6, length(entity::VARCHAR))::INT, '0') AS entity, cluster_id FROM asg) a LEFT JOIN lab l ON l.entity = a.entity"),
    "contingency": sql("tab", "SELECT label, cluster_id, n FROM tab"),
    "agreement": sql("agree", "SELECT ari + 0.0 AS ari, nmi + 0.0 AS nmi, n, n_labels, n_clusters FROM agree"),
    "industry_metrics": sql("agree", "SELECT ari + 0.0 AS ari, nmi + 0.0 AS nmi, n AS n_current, n AS n_used, 0::BIGINT AS n_unlabeled, n_clusters, n_labels, 1.0::DOUBLE AS coverage FROM agree"),
    "cluster_stats": sql("asg", "SELECT count(*) AS n_communities, count(*) FILTER (n = 1) AS n_singletons, max(n) AS largest, median(n)::DOUBLE AS median_size FROM (SELECT count(*) AS n FROM asg GROUP BY cluster_id)"),
    "dependence": sql("two info", "SELECT l::INT AS band_l, r::INT AS band_r, round(rho, 6) + 0.0 AS spearman, round(mi, 6) + 0.0 AS mi, round(2 * mi / (ha + hb), 6) + 0.0 AS nmi, round(ha + hb - 2 * mi, 6) + 0.0 AS vi FROM info JOIN (SELECT l, r, corr(x, y) AS rho FROM two GROUP BY 1, 2) USING (l, r)"),
    "connected_components": sql("adj", "SELECT s_suppkey AS entity, coalesce(c, s_suppkey)::VARCHAR AS cluster_id FROM supplier LEFT JOIN (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY 1) ON a = s_suppkey",
                                "reach(a, b) AS (SELECT i, j FROM adj UNION SELECT j, i FROM adj UNION SELECT r.a, e.b FROM reach r JOIN (SELECT i AS a, j AS b FROM adj UNION ALL SELECT j, i FROM adj) e ON e.a = r.b)"),
    "mcl_iteration": sql("step", "SELECT row, col, round(p, 5) + 0.0 AS p FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY p DESC, row) AS k FROM step) WHERE p >= 1e-3 OR k = 1"),
    "monotonicity": sql("trend", """SELECT operator, count(*) AS n_levels, round(min_by(ari, level), 6) + 0.0 AS start, round(max_by(ari, level), 6) + 0.0 AS end, round(corr(rl, ra), 6) + 0.0 AS rho,
      CASE WHEN count(*) < 5 THEN 'incomplete' WHEN bool_and(coalesce(step < 0, true)) THEN 'strictly_preserved' WHEN max_by(ari, level) < min_by(ari, level) AND corr(rl, ra) <= -0.9 THEN 'direction_preserved' ELSE 'not_preserved' END AS trend
      FROM (SELECT *, ari - lag(ari) OVER (PARTITION BY operator ORDER BY level) AS step, rank() OVER (PARTITION BY operator ORDER BY level) AS rl, rank() OVER (PARTITION BY operator ORDER BY ari) + (count(*) OVER (PARTITION BY operator, ari) - 1) / 2.0 AS ra FROM trend) GROUP BY 1"""),
    "pivot_levels": sql("trend", 'SELECT level, ' + ", ".join(f"round(max(ari) FILTER (operator = '{o}'), 6) + 0.0 AS \"{o}\"" for o in "ANR") + " FROM trend GROUP BY 1"),
    "combine_runs": """SELECT '2019:default:' || trial_id AS global_trial_id, status, SW1_ari, 'run_' || status AS source_run FROM (
      SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY (status = 'ok') DESC) AS k FROM (
        SELECT o_custkey::VARCHAR AS trial_id, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'failed' END AS status, max(o_totalprice) AS SW1_ari FROM orders GROUP BY 1, 2)) WHERE k = 1""",
}
REACH = "{0}(a, b) AS (SELECT i, j FROM {1} UNION SELECT j, i FROM {1} UNION SELECT r.a, e.b FROM {0} r JOIN (SELECT i AS a, j AS b FROM {1} UNION ALL SELECT j, i FROM {1}) e ON e.a = r.b)"
#: Agreement of the groups in `tab` (label, cluster_id, n), as the expressions pairs and agree have it.
AGREE = ",\n".join(CTES[c] for c in ("pairs", "agree"))
ORACLE |= {
    "sim_spearman": sql("rsim", "SELECT i, j, " + ", ".join(f"round(max(s) FILTER (band = {k}), 6) + 0.0 AS s{k}" for k in range(3)) + " FROM rsim GROUP BY 1, 2"),
    "sub_universe": sql("wide ind", "SELECT i, j, " + _r("s0 s1 s2") + " FROM wide WHERE i IN (SELECT entity FROM ind WHERE region = '1') AND j IN (SELECT entity FROM ind WHERE region = '1')"),
    "mcl_three_rounds": sql("m3", "SELECT row, col, round(p, 5) + 0.0 AS p FROM m3"),
    "partition_agreement": sql("adj asg", "SELECT ari + 0.0 AS ari, nmi + 0.0 AS nmi, n, n_labels, n_clusters FROM agree", REACH.format("reach", "adj") + """,
part AS (SELECT s_suppkey AS entity, coalesce(c, s_suppkey)::VARCHAR AS label FROM supplier LEFT JOIN (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY 1) ON a = s_suppkey),
tab AS (SELECT label, cluster_id, count(*) AS n FROM part JOIN asg USING (entity) GROUP BY 1, 2),\n""" + AGREE),
    "embedding_clusters": sql("elink", "SELECT ari + 0.0 AS ari, nmi + 0.0 AS nmi, n, n_labels, n_clusters FROM agree", REACH.format("reach", "elink") + """,
part AS (SELECT vec_id, coalesce(c, vec_id)::VARCHAR AS cluster_id FROM embeddings LEFT JOIN (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY 1) ON a = vec_id),
tab AS (SELECT label::VARCHAR AS label, cluster_id, count(*) AS n FROM part JOIN embeddings USING (vec_id) GROUP BY 1, 2),\n""" + AGREE),
}
#: Grids: trials by cross joins of the axes, ids by SHA-1 of the canonical JSON.
GRID = """feat AS (SELECT w, l, row_number() OVER (ORDER BY wi, l) - 1 AS fi, '{"level": ' || l || ', "wavelet": "' || w || '"}' AS feature, '{"level":' || l || ',"wavelet":"' || w || '"}' AS fj
  FROM (VALUES (0, 'sym2'), (1, 'db4'), (2, 'sym4'), (3, 'coif1')) a(wi, w), (VALUES (2), (3), (4), (5), (6)) b(l)),
clus(ci, cluster, cj) AS (VALUES (0, '{"gamma": 0.35, "kind": "dense_spectral_power", "n_clusters": 10}', '{"gamma":0.35,"kind":"dense_spectral_power","n_clusters":10}'), (1, '{"gamma": 0.35, "kind": "dense_spectral_power", "n_clusters": 25}', '{"gamma":0.35,"kind":"dense_spectral_power","n_clusters":25}'),
  (2, '{"inflation": 1.4, "kind": "mcl"}', '{"inflation":1.4,"kind":"mcl"}'), (3, '{"inflation": 1.8, "kind": "mcl"}', '{"inflation":1.8,"kind":"mcl"}')),
grid AS (SELECT fi * 4 + ci AS index, left(sha1('{"cluster":' || cj || ',"feature":' || fj || ',"strict_no_metadata":true}'), 16) AS trial_id, feature, cluster FROM feat, clus)"""
ORACLE["trial_grid"] = f"WITH {GRID} SELECT index, trial_id, feature, cluster FROM grid"
ORACLE["trial_shard"] = f"WITH {GRID} SELECT index, trial_id FROM grid WHERE index % 3 = 1"
ORACLE["grid_expansion"] = """WITH feat AS (SELECT row_number() OVER (ORDER BY wi, l) - 1 AS fi, '{"k": 0.0, "levels": ' || l || ', "q_threshold": 0.996, "return_mode": "raw", "wavelet": "' || w || '", "wavelet_transform": "modwt", "winsor_limit": 0.03}' AS feature FROM (VALUES (0, 'sym2'), (1, 'db4')) a(wi, w), (VALUES (2), (3), (4)) b(l)),
power AS (SELECT 1 AS c, g::DOUBLE * 1000 + n AS o, '{"assign_labels": "kmeans", "clusterer": "dense_spectral_power", "gamma": ' || g || ', "n_clusters": ' || n || ', "seed": 42}' AS cluster FROM (VALUES ('0.3'), ('0.35')) a(g), (VALUES (10), (25)) b(n)),
knn AS (SELECT 2, t * 10000 + g::DOUBLE * 1000 + n, '{"assign_labels": "kmeans", "clusterer": "knn_spectral", "gamma": ' || g || ', "n_clusters": ' || n || ', "seed": 42, "top_k": ' || t || '}' FROM (VALUES (8), (16)) c(t), (VALUES ('0.3'), ('0.35')) a(g), (VALUES (10), (25)) b(n)),
mcl AS (SELECT 3, i::DOUBLE, '{"clusterer": "mcl", "inflation": ' || i || ', "pruning_threshold": 0.05, "seed": 42}' FROM (VALUES ('1.4'), ('1.8')) a(i)),
clus AS (SELECT cluster, row_number() OVER (ORDER BY c, o) - 1 AS ci FROM (SELECT * FROM power UNION ALL SELECT * FROM knn UNION ALL SELECT * FROM mcl UNION ALL SELECT 4, 0, '{"clusterer": "connected_components", "seed": 42}')),
grid AS (SELECT fi * 15 + ci AS index, left(sha1('{"cluster":' || replace(replace(cluster, ': ', ':'), ', ', ',') || ',"feature":' || replace(replace(feature, ': ', ':'), ', ', ',') || ',"strict_no_metadata":true}'), 16) AS trial_id, feature, cluster FROM feat, clus)
SELECT index, trial_id, feature, cluster FROM grid WHERE index % 3 = 1 ORDER BY index LIMIT 20"""
ORACLE["modwt_l2_arrow"] = ORACLE["modwt_l2"]
