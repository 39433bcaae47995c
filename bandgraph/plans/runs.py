"""Whole runs: one model, level sweeps, trial grids, operator ablation, factor controls, and their outputs."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, replace
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from bandgraph.operators import dependence as D, evaluate as E, graph as G, matrix_cluster as M, panel as P, scores as S, similarity as SIM, transforms as T, wavelets as W
from bandgraph.params import Params, band_names, check_sweep, from_dict
from bandgraph.plans import experiments as X, grid as grids
from bandgraph.session import cut, delete
from bandgraph.sources import readers as R, sinks


def load_prices(spark: SparkSession, config: dict) -> DataFrame:
    """The panel of a configuration: a wide file if it is preferred and there, else a folder of series on a calendar."""
    start, end = config.get("start_date"), config.get("end_date")
    if config.get("prefer_panel", True) and config.get("panel_path"):
        return R.price_panel(spark, str(R.workspace_path(config["panel_path"])), start, end, config.get("prefer_parquet", True))
    days = R.trade_calendar(spark, str(R.workspace_path(config["calendar_path"])), config.get("exchange", "SSE")) if config.get("calendar_path") else None
    return R.series_directory(spark, str(R.workspace_path(config["series_dir"])), start, end, days, config.get("limit"))


class BandModel:
    """Returns, bands, similarities, network and clusters of a panel; each step is made once and kept in the shared folder."""

    def __init__(self, panel: DataFrame, params: Params = Params(), mode: str | None = None):
        """mode: None for the full model's returns, else plain returns in that mode."""
        self.panel, self.params, self.mode = panel, params, mode
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = cut(make())
        return self._kept[name]

    def release(self) -> None:
        """Deletes what is kept."""
        for df in self._kept.values():
            delete(df.sparkSession, df._cut)
        self._kept.clear()

    def change(self, params: Params) -> None:
        """Other parameters for the score and the clustering; what is kept and depends on them is made again."""
        if (params.negative_weight, params.reducer, params.layer_weighting) != (self.params.negative_weight, self.params.reducer, self.params.layer_weighting):
            self._kept.pop("score", None)
        self.params = params

    def returns(self) -> DataFrame:
        def make():
            out = T.model_returns(self.panel, self.params) if self.mode is None else T.plain_returns(self.panel, self.params, self.mode)
            if out.select("entity").distinct().limit(2).count() < 2:
                raise RuntimeError("fewer than two entities are left")
            return out

        return self._once("returns", make)

    def entities(self) -> DataFrame:
        return self._once("entities", lambda: self.returns().select("entity").distinct())

    def bands(self) -> DataFrame:
        p = self.params
        return self._once("bands", lambda: W.decomposed(W.series(self.returns()), p.wavelet, p.level, p.decomposition))

    def similarities(self, spearman: bool = False) -> DataFrame:
        make = W.ranked_bands if spearman else W.unit_bands
        return self._once(f"similarities {spearman}", lambda: SIM.all_pairs(cut(make(self.bands()))))

    def network(self) -> DataFrame:
        """Edges over the threshold."""
        sim = self.similarities()
        return self._once("network", lambda: S.adjacency(sim, S.threshold(sim, self.entities().count(), self.params.quantile), self.params.layer_step))

    def score(self) -> DataFrame:
        p = self.params
        return self._once("score", lambda: S.signed_score(self.similarities(), p.layer_step, p.negative_weight, p.reducer, p.layer_weighting))

    def assignments(self, clusterer: str = "mcl", **options) -> DataFrame:
        """(entity, cluster_id) by mcl, connected_components, or a clusterer of matrix_cluster."""
        p = self.params
        if clusterer == "mcl":
            return G.mcl_labels(G.mcl(self.network(), self.entities(), options.get("inflation", p.inflation), p.expansion - 1, iterations=p.iterations, pruning=p.pruning), self.entities())
        if clusterer == "connected_components":
            return G.assigned(G.components(self.network()), self.entities())
        if clusterer == "louvain" or clusterer not in {*M.MATRIX, *M.LANDMARK}:
            edges = self.network()
        else:
            edges = self.score() if "signed_dual" in clusterer else S.dense_score(self.similarities(), p.layer_step)
        return M.run_clusterer(edges.withColumn("trial", F.lit("one")), self.entities(), clusterer, **options).drop("trial")

    def metrics(self, assignments: DataFrame, industries: DataFrame | None = None) -> dict:
        found = E.cluster_stats(assignments).first().asDict()
        found |= S.adjacency_stats(self.network(), self.entities().count()).first().asDict()
        if industries is not None:
            found |= E.industry_metrics(self.entities(), assignments, industries).first().asDict()
        return found


def run_experiment(spark: SparkSession, config: dict, output: str) -> dict:
    """One run of a configuration; writes metrics, assignments and a manifest under output."""
    began, params = time.time(), from_dict(config.get("params", {}))
    model = BandModel(load_prices(spark, config["data"]), params)
    industries = T.industry_map(R.metadata(spark, str(R.workspace_path(config["data"]["metadata_path"])))).select(F.col("code").alias("entity"), "industry") if config["data"].get("metadata_path") else None
    got = cut(model.assignments(config.get("clusterer", "mcl"), **config.get("options", {})))
    metrics = model.metrics(got, industries) | {"seconds": round(time.time() - began, 3)}
    sinks.write_run(metrics, got, output, {"config": config, "params": asdict(params), "environment": sinks.environment(spark)})
    return metrics


def level_sweep(panel: DataFrame, params: Params, levels: list[int], inflations: list[float], industries: DataFrame | None = None, done: set[tuple] = frozenset()) -> list[dict]:
    """A row for each level and inflation not done; the network of a level is made once."""
    for level in levels:
        for inflation in inflations:
            check_sweep(level, inflation)
    rows = []
    for level in sorted(set(levels)):
        todo = [i for i in inflations if (level, i) not in done]
        if not todo:
            continue
        began = time.time()
        model = BandModel(panel, replace(params, level=level))
        model.network()
        setup = time.time() - began
        for inflation in todo:
            began = time.time()
            got = cut(model.assignments("mcl", inflation=inflation))
            rows.append({"level": level, "inflation": inflation, "setup_seconds": setup, "cluster_seconds": time.time() - began} | model.metrics(got, industries))
    return rows


def sweep_row(model: BandModel, name: str, metrics: dict, setup: float, cluster: float) -> dict:
    """A sweep's row: the run's parameters, metrics, shapes of prices and returns, and seconds."""
    shape = lambda df: df.agg(F.count_distinct("t").alias("r"), F.count_distinct("entity").alias("c"), F.min("t").alias("a"), F.max("t").alias("b")).first()
    prices, returns = shape(model.panel), shape(model.returns())
    day = lambda t: str(t.date()) if t else ""
    sizes = {"price_rows": prices.r, "price_cols": prices.c, "return_rows": returns.r, "return_cols": returns.c, "return_start": day(returns.a), "return_end": day(returns.b)}
    return {"run_id": name} | asdict(model.params) | metrics | sizes | {"setup_seconds": setup, "cluster_seconds": cluster, "seconds": setup + cluster}


def sweep_to_files(spark: SparkSession, config: dict, output: str, levels: list[int], inflations: list[float], force: bool = False) -> list[dict]:
    """A folder for each level and inflation with the configuration, metrics, assignments and manifest, and summary.csv.

    A cell that has metrics isn't run again unless forced; its row comes from the file. The network of a level is made once,
    if any of its cells is to do.
    """
    for level in levels:
        for inflation in inflations:
            check_sweep(level, inflation)
    params, data, rows = from_dict(config.get("params", {})), config["data"], []
    panel = cut(load_prices(spark, data))
    industries = T.industry_map(R.metadata(spark, str(R.workspace_path(data["metadata_path"])))).select(F.col("code").alias("entity"), "industry") if data.get("metadata_path") else None
    for level in levels:
        model, setup = None, 0.0
        for inflation in inflations:
            cell = Path(output) / f"level_{level}_inflation_{inflation:g}".replace(".", "p")
            sinks.write_yaml(config | {"params": config.get("params", {}) | {"level": level, "inflation": inflation}}, Path(output) / f"config_{cell.name}.yaml")
            if not force and (cell / "metrics.json").exists():
                rows.append(json.loads((cell / "metrics.json").read_text(encoding="utf-8")))
                continue
            began = time.time()
            if model is None:
                model = BandModel(panel, replace(params, level=level))
                model.network()
                setup = time.time() - began
            began = time.time()
            model.change(replace(model.params, inflation=inflation))
            got = cut(model.assignments("mcl", inflation=inflation))
            rows.append(sweep_row(model, cell.name, model.metrics(got, industries), setup, time.time() - began))
            sinks.write_run(rows[-1], got, cell, {"run_id": cell.name, "started_at": datetime.fromtimestamp(began).astimezone().isoformat(), "finished_at": datetime.now().astimezone().isoformat(), "config": config, "environment": sinks.environment(spark)})
        if model:
            model.release()
    sinks.write_rows_csv(rows, Path(output) / "summary.csv")
    return rows


def run_grid(panel: DataFrame, grid: DataFrame, results: str, tables: dict[str, DataFrame], params: Params = Params(), window: tuple[str, str, str] = ("", "", ""), assignments: str | None = None, target: float | None = None) -> DataFrame:
    """Runs trials that results, a Parquet folder, doesn't have with status ok, and appends a row each; gives all rows.

    Trials of equal features, which follow one another, share returns, bands and similarities. A failing trial is a row
    with its error; columns are the same whichever comes first. With `assignments`, a folder, the best trial so far by
    SW1_ari has its assignments there; with `target` the grid ends at the first trial that reaches it.
    """
    spark = panel.sparkSession
    schema = f"{grids.ROW}, " + "".join(f"{k}_{m} double, " for k in tables for m in ("ari", "nmi")) + grids.METRICS
    best, kinds = None, spark.createDataFrame([], schema).schema
    try:
        before = spark.read.parquet(results)
        grid = X.to_do(grid, before)
        best = before.agg(F.max("SW1_ari")).first()[0] if "SW1_ari" in before.columns else None
    except AnalysisException as e:  # no results yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    shape, feature, model = (panel.select("t").distinct().count(), panel.select("entity").distinct().count()), None, None
    for t in grid.orderBy("index").collect():  # a grid is a driver's list
        began, row = time.time(), grids.base_row(t, datetime.now().astimezone().isoformat(), window, shape)
        try:
            kind, options, changed = grids.cluster_options(json.loads(t.cluster))
            if t.feature != feature:
                own, mode = grids.feature_params(json.loads(t.feature), params)
                model, feature = BandModel(panel, own, mode), t.feature
            model.change(replace(own, **changed))
            got = cut(model.assignments(kind, **options))
            row |= E.cluster_stats(got).first().asDict()
            if kind in ("mcl", "connected_components", "louvain"):
                row |= S.adjacency_stats(model.network(), model.entities().count()).first().asDict()
            for r in E.level_metrics(got, tables).where("level <> 'mean'").collect() if tables else []:
                row |= {f"{r.level}_ari": r.ari, f"{r.level}_nmi": r.nmi}
            row["status"] = "ok"
            if assignments and row.get("SW1_ari") is not None and (best is None or row["SW1_ari"] > best):
                best, row["assignments_path"] = row["SW1_ari"], f"{assignments}/{t.trial_id}"
                sinks.write_rows(got, row["assignments_path"])
        except Exception as e:
            row |= {"status": "failed", "error_type": type(e).__name__, "error_message": str(e)[:500]}
        row["seconds"] = time.time() - began
        values = [row.get(f.name) for f in kinds]
        sinks.append_rows(spark.createDataFrame([tuple(float(v) if v is not None and f.dataType.simpleString() == "double" else v for v, f in zip(values, kinds, strict=True))], kinds), results, schema)
        if target is not None and (row.get("SW1_ari") or -1) >= target:
            break
    return spark.read.parquet(results)


def operator_ablation(panel: DataFrame, params: Params, levels: list[int], labels: DataFrame | dict[str, DataFrame], n_clusters: int = 25, wanted: dict | None = None) -> DataFrame:
    """(operator, level, ari, nmi, ...) for every reducer preset and level; wanted is a gate on the first level's max_weighted.

    With several label tables by name, agreement columns have the name before them; the partitions are made once.
    """
    tables, rows = labels if isinstance(labels, dict) else {"": labels}, []
    named = lambda name, c: f"{name}_{c}" if name else c
    agreed = ("ari", "nmi", "n", "n_labels", "n_clusters")
    for level in sorted(set(levels)):
        model = BandModel(panel, replace(params, level=level), "raw")
        terms = cut(S.signed_terms(model.similarities(), params.negative_weight))
        scores = cut(S.signed_scores(terms, params.layer_step, S.PRESETS))
        each = reduce(DataFrame.unionByName, (scores.select(F.lit(o).alias("trial"), "i", "j", F.col(o).alias("w")) for o in S.PRESETS))
        got = cut(M.run_clusterer(each, model.entities(), "dense_spectral_signed_dual_power", n_clusters=min(n_clusters, model.entities().count()), seed=params.seed))
        for o in S.PRESETS:
            one, row = got.where(F.col("trial") == o), {"operator": o, "level": level}
            for name, table in tables.items():
                used = E.aligned_labels(one.select("entity", "cluster_id"), table).where("is_labeled")
                found = E.agreement(E.contingency(used)).first().asDict()
                row |= {named(name, c): found[c] for c in agreed}
            rows.append(row | E.cluster_stats(one).first().asDict())
        if wanted and level == min(levels):
            X.require(X.gate(next(r for r in rows if r["operator"] == "max_weighted"), wanted))
        model.release()
    kinds = ", ".join(f"{named(name, c)} {'double' if c in ('ari', 'nmi') else 'long'}" for name in tables for c in agreed)
    return panel.sparkSession.createDataFrame([tuple(r.values()) for r in rows], f"operator string, level long, {kinds}, n_communities long, n_singletons long, largest long, median_size double")


def factor_controls(panel: DataFrame, industries: DataFrame, params: Params, bins: int = 64) -> tuple[DataFrame, DataFrame]:
    """(dependence of each branch, mean off-diagonal of each relative to raw) with Spearman similarities; branches are raw,
    market_residual_internal, sequential and industry_only, over the entities of factor_universe."""
    universe = cut(T.factor_universe(panel, industries))
    T.check_universe(universe)
    kept = universe.where("reason IS NULL").select("entity", "industry")
    panel = panel.join(kept.select("entity"), "entity", "left_semi")
    winsor = (params.winsor_low, params.winsor_high)
    T.check_fits(T.leave_one_out_diagnostics(T.leave_one_out(T.winsorized(P.log_returns(panel), *winsor))))
    branches = cut(T.factor_branches(panel, kept, winsor).unionByName(T.industry_only(panel, kept, winsor).withColumn("branch", F.lit("industry_only"))))
    found, means = [], []
    for b in ("raw", "market_residual_internal", "sequential", "industry_only"):
        bands = W.decomposed(W.series(branches.where(F.col("branch") == b)), params.wavelet, params.level, params.decomposition)
        d = cut(D.dependence(cut(SIM.all_pairs(cut(W.ranked_bands(bands)))), bins))
        found.append(d.withColumn("branch", F.lit(b)))
        means.append(D.mean_off_diagonal(d).withColumn("branch", F.lit(b)))
    return reduce(DataFrame.unionByName, found), D.relative_to(reduce(DataFrame.unionByName, means))


def ablation_to_files(panel: DataFrame, params: Params, levels: list[int], tables: dict[str, DataFrame], output: str, n_clusters: int = 25, wanted: dict | None = None) -> dict:
    """operator_ablation on every label table, with metrics, a pivot of each metric, trends over levels, the gate, an
    evidence index and a manifest as files; gives the manifest. A gate that isn't passed is written before it is raised."""
    spark, out, began = panel.sparkSession, Path(output), datetime.now().astimezone().isoformat()
    manifest = {"experiment": "operator_ablation", "started_at": began, "params": asdict(params), "levels": levels, "operators": {k: {"reducer": r, "layer_weighting": w} for k, (r, w) in S.PRESETS.items()}, "environment": sinks.environment(spark), "status": "running"}
    sinks.write_json(manifest, out / "run_manifest.json")
    try:
        found = cut(operator_ablation(panel, params, levels, tables, n_clusters, wanted))
    except RuntimeError as e:
        manifest |= {"status": "blocked_reference_gate", "failures": [str(e)]}
        sinks.write_json({"passed": False, "error": str(e)}, out / "baseline_gate.json")
        sinks.write_json({"status": manifest["status"], "manifest": str(out / "run_manifest.json")}, out / "evidence_index.json")
        sinks.write_json(manifest, out / "run_manifest.json")
        raise
    sinks.write_json({"passed": True if wanted else None, "wanted": wanted}, out / "baseline_gate.json")
    sinks.write_csv(found.orderBy("operator", "level"), out / "metrics.csv")
    for name in tables:
        for metric in (f"{name}_ari", f"{name}_nmi"):
            sinks.write_csv(sinks.pivoted(found, metric).orderBy("level"), out / f"{metric}_pivot.csv")
    trend = cut(X.monotonicity(found.withColumn("ari", F.col(f"{next(iter(tables))}_ari")), tuple(levels)))
    sinks.write_csv(trend.orderBy("operator"), out / "monotonicity.csv")
    status = "complete" if found.count() == len(set(levels)) * len(S.PRESETS) else "partial"
    sinks.write_json({"supplement": "operator_ablation", "metrics": str(out / "metrics.csv"), "monotonicity": str(out / "monotonicity.csv"), "baseline_gate": str(out / "baseline_gate.json"), "manifest": str(out / "run_manifest.json"), "key_conclusion": {r.operator: r.trend for r in trend.collect()}, "status": status}, out / "evidence_index.json")
    manifest |= {"status": status, "finished_at": datetime.now().astimezone().isoformat(), "n_metrics": found.count()}
    sinks.write_json(manifest, out / "run_manifest.json")
    return manifest


def save_branch(sim: DataFrame, branch: str, names: list[str], entities: int, output: str, bins: int = 64, provenance: str = "") -> dict:
    """A branch's similarities as Parquet by band, a summary row of each band, the four dependence tables and a summary."""
    out, found = Path(output) / branch, cut(D.dependence(sim, bins))
    each = sim.select("i", "j", F.posexplode("s").alias("band", "s")).withColumn("band", F.element_at(F.array(*map(F.lit, names)), F.col("band") + 1))
    sinks.write_rows(each.withColumn("s", F.col("s").cast("float")), str(out / "similarities"), ("band",))
    rows = [{"branch": branch, "band": n} | SIM.matrix_summary(sim, entities, k).first().asDict() for k, n in enumerate(names)]
    sinks.write_rows_csv(rows, out / "bands.csv")
    both = found.union(found.where("band_l < band_r").select("band_r", "band_l", "spearman", "mi", "nmi", "vi"))
    summary = {"branch": branch, "provenance": provenance, "n_entities": entities, "bands": names, "n_bins": bins}
    for value in ("spearman", "mi", "nmi", "vi"):
        table = both.groupBy("band_l").pivot("band_r", list(range(len(names)))).agg(F.first(value)).orderBy("band_l")
        sinks.write_csv(table.select(F.element_at(F.array(*map(F.lit, names)), F.col("band_l") + 1).alias("band"), *(F.col(f"`{k}`").alias(n) for k, n in enumerate(names))), out / f"cross_band_{value}.csv")
        summary[f"mean_off_diagonal_{value}"] = D.mean_off_diagonal(found, value).first()[0]
    sinks.write_json(summary, out / "summary.json")
    return summary


def archive_gate(sim: DataFrame, archived: DataFrame, wanted_mean: float, bins: int = 64, tolerance: float = 5e-6) -> dict:
    """Whether similarities (i, j, s) are those of an archive (i, j, s) within tolerance: the same pairs, every band, the
    correlations between bands, and their mean against a published one."""
    pair = sim.select("i", "j", F.col("s").alias("a")).join(archived.select("i", "j", F.col("s").alias("b")), ["i", "j"], "full")
    far = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    r = pair.agg(F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("int")).alias("alone"), F.max(far).alias("far")).first()
    one, two = (D.dependence(x, bins).select("band_l", "band_r", F.col("spearman").alias(n)) for x, n in ((sim, "x"), (archived, "y")))
    between = one.join(two, ["band_l", "band_r"]).agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0]
    mean = D.mean_off_diagonal(one, "x").first()[0]
    checks = {"same_pairs": not r.alone, "bands_within_tolerance": r.far is not None and r.far <= tolerance, "between_bands_within_tolerance": between is not None and between <= tolerance, "mean_within_tolerance": mean is not None and abs(mean - wanted_mean) <= tolerance}
    return {"passed": all(checks.values()), "tolerance": tolerance, "checks": checks, "max_abs_difference": r.far, "observed_mean": mean, "expected_mean": wanted_mean}


def accepted_gate(path: str, formal: bool) -> dict:
    """The gate that an earlier run wrote; a formal run needs it passed."""
    if not formal:
        return {"passed": None, "status": "smoke_not_formal"}
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"a formal run needs an accepted gate: {path}")
    found = json.loads(p.read_text(encoding="utf-8"))
    if found.get("passed") is not True:
        raise RuntimeError(f"gate not accepted: {found}")
    return found


def controls_to_files(panel: DataFrame, industries: DataFrame, params: Params, output: str, bins: int = 64, gate: dict | None = None) -> dict:
    """Factor controls as files: the common universe, diagnostics of each regression, similarities and dependence of every
    branch, their comparison with raw, an evidence index and a manifest. Raw similarities are those of the whole universe,
    sliced to the common one."""
    spark, out, names = panel.sparkSession, Path(output), band_names(params.level)
    universe = cut(T.factor_universe(panel, industries))
    T.check_universe(universe)
    kept = cut(universe.where("reason IS NULL").select("entity", "industry"))
    winsor, n = (params.winsor_low, params.winsor_high), kept.count()
    sinks.write_csv(universe.orderBy("entity"), out / "factor_common_universe.csv")
    whole = cut(P.log_returns(panel))
    ranked = lambda returns: cut(SIM.all_pairs(cut(W.ranked_bands(W.decomposed(W.series(returns), params.wavelet, params.level, params.decomposition)))))
    raw = ranked(T.zscored(T.winsorized(whole, *winsor)))
    means = [save_branch(SIM.restricted(raw, kept), "raw", names, n, str(out / "dependence"), bins, "sliced from the whole universe")]
    common = panel.join(kept.select("entity"), "entity", "left_semi")
    fits = cut(T.leave_one_out_diagnostics(T.leave_one_out(T.winsorized(P.log_returns(common), *winsor))))
    T.check_fits(fits)
    sinks.write_csv(fits.orderBy("entity"), out / "factor_diagnostics" / "market_residual_internal.csv")
    sinks.write_json(fits.agg(F.count("*").alias("n_entities"), F.avg("r2").alias("mean_r2"), F.avg("beta").alias("mean_beta")).first().asDict(), out / "factor_diagnostics" / "summary.json")
    branches = cut(T.factor_branches(common, kept, winsor).unionByName(T.industry_only(common, kept, winsor).withColumn("branch", F.lit("industry_only"))))
    for b in ("market_residual_internal", "sequential", "industry_only"):
        means.append(save_branch(ranked(branches.where(F.col("branch") == b).drop("branch")), b, names, n, str(out / "dependence"), bins, "factor branch"))
    frame = spark.createDataFrame([(m["branch"], m["mean_off_diagonal_spearman"]) for m in means], "branch string, mean_off_diagonal double")
    sinks.write_csv(D.relative_to(frame).orderBy("branch"), out / "relative_to_raw.csv")
    manifest = {"experiment": "common_factor_controls", "params": asdict(params), "operator_reference_gate": gate, "branches": means, "environment": sinks.environment(spark), "status": "complete"}
    sinks.write_json({"dependence": str(out / "dependence"), "universe": str(out / "factor_common_universe.csv"), "relative": str(out / "relative_to_raw.csv"), "status": "complete"}, out / "evidence_index.json")
    sinks.write_json(manifest, out / "run_manifest.json")
    return manifest
