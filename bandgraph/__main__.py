"""python -m bandgraph run|sweep|grid|ablation|controls CONFIG OUTPUT | combine ROOT OUTPUT"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from bandgraph.operators import evaluate as E, panel as P, transforms as T
from bandgraph.params import from_dict
from bandgraph.plans import experiments as X, grid, runs
from bandgraph.session import cut
from bandgraph.sources import readers as R, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="bandgraph")
    sub = out.add_subparsers(dest="what", required=True)
    said = {"run": "one run of a YAML configuration", "sweep": "Markov clusterings over levels and inflations", "grid": "trials of a parameter grid", "ablation": "reducers by levels", "controls": "market and industry controls"}
    made = {name: sub.add_parser(name, help=text) for name, text in said.items()}
    for p in made.values():
        p.add_argument("config")
        p.add_argument("output")
        for day in ("start-date", "end-date"):
            p.add_argument(f"--{day}")
        p.add_argument("--min-price-coverage", type=float)
        p.add_argument("--max-flat-return-rate", type=float)
        p.add_argument("--min-eligible", type=int, default=2)
    for name in ("sweep", "ablation"):
        made[name].add_argument("--levels", type=int, nargs="+", default=[2, 3, 4, 5, 6])
    made["sweep"].add_argument("--inflations", type=float, nargs="+", default=grid.CLUSTER_AXES["inflation"])
    made["sweep"].add_argument("--force", action="store_true")
    for name, default in (grid.FEATURE_AXES | grid.CLUSTER_AXES).items():
        made["grid"].add_argument(f"--{name.replace('_', '-')}", dest=f"axis_{name}", type=type(default[0]), nargs="+", default=default)
    for name, default in grid.CONSTANTS.items():
        made["grid"].add_argument(f"--{name.replace('_', '-')}", dest=f"axis_{name}", type=type(default), default=default)
    g = made["grid"]
    g.add_argument("--clusterers", nargs="+", default=["dense_spectral_power"], choices=list(grid.CLUSTERERS))
    g.add_argument("--include-trial-ids-file")
    g.add_argument("--num-shards", type=int, default=1)
    g.add_argument("--shard-index", type=int, default=0)
    g.add_argument("--max-trials", type=int)
    g.add_argument("--window-id", default="")
    g.add_argument("--target-min", type=float, default=0.2)
    g.add_argument("--stop-on-target", action="store_true")
    g.add_argument("--write-best-assignments", action="store_true")
    g.add_argument("--force", action="store_true")
    made["ablation"].add_argument("--clusters", type=int, default=25)
    made["controls"].add_argument("--dependence-bins", type=int, default=64)
    made["controls"].add_argument("--operator-baseline-gate")
    both = sub.add_parser("combine", help="merge the results of the run folders under a root")
    both.add_argument("root")
    both.add_argument("output")
    both.add_argument("--prefer", choices=["metrics", "summary"], default="metrics")
    both.add_argument("--keep-duplicates", action="store_true")
    return out


def prices(spark: SparkSession, config: dict, a: argparse.Namespace):
    """The panel in its window, of entities that are eligible in it."""
    data = config["data"] | {k: v for k, v in {"start_date": a.start_date, "end_date": a.end_date}.items() if v}
    panel = runs.load_prices(spark, data)
    if a.min_price_coverage is not None or a.max_flat_return_rate is not None:
        panel, _ = P.eligible(panel, a.min_price_coverage or 0.0, 1.0 if a.max_flat_return_rate is None else a.max_flat_return_rate)
    panel = cut(panel)
    if panel.select("entity").distinct().limit(a.min_eligible).count() < a.min_eligible:
        raise RuntimeError(f"fewer than {a.min_eligible} entities are eligible")
    return panel


def label_tables(spark: SparkSession, data: dict) -> dict:
    if not data.get("universe_path"):
        return {}
    rows = R.universe_rows(spark, str(R.workspace_path(data["universe_path"])))
    return {level: cut(E.label_table(rows, level)) for level in ("SW1", "SW2", "SW3")}


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("bandgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "combine":
        found = R.result_dirs(spark, a.root, a.prefer)
        if found:
            sinks.write_csv(X.combined_windows(found, dedupe=not a.keep_duplicates), a.output)
        return
    config = R.load_config(a.config)
    params, data = from_dict(config.get("params", {})), config["data"]
    if a.what == "run":
        print(json.dumps(sinks.json_safe(runs.run_experiment(spark, config, a.output))))
    elif a.what == "sweep":
        runs.sweep_to_files(spark, config | {"data": data | {k: v for k, v in {"start_date": a.start_date, "end_date": a.end_date}.items() if v}}, a.output, a.levels, a.inflations, a.force)
    elif a.what == "grid":
        axes = {k.removeprefix("axis_"): v for k, v in vars(a).items() if k.startswith("axis_")}
        ids = R.trial_ids(spark, a.include_trial_ids_file) if a.include_trial_ids_file else None
        trials = grid.expanded(spark, axes, a.clusterers, ids, a.num_shards, a.shard_index, a.max_trials)
        results, tables = str(Path(a.output) / "results"), label_tables(spark, data)
        if a.force:
            sinks.remove(spark, results)
        rows = runs.run_grid(prices(spark, config, a), trials, results, tables, params, (a.window_id, a.start_date or "", a.end_date or ""), str(Path(a.output) / "assignments") if a.write_best_assignments else None, a.target_min if a.stop_on_target else None)
        rows = rows.orderBy(F.desc_nulls_last("SW1_ari")) if "SW1_ari" in rows.columns else rows
        sinks.write_csv(rows, Path(a.output) / "metrics.csv")
        sinks.write_json({"window_id": a.window_id, "start_date": a.start_date, "end_date": a.end_date, "trials": trials.count(), "environment": sinks.environment(spark)}, Path(a.output) / "run_manifest.json")
    elif a.what == "ablation":
        runs.ablation_to_files(prices(spark, config, a), params, a.levels, label_tables(spark, data), a.output, a.clusters, config.get("gate"))
    else:
        gate = runs.accepted_gate(a.operator_baseline_gate or "", a.operator_baseline_gate is not None)
        industries = T.industry_map(R.metadata(spark, str(R.workspace_path(data["metadata_path"])))).select(F.col("code").alias("entity"), "industry")
        runs.controls_to_files(prices(spark, config, a), industries, params, a.output, a.dependence_bins, gate)


if __name__ == "__main__":
    main()
