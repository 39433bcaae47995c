"""Whole runs on the small supplier panel."""

import json

import pytest
from pyspark.sql import functions as F

from bandgraph.params import Params
from bandgraph.__main__ import main
from bandgraph.plans import experiments as X, grid, queries as Q, runs
from bandgraph.sources import readers as R, sinks


@pytest.fixture(scope="module")
def panel(spark):
    from bandgraph.session import cut

    return cut(Q.panel(spark, "/root/testdata/sf0.001"))


def test_model_and_sweep(spark, panel):
    ind = Q.industries(spark, "/root/testdata/sf0.001", "n_regionkey")
    rows = runs.level_sweep(panel, Params(wavelet="sym2"), [2], [1.8], ind)
    assert len(rows) == 1 and rows[0]["n_current"] == 10 and rows[0]["n_communities"] >= 1
    assert runs.level_sweep(panel, Params(), [2], [1.8], ind, {(2, 1.8)}) == []
    with pytest.raises(ValueError):
        runs.level_sweep(panel, Params(), [1], [1.8])


def test_grid_resumes(spark, panel, tmp_path):
    grid = X.trials(spark, {"wavelet": ["sym2"], "level": [2]}, {"dense_kmeans": {"n_clusters": [3]}, "no_such": {}})
    out = runs.run_grid(panel, grid, str(tmp_path / "r"), {})
    assert sorted(r.status for r in out.collect()) == ["failed", "ok"]
    assert runs.run_grid(panel, grid, str(tmp_path / "r"), {}).count() == 3  # the failed one again


def config_of(panel, tmp_path):
    wide = panel.groupBy("t").pivot("entity").agg(F.first("px")).withColumn("t", F.date_format("t", "yyyyMMdd")).orderBy("t")
    wide.toPandas().to_csv(tmp_path / "p.csv", index=False)
    ids = sorted(r.entity for r in panel.select("entity").distinct().collect())
    (tmp_path / "info.csv").write_text("symbol,ts_code,industry\n" + "".join(f"{i},{i}.SZ,{'ab'[k % 2]}\n" for k, i in enumerate(ids)))
    universe = [{"id": f"X_{lv}_{c}", "class": lv, "name": c, "description": f"d: {c}", "category": "EQUITY", "symbols": [str(i) for k, i in enumerate(ids) if "ab"[k % 2] == c]} for lv in ("SW1", "SW2", "SW3") for c in "ab"]
    (tmp_path / "u.json").write_text(json.dumps(universe))
    config = {"data": {"panel_path": str(tmp_path / "p.csv"), "metadata_path": str(tmp_path / "info.csv"), "universe_path": str(tmp_path / "u.json")}, "params": {"wavelet": "sym2", "level": 2}}
    sinks.write_yaml(config, tmp_path / "c.yaml")
    return str(tmp_path / "c.yaml")


@pytest.fixture(scope="module")
def config(panel, tmp_path_factory):
    return config_of(panel, tmp_path_factory.mktemp("config"))


def test_sweep_command(spark, config, tmp_path):
    args = ["sweep", config, str(tmp_path), "--levels", "2", "--inflations", "1.8"]
    main(args)
    cell = tmp_path / "level_2_inflation_1p8"
    assert {p.name for p in cell.iterdir()} == {"metrics.json", "metrics.csv", "cluster_assignments.csv", "run_manifest.json"} and (tmp_path / "config_level_2_inflation_1p8.yaml").exists()
    row = json.loads((cell / "metrics.json").read_text())
    assert row["ari"] is not None and row["return_cols"] == 10 and row["price_cols"] == 10 and row["level"] == 2
    (cell / "metrics.json").write_text(json.dumps(row | {"ari": 7.0}))
    main(args)  # nothing is run again
    assert "7.0" in (tmp_path / "summary.csv").read_text(encoding="utf-8-sig")


def test_grid_and_combine_commands(spark, config, tmp_path):
    args = ["grid", config, str(tmp_path / "r" / "g"), "--wavelet", "sym2", "--levels", "2", "--clusterers", "dense_kmeans", "connected_components", "--n-clusters", "3", "--window-id", "w1", "--write-best-assignments"]
    main([*args, "--num-shards", "2", "--shard-index", "0"])
    results = str(tmp_path / "r" / "g" / "results")
    assert spark.read.parquet(results).count() == 1
    main(args)
    rows = spark.read.parquet(results).toPandas()
    assert len(rows) == 2 and set(rows.status) == {"ok"} and set(rows.window_id) == {"w1"} and rows.SW1_ari.notna().all() and (rows.n_price_cols == 10).all() and (rows.assignments_path != "").any()
    main(["combine", str(tmp_path / "r"), str(tmp_path / "all.csv")])
    assert "w1_" in (tmp_path / "all.csv").read_text(encoding="utf-8-sig")


def test_ablation_command(spark, config, tmp_path):
    main(["ablation", config, str(tmp_path / "a"), "--levels", "2", "--clusters", "3"])
    assert {"metrics.csv", "monotonicity.csv", "baseline_gate.json", "evidence_index.json", "run_manifest.json", "SW1_ari_pivot.csv", "SW3_nmi_pivot.csv"} <= {p.name for p in (tmp_path / "a").iterdir()}
    assert json.loads((tmp_path / "a" / "evidence_index.json").read_text())["status"] == "complete"


def test_a_gate_that_is_not_passed_leaves_its_evidence(spark, panel, tmp_path):
    labels = Q.industries(spark, "/root/testdata/sf0.001", "n_regionkey").select(F.lpad(F.col("entity").cast("string"), 6, "0").alias("entity"), F.col("industry").alias("label"), F.lit(False).alias("is_conflict"))
    with pytest.raises(RuntimeError):
        runs.ablation_to_files(panel, Params(wavelet="sym2"), [2], {"SW1": labels}, str(tmp_path), 3, {"n_communities": -1})
    assert json.loads((tmp_path / "run_manifest.json").read_text())["status"] == "blocked_reference_gate" and not json.loads((tmp_path / "baseline_gate.json").read_text())["passed"]
    with pytest.raises(RuntimeError):
        runs.accepted_gate(str(tmp_path / "baseline_gate.json"), True)
    with pytest.raises(FileNotFoundError):
        runs.accepted_gate(str(tmp_path / "none.json"), True)


def test_controls_command(spark, config, tmp_path):
    main(["controls", config, str(tmp_path), "--dependence-bins", "4"])
    manifest = json.loads((tmp_path / "run_manifest.json").read_text())
    assert [b["branch"] for b in manifest["branches"]] == ["raw", "market_residual_internal", "sequential", "industry_only"] and (tmp_path / "dependence" / "raw" / "cross_band_mi.csv").exists()


def test_archive_and_reference_gates(spark, panel):
    sim = runs.BandModel(panel, Params(wavelet="sym2", level=2)).similarities(True)
    mean = runs.D.mean_off_diagonal(runs.D.dependence(sim, 4)).first()[0]
    assert runs.archive_gate(sim, sim, mean, 4)["passed"]
    other = sim.withColumn("s", F.transform("s", lambda x: x + 1e-3))
    assert not runs.archive_gate(sim, other, mean, 4)["checks"]["bands_within_tolerance"] and not runs.archive_gate(sim, sim.where("i < 3"), mean, 4)["checks"]["same_pairs"]
    rows = spark.createDataFrame([(lv, b, 9, "sym2") for lv in (2, 3) for b in ("raw", "x")], "level long, branch string, n_entities long, wavelet string")
    manifest = {"formal": True, "status": "complete", "operator_reference_gate": {"passed": True}, "archive_gate": {"passed": True}}
    assert X.reference_run_gate(manifest, rows, ("raw", "x"), 9, (2, 3), {"wavelet": "sym2"})["passed"]
    assert not X.reference_run_gate(manifest | {"formal": False}, rows, ("raw", "x"), 9, (2, 3))["passed"]


def test_grid_axes_shards_and_ids(spark):
    whole = grid.expanded(spark, {"levels": [2, 3], "wavelet": ["sym2"], "gamma": [0.3, 0.4], "n_clusters": [5, 6]}, list(grid.CLUSTERERS)).collect()
    assert len(whole) == 2 * (4 + 4 + 2 + 4 + 4 + 4 + 2 + 2 + 1 + 9 + 1) and len({r.trial_id for r in whole}) == len(whole)
    shards = [grid.expanded(spark, {"levels": [2, 3], "wavelet": ["sym2"]}, ["mcl"], None, 3, k).collect() for k in range(3)]
    assert sorted(r["index"] for s in shards for r in s) == list(range(18))
    ids = spark.createDataFrame([(whole[3].trial_id,)], "trial_id string")
    assert [r.trial_id for r in grid.expanded(spark, {"levels": [2, 3], "wavelet": ["sym2"], "gamma": [0.3, 0.4], "n_clusters": [5, 6]}, list(grid.CLUSTERERS), ids).collect()] == [whole[3].trial_id]
    for bad in ({"shards": 0}, {"shards": 2, "shard": 2}, {"axes": {"no": [1]}}, {"clusterers": ["no"]}):
        with pytest.raises(ValueError):
            grid.expanded(spark, **bad)
    assert X.trial_id({"a": 1}, {"kmeans_threads": 4}) == X.trial_id({"a": 1}, {"kmeans_threads": 8})


def test_ablation_and_controls(spark, panel):
    labels = Q.industries(spark, "/root/testdata/sf0.001", "n_regionkey").select(F.lpad(F.col("entity").cast("string"), 6, "0").alias("entity"), F.col("industry").alias("label"), F.lit(False).alias("is_conflict"))
    got = runs.operator_ablation(panel, Params(wavelet="sym2"), [2], labels, 3)
    assert got.count() == 6 and got.where("ari IS NULL").count() == 0
    with pytest.raises(RuntimeError):
        runs.operator_ablation(panel, Params(wavelet="sym2"), [2], labels, 3, {"n_communities": -1})
    dep, rel = runs.factor_controls(panel, Q.industries(spark, "/root/testdata/sf0.001", "n_regionkey"), Params(wavelet="sym2", level=2), 4)
    assert {r.branch for r in rel.collect()} == {"raw", "market_residual_internal", "sequential", "industry_only"} and dep.count() == 24


def test_run_from_files(spark, panel, tmp_path):
    wide = panel.groupBy("t").pivot("entity").agg(F.first("px")).withColumn("t", F.date_format("t", "yyyyMMdd")).orderBy("t")
    wide.toPandas().to_csv(tmp_path / "p.csv", index=False)
    config = {"data": {"panel_path": str(tmp_path / "p.csv")}, "params": {"wavelet": "sym2", "level": 2}, "clusterer": "connected_components"}
    got = runs.run_experiment(spark, config, str(tmp_path / "out"))
    assert got["n_entities"] == 10 and json.loads((tmp_path / "out" / "run_manifest.json").read_text())["params"]["level"] == 2
