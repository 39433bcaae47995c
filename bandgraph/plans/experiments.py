"""Parameter grids, their ids, resuming, merging of runs, trends over levels, and gates."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Parameters that change how fast a trial is but not what it gives.
NOT_HASHED = ("kmeans_threads", "workers", "gpu")


def trial_id(feature: dict, cluster: dict) -> str:
    """First 16 hex digits of the SHA-1 of the trial's semantic parameters in canonical JSON."""
    kept = lambda d: {k: v for k, v in d.items() if k not in NOT_HASHED}
    text = json.dumps({"cluster": kept(cluster), "feature": kept(feature), "strict_no_metadata": True}, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def product(axes: dict) -> list[dict]:
    return reduce(lambda rows, kv: [r | {kv[0]: v} for r in rows for v in kv[1]], axes.items(), [{}])


def trials(spark: SparkSession, features: dict, clusterers: dict[str, dict]) -> DataFrame:
    """(index, trial_id, feature, cluster as JSON): features outer, clusterers with their own axes inner."""
    inner = [{"kind": kind} | c for kind, axes in clusterers.items() for c in product(axes)]
    rows = [(trial_id(f, c), json.dumps(f, sort_keys=True), json.dumps(c, sort_keys=True)) for f in product(features) for c in inner]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "index bigint, trial_id string, feature string, cluster string")


def chosen(grid: DataFrame, include: DataFrame | None = None, shards: int = 1, shard: int = 0, most: int | None = None) -> DataFrame:
    """Trials with a listed id, of one shard, the first `most`."""
    out = grid.join(include, "trial_id", "left_semi") if include is not None else grid
    place = F.row_number().over(Window.orderBy("index")) - 1  # a grid is a driver's list
    out = out.withColumn("place", place).where(F.pmod("place", F.lit(shards)) == shard).drop("place")
    return out.orderBy("index").limit(most) if most else out


def to_do(grid: DataFrame, done: DataFrame) -> DataFrame:
    return grid.join(done.where("status = 'ok'").select("trial_id"), "trial_id", "left_anti")


def combined(runs: list[tuple[str, DataFrame, dict]], metric: str = "SW1_ari") -> DataFrame:
    """Results of several run folders (name, rows, manifest) by name of column; of a trial the best row stays.

    Window columns come from the manifest, 'default' where it has none. Best: status ok, then the metric, then most values.
    """
    frames = []
    for name, rows, manifest in runs:
        rows = rows.withColumn("source_run", F.lit(name))
        for c in ("start_date", "end_date"):
            rows = rows.withColumn(c, F.lit(str(manifest.get(c) or "default")))
        frames.append(rows.withColumn("global_trial_id", F.concat_ws(":", "start_date", "end_date", "trial_id")))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    filled = sum((F.col(c).isNotNull().cast("int") for c in out.columns), F.lit(0))
    order = Window.partitionBy("global_trial_id").orderBy(F.desc(F.col("status") == "ok"), F.desc_nulls_last(metric), F.desc(filled), "source_run")
    return out.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place").orderBy(F.desc_nulls_last(metric), "global_trial_id")


def combined_windows(runs: list[tuple[str, DataFrame, dict]], metric: str = "SW1_ari", dedupe: bool = True) -> DataFrame:
    """Results of run folders by name of column, the best metric first; rows that lack them have the folder's window.

    window_id is the manifest's, else the folder's name; window_start and window_end are the manifest's dates. Trials have
    global_trial_id, window and trial together; of a repeated one the best row stays (status ok, then the metric, then most
    values), unless dedupe is off; rows without a trial all stay.
    """
    frames = []
    for name, rows, manifest in runs:
        window = {"window_id": manifest.get("window_id") or name, "window_start": manifest.get("start_date") or "", "window_end": manifest.get("end_date") or ""}
        for c, default in window.items():
            rows = rows.withColumn(c, F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(str(default))) if c in rows.columns else F.lit(str(default)))
        frames.append(rows.withColumn("global_trial_id", F.concat_ws("_", "window_id", "trial_id")) if "trial_id" in rows.columns else rows)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    value = F.col(metric).try_cast("double") if metric in out.columns else F.lit(None).cast("double")
    if dedupe and "global_trial_id" in out.columns:
        ok = (F.col("status") == "ok") if "status" in out.columns else F.lit(False)
        filled = sum((F.col(c).isNotNull().cast("int") for c in out.columns), F.lit(0))
        order = Window.partitionBy("global_trial_id").orderBy(F.desc(F.coalesce(ok, F.lit(False))), F.desc_nulls_last("_value"), F.desc("_filled"), "_result_dir")
        out = out.withColumns({"_value": value, "_filled": filled}).withColumn("_place", F.row_number().over(order))
        out = out.where("_place = 1 OR global_trial_id IS NULL").drop("_value", "_filled", "_place")
    return out.orderBy(F.desc_nulls_last(value))


def monotonicity(rows: DataFrame, levels: tuple[int, ...] = (2, 3, 4, 5, 6)) -> DataFrame:
    """(operator, n_levels, start, end, rho, trend) of (operator, level, ari)."""
    order = Window.partitionBy("operator").orderBy("level")
    rank = lambda c: F.rank().over(Window.partitionBy("operator").orderBy(c)) + (F.count("*").over(Window.partitionBy("operator", c)) - 1) / 2.0
    r = rows.where(F.col("level").isin(*levels) & F.col("ari").isNotNull()).withColumns({"step": F.col("ari") - F.lag("ari").over(order), "rl": rank("level"), "ra": rank("ari")})
    out = r.groupBy("operator").agg(F.count("*").alias("n_levels"), F.min_by("ari", "level").alias("start"), F.max_by("ari", "level").alias("end"), F.corr("rl", "ra").alias("rho"), F.every(F.coalesce(F.col("step") < 0, F.lit(True))).alias("down"))
    trend = F.when(F.col("n_levels") < len(levels), "incomplete").when(F.col("down"), "strictly_preserved").when((F.col("end") < F.col("start")) & (F.col("rho") <= -0.9), "direction_preserved").otherwise("not_preserved")
    return out.select("operator", "n_levels", "start", "end", "rho", trend.alias("trend"))


def gate(found: dict, wanted: dict, tolerance: float = 1e-9) -> dict:
    """{'passed', 'checks': {name: {found, wanted, passed}}}."""
    ok = lambda a, b: a is not None and (abs(a - b) <= tolerance if isinstance(b, float) else a == b)
    checks = {k: {"found": found.get(k), "wanted": v, "passed": bool(ok(found.get(k), v))} for k, v in wanted.items()}
    return {"passed": all(c["passed"] for c in checks.values()), "checks": checks}


def reference_run_gate(manifest: dict, rows: DataFrame, branches: tuple[str, ...], entities: int, levels: tuple[int, ...] = (2, 3, 4, 5, 6), fixed: dict | None = None) -> dict:
    """Whether a control run is complete and as it was set up: its gates, levels, branches, rows, entities and parameters."""
    values = {c: {r[0] for r in rows.select(c).distinct().collect()} for c in ("level", "branch", "n_entities", *(fixed or {}))}
    found = {"formal_complete": manifest.get("formal") is True and manifest.get("status") == "complete", "operator_gate": (manifest.get("operator_reference_gate") or {}).get("passed") is True, "archive_gate": (manifest.get("archive_gate") or {}).get("passed") is True,
             "levels": values["level"] == set(levels), "branches": values["branch"] == set(branches), "rows": rows.count() == len(levels) * len(branches), "entities": values["n_entities"] == {entities}, "fixed": all(values[c] == {v} for c, v in (fixed or {}).items())}
    return {"passed": all(found.values()), "checks": {k: {"found": v, "wanted": True, "passed": v} for k, v in found.items()}}


def require(result: dict) -> None:
    if not result["passed"]:
        raise RuntimeError(f"gate not passed: {[k for k, c in result['checks'].items() if not c['passed']]}")
