"""The grid of trials: which axes a feature and each clusterer have, what a trial runs, and what a result row holds."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from bandgraph.params import Params
from bandgraph.plans import experiments as X

#: A feature's axes in their order, with defaults.
FEATURE_AXES = {"wavelet_transform": ["modwt"], "wavelet": ["db4", "sym2", "sym4", "coif1"], "levels": [2, 3, 4, 5, 6], "q_threshold": [0.996], "winsor_limit": [0.03], "return_mode": ["raw"], "k": [0.0]}
#: Axes of the clusterers with their defaults, and constants that every trial of a clusterer names.
CLUSTER_AXES = {"top_k": [80], "gamma": [0.3], "neg_weight": [0.5], "n_clusters": [380], "n_landmarks": [512], "linkage": ["average"], "resolution": [0.1], "inflation": [round(1.2 + 0.2 * i, 1) for i in range(9)], "pruning_threshold": [0.05]}
CONSTANTS = {"assign_labels": "kmeans", "kmeans_n_init": 1, "kmeans_max_iter": 40, "kmeans_threads": 4, "seed": 42}
#: What a clusterer takes, axes first (the first outermost), then constants.
CLUSTERERS = {
    "dense_spectral_power": "gamma n_clusters assign_labels seed",
    "dense_spectral_signed_dual_power": "gamma neg_weight n_clusters assign_labels seed",
    "dense_spectral_assign": "n_clusters assign_labels seed",
    "knn_spectral": "top_k gamma n_clusters assign_labels seed",
    "nystrom_spectral_power": "gamma n_clusters n_landmarks kmeans_n_init kmeans_max_iter kmeans_threads seed",
    "nystrom_spectral_signed_dual_power": "gamma neg_weight n_clusters n_landmarks kmeans_n_init kmeans_max_iter kmeans_threads seed",
    "dense_kmeans": "n_clusters seed",
    "dense_agglomerative": "n_clusters linkage",
    "louvain": "resolution seed",
    "mcl": "inflation pruning_threshold seed",
    "connected_components": "seed",
}
#: What a trial's names are called by the operators.
_OPTIONS = {"n_landmarks": "landmarks", "assign_labels": "assign", "top_k": "k"}


def expanded(spark: SparkSession, axes: dict | None = None, clusterers: list[str] = ("dense_spectral_power",), ids: DataFrame | None = None, shards: int = 1, shard: int = 0, most: int | None = None) -> DataFrame:
    """(index, trial_id, feature, cluster): features outer, clusterers with their own axes inner; then the listed ids, one
    shard of those, and its first `most`. axes override the defaults by name, axes and constants alike."""
    if shards < 1 or not 0 <= shard < shards:
        raise ValueError("shards must be at least 1, and a shard at least 0 and below it")
    given = FEATURE_AXES | CLUSTER_AXES | {k: [v] for k, v in CONSTANTS.items()} | (axes or {})
    if unknown := [c for c in clusterers if c not in CLUSTERERS] + [a for a in axes or {} if a not in FEATURE_AXES | CLUSTER_AXES | CONSTANTS]:
        raise ValueError(f"unknown: {unknown}")
    inner = [{"clusterer": c} | r for c in clusterers for r in X.product({a: given[a] if isinstance(given[a], (list, tuple)) else [given[a]] for a in CLUSTERERS[c].split()})]
    rows = [(X.trial_id(f, c), json.dumps(f, sort_keys=True), json.dumps(c, sort_keys=True)) for f in X.product({a: given[a] for a in FEATURE_AXES}) for c in inner]
    grid = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "index bigint, trial_id string, feature string, cluster string")
    return X.chosen(grid, ids, shards, shard, most)


def feature_params(feature: dict, base: Params = Params()) -> tuple[Params, str]:
    """Parameters and return mode of a trial's feature."""
    names = {"wavelet_transform": "decomposition", "levels": "level", "q_threshold": "quantile", "k": "layer_step"}
    values = {names.get(k, k): v for k, v in feature.items() if k not in ("winsor_limit", "return_mode", "mode")}
    if "winsor_limit" in feature:
        values |= {"winsor_low": feature["winsor_limit"], "winsor_high": feature["winsor_limit"]}
    return replace(base, **values), feature.get("return_mode", feature.get("mode", "raw"))


def cluster_options(cluster: dict) -> tuple[str, dict, dict]:
    """(clusterer, its operator's options, parameters of the model that it changes)."""
    kind = cluster.get("clusterer", cluster.get("kind"))
    takes = {"n_clusters", "gamma", "linkage", "resolution", "landmarks", "assign", "k", "seed", "inflation"}
    renamed = {_OPTIONS.get(k, k): v for k, v in cluster.items()}
    options = {k: v for k, v in renamed.items() if k in takes and not (kind in ("mcl", "connected_components", "dense_agglomerative") and k == "seed")}
    model = {"negative_weight": cluster["neg_weight"]} if "neg_weight" in cluster else {}
    if "pruning_threshold" in cluster:
        model["pruning"] = cluster["pruning_threshold"]
    return kind, options, model


#: Columns of a result row beside the metrics.
ROW = "trial_id string, status string, started_at string, window_id string, window_start string, window_end string, feature string, wavelet_transform string, wavelet string, levels bigint, q_threshold double, winsor_limit double, return_mode string, k double, cluster string, clusterer string, clusterer_params string, gamma double, neg_weight double, top_k bigint, n_landmarks bigint, n_clusters_requested bigint, assign_labels string, resolution double, inflation double, pruning_threshold double, seed bigint, n_price_rows bigint, n_price_cols bigint, assignments_path string, error_type string, error_message string"
METRICS = "n_communities bigint, n_singletons bigint, largest bigint, median_size double, n_edges bigint, edge_density double, seconds double"


def base_row(trial, started: str, window: tuple[str, str, str], shape: tuple[int, int]) -> dict:
    """A trial's row before it has run."""
    f, c = json.loads(trial.feature), json.loads(trial.cluster)
    kept = {k: c[k] for k in ("gamma", "neg_weight", "top_k", "n_landmarks", "assign_labels", "resolution", "inflation", "pruning_threshold", "seed") if k in c}
    names = dict(zip(("window_id", "window_start", "window_end"), window, strict=True))
    return f | kept | names | {
        "trial_id": trial.trial_id, "status": "running", "started_at": started, "feature": trial.feature, "cluster": trial.cluster, "clusterer": c.get("clusterer", c.get("kind")),
        "clusterer_params": trial.cluster, "n_clusters_requested": c.get("n_clusters"), "n_price_rows": shape[0], "n_price_cols": shape[1], "assignments_path": "", "error_type": "", "error_message": "",
    }
