"""Cross-band scores of pairs (i, j, s), as edges (i, j, w), and affinities made from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from bandgraph.functions import vectors as V
from bandgraph.operators.ranks import quantiles
from bandgraph.params import check_signed

#: Presets: name to (reducer, layer weighting).
PRESETS = {"max_weighted": ("max", True), "mean_weighted": ("mean", True), "median_weighted": ("median", True), "geometric_weighted": ("geometric", True), "max_unweighted": ("max", False), "mean_unweighted": ("mean", False)}


def threshold(sim: DataFrame, entities: int, q: float) -> DataFrame:
    """One row tau: max(0, quantile q over all entries of the full matrices of all bands), their zero diagonals and both triangles too."""
    rows = sim.select(F.explode("s").alias("x"), F.lit(2).cast("bigint").alias("n"))
    bands = sim.select(F.size("s").alias("b")).limit(1)
    zeros = bands.select(F.lit(0.0).alias("x"), (F.col("b") * entities).cast("bigint").alias("n"))
    (tau,) = quantiles(rows.union(zeros), [q])
    return sim.sparkSession.createDataFrame([(max(tau or 0.0, 0.0),)], "tau double")


def adjacency(sim: DataFrame, tau: DataFrame, layer_step: float) -> DataFrame:
    """Edges whose approximation and some detail are both over tau; w is the greatest (layer_step l + 1) sqrt(low high) of those."""
    low, details = F.get("s", F.lit(0)), F.slice("s", F.lit(2), F.size("s") - 1)
    both = sim.join(F.broadcast(tau))
    w = F.transform(details, lambda x, i: F.when((low > F.col("tau")) & (x > F.col("tau")), (F.lit(layer_step) * (i + 1) + 1) * F.sqrt(V.positive(low) * V.positive(x))))
    return both.select("i", "j", F.array_max(w).alias("w")).where("w > 0")


def adjacency_stats(edges: DataFrame, entities: int) -> DataFrame:
    pairs = entities * (entities - 1) // 2
    return edges.agg(F.count("*").alias("n_edges"), (F.count("*") / F.lit(pairs) if pairs else F.lit(0.0)).alias("edge_density"), F.lit(entities).cast("bigint").alias("n_entities"))


def dense_score(sim: DataFrame, layer_step: float) -> DataFrame:
    """w for every pair: the greatest (layer_step l + 1) sqrt(low+ high+)."""
    return sim.select("i", "j", F.array_max(V.weighted(V.signed_terms(F.col("s"), 0.0), layer_step)).alias("w"))


def dense_values(s: np.ndarray, layer_step: float, places: int | None = None) -> np.ndarray:
    """What dense_score gives, for similarities [bands, pairs]; places: decimals that it is rounded to, half up."""
    low, w = np.maximum(s[0], 0.0), np.zeros(s.shape[1])
    for i, x in enumerate(s[1:]):
        w = np.maximum(w, (layer_step * (i + 1) + 1) * np.sqrt(low * np.maximum(x, 0.0)))
    return w if places is None else V.half_up(w, places)


def signed_terms(sim: DataFrame, negative_weight: float) -> DataFrame:
    """(i, j, terms), to persist where several reducers are wanted."""
    return sim.select("i", "j", V.signed_terms(F.col("s"), negative_weight).alias("terms"))


def signed_scores(terms: DataFrame, layer_step: float, presets: dict[str, tuple[str, bool]]) -> DataFrame:
    """(i, j, a column for each preset), in one pass over the terms."""
    for reducer, weighting in presets.values():
        check_signed(layer_step, 0.0, reducer, weighting)
    weighted = V.weighted(F.col("terms"), layer_step)
    return terms.select("i", "j", *(V.reduced(weighted if weighting else F.col("terms"), reducer).alias(name) for name, (reducer, weighting) in presets.items()))


def signed_score(sim: DataFrame, layer_step: float = 1.5, negative_weight: float = 1.25, reducer: str = "max", layer_weighting: bool = True, interaction: str = "sqrt") -> DataFrame:
    check_signed(layer_step, negative_weight, reducer, layer_weighting, interaction)
    return signed_scores(signed_terms(sim, negative_weight), layer_step, {"w": (reducer, layer_weighting)})


def _scaled(edges: DataFrame) -> DataFrame:
    top = edges.agg(F.max("w").alias("top"))
    return edges.join(F.broadcast(top))


def normalized_affinity(edges: DataFrame) -> DataFrame:
    """w in 0 to 1, by the greatest; diagonals are 1 and not kept."""
    w = V.positive(F.col("w"))
    return _scaled(edges).select("i", "j", F.when(F.col("top") > 0, w / F.col("top")).otherwise(w).alias("w"))


def power_affinity(edges: DataFrame, gamma: float) -> DataFrame:
    a = normalized_affinity(edges)
    return a if gamma == 1 else a.withColumn("w", F.pow("w", F.lit(gamma)))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions, as (a, b, w): one pass that gives two rows of each."""
    ends = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e")
    return edges.select(ends, "w").select("e.a", "e.b", "w")


def topk_affinity(edges: DataFrame, k: int, gamma: float) -> DataFrame:
    """Edges among the k strongest of either end, ties by the other's id."""
    order = Window.partitionBy("a").orderBy(F.desc("w"), "b")
    kept = both_ways(power_affinity(edges, gamma)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 1))
    return kept.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.max("w").alias("w"))


def distance(edges: DataFrame) -> DataFrame:
    """1 - w / greatest w; 1 for all if there is no positive w."""
    return _scaled(edges).select("i", "j", F.when(F.col("top") > 0, 1 - V.positive(F.col("w")) / F.col("top")).otherwise(1.0).alias("d"))
