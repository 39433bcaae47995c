"""Clusterings that stay distributed: connected components and Markov clustering on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bandgraph.session import Scratch, cut


def components(links: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(node, comp): comp is the smallest node reachable over links; nodes without a link are left out.

    Min-label propagation with pointer jumping: minima are combined before each shuffle, joins are split by AQE where
    a hub is hot, and every round is cut in the shared folder, so neither lineage nor a driver list grows.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    with Scratch(links.sparkSession) as scratch:
        edges = cut(pairs.union(pairs.select("b", "a")).distinct())
        labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
        while True:
            near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
            step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
            up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            step = cut(step.join(up, "comp").select("node", "old", F.least("comp", "top").alias("comp")))
            scratch.free(labels)
            if step.where("comp <> old").isEmpty():
                return scratch.keep(step).select("node", "comp")
            labels = step.select("node", "comp")
            labels._cut = step._cut


def assigned(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, cluster_id) of all entities; those without a label are their own cluster."""
    own = F.coalesce("comp", "entity").cast("string")
    return entities.select("entity").distinct().join(labels, F.col("entity") == F.col("node"), "left").select("entity", own.alias("cluster_id"))


def _normalized(flow: DataFrame) -> DataFrame:
    return flow.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("col")))


def start_flow(edges: DataFrame, entities: DataFrame, loop: float = 1.0) -> DataFrame:
    """(row, col, p): columns add up to 1; the diagonal is `loop` before that."""
    ends = F.explode(F.array(F.struct(F.col("i").alias("row"), F.col("j").alias("col")), F.struct(F.col("j").alias("row"), F.col("i").alias("col")))).alias("e")
    off = edges.where("w <> 0").select(ends, "w").select("e.row", "e.col", F.col("w").cast("double").alias("p"))
    loops = entities.select(F.col("entity").alias("row"), F.col("entity").alias("col"), F.lit(float(loop)).alias("p"))
    return _normalized(off.unionByName(loops))


def mcl_step(flow: DataFrame, inflation: float, pruning: float) -> DataFrame:
    """Square, element power, columns to sum 1, then entries of at least `pruning` and each column's greatest (least row of ties)."""
    right = flow.select(F.col("row").alias("k"), F.col("col").alias("to"), F.col("p").alias("q"))
    squared = flow.join(right, F.col("col") == F.col("k")).groupBy("row", F.col("to").alias("col")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    raised = _normalized(squared.withColumn("p", F.pow("p", F.lit(inflation))))
    if pruning <= 0:
        return raised
    first = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("p"), "row"))
    return raised.withColumn("_first", first).where((F.col("p") >= pruning) | (F.col("_first") == 1)).drop("_first")


def mcl(edges: DataFrame, entities: DataFrame, inflation: float = 2.0, squarings: int = 1, loop: float = 1.0, iterations: int = 100, pruning: float = 1e-3, tolerance: float = 1e-9) -> DataFrame:
    """The flow at rest, or after `iterations`. A round squares `squarings` times; rest is an L1 change below tolerance."""
    flow = cut(start_flow(edges, entities, loop))
    for _ in range(iterations):
        now = flow
        for _ in range(squarings - 1):
            now = mcl_step(now, 1.0, 0.0)
        now = cut(mcl_step(now, inflation, pruning))
        before = flow.select("row", "col", F.col("p").alias("q"))
        change = now.join(before, ["row", "col"], "full").agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("d")).first().d
        flow = now
        if (change or 0.0) < tolerance:
            break
    return flow


def mcl_labels(flow: DataFrame, entities: DataFrame, least: float = 1e-7) -> DataFrame:
    """(entity, cluster_id): the attractor with the greatest entry in an entity's column. Attractors have a diagonal over
    `least` (all entities if none has); entities without an entry over it are their own cluster."""
    diagonal = flow.where((F.col("row") == F.col("col")) & (F.col("p") > least)).select("row")
    rows = flow if diagonal.isEmpty() else flow.join(diagonal, "row", "left_semi")
    best = rows.where(F.col("p") > least).groupBy(F.col("col").alias("node")).agg(F.min(F.struct((-F.col("p")).alias("q"), "row"))["row"].alias("comp"))
    return assigned(best, entities)


def by_strength(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, entity, strength, place): members by their edges' weight within the cluster, the strongest first."""
    ends = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e")
    both = edges.select(ends, "w").select("e.a", "e.b", "w")
    c = lambda k: assignments.select(F.col("entity").alias(k), F.col("cluster_id").alias(f"c{k}"))
    inside = both.join(c("a"), "a").join(c("b"), "b").where("ca = cb").groupBy(F.col("a").alias("entity")).agg(F.sum("w").alias("strength"))
    out = assignments.join(inside, "entity", "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("strength"), "entity")))
