"""Label tables, alignment of clusters with labels, agreement measures and cluster statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bandgraph.functions.keys import entity_code, label_after_colon, label_level


def normal_universe(values: DataFrame, column: str = "entity") -> DataFrame:
    """(entity, place) of the distinct codes of a column, without empty ones, in order of their first rows."""
    rows = values.select(entity_code(F.col(column)).alias("entity"), F.monotonically_increasing_id().alias("row")).where("entity <> ''")
    first = rows.groupBy("entity").agg(F.min("row").alias("place"))
    return first.orderBy("place")


def label_table(universe: DataFrame, level: str, category: str = "equity") -> DataFrame:
    """(entity, level, label, is_conflict, conflict_labels, ids, n_ids) of universe (id, class, name, description, category, symbols)."""
    rows = universe.where(F.lower("category") == category).select("id", label_level(F.col("class"), F.col("id"), F.col("name")).alias("level"), label_after_colon(F.col("description"), F.col("name")).alias("label"), F.explode("symbols").alias("symbol"))
    rows = rows.where((F.col("level") == level) & (F.col("label") != "")).select("id", "label", entity_code(F.col("symbol")).alias("entity")).where("entity <> ''")
    labels, ids = F.array_sort(F.collect_set("label")), F.array_sort(F.collect_set("id"))
    out = rows.groupBy("entity").agg(labels.alias("labels"), ids.alias("all_ids"))
    conflict = F.size("labels") > 1
    return out.select("entity", F.lit(level).alias("level"), F.when(~conflict, F.get("labels", F.lit(0))).alias("label"), conflict.alias("is_conflict"), F.when(conflict, F.array_join("labels", "|")).otherwise("").alias("conflict_labels"), F.array_join("all_ids", "|").alias("ids"), F.size("all_ids").alias("n_ids"))


def aligned_labels(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """assignments (entity, cluster_id) with label and is_labeled, by normalised code; entities without a code go."""
    keyed = assignments.select(entity_code(F.col("entity")).alias("entity"), F.col("cluster_id").cast("string").alias("cluster_id")).where("entity <> ''")
    out = keyed.join(labels.select("entity", "label", "is_conflict"), "entity", "left").withColumn("is_conflict", F.coalesce("is_conflict", F.lit(False)))
    return out.withColumn("is_labeled", F.col("label").isNotNull() & ~F.col("is_conflict"))


def matched(archived: DataFrame, current: DataFrame) -> DataFrame:
    """(entity, archived, current) of two assignments with the same entities, once each; anything else is an error."""
    for df in (archived, current):
        if df.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ValueError("an entity occurs twice")
    out = archived.select("entity", F.col("cluster_id").alias("archived")).join(current.select("entity", F.col("cluster_id").alias("current")), "entity", "full")
    if out.where("archived IS NULL OR current IS NULL").limit(1).count():
        raise ValueError("the entities differ")
    return out


def contingency(frame: DataFrame, label: str = "label", cluster: str = "cluster_id") -> DataFrame:
    return frame.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster_id")).agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """One row ari, nmi, n, n_labels, n_clusters of a contingency table (label, cluster_id, n); null without rows.

    ARI by pair counts and NMI with the arithmetic mean of entropies, natural logarithms; both are 1 if label and cluster are
    each a single group, ARI also if each group is a single entity.
    """
    both = table.withColumns({"a": F.sum("n").over(Window.partitionBy("label")), "b": F.sum("n").over(Window.partitionBy("cluster_id"))})
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    total = table.agg(F.sum("n").alias("total"))
    sums = both.join(F.broadcast(total)).agg(
        F.max("total").alias("n"), F.sum(pairs("n")).alias("s"),
        F.sum(F.col("n") * (F.col("a") - 1) / 2.0).alias("sa"), F.sum(F.col("n") * (F.col("b") - 1) / 2.0).alias("sb"),
        F.sum(F.col("n") / F.col("total") * F.ln(F.col("total") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(F.col("n") / F.col("total") * F.ln(F.col("a") / F.col("total")))).alias("ha"), (-F.sum(F.col("n") / F.col("total") * F.ln(F.col("b") / F.col("total")))).alias("hb"),
        F.count_distinct("label").alias("n_labels"), F.count_distinct("cluster_id").alias("n_clusters"),
    )
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("n") * (F.col("n") - 1) / 2.0)
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    ari = F.when(F.col("n").isNull(), F.lit(None)).when((F.col("n") == 1) | (F.coalesce(top, F.lit(0.0)) == 0), 1.0).otherwise(F.try_divide(F.col("s") - expected, top))
    h = (F.col("ha") + F.col("hb")) / 2
    nmi = F.when(F.col("n").isNull(), F.lit(None)).when((F.col("n_labels") == 1) & (F.col("n_clusters") == 1), 1.0).when(h == 0, 0.0).otherwise(F.greatest(F.try_divide(F.col("mi"), h), F.lit(0.0)))
    return sums.select(ari.alias("ari"), nmi.alias("nmi"), "n", "n_labels", "n_clusters")


def industry_metrics(universe: DataFrame, assignments: DataFrame, industries: DataFrame) -> DataFrame:
    """ari, nmi, n_current, n_used, n_unlabeled, n_clusters, n_labels, coverage; universe (entity) is left-joined with both."""
    frame = universe.select("entity").distinct().join(assignments.select("entity", "cluster_id"), "entity", "left").join(industries.select("entity", F.col("industry").alias("label")), "entity", "left")
    counts = frame.agg(F.count("*").alias("n_current"), F.count_if(F.col("cluster_id").isNotNull() & F.col("label").isNotNull()).alias("n_used"), F.count_if(F.col("label").isNull()).alias("n_unlabeled"))
    score = agreement(contingency(frame.where("cluster_id IS NOT NULL AND label IS NOT NULL")))
    return score.join(F.broadcast(counts)).select("ari", "nmi", "n_current", "n_used", "n_unlabeled", "n_clusters", "n_labels", F.try_divide("n_used", "n_current").alias("coverage"))


def level_metrics(assignments: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """A row (level, ari, nmi, n, ...) for each level's label table, and one 'mean' of those that are finite."""
    rows = None
    for level, labels in tables.items():
        one = agreement(contingency(aligned_labels(assignments, labels).where("is_labeled"))).select(F.lit(level).alias("level"), "*")
        rows = one if rows is None else rows.unionByName(one)
    mean = rows.agg(F.lit("mean").alias("level"), F.avg("ari").alias("ari"), F.avg("nmi").alias("nmi"))
    return rows.unionByName(mean, allowMissingColumns=True)


def cluster_stats(assignments: DataFrame) -> DataFrame:
    sizes = assignments.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_communities"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.max("n").alias("largest"), F.median("n").alias("median_size"))
