"""Mixing sources to target weights by weighted fair queueing [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandgraph.llm.common import SPACED_WORD, own_names, quoted, without
from bandgraph.session import cut, table

WEIGHTS, BUDGET_SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: The shuffled order is cut into this many slices for the prefix sums, so a hot source is summed by many tasks.
SLICES = 4096
#: Virtual time is cut into this many steps for the global truncation.
STEPS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size): water filling under caps.

    Sources in order of code points, null last, get weights in turn. The budget is share times all sizes; a source gets
    budget by weight, at most epochs times its size, and what is above goes to the others by weight. In order of
    cap / weight, the first source k whose level (budget - earlier caps) / (weights from k on) fits under its own cap
    fixes the level. The windows without partitions see one row per source, after the sums. An empty source has target 0.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    per = per.withColumn("cap", F.col("source_size") * epochs)
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.col("before")) / F.col("left")
    per = per.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    fixed = F.min(F.when(F.col("fits"), F.struct("before", "level"))).over(every)["level"]
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(fixed * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, size: Column, weights=WEIGHTS, share: float = BUDGET_SHARE, epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies (passes taken, 0 to epochs) and taken (size * copies).

    Each source is shuffled by a hash of seed and id; the document's finish time in pass e is (its source's tokens up to
    and with it, over passes) / target. All passes of all documents, in order of finish time, are taken while their
    total stays within the budget. Both running sums are in two levels - slice sums, a window over those, a window within
    a slice - so no task holds a source or the whole. Sums are of integers: reruns agree.

    Nulls: a null source is a source of its own, last; a null id hashes as ''; a null or empty text has size 0 and
    copies 0. Repeated rows are rows of their own: a count says how often (id, source, size) occurs, ties are taken
    together. Clashing column names: the columns added here replace columns of the same name. Empty table: no rows.
    """
    words_, t_source, t_size, t_target, g_id, g_source, g_size, g_copies = own_names(docs, "words", "t_source", "t_size", "t_target", "g_doc_id", "g_source", "g_size", "g_copies")
    base = docs.withColumn(words_, F.coalesce(size, F.lit(0)).cast("bigint"))
    slim = base.select("doc_id", "source", F.col(words_).alias("size"))
    aim = cut(targets(slim, weights, share, epochs))
    t = aim.select(F.col("source").alias("t_source"), "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("t_source"))
    # Distinct (id, source, size), with how often each occurs.
    rows = slim.where("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    rows = rows.withColumn("u", F.md5(F.concat_ws("-", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = cut(rows.withColumn("words", F.col("size") * F.col("times")).withColumn("slice", F.conv(F.substring("u", 1, 8), 16, 10).cast("bigint") % SLICES))
    per = rows.groupBy("source", "slice").agg(F.sum("words").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")
    per = per.select(F.col("source").alias("p_source"), F.col("slice").alias("p_slice"), before.alias("before"))
    # u's slice is a hash, so the order within a source is (slice, u, id, size), which is as shuffled as u.
    inner = F.sum("words").over(Window.partitionBy("source", "slice").orderBy("u", "doc_id", "size"))
    done = rows.withColumn("done", inner).join(per, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice")))
    done = done.join(t, same).where("target > 0")
    finish = (F.col("epoch") * F.col("source_size") + F.col("before") + F.col("done")) / F.col("target")
    passes = done.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs))))).withColumn("finish", finish)
    # Nothing after the latest finish, epochs * size / target, which is 2 or less for a capped source and more for others.
    passes = passes.withColumn("step", F.least(F.floor(F.col("finish") * (STEPS // 2)), F.lit(STEPS * 4)).cast("int"))
    passes = cut(passes.select("doc_id", "source", "size", "words", "u", "epoch", "finish", "step"))
    steps = passes.groupBy("step").agg(F.sum("words").alias("n"))
    steps = steps.select(F.col("step").alias("s_step"), "n", F.sum("n").over(Window.orderBy("step")).alias("upto"))
    budget = aim.agg(F.round(F.sum("target")).cast("bigint").alias("budget"))
    steps = cut(steps.join(F.broadcast(budget)).select("s_step", "n", "upto", "budget"))  # one row joined to STEPS rows
    whole = F.col("upto") <= F.col("budget")
    cross = steps.where(~whole).agg(F.min("s_step").alias("s_step")).join(steps, "s_step")
    full = passes.join(F.broadcast(steps.where(whole).select(F.col("s_step").alias("step"))), "step", "left_semi")
    # Within the one step where the budget ends, finish times again in slices.
    edge = passes.join(F.broadcast(cross), F.col("step") == F.col("s_step"))
    edge = edge.withColumn("room", F.col("budget") - F.col("upto") + F.col("n")).withColumn("part", F.floor((F.col("finish") * (STEPS // 2) - F.col("step")) * SLICES).cast("bigint"))
    parts = edge.groupBy("part").agg(F.sum("words").alias("pn"))
    parts = parts.select("part", (F.sum("pn").over(Window.orderBy("part")) - F.col("pn")).alias("pb"))
    running = F.sum("words").over(Window.partitionBy("part").orderBy("finish", F.col("source").asc_nulls_last(), "u", "doc_id", "size", "epoch"))
    edge = edge.join(parts, "part").withColumn("run", running + F.col("pb")).where("run <= room")
    keys = ("doc_id", "source", "size")
    got = full.select(*keys).union(edge.select(*keys)).groupBy(*keys).agg(F.count("*").alias("copies"))
    got = got.select(F.col("doc_id").alias(g_id), F.col("source").alias(g_source), F.col("size").alias(g_size), F.col("copies").alias(g_copies))
    aim = aim.select(F.col("source").alias(t_source), F.col("source_size").alias(t_size), F.col("target").alias(t_target))
    out = base.join(got, F.col("doc_id").eqNullSafe(F.col(g_id)) & F.col("source").eqNullSafe(F.col(g_source)) & (F.col(words_) == F.col(g_size)), "left")
    out = out.join(aim, F.col("source").eqNullSafe(F.col(t_source)), "left")
    copies = F.coalesce(g_copies, F.lit(0)).cast("bigint")
    kept = map(quoted, without(docs, "size", "source_size", "target", "copies", "taken"))
    return out.select(*kept, F.col(words_).alias("size"), F.col(t_size).alias("source_size"), F.col(t_target).alias("target"), copies.alias("copies"), (F.col(words_) * copies).alias("taken"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, source_size * 2 AS cap, ([5, 2, 1])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk FROM per
), lv AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
     / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl,
     coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM ranked
), fixed AS (
  SELECT lvl AS l FROM lv WHERE lvl * weight <= cap ORDER BY bef, lvl LIMIT 1
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT l FROM fixed) * weight, cap::DOUBLE)) AS target FROM lv
), e AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, md5('mix-1-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), cum AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(u, 1, 8))::BIGINT % 4096, u, doc_id, size
                            ROWS UNBOUNDED PRECEDING) AS done FROM e WHERE size > 0
), passes AS (
  SELECT doc_id, source, size, u, ep, (ep * source_size + done)::DOUBLE / target AS finish
  FROM cum, (VALUES (0), (1)) AS p(ep) WHERE target > 0
), run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, u, doc_id, size, ep ROWS UNBOUNDED PRECEDING) AS r FROM passes
), got AS (
  SELECT doc_id, source, size, count(*) AS copies FROM run WHERE r <= (SELECT round(sum(target)) FROM t) GROUP BY ALL
)
SELECT e.doc_id, e.size, e.source_size, e.target, CAST(e.size * coalesce(copies, 0) AS BIGINT) AS taken
FROM e LEFT JOIN got ON e.doc_id IS NOT DISTINCT FROM got.doc_id AND e.source IS NOT DISTINCT FROM got.source AND e.size = got.size
"""
