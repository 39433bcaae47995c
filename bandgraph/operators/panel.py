"""Panels (entity, t, px): grid, forward fill, calendars, eligibility, log returns and trims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def by_entity():
    return Window.partitionBy("entity").orderBy("t")


def unpivot(wide: DataFrame, date: str | None = None) -> DataFrame:
    """A wide table (a date column, a column for each entity) as a panel; columns never become rows of a schema again."""
    date = date or wide.columns[0]
    values = [c for c in wide.columns if c != date]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("entity"), F.col(f"`{c}`").cast("double").alias("px")) for c in values)))
    long = wide.select(F.col(f"`{date}`").cast("timestamp").alias("t"), cells.alias("cell")).select("t", "cell.*")
    return long.where("t IS NOT NULL AND px IS NOT NULL AND NOT isnan(px)").select("entity", "t", "px")


def grid(panel: DataFrame) -> DataFrame:
    """Every entity at every date of the panel; px is null where the panel has none. The dates are few and broadcast by AQE."""
    dates, entities = panel.select("t").distinct(), panel.select("entity").distinct()
    return entities.crossJoin(dates).join(panel, ["entity", "t"], "left")


def forward_filled(panel: DataFrame) -> DataFrame:
    """The grid with filled, the last px so far."""
    rows = by_entity().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid(panel).withColumn("filled", F.last("px", ignorenulls=True).over(rows))


def raw_log_returns(panel: DataFrame) -> DataFrame:
    """(entity, t, r) on the whole grid; r is null where there is no earlier or no positive price."""
    log = F.when(F.col("filled") > 0, F.ln("filled"))
    return forward_filled(panel).withColumn("log", log).select("entity", "t", (F.col("log") - F.lag("log").over(by_entity())).alias("r"))


def dense(returns: DataFrame) -> DataFrame:
    """Without dates and then entities that have no value; other nulls become 0."""
    dates = returns.groupBy("t").agg(F.count("r").alias("n")).where("n > 0").select("t")
    kept = returns.join(dates, "t", "left_semi")
    entities = kept.groupBy("entity").agg(F.count("r").alias("n")).where("n > 0").select("entity")
    return kept.join(entities, "entity", "left_semi").select("entity", "t", F.coalesce("r", F.lit(0.0)).alias("r"))


def log_returns(panel: DataFrame) -> DataFrame:
    return dense(raw_log_returns(panel))


def sparse_trim(returns: DataFrame, ratio: float) -> DataFrame:
    """Dates from the first on that has at least max(2, floor(ratio * most values of a date)) values, if there is one."""
    counts = returns.groupBy("t").agg(F.count("r").alias("n"))
    least = counts.agg(F.greatest(F.lit(2), F.floor(F.max("n") * F.lit(ratio))).alias("least"))
    start = counts.join(F.broadcast(least)).where("n >= least").agg(F.min("t").alias("start"))
    return returns.join(F.broadcast(start)).where("start IS NULL OR t >= start").drop("start")


def tail(returns: DataFrame, window: int) -> DataFrame:
    """The last `window` dates, if window is over 10."""
    if window <= 10:
        return returns
    last = returns.select("t").distinct().orderBy(F.desc("t")).limit(window).agg(F.min("t").alias("start"))
    return returns.join(F.broadcast(last)).where("t >= start").drop("start")


def aligned(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each series on the calendar's days between its first and last, forward filled."""
    ends = panel.groupBy("entity").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    days = ends.join(F.broadcast(calendar.select(F.col("t").alias("day"))), F.col("day").between(F.col("first"), F.col("last")))
    both = days.select("entity", F.col("day").alias("t"), F.lit(True).alias("open")).join(panel, ["entity", "t"], "full")
    rows = by_entity().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Days off the calendar don't fill in what they alone have: the series is put on the calendar first.
    on = both.where("open").withColumn("px", F.last("px", ignorenulls=True).over(rows))
    return on.where("px IS NOT NULL").select("entity", "t", "px")


def eligibility(panel: DataFrame, flat: float = 1e-12) -> DataFrame:
    """(entity, coverage, flat_rate): share of dates with a price; share of unchanged among pairs of adjacent dates with both, 1 without pairs."""
    g = grid(panel).withColumn("before", F.lag("px").over(by_entity()))
    pair = F.col("px").isNotNull() & F.col("before").isNotNull()
    out = g.groupBy("entity").agg((F.count("px") / F.count("*")).alias("coverage"), F.count_if(pair & (F.abs(F.col("px") - F.col("before")) <= flat)).alias("same"), F.count_if(pair).alias("pairs"))
    return out.select("entity", "coverage", F.when(F.col("pairs") == 0, F.lit(1.0)).otherwise(F.col("same") / F.greatest("pairs", F.lit(1))).alias("flat_rate"))


def eligible(panel: DataFrame, least_coverage: float = 0.0, most_flat: float | None = None, least_entities: int = 2) -> tuple[DataFrame, DataFrame]:
    """(panel of eligible entities, one row of statistics); too few dates or entities are an error."""
    rates = eligibility(panel).withColumn("kept", F.col("coverage") >= least_coverage)
    if most_flat is not None:
        rates = rates.withColumn("kept", F.col("kept") & (F.col("flat_rate") <= most_flat))
    of = lambda f, c: f(F.when(F.col("kept"), F.col(c)))
    stats = rates.agg(
        F.count("*").alias("n_entities"), F.count_if("kept").alias("n_selected"), F.median("coverage").alias("median_coverage"), F.median("flat_rate").alias("median_flat_rate"),
        of(F.min, "coverage").alias("min_coverage"), of(F.max, "coverage").alias("max_coverage"), of(F.min, "flat_rate").alias("min_flat_rate"), of(F.max, "flat_rate").alias("max_flat_rate"),
    )
    row, dates = stats.first(), panel.select("t").distinct().limit(2).count()
    if dates < 2:
        raise ValueError("the panel needs two dates at least")
    if row.n_selected < least_entities:
        raise ValueError(f"{row.n_selected} entities are eligible, {least_entities} are needed")
    return panel.join(rates.where("kept").select("entity"), "entity", "left_semi"), stats
