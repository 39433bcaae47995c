"""Transforms of returns (entity, t, r)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandgraph.functions.keys import entity_code, label
from bandgraph.operators import panel as P


def over(column: str):
    return Window.partitionBy(column)


def winsorized(returns: DataFrame, low: float, high: float) -> DataFrame:
    """r clipped from below at its entity's low quantile, then from above at the 1 - high quantile of what that gives."""
    out = returns
    if low > 0:
        out = out.withColumn("r", F.greatest("r", F.percentile("r", F.lit(low)).over(over("entity"))))
    if high > 0:
        out = out.withColumn("r", F.least("r", F.percentile("r", F.lit(1 - high)).over(over("entity"))))
    return out.withColumn("r", F.coalesce("r", F.lit(0.0)))


def zscored(returns: DataFrame) -> DataFrame:
    sd = F.coalesce(F.nullif(F.stddev_samp("r").over(over("entity")), F.lit(0.0)), F.lit(1e-8))
    return returns.withColumn("r", F.coalesce((F.col("r") - F.avg("r").over(over("entity"))) / sd, F.lit(0.0)))


def varying(returns: DataFrame, least: float = 1e-6) -> DataFrame:
    """Entities whose returns have more than that standard deviation."""
    return returns.withColumn("_sd", F.stddev_samp("r").over(over("entity"))).where(F.col("_sd") > least).drop("_sd")


def market_demeaned(returns: DataFrame) -> DataFrame:
    return returns.withColumn("r", F.col("r") - F.avg("r").over(over("t")))


def _residual(returns: DataFrame, factor: Column, least: float) -> DataFrame:
    """With f, alpha and beta of the regression of r on f in each entity, and f's sum of squares."""
    out = returns.withColumn("f", factor)
    return out.withColumns({"beta": F.regr_slope("r", "f").over(over("entity")), "alpha": F.regr_intercept("r", "f").over(over("entity")), "sxx": F.regr_sxx("r", "f").over(over("entity"))}).withColumn("fits", F.coalesce(F.col("sxx") > least, F.lit(False)))


def market_residual(returns: DataFrame) -> DataFrame:
    """Residuals of each entity on the mean of all; unchanged where the market has no variance."""
    out = _residual(returns, F.avg("r").over(over("t")), 1e-12)
    return out.withColumn("r", F.when(F.col("fits"), F.col("r") - F.col("alpha") - F.col("beta") * F.col("f")).otherwise(F.col("r"))).select(*returns.columns)


MODES = {"raw": lambda r: r, "none": lambda r: r, "": lambda r: r} | dict.fromkeys(("market_demean", "demean", "cross_section_demean"), market_demeaned) | dict.fromkeys(("market_residual", "demarket", "ols_residual"), market_residual)


def in_mode(returns: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown return mode: {mode}")
    return MODES[mode](returns)


def leave_one_out(returns: DataFrame) -> DataFrame:
    """(entity, t, r, factor, residual, alpha, beta): regression of each entity on the mean of all others."""
    others = (F.sum("r").over(over("t")) - F.col("r")) / F.nullif(F.count("*").over(over("t")) - 1, F.lit(0))
    out = _residual(returns, others, 1e-20)
    return out.select("entity", "t", "r", F.col("f").alias("factor"), (F.col("r") - F.col("alpha") - F.col("beta") * F.col("f")).alias("residual"), "alpha", "beta", "fits")


def leave_one_out_diagnostics(regressed: DataFrame) -> DataFrame:
    """Per entity: alpha, beta, r2, explained_variance, residual_mean, residual_factor (inner product)."""
    share = lambda part, all_: F.when(all_ > 1e-20, 1 - part / all_).otherwise(0.0)
    out = regressed.groupBy("entity").agg(
        F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.sum(F.col("residual") * F.col("residual")).alias("rss"), (F.var_pop("r") * F.count("*")).alias("tss"),
        F.var_pop("residual").alias("rv"), F.var_pop("r").alias("tv"), F.avg("residual").alias("residual_mean"), F.sum(F.col("residual") * F.col("factor")).alias("residual_factor"), F.every("fits").alias("fits"),
    )
    return out.select("entity", "alpha", "beta", share(F.col("rss"), F.col("tss")).alias("r2"), share(F.col("rv"), F.col("tv")).alias("explained_variance"), "residual_mean", "residual_factor", "fits")


def check_fits(diagnostics: DataFrame) -> None:
    bad = diagnostics.where(~F.col("fits")).select("entity").limit(5).collect()
    if bad:
        raise ValueError(f"the factor of {[r.entity for r in bad]} has no variance")


def industry_neutral(returns: DataFrame, industries: DataFrame) -> DataFrame:
    """r less the mean of its date and industry; industries (entity, industry)."""
    both = returns.join(industries, "entity")
    return both.withColumn("r", F.col("r") - F.avg("r").over(Window.partitionBy("t", "industry"))).select(*returns.columns)


def industry_map(info: DataFrame, strict: bool = True) -> DataFrame:
    """(code, industry) of info (symbol, ts_code, industry), under both codes. Conflicts: an error if strict, else the last row's.

    Only strict maps take words that mean no label, such as UNK, for none; others leave out blanks and nan alone.
    """
    rows = info.withColumn("_row", F.monotonically_increasing_id())
    plain = F.trim(F.col("industry").cast("string"))
    of = label(F.col("industry")) if strict else F.when(~F.lower(plain).isin("", "nan"), plain)
    keys = rows.select(F.explode(F.array_distinct(F.array(entity_code(F.col("ts_code")), entity_code(F.col("symbol"))))).alias("code"), of.alias("industry"), "_row")
    keys = keys.where("code <> '' AND industry IS NOT NULL")
    if strict and (bad := keys.groupBy("code").agg(F.count_distinct("industry").alias("n")).where("n > 1").limit(5).collect()):
        raise ValueError(f"codes with several industries: {[r.code for r in bad]}")
    return keys.groupBy("code").agg(F.max_by("industry", "_row").alias("industry"))


def factor_universe(entities: DataFrame, industries: DataFrame, least: int = 2) -> DataFrame:
    """(entity, industry, reason): reason is null for those kept, else missing_industry or industry_size_lt_<least>."""
    both = entities.select("entity").distinct().join(industries, "entity", "left")
    size = F.count("*").over(Window.partitionBy("industry"))
    reason = F.when(F.col("industry").isNull(), "missing_industry").when(size < least, f"industry_size_lt_{least}")
    return both.select("entity", "industry", reason.alias("reason"))


def check_universe(universe: DataFrame) -> None:
    if universe.where("reason IS NULL").limit(2).count() < 2:
        raise ValueError("fewer than two entities have an industry of the least size")


def check_industries(entities: DataFrame, industries: DataFrame) -> None:
    """Every entity must have an industry, a real one, and no industry may have a single entity."""
    both = entities.select("entity").distinct().join(industries.select("entity", F.col("industry").alias("given"), label(F.col("industry")).alias("industry"), F.lit(True).alias("there")), "entity", "left")
    for what, bad in (("not covered", "there IS NULL"), ("invalid", "industry IS NULL")):
        if rows := both.where(bad).orderBy("entity").limit(5).collect():
            raise ValueError(f"industries {what}: {[r.entity for r in rows]}")
    if rows := both.groupBy("industry").count().where("count < 2").orderBy("industry").limit(5).collect():
        raise ValueError(f"industries of a single entity: {[r.industry for r in rows]}")


def factor_branches(panel: DataFrame, industries: DataFrame, winsor: tuple[float, float]) -> DataFrame:
    """(branch, entity, t, r): raw, market_residual_internal and sequential. The last isn't scaled again."""
    w = winsorized(P.log_returns(panel), *winsor)
    raw = zscored(w)
    market = zscored(leave_one_out(w).select("entity", "t", F.col("residual").alias("r")))
    tagged = {"raw": raw, "market_residual_internal": market, "sequential": industry_neutral(market, industries)}
    return reduce(DataFrame.unionByName, (df.select(F.lit(b).alias("branch"), "entity", "t", "r") for b, df in tagged.items()))


def industry_only(panel: DataFrame, industries: DataFrame, winsor: tuple[float, float]) -> DataFrame:
    """Winsorized, then industry neutral, then scaled."""
    return zscored(industry_neutral(winsorized(P.log_returns(panel), *winsor), industries))


def model_returns(panel: DataFrame, params) -> DataFrame:
    """Returns of the full model: log returns, sparse trim, winsorizing, scaling, varying entities, tail."""
    r = P.dense(P.sparse_trim(P.raw_log_returns(panel), params.sparse_ratio))
    r = winsorized(r, params.winsor_low, params.winsor_high)
    r = zscored(r) if params.zscore else r
    return P.tail(varying(r), params.rolling_window)


def plain_returns(panel: DataFrame, params, mode: str = "raw") -> DataFrame:
    """Returns without metadata: log returns, mode, winsorizing, scaling, varying entities."""
    r = winsorized(in_mode(P.log_returns(panel), mode), params.winsor_low, params.winsor_high)
    return varying(zscored(r) if params.zscore else r)
