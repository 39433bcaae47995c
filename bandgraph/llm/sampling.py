"""Bounded, repeatable samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Resolution of a row's place in the sample order.
GRAIN = 1 << 20


def bounded(df: DataFrame, by: str, each: int, seed: int = 17) -> DataFrame:
    """About `each` rows for each value of `by` (all where there are fewer), by a hash of doc_id; null values are left out.

    One count per value fixes the share; no task or driver sees more than the sample.
    """
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(GRAIN))
    return df.join(F.broadcast(counts), by).where(place * F.col("_n") < F.lit(each * GRAIN)).drop("_n")
