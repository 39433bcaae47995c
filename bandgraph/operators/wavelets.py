"""Wavelet bands of series. Band 0 is the approximation, band b the detail of level J + 1 - b."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from bandgraph.functions import vectors as V
from bandgraph.params import DECOMPOSITIONS


def series(returns: DataFrame) -> DataFrame:
    """(entity, v): the values of an entity in order of date. A row holds one entity's dates."""
    rows = F.array_sort(F.collect_list(F.struct("t", "r")))
    return returns.groupBy("entity").agg(F.transform(rows, lambda x: x["r"]).alias("v"))


def modwt(vectors: DataFrame, wavelet: str, level: int) -> DataFrame:
    """(entity, bands): the maximal overlap transform, in SQL functions; bands are as long as the series.

    The series is continued by its mirror image to a multiple of 2**level, taken as circular, and cut again.
    """
    low, high, n = V.LOW[wavelet], V.high(wavelet), F.size("v")
    out = vectors.withColumn("a", V.mirrored(F.col("v").cast("array<double>"), 2**level))
    details = []
    for j in range(1, level + 1):
        out = out.withColumn(f"d{j}", V.circular(F.col("a"), high, 2 ** (j - 1))).withColumn("a", V.circular(F.col("a"), low, 2 ** (j - 1)))
        details.insert(0, f"d{j}")
    return out.select("entity", F.array(*(F.slice(c, F.lit(1), n) for c in ("a", *details))).alias("bands"))


def modwt_numpy(v: np.ndarray, wavelet: str, level: int) -> list[np.ndarray]:
    n, a = len(v), np.asarray(v, float)
    if pad := -n % 2**level:
        a = np.concatenate([a, a[::-1][:pad]])
    taps, bands = (np.array(V.LOW[wavelet]) / np.sqrt(2), np.array(V.high(wavelet)) / np.sqrt(2)), []
    for j in range(level):
        half = len(taps[0]) * 2**j // 2
        both = [sum(c * np.roll(a, m * 2**j - half) for m, c in enumerate(f)) for f in taps]
        a = both[0]
        bands.insert(0, both[1][:n])
    return [a[:n], *bands]


def dwt_numpy(v: np.ndarray, wavelet: str, level: int) -> list[np.ndarray]:
    """Decimated pyramid with half-sample symmetric borders; band lengths differ."""
    a, bands = np.asarray(v, float), []
    low, high = np.array(V.LOW[wavelet]), np.array(V.high(wavelet))
    for _ in range(level):
        k = len(low) - 1
        index = np.arange(-k, len(a) + k)
        period = np.concatenate([a, a[::-1]])
        long = period[index % len(period)]
        c = [np.convolve(long, f, "valid")[1::2] for f in (low, high)]
        a = c[0]
        bands.insert(0, c[1])
    return [a, *bands]


def decomposed(vectors: DataFrame, wavelet: str, level: int, kind: str = "modwt", engine: str = "arrow") -> DataFrame:
    """(entity, bands) by one of the names in DECOMPOSITIONS; engine 'sql' (modwt only) or 'arrow', the faster for long filters."""
    if kind not in DECOMPOSITIONS:
        raise ValueError(f"unknown decomposition: {kind}")
    if engine == "sql" and DECOMPOSITIONS[kind] == "modwt":
        return modwt(vectors, wavelet, level)
    transform = modwt_numpy if DECOMPOSITIONS[kind] == "modwt" else dwt_numpy

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"entity": pdf.entity, "bands": [[b.tolist() for b in transform(v, wavelet, level)] for v in pdf.v]})

    return vectors.mapInPandas(run, f"entity {vectors.schema['entity'].dataType.simpleString()}, bands array<array<double>>")


def unit_bands(bands: DataFrame) -> DataFrame:
    """Every band cut to its least length over the entities and scaled to length 1; zero bands stay."""
    least = bands.select(F.posexplode("bands").alias("b", "v")).groupBy("b").agg(F.min(F.size("v")).alias("n"))
    lengths = least.agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("lengths"))  # one row of J + 1 numbers
    cut = F.transform("bands", lambda v, i: V.unit(F.slice(v, F.lit(1), F.get(F.col("lengths"), i)["n"])))
    return bands.join(F.broadcast(lengths)).select("entity", cut.alias("bands"))


def ranked_bands(bands: DataFrame) -> DataFrame:
    """Every band as average ranks, centred and scaled to length 1, so that dot products are Spearman correlations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rank(v):
            v = np.asarray(v, float)
            if not np.isfinite(v).all():
                raise ValueError("ranks need finite values")
            _, at, n = np.unique(v, return_inverse=True, return_counts=True)
            r = (np.cumsum(n) - (n - 1) / 2)[at]
            r = r - r.mean()
            size = np.sqrt((r * r).sum())
            return r / (size or 1)

        for pdf in batches:
            yield pdf.assign(bands=[[rank(b).tolist() for b in bands] for bands in pdf.bands])

    return bands.mapInPandas(run, bands.schema)
