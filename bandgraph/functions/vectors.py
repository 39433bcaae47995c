"""Array expressions: products, norms, wavelet steps, cross-band terms and their reducers."""

from __future__ import annotations

import decimal
import math

import numpy as np
from pyspark.sql import Column, functions as F

#: Decomposition low-pass taps of the published orthonormal wavelets.
LOW = {
    "sym2": [-0.12940952255126034, 0.2241438680420134, 0.8365163037378079, 0.48296291314453414],
    "db4": [-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523],
    "sym4": [-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161, 0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427],
    "coif1": [-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539],
}


def high(wavelet: str) -> list[float]:
    """The quadrature mirror of the low-pass taps."""
    h = LOW[wavelet]
    return [(-1) ** (m + 1) * x for m, x in enumerate(reversed(h))]


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f's result has it, in lambdas too."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    length = F.sqrt(total(F.transform(v, lambda x: x * x)))
    return let(F.when(length == 0, F.lit(1.0)).otherwise(length), lambda n: F.transform(v, lambda x: x / n))


def circular(v: Column, taps: list[float], step: int) -> Column:
    """Sum over m of taps[m] / sqrt 2 times v[t + len(taps) step / 2 - m step], indices modulo the length of v."""
    half = len(taps) * step // 2

    def over(v: Column) -> Column:
        n = F.size(v)
        at = lambda t: sum((F.get(v, F.pmod(t + (half - m * step), n)) * F.lit(c / math.sqrt(2)) for m, c in enumerate(taps)), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda t: at(t))

    return let(v, over)


def mirrored(v: Column, multiple: int) -> Column:
    """v continued on the right by its mirror image (the last value first) up to a multiple of a length."""
    pad = F.pmod(-F.size(v), F.lit(multiple))
    return F.when(pad == 0, v).otherwise(F.concat(v, F.slice(F.reverse(v), F.lit(1), pad)))


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def signed_terms(s: Column, negative_weight: float) -> Column:
    """For each detail band l of band similarities s: sqrt(low+ high+) + weight sqrt(low- high-), low being band 0."""
    low = F.get(s, F.lit(0))
    root = lambda x: F.sqrt(positive(low) * positive(x)) + F.lit(negative_weight) * F.sqrt(positive(-low) * positive(-x))
    return F.transform(F.slice(s, F.lit(2), F.size(s) - 1), root)


def weighted(terms: Column, layer_step: float) -> Column:
    """Term of detail band l times layer_step l + 1."""
    return F.transform(terms, lambda x, i: x * (F.lit(layer_step) * (i + 1) + 1))


def reduced(terms: Column, reducer: str) -> Column:
    n = F.size(terms)
    if reducer == "max":
        return F.array_max(terms)
    if reducer == "mean":
        return total(terms) / n
    if reducer == "median":
        s = F.array_sort(terms)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    if reducer == "geometric":
        return F.pow(F.aggregate(terms, F.lit(1.0), lambda a, x: a * x), F.lit(1.0) / n)
    raise ValueError(f"unknown reducer: {reducer}")


def half_up(v: np.ndarray, places: int) -> np.ndarray:
    """v as Spark's round gives it, which rounds a double's shortest decimals half up; without negative zeros."""
    size = np.abs(v) * 10.0**places
    n = np.floor(size + 0.5)
    unit = decimal.Decimal(1).scaleb(-places)
    for k in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-6):  # by their decimals, where the product may be off
        n[k] = int(decimal.Decimal(repr(abs(float(v[k])))).quantize(unit, decimal.ROUND_HALF_UP).scaleb(places))
    return np.copysign(n / 10.0**places, v) + 0.0
