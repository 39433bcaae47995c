"""All pairs of entities, (i, j, s) with i < j and one similarity for each band.

Every pair is the result that is asked for, but no pair is stored: entities are packed into blocks once, a block a row, and
each task makes the product of two blocks. Nothing but the blocks is written or shuffled, so disk grows with the entities
and not with their pairs. What reads pairs several times has them made anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bandgraph.functions import vectors as V
from bandgraph.operators.ranks import quantiles
from bandgraph.session import cut

#: Most entities of a block, and most bytes; rows of a product that are made at once, and values that are counted at once.
BLOCK, BLOCK_BYTES, TILE, COUNTED = 2_048, 32 << 20, 256, 1 << 16
#: Rounded similarities are whole numbers of 10 ** -PLACES; added to OFFSET, their upper bits are the coarse bins of a histogram.
PLACES, OFFSET, FINE_BITS = 9, 1 << 30, 16


class Pairs:
    """The pairs of entities of (entity, bands) with bands of length 1, made where they are read.

    places: decimals that similarities are rounded to, or None. Histograms need PLACES.
    """

    def __init__(self, unit: DataFrame, block: int = BLOCK, places: int | None = None):
        self.kind, self.places = unit.schema["entity"].dataType, places
        blocks = cut(_blocks(unit, block))
        self._cut = blocks._cut
        sizes = blocks.select("x", F.size("ids").alias("n")).collect()  # a row for each block
        found, self.entities = sorted(r.x for r in sizes), sum(r.n for r in sizes)
        self.bands = (blocks.select(F.size("sizes").alias("b")).first() or [0])[0]
        place = F.array_position(F.lit(found).cast("array<bigint>"), F.col("x")).cast("int") - 1
        # A partition has one block, so that a task of the product has two.
        self.blocks = blocks.withColumn("x", place).repartitionById(max(len(found), 1), F.col("x"))

    def _products(self, run, schema: str) -> DataFrame:
        other = self.blocks.select(F.col("x").alias("y"), F.col("ids").alias("y_ids"), F.col("data").alias("y_data"))
        both = self.blocks.hint("shuffle_replicate_nl").join(other.hint("shuffle_replicate_nl"), F.col("x") <= F.col("y"))
        return both.select("x", "y", "ids", "y_ids", "sizes", "data", "y_data").mapInArrow(run, schema)

    def rows(self, over: float | None = None) -> DataFrame:
        """(i, j, s array). over: only pairs whose first band and some other are over it."""
        make = lambda values: [pa.ListArray.from_arrays(np.arange(0, values.size + 1, len(values), dtype=np.int32), values.T.ravel())]
        return self._made(make, "s array<double>", over)

    def columns(self, make, names: list[str], over: float | None = None) -> DataFrame:
        """(i, j, *names): columns of doubles that make gives for similarities [bands, pairs]."""
        return self._made(lambda values: [pa.array(v) for v in make(values)], ", ".join(f"{c} double" for c in names), over)

    def _made(self, make, schema: str, over: float | None) -> DataFrame:
        kind, tiles, names = to_arrow_type(self.kind), _tiler(self.places), ["i", "j", *(c.split()[0] for c in schema.split(", "))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, y_ids, s, own in tiles(batches):
                if over is None and not own:
                    i, j, values = np.repeat(ids, len(y_ids)), np.tile(y_ids, len(ids)), np.stack([v.ravel() for v in s])
                else:
                    keep = np.ones(s[0].shape, bool) if over is None else (s[0] > over) & np.logical_or.reduce([v > over for v in s[1:]])
                    a, b = np.nonzero(np.triu(keep, 1) if own else keep)
                    i, j, values = ids[a], y_ids[b], np.stack([v[a, b] for v in s])
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j), kind), pa.array(np.maximum(i, j), kind), *make(values)], names)

        return self._products(run, f"i {self.kind.simpleString()}, j {self.kind.simpleString()}, {schema}")

    def _counts(self, band: int | None, within: list[int] | None = None) -> dict[int, int]:
        """How many similarities of a band, or of all, are in each coarse bin; or of each value in the bins `within`.

        A task adds up in tables of as many places as there are bins, or values in the bins `within`.
        """
        tiles, bins = _tiler(None), (2 * OFFSET) >> FINE_BITS
        runs = [] if within is None else _runs(within)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coarse, fine = np.zeros(bins, np.int64), [np.zeros((b - a) << FINE_BITS, np.int64) for a, b in runs]
            for _, _, s, own in tiles(batches):
                for v in s if band is None else [s[band]]:
                    v = v[np.triu(np.ones(v.shape, bool), 1)] if own else v.ravel()
                    for at in range(0, len(v), COUNTED):  # as much as the cache holds
                        k = v[at : at + COUNTED]
                        np.multiply(k, 10.0**PLACES, out=k)
                        np.rint(k, out=k)
                        np.add(k, OFFSET, out=k)
                        if not 0 <= k.min() <= k.max() < 2 * OFFSET:
                            raise ValueError("similarities must be in -1 to 1")
                        k = k.astype(np.int32)
                        if within is None:
                            coarse += np.bincount(k >> FINE_BITS, minlength=bins)
                        for (a, b), table in zip(runs, fine, strict=True):
                            some = k[(k >= a << FINE_BITS) & (k <= (b << FINE_BITS) - 1)] - (a << FINE_BITS)
                            if len(some):
                                np.add.at(table, some, 1)
            for first, table in [(0, coarse), *((a << FINE_BITS, t) for (a, _), t in zip(runs, fine, strict=True))]:
                n = np.flatnonzero(table)
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(n + first), pa.array(table[n])], ["v", "n"])

        found = self._products(run, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n")).toArrow()
        return dict(zip(found.column("v").to_pylist(), found.column("n").to_pylist(), strict=True))

    def quantiles(self, shares: list[float], band: int | None = None, times: int = 1, zeros: int = 0) -> list[float | None]:
        """Exact quantiles, linear between neighbours, of the rounded similarities of a band, or of all bands.

        Each counts `times` times, and `zeros` zeros are added. One pass counts coarse bins, which are as many whatever the
        number of pairs, and a second the values in those bins that the wanted places are in.
        """
        if self.places != PLACES:
            raise ValueError(f"histograms need {PLACES} places")

        def full(counts: dict[int, int], zero: int | None) -> list[tuple[int, int]]:
            counts = {v: n * times for v, n in counts.items()}
            if zeros and zero is not None:
                counts[zero] = counts.get(zero, 0) + zeros
            return sorted(counts.items())

        coarse = full(self._counts(band), OFFSET >> FINE_BITS)
        total = sum(n for _, n in coarse)
        if not total:
            return [None] * len(shares)
        at = [q * (total - 1) for q in shares]
        places = sorted({f(p) for p in at for f in (math.floor, math.ceil)})
        bins, below, start = {}, 0, {}
        for b, n in coarse:
            start[b] = below
            for p in places:
                if below <= p < below + n:
                    bins[p] = b
            below += n
        inside = sorted(set(bins.values()))
        fine = full(self._counts(band, inside), OFFSET if OFFSET >> FINE_BITS in inside else None)
        found = {}
        for b in inside:
            below = start[b]
            for v, n in fine:
                if v >> FINE_BITS == b:
                    found |= {p: (v - OFFSET) / 10.0**PLACES for p in places if below <= p < below + n}
                    below += n
        return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in at]

    def threshold(self, q: float) -> float:
        """max(0, quantile q over all entries of the full matrices of all bands), their zero diagonals and both triangles too."""
        (tau,) = self.quantiles([q], None, 2, self.bands * self.entities)
        return max(tau or 0.0, 0.0)

    def summary(self, band: int, diagonal: float = 0.0) -> DataFrame:
        """What matrix_summary gives, without a row for each pair."""
        tiles = _tiler(self.places)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, s, own in tiles(batches):
                if len(x := s[band][np.triu(np.ones(s[band].shape, bool), 1)] if own else s[band].ravel()):
                    mean = x.mean()
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (len(x), float(mean), float(((x - mean) ** 2).sum()), float(x.min()), float(x.max()))], ["n", "mean", "far", "min", "max"])

        parts = self._products(run, "n bigint, mean double, far double, min double, max double")
        t = parts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("sum"), F.sum(F.col("far") + F.col("n") * F.col("mean") * F.col("mean")).alias("squares"), F.min("min").alias("min"), F.max("max").alias("max"))
        mean = F.try_divide(F.col("sum"), F.col("n"))
        std = F.sqrt(F.greatest(F.try_divide(F.col("squares"), F.col("n")) - mean * mean, F.lit(0.0)))
        values = F.array(*(F.lit(q).cast("double") for q in self.quantiles(SHARES, band)))
        return t.select(F.lit(diagonal).alias("diagonal"), F.lit(self.entities).alias("n"), mean.alias("mean"), F.when(F.col("n") > 0, std).alias("std"), "min", "max", values.alias("quantiles"))


def _blocks(unit: DataFrame, block: int) -> DataFrame:
    """(x, ids, sizes, data): blocks of entities as they lie in their partitions, and their bands end to end."""
    kind = unit.schema["entity"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, sizes, x = [], [], None, TaskContext.get().partitionId() << 32

        def done(n: int):
            nonlocal ids, rows, x
            all_ids, data = pa.concat_arrays(ids), np.concatenate(rows)
            out = [pa.array([x]), pa.array([all_ids[:n].to_pylist()], pa.list_(all_ids.type)), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([data[:n].tobytes()], pa.binary())]
            ids, rows, x = [all_ids[n:]], [data[n:]], x + 1
            return pa.RecordBatch.from_arrays(out, ["x", "ids", "sizes", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            each = b.column(1).flatten()
            own = each.value_lengths().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            sizes = own[0] if sizes is None else sizes
            if own.shape[1] != len(sizes) or (own != sizes).any():
                raise ValueError("bands must be equally long for all entities")
            ids.append(b.column(0))
            rows.append(each.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            most = max(1, min(block, BLOCK_BYTES // max(8 * rows[-1].shape[1], 1)))
            while sum(map(len, rows)) > most:
                yield done(most)
        if ids:
            yield done(sum(map(len, rows)))

    return unit.select("entity", F.col("bands").cast("array<array<double>>").alias("bands")).mapInArrow(run, f"x bigint, ids array<{kind.simpleString()}>, sizes array<int>, data binary")


def _runs(bins: list[int]) -> list[tuple[int, int]]:
    """Ranges [a, b) of bins that follow each other."""
    out: list[tuple[int, int]] = []
    for b in sorted(bins):
        out[-1:] = [(out[-1][0], b + 1)] if out and out[-1][1] == b else [*out[-1:], (b, b + 1)]
    return out


def _tiler(places: int | None):
    """A function that gives (ids, ids, an array [rows, columns] for each band, whether only those over the diagonal are
    pairs) for runs of rows of each product."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], bool]]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (batch.column(k)[r].as_py() for k in (0, 1))
                ids, y_ids = (batch.column(k)[r].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                ends = np.cumsum(sizes := np.array(batch.column(4)[r].as_py(), np.int64))
                left, right = (np.frombuffer(batch.column(k)[r].as_buffer(), np.float64).reshape(len(n), -1) for k, n in ((5, ids), (6, y_ids)))
                parts = [slice(e - n, e) for e, n in zip(ends, sizes, strict=True)]
                for at in range(0, len(ids), TILE):
                    first = at if x == y else 0  # of one block, the columns before are done
                    s = [left[at : at + TILE, p] @ right[first:, p].T for p in parts]
                    for v in s if places is not None else []:
                        np.multiply(v, 10.0**places, out=v)
                        np.rint(v, out=v)
                        np.divide(v, 10.0**places, out=v)
                        np.add(v, 0.0, out=v)
                    yield ids[at : at + TILE], y_ids[first:], s, x == y

    return tiles


def all_pairs(unit: DataFrame, engine: str = "blocks", block: int = BLOCK) -> DataFrame:
    """(i, j, s array) of (entity, bands) with bands of length 1; engine 'sql' or 'blocks' (matrix products of blocks)."""
    if engine != "sql":
        return Pairs(unit, block).rows()
    a, b = (unit.select(F.col("entity").alias(f"e{k}"), F.col("bands").alias(f"b{k}")) for k in "ab")
    return a.join(b, F.col("ea") < F.col("eb")).select(F.col("ea").alias("i"), F.col("eb").alias("j"), F.zip_with("ba", "bb", V.dot).alias("s"))


SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def matrix_summary(sim: DataFrame, entities: int, band: int, diagonal: float = 0.0) -> DataFrame:
    """mean, population deviation, min, max and quantiles over the pairs of a band, and the diagonal's value."""
    s = F.get("s", F.lit(band))
    found = quantiles(sim.select(s.alias("x"), F.lit(1).cast("bigint").alias("n")), SHARES)
    values = F.array(*(F.lit(q).cast("double") for q in found))
    return sim.agg(F.lit(diagonal).alias("diagonal"), F.lit(entities).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), values.alias("quantiles"))


def with_landmarks(unit: DataFrame, landmarks: list) -> DataFrame:
    """(i, j, s) of every entity i and each landmark j that it is not: the landmarks' bands go to all tasks, nothing is shuffled."""
    from_ = F.broadcast(unit.where(F.col("entity").isin(landmarks)).select(F.col("entity").alias("j"), F.col("bands").alias("theirs")))  # as many rows as landmarks
    both = unit.join(from_, F.col("entity") != F.col("j"))
    return both.select(F.col("entity").alias("i"), "j", F.zip_with("bands", "theirs", V.dot).alias("s"))


def restricted(sim: DataFrame, entities: DataFrame) -> DataFrame:
    """The pairs of sim both of whose entities are listed: a slice of what is there, nothing is computed anew."""
    kept = entities.select("entity").distinct()
    return sim.join(kept.withColumnRenamed("entity", "i"), "i", "left_semi").join(kept.withColumnRenamed("entity", "j"), "j", "left_semi").select("i", "j", "s")
