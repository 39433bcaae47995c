"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bandgraph.llm.hashing import BYTES, hashed_words, mixed
from bandgraph.session import cut, table

#: Samples of a fingerprint, and bits kept of each; unequal samples agree by chance once in 2**BITS.
SAMPLES, BITS = 64, 16
#: Terms are runs of so many words; a term's weight is WEIGHT_ROOT of its count.
RUNS = (1, 2)
#: Triples of variates in the table, and the bits of a 32-bit hash that are left beside a place in it.
TABLE, REST = 1 << 16, np.uint32(16)
#: Terms looked at together.
CHUNK = 2_048


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010).

    For sample k, term x and weight w: r and c are Gamma(2, 1) and beta uniform variates that depend on (k, x) only;
    t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r; the sample is (x, t) of the least a. Two
    weighted sets agree in a sample with probability sum of min weights / sum of max weights.

    A hash of (k, x) chooses one of TABLE triples (r, c, beta), drawn once. They are sorted by ln a at weight 1, where t is
    0, and the hash's other bits lie between neighbours; so of terms of weight 1 the least hash has the least a, and only
    terms of other weights are looked up.
    """

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        r, lnc, beta = rng.gamma(2.0, 1.0, TABLE), np.log(rng.gamma(2.0, 1.0, TABLE)), rng.random(TABLE)
        one = lnc + (beta - 1) * r
        order = np.argsort(one, kind="stable")
        self.r, self.beta, self.one = r[order].astype(np.float32), beta[order].astype(np.float32), one[order]
        self.step = np.diff(self.one, append=self.one[-1]) / (1 << int(REST))
        self.mult = (rng.integers(0, 2**31, (SAMPLES, 1), dtype=np.uint64) * 2 + 1).astype(np.uint32)
        self.add = rng.integers(0, 2**32, (SAMPLES, 1), dtype=np.uint64).astype(np.uint32)

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct term hashes, ascending, and their counts, of a text with word hashes h."""
        runs, acc = [], h
        for n in range(1, max(RUNS) + 1):
            if n > 1:
                acc = acc[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :] + np.uint64(n)
            if n in RUNS and len(acc):
                runs.append(acc ^ (acc >> np.uint64(31)))
        if not runs:
            return h, h.astype(np.int64)
        x = np.sort(np.concatenate(runs))
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        return x[first], np.diff(np.r_[first, len(x)])

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """32 bits for each sample and term: the upper ones are a place in the table."""
        h = (x ^ (x >> np.uint64(32))).astype(np.uint32)[None] * self.mult
        h += self.add
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        return h

    def looked_up(self, h: np.ndarray, lnw: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """(ln a, t) of hashes and terms' ln w."""
        at = h >> REST
        r = self.r[at]
        t = np.floor(lnw / r + self.beta[at])
        return self.one[at] + self.step[at] * (h & np.uint32((1 << int(REST)) - 1)) - r * t, t

    def least(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sample the least ln a over the terms (ascending), its x, and the code of its (x, t)."""
        best, term, code = np.full(SAMPLES, np.inf), np.full(SAMPLES, 2**64 - 1, np.uint64), np.zeros(SAMPLES, np.uint64)
        row, one = np.arange(SAMPLES), count == 1
        for light, own in ((True, np.flatnonzero(one)), (False, np.flatnonzero(~one))):
            for i in range(0, len(own), CHUNK):
                part = own[i : i + CHUNK]
                h = self.hashes(x[part])
                if light:
                    k = h.argmin(1)
                    a, t = self.looked_up(h[row, k], np.float32(0))
                else:
                    a, t = self.looked_up(h, 0.5 * np.log(count[part]).astype(np.float32))  # the root of the count
                    k = a.argmin(1)
                    a, t = a[row, k], t[row, k]
                k = x[part[k]]
                less = (a < best) | (a == best) & (k < term)  # ties keep the lesser term
                best, term = np.where(less, a, best), np.where(less, k, term)
                code = np.where(less, k + t.astype(np.int64).astype(np.uint64) * np.uint64(0xA24BAED4963EE407), code)
        return best, term, code

    def marks(self, code: np.ndarray) -> np.ndarray:
        """BITS bits of each sample's code."""
        return (mixed(code + np.arange(SAMPLES, dtype=np.uint64)) >> np.uint64(64 - BITS)).astype(np.uint16)

    def samples(self, h: np.ndarray) -> np.ndarray:
        """The samples of a text with word hashes h as SAMPLES numbers of BITS bits; none for a text without words."""
        x, count = self.terms(h)
        return self.marks(self.least(x, count)[2]) if len(x) else np.zeros(0, np.uint16)

    def samples_of_both(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples of two texts with these word hashes; terms of equal weight in both are looked at once."""
        (x, cx), (y, cy) = self.terms(one), self.terms(two)
        at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
        same = (y[at] == x) & (cy[at] == cx) if len(y) else np.zeros(len(x), bool)
        rest = np.ones(len(y), bool)
        rest[at[same]] = False
        shared, out = self.least(x[same], cx[same]), []
        for z, c, n in ((x[~same], cx[~same], len(x)), (y[rest], cy[rest], len(y))):
            own = self.least(z, c)
            less = (own[0] < shared[0]) | (own[0] == shared[0]) & (own[1] < shared[1])  # as in least()
            out.append(self.marks(np.where(less, own[2], shared[2])) if n else np.zeros(0, np.uint16))
        return out[0], out[1]


def hashed_texts(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words, which lie between white space of ASCII."""
    u, place, sizes = hashed_words(pa.array(texts, pa.string()), lower=False)
    h, ends = u[place], np.cumsum(sizes)
    return [h[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def batches_of(texts, size: int = BYTES):
    """Runs of an iterator of (anything, text), of about `size` characters, one at least."""
    held, n = [], 0
    for row in texts:
        held.append(row)
        n += len(row[1] or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; 1 for two texts without words, 0 if one has some."""
    return float((a == b).mean()) if len(a) and len(a) == len(b) else float(len(a) == len(b))


def fingerprint_text(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with its fingerprint in column out: hex text, '' for a null text or one without words. Rows are independent."""

    @F.pandas_udf("string")
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = Sampler()
        for texts in batches:
            runs = batches_of(enumerate(texts))
            yield pd.Series([fingerprint_text(sampler.samples(h)) for run in runs for h in hashed_texts([t for _, t in run])], dtype=object)

    return docs.withColumn(out, mark(F.col(text)))


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint texts, in SQL functions."""
    step = BITS // 4
    at = F.sequence(F.lit(1), F.length(a), F.lit(step))
    equal = F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(step)) == F.substr(b, i, F.lit(step)))) / F.lit(SAMPLES)
    return F.when(F.length(a) != F.length(b), F.lit(0.0)).when(F.length(a) == 0, F.lit(1.0)).otherwise(equal)


def edited(text: str, after: str) -> str:
    """text with its last floor(n / 4) code points replaced by the first as many of `after`, or all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k] if k else text


def edit_chain(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """For each document (doc_id, text): n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    The next document is that with the next higher id, the first after the last. One pass deals whole texts out to
    ranges of ids; a range's first document also goes, as a look-ahead row, to the range before. Ranges are cut at
    quantiles of the ids, so a task holds few documents at a time and no text is moved twice.

    A null text counts as ''; its fingerprint is ''. A null id comes before all others. Rows of equal id follow one another
    in order of text, repeated rows after each other. A single document is its own next. An empty table gives no rows.
    Texts of any length are hashed whole, some at a time. Columns other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    share = [k / parts for k in range(1, parts)] or [0.5]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", share, 100_000)).first()[0] or []))  # one number a range

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:  # a null id is in range 0
        got = np.searchsorted(np.array(bounds, np.int64), ids.fillna(-(2**63)).to_numpy(np.int64), side="right")
        return pd.Series(got.astype(np.int32))

    placed = docs.withColumn("part", place("doc_id"))
    firsts = placed.groupBy("part").agg(F.min(F.struct("doc_id"))["doc_id"].alias("first_id"))
    order = Window.orderBy("part")  # one row a range
    last = F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    back = cut(firsts.select("first_id", F.coalesce(F.lag("part").over(order), last).alias("into")))
    ahead = docs.join(F.broadcast(back), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("doc_id", "into").agg(F.min("text").alias("text"))
    rows = placed.select("part", F.lit(False).alias("ahead"), "doc_id", "text").unionByName(ahead.select(F.col("into").alias("part"), F.lit(True).alias("ahead"), "doc_id", "text"))
    dealt = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), "text")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held, waiting = Sampler(), None, None  # a text without its next one; a document without the next one's samples
        rows = ((x, t.as_py()) for batch in batches for x, t in zip(zip(batch["doc_id"].to_pylist(), batch["ahead"].to_pylist(), strict=True), batch["text"], strict=True))

        def pair(doc_id, size, digest, own, mark, other):
            return doc_id, size, digest, fingerprint_text(own), fingerprint_text(mark), likeness(own, mark), likeness(own, other)

        for part in batches_of(rows):
            todo, out = ([held] if held else []) + [(doc_id, text, ahead) for (doc_id, ahead), text in part], []
            new = [edited(one[1], two[1]) for one, two in zip(todo, todo[1:], strict=False)]
            words = hashed_texts([text for _, text, _ in todo] + new)
            for k, (one, text) in enumerate(zip(todo, new, strict=False)):
                own, mark = sampler.samples_of_both(words[k], words[len(todo) + k])
                if waiting:
                    out.append(pair(*waiting, own))
                waiting = (one[0], len(one[1]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), own, mark)
            held = todo[-1]
            if held[2]:  # the look-ahead row is a range's last
                out.append(pair(*waiting, sampler.samples(words[len(todo) - 1])))
                held = waiting = None
            for i in range(0, len(out), 1_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 1_000], strict=True), types, strict=True)], names)

    return dealt.select("doc_id", "text", "ahead").mapInArrow(run, schema)


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_chain(table(spark, sf_dir, "documents").select("doc_id", "text"))
