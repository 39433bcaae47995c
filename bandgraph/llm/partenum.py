"""Exact Jaccard self-join of word shingle sets with PartEnum signatures, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from bandgraph.llm.common import meetings, split_keys
from bandgraph.llm.hashing import MULT, hashed_words, mixed, pieces
from bandgraph.operators.graph import components
from bandgraph.session import Scratch, cut, table

#: Words of a shingle, and the least similarity in percent: two sets link when 100 * common >= PERCENT * union.
SHINGLE, PERCENT = 4, 85
#: Second-level parts of a first-level part, and how many of them may differ: signatures are subsets of the others.
PARTS, DIFFER = 2, 1
#: Parts are this much more than differences, so that parts with elements alone are more than differences.
SPARE = 1.1
#: Ratio of a size band's ends. Narrow bands allow few differences but put more sets in two families; 1.6 gives least signatures.
BAND = 1.6
#: Bits of a set's parity sketch.
SKETCH = 512
#: One signature in FIRST is looked at in the first round.
FIRST = 8
#: Buckets of ids by which texts are chosen before they are shuffled; also the most rows of that broadcast.
BUCKETS = 1 << 20


def shingles_of(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of shingles of words with hashes h: size consecutive ones, or all if fewer."""
    if not len(h):
        return h
    n = min(size, len(h))
    acc = np.full(len(h) - n + 1, len(h) if len(h) < size else 0, np.uint64)
    for j in range(n):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : len(h) - n + 1 + j]
    acc = (acc ^ (acc >> np.uint64(32))) * MULT
    return np.unique(acc ^ (acc >> np.uint64(29)))


def sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The set of each text."""
    u, place, sizes = hashed_words(texts)
    h, ends = u[place], np.cumsum(sizes)
    return [shingles_of(h[e - n : e], size) for e, n in zip(ends, sizes, strict=True)]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return sets(pa.array([text], pa.string()), size)[0]


def parity(x: np.ndarray) -> np.ndarray:
    """SKETCH bits as longs, each the parity of how many elements fall on it: two differ in at most |x sym-diff y| bits."""
    at = (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SKETCH.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def fine(x: np.ndarray) -> bytes | None:
    """A parity sketch of twice as many bits as elements, or up to twice that; None where the SKETCH bits are as many."""
    bits = 1 << (2 * len(x) - 1).bit_length()
    if bits <= SKETCH:
        return None
    at = (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two fine sketches differ, which is the symmetric difference at most; the longer is folded to the shorter's bits."""
    x, y = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum(dtype=np.int64))


class Bands:
    """Bands of sizes. Family i is band i and the sizes above it that a set of band i can be similar to."""

    def __init__(self, percent: int = PERCENT, most: int = 1 << 40):
        self.percent, low = percent, [1]
        while low[-1] <= most:
            low.append(max(low[-1] + 1, int(low[-1] * BAND)))
        self.low = np.array(low)

    def families(self, n: int) -> list[int]:
        """The families of a set: its own band's, and the lower one's if a set there can be similar."""
        own = int(np.searchsorted(self.low, n, side="right")) - 1
        return [own - 1, own] if own and n <= self.top(own - 1) else [own]

    def top(self, family: int) -> int:
        """The largest size that can be similar to one of band `family`: percent * top <= 100 * (largest of the band)."""
        return (int(self.low[family + 1]) - 1) * 100 // self.percent

    def budget(self, family: int) -> int:
        """Most elements in the symmetric difference of two linked sets of this family.

        |x sym y| = |x| + |y| - 2 common <= (|x| + |y|) (100 - p) / (100 + p), with at least one set in the band itself.
        """
        return (self.top(family) + int(self.low[family + 1]) - 1) * (100 - self.percent) // (100 + self.percent)


def signatures(x: np.ndarray, bands: Bands) -> np.ndarray:
    """64-bit signatures of a set; linked sets share at least one.

    The domain of element hashes is cut into first-level parts, these into PARTS second-level parts, n1 PARTS in all. With
    k differences at most, and n1 (DIFFER + 1) > k, some first-level part has at most DIFFER of them, so one subset of
    PARTS - DIFFER of its second-level parts is equal in both sets. Each subset gives the hash of the family, the subset and
    its elements. Subsets without elements are left out if the set has more than k others: at most k of those can differ,
    so an equal one is left; a set with fewer gives all.
    """
    out = []
    for family in bands.families(len(x)):
        k = bands.budget(family)
        h = (x * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)
        seed = np.uint64((family * 131 + 1) * 0xA24BAED4963EE407 % 2**64)
        n1 = int(np.ceil(SPARE * (k + 1) / (DIFFER + 1))) if k else 1
        keep = PARTS - DIFFER if k else PARTS
        sums, full = (v.reshape(n1, PARTS) for v in _sums((h % np.uint64(n1 * PARTS)).astype(np.int64), x, n1 * PARTS))
        sparse = full.sum() > k if keep == 1 else False
        for c, subset in enumerate(combinations(range(PARTS), keep)):
            mark = _mark(seed + np.uint64(c), np.arange(n1, dtype=np.uint64), [sums[:, s] for s in subset])
            out.append(mark[full[:, subset[0]]] if sparse else mark)
    return np.concatenate(out)


def _mark(seed, place: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
    h = seed + place * np.uint64(0xD6E8FEB86659FD93)
    for s in sums:
        h = mixed(h) + s
    return mixed(h)


def _sums(place: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of mixed elements in each of n parts, and whether it has any."""
    order = np.argsort(place, kind="stable")
    p, values = place[order], mixed(x)[order]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    out, full = np.zeros(n, np.uint64), np.zeros(n, bool)
    if len(p):
        out[p[first]], full[p[first]] = np.add.reduceat(values, first), True
    return out, full


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def set_id(x: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63)


def profiles(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch, fine, sigs) of docs (doc_id, text); set_id is a hash of the set, null without words.

    A task gives the sigs of equal sets once, so copies are combined before anything is shuffled.
    """
    schema = "doc_id bigint, n_shingles bigint, set_id bigint, sketch array<bigint>, fine binary, sigs array<bigint>"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, done, out = Bands(percent), set(), []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            if len(done) > 200_000:
                done.clear()
            for doc_id, x in ((d, x) for part in pieces(batch) for d, x in zip(part["doc_id"].to_pylist(), sets(part["text"], size), strict=True)):
                own = set_id(x) if len(x) else None
                fresh = own is not None and doc_id is not None and own not in done
                if fresh:
                    done.add(own)
                out.append((doc_id, len(x), own, parity(x) if len(x) else None, fine(x) if len(x) else None, signatures(x, bands).view(np.int64) if fresh else None))
                if len(out) >= 2_000:
                    yield flush()
                    out.clear()
        if out:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set_ids whose sets, made anew from texts (set_id, text), link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 100):  # only these texts become strings
                part = whole.slice(first, 100)
                a, b, x, y = (part.column(c).to_pylist() for c in ("a", "b", "x", "y"))
                text = dict(zip(a, x, strict=True)) | dict(zip(b, y, strict=True))
                # A set that isn't the one meant is of another text under the same id.
                made = {k: v for k, v in zip(text, sets(pa.array(list(text.values()), pa.string()), size), strict=True) if len(v) and set_id(v) == k}
                ok = [i in made and j in made and linked(made[i], made[j], percent) for i, j in zip(a, b, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    text = lambda k, t: texts.select(F.col("set_id").alias(k), F.col("text").alias(t))
    return pairs.join(text("a", "x"), "a").join(text("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set_ids whose fine sketches allow a link, or that have none; classes is (set_id, n, fine).

    The SKETCH bits of large sets are mostly noise, and texts are many times as long as a fine sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, y, n = (part.column(c).to_pylist() for c in ("x", "y", "n"))
            ok = [i is None or j is None or apart(i, j) * (100 + percent) <= m * (100 - percent) for i, j, m in zip(x, y, n, strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k, f: classes.select(F.col("set_id").alias(k), F.col("n").alias(f"n{k}"), F.col("fine").alias(f))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(run, "a bigint, b bigint")


def _may_link(x: str, y: str, percent: int):
    """Whether sizes n and sketches of two sets allow a link: both bound the symmetric difference from below."""
    far = sum((F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    most = (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)
    return (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) * (100 + percent) <= most) & (far * (100 + percent) <= most)


def _nearest(sides: DataFrame, limit: int, percent: int) -> DataFrame:
    """Distinct (a, b, sig): pairs that may link, with no sig, and sigs that have more of them; from rows (sig, i, j, side, set_id, comp, n, sketch) sorted by (sig, i, j, side).

    In each (sig, i, j), which has two chunks of rows at most, every row of side 0 is compared with those of side 1 in
    other components by sizes and sketches, which bound the symmetric difference from below. The `limit` nearest by sketch
    are given; if there are others, sig is given as well. A task gives a pair once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held, names = None, ["sig", "i", "j", "side", "set_id", "comp", "n"]
        for batch in _with_end(batches):
            if batch is None:
                if held is None:
                    return
                cols, sk, last = held[0], held[1], True
            else:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
                sk = batch.column(7).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH // 64)
                if held is not None:
                    cols, sk = [np.concatenate(p) for p in zip(held[0], cols, strict=True)], np.concatenate([held[1], sk])
                last = False
            if not len(sk):
                continue
            sig, i, j, side, ids, comp, n = cols
            first = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            ends = np.r_[first[1:], len(sig)]
            out, rest = [], []
            for lo, hi in zip(first if last else first[:-1], ends if last else ends[:-1], strict=True):
                mid = lo + int(np.searchsorted(side[lo:hi], 1))
                for x in range(lo, mid):
                    far = np.bitwise_count(sk[mid:hi] ^ sk[x]).sum(1, dtype=np.int64)
                    most = (n[mid:hi] + n[x]) * (100 - percent)
                    ok = np.flatnonzero((comp[mid:hi] != comp[x]) & (far * (100 + percent) <= most) & (np.abs(n[mid:hi] - n[x]) * (100 + percent) <= most))
                    more = len(ok) > limit
                    if more and rest[-1:] != [sig[x]]:
                        rest.append(sig[x])
                    for y in ok[np.argsort(far[ok], kind="stable")[:limit]] if more else ok:
                        pair = (min(ids[x], ids[mid + y]), max(ids[x], ids[mid + y]), None)
                        if pair not in seen:
                            seen.add(pair)
                            out.append(pair)
            if len(seen) > 100_000:
                seen.clear()
            held = None if last else ([c[first[-1] :].copy() for c in cols], sk[first[-1] :].copy())
            out += [(None, None, k) for k in rest]
            for k in range(0, len(out), 50_000):
                part = out[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], ["a", "b", "sig"])

    return sides.mapInArrow(run, "a bigint, b bigint, sig bigint").distinct()


def _with_end(items):
    yield from items
    yield None


def _texts(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, text) of the representatives in pairs. Texts outside the wanted ids' buckets stay where they are."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(classes.select("set_id", "rep"), "set_id")
    wanted = cut(wanted)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    chosen = F.broadcast(wanted.select(bucket("rep").alias("k")).distinct())  # at most BUCKETS rows
    some = docs.join(chosen, bucket("doc_id") == F.col("k"), "left_semi")
    return wanted.join(some, F.col("rep") == F.col("doc_id")).select("set_id", "text")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text); exact but for collisions of 64-bit hashes.

    Equal sets are one class, which one representative (the least doc_id) stands for. Representatives that share a
    signature are candidates. First each is verified against the least set of its signatures: this joins large groups of
    near copies in as many pairs as they have members. Then, of signatures whose members lie in several components, members
    outside the largest are compared with those in other components, in chunks, by sizes and sketches first. Each gives
    its few nearest to be verified, those of large sets by longer sketches before any text is moved; signatures in which one has more are looked at again over the components that are left,
    for more of the nearest; of all others every pair has been verified. So no link between components is lost, and pairs within one are never all made.

    Null or wordless texts have n_shingles 0 and are their own component. A null id isn't linked with anything and has a
    null component. Rows of equal id are one document, with the least of their texts. An empty table gives no rows. Texts
    are taken whole, whatever their length. Other columns of docs aren't looked at.
    """
    docs = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        found = cut(profiles(docs, size, percent))
        rows = scratch.keep(cut(found.select("doc_id", "n_shingles", "set_id")))
        one = F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "sketch", "fine")).alias("m")
        classes = found.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(one)
        classes = cut(classes.select("set_id", F.col("m.doc_id").alias("rep"), "m.n", "m.sketch", "m.fine"))
        members = cut(meetings(found.select(F.explode("sigs").alias("sig"), "set_id"), "sig", "set_id").distinct())
        scratch.free(found)
        side = lambda k: classes.select(F.col("set_id").alias(k), F.struct("n", "sketch").alias(f"p{k}"))
        star = members.where("set_id <> head").groupBy(F.col("set_id").alias("b")).agg(F.min("head").alias("a"))
        star = star.join(side("a"), "a").join(side("b"), "b").where(_may_link("pa", "pb", percent)).select("a", "b")
        star = cut(_near(star, classes, percent))
        links = cut(_verified(star, _texts(star, docs, classes), size, percent))
        # A part of the signatures joins most of what is close; then all are looked at, and then those that have more.
        some, limit, whole = members.where(F.pmod(F.xxhash64("sig"), F.lit(FIRST)) == 0), 1, False
        while some is not None:
            with Scratch(docs.sparkSession) as round_:
                x, y = split_keys(some.select("sig", "set_id"), "sig", "set_id", components(links, "a", "b"))
                near = x.select("sig", "i", "j", F.lit(0).alias("side"), F.col("x").alias("set_id"), F.col("xc").alias("comp"))
                near = near.union(y.select("sig", "i", "j", F.lit(1), "y", "yc")).join(classes.select("set_id", "n", "sketch"), "set_id")
                near = near.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "side").select("sig", "i", "j", "side", "set_id", "comp", "n", "sketch")
                cross = cut(_nearest(near, limit, percent))
                pairs, rest = cut(_near(cross.where("a IS NOT NULL"), classes, percent)), cross.where("sig IS NOT NULL").select("sig")
                before, links = links, round_.keep(cut(links.union(_verified(pairs, _texts(pairs, docs, classes), size, percent))))
                again = members
                if whole:
                    again, limit = None if rest.isEmpty() else round_.keep(cut(some.join(rest, "sig", "left_semi"))), limit * 8
            scratch.free(before, *([some] if whole and some is not members else []))
            some, whole = again, True
        rep = lambda k: classes.select(F.col("set_id").alias(k), F.col("rep").alias(f"r{k}"))
        comp = components(links.join(rep("a"), "a").join(rep("b"), "b"), "ra", "rb")
        ids = classes.select("set_id", "rep").join(comp, F.col("rep") == F.col("node"), "left")
        ids = scratch.keep(cut(ids.select("set_id", F.coalesce("comp", "rep").alias("component"))))
    # Rows without words or an id need no partner, and so no task that gets all of them.
    alone = F.col("set_id").isNull() | F.col("doc_id").isNull()
    linked_ = rows.where(~alone).join(ids, "set_id").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return linked_.union(rows.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: The same by counting common shingles of all pairs, for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) c ON c.a = d.doc_id
"""
