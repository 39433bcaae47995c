"""Operators of the subpackage llm against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandgraph.llm import common, cws, decontaminate as dec, gbt, langid, licenses, line_dedup as lines, lm, mixing, partenum, toxicity, warc
from bandgraph.operators.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("size", "items", "removed", "n_words", "n_lines", "licences", "lang_pred", "score", "taken")}) if extra else df


WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti") for b in ("dan", "fer", "gol", "hin", "jup", "lem")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append([i, "\n".join(prose(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 5))), f"s{i % 4}"])
    for i in range(60, 80):
        rows.append([i, rows[i - 60][1], "s0"])
    for i in range(80, 110):
        w = rows[i - 80][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append([i, " ".join(w), None])
    rows += [[110, None, "s1"], [111, "", "s1"], [112, " \n\t ", "s2"], [113, "One", "s2"], [114, "### $$$", "s3"], [None, "no id here at all", "s3"]]
    rows += [rows[5], rows[110]]
    return rows


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 50), (50, 60), (70, 70)], "a long, b long")
    got = {r.node: r.comp for r in components(links, "a", "b").collect()}
    assert got == {k: 0 for k in range(21)} | {40: 40, 50: 40, 60: 40}
    assert components(links.where("a < 0"), "a", "b").count() == 0


def test_mixing(spark, corpus):
    out = mixing.mix(docs(spark, corpus, True), mixing.word_count(F.col("text"))).toPandas()
    assert len(out) == len(corpus) and not out.columns.duplicated().any()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in corpus]
    total = Counter()
    for (_, _, s), n in zip(corpus, size, strict=True):
        total[s] += n
    # Water filling by bisection.
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * total[s], mid * weight[s]) for s in order) < 1.5 * sum(size) else (lo, mid)
    for s in order:
        got = out[out.source.isna()] if s is None else out[out.source == s]
        target = min(2 * total[s], lo * weight[s])
        assert got.target.iloc[0] == pytest.approx(target, rel=1e-9)
        assert abs(got.taken.sum() - target) <= 2 * max(size)
    assert (out.taken <= 2 * out["size"]).all() and out.taken.sum() <= 1.5 * sum(size) + 1
    assert mixing.mix(docs(spark, corpus).where("doc_id < 0"), mixing.word_count(F.col("text"))).count() == 0


def test_decontamination(spark, corpus):
    rng = random.Random(5)
    items = [(0, " ".join(corpus[3][1].split()[:14])), (1, prose(rng, 20)), (2, "One"), (3, None), (4, "..."), (10, " ".join(corpus[7][1].split()[-12:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = dec.decontaminate(docs(spark, corpus, True), bench).toPandas()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = {(k, tuple(w[i : i + 10])) for k, t in items for w in [words(t)] if w for i in range(max(len(w) - 9, 1))}
    want = Counter()
    for i, t, _ in corpus:
        w, hit, found = words(t), set(), set()
        for k, g in grams:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(str(k))
        want[(i, len(w), len(hit), ",".join(sorted(found)), bool(hit))] += 1
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"]), bool(r.contaminated)) for _, r in out.iterrows())
    assert got == want and sum(c for (*_, hit), c in want.items() if hit) > 3
    assert dec.decontaminate(docs(spark, corpus), bench.where("item_id < 0")).where("contaminated").count() == 0


def test_decontamination_by_shuffle_equals_broadcast(spark, corpus, monkeypatch):
    bench = spark.createDataFrame([(0, " ".join(corpus[3][1].split()[:14]))], "item_id long, text string")
    one = dec.decontaminate(docs(spark, corpus), bench).select("doc_id", "n_hit").collect()
    monkeypatch.setattr(dec, "BROADCAST_ROWS", -1)
    two = dec.decontaminate(docs(spark, corpus), bench).select("doc_id", "n_hit").collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))


def normal(t):
    return re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()


def similar_lines(lines_):
    """Pairs of lines of edit similarity 0.8, by edit distance alone."""
    at = duckdb.connect()
    at.register("l", pd.DataFrame({"x": list(lines_)}))
    near = "l a JOIN l b ON a.x < b.x AND 5 * abs(length(a.x) - length(b.x)) <= greatest(length(a.x), length(b.x))"
    return at.execute(f"SELECT a.x, b.x FROM {near} WHERE 5 * levenshtein(a.x, b.x) <= greatest(length(a.x), length(b.x))").fetchall()


def expected_lines(rows):
    """(id, text, removed) of each row, with links by edit similarity alone; and the number of links."""
    places = {}
    for i, t, _ in rows:
        for k, line in enumerate((t or "").split("\n")):
            if n := normal(line):
                places.setdefault(n, []).append(((2**63 - 1) if i is None else i, k))
    parent, links = {n: n for n in places}, 0

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in similar_lines(places):
        parent[root(a)], links = root(b), links + 1
    first = {}
    for n in places:
        first[root(n)] = min([*places[n], first.get(root(n), (2**64, 0))])
    want = Counter()
    for i, t, _ in rows:
        k = (2**63 - 1) if i is None else i
        gone = [j for j, line in enumerate((t or "").split("\n")) if (n := normal(line)) and first[root(n)] != (k, j)]
        text = None if t is None else t if not gone else "\n".join(line for j, line in enumerate(t.split("\n")) if j not in gone)
        want[(i, text, tuple(gone))] += 1
    return want, links


def test_line_dedup(spark, corpus):
    df = docs(spark, corpus, True)
    out = lines.dedup_lines(df).toPandas()
    want, links = expected_lines(corpus)
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.text, tuple(int(x) for x in r.removed)) for _, r in out.iterrows())
    assert links > 0 and got == want
    assert lines.dedup_lines(df.where("doc_id < 0")).count() == 0


def test_blocks_are_majorities_of_their_voters(spark):
    rng = random.Random(9)
    for n in (1, 2, 5, 60, 700):
        h = sorted(rng.randrange(-(2**63), 2**63) for _ in range(n))
        groups = {}
        for x in h:
            groups.setdefault(((x & (2**64 - 1)) >> 32) * lines.BLOCKS >> 32, []).append(x)
        want = []
        for v in groups.values():
            if len(v) > 1:
                ones = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in v[:3]) > len(v[:3]))
                want.append(ones - 2**64 if ones >> 63 else ones)
        got = spark.createDataFrame([(h,)], "ring array<bigint>").select(lines._blocks(F.col("ring")).alias("b"), lines._pairs(F.col("ring")).alias("p")).first()
        assert sorted(got.b) == sorted(want) and got.p == [x & y for x, y in zip(h, [*h[1:], h[0]], strict=True)], n


def test_recall_of_line_links_against_edit_similarity(spark):
    """Near copies by replaced, dropped, added and misspelt words, of lines of 1 to 90 words; nine in ten links are found."""
    rng, rows = random.Random(61), []
    for i in range(220):
        w = [rng.choice(WORDS) + rng.choice(WORDS) * rng.randint(0, 1) for _ in range(rng.choice((1, 2, 3, 5, 8, 12, 20, 35, 60, 90)))]
        rows.append((2 * i, " ".join(w), None))
        for _ in range(max(1, len(w) // rng.choice((6, 10, 20)))):
            p, kind = rng.randrange(len(w)), rng.randrange(4)
            w[p : p + 1] = [[rng.choice(WORDS)], [], [w[p], rng.choice(WORDS)], [w[p][:3] + w[p][4:]]][kind]
        rows.append((2 * i + 1, " ".join(w), None))
    want, links = expected_lines(rows)
    want = {i for i, _, gone in want if gone}
    got = {r.doc_id for r in lines.dedup_lines(docs(spark, rows)).where("size(removed) > 0").collect()}
    assert links > 150 and got <= want and len(got) >= 0.95 * len(want), (len(got), len(want))


def test_lines_of_rows_with_one_id(spark):
    rows = [(1, "alpha beta gamma delta\nother words entirely here", None), (1, "alpha beta gamma delta", None), (1, "alpha beta gamma delta", None)]
    out = lines.dedup_lines(docs(spark, rows)).collect()
    left = [r.text for r in out if "alpha" in r.text]
    assert len(out) == 3 and (len(left) == 1 or left == [rows[1][1]] * 2)  # of different texts one keeps the line


def test_line_dedup_finds_what_edit_similarity_alone_links(spark):
    rng = random.Random(47)
    base = [prose(rng, n) for n in range(3, 33)]
    rows = [(i, t, None) for i, t in enumerate(base)]
    for k, t in enumerate(base):
        w = t.split()
        for p in rng.sample(range(len(w)), max(1, len(w) // 12)):
            w[p] = rng.choice(["changed", "renewed"])
        rows += [(100 + k, " ".join(w), None), (200 + k, t[:5] + t[6:], None), (300 + k, t + "s", None)]
    rows += [(500, "subscribe", None), (501, "Subscribed", None), (502, "", None), (503, None, None)]
    norms = sorted({normal(t) for _, t, _ in rows if t})
    parent, links = {n: n for n in norms}, 0

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in similar_lines(norms):
        parent[root(a)], links = root(b), links + 1
    first = {}
    for i, t, _ in rows:
        if t:
            first.setdefault(root(normal(t)), i)
    want = {i for i, t, _ in rows if t and first[root(normal(t))] != i}
    got = {r.doc_id for r in lines.dedup_lines(docs(spark, rows)).where("size(removed) > 0").collect()}
    assert links > 100 and got == want


def jaccard_truth(rows, size, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()

    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None:
            continue
        both = len(sets[a] & sets[b])
        if rows[a][0] == rows[b][0] or sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[root(k)] = min(r[0], ids.get(root(k), 2**62))
    return Counter((r[0], len(s), ids.get(root(k))) for k, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components(spark, corpus, size, percent):
    rng = random.Random(11)
    rows = [list(r) for r in corpus]
    base = prose(rng, 1500).split()  # large sets: sampled coarse parts
    for k in range(12):
        w = list(base)
        for p in rng.sample(range(len(w)), 10 + 6 * k):
            w[p] = f"z{k}x{p}"
        rows.append([200 + k, " ".join(w), None])
    out = partenum.jaccard_components(docs(spark, rows, True), size, percent).toPandas()
    got = Counter((None if np.isnan(a) else int(a), b, None if np.isnan(c) else int(c)) for a, b, c in out[["doc_id", "n_shingles", "component_id"]].itertuples(index=False))
    assert got == jaccard_truth(rows, size, percent)


def test_hot_signatures_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 64)
    monkeypatch.setattr(common, "SAMPLE", 4)
    rng = random.Random(13)
    base = prose(rng, 60).split()
    rows = []
    for k in range(150):
        w = list(base)
        for p in rng.sample(range(60), 2):
            w[p] = f"v{k}{p}"
        rows.append([k, " ".join(w), None])
    out = partenum.jaccard_components(docs(spark, rows)).toPandas()
    assert Counter(zip(out.doc_id, out.n_shingles, out.component_id, strict=True)) == jaccard_truth(rows, 4, 85)


def test_only_signatures_that_have_more_are_looked_at_again(spark, monkeypatch):
    """Texts that just miss the threshold: sixty of one base, and many of two each, all pairs of which the first rounds verify."""
    rng, rows = random.Random(71), []

    def near(k):
        base = [rng.choice(WORDS) + str(k) + rng.choice(WORDS) for _ in range(103)]
        for i in range(60 if k == 0 else 2):
            w = list(base)
            w[5 + (i * 7) % 90], w[-1] = f"mid{i}", f"end{i}"
            rows.append((len(rows), " ".join(w), None))

    for k in range(120):
        near(k)
    seen, nearest = [], partenum._nearest
    monkeypatch.setattr(partenum, "_nearest", lambda sides, limit, percent: seen.append(sides.select("sig").distinct().count()) or nearest(sides, limit, percent))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in partenum.jaccard_components(docs(spark, rows)).collect())
    assert got == jaccard_truth(rows, partenum.SHINGLE, partenum.PERCENT)
    assert len(seen) > 2 and seen[2] < seen[1] / 2, seen


def test_large_sets_are_told_apart_before_their_texts_are_moved(spark, monkeypatch):
    """Long texts a little below the threshold, which 512 bits can't tell from linked ones, and some above it."""
    rng, rows = random.Random(83), []
    for k in range(6):
        base = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(1500)]
        for i in range(5):
            w = list(base)
            for p in range(i, 1500, 40 if i < 3 else 200):  # 152 of 1497 shingles, or 32, are a text's own
                w[p] = f"own{k}x{i}x{p}"
            rows.append((len(rows), " ".join(w), None))
    seen, verified = [], partenum._verified
    monkeypatch.setattr(partenum, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    out = partenum.jaccard_components(docs(spark, rows)).collect()
    want = jaccard_truth(rows, 4, 85)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want and len({c for _, _, c in want}) < len(rows)
    assert sum(seen) <= 40, seen
    for _ in range(200):
        x, y = (np.unique(np.array([rng.randrange(2**64) for _ in range(rng.choice((300, 1100, 2500)))], np.uint64)) for _ in "xy")
        y = np.unique(np.r_[x[: rng.randrange(len(x))], y[: rng.randrange(300, len(y) + 1)]])
        if partenum.fine(x) and partenum.fine(y):
            assert partenum.apart(partenum.fine(x), partenum.fine(y)) <= len(np.setxor1d(x, y))


def test_signatures_of_linked_sets_meet():
    rng, bands = np.random.default_rng(17), partenum.Bands()
    for n in (1, 2, 6, 7, 13, 40, 160, 700, 3_000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            out = int(rng.integers(0, n * 15 // 100 + 1))
            y = np.unique(np.concatenate([x[out:], rng.integers(0, 2**63, max(0, int(n * 0.08) - out // 2), dtype=np.uint64)]))
            if len(y) and partenum.linked(x, y):
                assert set(partenum.signatures(x, bands)) & set(partenum.signatures(y, bands)), n
                far = np.bitwise_count(partenum.parity(x).view(np.uint64) ^ partenum.parity(y).view(np.uint64)).sum()
                assert far <= len(np.setxor1d(x, y))


def test_fingerprints(spark, corpus):
    rows = [r for r in corpus if r[0] is not None][:-2]
    out = cws.edit_chain(docs(spark, rows), 5).toPandas().sort_values("doc_id").reset_index(drop=True)
    rows = sorted(rows, key=lambda r: r[0])
    text = [t or "" for _, t, _ in rows]
    after = text[1:] + text[:1]
    assert out.n_chars.tolist() == [len(t) for t in text]
    new = [cws.edited(a, b) for a, b in zip(text, after, strict=True)]
    assert out.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in new]
    s = cws.Sampler()
    assert out.fingerprint.tolist() == [cws.fingerprint_text(s.samples(h)) for h in cws.hashed_texts(text)]
    assert out.edited_fingerprint.tolist() == [cws.fingerprint_text(s.samples(h)) for h in cws.hashed_texts(new)]
    assert out.near_next.tolist() == [cws.likeness(s.samples(a), s.samples(b)) for a, b in zip(cws.hashed_texts(text), cws.hashed_texts(after), strict=True)]
    again = cws.fingerprint(docs(spark, rows)).select("doc_id", "fingerprint", cws.similarity(F.col("fingerprint"), F.col("fingerprint")).alias("same"))
    assert all(r.same == 1.0 for r in again.collect())
    assert cws.edit_chain(docs(spark, rows).where("doc_id < 0")).count() == 0
    one = cws.edit_chain(docs(spark, rows).where("doc_id = 3")).first()
    assert one.near_next == 1.0


def test_samples_are_the_least_over_every_term():
    """The sampler's definition, a term and a sample at a time, for texts of few, many, once and often used words."""
    s, rng = cws.Sampler(), random.Random(53)
    texts = ["one", "a a a a", prose(rng, 40), " ".join([prose(rng, 3)] * 9), " ".join(f"w{i}" for i in range(3_000)) + " w1" * 50]
    for h in cws.hashed_texts(texts):
        x, count = s.terms(h)
        assert Counter(dict(zip(x.tolist(), count.tolist(), strict=True))).total() == 2 * len(h) - 1
        bits, some = s.hashes(x), range(0, cws.SAMPLES, 1 if len(x) < 100 else 16)
        a, term, code = s.least(x, count)
        for k in some:
            best = (np.inf, 0, 0)
            for g, e, n in zip(bits[k].tolist(), x.tolist(), count.tolist(), strict=True):
                at, low = g >> 16, g & 0xFFFF
                t = np.floor(np.float32(0.5 * np.log(n)) / s.r[at] + s.beta[at])
                best = min(best, (s.one[at] + s.step[at] * low - s.r[at] * t, e, (e + int(t) * 0xA24BAED4963EE407) % 2**64))
            assert (term[k], code[k]) == best[1:] and abs(a[k] - best[0]) < 1e-5


def test_long_text_null_ids_and_repeats_of_fingerprints(spark):
    rng = random.Random(59)
    rows = [(1, prose(rng, 60_000), None), (None, "no id", None), (None, "no id", None), (2, None, None), (2, "b", None), (2, "b", None), (3, "", None)]
    out = cws.edit_chain(docs(spark, rows, True), 3).collect()
    assert len(out) == len(rows) and sum(r.doc_id is None for r in out) == 2
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    text = [t or "" for _, t, _ in order]
    want = Counter((i, len(t), hashlib.sha256(cws.edited(t, n).encode()).hexdigest()) for (i, _, _), t, n in zip(order, text, text[1:] + text[:1], strict=True))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want


def test_collision_rate_is_generalised_jaccard():
    rng, s, err = random.Random(19), cws.Sampler(), []
    for _ in range(150):
        a = [rng.choice(WORDS) for _ in range(120)]
        b = a[: rng.randint(10, 110)] + [rng.choice(WORDS) for _ in range(40)]
        ta, tb = (dict(zip(*s.terms(h), strict=True)) for h in cws.hashed_texts([" ".join(a), " ".join(b)]))
        keys = set(ta) | set(tb)
        w = lambda t, k: t.get(k, 0) ** 0.5
        want = sum(min(w(ta, k), w(tb, k)) for k in keys) / sum(max(w(ta, k), w(tb, k)) for k in keys)
        err.append(cws.likeness(*map(s.samples, cws.hashed_texts([" ".join(a), " ".join(b)]))) - want)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.08


def test_trees_and_isotonic():
    rng = np.random.default_rng(23)
    x = rng.normal(size=(1500, 4))
    p = 1 / (1 + np.exp(-3 * x[:, 0] * (x[:, 1] > 0)))
    y = (rng.random(1500) < p).astype(float)
    trees, (knots, values) = gbt.calibrated(x[:1000], y[:1000], np.arange(1000))
    got = np.interp(trees.margin(x[1000:]), knots, values)
    assert (np.diff(values) >= 0).all() and ((got - p[1000:]) ** 2).mean() < 0.03


def test_toxicity(spark):
    rng = random.Random(29)
    rows, labels = [], []
    for i in range(300):
        w = prose(rng, 40).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["qzarfen", "qzarlot", "idiot"])
        rows.append((i, " ".join(w), None))
        labels.append((i, int(toxic)))
    rows += [(300, None, None), (301, "", None), (None, "idiot", None)]
    df, lab = docs(spark, rows, True), spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab.where("doc_id % 4 <> 2"))
    out = toxicity.toxicity(df, model).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    held = out[out.doc_id % 4 == 2]
    assert ((held.score >= toxicity.THRESHOLD) == (held.doc_id % 3 == 0)).mean() > 0.95


def test_language_model(spark, corpus):
    df = docs(spark, corpus)
    train = df.where("doc_id % 3 <> 0")
    model, bits, words = lm.fit(train)
    got = Counter((None if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score(df, model, bits, words).collect())
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), " "]
    c = Counter(w for i, t, _ in corpus if i is not None and i % 3 for w in token(t))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.distinct) == (n, v)
    want = Counter((i, len(token(t)), sum(c[w] > 0 for w in token(t)), round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(t)), 6)) for i, t, _ in corpus)
    assert got == want


def test_rare_words_by_join_give_the_same(spark, corpus, monkeypatch):
    df = docs(spark, corpus)
    model, bits, words = lm.fit(df)
    key = lambda rows: Counter((r.doc_id, r.n_known, round(r.base_score, 6)) for r in rows)
    one = key(lm.score(df, model, bits, words).collect())
    monkeypatch.setattr(lm, "HEAD", 20)
    assert key(lm.score(df, model, bits, words).collect()) == one


def test_scores_are_those_of_quantised_counts_in_either_form_of_the_filter(spark, corpus, monkeypatch):
    """Against counts kept exactly and quantised afterwards; a filter in parts, of several parts a task, gives the same."""
    df = docs(spark, corpus)
    train = df.where("doc_id % 3 <> 0")
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), " "]
    texts = [token(t) for i, t, _ in corpus if i is not None and i % 3]
    c, n = Counter(w for t in texts for w in t), sum(map(len, texts))
    two = Counter(p for t in texts for p in zip([" ", *t], t))  # noqa: B905
    read = lambda x: float(lm.quantum(lm.quantised(np.array([x])))[0]) if x else 0.0

    def score(t, model):
        out = 0.0
        for v, w in zip([" ", *t], t):  # noqa: B905
            cv, cw = read(c[v]), read(c[w])
            a = model.weights[int(min(np.log2(max(cv, 0.5)) + 1, lm.CLASSES - 1))]
            one = max(cw - model.cut, 0.25) / n if cw else max(model.cut * len(c), 0.5) / n
            out += np.log10(a * min(read(two[v, w]), cv, cw) / max(cv, 1) + (1 - a) * one)
        return out

    monkeypatch.setattr(lm, "BITS_PER_TOKEN", 64)  # hardly any key is found by chance
    for most in (1 << 29, 1 << 10):
        monkeypatch.setattr(lm, "MOST_BITS", most)
        monkeypatch.setattr(lm, "HEAD", 400_000 if most > 1 << 20 else 20)
        monkeypatch.setattr(lm, "PARTS", 64 if most > 1 << 20 else 2)
        monkeypatch.setattr(lm, "PART_BITS", 1 << 23 if most > 1 << 20 else 1 << 12)
        model, bits, words = lm.fit(train)
        got = sorted((r.doc_id or -1, r.score) for r in lm.score(df, model, bits, words).collect())
        want = sorted((i or -1, score(token(t), model)) for i, t, _ in corpus)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.mean(np.isclose([x for _, x in got], [x for _, x in want], atol=1e-4)) > 0.95, most


def test_weights_come_from_all_distinct_texts(spark):
    import pyarrow as pa

    rng = random.Random(59)
    texts = [prose(rng, 1_500) if k % 2 else " ".join(f"r{k}x{i}" for i in range(1_500)) for k in range(240)]
    df = docs(spark, [[k, t, None] for k, t in enumerate(texts + texts[:40])])
    model, bits, _ = lm.fit(df)
    again = lm.Model(model.bits, model.tokens, model.distinct, 0, 0).over(bits.value)
    again.cut = model.cut
    got = [again.parts(h, sizes, less=1) for _, _, h, sizes in lm.blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))]
    again.tune(*(np.concatenate(x) for x in zip(*got, strict=True)))
    assert np.allclose(model.weights, again.weights, rtol=1e-9, atol=0)


def test_language_model_of_nothing_and_of_a_long_text(spark):
    df = docs(spark, [(1, None, None), (2, "", None), (3, prose(random.Random(3), 30_000), None)], True)
    model, bits, words = lm.fit(df.where("doc_id < 0"))
    got = lm.score(df, model, bits, words).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known) for r in got} == {(1, 1, 0), (2, 1, 0), (3, 30_001, 0)} and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert lm.score(df.where("doc_id < 0"), *lm.fit(df)).count() == 0


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(31)
    keys, counts = rng.integers(0, 2**lm.KEY_BITS, 5_000, dtype=np.uint64), rng.geometric(0.2, 5_000)
    f = lm.Filter(1 << 20)
    f.add(keys, counts)
    assert (f.levels(keys) >= lm.quantised(counts)).all() and (f.levels(keys) == lm.quantised(counts)).mean() > 0.95
    assert (f.levels(rng.integers(0, 2**lm.KEY_BITS, 5_000, dtype=np.uint64)) > 0).mean() < 0.02


def test_the_filter_is_asked_once_for_each_bigram_of_a_block(monkeypatch):
    h = np.array([1, 2, 1, 2, 1, 2, 9, 1, 2, 1, 2, 9], np.uint64)
    model, asked, levels = lm.Model(1 << 16, 12, 3, 1, 1).over(np.zeros(1 << 13, np.uint8)), [], lm.Filter.levels
    model.filter.add(*np.unique(lm.bigram_keys(lm.previous(h, np.array([7, 5])), h), return_counts=True))
    model.filter.add(*np.unique(lm.unigram_keys(h), return_counts=True))
    monkeypatch.setattr(lm.Filter, "levels", lambda self, keys: asked.append(keys) or levels(self, keys))
    _, two, _ = model.parts(h, np.array([7, 5]))
    assert all(len(k) == len(np.unique(k)) for k in asked)
    each = np.array([levels(model.filter, k)[0] for k in lm.bigram_keys(lm.previous(h, np.array([7, 5])), h)[:, None]])
    assert ((two > 0) == (each > 0))[1:7].all()


def test_language(spark):
    rng = random.Random(37)
    stems = {"aa": ["ba", "da", "ga", "la"], "bb": ["xi", "yi", "zi", "qi"]}
    make = lambda s, n: " ".join("".join(rng.choice(stems[s]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(s, 30), s, None, None) for i in range(80) for s in [("aa", "bb")[i % 2]]]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    tests = [(0, make("aa", 900), None), (1, make("bb", 3), None), (2, make("aa", 40) + " " + make("bb", 20), None), (3, None, None), (4, "12 ## ", None), (None, make("bb", 5), None)]
    out = langid.identify(docs(spark, tests, True), model).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [r.lang_pred for r in out] == ["aa", "bb", "aa", "und", "und", "bb"]
    assert out[2].lang_shares["bb"] == pytest.approx(1 / 3, abs=0.05) and out[2].lang_switches <= 3 and out[3].score == 0
    assert {r.lang_pred for r in langid.identify(docs(spark, tests), langid.Tagger().fit([], [])).collect()} == {"und"}


def test_words_are_found_fast_and_as_by_the_class_of_letters():
    rng = random.Random(53)
    odd = ["½abc", "abⅷcd²ef", "a" * 60, "Ünï٣x", "_a_b", "x" * 24 + "Ⅻ" + "y" * 30, "漢字仮名", "İstanbul", "12 ##", ""]
    for _ in range(200):
        text = " ".join(rng.choice(odd + WORDS) for _ in range(rng.randint(0, 20)))
        assert langid.words_of(text) == langid.WORD.findall(text.lower())
    assert langid.words_of(None) == []
    text, took = prose(rng, 50_000), []
    for find in (langid.words_of, langid.WORD.findall):
        began = time.perf_counter()
        find(text)
        took.append(time.perf_counter() - began)
    assert took[0] < took[1] / 3


def test_forward_backward_is_exact():
    rng = np.random.default_rng(41)
    scores, moves = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    got, pairs = langid.forward_backward(scores, np.array([4, 3]), moves, True)
    want, count = np.zeros((7, 2)), np.zeros((2, 2))
    for lo, n in ((0, 4), (4, 3)):
        paths = np.array(np.meshgrid(*[[0, 1]] * n)).reshape(n, -1).T
        e = np.array([sum(scores[lo + t, p[t]] for t in range(n)) + sum(moves[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        p = np.exp(e) / np.exp(e).sum()
        for path, q in zip(paths, p, strict=True):
            for t in range(n):
                want[lo + t, path[t]] += q
                if t + 1 < n:
                    count[path[t], path[t + 1]] += q
    assert np.allclose(got, want) and np.allclose(pairs, count)


def test_licences(spark):
    rng = random.Random(43)
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(3)), None) for i in range(60)]
    rows[3] = (3, rows[3][1] + "\nReleased under the MIT License.", None)
    rows[4] = (4, "This work is licensed under the GNU General Public License, version 3.\n" + rows[4][1], None)
    rows += [(70, "You need a driving license to rent a car.", None), (71, None, None), (72, "", None), (3, rows[3][1], None), (None, "Licensed under CC BY-NC 4.0.", None)]
    df = docs(spark, rows, True)
    model = licenses.fit(df)
    out = licenses.classify(df, model).collect()
    got = Counter((r.doc_id, tuple((x.line_no, x.family) for x in r.licences)) for r in out)
    want = Counter((i, tuple((k, f) for k, line in enumerate((t or "").split("\n")) if line and (f := model.predict(line)[0]) != "unknown")) for i, t, _ in rows)
    assert got == want and got[(3, ((3, "mit"),))] == 2 and got[(None, ((0, "cc-by-nc-4.0"),))] == 1 and got[(70, ())] == 1


def test_short_licence_notices_are_found(spark):
    rng = random.Random(53)
    notices = {"All rights reserved.": "proprietary", "MIT License": "mit", "The MIT License": "mit", "Apache License 2.0": "apache-2.0", "Apache License, Version 2.0": "apache-2.0", "GNU General Public License v3.0": "gpl-3.0", "BSD 3-Clause License": "bsd-3-clause", "Mozilla Public License 2.0": "mpl-2.0", "CC BY 4.0": "cc-by-4.0", "CC BY-NC 4.0": "cc-by-nc-4.0", "CC BY-SA 4.0": "cc-by-sa-4.0", "CC0 1.0 Universal": "cc0-1.0"}
    none = ["All seats are reserved for guests.", "She got a license after her studies at MIT.", "The rights of all were reserved by the court."]
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(3)), None) for i in range(200)]
    rows += [(1_000 + k, f"{prose(rng, 9)}\n{t}\n{prose(rng, 9)}", None) for k, t in enumerate([*notices, *none])]
    df = docs(spark, rows)
    got = {r.doc_id: [(x.line_no, x.family) for x in r.licences] for r in licenses.classify(df, licenses.fit(df)).collect() if r.licences}
    assert got == {1_000 + k: [(1, f)] for k, f in enumerate(notices.values())}


def test_revisits(spark):
    at = lambda m: F.timestamp_seconds(F.lit(m * 60))
    rows = [
        ("r1", "http://www.A.com/x/", 1, "response", 200, {"ETag": '"1"', "X": "y"}, "d1"), ("r2", "http://a.com/x", 3, "response", 200, {"etag": '"2"', "Last-Modified": "m"}, "d2"), ("r3", "https://a.com/x", 4, "response", 404, {}, "d3"),
        ("v1", "HTTPS://a.com:443/x?utm_source=q#f", 2, "revisit", 304, {"ETag": 'W/"1"', "X": "z", "Date": "t"}, None), ("v2", "http://a.com/x", 9, "revisit", 304, {"Last-Modified": "m"}, None),
        ("v3", "http://a.com/x", 3, "revisit", 304, {"ETag": '"2"'}, None), ("v4", "http://a.com/x", 1, "revisit", 304, {}, None), ("v5", None, 5, "revisit", 304, None, None), ("v6", "http://a.com/x", 9, "revisit", 304, {}, None), ("v2", "http://a.com/x", 9, "revisit", 304, {"Last-Modified": "m"}, None),
    ]
    df = spark.createDataFrame(rows, "record_id string, url string, m long, kind string, status int, headers map<string,string>, digest string")
    df = df.select("record_id", "url", at(F.col("m")).alias("date"), "kind", "status", "headers", "digest")
    out = warc.resolve_revisits(df).collect()
    got = Counter((r.record_id, r.result, r.source_id) for r in out)
    assert got == Counter([("v1", "resolved", "r1"), ("v2", "resolved", "r2"), ("v2", "resolved", "r2"), ("v3", "changed", None), ("v4", "missing", None), ("v5", "missing", None), ("v6", "unverified", None)])
    merged = next(r.merged_headers for r in out if r.record_id == "v1")
    assert merged == {"etag": 'W/"1"', "x": "y", "date": "t"}
    assert warc.resolve_revisits(df.where("kind = 'x'")).count() == 0


#: Names that operators use inside, and columns that corpora have.
CLASHES = ("source", "at", "curl", "rid", "r", "r_id", "r_at", "r_url", "c_url", "key", "_key", "g_key", "g_doc_id", "g_lines", "f_doc_id", "f_text_key", "f_key", "f_hit", "f_items", "t_source", "t_size", "t_target",
           "g_source", "g_size", "g_copies", "words", "p_key", "p_doc_id", "p_found", "text_key", "line_no", "k0", "mark", "head", "tail", "set_id", "sig", "node", "comp", "uid", "n", "w", "part", "ahead", "id", "headers2", "Part", "size", "items", "score")


def test_clashing_names(spark, corpus):
    rows = [r for r in corpus if r[0] is not None and (r[0] < 12 or r[0] > 105)]
    extra = [c for c in CLASHES if c.lower() not in ("source",)]
    extra = list({c.lower(): c for c in extra}.values())
    df = docs(spark, rows).select("*", *(F.lit(f"kept {c}").alias(c) for c in extra))
    items = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    model = licenses.Model(["plain words of a text"] * 5)
    tagger = langid.Tagger().fit(["one two three", "un deux trois"], ["en", "fr"])
    runs = {
        "lines": (lines.dedup_lines(df), ("n_lines", "removed")), "bench": (dec.decontaminate(df, items), ("n_words", "n_hit", "items", "contaminated")),
        "mix": (mixing.mix(df, mixing.word_count(F.col("text"))), ("size", "source_size", "target", "copies", "taken")), "licences": (licenses.classify(df, model), ("licences",)),
        "language": (langid.identify(df, tagger), ("lang_pred", "score", "lang_shares", "lang_switches")), "fingerprint": (cws.fingerprint(df), ("fingerprint",)),
    }
    for name, (out, added) in runs.items():
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        got = out.collect()
        assert len(got) == len(rows), name
        for c in extra:
            assert c in added or all(r[c] == f"kept {c}" for r in got), (name, c)
    assert partenum.jaccard_components(df).count() == len(rows) == cws.edit_chain(df, 2).count()
    log = spark.createDataFrame([("r1", "http://a/x", 1, "response", 200, {"ETag": "1"}, "d"), ("v1", "http://a/x", 2, "revisit", 304, {"ETag": "1"}, None)], "record_id string, url string, m long, kind string, status int, headers map<string,string>, digest string")
    log = log.withColumn("date", F.timestamp_seconds("m")).select("*", *(F.lit(f"kept {c}").alias(c) for c in [*extra, "source", "source_id", "canonical_url", "result"]))
    out = warc.resolve_revisits(log)
    r = out.first()
    assert len({c.lower() for c in out.columns}) == len(out.columns) and (r.result, r.source_id, r.canonical_url) == ("resolved", "r1", "a/x") and r.source_digest == "d"
    assert all(r[c] == f"kept {c}" == r[f"source_{c}"] for c in [*extra, "source"] if c not in ("id",))


EDGE = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n ", "en", None), (4, "12 34 !!", "en", "a"), (5, "one line here\nand another one there", "en", "a"), (5, "one line here\nand another one there", "en", "a"),
        (6, "one line here\nand another one there", "en", "b"), (None, "without an id this text stays", "en", "b"), (None, "without an id this text stays", None, None), (7, "short", None, "b")]


def test_pipeline_stages_on_edge_cases(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, by each stage."""
    import corpus_pipeline as p
    from bandgraph.session import cut

    rng = random.Random(67)
    rows = [*EDGE, (8, "\n".join(prose(rng, 40) for _ in range(1_500)), "en", "c")]
    spark.createDataFrame([(1, " ".join(rows[10][1].split()[300:312]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"size": F.lit(1), "comp": F.lit(2), "key": F.lit(3), "removed": F.lit(4)})
    ids = lambda out: Counter(r.doc_id for r in out.select("doc_id").collect())
    got = {name: cut(stage(spark, df, str(tmp_path))) for name, stage in p.STAGES}
    assert ids(got["language"]) == {5: 2, 6: 1, None: 2, 7: 1, 8: 1}
    assert ids(got["line_dedup"]) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 2, 7: 1, 8: 1}  # the null ids are equal rows
    assert ids(got["ngram_jaccard"]) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 2, 7: 1, 8: 1}
    assert ids(got["decontamination"]) == Counter(i for i, *_ in rows if i != 8)
    assert set(ids(got["mixing"])) <= {4, 5, 6, 7, 8, None}
    for name, stage in p.STAGES:
        assert cut(stage(spark, df.where("doc_id < 0"), str(tmp_path))).count() == 0, name
        if name != p.STAGES[-1][0]:
            assert got[name].columns == df.columns


def test_pipeline_is_what_brute_force_gives(spark, tmp_path):
    import corpus_pipeline as p

    rng, rows = random.Random(71), []
    for i in range(40):
        rows.append([i, "\n".join(prose(rng, rng.randint(8, 20)) for _ in range(rng.randint(1, 4))), f"s{i % 3}"])
    for i in range(40, 50):
        w = rows[i - 40][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append([i, " ".join(w), "s1"])
    rows += [[50, rows[7][1], "s1"], [51, "1234 5678", "s1"], [52, None, "s2"], [53, prose(rng, 9) + "\n" + rows[9][1].split("\n")[0], "s2"]]
    items = [(0, " ".join(rows[12][1].split()[:11])), (1, prose(rng, 20))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    left = [r for r in rows if re.search("[a-z]", r[1] or "")]  # language
    kept = {}
    for i, text, gone in expected_lines(left)[0]:  # lines
        if not gone or normal(text):
            kept[i] = text
    left = [[i, kept[i], s] for i, _, s in left if i in kept]
    heads = {i: c for (i, _, c) in jaccard_truth(left, 5, 80)}
    left = [r for r in left if heads[r[0]] == r[0]]
    leaks = {tuple(w[k : k + 10]) for _, t in items for w in [t.split()] for k in range(max(len(w) - 9, 1))}  # a short item is one window
    leaked = lambda w: any(tuple(w[k : k + len(g)]) == g for g in leaks for k in range(len(w) - len(g) + 1))
    left = [r for r in left if not leaked(r[1].split())]
    size = {i: len(t.split()) for i, t, _ in left}
    got = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= set(size) and all(r.text == kept[r.doc_id] and r.size == size[r.doc_id] and r.n_chars == len(r.text) for r in got)
    assert 30 < len(size) < 50
    # The mix takes what fits: budget within a document, near the target of each source, and everything up to its caps.
    total = Counter()
    for r in got:
        total[r.source] += r.taken
        assert r.taken == r.copies * r.size <= 2 * r.size
    assert {s: sum(size[i] for i, _, x in left if x == s) for s in total} == {r.source: r.source_size for r in got}
    assert all(abs(total[r.source] - r.target) <= 2 * max(size.values()) for r in got)


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from bandgraph.session import cut, table

    df = table(spark, sf, "documents")
    for name, stage in p.STAGES:
        before = df
        df = cut(stage(spark, df, sf))
        assert df.count() <= before.count(), name
        if name != "mixing":
            assert df.columns == before.columns
    assert df.where("copies < 1").count() == 0 and df.count() > 50
