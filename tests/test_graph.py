"""Wavelets, similarities, scores, clusterings and agreement."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandgraph.functions import vectors as V
from bandgraph.operators import dependence as D, evaluate as E, graph as G, matrix_cluster as M, ranks, scores as S, similarity as SIM, wavelets as W
from bandgraph.params import check_signed
from bandgraph.plans import experiments as X


def pair(spark, s):
    return spark.createDataFrame([(0, 1, [float(x) for x in s])], "i long, j long, s array<double>")


def test_reducers_closed_forms(spark):
    got = S.signed_scores(S.signed_terms(pair(spark, [1, 1, 0.25, 0.0625]), 1.25), 1.0, S.PRESETS).first().asDict()
    want = {"max_weighted": 2, "mean_weighted": 1.5, "median_weighted": 1.5, "geometric_weighted": 3 ** (1 / 3) * 0.5 ** (1 / 3) * 2 ** (1 / 3), "max_unweighted": 1, "mean_unweighted": 7 / 12}
    x = [2 * 1.0, 3 * 0.5, 4 * 0.25]
    want["geometric_weighted"] = (x[0] * x[1] * x[2]) ** (1 / 3)
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_negative_bands_count_with_their_weight(spark):
    got = S.signed_score(pair(spark, [-0.5, -0.5, 0.5]), 0.0, 2.0, "max", False).first().w
    assert got == pytest.approx(1.0)


@pytest.mark.parametrize("bad", [{"reducer": "sum"}, {"interaction": "product"}, {"layer_step": -1.0}, {"negative_weight": -1.0}, {"layer_weighting": 1}])
def test_score_parameters(bad):
    with pytest.raises(ValueError):
        check_signed(**({"layer_step": 1.0, "negative_weight": 1.0, "reducer": "max", "layer_weighting": True} | bad))


@pytest.mark.parametrize("wavelet", list(V.LOW))
@pytest.mark.parametrize("n", [32, 37])
def test_modwt_keeps_energy_and_sql_is_numpy(spark, wavelet, n):
    v = np.random.default_rng(5).normal(size=n)
    bands = W.modwt_numpy(v, wavelet, 2)
    if n % 4 == 0:
        assert sum((b**2).sum() for b in bands) == pytest.approx((v**2).sum())
    df = spark.createDataFrame([("e", v.tolist())], "entity string, v array<double>")
    assert np.allclose(W.modwt(df, wavelet, 2).first().bands, bands)


def test_dwt_keeps_energy_of_long_series():
    v = np.random.default_rng(6).normal(size=64)
    bands = W.dwt_numpy(v, "sym2", 1)
    assert len(bands[0]) == (64 + 3) // 2 == len(bands[1])


def test_pairs_by_blocks_and_sql_agree(spark):
    x = np.random.default_rng(7).normal(size=(9, 2, 6))
    x /= np.sqrt((x**2).sum(-1, keepdims=True))
    df = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(x)], "entity long, bands array<array<double>>")
    want = {(i, j): [float(x[i, b] @ x[j, b]) for b in (0, 1)] for i, j in combinations(range(9), 2)}
    for engine in ("blocks", "sql"):
        for block in (4, 100):
            got = {(r.i, r.j): r.s for r in SIM.all_pairs(df, engine, block).collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want), (engine, block)
            # Columns that nothing asks for are pruned below the products of blocks.
            pairs = SIM.all_pairs(df, engine, block)
            assert pairs.count() == len(want) and pairs.select(F.get("s", F.lit(0)).alias("s")).where("s IS NOT NULL").count() == len(want)
            assert {r.j for r in pairs.withColumn("t", F.lit(1)).select("j").collect()} == set(range(1, 9))


def test_pairs_made_anew(spark):
    x = np.random.default_rng(8).normal(size=(11, 3, 5))
    x /= np.sqrt((x**2).sum(-1, keepdims=True))
    df = spark.createDataFrame([(f"e{i:02}", b.tolist()) for i, b in enumerate(x)], "entity string, bands array<array<double>>")
    want = {(f"e{i:02}", f"e{j:02}"): [float(np.round(x[i, b] @ x[j, b], 9)) for b in range(3)] for i, j in combinations(range(11), 2)}
    for block in (3, 100):
        sim = SIM.Pairs(df, block, SIM.PLACES)
        rows = sim.rows()
        assert {(r.i, r.j): r.s for r in rows.collect()} == want
        assert {(r.i, r.j) for r in sim.rows(over=0.1).collect()} == {k for k, s in want.items() if s[0] > 0.1 and max(s[1:]) > 0.1}
        assert sim.threshold(0.9) == pytest.approx(S.threshold(rows, 11, 0.9).first().tau, abs=1e-15)
        one, two = sim.summary(1).first(), SIM.matrix_summary(rows, 11, 1).first()
        assert all(np.allclose(one[c], two[c], atol=1e-14, rtol=0) for c in two.asDict())
    none = SIM.Pairs(df.where("entity = ''"), places=SIM.PLACES)
    assert none.rows().count() == 0 and none.threshold(0.9) == 0.0 and none.summary(0).first()["mean"] is None


@pytest.mark.parametrize("name", ["similarity_threshold", "matrix_summary", "adjacency", "sim_cosine", "sub_universe"])
def test_no_table_of_all_pairs_is_written(spark, sf, name):
    from pathlib import Path

    from bandgraph.plans.queries import QUERIES
    from bandgraph.session import shared_dir

    folders = lambda: set(Path(shared_dir(spark)).glob("cut-*"))
    before = folders()
    QUERIES[name](spark, sf).count()
    written = folders() - before
    assert written and not any("s" in spark.read.parquet(str(f)).columns for f in written)


@pytest.mark.parametrize("name", ["adjacency", "adjacency_stats"])
def test_edges_that_are_read_once_are_not_written(spark, sf, name):
    from pathlib import Path

    from bandgraph.plans.queries import QUERIES
    from bandgraph.session import shared_dir

    folders = lambda: set(Path(shared_dir(spark)).glob("cut-*"))
    before = folders()
    assert QUERIES[name](spark, sf).count()
    assert not any("w" in spark.read.parquet(str(f)).columns for f in folders() - before)


def test_columns_of_pairs_are_what_spark_makes_of_rows(spark):
    x = np.random.default_rng(9).normal(size=(11, 3, 5))
    x[1], x[2] = x[0], -x[0]
    x /= np.sqrt((x**2).sum(-1, keepdims=True))
    sim = SIM.Pairs(spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(x)], "entity long, bands array<array<double>>"), 4, SIM.PLACES)
    want = {(r.i, r.j): r.w for r in S.dense_score(sim.rows(), 1.5).withColumn("w", F.round("w", 6) + F.lit(0.0)).collect()}
    got = sim.columns(lambda v: [S.dense_values(v, 1.5, 6)], ["w"]).collect()
    assert len(got) == len(want) == 55 and {(r.i, r.j): r.w for r in got} == want


def test_half_up_is_sparks_round(spark):
    rng = np.random.default_rng(10)
    halves = (rng.integers(-2_000_000, 2_000_000, 2_000) * 1000 + 500) / 1e9
    v = np.concatenate([halves, np.nextafter(halves, 9), np.nextafter(halves, -9), rng.normal(size=2_000), [0.0, -0.0, -4e-7, 1.0, -1.0]])
    got = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "k int, x double").select("k", (F.round("x", 6) + F.lit(0.0)).alias("x")).orderBy("k").collect()
    assert V.half_up(v, 6).tobytes() == np.array([r.x for r in got]).tobytes()


def test_ranked_bands_are_spearman(spark):
    df = spark.createDataFrame([(0, [[1.0, 2.0, 3.0, 4.0]]), (1, [[4.0, 3.0, 2.0, 1.0]]), (2, [[1.0, 1.0, 2.0, 2.0]])], "entity long, bands array<array<double>>")
    got = {(r.i, r.j): r.s[0] for r in SIM.all_pairs(W.ranked_bands(df)).collect()}
    assert got[(0, 1)] == pytest.approx(-1) and got[(0, 2)] == pytest.approx(2 / np.sqrt(5))


def test_threshold_counts_zero_diagonals(spark):
    sim = spark.createDataFrame([(0, 1, [0.5, 0.2])], "i long, j long, s array<double>")
    assert S.threshold(sim, 2, 0.75).first().tau == pytest.approx(np.quantile([0.5, 0.5, 0, 0, 0.2, 0.2, 0, 0], 0.75))


def test_dependence_of_equal_and_reversed_bands(spark):
    rows = [(i, j, [float(k), -float(k)]) for k, (i, j) in enumerate(combinations(range(4), 2))]
    got = {(r.band_l, r.band_r): r for r in D.dependence(spark.createDataFrame(rows, "i long, j long, s array<double>"), 2).collect()}
    assert got[(0, 1)].spearman == -1 and got[(0, 1)].nmi == pytest.approx(1) and got[(0, 1)].vi == pytest.approx(0, abs=1e-12) and got[(0, 0)].spearman == 1


def test_agreement_matches_pair_counting(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 3, 12), rng.integers(0, 3, 12)
    same = [(a[i] == a[j], b[i] == b[j]) for i, j in combinations(range(12), 2)]
    n, s, sa, sb = len(same), sum(p and q for p, q in same), sum(p for p, _ in same), sum(q for _, q in same)
    want = (s - sa * sb / n) / ((sa + sb) / 2 - sa * sb / n)
    df = spark.createDataFrame([(str(x), str(y)) for x, y in zip(a, b, strict=True)], "label string, cluster_id string")
    got = E.agreement(E.contingency(df)).first()
    assert got.ari == pytest.approx(want)
    one = E.agreement(E.contingency(spark.createDataFrame([("x", "1"), ("x", "1")], "label string, cluster_id string"))).first()
    assert one.ari == 1 and one.nmi == 1
    none = E.agreement(E.contingency(df.where("label = 'q'"))).first()
    assert none.ari is None and none.nmi is None


def planted(k=3, n=8, seed=9):
    rng = np.random.default_rng(seed)
    truth = np.repeat(np.arange(k), n)
    s = np.where(truth[:, None] == truth, 0.9, 0.05) + rng.random((k * n, k * n)) * 0.04
    s = (s + s.T) / 2
    np.fill_diagonal(s, 0)
    return truth, s


@pytest.mark.parametrize("name", [*M.MATRIX, *M.LANDMARK])
def test_matrix_clusterers_recover_blocks(spark, name):
    truth, s = planted()
    i, j = np.triu_indices(len(s), 1)
    edges = spark.createDataFrame([("t", int(p), int(q), float(s[p, q])) for p, q in zip(i, j, strict=True)], "trial string, i long, j long, w double")
    ids = spark.createDataFrame([(k,) for k in range(len(s))], "entity long")
    options = {} if name == "louvain" else {"n_clusters": 3}
    options |= {"k": 7} if name == "knn_spectral" else {"landmarks": 9} if name in M.LANDMARK else {}
    got = M.run_clusterer(edges, ids, name, **options).toPandas().sort_values("entity").cluster_id.tolist()
    assert len(set(zip(truth.tolist(), got, strict=True))) == 3 == len(set(got)), got


def test_components_and_mcl(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (4, 5, 1.0)], "i long, j long, w double")
    ids = spark.createDataFrame([(k,) for k in range(7)], "entity long")
    got = {r.entity: r.cluster_id for r in G.assigned(G.components(e), ids).collect()}
    assert got == {0: "0", 1: "0", 2: "0", 3: "3", 4: "4", 5: "4", 6: "6"}
    flow = G.start_flow(e, ids)
    sums = {r.col: r.p for r in flow.groupBy("col").agg(F.sum("p").alias("p")).collect()}
    assert all(abs(v - 1) < 1e-12 for v in sums.values())
    labels = {r.entity: r.cluster_id for r in G.mcl_labels(G.mcl(e, ids, 2.0), ids).collect()}
    assert labels[0] == labels[1] == labels[2] and labels[4] == labels[5] and labels[3] == "3"


def test_trials(spark):
    a = X.trial_id({"level": 2}, {"kind": "mcl", "workers": 4})
    assert a == X.trial_id({"level": 2}, {"workers": 8, "kind": "mcl"}) and len(a) == 16
    grid = X.trials(spark, {"level": [2, 3]}, {"mcl": {"inflation": [1.4, 1.8]}, "louvain": {}})
    assert grid.count() == 6 and grid.select("trial_id").distinct().count() == 6
    assert [r["index"] for r in X.chosen(grid, None, 3, 1).collect()] == [1, 4]
    with pytest.raises(RuntimeError):
        X.require(X.gate({"n": 3}, {"n": 4}))


def test_landmarks_of_two_trials_and_many_clusters(spark):
    truth, s = planted()
    i, j = np.triu_indices(len(s), 1)
    rows = [(t, int(p), int(q), float(s[p, q])) for t in ("a", "b") for p, q in zip(i, j, strict=True)]
    ids = spark.createDataFrame([(k,) for k in range(len(s))], "entity long")
    got = M.run_clusterer(spark.createDataFrame(rows, "trial string, i long, j long, w double"), ids, "nystrom_spectral_power", n_clusters=3, landmarks=24).toPandas()
    for _, one in got.groupby("trial"):
        assert len(one) == len(s) and len(set(zip(truth.tolist(), one.sort_values("entity").cluster_id.tolist(), strict=True))) == 3
    assert len(M.chosen_landmarks(ids, 3, 9)) == 9 and M.chosen_landmarks(ids, 3, 9) == M.chosen_landmarks(ids.orderBy(F.desc("entity")), 3, 9)


def test_similarities_with_landmarks_and_slices(spark):
    x = np.random.default_rng(7).normal(size=(9, 2, 6))
    x /= np.sqrt((x**2).sum(-1, keepdims=True))
    df = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(x)], "entity long, bands array<array<double>>")
    got = {(r.i, r.j): r.s for r in SIM.with_landmarks(df, [2, 5]).collect()}
    assert got.keys() == {(i, j) for i in range(9) for j in (2, 5) if i != j} and all(np.allclose(v, [x[i, b] @ x[j, b] for b in (0, 1)]) for (i, j), v in got.items())
    sim = SIM.all_pairs(df)
    part = {(r.i, r.j): r.s for r in SIM.restricted(sim, df.where("entity % 2 = 0")).collect()}
    assert part == {(r.i, r.j): r.s for r in sim.collect() if r.i % 2 == r.j % 2 == 0}


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_quantiles(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL", small)
    rng, shares = np.random.default_rng(3), [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for x in (rng.normal(size=3_000), np.round(rng.normal(size=900), 1), np.r_[np.zeros(500), rng.random(300) * 1e-300, 1e300], np.array([4.5])):
        n = rng.integers(1, 4, len(x))
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, n, strict=True)] + [(None, 3)], "x double, n long")
        assert np.allclose(ranks.quantiles(df, shares), np.quantile(np.repeat(x, n), shares), rtol=1e-12, atol=0)
    assert ranks.quantiles(df.where("x < 0"), [0.5]) == [None]


def test_places_and_ranks(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame([(int(k % 2), float(v), int(k)) for k, v in enumerate(x)], "g int, x double, i long")
    got = ranks.ranked(df, "g", "x", ("i",)).toPandas()
    for _, one in got.groupby("g"):
        one = one.sort_values(["x", "i"])
        assert one.place.tolist() == list(range(len(one))) and (one["rank"] == one.x.rank()).all() and (one["size"] == len(one)).all()


def test_scores_from_kept_terms_are_those_made_alone(spark):
    x = np.random.default_rng(8).uniform(-1, 1, size=(60, 4))
    sim = spark.createDataFrame([(k, k + 1, [float(v) for v in row]) for k, row in enumerate(x)], "i long, j long, s array<double>")
    kept = S.signed_scores(S.signed_terms(sim, 1.25).cache(), 1.5, S.PRESETS).orderBy("i").toPandas()
    for name, (reducer, weighting) in S.PRESETS.items():
        alone = S.signed_score(sim, 1.5, 1.25, reducer, weighting).orderBy("i").toPandas().w
        assert (alone == kept[name]).all(), name  # bit by bit


def test_power_iteration_and_matched_partitions(spark):
    truth, s = planted()
    i, j = np.triu_indices(len(s), 1)
    edges = spark.createDataFrame([(int(p), int(q), float(s[p, q] > 0.5)) for p, q in zip(i, j, strict=True)], "i long, j long, w double")
    got = M.power_iteration(edges, 3).orderBy("entity").toPandas()
    assert len(got) == len(s)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "entity long, cluster_id string")
    assert E.matched(a, a).count() == 2
    for bad in (a.union(a), a.where("entity = 1")):
        with pytest.raises(ValueError):
            E.matched(a, bad)
