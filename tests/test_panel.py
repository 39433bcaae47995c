"""Panel operators against small closed forms and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandgraph import params
from bandgraph.functions import keys
from bandgraph.operators import panel as P, transforms as T


def frame(spark, rows):
    return spark.createDataFrame([(e, pd.Timestamp(t).to_pydatetime(), v) for e, t, v in rows], "entity string, t timestamp, px double")


def test_forward_fill_and_returns_use_the_whole_grid(spark):
    df = frame(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-03", 2.0), ("b", "2024-01-02", 4.0)])
    got = {(r.entity, r.t.day): r.filled for r in P.forward_filled(df).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 1.0, ("a", 3): 2.0, ("b", 1): None, ("b", 2): 4.0, ("b", 3): 4.0}
    r = {(x.entity, x.t.day): x.r for x in P.log_returns(df).collect()}
    assert r[("a", 3)] == pytest.approx(np.log(2)) and r[("b", 3)] == 0.0 and ("a", 1) not in r


def test_eligibility(spark):
    df = frame(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 1.0), ("a", "2024-01-03", 2.0), ("b", "2024-01-02", 4.0)])
    got = {r.entity: (r.coverage, r.flat_rate) for r in P.eligibility(df).collect()}
    assert got["a"] == (1.0, 0.5) and got["b"] == (pytest.approx(1 / 3), 1.0)
    with pytest.raises(ValueError):
        P.eligible(df, 0.9, 0.1)


def test_calendar_alignment(spark):
    df = frame(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 9.0), ("a", "2024-01-04", 2.0)])
    days = spark.createDataFrame([(pd.Timestamp(f"2024-01-0{d}").to_pydatetime(),) for d in (1, 3, 4, 5)], "t timestamp")
    assert [(r.t.day, r.px) for r in P.aligned(df, days).orderBy("t").collect()] == [(1, 1.0), (3, 1.0), (4, 2.0)]


def returns(spark, x):
    return spark.createDataFrame([(f"e{j}", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(v)) for (i, j), v in np.ndenumerate(x)], "entity string, t timestamp, r double")


def matrix(df, col="r"):
    return df.toPandas().pivot(index="t", columns="entity", values=col).to_numpy()


def test_winsorize_and_zscore_match_numpy(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    want = np.maximum(x, np.quantile(x, 0.1, axis=0))
    want = np.minimum(want, np.quantile(want, 0.9, axis=0))
    got = T.winsorized(returns(spark, x), 0.1, 0.1)
    assert np.allclose(matrix(got), want)
    assert np.allclose(matrix(T.zscored(got)), (want - want.mean(0)) / want.std(0, ddof=1))


def test_leave_one_out_residuals_are_orthogonal(spark):
    x = np.random.default_rng(2).normal(size=(25, 6)) + np.random.default_rng(3).normal(size=(25, 1))
    reg = T.leave_one_out(returns(spark, x)).cache()
    diag = T.leave_one_out_diagnostics(reg).toPandas()
    assert (diag.residual_factor.abs() < 1e-9).all() and diag.fits.all()
    f = (x.sum(1, keepdims=True) - x) / 5
    beta = [np.polyfit(f[:, k], x[:, k], 1)[0] for k in range(6)]
    assert np.allclose(diag.sort_values("entity").beta, beta)


def test_industry_means_vanish(spark):
    x = np.random.default_rng(4).normal(size=(10, 6))
    ind = spark.createDataFrame([(f"e{k}", "AABBCC"[k]) for k in range(6)], "entity string, industry string")
    got = T.industry_neutral(returns(spark, x), ind).join(ind, "entity").groupBy("t", "industry").agg(F.abs(F.avg("r")).alias("m"))
    assert got.agg(F.max("m")).first()[0] < 1e-12


def test_factor_universe_reasons(spark):
    e = spark.createDataFrame([(k,) for k in "123456"], "entity string")
    ind = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B"), ("5", "C"), ("6", "C")], "entity string, industry string")
    got = {r.entity: r.reason for r in T.factor_universe(e, ind).collect()}
    assert got == {"1": None, "2": None, "3": "industry_size_lt_2", "4": "missing_industry", "5": None, "6": None}


def test_industry_map_conflicts(spark):
    info = spark.createDataFrame([("1", "000001.SZ", "A"), ("1", "000001.SZ", "B"), ("2", "000002.SZ", " nan ")], "symbol string, ts_code string, industry string")
    with pytest.raises(ValueError):
        T.industry_map(info)
    assert [(r.code, r.industry) for r in T.industry_map(info, strict=False).collect()] == [("000001", "B")]


def test_modes_and_params():
    with pytest.raises(ValueError):
        T.in_mode(None, "other")
    for bad in ({"wavelet": "haar"}, {"level": 7}, {"reducer": "sum"}, {"layer_step": -1.0}, {"negative_weight": -1.0}, {"layer_weighting": 1}, {"unknown": 1}):
        with pytest.raises(ValueError):
            params.from_dict(bad)
    assert params.band_names(4) == ["CA4", "CD4", "CD3", "CD2", "CD1"]
    with pytest.raises(ValueError):
        params.check_sweep(1, 1.5)


def test_entity_codes(spark):
    rows = [(" 1.sz ",), ("1234567",), (None,), ("nan",), ("600000.SH",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(keys.entity_code(F.col("c"))).collect()]
    assert got == ["000001", "1234567", "", "", "600000"]
