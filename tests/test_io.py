"""Readers, sinks and the driver contract."""

import json

import pytest
from pyspark.sql import functions as F

from bandgraph.sources import readers as R, sinks as W


def test_series_directory(spark, tmp_path):
    (tmp_path / "000001_a.csv").write_text("Date,Close,Code\n20240101,1.5,1.SZ\n20240102,-3,1.SZ\n20240102,2.5,1.SZ\n20240103,x,1.SZ\n", encoding="utf-8")
    (tmp_path / "2_b.csv").write_text("Date,Close,Code\n20240101,4,\n20240103,5,\n", encoding="utf-8")
    (tmp_path / "3_c.csv").write_text("Date,Close,Code\n20240101,4,\n", encoding="utf-8")
    got = sorted((r.entity, r.t.day, r.px) for r in R.series_directory(spark, str(tmp_path)).collect())
    assert got == [("000001", 1, 1.5), ("000001", 2, 2.5), ("000002", 1, 4.0), ("000002", 3, 5.0)]


def test_series_files_have_their_own_encodings_and_headers(spark, tmp_path):
    (tmp_path / "1_a.csv").write_bytes("交易日期,收盘价,股票代码\n2024-01-01,1.5,1.SZ\n2024-01-02,2,1.SZ\n".encode("gbk"))
    (tmp_path / "2_b.CSV").write_text("\ufeffcode,when,close,date\n2.SZ,x,3,20240101\n2.SZ,y,4,20240102\n", encoding="utf-8")
    (tmp_path / "3_c.csv").write_text("date,price\n20240101,3\n20240102,4\n")
    (tmp_path / "4_d.csv").write_text('day,"close"\r\n"20240101","7"\r\n20240102,8\r\n')
    got = sorted((r.entity, r.t.day, r.px) for r in R.series_directory(spark, str(tmp_path)).collect())
    assert got == [("000001", 1, 1.5), ("000001", 2, 2.0), ("000002", 1, 3.0), ("000002", 2, 4.0), ("000004", 1, 7.0), ("000004", 2, 8.0)]
    assert {r.entity for r in R.series_directory(spark, str(tmp_path), limit=1).collect()} == {"000001"}
    (tmp_path / "empty").mkdir()
    for path in ("empty", "none"):
        with pytest.raises(FileNotFoundError):
            R.series_directory(spark, str(tmp_path / path))
    (tmp_path / "empty" / "x.csv").write_text("date,price\n20240101,3\n")
    with pytest.raises(RuntimeError):
        R.series_directory(spark, str(tmp_path / "empty"))


def test_labels_after_colons(spark):
    from bandgraph.functions.keys import label_after_colon

    rows = [("a: b", "n"), ("a： b: c", "n"), ("x：y", "n"), ("x:", "n"), ("", "SW1 name"), (None, "SW2_x"), (None, None)]
    got = [r.o for r in spark.createDataFrame(rows, "d string, n string").coalesce(1).select(label_after_colon(F.col("d"), F.col("n")).alias("o")).collect()]
    assert got == ["b", "c", "y", "", "name", "_x", ""]


def test_industry_maps_and_checks(spark):
    from bandgraph.operators import evaluate as E, transforms as T

    info = spark.createDataFrame([("1", "1.SZ", "UNK"), ("2", "2.SZ", "Banks"), ("2", "2.SZ", "Steel"), ("3", "3.SZ", "nan")], "symbol string, ts_code string, industry string").coalesce(1)
    assert {r.code: r.industry for r in T.industry_map(info, strict=False).collect()} == {"000001": "UNK", "000002": "Steel"}
    with pytest.raises(ValueError):
        T.industry_map(info)
    ids = spark.createDataFrame([(k,) for k in range(4)], "entity long")
    good = [(0, "a"), (1, "a"), (2, "b"), (3, "b")]
    frame = lambda rows: spark.createDataFrame(rows, "entity long, industry string")
    T.check_industries(ids, frame(good))
    for bad in (good[:3], [*good[:3], (3, "unk")], [*good[:3], (3, "c")]):
        with pytest.raises(ValueError):
            T.check_industries(ids, frame(bad))
    rows = spark.createDataFrame([("2.SZ",), ("1",), ("",), ("000002",)], "entity string").coalesce(1)
    assert [r.entity for r in E.normal_universe(rows).collect()] == ["000002", "000001"]


def test_calendar_and_panel(spark, tmp_path):
    (tmp_path / "cal.csv").write_text("exchange,cal_date,is_open\nSSE,20240102,1\nSSE,20240103,0\nXX,20240104,1\nSSE,bad,1\n")
    assert [r.t.day for r in R.trade_calendar(spark, str(tmp_path / "cal.csv")).collect()] == [2]
    with pytest.raises(FileNotFoundError):
        R.trade_calendar(spark, str(tmp_path / "none.csv"))
    (tmp_path / "panel.csv").write_text("day,1.SZ,2.SZ\n2024-01-01,1,\n2024-01-02,,\n2024-01-03,2,3\n")
    got = sorted((r.entity, r.t.day, r.px) for r in R.price_panel(spark, str(tmp_path / "panel.csv"), "2024-01-02").collect())
    assert got == [("000001", 3, 2.0), ("000002", 3, 3.0)]


def test_universe_and_ids(spark, tmp_path):
    (tmp_path / "u.json").write_text("﻿" + json.dumps([{"id": "X_SW1_a", "class": None, "name": "SW1 a", "description": "d: Banks", "category": "equity", "symbols": ["1.SZ"]}]), encoding="utf-8")
    from bandgraph.operators.evaluate import label_table

    assert [(r.entity, r.label) for r in label_table(R.universe_rows(spark, str(tmp_path / "u.json")), "SW1").collect()] == [("000001", "Banks")]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        R.universe_rows(spark, str(tmp_path / "bad.json"))
    (tmp_path / "ids.txt").write_text("# c\n\nabc\n abc \nd\n")
    assert sorted(r.trial_id for r in R.trial_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["abc", "d"]


def test_sinks(spark, tmp_path):
    assert W.json_safe({"a": float("nan"), "b": [1, float("inf")], "c": tmp_path}) == {"a": None, "b": [1, None], "c": str(tmp_path)}
    df = spark.createDataFrame([("x", 1.0)], "trial_id string, ari double")
    W.write_csv(df, tmp_path / "o" / "m.csv")
    assert (tmp_path / "o" / "m.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    path = str(tmp_path / "rows")
    W.append_rows(df, path, "trial_id string, ari double, nmi double")
    W.append_rows(df.withColumn("other", F.lit(1)), path, "trial_id string, ari double, nmi double")
    assert spark.read.parquet(path).columns == ["trial_id", "ari", "nmi"] and spark.read.parquet(path).count() == 2
    assert len(W.sha256(spark, str(tmp_path / "o" / "m.csv")).first().sha256) == 64


def test_contract_names():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 50


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
