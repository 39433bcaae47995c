"""Readers of panels, series files, calendars, metadata, label universes and configurations."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bandgraph.functions.keys import entity_code
from bandgraph.operators import panel as P

#: Header names by meaning, in lower case.
ALIASES = {"date": {"date", "trade_date", "datetime", "time", "日期", "交易日期"}, "close": {"close", "close_price", "adj_close", "收盘", "收盘价"}, "code": {"code", "ts_code", "symbol", "股票代码", "代码"}}
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb18030")


def load_config(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def workspace_path(path: str | Path, base: str | Path | None = None) -> Path:
    """path itself if absolute, else under base or the working directory."""
    p = Path(path)
    return p if p.is_absolute() else Path(base or Path.cwd()) / p


def find_column(columns: list[str], kind: str, default: str | None = None) -> str | None:
    return next((c for c in columns if c.strip().lower() in ALIASES[kind]), default)


def parsed_date(c: Column) -> Column:
    c = c.cast("string")
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMdd")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("yyyy/MM/dd")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))


def trade_calendar(spark: SparkSession, path: str, exchange: str = "SSE") -> DataFrame:
    """(t) of the exchange's open days, distinct; a missing file is a FileNotFoundError."""
    try:
        rows = spark.read.csv(path, header=True)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return calendar(rows, exchange)


def calendar(rows: DataFrame, exchange: str = "SSE") -> DataFrame:
    days = rows.where((F.col("exchange") == exchange) & (F.expr("try_cast(is_open AS int)") == 1))
    return days.select(F.try_to_timestamp(F.col("cal_date").cast("string"), F.lit("yyyyMMdd")).alias("t")).where("t IS NOT NULL").distinct()


def _series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, row, date, close, code) as text of files (file, content), each in its own encoding and with its own header."""
    names = ["file", "row", "date", "close", "code"]
    for files in batches:
        for file, content in zip(files.file, files.content, strict=True):
            for encoding in ENCODINGS:
                try:
                    text = bytes(content).decode(encoding).removeprefix("\ufeff")
                    break
                except UnicodeDecodeError as e:
                    last = e
            else:
                raise RuntimeError(f"{file} is in none of {ENCODINGS}") from last
            lines = csv.reader(io.StringIO(text))
            head = next(lines, [])
            at = {kind: next((i for i, c in enumerate(head) if c.strip().lower() in ALIASES[kind]), None) for kind in ALIASES}
            if at["close"] is None:
                continue
            cell = lambda v, i: v[i].strip() if i is not None and i < len(v) else None
            rows = [(file, k, cell(v, at["date"] or 0), cell(v, at["close"]), cell(v, at["code"])) for k, v in enumerate(lines)]
            for k in range(0, len(rows), 50_000):
                yield pd.DataFrame(rows[k : k + 50_000], columns=names)


def series_directory(spark: SparkSession, directory: str, start: str | None = None, end: str | None = None, days: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The panel of a folder of CSV files, one entity each; each file has its own encoding and header.

    Columns are found by alias; without a date column the first is it, a file without a close column gives nothing. A value
    is valid if its date parses and its price is a finite number over 0. The entity is the first valid code, else the file's
    name up to the first '_'. Of equal dates in a file the last counts, of equal entities the last file; series of one value go.
    A folder that is missing or has no CSV file is a FileNotFoundError, one without any series a RuntimeError.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").load(directory)
    except AnalysisException as e:
        raise FileNotFoundError(directory) from e
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if limit:
        files = files.join(F.broadcast(files.select("file").orderBy("file").limit(limit)), "file", "left_semi")
    if files.select("file").isEmpty():
        raise FileNotFoundError(f"no CSV file in {directory}")
    rows = files.mapInPandas(_series, "file string, row bigint, date string, close string, code string")
    rows = rows.select("file", F.regexp_extract("file", r"^([^_.]*)", 1).alias("stem"), "row", parsed_date(F.col("date")).alias("t"), F.col("close").try_cast("double").alias("px"), "code")
    rows = rows.where("t IS NOT NULL AND px > 0 AND NOT isnan(px) AND px < double('infinity')")
    found = rows.groupBy("file").agg(F.coalesce(F.min_by("code", F.when(F.trim("code") != "", F.col("row"))), F.first("stem")).alias("code"))
    values = rows.groupBy("file", "t").agg(F.max_by("px", "row").alias("px")).where(F.col("t").between(start or "0001-01-01", end or "9999-12-31"))
    values = values.join(found.select("file", entity_code(F.trim("code")).alias("entity")), "file").select("file", "entity", "t", "px")
    long = values.withColumn("n", F.count("*").over(Window.partitionBy("file"))).where("n > 1").drop("n") if days is None else values
    last = long.groupBy("entity").agg(F.max("file").alias("file"))
    out = long.join(last, ["entity", "file"], "left_semi").select("entity", "t", "px")
    if days is not None:
        out = P.aligned(out, days)
        out = out.withColumn("n", F.count("*").over(Window.partitionBy("entity"))).where("n > 1").drop("n")
    if out.isEmpty():
        raise RuntimeError(f"no series in {directory}")
    return out


def result_dirs(spark: SparkSession, root: str, prefer: str = "metrics") -> list[tuple[str, DataFrame, dict]]:
    """(name, rows, manifest) of every run folder under root that has metrics.csv or summary.csv (the preferred first) or a
    Parquet folder results; columns of CSV files are text."""
    found, names = [], ["metrics.csv", "summary.csv"] if prefer == "metrics" else ["summary.csv", "metrics.csv"]
    for folder in sorted(p for p in Path(root).iterdir() if p.is_dir()):
        file = next((folder / n for n in names if (folder / n).exists()), None)
        if file:
            rows = spark.read.csv(str(file), header=True)
        elif (folder / "results").exists():
            rows, file = spark.read.parquet(str(folder / "results")), folder / "results"
        else:
            continue
        manifest = folder / "run_manifest.json"
        found.append((folder.name, rows.withColumn("_source_file", F.lit(str(file))).withColumn("_result_dir", F.lit(str(folder))), json.loads(manifest.read_text(encoding="utf-8")) if manifest.exists() else {}))
    return found


def price_panel(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, prefer_parquet: bool = True) -> DataFrame:
    """The panel of a wide table (date, a column per entity); a Parquet file beside a CSV is preferred."""
    wide = None
    if prefer_parquet and path.endswith(".csv"):
        try:
            wide = spark.read.parquet(path[:-4] + ".parquet")
        except AnalysisException:
            wide = None
    if wide is None:
        wide = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    date = wide.columns[0]
    cast = wide.select(parsed_date(F.col(f"`{date}`")).alias("t") if dict(wide.dtypes)[date] == "string" else F.col(f"`{date}`").cast("timestamp").alias("t"), *(F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in wide.columns[1:]))
    long = P.unpivot(cast, "t").withColumn("entity", entity_code(F.col("entity")))
    return long.where(F.col("t").between(start or "0001-01-01", end or "9999-12-31"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, so that codes keep their zeros."""
    return spark.read.csv(path, header=True, inferSchema=False)


def universe_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, class, name, description, category, symbols) of a JSON array; anything else is an error."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", "^\\uFEFF", "")), 1, 1).alias("c")).first()
    if head is None or head.c != "[":
        raise ValueError("a label universe is a JSON array")
    return spark.read.schema("id string, class string, name string, description string, category string, symbols array<string>").json(path, multiLine=True)


def trial_ids(spark: SparkSession, path: str) -> DataFrame:
    """(trial_id) of a text file, without blanks and # comments."""
    return spark.read.text(path).select(F.trim("value").alias("trial_id")).where("trial_id <> '' AND trial_id NOT LIKE '#%'").distinct()


def weekly_panel(lineitem: DataFrame, unit: str = "week") -> DataFrame:
    """(entity, t, px): suppliers' mean unit price by week or month of shipping."""
    return lineitem.groupBy(F.col("l_suppkey").alias("entity"), F.date_trunc(unit, "l_shipdate").alias("t")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("px"))
