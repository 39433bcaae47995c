"""Writers of results, manifests and digests."""

from __future__ import annotations

import csv
import json
import math
import platform
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from bandgraph.session import delete


def json_safe(x):
    """x in what JSON has: numbers of numpy as plain ones, paths and times as text, numbers that aren't finite as null."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [json_safe(v) for v in x]
    if hasattr(x, "tolist"):
        return json_safe(x.tolist())
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x if x is None or isinstance(x, (bool, int, str)) else str(x)


def write_json(value, path: str | Path) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(json_safe(value), ensure_ascii=False, indent=2), encoding="utf-8")


def write_csv(df: DataFrame, path: str | Path) -> None:
    """A small result as one CSV file with a byte order mark; large ones go through write_rows."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(path, index=False, encoding="utf-8-sig")


def write_rows_csv(rows: list[dict], path: str | Path) -> None:
    """A driver's list of rows as CSV with a byte order mark; columns in order of their first row, absent values blank."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    names = list(dict.fromkeys(k for r in rows for k in r))
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.DictWriter(f, names)
        out.writeheader()
        out.writerows({k: json.dumps(v) if isinstance(v, (list, dict)) else v for k, v in json_safe(r).items()} for r in rows)


def write_yaml(value: dict, path: str | Path) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(json_safe(value), allow_unicode=True, sort_keys=False), encoding="utf-8")


def write_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows as JSON lines."""
    rows.write.mode(mode).json(path)


def write_rows(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def append_rows(df: DataFrame, path: str, schema: str) -> None:
    """Appends to a results table of a fixed schema: absent columns are null, others are left out."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    df.select(*cols).write.mode("append").parquet(path)


def write_run(metrics: dict, assignments: DataFrame, folder: str | Path, manifest: dict) -> None:
    folder = Path(folder)
    write_csv(assignments, folder / "cluster_assignments.csv")
    write_rows_csv([metrics], folder / "metrics.csv")
    write_json(manifest, folder / "run_manifest.json")
    write_json(metrics, folder / "metrics.json")  # the last, as it tells that a run is done


def remove(spark: SparkSession, path: str) -> None:
    delete(spark, path)


def sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def environment(spark: SparkSession) -> dict:
    versions = {}
    for name in ("numpy", "pandas", "pyarrow", "py4j"):
        try:
            versions[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            versions[name] = None
    return {"versions": versions, "spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "master": spark.sparkContext.master}


def pivoted(rows: DataFrame, value: str, by: str = "operator") -> DataFrame:
    return rows.groupBy("level").pivot(by).agg(F.first(value))
