"""Session and shared-folder helpers used by every subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bandgraph")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="bandgraph-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Scratch scopes that are open, the innermost last.
_open: list[Scratch] = []


class Scratch:
    """A scope of cut(): at its end, folders that were cut inside are deleted, but for those of kept frames.

    What is kept must be cut itself, and lazy frames made inside must not be used outside. Kept folders then belong to the
    scope around, if there is one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._cut)
        return df

    def free(self, *frames: DataFrame) -> None:
        """Delete the folders of cut frames now."""
        for df in frames:
            if df._cut in self.paths:
                self.paths.remove(df._cut)
                delete(self.spark, df._cut)

    def __exit__(self, kind, *_) -> None:
        _open.remove(self)
        for path in self.paths:
            if path not in self.kept:
                delete(self.spark, path)
            elif _open:
                _open[-1].paths.append(path)


class Pending(Scratch):
    """A scope whose folders stay at its end, as a lazy result reads them; release() deletes them."""

    def __exit__(self, kind, *_) -> None:
        _open.remove(self)

    def release(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    One Parquet write computes the plan once, which DataFrame.checkpoint() doesn't (it counts, then writes). The folder
    lives as long as the innermost open scope.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if _open:
        _open[-1].paths.append(path)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out
